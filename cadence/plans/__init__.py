"""Models, evaluations and the query catalogue."""
