"""Relational operators over stints, possessions, events and lineups."""
