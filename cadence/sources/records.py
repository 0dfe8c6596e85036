"""Readers and writers of stint tables, splits, profiles, production and model files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract


class ContractError(ValueError):
    """A file or table that breaks the record contract."""


def read_stints(spark: SparkSession, path: str) -> DataFrame:
    """``.jsonl`` (one object a line, blank lines skipped) or a ``.json`` file with ``stints: [...]``.

    Lines that aren't objects, unknown fields, missing fields and other versions are errors.
    """
    lines = spark.read.text(path, wholetext=path.endswith(".json")).where(F.trim("value") != "")
    if path.endswith(".json"):
        lines = lines.select(F.explode(F.from_json("value", "stints array<string>")["stints"]).alias("value"))
    keys = lines.select("value", F.json_object_keys("value").alias("keys"))
    known = F.array(*map(F.lit, contract.SCHEMA.names))
    required = F.array(*[F.lit(c) for c in contract.SCHEMA.names if c != "schema_version"])
    bad = keys.agg(
        F.sum(F.col("keys").isNull().cast("int")).alias("not_objects"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_except("keys", known))))), ", ").alias("unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_except(required, "keys"))))), ", ").alias("missing"),
    ).first()
    if bad["not_objects"] or bad["unknown"] or bad["missing"]:
        raise ContractError(f"{path}: {bad['not_objects'] or 0} lines aren't objects; unknown fields: {bad['unknown'] or 'none'}; missing fields: {bad['missing'] or 'none'}")
    table = lines.select(F.from_json("value", contract.SCHEMA).alias("s")).select("s.*")
    other = table.where(F.coalesce("schema_version", F.lit(contract.VERSION)) != contract.VERSION)
    if not other.isEmpty():
        raise ContractError(f"{path}: other schema versions than {contract.VERSION}")
    return contract.canonical(table)


def write_stints(stints: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; reads back as it was."""
    names = sorted(c for c in stints.columns if c in contract.SCHEMA.names)
    missing = contract.missing_fields(stints)
    full = stints.withColumns({c: F.lit(None).cast(contract.SCHEMA[c].dataType) for c in missing}).withColumn("schema_version", F.lit(contract.VERSION))
    names = sorted(set(names) | set(missing) | {"schema_version"})
    full.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_production(rows: DataFrame, meta: dict, path: str) -> None:
    """Production rows, and one ``_meta`` row with how they were made."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "_meta string")
    head.unionByName(rows.withColumn("_meta", F.lit(None).cast("string")), allowMissingColumns=True).write.mode("overwrite").json(path)


def read_production(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    every = spark.read.json(path)
    meta = every.where(F.col("_meta").isNotNull()).select("_meta").first()
    return every.where(F.col("_meta").isNull()).drop("_meta"), json.loads(meta[0]) if meta else {}


def write_split(split: DataFrame, kind: str, parameters: dict, path: str) -> None:
    """(stint_id, side) by side, with the kind and its parameters."""
    split.withColumns({"kind": F.lit(kind), "parameters": F.lit(json.dumps(parameters, sort_keys=True))}).write.mode("overwrite").partitionBy("side").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stint_id string, kind string, parameters string, side string").json(path)


FIT_VERSION = 1


def save_fit(fit, spark: SparkSession, path: str) -> None:
    """Coefficients, factor and variances as Parquet, under a version."""
    meta = json.dumps({"version": FIT_VERSION, "variances": fit.variances, "sigma2": fit.sigma2, "log_likelihoods": fit.log_likelihoods}, sort_keys=True)
    rows = [(i, c, float(v), f.tolist(), meta if i == 0 else None) for i, (c, v, f) in enumerate(zip(fit.columns, fit.coef, fit.covariance_factor))]
    spark.createDataFrame(rows, "place int, col string, coef double, factor array<double>, meta string").write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str):
    import numpy as np

    from ..plans.linear import Fit

    rows = spark.read.parquet(path).orderBy("place").collect()  # the model's size
    meta = json.loads(rows[0]["meta"])
    if meta["version"] != FIT_VERSION:
        raise ContractError(f"model version {meta['version']} isn't {FIT_VERSION}")
    return Fit([r["col"] for r in rows], np.array([r["coef"] for r in rows]), np.array([r["factor"] for r in rows]), meta["variances"], meta["sigma2"], meta["log_likelihoods"])


def schema_fingerprint(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: the merged, value-free schema of JSON texts and its sha256."""
    merged = lines.agg(F.expr(f"schema_of_variant_agg(parse_json({column}))").alias("schema"))
    return merged.withColumn("fingerprint", F.sha2("schema", 256))


def csv_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, header fingerprint and rows of CSV files."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.where("start = 0").groupBy("file").agg(F.first("value").alias("header"))
    return lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("rows")).join(first, "file").select("file", F.sha2("header", 256).alias("header_sha256"), "rows")


#: Spark reads a file's bytes as one value, of under 2 GB.
MAX_FILE = (1 << 31) - 1


def stint_files(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of the data files of a table of stints, be it one file or a folder of parts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = raw.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(~F.col("file").rlike(r"^[._]"))
    large = [r["file"] for r in named.where(F.col("length") > MAX_FILE).select("file").limit(5).collect()]
    if large:
        raise ValueError(f"files of over 2 GB can't be hashed, write them in parts: {', '.join(large)}")
    return named.select("file", F.sha2("content", 256).alias("sha256"))


def stints_manifest(spark: SparkSession, path: str) -> dict:
    """What ``checked_stints`` holds a table against: rows, possessions, and each file's sha256."""
    totals = read_stints(spark, path).agg(F.count(F.lit(1)).alias("stints_written"), F.coalesce(F.sum("offensive_possessions"), F.lit(0)).alias("accepted_possessions")).first().asDict()
    return totals | {"files": {r["file"]: r["sha256"] for r in stint_files(spark, path).collect()}}  # a row for each file


def checked_stints(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """The stints of a file or folder, if it is the one that the manifest lists: the same files with
    the same sha256 (``files``: name to sha256; or ``stints_sha256`` for a single file), number of rows and
    possessions; else ValueError with all that differs."""
    found = stints_manifest(spark, path)
    files = found.pop("files")
    if "stints_sha256" in manifest:
        found["stints_sha256"] = next(iter(files.values())) if len(files) == 1 else f"{len(files)} files"
    wrong = [f"{k}: {manifest[k]} listed, {v} found" for k, v in sorted(found.items()) if k in manifest and manifest[k] != v]
    listed = manifest.get("files")
    if listed is not None:
        wrong += [f"{n}: {listed.get(n, 'nothing')} listed, {files.get(n, 'nothing')} found" for n in sorted({*listed, *files}) if listed.get(n) != files.get(n)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return read_stints(spark, path)
