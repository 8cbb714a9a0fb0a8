"""Typed reads, dataset writes, file listings and snapshot compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievework.functions.columns import ratio
from sievework.operators.versions import digest_columns


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", strict: bool = True) -> DataFrame:
    """Declared-schema read. Strict text reads raise on a bad cell; lenient
    ones keep the raw line in ``_corrupt`` instead."""
    if fmt in ("csv", "json"):
        reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
        if not strict:
            schema = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
        reader = reader.schema(schema)
        return reader.csv(path, header=True) if fmt == "csv" else reader.json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def write_dataset(
    df: DataFrame,
    path: str,
    name: str,
    version: str,
    licence: str,
    seed: int | None = None,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    rows_per_file: int = 5_000_000,
) -> DataFrame:
    """Writes rows in the frame's column order and returns one metadata record.

    The rebalance hint lets adaptive execution split a partition value that
    holds most rows, instead of sending it to one writer.
    """
    spark = df.sparkSession
    out = df.hint("rebalance", *partition_by) if partition_by else df
    if sort_by:
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.agg(
        F.lit(name).alias("name"),
        F.lit(version).alias("version"),
        F.lit(licence).alias("licence"),
        F.lit(df.schema.json()).alias("schema_json"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(path).alias("path"),
        *digest_columns(df.columns),
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested contract records, one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_records(df: DataFrame, text: str, schema: T.StructType | str, name: str = "record") -> DataFrame:
    """The same records held as a text column."""
    return df.withColumn(name, F.from_json(F.col(text), schema))


def list_source_files(
    spark: SparkSession, root: str, allow_prefixes: Sequence[str], glob: str = "*", max_bytes: int = 1 << 30
) -> DataFrame:
    """Path, size, mtime and sha256 of every file under the root.

    A path that leaves the root or its allowed prefixes is listed as rejected
    and its content is never read, nor is that of a file over ``max_bytes``.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    meta = base.load(root).select("path", "length", "modificationTime")
    rel = F.regexp_replace("path", "^file:/*", "/")
    root_text = "/" + root.strip("/") + "/"
    inside = rel.startswith(root_text)
    rel = F.when(inside, F.substring(rel, len(root_text) + 1, 1 << 20))
    allowed = F.lit(False)
    for p in allow_prefixes:
        allowed = allowed | (rel == p.rstrip("/")) | rel.startswith(p.rstrip("/") + "/")
    status = (
        F.when(~inside | F.concat(F.lit("/"), rel, F.lit("/")).contains("/../"), "outside_root")
        .when(~allowed, "not_allowed")
        .when(F.col("length") > max_bytes, "oversize")
        .otherwise("listed")
    )
    meta = meta.select("path", rel.alias("rel_path"), "length", "modificationTime", status.alias("status"))
    none = meta.where("status <> 'listed'").withColumn("sha256", F.lit(None).cast("string"))
    listed = meta.where("status = 'listed'")
    # Content is loaded from allowed prefixes that hold a listed file and from nowhere else.
    roots = [p for p in allow_prefixes if not listed.where((F.col("rel_path") == p.rstrip("/")) | F.col("rel_path").startswith(p.rstrip("/") + "/")).isEmpty()]
    if not roots:
        return none
    body = base.load([f"{root.rstrip('/')}/{p.strip('/')}" for p in roots]).where(F.col("length") <= max_bytes)
    return listed.join(body.select("path", F.sha2("content", 256).alias("sha256")).distinct(), "path").unionByName(none)


def source_changes(prev: DataFrame, cur: DataFrame, key: str, checksum: str) -> DataFrame:
    """new / changed / deleted / unchanged per source; deletions are markers."""
    a = prev.select(F.col(key).alias("_k"), F.col(checksum).alias("old_checksum"), F.lit(True).alias("_a"))
    b = cur.select(F.col(key).alias("_k"), F.col(checksum).alias("new_checksum"), F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "new")
        .when(F.col("_b").isNull(), "deleted")
        .when(F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, "_k", "full_outer").select(
        F.col("_k").alias(key), status.alias("status"), "old_checksum", "new_checksum"
    )


def low_density_pages(df: DataFrame, text_chars: Column, raw_chars: Column, min_density: float) -> DataFrame:
    """Pages whose share of text characters is under the threshold."""
    return df.withColumn("density", F.coalesce(ratio(text_chars, raw_chars), F.lit(0.0))).where(
        F.col("density") < min_density
    )
