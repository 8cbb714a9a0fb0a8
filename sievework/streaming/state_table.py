"""A table of newest rows per key: a bucketed base, open deltas and a manifest.

    base/version=V/bucket=B   one row for each key, folded up to some batch
    deltas/batch_id=N         the newest rows per key of one micro-batch
    manifest/version=V        one row: the base's last folded batch and its rows

A read takes the newest manifest, its base and the deltas after its last batch. A
batch that a manifest has folded is not written again, any other batch replaces its
own delta, so a replay changes nothing. When open deltas hold more than a share of
the base's rows, they are folded into the next version; its manifest is written
last, so a lost writer leaves the old version whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MANIFEST = "batch_id bigint, base_rows bigint"


@dataclass(frozen=True)
class StateTable:
    """``order``: columns whose greatest values mark a key's newest row; rows equal
    in them must be equal. ``schema``: all columns of a row, key and order included."""

    path: str
    key: str
    order: Sequence[Column]
    schema: T.StructType
    buckets: int = 16
    share: float = 0.5

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, by a partial aggregate, so that a hot key stays small."""
        rest = [c for c in self.schema.names if c != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_r"))
        return best.select(*[F.col(c if c == self.key else f"_r.{c}").alias(c) for c in self.schema.names])

    def manifest(self, spark: SparkSession) -> tuple[int, int, int]:
        """(version, last folded batch, rows of the base); version 0 has no base."""
        try:
            m = spark.read.schema(MANIFEST + ", version int").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return 0, -1, 0
        top = m.agg(F.max(F.struct("version", "batch_id", "base_rows"))).first()[0]
        return (top.version, top.batch_id, top.base_rows) if top else (0, -1, 0)

    def _base(self, spark: SparkSession, version: int) -> DataFrame:
        if not version:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/base/version={version}").select(*self.schema.names)

    def deltas(self, spark: SparkSession, after: int) -> DataFrame:
        """Open deltas: rows of batches later than ``after``, with ``batch_id``.

        The condition is on the folder's name, so folded deltas are not opened."""
        both = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        try:
            d = spark.read.schema(both).option("basePath", f"{self.path}/deltas").parquet(f"{self.path}/deltas")
        except AnalysisException:
            return spark.createDataFrame([], both)
        return d.where(F.col("batch_id") > after)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key, from the base and the open deltas alone."""
        version, last, _ = self.manifest(spark)
        rows = self._base(spark, version).unionByName(self.deltas(spark, last).drop("batch_id"))
        return self.newest(rows)

    def write(self, df: DataFrame, batch_id: int) -> None:
        """foreachBatch function: keeps a batch's newest rows, then folds if due."""
        spark = df.sparkSession
        version, last, base_rows = self.manifest(spark)
        if batch_id <= last:
            return
        self.newest(df.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/deltas/batch_id={batch_id}")
        if self.deltas(spark, last).count() > self.share * base_rows:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> int:
        """Folds all open deltas into the next version and returns it. A version
        that another writer has finished meanwhile is not touched: its manifest
        exists, and writing it again is an error."""
        version, last, _ = self.manifest(spark)
        top = self.deltas(spark, last).agg(F.max("batch_id")).first()[0]
        if top is None:
            return version
        # Later batches may arrive while this runs; they stay open.
        rows = self._base(spark, version).unionByName(self.deltas(spark, last).where(F.col("batch_id") <= top).drop("batch_id"))
        target = f"{self.path}/base/version={version + 1}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        self.newest(rows).withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        n = spark.read.parquet(target).count()
        spark.createDataFrame([(top, n)], MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version + 1}")
        return version + 1

    def lookup(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """Newest rows of some keys: their buckets of the base and the open deltas."""
        version, last, _ = self.manifest(spark)
        wanted = keys.select(self.key).distinct().withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        names = self.schema.names
        rows = self.deltas(spark, last).join(wanted, self.key, "left_semi").select(*names)
        if version:
            base = spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/base/version={version}")
            rows = rows.unionByName(base.join(wanted, [self.key, "bucket"], "left_semi").select(*names))
        return self.newest(rows)
