"""What the operators share on Spark's side: row keys, Arrow maps, written cuts of lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal columns start with this, so that extra columns of the caller cannot clash.
OWN = "__loom_"
KEY, DOC, TEXT = OWN + "key", OWN + "doc", OWN + "text"
#: Stands for a null id wherever ids are ordered: after all others.
LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a worker's memory doesn't follow the longest run of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(key, doc, more columns, text): a 64-bit key of id and text, the id with null last, the text with null empty.

    Rows that are equal in id and text share a key; every operator treats them alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    return docs.select(F.xxhash64(doc, text).alias(KEY), doc.alias(DOC), *more, text.alias(TEXT))


def real_id(column: str = DOC):
    """The id as the caller knows it: null again where it was null."""
    return F.when(F.col(column) != LAST_ID, F.col(column))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session within one process may name none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the time of one action, put back after it. ``__`` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Cuts:
    """Intermediate results written as Parquet to the shared folder: lineage ends there, so a lost
    executor costs no more than the step in hand. The shuffle files behind a written result go as soon
    as it is written. ``drop`` removes one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        return self._read(df.schema, self._written(df))

    def split(self, df: DataFrame, which) -> tuple[DataFrame, DataFrame]:
        """The rows for which a condition doesn't hold and those for which it does, in one pass, to be dropped singly."""
        path, name = self._written(df.withColumn(OWN + "which", which), OWN + "which"), OWN + "which"
        for value in ("false", "true"):  # a side without rows has no folder
            where = self._path(f"{path}/{name}={value}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        return tuple(self._read(df.schema, f"{path}/{name}={value}") for value in ("false", "true"))

    def _written(self, df: DataFrame, *by: str) -> str:
        path = f"{self.base}/{self.n}"
        self.n += 1
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return path

    def _read(self, schema, path: str) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out.__dict__[OWN + "path"] = path
        return out

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def drop(self, df: DataFrame) -> None:
        path = df.__dict__.pop(OWN + "path", None)
        if path:
            where = self._path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or hangs on one centre only."""
    twice = edges.groupBy("u").count().where("count > 1")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return not twice.head(1) and not inner.head(1)


def components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that undirected edges (u, v) connect node with.

    Alternating large and small stars; each round is aggregations and equi-joins on distributed rows,
    and ends in a written cut. The number of rounds grows with the logarithm of a component's size.
    """
    now = cuts.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = cuts.write(small.where("u <> v").distinct())
        cuts.drop(now)
        now = after
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


RANK = OWN + "rank"


def numbered(cuts: Cuts, df: DataFrame, *order) -> DataFrame:
    """The rows with their place in the order, from 0, as column RANK: range-partitioned, never in one task.

    Only the row counts of the partitions come to the driver.
    """
    part, place = OWN + "part", OWN + "place"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cuts.write(rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    counts = sorted((r[part], r["count"]) for r in rows.groupBy(part).count().collect())
    before, seen = {}, 0
    for p, n in counts:
        before[p], seen = seen, seen + n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col(part).cast("long")) if before else F.lit(0)
    return rows.withColumn(RANK, offset + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, place)
