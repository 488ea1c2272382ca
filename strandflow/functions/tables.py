"""Tables written between steps, to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that is broadcast, and what a number of a row counts for.
MOST_BYTES, NUMBER_BYTES = 64 << 20, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a session in one process (``local``, ``local[...]``) without the setting gets
    one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark, "_strandflow_dir", None)
    if own is None:
        own = spark._strandflow_dir = tempfile.mkdtemp(prefix="strandflow-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lineage cut that outlives lost executors.

    The table stays until ``drop_staged``, since the returned frame is lazy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = getattr(spark, "_strandflow_staged", None)
    if kept is None:
        kept = spark._strandflow_staged = []
    kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the values of ``df``: texts as they are, all else ``NUMBER_BYTES`` each.  A job over the table."""
    texts = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    sizes = [F.sum(F.octet_length(c)) for c in texts]
    rows, *of_texts = df.agg(F.count(F.lit(1)), *sizes).first()
    return rows * NUMBER_BYTES * len(df.columns) + sum(x or 0 for x in of_texts)


def sized(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` as the small side of an equi-join: broadcast if it has been measured to be within ``most_bytes``, else as it
    is, so that both sides are shuffled."""
    return F.broadcast(df) if bytes_of(df) <= most_bytes else df


def paired(left: DataFrame, right: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, for results that are all pairs; column names differ.

    ``right`` is broadcast if it has been measured to be within ``most_bytes``.  Beyond that it is cut into parts of about
    that size and ``left`` into as many slices as the session shuffles into: each part and slice meet in one task."""
    size = bytes_of(right)
    if size <= most_bytes:
        return left.crossJoin(F.broadcast(right))
    parts, slices = ceil(size / most_bytes), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = left.withColumn("__slice", to(left, slices)).withColumn("__part", every(parts))
    other = right.withColumn("__part", to(right, parts)).withColumn("__slice", every(slices))
    return own.join(other, ["__part", "__slice"]).drop("__part", "__slice")


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables, all of this session unless named; call it once the results that read them are written."""
    kept = getattr(spark, "_strandflow_staged", [])
    for path in list(kept if paths is None else paths):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in kept:
            kept.remove(path)
