"""A running pileup over read files that keep arriving; an addition to the batch operators.

Counts of bases are sums, so they can be kept by place while files come in; entropy and variant sites follow from the
current counts at any time by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pileup import pileup


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(start_pos, seq, cnt): reads of the raw layout from files that arrive in ``folder``."""
    parts = F.split("value", " ")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).where(F.size(parts) >= 8)
    return lines.select(parts[3].cast("int").alias("start_pos"), parts[7].alias("seq"), F.lit(1).cast("long").alias("cnt"))


def running_pileup(reads: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The pileup of all reads so far as the in-memory table ``name``, one row per place of the genome."""
    return pileup(reads).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
