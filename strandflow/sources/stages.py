"""A store of tables that are made part by part: windows, regions or fits, each finished once and united on reading.

``{root}/{name}/batch=…/{column}=…/`` holds the rows of the parts that one job wrote; ``{root}/{name}.parts/`` lists the
parts of each batch and is written after the rows.  So a part is finished when it is listed; what a job that was killed
left behind is never read.  A part that is written again replaces the one before.  Reading prunes by the part's column.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StageStore:
    """Tables in parts under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _listed(self, name: str) -> DataFrame:
        """(part, batch): of each finished part the last batch that has it; one row a part of a grid."""
        path = f"{self.root}/{name}.parts"
        if not self._exists(path):
            return self.spark.createDataFrame([], "part string, batch string")
        rows = self.spark.read.schema("part string, batch string, turn long").parquet(path)
        return rows.groupBy("part").agg(F.max_by("batch", F.struct("turn", "batch")).alias("batch"))

    def finished(self, name: str) -> set[str]:
        """The finished parts, as strings: windows or fits of a grid."""
        return {r.part for r in self._listed(name).select("part").collect()}

    def write(self, name: str, df: DataFrame, column: str, parts: Iterable) -> None:
        """The rows of ``parts`` (values of ``column``) as one batch; a part without rows is finished, too."""
        batch = uuid.uuid4().hex
        df.write.partitionBy(column).parquet(f"{self.root}/{name}/batch={batch}")
        turn = time.time_ns()
        listed = self.spark.createDataFrame([(str(p), batch, turn) for p in parts], "part string, batch string, turn long")
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}.parts")

    def read(self, name: str, schema: str, column: str) -> DataFrame:
        """The rows of all finished parts; ``schema`` names ``column`` and the others, for a table without parts as well."""
        batches = sorted({r.batch for r in self._listed(name).select("batch").collect()})
        empty = self.spark.createDataFrame([], schema)
        paths = [p for p in (f"{self.root}/{name}/batch={b}" for b in batches) if self._exists(p)]
        if not paths:
            return empty
        rows = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.root}/{name}").parquet(*paths)
        last = self._listed(name).select(F.col("part").alias("__part"), F.col("batch").alias("__batch"))
        valid = rows.join(last, (F.col("batch") == F.col("__batch")) & (F.col(column).cast("string") == F.col("__part")), "left_semi")
        return valid.select(*empty.columns)

    def resumed(self, name: str, schema: str, column: str, parts: list, make: Callable[[list], DataFrame], at_a_time: int = 16) -> DataFrame:
        """The table with all ``parts``: those that aren't finished are made, ``at_a_time`` a job, and written first.

        ``make`` takes a list of parts and returns their rows.  After a failure another call goes on with what is missing."""
        done = self.finished(name)
        missing = [p for p in parts if str(p) not in done]
        for i in range(0, len(missing), at_a_time):
            now = missing[i : i + at_a_time]
            self.write(name, make(now), column, now)
        return self.read(name, schema, column).where(F.col(column).isin(list(parts)))
