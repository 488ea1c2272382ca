"""Text and array files whose line numbers mean something: ordered writers and readers that give the numbers back.

Lines are sorted by ranges, so file after file is in order and no task sees more than its range; reading numbers the lines
by where a split begins in its file.  No index has to agree with the files, and no task counts through all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import staged


def write_ordered(df: DataFrame, line: Column, order: list, path: str, parts: int | None = None) -> None:
    """``line`` of each row as text in the order of ``order`` (which should have no ties), over ``parts`` files."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of the files at ``path`` and their 0-based numbers, in order of file names and lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = staged(lines, "lines")  # the numbers within a split hold from here on
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")  # a row for each split of a file
    return lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("row"), "value")


def _field(i: int, kind: str) -> Column:
    return F.split("value", " ", -1)[i].cast(kind)


def write_votes(votes: DataFrame, path: str) -> None:
    """``start count votes`` of reads (read_id, start_pos, cnt, votes) in order of id; ``_`` where there is no vote."""
    write_ordered(votes, F.concat_ws(" ", "start_pos", "cnt", F.coalesce("votes", F.lit("_"))), ["read_id"], path)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    rows = read_ordered(spark, path)
    return rows.select(F.col("row").alias("read_id"), _field(0, "int").alias("start_pos"), _field(1, "long").alias("cnt"), F.nullif(_field(2, "string"), F.lit("_")).alias("votes"))


def write_tracker(lineage: DataFrame, path: str) -> None:
    """The raw reads (raw_id) of each compact read (cread_id, from 0 on without holes), ascending; ``_`` where raw_id is null."""
    of_read = lineage.groupBy("cread_id").agg(F.sort_array(F.collect_list("raw_id")).alias("raw"))
    write_ordered(of_read, F.when(F.size("raw") > 0, F.array_join("raw", " ")).otherwise("_"), ["cread_id"], path)


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    rows = read_ordered(spark, path).where("value <> '_'")
    return rows.select(F.col("row").alias("cread_id"), F.explode(F.split("value", " ")).alias("raw")).select("cread_id", F.col("raw").cast("long").alias("raw_id"))


def write_positions(places: DataFrame, path: str) -> None:
    """The places (pos) of a genome's sites, ascending, on one line."""
    places.agg(F.array_join(F.sort_array(F.collect_list("pos")), " ").alias("value")).coalesce(1).write.text(path)


def write_solution(solution: DataFrame, path: str) -> None:
    """``frequency haplotype`` (h, cseq), the most frequent first."""
    write_ordered(solution, F.concat_ws(" ", F.col("h").cast("string"), "cseq"), [F.desc("h"), "cseq"], path)


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    return read_ordered(spark, path).select("row", _field(0, "double").alias("h"), _field(1, "string").alias("cseq"))


def write_flags(flags: DataFrame, path: str) -> None:
    """1 or 0 of each read (read_id, changed) in order of id."""
    write_ordered(flags, F.col("changed").cast("int").cast("string"), ["read_id"], path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    return read_ordered(spark, path).select(F.col("row").alias("read_id"), (F.col("value") == "1").alias("changed"))


def write_matrix(matrix: DataFrame, y: DataFrame, path: str) -> None:
    """P, y and the row list: files ``nList`` (the read of each row), ``P`` (its haplotypes) and ``y``, equal row by row.

    ``matrix`` (read_id, hap_id), ``y`` (read_id, y): reads without a haplotype have no row."""
    rows = matrix.groupBy("read_id").agg(F.sort_array(F.collect_set("hap_id")).alias("haps")).join(y, "read_id", "left")  # capped haplotypes
    rows = staged(rows, "matrix-rows")
    for name, line in (("nList", F.col("read_id").cast("string")), ("P", F.array_join("haps", " ")), ("y", F.coalesce("y", F.lit(0.0)).cast("string"))):
        write_ordered(rows, line, ["read_id"], f"{path}/{name}")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(read_id, hap_id) and (read_id, y), joined by row number."""
    ids = read_ordered(spark, f"{path}/nList").select("row", F.col("value").cast("long").alias("read_id"))
    p = read_ordered(spark, f"{path}/P").select("row", F.explode(F.split("value", " ")).alias("h")).join(ids, "row")
    y = read_ordered(spark, f"{path}/y").select("row", F.col("value").cast("double").alias("y")).join(ids, "row")
    return p.select("read_id", F.col("h").cast("int").alias("hap_id")), y.select("read_id", "y")
