"""Sources and sinks of reads: text layouts of sequencing tools, and reads derived from the ``lineitem`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENOME, READ = 120, 40


def raw_paired(spark: SparkSession, path: str) -> DataFrame:
    """(start_pos, seq) of a raw read file: fields 3 and 7 of lines of eight or more fields split by blanks."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).where(F.size(parts) >= 8)
    return lines.select(parts[3].cast("int").alias("start_pos"), parts[7].alias("seq"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, hap_id, name, seq) of each record of the FASTA files at ``path``; sequence lines are joined, line ends dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.filter(F.split("value", r"(?m)^>"), lambda x: F.trim(x) != "")).alias("hap_id", "record"))
    head = F.substring_index("record", "\n", 1)
    return whole.select("file", "hap_id", F.trim(head).alias("name"), F.regexp_replace(F.expr("substring(record, length(substring_index(record, '\n', 1)) + 1)"), r"\s", "").alias("seq"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, start_pos, seq) of SAM lines; header lines begin with ``@``."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(parts) >= 10)).select(parts[0].alias("qname"), parts[3].cast("int").alias("start_pos"), parts[9].alias("seq"))


def corrected(spark: SparkSession, path: str) -> DataFrame:
    """(start_pos, cnt, seq) of a corrected read file: ``start count read [compact]``."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].cast("int").alias("start_pos"), parts[1].cast("long").alias("cnt"), parts[2].alias("seq"))


def compact(spark: SparkSession, path: str) -> DataFrame:
    """(cstart, cend, cnt, cseq) of a compact read file: ``start end count read``; lines ``_`` stand for dropped reads."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].cast("int").alias("cstart"), parts[1].cast("int").alias("cend"), parts[2].cast("long").alias("cnt"), parts[3].alias("cseq"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(vi, pos) of a position list: one line of 0-based places split by blanks."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("vi", "p")).select("vi", F.col("p").cast("int").alias("pos"))


def shared(spark: SparkSession, path: str) -> DataFrame:
    """(pos, base) of a string with one symbol per site."""
    return spark.read.text(path).select(F.posexplode(F.filter(F.split("value", ""), lambda x: x != "")).alias("pos", "base"))


def write_lines(df: DataFrame, columns: list[str], path: str) -> None:
    """Rows as blank-separated lines, the layout of all readers above."""
    df.select(F.concat_ws(" ", *(F.col(x).cast("string") for x in columns)).alias("value")).write.text(path)


def _base(p: Column, o: Column, hap: Column, err: Column) -> Column:
    twelfth = (hap == 1) & (p % 12 == 0)
    sixth = (hap == 2) & (p % 12 == 6)
    thirtieth = (hap >= 1) & (p % 30 == 0)
    mut = F.when((p % 6 == 0) & (twelfth | sixth | thirtieth), hap).otherwise(0)
    code = (7 * p * p + 3 * p + mut + F.when(err == o, 2).otherwise(0)) % 4
    return F.element_at(F.array(*map(F.lit, "ACGT")), (code + 1).cast("int"))


def _sequence(length: int) -> Column:
    """The bases of a read from ``start_pos``, ``hap``, ``err`` (place of its error, -1 for none) and ``gap``."""

    def one(o: Column) -> Column:
        b = _base(F.col("start_pos") + o, o, F.col("hap"), F.col("err"))
        return F.when(F.col("gap") & (o >= 16) & (o <= 23), F.lit(".")).otherwise(b)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), one), "")


def _traits(lineitem: DataFrame) -> DataFrame:
    share = F.col("l_suppkey") % 10
    return lineitem.select(
        (1 + F.col("l_partkey") % 81).cast("int").alias("start_pos"),
        F.when(share < 6, 0).when(share < 9, 1).otherwise(2).alias("hap"),
        F.when(F.col("l_orderkey") % 50 == 0, F.col("l_orderkey") % 40).otherwise(-1).cast("int").alias("err"),
        (F.col("l_linenumber") % 3 == 0).alias("gap"),
    )


def raw_reads(lineitem: DataFrame) -> DataFrame:
    """(start_pos, seq): one read of 40 bases per row of lineitem, from three hidden haplotypes with errors and gaps."""
    return _traits(lineitem).select("start_pos", _sequence(READ).alias("seq"))


def counted_reads(lineitem: DataFrame) -> DataFrame:
    """(start_pos, seq, cnt): equal to ``read_dedup(raw_reads(lineitem))``; rows are counted by what makes the sequence
    before any sequence is built."""
    traits = _traits(lineitem).groupBy("start_pos", "hap", "err", "gap").agg(F.count(F.lit(1)).alias("n"))
    return traits.select("start_pos", _sequence(READ).alias("seq"), "n").groupBy("start_pos", "seq").agg(F.sum("n").alias("cnt"))


def true_haplotypes(spark: SparkSession) -> DataFrame:
    """(hap_id, seq): the hidden haplotypes, three strings of 120 bases."""
    rows = spark.range(3, numPartitions=1).select(F.col("id").cast("int").alias("hap"), F.lit(1).alias("start_pos"), F.lit(-1).alias("err"), F.lit(False).alias("gap"))
    return rows.select(F.col("hap").alias("hap_id"), _sequence(GENOME).alias("seq"))
