"""What the corpus operators share: staged tables, Arrow text helpers, null-safe joins."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.tables import drop_staged, new_path, shared_dir  # noqa: F401  for the operators


#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch between the JVM and Python: texts are long, and both sides hold a batch or two for each task.
ARROW_ROWS = 1000


@contextmanager
def arrow_rows(spark: SparkSession, most: int = ARROW_ROWS):
    """Within it, what is written goes to and from Python in Arrow batches of at most ``most`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most)) if int(before) > 0 else str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, most: int = ARROW_ROWS) -> DataFrame:
    """``functions.tables.staged`` with at most ``most`` rows in an Arrow batch."""
    with arrow_rows(df.sparkSession, most):
        return tables.staged(df, name)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others give back by themselves
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` for ``mapInArrow``; when a task ends, its worker gives back what it took.  Workers live on from step to step,
    and each would keep what its largest step has needed."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def path_of(df: DataFrame) -> list[str]:
    """The staged folders that ``df`` itself reads."""
    return sorted({f.rpartition("/")[0] for f in df.inputFiles()})


def others(columns: list[str], new) -> list[str]:
    """The columns that none of ``new`` replaces; like Spark's, names differ by more than case."""
    taken = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in taken]


def unit(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the columns only, so that reruns and retries agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch of texts, dictionary-encoded, and for each text where its words begin (one more at the end).

    A null text has no words.  ``ascii_split_whitespace`` splits at exactly the six characters that WORD excludes."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        flat, starts = flat.filter(pa.array(full)), before[starts]
    return flat.dictionary_encode(), starts


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of each word; equal over batches, tasks and runs."""
    h = xxhash.xxh3_64_intdigest
    own = np.fromiter((h(w) for w in words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), dtype=np.uint64, count=len(words.dictionary))
    return own[np.asarray(words.indices)] if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; ``len(h) - k + 1`` of them (none if fewer words).  Texts are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, have = None, 0, {1: h}
    size = 1
    while size * 2 <= k:  # doubling: a window of 2s words from two of s words
        x = have[size]
        have[size * 2] = mixed(x[:-size] * np.uint64(0x9E3779B97F4A7C15) + x[size:] + np.uint64(size))
        size *= 2
    for s in sorted(have, reverse=True):
        if k - done >= s:
            part = have[s][done : done + n]
            out = part if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k))
            done += s
    return out


def sub_batches(batches, text_at: str, most_bytes: int = 4 << 20):
    """Arrow batches cut so that each holds about ``most_bytes`` of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_at))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
