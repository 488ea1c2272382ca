"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark, run once over each text.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and of all code points above 0x7F.  An item's
windows are its runs of ``window`` words, or all its words if it has fewer.  A word of a document is hit if it lies in
an occurrence of a window.  Normalising maps each UTF-8 byte to one byte, so places in the normalised text are places
in the original, and spans are given as code-point offsets there.

Defined results: a null or empty text has no words, no hits and is not contaminated; an item without text or words
gives no window; a null item id counts as the empty string; items that repeat count once by id; rows that repeat are
judged alike, each by itself; with no items nothing is hit.  Other input columns pass through; where they bear the
name of a result column, the result replaces them.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, others, staged, sub_batches

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))

RESULTS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    *(T.StructField(c, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))) for c in ("hit_words", "hit_spans")),
])


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = normalised_words(text)
    n = max(1, len(words) - window + 1) if words else 0
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(n)}


class Matcher:
    """The automaton, and for each of its windows the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(text, window):
                owners.setdefault(w, set()).add(item or "")
        self.machine = ahocorasick.Automaton()
        for w, who in owners.items():
            self.machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, frozenset(who)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def judge(self, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]], list[tuple[int, int]]]:
        """Words, hit words, items, and the runs of hit words as places of words and of code points."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        flat = raw.translate(_TABLE)
        words = flat.split()
        if self.empty or not words:
            return len(words), 0, [], [], []
        found, items = [], set()
        for end, (size, who) in self.machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            found.append((end, size))
            items |= who
        if not found:
            return len(words), 0, [], [], []
        last_at, at = {}, 0  # where the blank after each word is, in the joined words
        for i, w in enumerate(words):
            at += len(w) + 1
            last_at[at] = i
        runs: list[list[int]] = []  # of hit words, first and last, merged where they touch
        for lo, hi in sorted((last_at[end] - size + 1, last_at[end]) for end, size in found):
            if runs and lo <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], hi)
            else:
                runs.append([lo, hi])
        places = [m.span() for m in re.finditer(rb"[^ ]+", flat)]
        spans, at, chars = [], 0, 0
        for lo, hi in runs:
            start = chars + len(raw[at : places[lo][0]].decode("utf-8", "surrogatepass"))
            at, chars = places[hi][1], start + len(raw[places[lo][0] : places[hi][1]].decode("utf-8", "surrogatepass"))
            spans.append((start, chars))
        return len(words), sum(hi - lo + 1 for lo, hi in runs), sorted(items), [(lo, hi + 1) for lo, hi in runs], spans


_MATCHERS: dict[str, Matcher] = {}  # of this Python worker, by the broadcast's own key; one is kept


def _matcher(key: str, items, window: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, window)
    return _MATCHERS[key]


FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunks(items: DataFrame, item: str, item_text: str, window: int, most: int = 1000) -> DataFrame:
    """(item, text, n): the items in pieces of ``most`` windows at most, which together have the items' windows."""
    words = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(F.translate(F.coalesce(item_text, F.lit("")), _UPPER, _LOWER), F.lit(FOLDED), F.lit(0)).alias("w"))
    count = F.greatest(F.size("w") - (window - 1), F.lit(1))
    cut = words.where(F.size("w") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((count - 1) / most).cast("int"))))
    piece = F.slice("w", F.col("i") * most + 1, F.lit(most + window - 1))
    return cut.select("item", F.array_join(piece, " ").alias("text"), F.greatest(F.size(piece) - (window - 1), F.lit(1)).alias("n")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, least_percent: int = 5, keep: list[str] | None = None, part_windows: int = 60_000) -> DataFrame:
    """``docs`` with the columns of RESULTS; ``keep`` names the input columns to pass through (default: all).

    An automaton takes some 4 kB for each of its windows in each Python worker, so it holds about ``part_windows`` at
    most.  A benchmark of more windows is dealt into parts; each is looked for in a pass of its own, and what the passes
    find in a text is united, which gives what one automaton of all windows would find."""
    spark = docs.sparkSession
    passed = others(docs.columns if keep is None else keep, RESULTS.names)
    cut = staged(chunks(items, item, item_text, window), "benchmark-chunks")
    n_parts = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // part_windows))

    def part(k: int):
        rows = cut if n_parts == 1 else cut.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == k)
        return spark.sparkContext.broadcast([tuple(r) for r in rows.select("item", "text").collect()]), uuid.uuid4().hex  # about part_windows windows

    if n_parts == 1:
        return _judged(docs.select(*passed, F.col(text).alias("__text")), passed, *part(0), window, least_percent)
    keys = [F.xxhash64(text), F.xxhash64(text, F.lit("again")), F.coalesce(F.octet_length(text), F.lit(-1))]  # findings depend on the text alone
    known = docs.select(*passed, *(k.alias(f"__k{i}") for i, k in enumerate(keys)), F.col(text).alias("__text"))
    key = ["__k0", "__k1", "__k2"]
    texts = known.select(*key, "__text")
    found = [staged(_judged(texts, key, *part(k), window, least_percent).where("n_hit > 0").select(*key, "items", "hit_words", "hit_spans").distinct(), "benchmark-hits") for k in range(n_parts)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    united = every.groupBy(*key).agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_words")).alias("hit_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"))  # a row a part
    spans = RESULTS["hit_spans"].dataType.simpleString()

    def unite(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for who, words, places in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                runs: list[list[int]] = []
                for w, p in sorted(zip(((x["start"], x["end"]) for x in words), ((x["start"], x["end"]) for x in places), strict=True)):
                    if runs and w[0] <= runs[-1][1]:
                        runs[-1][1], runs[-1][3] = max(runs[-1][1], w[1]), max(runs[-1][3], p[1])
                    else:
                        runs.append([*w, *p])
                for column, value in zip(out, (sorted(set(who)), [{"start": r[0], "end": r[1]} for r in runs], [{"start": r[2], "end": r[3]} for r in runs]), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], span), pa.array(out[2], span)], names=[*key, "__items", "__words", "__spans"])

    whole = united.mapInArrow(lean(unite), f"__k0 long, __k1 long, __k2 int, __items array<string>, __words {spans}, __spans {spans}")
    none = F.array().cast(spans)
    n_words = F.regexp_count(F.translate(F.coalesce("__text", F.lit("")), _UPPER, _LOWER), F.lit(FOLDED)).cast("long")
    rows = known.withColumn("__n", n_words).drop("__text").join(whole, key, "left")
    names, runs = F.coalesce("__items", F.array().cast("array<string>")), F.coalesce("__words", none)
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    rows = rows.select(*passed, F.col("__n").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), names.alias("items"), runs.alias("hit_words"), F.coalesce("__spans", none).alias("hit_spans"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words"))).select(*passed, *RESULTS.names)


def _judged(source: DataFrame, passed: list[str], sent, key: str, window: int, least_percent: int) -> DataFrame:
    """``source`` (columns ``passed`` and ``__text``) judged by one automaton over the items of the broadcast."""
    schema = T.StructType([source.schema[c] for c in passed] + RESULTS.fields)

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrow = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hit_words", span), ("hit_spans", span)])
        for batch in sub_batches(batches, "__text", 16 << 20):
            m = _matcher(key, sent, window)
            out: list[list] = [[] for _ in arrow]
            for t in batch.column(len(passed)):
                n, hit, who, runs, spans = m.judge(t.as_py())
                row = (n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), hit > 0 and 100 * hit >= least_percent * n, who, *([{"start": a, "end": b} for a, b in x] for x in (runs, spans)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *(pa.array(v, f.type) for v, f in zip(out, arrow, strict=True))], names=[*passed, *arrow.names])

    return source.mapInArrow(lean(run), schema)
