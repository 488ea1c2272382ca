"""Secret scan over whole texts, in DataFrame operations only.

Fixed patterns find assignments of secrets, access keys and hexadecimal strings.  What they leave is blanked out for a
second look: runs of key characters are judged by two Markov models of their characters, one trained on random strings
and one on ordinary words and identifiers.  A run is reported where the log-likelihood ratio of random over ordinary, less
``cost`` for each character and summed over the run's best stretch, reaches ``least``: the cost keeps long paths and long
words, which gather a little ratio everywhere, from passing by their length.

Both models are counts of adjacent character pairs in a labelled sample, a DataFrame of (value, secret).  The default
sample (``labelled``) is made of the documents themselves: words of a bounded sample of texts, and identifiers put
together from words in a row, are ordinary; so are identifiers and paths of the words of a tokenizer's vocabulary, if its
file is given; values that the patterns find in the texts, and digests in several alphabets, are secret.  ``errors``
measures a model on values held out.

Places are code points in the text, end exclusive.  A pattern's places follow from the lengths of the text's pieces
between its matches, summed in blocks, so no row leaves the JVM and the work grows in proportion to the text.

Defined results: a null or empty text has no span; rows that repeat are scanned alike; an empty table gives an empty
result; other columns pass through, and result columns replace columns of the same name.
"""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, unit

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The greedy runs of the rule that are long enough; shorter ones drop out, whatever they hold.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_-]{12,}={0,2}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 12

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
#: Matches of a block of ``found``.
_BLOCK = 128


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Each match ``m`` of a pattern with the piece ``p`` of the text before it; the last piece has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def found(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, as array of (start, rank, end, kind, value)."""
    none = F.array().cast("array<struct<start: int, rank: int, `end`: int, kind: string, value: string>>")
    length = lambda x: F.length(x["p"]) + F.length(x["m"])

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def blocks(zipped):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / _BLOCK).cast("int")), lambda i: F.slice(zipped, i * _BLOCK + 1, F.lit(_BLOCK)))
        return let(cut, walked)

    def walked(cut):
        sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + length(x)))
        begin = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"])
        per_block = F.transform(F.arrays_zip(cut.alias("c"), starts.alias("s")), lambda b: F.aggregate(b["c"], F.struct(b["s"].alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(per_block)

    zipped = F.filter(matches(text, pattern), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), let(zipped, blocks)).otherwise(none)


def _value(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 2)


def blanked(text: Column, pattern: str, counts=None) -> Column:
    """The text with a blank for each character of a match (of those that ``counts``)."""
    hit = lambda m: F.lit(True) if counts is None else counts(m)
    joined_up = F.array_join(F.transform(matches(text, pattern), lambda x: F.concat(x["p"], F.coalesce(F.when(hit(x["m"]), F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]), F.lit("")))), "")
    return F.when(text.rlike(pattern), joined_up).otherwise(text)


def without_base(text: Column) -> Column:
    """The text with the patterns' spans blanked out."""
    assigned = blanked(text, ASSIGN, lambda m: F.length(_value(m)) >= MIN_VALUE)
    return let(assigned, lambda t: let(blanked(t, ACCESS), lambda u: blanked(u, HEX)))


def vocabulary_values(file: str) -> list[str]:
    """Ordinary values of the plain words of a tokenizer's vocabulary, as many as words: each with two others by a step
    through the list, in turn as snake, camel, upper, kebab and path case and run together.  Bounded by the vocabulary."""
    with open(file, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = sorted({w for w in (re.sub("</w>|\u0120|\u2581", "", t) for t in tokens) if re.fullmatch("[A-Za-z]{3,}", w)})
    out = []
    for i, w in enumerate(words):
        three = [w, words[(i * 7919 + 13) % len(words)], words[(i * 104729 + 7) % len(words)]]
        cases = ("_".join(three), three[0].lower() + "".join(x.capitalize() for x in three[1:]), "_".join(three).upper(), "-".join(three), "/".join(three))
        out.append(cases[i % 8] if i % 8 < len(cases) else "".join(three).lower())
    return out


def labelled(docs: DataFrame, *, text: str = "text", sample: int = 2000, random: int = 6000, vocabulary: str | None = None) -> DataFrame:
    """(value, secret): from about ``sample`` documents, picked by a hash of their text, of which equal ones count once;
    ``random`` digests; and the words of the tokenizer file ``vocabulary``."""
    spark = docs.sparkSession
    total = docs.count()
    picked = docs.where(F.col(text).isNotNull() & (unit(F.xxhash64(text), F.lit("secrets")) < sample / max(total, 1))).select(F.col(text).alias("t")).distinct()
    words = picked.select(F.regexp_extract_all(without_base(F.col("t")), F.lit("[A-Za-z0-9+/_-]{3,}"), F.lit(0)).alias("w"))
    three = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("w") / 3) - 1, F.lit(0)).cast("int")), lambda i: F.slice("w", i * 3 + 1, F.lit(3)))).alias("w"))
    kind = F.pmod(F.xxhash64("w"), F.lit(8))
    camel = F.array_join(F.transform("w", lambda x, i: F.when(i == 0, F.lower(x)).otherwise(F.initcap(x))), "")
    ordinary = three.select(F.when(kind == 0, F.array_join("w", "_")).when(kind == 1, camel).when(kind == 2, F.upper(F.array_join("w", "_"))).when(kind == 3, F.array_join("w", "-")).when(kind == 4, F.array_join("w", "/")).otherwise(F.array_join("w", "")).alias("value"))
    values = picked.select(F.explode(F.concat(F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: v), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))).alias("value")).where(F.length("value") >= MIN_VALUE)
    ids = spark.range(random, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 512)
    of = F.col("id") % 5
    made = ids.select(F.when(of == 0, F.substring(digest, 1, 40)).when(of == 1, F.upper(F.substring(digest, 1, 32))).otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40)).alias("value"))
    if vocabulary is not None:
        ordinary = ordinary.union(spark.createDataFrame([(v,) for v in vocabulary_values(vocabulary)], "value string"))
    return made.union(values).select("value", F.lit(True).alias("secret")).union(ordinary.select("value", F.lit(False).alias("secret")))


def ratios(sample: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of adjacent characters, random over ordinary: entry a * (k + 1) + b, k for any other character."""
    k = len(_ALPHABET) + 1
    pairs = sample.where(F.col("value").isNotNull()).select("secret", F.split("value", "").alias("c"))
    pairs = pairs.select("secret", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = {True: [smooth] * k * k, False: [smooth] * k * k}
    at = {c: i for i, c in enumerate(_ALPHABET)}
    for secret, a, b, n in pairs.groupBy("secret", "p.a", "p.b").count().collect():  # pairs of characters: bounded
        counts[bool(secret)][at.get(a, k - 1) * k + at.get(b, k - 1)] += n
    out = []
    for a in range(k):
        one, two = counts[True][a * k : a * k + k], counts[False][a * k : a * k + k]
        out += [log(x / sum(one)) - log(y / sum(two)) for x, y in zip(one, two, strict=True)]
    return out


#: Log-likelihood ratio, in nats, from which a run counts as random, and what each character costs.
LEAST, COST = 15.0, 0.3


def randomness(value: Column, table: list[float], cost: float = COST) -> Column:
    """The greatest sum of log-likelihood ratios, less ``cost`` each, over any stretch of a string of ASCII characters."""
    k = len(_ALPHABET) + 1
    place = [_ALPHABET.index(chr(c)) if chr(c) in _ALPHABET else k - 1 for c in range(128)]
    places = F.from_json(F.lit(json.dumps(place)), "array<int>")
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.get(places, F.ascii(c)))

    def step(acc, c):
        here = F.when(acc["last"] < 0, 0.0).otherwise(F.greatest(F.lit(0.0), acc["sum"] + F.get(weights, acc["last"] * k + c) - F.lit(cost)))
        return F.struct(c.alias("last"), here.alias("sum"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])


def errors(sample: DataFrame, table: list[float], least: float = LEAST) -> tuple[float, float]:
    """Of a labelled sample the share of secrets that are missed and of ordinary values that are reported."""
    judged = sample.where(F.length("value") >= MIN_VALUE).select("secret", (randomness(F.col("value"), table) >= least).alias("hit"))
    row = judged.agg(F.avg(F.when(F.col("secret"), 1 - F.col("hit").cast("int"))), F.avg(F.when(~F.col("secret"), F.col("hit").cast("int")))).first()
    return row[0] or 0.0, row[1] or 0.0


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, text: str = "text", sample: DataFrame | None = None, vocabulary: str | None = None, least: float = LEAST, cost: float = COST, min_value: int = MIN_VALUE) -> DataFrame:
    """``docs`` with ``secrets``: all spans, as array of (start, rank, end, kind, value), those of the patterns and of the models."""
    table = ratios(labelled(docs, text=text, vocabulary=vocabulary) if sample is None else sample)
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(found(whole, ASSIGN, "assign"), lambda s: F.length(_value(s["value"])) >= min_value)
    runs = let(without_base(whole), lambda t: F.filter(found(t, RUN, "markov"), lambda r: randomness(r["value"], table, cost) >= least))
    return docs.select(*others(docs.columns, ["secrets"]), F.concat(assign, found(whole, ACCESS, "access"), found(whole, HEX, "hex"), runs).alias("secrets"))
