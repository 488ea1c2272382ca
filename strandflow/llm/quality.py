"""Document quality by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation-maximisation over the counts of vote
patterns estimates the share of good documents and how each rule votes on good and on bad ones; a document's posterior
probability of being good then decides, in place of a filter that all rules must pass.  The corpus is read once for
features and votes; EM sees one row per vote pattern (3 to the number of rules at most, a bound of the rule set), so
what reaches the driver does not grow with the corpus.

Defined results: a null or empty text has no words, fails the base rule and is not kept; documents are judged by
themselves, so rows that repeat get equal verdicts; an empty table gives an empty result; other input columns pass
through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mixed, others, staged, sub_batches, window_hashes, words_of

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_open_lines", "n_brackets", "n_unpaired"]
WINDOW = 5

#: What may stand at the end of a finished line.
_STOPS = (".", "!", "?", '"', "'", ":", ";", ")", "]", "…", "”", "’", "»", "。", "！", "？", "」", "।", "؟")
#: ASCII marks that are rare in plain sentences.
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def repeated(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Per word, whether a window of k words that covers it occurs twice or more in its own text."""
    covered = np.zeros(len(ids), dtype=bool)
    n = len(ids) - k + 1
    if n <= 0:
        return covered
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = np.flatnonzero(text[:n] == text[k - 1 :])
    key = window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), k)[whole] ^ mixed(text[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = whole[order[same]], whole[order[same + 1]]
    if any((ids[a + j] != ids[b + j]).any() for j in range(k)) or (text[a] != text[b]).any():  # two windows of one hash: tell them apart in full
        rows = np.stack([text[whole], *(ids[whole + j] for j in range(k))], axis=1)
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = whole[count[inverse.ravel()] > 1]
    else:
        twice = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    flag = np.zeros(len(ids), dtype=bool)
    flag[twice] = True
    at = np.flatnonzero(flag)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words, starts = words_of(texts)
    out = {"n_words": np.diff(starts)}
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    kinds = np.zeros(256, dtype=np.uint8)  # one bit each: white space, symbol, upper, lower, mark, opening and closing bracket
    for bit, chars in enumerate((b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), _MARKS, b"([{", b")]}")):
        for c in chars:
            kinds[c] |= 1 << bit
    kind = kinds[raw]
    blank, out["n_symbols"], out["n_upper"], out["n_lower"], out["n_marks"], opening, closing = (_sums((kind >> bit) & 1, at) for bit in range(7))
    out["n_brackets"], out["n_unpaired"] = opening + closing, np.abs(opening - closing)
    out["word_chars"] = np.asarray(pc.utf8_length(texts), dtype=np.int64) - blank
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    line_starts = np.asarray(lists.offsets, dtype=np.int64)
    line_starts = line_starts - line_starts[0]
    trimmed = pc.ascii_trim_whitespace(lines.dictionary)
    full = np.asarray(pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False), dtype=bool)
    closed = np.zeros(len(trimmed), dtype=bool)
    for stop in _STOPS:
        closed |= np.asarray(pc.ends_with(trimmed, stop).to_numpy(zero_copy_only=False), dtype=bool)
    line = np.asarray(lines.indices, dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(line_starts))
    real = full[line] if len(line) else np.zeros(0, bool)
    distinct = np.unique(of[real] * (len(trimmed) + 1) + line[real]) // (len(trimmed) + 1)
    out["n_lines"] = np.bincount(of[real], minlength=len(texts))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=len(texts))
    out["n_open_lines"] = np.bincount(of[real & ~closed[line]] if len(line) else of, minlength=len(texts))
    out["n_repeat_words"] = _sums(repeated(np.asarray(words.indices, dtype=np.int64), starts, WINDOW), starts)
    return {k: out[k].astype(np.int64) for k in FEATURES}


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: The rules that vote bad or abstain; the others vote good or abstain.
BAD = ("symbols", "marks", "capitals", "lines", "repeats", "word_size", "open_lines")


def rules() -> dict[str, Column]:
    """The rules by name: 1 for good, -1 for bad, 0 where a rule abstains.

    A detector of one kind of junk votes bad or abstains: that it finds nothing says little of the other kinds.  Source code
    and markup are full of marks and of lines without a stop, but their brackets pair up: there the detectors of marks and
    open lines abstain, since what they look for is no sign of junk, and idioms may repeat up to the base rule's bound."""
    paired = (F.col("n_brackets") >= 6) & (F.col("n_brackets") * 50 >= F.col("n_words")) & (F.col("n_unpaired") * 20 <= F.col("n_brackets"))
    long_word = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    bad = {
        "symbols": ~paired & (_ratio("n_symbols", "n_words") > 0.1),
        "marks": ~paired & (_ratio("n_marks", "n_words") > 0.25),
        "capitals": F.col("n_upper") > F.col("n_lower"),
        "lines": (F.col("n_dup_lines") >= 3) & (_ratio("n_dup_lines", "n_lines") > 0.3),  # of three lines one may repeat
        "repeats": _ratio("n_repeat_words", "n_words") > 0.2,
        "word_size": (long_word < 2.5) | (long_word > 14),
        "open_lines": ~paired & (_ratio("n_open_lines", "n_lines") > 0.6),
    }
    good = {
        "prose": (F.col("n_symbols") * 50 <= F.col("n_words")) & (F.col("n_marks") * 20 <= F.col("n_words")) & (F.col("n_upper") * 4 < F.col("n_lower")),
        "varied": (F.col("n_dup_lines") * 10 <= F.col("n_lines")) & (F.col("n_repeat_words") * F.when(paired, 5).otherwise(10) <= F.col("n_words")),
    }
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {k: F.when(v, 1).otherwise(0) for k, v in good.items()}


#: P(vote | class) as believed before the corpus is seen; class bad, good; vote bad, abstain, good.  A detector of one
#: kind of junk stays silent on most bad documents and on nearly all good ones; a rule that votes good only is silent on
#: many good ones; a rule of both kinds may err either way.
PRIORS = {
    "bad": np.array([[0.299, 0.7, 0.001], [0.02, 0.979, 0.001]]),
    "good": np.array([[0.001, 0.849, 0.15], [0.001, 0.399, 0.6]]),
    "both": np.array([[0.3, 0.6, 0.1], [0.02, 0.38, 0.6]]),
}


def fit(patterns: np.ndarray, counts: np.ndarray, kinds: list[str] | None = None, rounds: int = 60, weight: float = 20.0) -> tuple[float, np.ndarray]:
    """EM for the share of good documents and P(vote | class) of each rule, as an array [rule, class, vote + 1].

    ``kinds``: of each rule the name of its prior.  ``weight`` documents of prior belief say that rules vote rightly far
    more often than wrongly, which also fixes which class is the good one; so EM is defined on an empty corpus and on
    one without bad documents, and a corpus in which all documents are alike is judged by the priors."""
    n_rules = patterns.shape[1]
    prior = np.stack([PRIORS[k] for k in (kinds or ["both"] * n_rules)])
    table, share = prior.copy(), 0.8
    at = np.arange(n_rules)
    for _ in range(rounds):
        like = np.log(np.stack([table[at, c, patterns + 1] for c in (0, 1)])).sum(-1) + np.log([1 - share, share])[:, None]
        post = np.exp(like - like.max(0))
        post = post / post.sum(0) * counts
        share = float(np.clip((post[1].sum() + 0.8 * weight) / (counts.sum() + weight), 0.01, 0.99))
        for vote in (-1, 0, 1):
            table[:, :, vote + 1] = np.stack([(post[c][:, None] * (patterns == vote)).sum(0) + weight * prior[:, c, vote + 1] for c in (0, 1)], axis=1)
        table /= table.sum(-1, keepdims=True)
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    at = np.arange(patterns.shape[1])
    like = np.log(np.stack([table[at, c, patterns + 1] for c in (0, 1)])).sum(-1) + np.log([1 - share, share])[:, None]
    return 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))


def weak_quality(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, least: float = 0.5, min_words: int = 10, most_repeat_percent: int = 20) -> DataFrame:
    """``docs`` with FEATURES, ``votes`` (one character per rule), ``p_good``, ``base_failed`` and ``kept``.

    ``keep`` names the input columns to pass through (default: all).  The features are staged, so texts are read once."""
    named = rules()
    new = {*FEATURES, "votes", "p_good", "base_failed", "kept"}
    passed = others(docs.columns if keep is None else keep, new)
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField(c, T.LongType()) for c in FEATURES])

    def run(batches):
        for batch in sub_batches(batches, "__text", 1 << 20):
            got = features(batch.column(len(passed)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *(pa.array(got[c]) for c in FEATURES)], names=[*passed, *FEATURES])

    found = docs.select(*passed, F.col(text).alias("__text")).mapInArrow(lean(run), schema)
    code = sum((v + 1) * 3**i for i, v in enumerate(named.values()))
    found = staged(found.withColumn("__code", code.cast("int")), "quality")
    seen = {r[0]: r[1] for r in found.groupBy("__code").count().collect()}
    patterns = np.array([[(c // 3**i) % 3 - 1 for i in range(len(named))] for c in range(3 ** len(named))])
    counts = np.zeros(len(patterns))
    counts[list(seen)] = list(seen.values())
    p_good = posterior(patterns, *fit(patterns[counts > 0], counts[counts > 0], ["bad" if k in BAD else "good" for k in named]))
    votes = F.concat(*(F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), (F.floor(F.col("__code") / 3**i) % 3 + 1).cast("int")) for i in range(len(named))))
    belief = {int(c): float(p_good[c]) for c in seen}
    p = F.element_at(F.create_map(*(F.lit(x) for kv in belief.items() for x in kv)), F.col("__code")) if belief else F.lit(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return found.withColumns({"votes": votes, "p_good": p, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).drop("__code")
