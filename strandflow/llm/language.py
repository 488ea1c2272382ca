"""Language identification by error-correcting output codes.

Each language gets a codeword of bits, far from the others in Hamming distance.  For each bit one binary classifier
over hashed byte 1- to 4-grams of its lower-cased words learns to tell the languages with a 1 from those with a 0.  A
text is read whole; its language is the codeword with the least summed loss of the classifiers' margins, each bit
weighted by how well its classifier did on the sample.  Where the two best codewords are close, ``ambiguous`` is true.

The classifiers are fitted on a bounded sample: about ``sample`` documents of each language, picked by a hash of their
id, of at most an equal share of ``sample_bytes`` of text each (its
shortest text at least); a text that does not fit is left out.  Only text and language are learned from.

Defined results: ``und`` with score 0 for a null text or one without a letter, or if there is nothing to learn from;
rows that repeat are judged alike; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sub_batches, unit, words_of

BITS = 14  # of the feature space
_ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48  # all digits are one


def _grams(words: list[bytes]):
    """n-grams of words with a blank on either side, order by order: the feature at each byte of all of them in a row,
    and for each word the bytes where its own n-grams begin (first, and one past the last)."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    size = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    b = _FOLD[raw]
    for n in _ORDERS:
        x = np.full(max(len(b) - n + 1, 0), n, dtype=np.uint32)
        for j in range(n):
            x = (x + b[j : j + len(x)]) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
        yield x >> np.uint32(32 - BITS), first, np.maximum(first + size + 3 - n, first)


def _counts(text: str) -> np.ndarray:
    """A text's features: counts of its n-grams per byte."""
    words = text.encode("utf-8", "surrogatepass").split()
    total = np.zeros(1 << BITS, dtype=np.float32)
    for gram, first, end in _grams(words):
        own = np.zeros(len(gram) + 1, dtype=np.int32)
        np.add.at(own, np.minimum(first, len(gram)), 1)
        np.add.at(own, np.minimum(end, len(gram)), -1)
        total += np.bincount(gram[np.cumsum(own[:-1]) > 0], minlength=1 << BITS)
    return total / max(sum(len(w) + 1 for w in words), 1)


def _margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Each text's features times the weights, an array [text, bit]; every distinct word is weighed once."""
    words, starts = words_of(texts)
    total = np.zeros((len(texts), weights.shape[1]))
    if not len(words):
        return total
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    own = np.zeros((len(distinct), weights.shape[1]))
    for gram, first, end in _grams(distinct):
        for bit in range(weights.shape[1]):
            run = np.concatenate(([0.0], np.cumsum(weights[gram, bit], dtype=np.float64)))
            own[:, bit] += run[np.minimum(end, len(gram))] - run[np.minimum(first, len(gram))]
    index = np.asarray(words.indices)
    for bit in range(weights.shape[1]):
        run = np.concatenate(([0.0], np.cumsum(own[index, bit])))
        total[:, bit] = run[starts[1:]] - run[starts[:-1]]
    size = np.fromiter((len(w) + 1 for w in distinct), dtype=np.int64, count=len(distinct))
    run = np.concatenate(([0], np.cumsum(size[index])))
    return total / np.maximum(run[starts[1:]] - run[starts[:-1]], 1)[:, None]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n distinct rows of bits: all splits into two sides for up to four languages, else the best of some random codes."""
    if n <= 1:
        return np.zeros((n, 1), dtype=np.int8)
    if n <= 4:
        columns = [[(c >> i) & 1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(columns, dtype=np.int8).T
    size, rng, best = ceil(10 * log2(n)), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.integers(0, 2, (n, size), dtype=np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < n)]
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) if code.shape[1] else 0
        if gap > best[0]:
            best = (gap, code)
    return best[1]


class Model:
    """The languages, their codewords, and weight, offset and trust of each bit's classifier."""

    def __init__(self, texts: list[str], langs: list[str], rounds: int = 80, decay: float = 1e-3):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        n_bits = self.code.shape[1]
        self.weights = np.zeros((1 << BITS, n_bits), dtype=np.float32)
        self.offset, self.trust = np.zeros(n_bits), np.ones(n_bits)
        if len(self.langs) < 2:
            return
        x = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
        for i, t in enumerate(texts):
            x[i] = _counts(t)
        who = np.searchsorted(self.langs, langs)
        share = 1 / np.bincount(who)[who] / len(self.langs)  # languages count alike
        scale = 1 / (x.std(0) + 1e-4)
        mean = x.mean(0)
        x = (x - mean) * scale / np.sqrt(1 << BITS)
        y = self.code[who].astype(np.float32) * 2 - 1
        w, b = np.zeros((1 << BITS, n_bits), dtype=np.float32), np.zeros(n_bits)
        step = 1.0 / (float(np.einsum("ij,ij,i->", x, x, share, dtype=np.float64)) / 4 + 0.25 + decay)
        for _ in range(rounds):  # logistic loss by accelerated gradient
            g = -y * share[:, None] / (1 + np.exp(np.clip(y * (x @ w + b), -50, 50)))
            w -= 4 * step * (x.T @ g.astype(np.float32) + decay * w)
            b -= 4 * step * g.sum(0)
        right = (((x @ w + b) * y > 0) * share[:, None]).sum(0)
        self.trust = np.log((right + 0.01) / (1 - right + 0.01)).clip(0.05)
        self.weights = (w * scale[:, None] / np.sqrt(1 << BITS)).astype(np.float32)
        self.offset = b - mean @ self.weights

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, score and ambiguity of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        margin = _margins(texts, self.weights) + self.offset
        signs = self.code.astype(np.float64) * 2 - 1
        loss = np.stack([(np.logaddexp(0, -margin * s) * self.trust).sum(1) for s in signs], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = like.max(1) / like.sum(1)
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss.min(1) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\pL"), False).to_numpy(zero_copy_only=False), dtype=bool)
        pred = [self.langs[k] if known else UNKNOWN for k, known in zip(order[:, 0], letters, strict=True)]
        return pred, np.where(letters, score, 0.0), letters & (gap < 1)


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400, sample_bytes: int = 16 << 20) -> Model:
    """The model of ``docs`` (those to learn from).  ``sample`` documents of each language, as near as a hash gives them."""
    learn = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in learn.groupBy(lang).count().collect()}
    if not counts:
        return Model([], [])
    rate = F.element_at(F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, sample / v))), F.col(lang))
    picked = learn.select(F.col(text).alias("t"), F.col(lang).alias("l"), unit(F.col(id_col), F.lit("lang")).alias("u"), rate.alias("rate")).where(F.col("u") < F.col("rate"))
    rows, used, share = [], dict.fromkeys(counts, 0), sample_bytes / len(counts)
    picked = picked.where(F.length("t") <= share)
    for t, lang_of in picked.orderBy(F.col("u") / F.col("rate"), "t").select("t", "l").limit(3 * sample * len(counts)).toLocalIterator():
        if used[lang_of] + len(t) <= share:
            used[lang_of] += len(t)
            rows.append((t, lang_of))
    rest = [k for k, n in used.items() if not n]
    if rest:  # all of their picked texts are longer
        rows += [(r.t, r.l) for r in learn.where(F.col(lang).isin(rest)).groupBy(F.col(lang).alias("l")).agg(F.min_by(text, F.struct(F.length(text), text)).alias("t")).collect()]
    return Model(*map(list, zip(*rows, strict=True))) if rows else Model([], [])


def identify(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400) -> DataFrame:
    """The id, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` of each document, by a model fitted on the rest."""
    model = fitted(docs.where(~held_out(id_col)), id_col=id_col, text=text, lang=lang, sample=sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # size: 2**BITS weights for each bit of the code

    def run(batches):
        for batch in sub_batches(batches, "__text"):
            pred, score, near = sent.value.judge(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
