"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased letters (other characters count as one
space); term frequency is an n-gram's share of its text, inverse document frequency is counted over *all* training
rows. The weights are trained with follow-the-regularised-leader (proximal, per coordinate, L1 and L2 penalties) on a
sample of at most ``SAMPLE`` distinct labelled texts. Each language has a quota of it: an equal share, and what smaller languages
leave; of a language with more texts those of the smallest hashes are taken. If there are more languages than ``SAMPLE``, the most
frequent take part. A fifth of the sample is kept back to calibrate one temperature by its log-loss. Whole texts are read in training
and in prediction.

Training rows have crc32(id as text) mod 5 other than 0, a label and a letter; a row without an id is no training row.
Only the text enters a prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; without any training row all are; repeated rows
get equal results; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memaudit.llm.common import add_columns, fresh, quoted, utf8

ORDERS, BUCKET_BITS = (1, 2, 3), 15
BUCKETS = 1 << BUCKET_BITS
#: Distinct labelled texts that the weights are fitted on, at most.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
#: Shares of n-grams are small numbers; they enter the regression times this.
SCALE = 100.0
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    """Whether a row's id keeps it out of training."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trains(id_col: str) -> Column:
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(raw: bytes | None) -> np.ndarray:
    """The buckets of all n-grams of a text, repeats included; empty if it has no letter."""
    points = np.frombuffer((raw or b"").decode().lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    first_gap = ~letter
    first_gap[1:] &= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[letter | first_gap]
    out, mixed = [], np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        mixed = mixed[:len(points) - order + 1] * np.uint32(0x01000193) + points[order - 1:] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            spread = (mixed ^ (mixed >> np.uint32(15)) ^ np.uint32(order)) * np.uint32(0x85EBCA77)
            out.append(spread >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, scaled by the inverse document frequencies
    bias: np.ndarray
    temperature: float

    def logits(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for at in range(0, len(grams), 1 << 18):
            total += self.weights[grams[at:at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return total / len(grams) + self.bias

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        grams = ngrams(raw)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(grams) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts (the only column) each bucket occurs, and how many texts have a letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), 0
        for batch in batches:
            for raw in utf8(batch.column(0)):
                grams = ngrams(raw)
                seen[:] = False
                seen[grams] = True
                found += seen
                n += bool(len(grams))
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, BUCKETS]), pa.array(np.r_[found[own], n])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts[:BUCKETS], int(counts[BUCKETS])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (buckets, values, class) rows, by FTRL-proximal with elastic-net penalties."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(own: np.ndarray) -> np.ndarray:
        zs, ns = z[own], n[own]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        w[np.abs(zs) <= L1] = 0
        return w

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            own, value, label = rows[i]
            own, value = np.r_[own, BUCKETS], np.r_[value, 1.0]  # the last is the bias
            w = weights(own)
            error = _softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            rate = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
            z[own] += g - rate * w
            n[own] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log-loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(logits / math.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """How many texts of each language the sample takes: equal shares, smaller languages leave theirs to the others."""
    out, left = {}, sample
    for i, name in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[name] = min(sizes[name], left // (len(sizes) - i))
        left -= out[name]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    rows = docs.where(trains(id_col) & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(
        quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang"), F.xxhash64(quoted(text).cast("string"), F.lit("sample")).alias("h"))
    counts, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + counts)) + 1
    # distinct texts of each language, to within some per cent: they only set the share of the hashes that is fetched
    sizes = dict(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect())
    quota = quotas(sizes, sample)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 1.1 * quota[k] / sizes[k])) for k in sorted(sizes)], "lang string, share double")  # SAMPLE rows at most

    def features(texts: list[bytes | None]) -> list[list]:
        found = [np.unique(ngrams(t), return_counts=True) for t in texts]
        return [[own.astype(np.int32) for own, _ in found], [n.astype(np.int32) for _, n in found]]

    fields = [T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    picked = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).dropDuplicates(["h", "lang"])  # equal texts teach once
    found = sorted(((r["h"] % (1 << 64), r["lang"], np.array(r["own"]), np.array(r["n"])) for r in add_columns(picked, "text", fields, features, ["h", "lang"]).collect() if r["own"]),
                   key=lambda r: r[:2])
    got, taken = [], Counter()
    for r in found:
        taken[r[1]] += 1
        if taken[r[1]] <= quota[r[1]]:
            got.append(r)
    languages = sorted({r[1] for r in got})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    data = [(own, SCALE * n / n.sum() * idf[own], languages.index(name)) for _, name, own, n in got]
    kept_back = [r for i, r in enumerate(data) if i % 5 == 4]
    weights, bias = ftrl([r for i, r in enumerate(data) if i % 5 != 4], len(languages))
    temperature = 1.0
    if kept_back:
        temperature = calibrate(np.array([value @ weights[own] + bias for own, value, _ in kept_back]), np.array([label for *_, label in kept_back]))
    return Model(languages, (weights * (SCALE * idf)[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the predicted language and its calibrated probability."""
    def predict(texts: list[bytes | None]) -> list[list]:
        return list(map(list, zip(*map(model.predict, texts)))) or [[], []]

    return add_columns(docs, text, [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())], predict, keep)


def confident(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows of no language, or whose language is less likely than ``least``."""
    label, score = fresh(docs, "lang_pred", "lang_score")
    return identify(docs, model, text, label, score).where((F.col(label) != UNKNOWN) & (F.col(score) >= least)).select(*[quoted(c) for c in docs.columns])
