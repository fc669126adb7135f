"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams of three to six code points inside its words, one boundary blank at
either end included, A-Z in lower case; other ASCII characters than letters and digits end a word. A feature's
value is ln(1 + its count) times the log ratio of its smoothed document shares under the two labels; logistic
regression with L2 penalty is fitted on the values. Only n-grams whose shares differ by SIGNIFICANT standard
errors between the labels take part, of them the FEATURES of the largest difference.

Labels are learnt from at most MOST rows, those with the smallest hashes of their ids among the rows
outside the held-out fold, one text for each id; every text is scored as a whole.

Defined results: null and empty texts score the intercept alone; repeated rows score alike, and of several
texts of one id the smallest is learnt from; of several labels of an id the largest counts; n-grams that tie
for the last place go by their hashes; without both labels among the rows learnt from, every score is the
smoothed share of label 1; an empty table gives none; a column score of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import _A, mix, slices
from quern.llm.common import checkpointed
from quern.llm.labelled import held_out, learnable, sampled

ORDERS = (3, 4, 5, 6)
#: Labelled rows to learn from at most; documents that a feature must lie in; rounds, step and penalty of the fit;
#: weight of a text of label 1, which is the rarer.
MOST, LEAST, ROUNDS, STEP, PENALTY, WEIGHT = 5_000, 5, 150, 0.1, 1e-5, 2.0
SIGNIFICANT, FEATURES, THRESHOLD = 5.0, 20_000, 0.5
#: Bits of the table that tells most n-grams outside the model at once.
_FILTER = 1 << 20

_SEPARATOR = np.ones(128, bool)
_SEPARATOR[48:58] = _SEPARATOR[97:123] = _SEPARATOR[65:91] = False


def occurrences(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (text index, hash) of every n-gram."""
    joined = "\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass")
    cp = np.frombuffer(joined, np.uint32).copy()
    start = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    cp[(cp >= 65) & (cp <= 90)] += 32
    gap = cp < 128
    gap[gap] = _SEPARATOR[cp[gap]]
    cp[gap] = 32
    h = cp.astype(np.uint64)
    inner = np.zeros(len(cp), bool)
    for n in range(2, max(orders) + 1):
        size = len(cp) - n + 1
        if size <= 0:
            return
        h = (h[:size] * _A) ^ (h[:size] >> np.uint64(29))
        h += cp[n - 1 :]
        inner = inner[:size] | gap[n - 2 : n - 2 + size] if n > 2 else inner[:size]
        if n in orders:
            at = np.flatnonzero(~inner & ~(gap[:size] & gap[1 : size + 1]))
            yield np.searchsorted(start, at, "right") - 1, mix(h[at] ^ np.uint64(n))


def grams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of the distinct n-grams of each text, by text and hash."""
    found = list(occurrences(texts, orders))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
    return doc[first], h[first], np.diff(np.concatenate((first, [len(h)])))


@dataclass
class Model:
    """score = sigmoid(sum of weight * ln(1 + count) over a text's n-grams + intercept); grams ascend."""

    grams: np.ndarray
    weight: np.ndarray
    intercept: float
    orders: tuple[int, ...] = ORDERS

    def __post_init__(self):
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.grams % np.uint64(_FILTER)] = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for doc, h in occurrences(texts, self.orders) if len(self.grams) else ():
            some = np.flatnonzero(self.filter[h & np.uint64(_FILTER - 1)])
            doc, h = doc[some], h[some]
            place = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            hit = self.grams[place] == h
            key, count = np.unique(doc[hit] * len(self.grams) + place[hit], return_counts=True)
            z += np.bincount(key // len(self.grams), weights=self.weight[key % len(self.grams)] * np.log1p(count), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(ratio: np.ndarray, row: np.ndarray, feature: np.ndarray, count: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature and intercept of the penalised regression on values ln(1 + count) * ratio, by gradient steps."""
    n = len(label)
    share = (label.sum() + 1) / (n + 2)
    value = np.log1p(count) * ratio[feature]
    weigh = np.where(label == 1, WEIGHT, 1.0) / n
    w, bias, gw, gb = np.full(len(ratio), 0.02), float(np.log(share / (1 - share))), np.full(len(ratio), 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(row, weights=value * w[feature], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - label) * weigh
        g = np.bincount(feature, weights=value * error[row], minlength=len(ratio)) + PENALTY * w
        gw += g * g
        w -= STEP * g / np.sqrt(gw)
        gb += error.sum() ** 2
        bias -= STEP * error.sum() / np.sqrt(gb)
    return w * ratio, float(bias)


def ratios(counted: DataFrame, positives: int, negatives: int) -> DataFrame:
    """(gram, ratio) of the n-grams that differ significantly; counted: gram, pos, neg (documents that hold it)."""
    pos, neg, total = F.col("pos"), F.col("neg"), float(positives + negatives)
    pool = (pos + neg) / total
    error = F.sqrt(pool * (1 - pool) * (1 / positives + 1 / negatives)) + 1e-12
    apart = F.abs(pos / positives - neg / negatives) / error
    ratio = F.log((pos + 1) / (positives + 1) / ((neg + 1) / (negatives + 1)))
    able = counted.where(pos + neg >= LEAST).select("gram", ratio.alias("ratio"), apart.alias("apart")).where(F.col("apart") >= SIGNIFICANT)
    return able.orderBy(F.desc("apart"), "gram").limit(FEATURES).select("gram", "ratio")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", most: int = MOST) -> Model:
    """docs needs doc_id and text. What reaches the driver is bounded by most and FEATURES."""
    chosen = sampled(learnable(labels, label), most, 9)
    texts = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = checkpointed(texts.select("doc_id", "text", "label"))
    number = dict(rows.groupBy("label").count().collect())
    positives, negatives = number.get(1, 0), number.get(0, 0)
    share = (positives + 1) / (positives + negatives + 2)
    if not positives or not negatives:
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                doc, h, _ = grams(texts[lo:hi])
                uniq, place = np.unique(h, return_inverse=True)
                pos = np.bincount(place, weights=toxic[lo:hi][doc], minlength=len(uniq)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(np.bincount(place, minlength=len(uniq)) - pos)], names=["gram", "pos", "neg"])

    counted = rows.mapInArrow(counts, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    picked = ratios(counted, positives, negatives).toPandas()
    known = picked["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    known, ratio = known[order], picked["ratio"].to_numpy(float)[order]
    if not len(known):
        return Model(known, ratio, float(np.log(share / (1 - share))))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                doc, h, count = grams(texts[lo:hi])
                place = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                hit = shared.value[place] == h
                cut = np.searchsorted(doc[hit], np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (place[hit], count[hit])]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), *lists], names=["label", "feature", "n"])

    got = rows.mapInArrow(values, "label int, feature array<int>, n array<int>").toArrow()
    lists = got.column("feature").combine_chunks()
    row = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    weight, bias = fit(ratio, row, lists.flatten().to_numpy(), got.column("n").combine_chunks().flatten().to_numpy(), got.column("label").to_numpy())
    return Model(known, weight, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double); no shuffle."""
    plain = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB at most, fixed by FEATURES and _FILTER
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(m.score(texts[lo:hi]))], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
