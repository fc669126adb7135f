"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic scorer that minimises the non-negative
unbiased risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-)). The class prior pi comes from all trusted and all
unlabelled rows outside the held-out fold: first fits, each without one part of the ids, score the rows of that part
in tasks, and histograms of the scores are added up; of the thresholds, that whose share of unlabelled over share
of positives above it is least, with a margin for sampling, bounds the prior. Label 0 is never learnt from.

Features are shares and ratios of a text's characters, words and lines, each cut into bins at quantiles of
the sample, so that the scorer is additive and monotone in none of them.

The weights are learnt from at most MOST positives and MOST unlabelled documents, those with the smallest hashes of
their ids outside the held-out fold, one text for each id; every text is scored as a whole.

Defined results: null and empty texts have all features zero and are scored as such; repeated rows score
alike, and of several texts of one id the smallest is learnt from; equal hashes go by the id; without positives or
unlabelled text every score is 0.5; an empty table gives an empty table; other columns of the input than doc_id
and text are not read, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import WHITE, TextBatch, combine, repeated, slices
from quern.llm.common import checkpointed
from quern.llm.labelled import held_out, learnable, sampled

MOST, BINS, ROUNDS, STEP, PENALTY = 20_000, 12, 300, 0.1, 1e-3
THRESHOLD = 0.3
#: Prior of the first fits, of which each leaves out one of PARTS, and chance that the sampling margin of the
#: prior's estimate fails. The estimate errs upwards, as unlabelled and positive texts overlap, and too high a
#: prior leaves the bracket of the risk empty: half the margin and SLACK are taken off.
FIRST_PRIOR, PARTS, RISK, SLACK = 0.5, 3, 0.1, 0.03
#: Bins of the histograms of first scores.
HISTOGRAM = 4096


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGITS = _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("abcdefghijklmnopqrstuvwxyz"), _among("0123456789")
_SYMBOLS, _STOPS, _SHOUT = _among("#*$%&|<>{}[]\\^~=_"), _among(".,;:"), _among("!?")
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "shouts", "non_ascii", "distinct_words", "repeated_words", "twin_words", "repeated_lines", "line_words", "long_words")


def features(texts: list[str | None]) -> np.ndarray:
    """One row of the features in NAMES per text."""
    b = TextBatch(texts)
    start, end, doc = b.words()
    h = b.hash_spans(start, end)
    count = lambda owner: np.bincount(owner, minlength=b.n).astype(float)
    share = lambda x, of: x / np.maximum(of, 1)
    table = lambda flags: b.per_text(flags[b.bytes])
    words, letters = count(doc), table(_UPPER) + table(_LOWER)
    size = table(~WHITE)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(doc), bool)
    fresh[order[1:]] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    twin = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    covered = np.zeros(len(doc) + 2, bool)
    if len(doc) >= 3:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        again = whole[repeated(doc[whole], combine(h, 3)[whole])]
        for i in range(3):
            covered[again + i] = True
    ls, le, ld = b.lines()
    line_again = repeated(ld, b.hash_spans(ls, le))
    return np.column_stack([
        np.log1p(words), share(size, words), share(table(_UPPER), letters), share(table(_DIGITS), size), share(table(_SYMBOLS), size), share(table(_STOPS), words),
        share(table(_SHOUT), words), share(table(np.arange(256) > 127), size), share(count(doc[fresh]), words), share(count(doc[covered[: len(doc)]]), words),
        share(count(doc[twin]), words), share(count(ld[line_again]), count(ld)), share(words, count(ld)), share(count(doc[end - start > 24]), words),
    ])


@dataclass
class Model:
    edges: list[np.ndarray]
    weight: np.ndarray
    intercept: float
    prior: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Index of the active bin of every feature, in one numbering."""
        return np.column_stack([np.searchsorted(e, x[:, j], "right") + j * (BINS + 1) for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weight[self.columns(x)].sum(1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _descend(pos: np.ndarray, unl: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Gradient steps on the non-negative risk with logistic loss; where its bracket is negative, away from it."""
    w, bias, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for _ in range(ROUNDS):
        zp, zu = w[pos].sum(1) + bias, w[unl].sum(1) + bias
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = sigmoid(zu) / len(unl)
        down = -prior * sigmoid(zp) / len(pos)
        if bracket >= 0:
            ep, eu = prior * (sigmoid(zp) - 1) / len(pos) + down, up
        else:
            ep, eu = -down, -up
        g = np.bincount(pos.ravel(), weights=np.repeat(ep, pos.shape[1]), minlength=size) + np.bincount(unl.ravel(), weights=np.repeat(eu, unl.shape[1]), minlength=size) + PENALTY * w
        gw += g * g
        w -= STEP * g / np.sqrt(gw)
        gb += (ep.sum() + eu.sum()) ** 2
        bias -= STEP * (ep.sum() + eu.sum()) / np.sqrt(gb)
    return w, bias


def prior_of(pos: np.ndarray, unl: np.ndarray) -> float:
    """Least ratio of unlabelled to positive shares above a threshold, with Hoeffding-style margins, from the numbers
    of positive and unlabelled scores in ascending bins."""
    n_pos, n_unl = pos.sum(), unl.sum()
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    p, u = above(pos)[pos > 0], above(unl)[pos > 0]
    margin = np.sqrt(np.log(4 / RISK) / 2) * (1 / np.sqrt(n_pos) + 1 / np.sqrt(n_unl))
    best = int(np.argmin((u + margin) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9) - margin / 2 - SLACK, 0.05, 0.99))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The prior from two samples of scores."""
    cuts = np.unique(np.concatenate((pos, unl)))
    return prior_of(*(np.bincount(np.searchsorted(cuts, x), minlength=len(cuts)) for x in (pos, unl)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of the scores before the sigmoid, with logistic loss."""
    lost = lambda z: float(np.logaddexp(0, -z).mean())
    return prior * lost(positive) + max(0.0, lost(-unlabelled) - prior * lost(-positive))


def first_fits(pos: np.ndarray, unl: np.ndarray, pos_part: np.ndarray, unl_part: np.ndarray) -> list[Model]:
    """A model for each part of the ids, fitted without it; their bins are those of both samples."""
    both = np.vstack([pos, unl])
    # quantiles crowd where most texts are alike; equal steps of the range keep the tails apart
    edges = []
    for j in range(both.shape[1]):
        x = both[:, j]
        inner = np.concatenate((np.quantile(x, np.linspace(0, 1, BINS // 2 + 2)[1:-1]), np.quantile(pos[:, j], (0.001, 0.005, 0.99, 0.995, 0.999, 1))))
        edges.append(np.sort(inner[:BINS]))
    size = len(NAMES) * (BINS + 1)
    plain = Model(edges, np.zeros(size), 0.0, FIRST_PRIOR)
    p, u = plain.columns(pos), plain.columns(unl)
    out = []
    for k in range(PARTS):
        ip, iu = pos_part != k, unl_part != k
        # too few rows to leave any out: all of them
        ip, iu = (x if x.any() else np.ones(len(x), bool) for x in (ip, iu))
        out.append(Model(edges, *_descend(p[ip], u[iu], size, FIRST_PRIOR), FIRST_PRIOR))
    return out


def fit(pos: np.ndarray, unl: np.ndarray, edges: list[np.ndarray], prior: float) -> Model:
    model = Model(edges, np.zeros(len(NAMES) * (BINS + 1)), 0.0, prior)
    return Model(edges, *_descend(model.columns(pos), model.columns(unl), len(model.weight), prior), prior)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, and features (array<double>); no shuffle."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                x = features(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], lists], names=[*keep, "features"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def _part():
    return F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(PARTS)).cast("int")


def histograms(docs: DataFrame, sides: DataFrame, models: list[Model], text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Numbers of positive and unlabelled rows of docs by bins of their first scores; sides: doc_id, _s (1 positive,
    0 neither). Rows outside the held-out fold that sides does not name are unlabelled."""
    rows = docs.where(~held_out()).select("doc_id", F.col(text).cast("string").alias("_text"), _part().alias("_part"))
    scored = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                x = features(texts[lo:hi])
                each = np.stack([m.score(x) for m in scored.value])[part[lo:hi], np.arange(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.minimum(each * HISTOGRAM, HISTOGRAM - 1).astype(np.int32))], names=["doc_id", "bin"])

    binned = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bin int")
    counted = binned.join(sides, "doc_id", "left").groupBy(F.coalesce("_s", F.lit(-1)).alias("side"), "bin").agg(F.count("*").alias("c")).collect()
    out = np.zeros((2, HISTOGRAM), np.int64)
    for r in counted:
        if r["side"]:
            out[0 if r["side"] == 1 else 1, r["bin"]] += r["c"]
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most: int = MOST) -> Model:
    """docs needs doc_id and text; what reaches the driver is bounded by most and HISTOGRAM."""
    good = learnable(labels, label).where("label = 1").select("doc_id")
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    web = docs.where(~held_out()).select("doc_id").distinct().join(marked, "doc_id", "left_anti")
    trusted = sampled(good, most, 6)
    chosen = checkpointed(trusted.select("doc_id", F.lit(1).alias("_s")).union(sampled(web, most, 66).select("doc_id", F.lit(0))))
    texts = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_s").alias("_s"))
    rows = measured(texts.withColumn("_part", _part()), ["_s", "_part"]).collect()
    side = {s: [r for r in rows if r["_s"] == s] for s in (1, 0)}
    if not side[1] or not side[0]:
        return Model([np.zeros(BINS)] * len(NAMES), np.zeros(len(NAMES) * (BINS + 1)), 0.0, 0.5)
    (pos, unl), (pos_part, unl_part) = ([np.array([r[c] for r in side[s]]) for s in (1, 0)] for c in ("features", "_part"))
    first = first_fits(pos, unl, pos_part, unl_part)
    sides = marked.join(good.withColumn("_g", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("_g", F.lit(0)).alias("_s"))
    positive, unlabelled = histograms(docs, sides, first, text)
    return fit(pos, unl, first[0].edges, prior_of(positive, unlabelled))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, and score (double); no shuffle."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for lo, hi in slices([len(t or "") + 64 for t in texts]):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], pa.array(model.score(features(texts[lo:hi])))], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
