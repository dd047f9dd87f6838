"""Toxicity by class-conditional Kneser-Ney models.

The class is the context of a word. Within a class a word counts by the number of different words it
comes after, less an absolute discount; the mass freed so goes by shared backoff counts, where, as Kneser-Ney has
it, a word counts by the number of contexts that have it at all: one class or both. So an expression that is
rare in both classes gets the same shared probability from either, up to a constant, and one that a class
uses often and the other never stands out by how often. A text is judged by the log-likelihood ratio of
toxic to ordinary divided by length: of the whole text, and of its one, two and three most toxic words, so that a
slur in a long text is not diluted. A logistic function of these turns them into a score. The
discount and the logistic weights are chosen on the labelled rows by cross-fitting: each half is judged by
the models of the other.

Labels are learned from at most about ``max_docs`` rows per class (a seeded hash of the id chooses them), so what
the driver holds does not grow with the corpus; every document is scored in whole.

Defined cases: null text is empty; a text without words has features 0; null labels and labels of unknown ids
are ignored, of several labels of one id the highest counts; without labels of both classes the score
is the share of toxic labels (0 without any); repeated rows get equal scores; empty tables give an empty result;
``score`` keeps all columns and replaces those named like its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, sliced, table

MAX_DOCS, SEED, THRESHOLD = 10_000, 42, 0.7
FOLDS, HELD_OUT = 3, 1
DISCOUNTS = (0.75, 2.0, 4.0, 8.0)
HIGHEST = (1, 2, 3)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Counts:
    """Continuation counts of the words that exceed 1 in a class, and for every count the number of all words that have it."""

    words: list[str]
    ordinary: np.ndarray
    toxic: np.ndarray
    #: For each class {count: words}.
    spectrum: tuple[dict[int, int], dict[int, int]]


def log_ratios(c: Counts, discount: float) -> tuple[np.ndarray, float]:
    """log p(word | toxic) / p(word | ordinary) of each word, and of all words at or below the discount in both classes."""
    total = [max(1, sum(k * n for k, n in s.items())) for s in c.spectrum]
    types = max(1, sum(sum(s.values()) for s in c.spectrum))
    freed = [max(1e-9, sum(min(k, discount) * n for k, n in s.items()) / t) for s, t in zip(c.spectrum, total, strict=True)]
    shared = np.maximum((c.ordinary > 0).astype(float) + (c.toxic > 0), 1) / types
    p = [np.maximum(x - discount, 0) / t + f * shared for x, t, f in zip((c.ordinary, c.toxic), total, freed, strict=True)]
    return np.log(p[1] / p[0]), float(np.log(freed[1] / freed[0]))


def text_features(ratio: np.ndarray) -> list[float]:
    """Length-normalised log ratios: of the text, then of its highest words, one to three (a shorter text lacks evidence for the rest)."""
    if not len(ratio):
        return [0.0] * (1 + len(HIGHEST))
    most = HIGHEST[-1]
    top = ratio if len(ratio) <= most else np.partition(ratio, len(ratio) - most)[-most:]
    top = np.maximum(np.sort(top)[::-1], 0)
    return [float(ratio.mean()), *(float(top[:k].sum()) / k for k in HIGHEST)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept first) by Newton's method; the classes weigh the same."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + (x - mean) / scale @ w[1:], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int, seed: int) -> DataFrame:
    """(text, y, half) of the labelled rows to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = materialise(known.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "labels")
    share = {r["y"]: min(1.0, max_docs / r["count"]) for r in known.groupBy("y").count().collect()}
    limit = F.when(F.col("y") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    chosen = known.where(F.pmod("h", F.lit(1 << 30)) < limit * (1 << 30)).select("doc_id", "y", F.pmod(F.shiftright("h", 31), F.lit(2)).cast("int").alias("half"))
    return materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", "half"), "labelled")


def _contexts(sample: DataFrame) -> DataFrame:
    """(word, y, half, n): n different words that ``word`` comes after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        h = xxhash.xxh64_intdigest
        for b in sliced(batches):
            seen = set()
            for text, y, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                seen.update(zip(["", *words], words, [2 * y + half] * len(words)))
            rows = list(seen)
            kind = np.array([r[2] for r in rows], np.int32)
            before = np.array([h(r[0]) for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array(before), pa.array(kind)], names=["word", "before", "kind"])

    pairs = sample.mapInArrow(run, "word string, before long, kind int").distinct()
    # A pair that both halves have counts once in the whole, so the whole is not the halves' sum.
    flags = pairs.groupBy("word", "before").agg(*(F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"k{k}") for k in range(4)))
    return flags.groupBy("word").agg(*(F.sum(f"k{k}").cast("int").alias(f"k{k}") for k in range(4)), F.sum(F.greatest("k0", "k1")).cast("int").alias("c0"), F.sum(F.greatest("k2", "k3")).cast("int").alias("c1"))


def _collect_counts(contexts: DataFrame) -> dict[str, Counts]:
    """Counts of half 0, half 1 and the whole; words that stay at 1 everywhere come as numbers only."""
    names = {"0": ("k0", "k2"), "1": ("k1", "k3"), "all": ("c0", "c1")}
    frame = contexts.where(F.greatest("c0", "c1") > 1).toPandas().sort_values("word")
    words = frame["word"].tolist()
    spectrum = {c: {int(r[0]): int(r[1]) for r in contexts.groupBy(c).count().collect() if r[0]} for pair in names.values() for c in pair}
    return {k: Counts(words, frame[a].to_numpy(float), frame[b].to_numpy(float), (spectrum[a], spectrum[b])) for k, (a, b) in names.items()}


def _cross_features(sample: DataFrame, counts: dict[str, Counts]) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, features as rows x discounts x features), each row judged by the other half's models."""
    width = 1 + len(HIGHEST)
    words = counts["all"].words
    tables = {h: [(lambda r: np.append(r[0], r[1]).astype(np.float32))(log_ratios(counts[str(h)], d)) for d in DISCOUNTS] for h in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(words)}
        last = len(words)
        for b in sliced(batches):
            ys, rows = [], []
            for text, y, half in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.array([index.get(w, last) for w in words_of(text)], np.int64)
                ys.append(y)
                rows.append([x for t in tables[1 - half] for x in text_features(t[at])])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(run, "y int, x array<double>").toPandas()
    return got["y"].to_numpy(), np.array(got["x"].tolist()).reshape(len(got), len(DISCOUNTS), width)


@dataclass
class Model:
    words: list[str]
    ratios: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    discount: float
    prior: float

    def scorer(self):
        """text -> score, with its own word index."""
        index, last = {w: i for i, w in enumerate(self.words)}, len(self.words)

        def score(text: str | None) -> float:
            if self.weights is None:
                return self.prior
            at = np.array([index.get(w, last) for w in words_of(text)], np.int64)
            return float(logistic(np.array([text_features(self.ratios[at])]), self.weights)[0])

        return score


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, seed: int = SEED) -> Model:
    sample = _sample(docs, labels, max_docs, seed)
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    prior = size.get(1, 0) / max(1, sum(size.values()))
    if len(size) < 2:
        return Model([], np.zeros(1), None, DISCOUNTS[0], prior)
    counts = _collect_counts(materialise(_contexts(sample), "contexts"))
    y, x = _cross_features(sample, counts)
    best = None
    for k, d in enumerate(DISCOUNTS):
        fitted = fit_logistic(x[:, k], y)
        p = np.clip(logistic(x[:, k], fitted), 1e-9, 1 - 1e-9)
        wrong = np.mean([((p >= THRESHOLD) != y)[y == c].mean() for c in (0, 1)])
        loss = np.mean([-np.log(np.where(y == 1, p, 1 - p))[y == c].mean() for c in (0, 1)])
        if best is None or (wrong, loss) < best[:2]:
            best = (wrong, loss, d, fitted)
    ratios, rest = log_ratios(counts["all"], best[2])
    whole = counts["all"]
    keep = np.flatnonzero(np.maximum(whole.ordinary, whole.toxic) > best[2])  # the others all have the ratio ``rest``
    return Model([whole.words[i] for i in keep], np.append(ratios[keep], rest).astype(np.float32), best[3], best[2], prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    shape = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        judge = model.scorer()
        for b in sliced(batches):
            s = np.array([judge(t) for t in b.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, shape)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).select("doc_id", "held_out", "score", "predicted")
