"""Toxicity by maximum-scoring segments over token log-odds.

Each token's score is the lower confidence bound of its log-odds between toxic and other labelled
texts, under a Dirichlet prior; tokens that tell nothing cost ``DRIFT``. One linear scan finds every
maximal segment of a text's scores (those that no longer or shorter neighbour beats): its toxic
passages. Under the scores' distribution in clean texts the best segment of n tokens follows an
extreme-value law with parameters lambda and K; a segment's excess ``lambda * S - ln(K * n)`` is its
significance, whatever the text's length. A document has the excess of its best segment (its inverse
hyperbolic sine) and the root of the sum of all significant ones, and a logistic curve, fitted on
labelled texts whose tokens were not counted, maps these two to a score. Neither is clipped.

Learning takes at most ``SAMPLE`` labelled documents, those with the least hash of their id, so what
is broadcast, their telling tokens, is bounded by what is in them; all of these are kept. Every whole
text is scored.

Results in odd cases: a null or empty text scores like a text of one token that tells nothing; null or
missing labels are not learned from, of several labels the largest counts; repeated rows have equal
scores; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import asinh, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 30_000
DRIFT, PRIOR, CONFIDENCE, LEAST_Z = 0.7, 0.5, 1.64, 2.5
PENALTY = 0.1
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass."""
    s = np.asarray(scores, np.float64)
    sums = np.concatenate([[0.0], np.cumsum(s)])
    held: list[tuple] = []  # start, end, sum before, sum after, index of the last one with a lower sum before
    for i in np.flatnonzero(s > 0).tolist():
        start, before, after = i, sums[i], sums[i + 1]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append((start, i + 1, before, after, j))
                break
            start, before = held[j][0], held[j][2]
            del held[j:]
            j -= 1
    return [(a, b, float(y - x)) for a, b, x, y, _ in held]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fitted: bool = False

    def base(self, n: int) -> float:
        """What a segment's scaled score in ``n`` tokens has to exceed."""
        return log(self.size * max(1, n))

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, excess) of each maximal segment; significant where the excess is above 0."""
        get = self.scores.get
        found = segments(np.fromiter((get(w, -DRIFT) for w in words), np.float64, len(words)))
        return [(a, b, self.rate * s - self.base(len(words))) for a, b, s in found]

    def statistics(self, words: list[str]) -> tuple[float, float]:
        """The best segment's excess (of a score of 0 if there is none) on a scale that grows slowly on
        both sides, and the root of the sum of the significant ones."""
        excess = [x for _, _, x in self.passages(words)]
        return asinh(max(excess, default=-self.base(len(words)))), sum(x for x in excess if x > 0) ** 0.5

    def score(self, words: list[str]) -> float:
        if not self.fitted:
            return 0.0
        best, root = self.statistics(words)
        a, b, c = self.weights
        z = a + b * best + c * root
        return 1.0 / (1.0 + exp(-z)) if z >= 0 else 1.0 - 1.0 / (1.0 + exp(z))


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum(weights * exp(lambda * values)) = 1, for a negative mean."""
    if not (values > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return max(0.05, low)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Offset and weights by Newton's method with a small penalty on the weights."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = np.array([1e-6] + [PENALTY] * (len(w) - 1))
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - penalty * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows outside the held-out fold: tokens from two folds, calibration on the
    third."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 2)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "toxic", fold(F.col("doc_id")).cast("int").alias("fold"))

    def count(parts):
        toxic, clean = Counter(), Counter()
        for batch in parts:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(tokens(text))
            if len(toxic) + len(clean) > 200_000:
                yield _counts(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield _counts(toxic, clean)

    counted = rows.filter("fold <> 3").select("text", "toxic").mapInArrow(count, "token string, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).persist()
    sums = counted.agg(F.sum("t"), F.sum("c"), F.count(F.lit(1))).first()
    if not sums[0] or not sums[1]:
        counted.unpersist()
        return Model()
    nt, nc, kinds = sums
    a = F.lit(PRIOR)
    total = PRIOR * kinds
    odds = F.log((F.col("t") + a) / (F.lit(nt + total) - F.col("t") - a)) - F.log((F.col("c") + a) / (F.lit(nc + total) - F.col("c") - a))
    spread = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    kept = counted.select("token", "t", "c", odds.alias("odds"), spread.alias("spread")).filter((F.col("odds") / F.col("spread") >= LEAST_Z) & (F.col("odds") - CONFIDENCE * F.col("spread") > 0))
    kept = kept.collect()  # telling tokens of at most `sample` documents
    counted.unpersist()
    model = Model({r.token: r.odds - CONFIDENCE * r.spread for r in kept})
    values = np.array([*model.scores.values(), -DRIFT])
    share = np.array([(r.c + PRIOR) / (nc + total) for r in kept])
    model.rate = _rate(values, np.append(share, max(0.0, 1 - share.sum())))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def best(parts):
        scores = sent.value.scores
        for batch in parts:
            words = [tokens(t) for t in batch.column(0).to_pylist()]
            top = [max((s for _, _, s in segments([scores.get(w, -DRIFT) for w in x])), default=0.0) for x in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(x) for x in words], pa.int64()), pa.array(top, pa.float64())], ["toxic", "n", "best"])

    held = rows.filter("fold = 3").select("text", "toxic").persist()
    clean = held.filter("toxic = 0").mapInArrow(best, "toxic int, n long, best double").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.exp(-F.lit(model.rate) * F.col("best"))).alias("s")).first()
    model.size = max(1e-6, clean.m / clean.s) if clean.s else 1.0

    sized = docs.sparkSession.sparkContext.broadcast(model)

    def measure(parts):
        m = sized.value
        for batch in parts:
            both = [m.statistics(tokens(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64())], ["toxic", "best", "root"])

    found = held.mapInArrow(measure, "toxic int, best double, root double").collect()  # at most a third of `sample`
    held.unpersist()
    y = np.array([float(r.toxic > 0) for r in found])
    if 0 < y.sum() < len(y):
        model.weights = _logistic(np.array([(r.best, r.root) for r in found]), y)
        model.fitted = True
    return model


def _counts(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    words = list(toxic | clean)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["token", "t", "c"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, with_passages: bool = False) -> DataFrame:
    """doc_id, score and predicted; with passages: (start, end, excess) of each significant one, in
    characters of the lower-cased text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the telling tokens of the learned sample

    def run(parts):
        m = sent.value
        for batch in parts:
            texts = batch.column(1).to_pylist()
            scores = [m.score(tokens(t)) for t in texts]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            if with_passages:
                columns.append(pa.array([_spans(m, t) for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "score", "predicted"] + ["passages"] * with_passages
    schema = "doc_id long, score double, predicted int" + ", passages array<struct<start: int, end: int, excess: double>>" * with_passages
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _spans(model: Model, text: str | None) -> list[dict]:
    found = list(TOKEN.finditer((text or "").lower()))
    return [{"start": found[a].start(), "end": found[b - 1].end(), "excess": x} for a, b, x in model.passages([m[0] for m in found]) if x > 0]
