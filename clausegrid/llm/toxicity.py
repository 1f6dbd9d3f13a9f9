"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are lower-cased words, hashed to ``BUCKETS`` rows. A token's score is the log-odds of its
use in toxic against other labelled documents, with a Dirichlet prior in proportion to its use in
both; each document counts a token once, so that one that repeats itself does not set scores.
Log-odds count as 0 where a likelihood-ratio test finds fewer than ``DEVIATIONS`` standard
deviations. A drift makes the score of ordinary text negative on average. In such a sequence
the segments of maximal score stand out: a linear-time scan finds them all. The score of a
document's best segment follows an extreme-value law in documents that are not toxic: with lambda
the root of E[exp(lambda s)] = 1 under ordinary text, lambda times the score less the logarithm of
the number of words is Gumbel distributed, whatever the length. Its location and a logistic curve,
both fitted on the labelled rows, turn it into p-values of passages and a document's probability.
All maximal segments count: by the same law the number of segments above a score is Poisson, so the
r best of a document are tested together by the r-th, for every r at the price of log(2) a step, and
the best of these tests is the document's score. Its passages are the segments that are significant
alone, and the r best where they are together.

Learned from at most ``max_rows`` labelled documents of either label, chosen by a hash of their id:
two thirds are counted, over their whole texts, and one third calibrates. Null and empty texts have no words and score as a document
whose best segment is 0. Labels that are null are left out; a document with several labels counts
with the highest. Without toxic and other labelled rows all scores are 0. Of segments with equal scores the
first in the text comes first. A very long text is scored as a whole, whatever its batch. Rows that repeat are answered
each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import remainder

BUCKETS = 1 << 18
#: Most labelled documents of each label that the model is fitted on.
MAX_ROWS = 12_000
#: Pseudo-counts that the Dirichlet prior spreads over all tokens.
PRIOR = 500.0
DRIFT = 0.25
DEVIATIONS = 5.0
SIGNIFICANT = 0.01
WORD_BYTES = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
GUMBEL_MEAN = 0.5772156649015329


def token_rows(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, bucket of each word, index of each document's first word) of a block."""
    low = common.LOWER[data]
    starts, ends, first = common.words(low, offsets, WORD_BYTES)
    rows = (common.word_hash(low, starts, ends) >> np.uint64(46)).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
    return starts, ends, rows, first


def log_odds(toxic: np.ndarray, other: np.ndarray, sizes: tuple[int, int], prior: float = PRIOR, drift: float = DRIFT, deviations: float = DEVIATIONS) -> np.ndarray:
    """Scores by bucket from the numbers of documents that have it; sizes: all toxic and all other documents."""
    both = toxic + other
    alpha = prior * (both + 0.01) / (both.sum() + 0.01 * len(both))
    found = np.log((toxic + alpha) / (sizes[0] + prior - toxic - alpha)) - np.log((other + alpha) / (sizes[1] + prior - other - alpha))
    share = sizes[0] / sum(sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        test = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(other > 0, other * np.log(other / (both * (1 - share))), 0))
    return (np.where(test >= deviations**2, found, 0) - drift).astype(np.float32)


def decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda: the positive root of sum p exp(lambda s) = 1; 1 where scores have no such root."""
    p = weights / max(1, weights.sum())
    if not (scores[weights > 0] > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    high = 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 50))).sum()) - 1
    while value(high) < 0:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def best_segments(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best segment's score in each document, 0 at least."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    out = np.zeros(len(first) - 1)
    for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        if b > a:
            part = sums[a : b + 1]
            out[k] = max(0.0, float((part[1:] - np.minimum.accumulate(part[:-1])).max()))
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    found: list[list] = []  # start, end, sum before, sum after, number of the nearest earlier one with a lesser sum before
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    above = np.flatnonzero(scores > 0)
    for i, before, after in zip(above.tolist(), sums[above].tolist(), sums[above + 1].tolist()):
        new = [i, i + 1, before, after, -1]
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= new[2]:
                at = found[at][4]
            if at < 0 or found[at][3] >= new[3]:
                new[4] = at
                found.append(new)
                break
            new = [found[at][0], new[1], found[at][2], new[3], -1]
            del found[at:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    scores: np.ndarray
    rate: float  # lambda
    location: float
    slope: float = 0.0
    base: float = -50.0

    def normalised(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self.rate * best - np.log(np.maximum(words, 1)) - self.location

    def p_value(self, z: np.ndarray) -> np.ndarray:
        """Of a best segment at least as good in a document that is not toxic."""
        return -np.expm1(-np.exp(-np.clip(z, -30, 700)))

    def joint(self, z: np.ndarray) -> tuple[float, int]:
        """Of a document's segments, best first: the best score of the r best together, as that of one segment, and r."""
        z = z[: max(1, int((z > -3).sum()))]  # more than twenty such segments are expected below
        if len(z) < 2:
            return float(z[0]), 1
        r, mean = np.arange(1, len(z) + 1), np.exp(-np.clip(z, -30, 700))
        term, total, k = np.ones(len(z)), np.ones(len(z)), 0
        while term.max() > 1e-12 * total.min():
            k += 1
            term = term * mean / (r + k)
            total += term
        tail = np.minimum(-r * z - np.cumsum(np.log(r)) - mean + np.log(total), -1e-12)  # log P(r segments or more)
        alike = np.where(tail < -30, -tail, -np.log(-np.log1p(-np.exp(np.maximum(tail, -40)))))
        alike[0] = z[0]
        alike -= (r - 1) * np.log(2)
        at = int(alike.argmax())
        return float(alike[at]), at + 1

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(z, 60) + self.base, -500, 500)))


def calibrate(model: Model, z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """Newton's method on the two coefficients of a logistic curve, with a slight ridge."""
    x = np.stack([np.minimum(z, 60), np.ones(len(z))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (weight * (p - label)) + 1e-3 * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.base = float(beta[0]), float(beta[1])


def score(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(best segment, number of words) of each document."""
    best, n = [np.zeros(0)], [np.zeros(0, np.int64)]
    for i, j in common.blocks(offsets):
        _, _, rows, first = token_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        best.append(best_segments(table[rows], first))
        n.append(np.diff(first))
    return np.concatenate(best), np.concatenate(n)


def judge(data: np.ndarray, offsets: np.ndarray, model: Model, significant: float = SIGNIFICANT):
    """Of each document: its score by all of its segments, and the byte spans and p-values of its significant passages."""
    for i, j in common.blocks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        starts, ends, rows, first = token_rows(data[offsets[i] : offsets[j]], own)
        scores = model.scores[rows]
        for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            found = sorted(segments(scores[a:b]), key=lambda x: -x[2])
            z = model.normalised(np.array([x for *_, x in found] or [0.0]), np.array(b - a))
            best, r = model.joint(z)
            p = model.p_value(z)
            n = max(int((p <= significant).sum()), r if 2 * model.p_value(np.array(best)) <= significant else 0)
            yield best, sorted((int(starts[a + s] - own[k]), int(ends[a + e - 1] - own[k]), float(q)) for (s, e, _), q in zip(found[:n], p))


def passages(text: str, model: Model, significant: float = SIGNIFICANT) -> list[tuple[int, int, float]]:
    """Byte spans and p-values of the significant toxic passages of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    return next(judge(data, np.array([0, len(data)]), model, significant))[1]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS) -> Model | None:
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learnable)
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.when(F.col("label") == 1, min(1.0, max_rows / sizes[1])).otherwise(min(1.0, max_rows / sizes[0]))
    marked = common.checkpoint(marked.where(F.col("label").isin(0, 1) & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))))
    texts = common.reduce_to(common.own_columns(docs, "doc_id", "text"), "doc_id", marked.select("doc_id"))
    sample = common.checkpoint(texts.join(marked, "doc_id"))  # about 2 * max_rows rows

    def count(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            toxic = np.asarray(batch.column("label")) == 1
            totals = np.zeros((2, BUCKETS), np.int64)
            for i, j in common.blocks(offsets):
                _, _, rows, first = token_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                once = np.unique(np.repeat(np.arange(i, j, dtype=np.int64), np.diff(first)) * BUCKETS + rows)
                mark = toxic[once // BUCKETS]
                totals[0] += np.bincount(once[~mark] % BUCKETS, minlength=BUCKETS)
                totals[1] += np.bincount(once[mark] % BUCKETS, minlength=BUCKETS)
            used = np.flatnonzero(totals.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, totals[0][used], totals[1][used])], ["bucket", "other", "toxic"])

    counted = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) > 0
    counts = sample.where(counted).mapInArrow(common.tidy(count), "bucket bigint, other bigint, toxic bigint").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow().to_pandas()  # BUCKETS rows at most
    other, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    other[counts.bucket], toxic[counts.bucket] = counts.other, counts.toxic
    of = {r.label: r.n for r in sample.where(counted).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not of.get(0) or not of.get(1):
        return None
    table = log_odds(toxic, other, (of[1], of[0]))
    model = Model(table, decay(table, other), 0.0)
    sent = spark.sparkContext.broadcast(table)

    def measure(batches):
        for batch in batches:
            best, n = score(*common.utf8(batch.column("text")), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(n, pa.int64()), batch.column("label")], ["best", "n", "label"])

    rows = sample.where(~counted).mapInArrow(common.tidy(measure), "best double, n bigint, label int").toArrow().to_pandas().sort_values(["label", "best", "n"])  # at most 2 * max_rows rows
    z, label = model.normalised(rows.best.to_numpy(), rows.n.to_numpy()), rows.label.to_numpy().astype(float)
    if not (label == 0).any() or not (label == 1).any():
        return None
    model.location = float(z[label == 0].mean()) - GUMBEL_MEAN
    whole = spark.sparkContext.broadcast(model)

    def judged(batches):
        for batch in batches:
            z = [z for z, _ in judge(*common.utf8(batch.column("text")), whole.value)]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("label")], ["z", "label"])

    rows = sample.where(~counted).mapInArrow(common.tidy(judged), "z double, label int").toArrow().to_pandas().sort_values(["label", "z"])
    z, label = rows.z.to_numpy(), rows.label.to_numpy().astype(float)
    weight = np.where(label == 1, sizes[1] / max(1, (label == 1).sum()), sizes[0] / max(1, (label == 0).sum()))
    calibrate(model, z, label, weight)
    return model


PASSAGES = "array<struct<start:int,end:int,p_value:double>>"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, p_value, passages) of every row; passages are byte spans with p-values of their own."""
    rows = common.own_columns(docs, "doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(1.0).alias("p_value"), F.expr(f"cast(array() as {PASSAGES})").alias("passages"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p_value", pa.float64())]))

    def mapped(batches):
        for batch in batches:
            found = list(judge(*common.utf8(batch.column("text")), sent.value))
            z = np.array([z for z, _ in found])
            p = np.minimum(1, 2 * sent.value.p_value(z))  # of all numbers of segments that were tested
            spans = pa.array([[dict(zip(("start", "end", "p_value"), s)) for s in spans] for _, spans in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.probability(z)), pa.array(p), spans], ["doc_id", "score", "p_value", "passages"])

    return rows.mapInArrow(common.tidy(mapped), f"doc_id bigint, score double, p_value double, passages {PASSAGES}")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 5) != 0)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "p_value", F.array_join(F.transform("passages", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("passages"))
