"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes of lower-cased letters,
single spaces between words), each hashed to one of ``BUCKETS`` rows; a linear layer and a softmax
follow. Embeddings and layer are trained by stochastic gradient descent in numpy, on at most
``max_rows`` labelled documents, dealt evenly over the languages (at least one of each) and chosen by a hash of their id,
of each its ``MAX_GRAMS`` most frequent n-grams; every language is learned.
A fifth of these is held back from the descent: they set the softmax's temperature, and, with
copies of themselves whose letters are shuffled and so of no language, the
score below which a prediction is rejected (the least at which ``precision`` of the accepted
are right, and never one that rejects more than ``max_rejected`` of the right ones; as these are few rows, at
``MARGIN`` of their log-odds).

As average and layer are linear, a trained model is one table of scores, an n-gram row and a
language column, so a text of any length costs a few table look-ups a byte and no embeddings.

Texts that are null or have no letters are ``und`` with score 0, and so is all where no row can be
learned from. Of languages with equal scores the first by name is predicted. A very long text is scored in its
Arrow batch, in one pass. Rows that repeat are answered each; an empty table gives no rows. Other columns,
whatever their names, are ignored (``keep_known`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
#: Most labelled documents that the model is fitted on.
MAX_ROWS = 2000
#: Most different n-grams of one of them.
MAX_GRAMS = 1024
PRECISION, MAX_REJECTED, MARGIN = 0.99, 0.001, 0.75
UNKNOWN = "und"

#: What each byte counts as: letters lower-cased, bytes from 0x80 as they are, the rest a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_ASCII = common.byte_class([*range(65, 91), *range(97, 123)])


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of each document, with new offsets."""
    low = _LETTER[data]
    keep = low != 32
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    after = np.zeros(len(low), bool)
    after[1:] = keep[:-1]
    after[edge] = False
    keep |= after
    count = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return low[keep], count[offsets]


def grams(low: np.ndarray, offsets: np.ndarray):
    """For each n-gram size, the bucket of the n-gram at each byte, BUCKETS where it would leave its document."""
    wide = np.zeros(len(low) + 4, np.uint32)
    wide[: len(low)] = low
    value = wide[: len(low)].copy()
    for n in range(2, max(SIZES) + 1):
        value |= wide[n - 1 : n - 1 + len(low)] << np.uint32(8 * (n - 1))
        if n in SIZES:
            out = ((value * np.uint32(0x9E3779B1) ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n) >> np.uint32(16)).astype(np.int32)
            for k in range(1, n):
                at = offsets[1:] - k
                out[at[at >= offsets[:-1]]] = BUCKETS
            yield out


def counted(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one document and their shares of its n-grams."""
    ends = np.array([0, len(low)])
    found, n = np.unique(np.concatenate([*grams(low, ends)]) if len(low) else np.zeros(0, np.int32), return_counts=True)
    inside = found < BUCKETS
    found, n = found[inside], n[inside]
    if len(found) > MAX_GRAMS:
        most = np.sort(np.argsort(-n, kind="stable")[:MAX_GRAMS])
        found, n = found[most], n[most]
    return found.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def shuffled(low: np.ndarray, seed: int = 13) -> np.ndarray:
    """A text's letters in another order, its spaces where they were: no language, but the letters of one."""
    out = low.copy()
    letters = out != 32
    out[letters] = np.random.default_rng(seed).permutation(out[letters])
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row for each bucket and a last one of zeros, a column for each language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each document, a column for each language; NaN without n-grams."""
        low, ends = squeeze(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(ends[1:] > ends[:-1])
        total = np.zeros(len(offsets) - 1)
        size = ends[1:] - ends[:-1]
        for n, found in zip(SIZES, grams(low, ends)):
            total += np.maximum(0, size - n + 1)
            for k in range(len(self.languages)):
                if len(full):
                    out[full, k] += np.add.reduceat(self.scores[k][found], ends[:-1][full])
        with np.errstate(invalid="ignore", divide="ignore"):
            return out / total[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i, j in common.blocks(offsets):
            part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ascii_sum = np.concatenate([[0], np.cumsum(_ASCII[part])])[ends]
            p = softmax(np.nan_to_num(self.logits(part, ends)) / self.temperature)
            best = p.argmax(1)
            for k in range(j - i):
                lettered = ascii_sum[k + 1] > ascii_sum[k] or any(map(str.isalpha, part[ends[k] : ends[k + 1]].tobytes().decode(errors="ignore")))
                names.append(self.languages[best[k]] if lettered else UNKNOWN)
                scores.append(float(p[k, best[k]]) if lettered else 0.0)
        return names, np.array(scores)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, rate: float = 4.0, batch: int = 16, seed: int = 7, precision: float = PRECISION, max_rejected: float = MAX_REJECTED, foreign: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
    """texts: buckets and shares of each document, as ``counted`` gives them; foreign: those of a text of no language for each."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    table = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def mean(rows, texts=texts):
        at = np.concatenate([texts[r][0] for r in rows])
        share = np.concatenate([texts[r][1] for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(texts[r][0]) for r in rows])
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        if len(at):
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[heads]] = np.add.reduceat(table[at] * share[:, None], heads)
        return out, at, share, of

    steps = epochs * max(1, -(-len(fit) // batch))
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(fit)
        for k in range(0, len(shuffled), batch):
            rows = shuffled[k : k + batch]
            x, at, share, of = mean(rows)
            now = rate * (1 - step / steps)
            g = softmax(x @ layer + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = (g @ layer.T)[of] * (share * now)[:, None]
            layer -= now / len(rows) * (x.T @ g)
            bias -= now / len(rows) * 0.1 * g.sum(0)
            np.subtract.at(table, at, back)
            step += 1
    table[BUCKETS] = 0
    model = Model(languages, np.ascontiguousarray((table @ layer).T.astype(np.float32)), bias.astype(np.float64))
    logits = lambda texts: np.concatenate([mean(held[k : k + 64], texts)[0] @ layer + bias for k in range(0, len(held), 64)]).astype(np.float64)
    raw = logits(texts) if len(held) else np.zeros((0, len(languages)))
    if len(held):
        loss = lambda t: -np.mean(np.log(softmax(raw / t)[np.arange(len(held)), y[held]] + 1e-12))
        model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
        p = softmax(raw / model.temperature)
        score, right = p.max(1), p.argmax(1) == y[held]
        all_scores, all_right = score, right
        if foreign:
            all_scores = np.concatenate([score, softmax(logits(foreign) / model.temperature).max(1)])
            all_right = np.concatenate([right, np.zeros(len(held), bool)])
        best = np.argsort(-all_scores)
        exact = np.cumsum(all_right[best]) / np.arange(1, len(best) + 1)
        good = np.flatnonzero(exact >= precision)
        wanted = all_scores[best[good[-1]]] if len(good) else 1.0
        wanted = 0.0 if len(good) and good[-1] == len(best) - 1 else wanted
        least = min(np.quantile(score[right], max_rejected), 1 - 1e-12) if right.any() else 0.0
        model.threshold = float(min(wanted, 1 / (1 + (1 / least - 1) ** MARGIN) if least else 0.0))
    return model


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(docs: DataFrame, learnable: Column, max_rows: int = MAX_ROWS) -> Model | None:
    """A model of the learnable rows with a language; None where there are none."""
    rows = common.own_columns(docs, "doc_id", "text", "lang").where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, max_rows // len(sizes))
    share = F.coalesce(*(F.when(F.col("lang") == k, min(1.0, each / n)) for k, n in sizes.items()), F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def mapped(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            low, ends = squeeze(data, offsets)
            found = [(*counted(low[a:b]), *counted(shuffled(low[a:b]))) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(4))], ["lang", "at", "share", "other_at", "other_share"])

    # About max_rows rows, each of twice MAX_GRAMS n-grams at most.
    got = sorted((r.lang, *map(bytes, r[1:])) for r in chosen.mapInArrow(common.tidy(mapped), "lang string, at binary, share binary, other_at binary, other_share binary").toLocalIterator())
    got = [(k, *(np.frombuffer(x, (np.int32, np.float32)[i % 2]) for i, x in enumerate(rest))) for k, *rest in got if rest[0]]
    model = train([(a, b) for _, a, b, *_ in got], [k for k, *_ in got], foreign=[(a, b) for *_, a, b in got]) if got else None
    got.clear()
    common.trim()  # the driver goes on
    return model


def predict(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    rows = common.own_columns(docs, "doc_id", column)
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a column a language

    def mapped(batches):
        for batch in batches:
            names, scores = sent.value.predict(*common.utf8(batch.column(column)))
            gone = [k == UNKNOWN or s < sent.value.threshold for k, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(common.tidy(mapped), "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with all their columns, without the documents that the model rejects."""
    if model is None:
        return docs.limit(0)
    where = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def mapped(batches):
        for batch in batches:
            names, scores = sent.value.predict(*common.utf8(batch.column(where)))
            yield batch.filter(pa.array([k != UNKNOWN and s >= sent.value.threshold for k, s in zip(names, scores)], pa.bool_()))

    own = common.plain(docs)
    return own.mapInArrow(common.tidy(mapped), own.schema).toDF(*docs.columns)


def learned(docs: DataFrame) -> Model | None:
    """The model of op4: learned from rows whose remainder modulo 4 is not 2."""
    return fit(docs, remainder(F.col("doc_id"), 4) != 2)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learned(docs)).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
