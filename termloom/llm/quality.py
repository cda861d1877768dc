"""Quality scores from random-indexing word vectors and a small network.

Every term (a hashed word, a word shape, a repeat of the word before) has a
sparse random index vector.  A word's vector is the sum of the index vectors of
the terms around its occurrences in the training rows, scaled to length one.  A
document is the mean of its words' vectors, of its shapes' index vectors and
its rate of repeats.  A two-layer numpy network reads that, and a temperature
fitted on rows kept out of the training makes its outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks
from termloom.llm._words import UNBLANK, Words, mix

#: The model is fitted on at most so many labelled rows and bytes of their texts, in the order of a hash of doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 48 << 20
WORDS, SHAPES, DIMS, NONZERO, HIDDEN = 1 << 15, 1 << 10, 24, 4, 16
SEED = 7
#: Standard deviations at which a feature is clipped, so that texts of one word do not drown the other features.
FAR = 3.0
#: Bytes of text worked on at a time.
PART = 1 << 20

# Classes of bytes that make a word's shape.
CLASS = np.full(256, 9, dtype=np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"|", b"-_/", b"'\"()[]{}:;", b"#$%&*@^~+=<>\\`")):
    CLASS[list(_chars)] = _i


def terms(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts with their bucket, the bucket of their shape, and whether they repeat the word before."""
    w = Words(texts, UNBLANK)
    h = w.hashes()
    classes = CLASS[w.data]
    new = np.empty(len(classes), dtype=bool)
    new[0] = True
    np.not_equal(classes[1:], classes[:-1], out=new[1:])
    new[w.starts] = True
    # runs of a class count once: place in the word is the number of runs before
    run = np.cumsum(new, dtype=np.int64)
    place = np.minimum(run - np.repeat(np.concatenate([[0], run[w.starts]]), np.diff(np.concatenate([[0], w.starts, [len(run)]]))), 15).astype(np.uint64)
    value = np.where(new, (classes.astype(np.uint64) + np.uint64(1)) << (place * np.uint64(4)), np.uint64(0))
    sums = np.cumsum(value, dtype=np.uint64)
    shape = mix(sums[w.ends - 1] - sums[w.starts - 1])
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    again[w.first[:-1][w.first[:-1] < len(h)]] = False
    return w, (h & np.uint64(WORDS - 1)).astype(np.int64), (shape & np.uint64(SHAPES - 1)).astype(np.int64), again


def index_vectors() -> np.ndarray:
    """Sparse random vectors of the words, then of the shapes, then of a repeat."""
    rng = np.random.default_rng(SEED)
    n = WORDS + SHAPES + 1
    out = np.zeros((n, DIMS), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIMS, n)] += rng.choice(np.array([-1, 1], dtype=np.float32), n)
    return out


def pool(texts: list[bytes], vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row of features for each text; zeros for a text without words."""
    w, word, shape, again = terms(texts)
    n = np.diff(w.first)
    out = np.zeros((len(texts), 2 * DIMS + 2), dtype=np.float64)
    some = np.flatnonzero(n)
    if len(some):
        at = w.first[:-1][some]
        per = n[some, None]
        out[some, :DIMS] = np.add.reduceat(vectors[word], at, axis=0) / per
        out[some, DIMS : 2 * DIMS] = np.add.reduceat(index[WORDS:][shape], at, axis=0) / per
        out[some, -2] = np.add.reduceat(again.astype(np.float32), at) / n[some]
    out[:, -1] = np.log1p(n) / 10
    return out


def word_vectors(texts: list[bytes], index: np.ndarray, window: int = 2) -> np.ndarray:
    """Sums of the index vectors of the terms within ``window`` words, scaled to length one; zero for words not met."""
    out = np.zeros((WORDS, DIMS), dtype=np.float64)
    for start in range(0, len(texts), 200):
        w, word, shape, again = terms(texts[start : start + 200])
        text = w.of_text()
        own = index[word] + index[WORDS:][shape] + again[:, None] * index[-1]
        around = index[WORDS:][shape] + again[:, None] * index[-1]
        for d in range(1, window + 1):
            same = (text[d:] == text[:-d])[:, None]
            around[d:] += own[:-d] * same
            around[:-d] += own[d:] * same
        for k in range(DIMS):
            out[:, k] += np.bincount(word, around[:, k], WORDS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class QualityModel:
    """What a worker needs to score texts; its size is fixed by the constants above."""

    vectors: np.ndarray
    index: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = np.clip((features - self.mean) / self.scale, -FAR, FAR)
        # sums of products in a fixed order, whatever the number of rows
        hidden = np.tanh(np.einsum("ij,jk->ik", x, w1) + b1)
        return np.einsum("ij,j->i", hidden, w2) + b2[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pool(texts, self.vectors, self.index)) / self.temperature, -500, 500)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 1500) -> QualityModel:
    """Fit on rows in a given order: of every five, two make the word vectors, two the network, one the temperature.

    The network must not learn on the texts that made the vectors, or it would
    rely on vectors of words that no other text has. Without network rows of
    both labels the model is sure of nothing.
    """
    index = index_vectors()
    role = np.arange(len(texts)) % 5
    held = role == 4
    vectors = word_vectors([t for t, r in zip(texts, role) if r < 2], index)
    width = 2 * DIMS + 2
    x = np.concatenate([pool(texts[i : i + 200], vectors, index) for i in range(0, len(texts), 200)]) if texts else np.zeros((0, width))
    y = np.asarray(labels, dtype=np.float64)
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = QualityModel(vectors, index, np.zeros(width), np.ones(width), layers, 1.0)
    own = (role == 2) | (role == 3)
    xt, yt = x[own], y[own]
    if len(set(yt.tolist())) < 2:
        model.layers = [np.zeros_like(p) for p in layers]
        return model
    model.mean, model.scale = xt.mean(0), xt.std(0) + 1e-3
    z = np.clip((xt - model.mean) / model.scale, -FAR, FAR)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = layers
        hidden = np.tanh(z @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60)))
        d = (p - yt) / len(yt)
        dh = np.outer(d, w2) * (1 - hidden**2)
        grads = [z.T @ dh + 3e-4 * w1, dh.sum(0), hidden.T @ d + 3e-4 * w2, np.array([d.sum()])]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            moments[i] = (m, v)
            layers[i] = layers[i] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    raw, yh = model.logits(x[held]), y[held]
    if len(yh):
        grid = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
        loss = [np.mean(np.logaddexp(0, -np.where(yh > 0, raw, -raw) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text is a multiple of 5; labels of these are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``rows`` training rows and ``most_bytes``, in hash order; null texts are empty.

    The rows are chosen by their keys and lengths; only the chosen texts are
    fetched. Texts longer than ``most_bytes`` are not chosen; rows with one
    doc_id and text are one; of several labels of a doc_id the least counts.
    """
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id")]
    marks = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = F.broadcast(marks.orderBy(*order).limit(rows))  # at most `rows` rows of two numbers
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.octet_length(text).alias("bytes"), text.alias("text"))
    keys = keyed.drop("text").filter(F.col("bytes") <= most_bytes).join(some, "doc_id").distinct()
    chosen, size = [], 0
    for row in keys.orderBy(*order, "h").limit(rows).toLocalIterator():
        size += row.bytes
        if size > most_bytes:
            break
        chosen.append(row)
    if not chosen:
        return [], np.array([])
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.h) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long")
    found = keyed.select("doc_id", "h", "text").join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    texts = {(r.doc_id, r.h): bytes(r.text) for r in found.toLocalIterator()}
    return [texts[r.doc_id, r.h] for r in chosen], np.array([int(r.quality > 0) for r in chosen])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced.

    Only the text is looked at, the whole of it. Null text is empty; an empty
    text gets a score like any other; a score equal to the threshold is predicted 1;
    repeated rows stay repeated; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, batch_text, PART):
            score = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    batch_text = names[at]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "score double", "predicted int"])
    return docs.mapInArrow(run, schema)
