"""Quality classifier: random-indexing word vectors, a two-layer network, a temperature.

Words are maximal runs of one character class (lower case and non-ASCII, upper case,
digits, other marks), hashed to ``WORDS`` numbers. A word's vector is the sum of sparse
random index vectors of its neighbours, over the training texts. A document is the mean
of its words' vectors with a few shares taken over the whole text. A network with one
hidden layer is trained in numpy, and its logits are divided by a temperature fitted on
training rows that were not used for its weights.

The fit uses a bounded sample: at most ``sample_rows`` labelled documents outside the
held-out fold, those of smallest id hash. Vectors and model have a fixed size, so the
broadcast is bounded; all documents are scored, whole, in one map over the table.

Defined results. Null and empty texts have no word and get the score of the zero vector.
Rows repeating an id are scored each; a document labelled more than once takes its lowest
label. A null id is never held out nor learned from. With labels of one kind only the
score is their share; with none it is 0.5. Extra columns never matter: only the text is
read for a score.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm import kernels
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, DIMENSIONS, NONZERO, REACH = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS, BATCH = 32, 40, 128
SAMPLE_ROWS, SAMPLE_PARTS = 8000, 8
CHUNK_BYTES = 1 << 20
THRESHOLD = 0.7

#: Byte -> class: 0 white space and control, 1 lower case and non-ASCII, 2 upper case, 3 digits, 4 marks.
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x7F] = 4
CLASS[0x30:0x3A] = 3
CLASS[0x41:0x5B] = 2
CLASS[0x61:0x7B] = 1
CLASS[0x80:] = 1


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Word numbers, 64-bit hashes, classes and rows of all runs."""
    kind = CLASS[data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(kind)]] = True
    bounds = np.flatnonzero(fresh)
    ends = np.r_[bounds[1:], len(kind)]
    inside = kind[bounds] > 0
    starts, ends = bounds[inside], ends[inside]
    hashes = kernels.run_hashes(data, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    return (hashes >> np.uint64(49)).astype(np.int64), hashes, kind[starts], row


def index_vectors() -> np.ndarray:
    """The sparse random vectors, the same wherever they are made."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS, DIMENSIONS), np.float32)
    at = rng.integers(0, DIMENSIONS, (WORDS, NONZERO))
    np.add.at(out, (np.arange(WORDS)[:, None], at), rng.choice([-1.0, 1.0], (WORDS, NONZERO)).astype(np.float32))
    return out


def _neighbours(batches):
    """One row per task: sums of neighbours' index vectors for every word number."""
    index, total = index_vectors(), np.zeros((WORDS, DIMENSIONS))
    for batch in batches:
        data, offsets = kernels.utf8(batch.column("text"))
        for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES):
            word, _, _, row = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            near = np.zeros((len(word), DIMENSIONS), np.float32)
            for step in range(1, REACH + 1):
                same = (row[step:] == row[:-step])[:, None]
                near[step:] += index[word[:-step]] * same
                near[:-step] += index[word[step:]] * same
            for d in range(DIMENSIONS):
                total[:, d] += np.bincount(word, near[:, d], WORDS)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["sums"])


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean word vector, log size, share of distinct word triples, class shares."""
    n = len(offsets) - 1
    word, hashes, kind, row = words_of(data, offsets)
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, DIMENSIONS + 6), np.float32)
    some = count > 0
    if some.any():
        first = np.searchsorted(row, np.flatnonzero(some))
        out[some, :DIMENSIONS] = np.add.reduceat(vectors[word], first, axis=0) / count[some, None]
        out[:, DIMENSIONS] = np.log1p(count)
        triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
        same = row[:-2] == row[2:]
        keys = np.sort((row[:-2][same].astype(np.uint64) << np.uint64(40)) | (kernels.scramble(triples[same]) >> np.uint64(24)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
        out[:, DIMENSIONS + 1] = distinct / np.maximum(count - 2, 1)
        for k in range(1, 5):
            out[:, DIMENSIONS + 1 + k] = np.bincount(row[kind == k], minlength=n) / np.maximum(count, 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """Adam on the log loss over four fifths of the rows, the temperature on the last fifth."""
    x, y, rng = x.astype(float), y.astype(float), np.random.default_rng(seed)
    n, inputs = x.shape
    share = float(y.mean()) if n else 0.5
    level = np.log((share + 1e-6) / (1 - share + 1e-6))
    model = Model(vectors, x.mean(0) if n else np.zeros(inputs), (x.std(0) if n else np.zeros(inputs)) + 1e-3, rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), level)
    if n < 20 or share in (0.0, 1.0):
        return model
    order = rng.permutation(n)
    use, check = order[n // 5 :], order[: n // 5]
    model.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (x - model.centre) / model.scale
    values = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        rng.shuffle(use)
        for at in range(0, len(use), BATCH):
            rows = use[at : at + BATCH]
            hidden = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-4 * values[0], back.sum(0), hidden.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for v, g, a, b in zip(values, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = values[0], values[1], values[2], float(values[3][0])
    logits, truth = model.logits(x[check]), y[check]
    loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))
    model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = settle(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    rows = settle(rows.repartition(SAMPLE_PARTS, "id"))
    sums = np.zeros((WORDS, DIMENSIONS), np.float32)
    for part in rows.select("text").mapInArrow(_neighbours, "sums binary").toLocalIterator():
        sums += np.frombuffer(part["sums"], "<f4").reshape(WORDS, DIMENSIONS)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def describe(batches):
        for batch in batches:
            data, offsets = kernels.utf8(batch.column("text"))
            parts = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value) for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES)]
            x = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS + 6), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    sample = sorted(rows.mapInArrow(describe, "id string, y int, x binary").collect(), key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample]).reshape(-1, DIMENSIONS + 6)
    return train(x, np.array([r["y"] for r in sample]), vectors)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    # a plain dict of arrays: executors need not have this package to read it
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def apply(batches):
        model = Model(**shared.value)
        for batch in batches:
            data, offsets = kernels.utf8(batch.column("text"))
            parts = [model.scores(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.vectors)) for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(np.concatenate([np.zeros(0), *parts]))], ["id", "held_out", "score"])

    scored = rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
