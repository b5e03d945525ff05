"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network whose probabilities
are calibrated by a temperature.

Words fall in buckets by hash. Every bucket has a fixed sparse vector of a few +1 and -1, which follows from its number;
its word vector is the sum of the sparse vectors of all its neighbours over the whole corpus: tasks add up tables of a
fixed size, and those are summed part by part. A document is the mean of its words' unit vectors, their spread, and how
alike its neighbouring words are. The network is fitted on the driver from a bounded sample of labelled documents.

Words of one bucket share a vector, so ``buckets`` bounds memory and is a parameter; README has the accuracy at several
sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_schema, keyed_text, map_batches, shuffle_width, stored
from marginalia.llm.shingles import WORDS_AND_SIGNS, mixed, word_hashes

#: Hash buckets that words fall in, unless a caller asks for others.
BUCKETS = 8192
DIMENSIONS = 48
MARKS = 2
WINDOW = 2
#: Buckets of one part of a table, which are summed together.
PART = 8
#: Labelled documents that the network is fitted on, at most: those whose doc_id has the least hash.
LABELLED_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
FEATURES = 2 * DIMENSIONS + 4


def sparse_marks(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the places of its marks, and their signs."""
    at = np.arange(buckets, dtype=np.uint64)[:, None] * np.uint64(MARKS) + np.arange(MARKS, dtype=np.uint64)
    drawn = mixed(at + np.uint64(0x5EED))
    return (drawn % np.uint64(DIMENSIONS)).astype(np.int64), np.where(drawn >> np.uint64(63), 1.0, -1.0)


def batch_words(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of some hundred rows at a time, and where each row's begin."""
    for at in range(0, len(texts), 512):
        words, bounds = word_hashes(texts.slice(at, 512), kinds=WORDS_AND_SIGNS)
        yield (words % np.uint64(buckets)).astype(np.int64), bounds


def context_table(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The word vectors, not yet of unit length: a table of a fixed size, whatever the corpus."""
    parts_of = -(-buckets // PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = sparse_marks(buckets)
        table = np.zeros(parts_of * PART * DIMENSIONS)
        for batch in batches:
            for words, bounds in batch_words(batch.column("text"), buckets):
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, WINDOW + 1):
                    near = row[step:] == row[:-step]
                    a, b = words[:-step][near], words[step:][near]
                    for one, other in ((a, b), (b, a)):
                        for m in range(MARKS):
                            table += np.bincount(one * DIMENSIONS + places[other, m], weights=signs[other, m], minlength=len(table))
        parts = table.astype(np.int32).reshape(parts_of, PART * DIMENSIONS)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
                values = np.frombuffer(zlib.decompress(sums.as_py()), dtype=np.int32).astype(np.int64)
                total[part] = total[part] + values if part in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "sums"])

    partial = texts.mapInArrow(count, "part int, sums binary")
    summed = partial.repartition(shuffle_width(texts.sparkSession), "part").mapInArrow(add, "part int, sums binary").toArrow()
    table = np.zeros((parts_of, PART * DIMENSIONS))
    for part, sums in zip(summed["part"].to_pylist(), summed["sums"].to_pylist()):
        table[part] = np.frombuffer(sums, dtype=np.int64)
    return table.reshape(-1, DIMENSIONS)[:buckets]


def unit_vectors(table: np.ndarray) -> np.ndarray:
    """Without the direction that all words share, and of length one; words never seen stay zero."""
    seen = np.abs(table).sum(axis=1) > 0
    length = np.linalg.norm(table, axis=1, keepdims=True)
    unit = np.where(seen[:, None], table / np.maximum(length, 1e-12), 0.0)
    unit = np.where(seen[:, None], unit - (unit[seen].mean(axis=0) if seen.any() else 0.0), 0.0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, the length of the mean, how alike words one and two apart are, and the
    logarithm of the number of words; zeros for no words."""
    if not len(words):
        return np.zeros(FEATURES, dtype=np.float32)
    own = vectors[words]
    mean = own.mean(axis=0)
    alike = [float((own[s:] * own[:-s]).sum(axis=1).mean()) if len(own) > s else 0.0 for s in (1, 2)]
    return np.concatenate([mean, own.std(axis=0), [np.linalg.norm(mean), *alike, np.log1p(len(words))]]).astype(np.float32)


def document_vectors(texts: DataFrame, vectors: np.ndarray) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [pooled(words[a:b], vectors).tolist() for words, bounds in batch_words(batch.column("text"), len(vectors)) for a, b in zip(bounds[:-1], bounds[1:])]
            return {"doc_id": batch.column("doc_id"), "vector": rows}

        return step

    return map_batches(texts, make, "doc_id long, vector array<float>")


class Network:
    """tanh layer, then a logistic unit; its logit is divided by a temperature fitted on rows kept from the fit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self.standard(x)
        kept = rng.random(len(x)) < 0.2
        if kept.all() or not kept.any() or len(x) < 20:
            kept[:] = False
        w1, b1 = rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN)
        w2, b2 = rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)
        self.weights = [w1, b1, w2, b2]
        self._fit(x[~kept], y[~kept], rng)
        self.temperature = self._temperature(x[kept], y[kept]) if kept.any() else 1.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _fit(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step, rate, size = 0, 3e-3, 128
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                rows = order[at : at + size]
                w1, b1, w2, b2 = self.weights
                hidden = np.tanh(x[rows] @ w1 + b1)
                error = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - y[rows]) / len(rows)
                back = np.outer(error, w2) * (1 - hidden**2)
                slopes = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
                step += 1
                for i, slope in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope**2
                    fall = rate * (1 - epoch / EPOCHS) + 1e-5
                    self.weights[i] = self.weights[i] - fall * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def _temperature(self, x: np.ndarray, y: np.ndarray) -> float:
        logit = self.logits(x)
        loss = lambda t: np.logaddexp(0, -np.where(y == 1, logit, -logit) / t).mean()
        return min(np.geomspace(0.25, 8, 60), key=loss)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)) / self.temperature, -500, 500)))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Model:
    """What scoring needs: word vectors and the network, both of a fixed size. Without any label all scores are 0.5."""

    def __init__(self, vectors: np.ndarray, network: Network | None):
        self.vectors, self.network = vectors, network

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.network.scores(x) if self.network and len(x) else np.full(len(x), 0.5)


def fitted(texts: DataFrame, labels: DataFrame, label_col: str, labelled_rows: int, buckets: int) -> tuple[Model, DataFrame]:
    """The model, and the document vectors of all texts. Of rows of one doc_id the one of the least vector is learned."""
    vectors = unit_vectors(context_table(texts.select("text"), buckets))
    known = stored(document_vectors(texts, vectors))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.join(marked, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.first("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).select("vector", "y").toArrow()
    y = sample["y"].to_numpy().astype(float)
    return Model(vectors, Network(np.array(sample["vector"].to_pylist()), y) if len(y) else None), known


def scored_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a score depends on the text alone, so equal texts score alike.

    Only labels of documents that aren't held out are learned, of at most ``labelled_rows`` of them. Null labels and
    labels without a document count for nothing; of several labels of a document the greatest holds. A null text is
    empty; empty texts are scored as the network scores a document without words. Without any label every score is 0.5.
    """
    model, known = fitted(keyed_text(docs, id_col, text_col), labels, label_col, labelled_rows, buckets)
    schema = arrow_schema("doc_id long, score double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x), pa.float64())], schema=schema)

    out = known.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold. Each task scores its own rows, so
    no text is shuffled."""
    model, _ = fitted(keyed_text(docs, id_col, text_col), labels, label_col, labelled_rows, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).fill_null("")
            x = [pooled(words[a:b], model.vectors) for words, bounds in batch_words(texts, len(model.vectors)) for a, b in zip(bounds[:-1], bounds[1:])]
            yield batch.filter(pa.array(model.scores(np.array(x, dtype=np.float64).reshape(-1, FEATURES)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
