"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Random indexing: every word has a sparse random index vector; its word vector is the sum of the index vectors of its neighbours
(``WINDOW`` tokens to either side) over the whole corpus. Words are runs of letters and digits, and runs of signs, case kept. The ``WORDS`` most frequent
of the corpus, by counts over all texts, have vectors of their own; rarer ones share ``2**RARE_BITS`` by hash, so what is broadcast (8 MB)
and what a task holds (17 MB) have a bound for any corpus. A document's features are the mean and the standard deviation of its tokens' vectors.

The network (tanh, then logistic) learns from at most ``sample`` labelled rows, in the order of a hash of their ids; the fifth of
them that the first layer never sees calibrates a temperature for the probabilities.

Edge cases: a null or empty text has zero features and is scored like any other. A very long text is read whole, as a chunk of its own; bytes that are no
UTF-8 are parts of words. Null labels, or rows with null ids, are not learned from. Labels or rows that are repeated are learned from as often
as they stand there. Words of equal frequency, and rows with equal hashes, are taken in the order of their hashes and ids. With fewer than two classes
to learn from, every score is the share of label 1 (one half if there is none). No documents give an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import text_chunks, token_hashes
from sheetwise.runtime import cut, ship

DIMS, NONZERO, WINDOW = 32, 4, 2
#: The most frequent words of the corpus have a vector each; rarer ones share ``2**RARE_BITS`` vectors by hash.
WORDS, RARE_BITS = 60_000, 12
#: Bytes of text in a chunk; each token of it takes a vector.
TEXT = 1 << 19
#: Distinct token hashes that a task gathers before it passes their counts on.
HELD = 1 << 20


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token hash, count) over a partition; a token may come more than once."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def rows() -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, x in parts])).astype(np.int64)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for b in batches:
        for _, _, data, offsets in text_chunks(b.column(0), TEXT):
            parts.append(np.unique(token_hashes(data, offsets)[0], return_counts=True))
            total += len(parts[-1][0])
            if total >= HELD:
                yield rows()
                parts, total = [], 0
    if parts:
        yield rows()


@dataclass
class Vocabulary:
    """Rows of the word vectors: those of ``words`` (token hashes, ascending), then the shared ones."""

    words: np.ndarray

    def __len__(self) -> int:
        return len(self.words) + (1 << RARE_BITS)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each token, token offsets of the texts)."""
        h, bounds = token_hashes(data, offsets)
        if not len(self.words):
            return (h >> np.uint64(64 - RARE_BITS)).astype(np.int64), bounds
        own, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        row = np.where(self.words[at] == own, at, len(self.words) + (own >> np.uint64(64 - RARE_BITS)).astype(np.int64))
        return row[back], bounds


def learn_vocabulary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> Vocabulary:
    """The ``words`` most frequent tokens of all texts; of equally frequent ones those with the smaller hash."""
    ship(docs.sparkSession)
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "h").limit(words).select("h").toArrow()
    return Vocabulary(np.sort(np.asarray(top["h"], dtype=np.int64).view(np.uint64)))


def index_vectors(rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its index vector that are not zero, and their signs."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((rows, DIMS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1, 1]), (rows, NONZERO))


def _contexts(shared: Broadcast[Vocabulary]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of index vectors of the neighbours of each row's tokens, over a partition."""
        vocabulary = shared.value
        places, signs = index_vectors(len(vocabulary))
        total = np.zeros(len(vocabulary) * DIMS, np.int64)
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0), TEXT):
                ids, bounds = vocabulary.ids(data, offsets)
                if not len(ids):
                    continue
                # Sums over the chunk's own rows, so that their cost follows the chunk and not the vocabulary.
                own, ids = np.unique(ids, return_inverse=True)
                where, sign = places[own], signs[own]
                part = np.zeros(len(own) * DIMS)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for gap in range(1, WINDOW + 1):
                    near = doc[gap:] == doc[:-gap]
                    a, c = ids[gap:][near], ids[:-gap][near]
                    for j in range(NONZERO):
                        part += np.bincount(np.concatenate((a * DIMS + where[c, j], c * DIMS + where[a, j])), np.concatenate((sign[c, j], sign[a, j])), len(part))
                total.reshape(-1, DIMS)[own] += part.astype(np.int64).reshape(-1, DIMS)
        rows = total.reshape(-1, DIMS)
        used = np.flatnonzero(rows.any(axis=1))
        for s in range(0, len(used), 8192):
            k = used[s : s + 8192]
            yield pa.record_batch([pa.array(k), *(pa.array(rows[k, i]) for i in range(DIMS))], names=["row", *(f"d{i}" for i in range(DIMS))])

    return run


def learn_word_vectors(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> np.ndarray:
    """Unit word vectors, one for each row of the vocabulary, from every text."""
    spark = docs.sparkSession
    ship(spark)
    names = [f"d{i}" for i in range(DIMS)]
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_contexts(spark.sparkContext.broadcast(vocabulary)), "row long, " + ", ".join(f"{x} long" for x in names))
    table = parts.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    vectors = np.zeros((len(vocabulary), DIMS), np.float32)
    for i, x in enumerate(names):
        vectors[np.asarray(table["row"]), i] = np.asarray(table[x])
    known = vectors.any(axis=1, keepdims=True)
    vectors -= vectors.sum(axis=0, dtype=np.float64).astype(np.float32) / max(1, np.count_nonzero(known)) * known
    return vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def pooled(ids: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text."""
    n = np.maximum(1, np.diff(bounds))[:, None]
    out = np.zeros((len(bounds) - 1, 2 * DIMS), np.float32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        own = vectors[ids]
        out[full, :DIMS] = np.add.reduceat(own, bounds[full])
        np.square(own, out=own)
        out[full, DIMS:] = np.add.reduceat(own, bounds[full])
        out /= n
        out[:, DIMS:] = np.sqrt(np.maximum(0, out[:, DIMS:] - out[:, :DIMS] ** 2))
    return out


def document_features(docs: DataFrame, vocabulary: Vocabulary, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, features)`` of every row; the features are float32 in a binary value."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((vocabulary, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1), TEXT):
                x = pooled(*shared.value[0].ids(data, offsets), shared.value[1])
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    """Two layers on standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on four fifths of the rows; the temperature with the least log loss on the rest, of a fixed grid."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Network(mean, scale, np.zeros((x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    order = rng.permutation(len(x))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    z = (x - mean) / scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), batch):
            k = used[i : i + batch]
            a = np.tanh(z[k] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -50, 50))) - y[k]) / len(k)
            back = g[:, None] * p[2] * (1 - a * a)
            grads = [z[k].T @ back + decay * p[0], back.sum(axis=0), a.T @ g + decay * p[2], np.array([g.sum()])]
            t += 1
            for j, d in enumerate(grads):
                m[j] += 0.1 * (d - m[j])
                v[j] += 0.001 * (d * d - v[j])
                p[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, yes = net.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        return float(np.mean(np.logaddexp(0, logit / temperature) - yes * logit / temperature))

    net.temperature = min(np.geomspace(0.25, 8, 51).tolist(), key=loss)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``; ``labels`` (id, 0/1) is what may be learned from."""
    spark = docs.sparkSession
    vocabulary = learn_vocabulary(docs, text_col)
    features = cut(spark, document_features(docs, vocabulary, learn_word_vectors(docs, vocabulary, text_col), id_col, text_col))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    # Twice in the order of a hash: for the labels, then for their rows, of which one id may have many.
    turn = F.xxhash64(F.lit(5), "doc_id")
    part = marked.orderBy(turn, "doc_id", "y").limit(sample)
    rows = features.join(F.broadcast(part), "doc_id").select("y", "features", turn.alias("turn"), "doc_id").orderBy("turn", "doc_id", "y", "features").limit(sample).toArrow()
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float32).reshape(-1, 2 * DIMS).astype(np.float64)
    net = spark.sparkContext.broadcast(train(x, np.asarray(rows["y"], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, 2 * DIMS)
                yield pa.record_batch([b.column(0), pa.array(net.value.score(own).astype(np.float64))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")
