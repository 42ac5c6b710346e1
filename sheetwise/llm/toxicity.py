"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's subwords are the character n-grams of its distinct words (``SIZES`` bytes, with a mark before and after each word),
hashed to ``2**BITS`` buckets. ``PAD`` empty subwords stand beside them, so that a very short text is not judged by a few. Each bucket has an embedding; the mean over a text's subwords goes into a softmax over two classes.
Embeddings and softmax are trained together, so a misspelling that was never seen shares the vectors of the n-grams it has left.
In the mean a bucket counts by its rarity among the training texts, and not at all if fewer than ``LEAST`` of them have it. All embeddings share one
step size: with a step of its own for each bucket, as in plain Adam, buckets of one or two texts learn those texts by heart.

A text is judged by its windows of ``WORDS`` words, all of them: the largest score counts, so that a few toxic lines of a long text are not averaged away. Training sees each text twice, whole and
as the window that a first model scores highest. How far scores must be moved for 0.7 to part the classes best (a false alarm weighs as ``ALARM`` misses) is read from the learning rows alone: two models,
each trained on one half of them, score the other half.

Training takes at most ``sample`` labelled rows of each class and a stated number of bytes of their bags, in the order of a hash. As everything after the mean
is linear, scoring needs one number for each bucket: its embedding times the difference of the two softmax rows.

Edge cases: a null or empty text has no subwords and gets the bias's score. A very long text is scored whole, as a chunk of its own; bytes that are no UTF-8
are parts of words. Null labels and null ids are not learned from. Labels that are repeated count once; an id with both labels is learned from as both, and
rows that share a labelled id are all learned from. Where hashes tie, the smaller bag comes first. With one class or none to learn from (or empty tables), every
score is 0 (or 1, if all are toxic); no rows to score give an empty table. Repeated rows have the same score. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import mix, sums, text_chunks, token_hashes
from sheetwise.runtime import scratch, ship

BITS, SIZES, DIMS, PAD, LEAST = 17, (3, 4, 5, 6), 4, 3000, 8
#: Means are over thousands of subwords; this factor brings them near 1.
SCALE = 100.0
#: Words of a window; the score that parts the classes; misses that weigh as much as one false alarm.
WORDS, PARTS_AT, ALARM = 200, 0.7, 10
#: Bytes as parts of words in lower case, all else as a space; and which bytes are parts of words.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
WORD = (np.arange(256) != 0x20).astype(np.uint8)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of each text's distinct words, a space before and after each word, and the texts' offsets."""
    folded = FOLD[data]
    word = folded != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    # Words that end where the next text begins are two.
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[word[inner] & word[inner - 1]]
    edge = np.sort(np.concatenate((edge, inner, inner)))
    starts, ends = edge[::2], edge[1::2]
    h, _ = token_hashes(folded, offsets, WORD)
    doc = np.searchsorted(offsets, starts, "right") - 1
    _, first = np.unique(mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    first.sort()
    starts, sizes, doc = starts[first], ends[first] - starts[first], doc[first]
    at = np.cumsum(sizes + 1) - sizes
    text = np.full(int(at[-1] + sizes[-1]) + 1 if len(at) else 1, 0x20, np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(at, sizes) + step] = folded[np.repeat(starts, sizes) + step]
    bounds = np.concatenate((at - 1, [len(text) - 1]))[np.searchsorted(doc, np.arange(len(offsets)))]
    return text, bounds


def windows(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all texts' windows of so many words, and the place of each text's first window; a text without words is one window."""
    n = len(offsets) - 1
    word = WORD[FOLD[data]].astype(bool)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1]
    inner = inner[inner < len(data)]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    text = np.searchsorted(offsets, start, "right") - 1
    place = np.arange(len(start)) - np.searchsorted(start, offsets)[text]
    cut = (place % words == 0) & (place > 0)
    own, at = np.concatenate((np.arange(n), text[cut])), np.concatenate((offsets[:-1], start[cut]))
    order = np.lexsort((at, own))
    return np.concatenate((at[order], offsets[-1:])), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(number of subwords of each text, for each size the buckets and their offsets by text)."""
    n = len(offsets) - 1
    text, bounds = distinct_words(data, offsets)
    space = text == 0x20
    h = text.astype(np.uint32)
    inner = np.ones(len(text), bool)
    out, count = [], np.zeros(n, np.int64)
    for size in range(2, max(SIZES) + 1):
        m = len(text) - size + 1
        if m <= 0:
            out += [(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))] * (size in SIZES)
            continue
        h = h[:m] * np.uint32(0x01000193) + text[size - 1 :].astype(np.uint32)
        if size > 2:
            inner = inner[:m] & ~space[size - 2 : size - 2 + m]
        if size in SIZES:
            at = np.flatnonzero(inner[:m])
            b = ((h[at] ^ np.uint32(size * 0x27D4EB2F)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            where = np.searchsorted(at, bounds)
            count += np.diff(where)
            out.append((b.astype(np.int64), where))
    return count + PAD, out


@dataclass
class Model:
    """``weight[bucket]`` adds to the logit of toxic, times SCALE over the number of subwords."""

    weight: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        count, parts = subwords(data, offsets)
        total = np.zeros(len(count))
        for b, where in parts:
            total += sums(self.weight[b], where, np.float64)
        return self.bias + SCALE * total / count

    def highest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest logit of each text's windows."""
        if len(offsets) < 2:
            return np.zeros(0)
        fine, at = windows(data, offsets)
        return np.maximum.reduceat(self.logits(data, fine), at[:-1])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.highest(data, offsets), -50, 50)))


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """For each text its distinct buckets (int32) and their shares of all subwords (float32)."""
    count, parts = subwords(data, offsets)
    for i, n in enumerate(count):
        own, times = np.unique(np.concatenate([b[w[i] : w[i + 1]] for b, w in parts]), return_counts=True)
        yield own.astype(np.int32).tobytes(), (times / n).astype(np.float32).tobytes()


def window_bags(model: Model, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """:func:`bags` of the window of each text that a model scores highest, the first of equals."""
    fine, at = windows(data, offsets)
    logit = model.logits(data, fine)
    best = {a + int(logit[a:b].argmax()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())}
    for i, bag in enumerate(bags(data, fine)):
        if i in best:
            yield bag


def parting(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit from which on texts are called toxic with the least cost; the middle of the best gap."""
    order = np.argsort(logit)
    z, toxic = logit[order], y[order] == 1
    # Calling the first i texts clean misses the toxic ones among them, and alarms at the clean ones after.
    cost = np.concatenate(([0], np.cumsum(toxic))) + ALARM * (np.sum(~toxic) - np.concatenate(([0], np.cumsum(~toxic))))
    best = np.flatnonzero(cost == cost.min())
    low, high = int(best[0]), int(best[-1])
    edges = np.concatenate((z[:1] - 1, z, z[-1:] + 1))
    return float((edges[low] + edges[high + 1]) / 2)


def rarity(index: list[np.ndarray]) -> np.ndarray:
    """Weight of each bucket, 0 to 1: the log of its inverse share of the texts, over the log of their number."""
    seen = np.zeros(1 << BITS, np.int64)
    for i in index:
        seen[i] += 1
    n = np.log(len(index) + 1)
    return np.where(seen >= LEAST, 1 - np.log(seen + 1) / n, 0).astype(np.float32)


def train(index: list[np.ndarray], share: list[np.ndarray], y: np.ndarray, epochs: int = 20, batch: int = 128, rate: float = 0.3, seed: int = 5) -> Model:
    """Momentum on mini-batches, over embeddings and softmax together; a matrix's steps are divided by its largest recent gradient."""
    size = 1 << BITS
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size, np.float32), 50.0 if len(y) and y[0] else -50.0)
    rng = np.random.default_rng(seed)
    rare = rarity(index) * np.float32(SCALE)
    e = rng.normal(0, 0.001, (size, DIMS)).astype(np.float32)
    u, bias = rng.normal(0, 0.3, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum()))).astype(np.float32)
    p = [e, u, bias]
    m, v, t = [np.zeros_like(a) for a in p], [0.0 for _ in p], 0
    order = np.arange(len(y))
    steps = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        rng.shuffle(order)
        for s in range(0, len(order), batch):
            k = order[s : s + batch]
            ids = np.concatenate([index[i] for i in k])
            val = np.concatenate([share[i] for i in k]) * rare[ids]
            n = np.array([len(index[i]) for i in k])
            row = np.repeat(np.arange(len(k)), n)
            mean = np.stack([np.bincount(row, val * e[ids, d], len(k)) for d in range(DIMS)], axis=1).astype(np.float32)
            z = mean @ u + bias
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(k)), y[k]] -= 1
            q *= weight[k, None] / len(k)
            back = q @ u.T
            ge = np.stack([np.bincount(ids, val * back[row, d], size) for d in range(DIMS)], axis=1).astype(np.float32)
            t += 1
            lr = rate * (1 - (t - 1) / steps)
            for j, g in enumerate((ge, mean.T @ q, q.sum(axis=0))):
                m[j] += np.float32(0.1) * (g - m[j])
                v[j] += 0.01 * (float(np.max(g * g)) - v[j])
                p[j] -= (m[j] * (lr / (1 - 0.9**t) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-6))).astype(np.float32)
    return Model((e @ (u[:, 1] - u[:, 0]) * rare / np.float32(SCALE)).astype(np.float32), float(bias[1] - bias[0]))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2500, max_bytes: int = 64 << 20
) -> Model:
    """Train on at most ``sample`` rows of each class of ``labels`` (id, 0/1) and at most ``max_bytes`` of their bags, and as many of their windows' bags.

    Rows are taken in the order of a hash of id and text, so that each run takes the same ones.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    turn = F.xxhash64(F.lit(9), "doc_id")
    ids = [marked.where(F.col("y") == y).orderBy(turn, "doc_id").limit(sample) for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    # At most 2 * sample ids are broadcast. An id that many rows have gives many texts: these are bounded again, by rows of a class and by bytes.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("y", F.xxhash64(F.lit(9), "doc_id", "text").alias("turn"), "text")
    with scratch(spark) as cut:
        rows = cut(_with_bags(texts, bags))
        first = [rows.where(F.col("y") == y).select("y", "turn", "size").orderBy("turn", "size").limit(sample) for y in (0, 1)]
        # 2 * sample rows of three numbers, classes taken in turn.
        order = Window.orderBy("place", "y")
        ranked = first[0].unionByName(first[1]).withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("turn", "size")))
        fit = ranked.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= max_bytes)
        last = {r.y: (r.n, r.turn) for r in fit.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("turn")).collect()}
        taken = [rows.where((F.col("y") == y) & (F.col("turn") <= turn)).orderBy("turn", "size").limit(n) for y, (n, turn) in sorted(last.items())]
        if not taken:
            return train([], [], np.zeros(0, np.int64))
        held = cut(taken[0].unionByName(taken[1]) if len(taken) > 1 else taken[0])
        whole = _Learned(held.toArrow(), max_bytes)
        if len(np.unique(whole.y)) < 2:
            return whole.train()
        near = _Learned(_with_bags(held.select("y", "turn", "text"), window_bags, spark.sparkContext.broadcast(whole.train(epochs=10))).toArrow(), max_bytes)
        halves = [_Learned.both(whole.half(k), near.half(k)) for k in (0, 1)]
        found = []
        for k in (0, 1):
            if len(np.unique(halves[1 - k].y)) == 2:
                found.append(_highest(held.where(F.col("turn").bitwiseAND(1) == k).select("y", "text"), spark.sparkContext.broadcast(halves[1 - k].train(epochs=10))))
    model = _Learned.both(whole, near).train()
    table = pa.concat_tables(found) if found else None
    if table is None or len(table["y"].unique()) < 2:
        return model
    at = parting(np.asarray(table["logit"]), np.asarray(table["y"]))
    return Model(model.weight, model.bias - at + float(np.log(PARTS_AT / (1 - PARTS_AT))))


class _Learned:
    """Labelled bags as views of Arrow buffers, in the order of their hash."""

    def __init__(self, table: pa.Table, max_bytes: int):
        table = table.select(["y", "turn", "size", "ids", "shares"]).sort_by([("turn", "ascending"), ("y", "ascending"), ("size", "ascending")])
        fits = int(np.searchsorted(np.cumsum(np.asarray(table["size"])), max_bytes, "right"))
        table = table.slice(0, fits)
        view = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
        self.y, self.turn, self.index, self.share = np.asarray(table["y"], dtype=np.int64), np.asarray(table["turn"], dtype=np.int64), view("ids", np.int32), view("shares", np.float32)

    @classmethod
    def of(cls, y: np.ndarray, turn: np.ndarray, index: list, share: list) -> _Learned:
        made = cls.__new__(cls)
        made.y, made.turn, made.index, made.share = y, turn, index, share
        return made

    @classmethod
    def both(cls, a: _Learned, b: _Learned) -> _Learned:
        return cls.of(np.concatenate((a.y, b.y)), np.concatenate((a.turn, b.turn)), a.index + b.index, a.share + b.share)

    def half(self, k: int) -> _Learned:
        """Rows whose hash is even or odd; equal texts of one id are in the same half."""
        own = np.flatnonzero((self.turn & 1) == k)
        return self.of(self.y[own], self.turn[own], [self.index[i] for i in own], [self.share[i] for i in own])

    def train(self, epochs: int = 20) -> Model:
        return train(self.index, self.share, self.y, epochs)


def _with_bags(texts: DataFrame, how, model=None) -> DataFrame:
    """Rows ``y, turn, text`` with their bags (of whole texts, or of what a broadcast model finds in them) and the bags' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple[bytes, bytes]] = []
            for _, _, data, offsets in text_chunks(b.column(2)):
                made += how(data, offsets) if model is None else how(model.value, data, offsets)
            parts = [pa.array([len(x) + len(z) for x, z in made], pa.int64()), pa.array([x for x, _ in made], pa.binary()), pa.array([z for _, z in made], pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *parts], names=["y", "turn", "text", "size", "ids", "shares"])

    return texts.mapInArrow(run, "y int, turn long, text string, size long, ids binary, shares binary")


def _highest(texts: DataFrame, model) -> pa.Table:
    """(y, largest logit) of labelled rows that a broadcast model has not learned from; as many as were learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1)):
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(model.value.highest(data, offsets))], names=["y", "logit"])

    return texts.mapInArrow(run, "y int, logit double").toArrow()


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1)):
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(shared.value.score(data, offsets))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
