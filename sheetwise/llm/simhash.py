"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced within blocks.

Fingerprints that differ in at most ``RADIUS`` bits are linked. Two such fingerprints agree in at least two of four
16-bit quarters, so each fingerprint is dealt to six tables by pairs of quarters, and only equal keys meet. A key with
more than ``large`` fingerprints is dealt again by quarters of its remaining 32 bits; what then meets agrees in 48
bits, so no group exceeds 65,536 fingerprints, whatever the input. Equal fingerprints are one row before all this.

Within a group, fingerprints are stored as vertical bit planes, 64 to a word. A query is compared with 64 fingerprints at
once: the planes that differ are added into carry-save counters, and the word is abandoned as soon as each of its lanes has passed
the radius, is the query itself or has been a query before. A group emits one link for each member to the smallest member it reaches, never all pairs.

Edge cases: a null text, like one without words, has fingerprint zero and is linked like any other. A text with fewer words
than a shingle has the whole sequence as its one shingle. Rows with a null id are linked too, but never name a component;
a component of null ids only has a null id. A very long text is fingerprinted whole, as a chunk of its own. A bit that is set in just half the
hashes is 0; nothing else can tie. Bytes that are no UTF-8 are hashed as they are. Repeated rows have the same result each. An empty table gives an
empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import text_chunks, whole_groups
from sheetwise.llm.components import connected_components
from sheetwise.runtime import cut, ship

RADIUS = 2
#: Fingerprints that are turned into bit planes at once.
BLOCK = 4096
#: Comparisons of a fingerprint with a word of 64 that are carried out at once.
PAIRS = 1 << 14
#: Planes after which words without a lane left are looked for.
CHECK = 4
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(words: list[bytes], k: int, seed: int) -> int:
    """Bit i is 1 if it is set in over half the hashes of the k-word shingles."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if x else "0" for x in counts * 2 > len(h)), 2)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, data, offsets in text_chunks(b.column(1)):
                raw, ends = data.tobytes().lower(), offsets.tolist()
                out += [fingerprint(raw[s:e].split(), k, seed) for s, e in zip(ends, ends[1:])]
            yield pa.record_batch([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of 64-bit words): one for each bit, each packed 64 fingerprints to a word; the lanes past the last are zero."""
    n, bits = len(fps), 64 * fps.shape[1]
    out = np.zeros((bits, -(-n // 64)), np.uint64)
    for s in range(0, n, BLOCK):
        part = np.unpackbits(fps[s : s + BLOCK].astype(">u8").view(np.uint8), axis=1)
        wide = np.zeros((bits, -(-len(part) // 64) * 64), np.uint8)
        wide[:, : len(part)] = part.T
        out[:, s // 64 : s // 64 + wide.shape[1] // 64] = np.packbits(wide, axis=1, bitorder="little").view("<u8")
    return out


def below(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest lanes are set, for n from 0 to 64."""
    return np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def near_pairs(fps: np.ndarray, last: np.ndarray, radius: int, order: list[int] | None = None, counted: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i < j and distance of the fingerprints (rows of words) at most ``radius`` bits apart within a group, some pairs at a time.

    Groups lie one after the other; ``last`` is the place past the end of each row's group. ``order`` names the planes to read (by default all), ``counted`` gets
    the number of words that were abandoned added.

    A fingerprint is compared with 64 at once: the planes in which they differ are added into carry-save counters, one bit of the count to a word. As soon as
    every lane of a word has passed the radius or is not asked for, the word is abandoned.
    """
    n = len(fps)
    plane = planes(fps)
    own = np.arange(n)
    first_word, words = own // 64, (last - 1) // 64 - own // 64 + 1
    upto = np.cumsum(words)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        many = words[start:stop]
        query = np.repeat(own[start:stop], many)
        word = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + first_word[query]
        # Not asked for: lanes up to the query's own, and those of other groups.
        skip = below(np.clip(query + 1 - word * 64, 0, 64)) | ~below(np.clip(last[query] - word * 64, 0, 64))
        yield from _within(plane, fps, query, word, skip, radius, order or list(range(len(plane))), counted)
        start = stop


def _within(
    plane: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, over: np.ndarray, radius: int, order: list[int], counted: list[int] | None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    counters = [np.zeros(len(over), np.uint64) for _ in range(radius.bit_length())]
    for step, i in enumerate(order):
        if step % CHECK == 0:
            left = over != FULL
            if not left.all():
                if counted is not None and step:
                    counted.append(int(len(left) - left.sum()))
                query, word, over, counters = query[left], word[left], over[left], [c[left] for c in counters]
            if not len(over):
                return
        carry = plane[i][word] ^ (np.uint64(0) - (fps[query, i // 64] >> np.uint64(63 - i % 64) & np.uint64(1)))
        for j, c in enumerate(counters):
            counters[j], carry = c ^ carry, c & carry
        over = over | carry | _above(counters, radius)
    at, bit = np.nonzero(np.unpackbits((~over)[:, None].view(np.uint8), axis=1, bitorder="little"))
    if len(at):
        lane = bit.astype(np.uint64)
        distance = sum((((c[at] >> lane) & np.uint64(1)).astype(np.int64) << j for j, c in enumerate(counters)), np.zeros(len(at), np.int64))
        yield query[at], word[at] * 64 + bit, distance


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius, from the highest bit of the counts down."""
    over, equal = np.uint64(0), FULL
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal = equal & counters[j]
        else:
            over = over | (equal & counters[j])
            equal = equal & ~counters[j]
    return over


def group_links(fps: np.ndarray, last: np.ndarray, agreed: int, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, smallest it reaches) that connect what is within ``RADIUS`` in groups of distinct 64-bit fingerprints.

    ``agreed`` has a 1 for each bit in which each group agrees; those planes are not read.
    """
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    order = [i for i in range(64) if not agreed >> (63 - i) & 1]
    for one, two, _ in near_pairs(fps[:, None], last, RADIUS, order, counted):
        while len(one):
            # Most pairs are known to be connected once their roots are looked up.
            while (root[root] != root).any():
                root = root[root]
            new = root[one] != root[two]
            one, two = one[new], two[new]
            for i, j in zip(one[:1000].tolist(), two[:1000].tolist()):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
            one, two = one[1000:], two[1000:]
    while (root[root] != root).any():
        root = root[root]
    member = np.flatnonzero(root != np.arange(len(root)))
    return member, root[member]


def _pairs_of(width: int, high: int, parts: int = 4) -> list[int]:
    """Masks of all pairs of ``parts`` equal fields in ``width`` bits, whose highest bit is ``high``."""
    step = width // parts
    field = [((1 << step) - 1) << (high + 1 - step * (i + 1)) for i in range(parts)]
    return [field[i] | field[j] for i in range(parts) for j in range(i + 1, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _remaining(mask: int) -> list[int]:
    """As :func:`_pairs_of`, for four 8-bit fields of the 32 bits that ``mask`` leaves out."""
    left = [i for i in range(63, -1, -1) if not mask >> i & 1]
    field = [sum(1 << b for b in left[i * 8 : i * 8 + 8]) for i in range(4)]
    return [mask | field[i] | field[j] for i in range(4) for j in range(i + 1, 4)]


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once for each mask, with the mask and the bits under it."""
    every = F.array(*[F.lit(_signed(m)) for m in masks])
    return fps.select("fp", F.explode(every).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted so; emits the links of each run of equal (mask, key)."""
    for t in whole_groups(batches, 2):
        mask, key, fp = (np.asarray(t.column(i)) for i in range(3))
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        mask, key, fp = mask[new], key[new], fp[new].view(np.uint64)
        for m in np.unique(mask):
            k, f = key[mask == m], fp[mask == m]
            ends = np.concatenate((np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            member, root = group_links(f, np.repeat(ends, np.diff(np.concatenate(([0], ends)))), int(m) & 0xFFFFFFFFFFFFFFFF)
            if len(member):
                yield pa.record_batch([pa.array(f[member].view(np.int64)), pa.array(f[root].view(np.int64))], names=["a", "b"])


def near_links(fps: DataFrame, large: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` values at most ``RADIUS`` bits apart."""
    spark = fps.sparkSession
    ship(spark)
    first = _pairs_of(64, 63)
    dealt = _dealt(fps, first)
    sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = cut(spark, sizes)
    plain = dealt.join(sizes.where(F.col("n") <= large), ["mask", "key"], "left_semi")
    hot = dealt.join(sizes.where(F.col("n") > large), ["mask", "key"], "left_semi")
    deeper = F.lit(None).cast("array<long>")
    for m in first:
        deeper = F.when(F.col("mask") == F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in _remaining(m)])).otherwise(deeper)
    hot = hot.select("fp", F.explode(deeper).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    groups = plain.select("mask", "key", "fp").unionByName(hot.select("mask", "key", "fp"))
    return groups.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_link_groups, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest id that links reach, itself included; ``fingerprint`` has 16 hex digits.
    """
    spark = docs.sparkSession
    rows = cut(spark, with_fingerprints(docs, id_col, text_col, k, seed))
    own = cut(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = cut(spark, connected_components(near_links(own.select("fp"))))
    of_component = (
        member.join(own, member.node == own.fp).groupBy("component").agg(F.min("least").alias("least")).withColumnRenamed("least", "component_id")
    )
    moved = member.join(of_component, "component").select(F.col("node").alias("fp"), "component_id")
    # Written, so that Spark shuffles both sides of the last join and can split a fingerprint with a large part of all rows.
    named = cut(spark, own.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
