"""Near-duplicate texts: wide SimHash fingerprints compared bit-sliced, confirmed by the similarity of their shingles.

A text is the set of its five-word shingles (A-Z count as a-z). Its fingerprint has a bit for each of ``64 * WIDE`` hash bits, set in over half the shingles.
Texts are dealt to groups by ``BANDS`` keys of ``MINS`` min-hashes each; of two texts with similarity 0.8, all keys differ in 0.3 % of cases. Within a group,
fingerprints are compared as bit planes (:func:`simhash.near_pairs`), and each text is paired with the nearest within ``RADIUS`` bits before and after it, never with
all. At similarity 0.8 two fingerprints differ in 39 bits on average and in more than the radius in 0.2 % of cases. Pairs are then confirmed by the Jaccard similarity of their
shingles.

What that leaves out, a prefix join finds without exception (:func:`others`): two texts of that similarity have a shingle in common among the first fifth of each, in any order of all shingles. Here the order is the
rare ones first, and only pairs that no confirmed pairs connect yet are looked at. Components are those of all confirmed pairs, and the tests hold them against brute force.

Texts with the same words are one before all this. A group of more than ``LARGE`` texts is dealt to cells; each pair of cells is compared in a task of its own, and the
nearest of all tasks counts, so the result does not depend on the size of a group.

Edge cases: null, empty and white texts have the same (no) words and are copies of each other. A text with fewer words than a shingle has the whole sequence as its one shingle. A
very long text is worked on whole, as a chunk of its own. Bytes that are no UTF-8 are parts of words. Of texts at the same distance the one with the smaller hash is
the nearest. Rows with a null id are linked too, but never name a component; a component of null ids only has a null id. Repeated rows have the same result each. An empty
table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm import simhash
from sheetwise.llm.common import mix, text_chunks, whole_groups
from sheetwise.llm.compact_windows import SHINGLE, needed_items, shingles
from sheetwise.llm.components import connected_components
from sheetwise.runtime import cut, scratch, ship

WIDE, RADIUS = 4, 56
BANDS, MINS = 8, 3
#: Distinct texts of a group that one task compares with each other.
LARGE = 1 << 14
#: Shingles whose bits are counted at once.
SLAB = 1 << 15
SEEDS = mix(np.arange(1, 1 + WIDE + BANDS * MINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, their offsets by text, a hash of each whole text); a short text's one shingle is its hash."""
    s, bounds, key = shingles(data, offsets)
    n = np.diff(bounds)
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(s)) - bounds[:-1][own]
    use = place < np.maximum(n - SHINGLE + 1, 1)[own]
    s, own = np.where(n[own] < SHINGLE, key[own], s)[use], own[use]
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[new], np.searchsorted(own[new], np.arange(len(n) + 1)), key


def sketches(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as rows of ``WIDE`` words, group keys as rows of ``BANDS``) of texts' shingle sets."""
    n = np.diff(bounds)
    fps, keys = np.zeros((len(n), WIDE), np.uint64), np.zeros((len(n), BANDS), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return fps, keys
    own = np.repeat(np.arange(len(full)), n[full])
    for j in range(WIDE):
        ones = np.zeros((len(full), 64), np.int64)
        for x in range(0, len(items), SLAB):
            bits = np.unpackbits(mix(items[x : x + SLAB] ^ SEEDS[j]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            here = own[x : x + SLAB]
            first = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            ones[here[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        fps[full, j] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel()
    least = [np.minimum.reduceat(mix(items ^ x), bounds[full]) for x in SEEDS[WIDE:]]
    for i in range(BANDS):
        h = np.full(len(full), i + 1, np.uint64)
        for m in least[i * MINS : (i + 1) * MINS]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m)
        keys[full, i] = h
    return fps, keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last, data, offsets in text_chunks(b.column(1)):
            items, bounds, key = shingle_sets(data, offsets)
            fps, keys = sketches(items, bounds)
            raw = [x.tobytes() for x in fps.astype("<u8")]
            groups = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(key.view(np.int64)), pa.array(raw, pa.binary()), groups], names=["doc_id", "k", "fp", "groups"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, lo, hi, k, fp) sorted so to (group, k, side, distance, other): the nearest text before (0) and after (1) each in its group."""
    for t in whole_groups(batches, 3):
        group, lo, hi, k = (np.asarray(t.column(i)) for i in range(4))
        fps = np.frombuffer(b"".join(t.column(4).to_pylist()), "<u8").reshape(-1, WIDE)
        ends = np.concatenate((np.flatnonzero((group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1, [len(k)]))
        far = np.iinfo(np.int64).max
        best = np.full((2, len(k)), far)
        for one, two, d in simhash.near_pairs(fps, np.repeat(ends, np.diff(np.concatenate(([0], ends)))), RADIUS):
            np.minimum.at(best[0], two, d << 32 | one)
            np.minimum.at(best[1], one, d << 32 | two)
        side, at = np.nonzero(best < far)
        if len(at):
            code = best[side, at]
            cols = [group[at], k[at], side.astype(np.int32), (code >> 32).astype(np.int32), k[code & 0xFFFFFFFF]]
            yield pa.record_batch([pa.array(c) for c in cols], names=["group", "k", "side", "d", "other"])


NEAREST = "group long, k long, side int, d int, other long"


def candidates(texts: DataFrame, large: int = LARGE) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct texts ``(k, fp, groups)`` that are nearest to one another in a group."""
    dealt = texts.select("k", "fp", F.explode("groups").alias("group"))
    hot = cut(texts.sparkSession, dealt.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large))
    none = F.lit(0)
    plain, more = dealt.withColumns({"lo": none, "hi": none}), None
    if not hot.isEmpty():
        plain = plain.join(hot, "group", "left_anti")
        cells = F.ceil(F.col("n") / large).cast("int")
        placed = dealt.join(hot, "group").withColumn("cell", F.pmod(F.xxhash64("k"), cells).cast("int"))
        more = placed.withColumn("to", F.explode(F.sequence(none, cells - 1))).withColumns({"lo": F.least("cell", "to"), "hi": F.greatest("cell", "to")})

    def compared(df: DataFrame) -> DataFrame:
        keys = ["group", "lo", "hi"]
        return df.select(*keys, "k", "fp").repartition(*keys).sortWithinPartitions(*keys, "k").mapInArrow(_nearest, NEAREST)

    near = compared(plain).select("k", "other")
    if more is not None:
        near = near.unionByName(compared(more).groupBy("group", "k", "side").agg(F.min_by("other", F.struct("d", "other")).alias("other")).select("k", "other"))
    return near.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct()


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    items, bounds, key = shingle_sets(data, offsets)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for k, x, y in zip(key.view(np.int64).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield k, np.unique(short[x:y]).tobytes()


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                one, two = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(one), len(two)) >= similarity * max(len(one), len(two)):
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                        keep.append(i)
            if keep:
                yield pa.record_batch([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["a", "b"])

    return run


#: One in so many texts is read to learn which shingles are frequent, and so often a shingle occurs in these. That orders shingles and deals large groups; it leaves no pair out.
PART, OFTEN = 16, 8
#: Shingles at most whose frequencies are sent to all tasks.
FREQUENT = 1 << 16
#: Pairs of a group that are looked at in one step.
STEP = 1 << 17


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        for _, _, data, offsets in text_chunks(b.column(0)):
            items, bounds, key = shingle_sets(data, offsets)
            new = np.array([not (k in seen or seen.add(k)) for k in key.tolist()], bool)
            h, n = np.unique(items[np.repeat(new, np.diff(bounds))].view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n)], names=["h", "n"])


def _prefixes(similarity: float, often: np.ndarray, times: np.ndarray, large: int):
    """Texts to (k, size, keys): a key for each shingle of which a similar text must have one in common, rare ones first; ``often`` is sorted.

    The shingles of a large group are dealt to pairs of cells, with a key for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                items, bounds, key = shingle_sets(data, offsets)
                place = np.minimum(np.searchsorted(often, items.view(np.int64)), max(len(often) - 1, 0))
                count = np.where(often[place] == items.view(np.int64), times[place], 0) if len(often) else np.zeros(len(items), np.int64)
                ks, sizes, keys, at = [], [], [], []
                for k, x, y in zip(key.view(np.int64).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if y == x or k in seen:
                        continue
                    seen.add(k)
                    n = y - x
                    first = np.lexsort((mix(items[x:y]), count[x:y]))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                    h, many, pos = items[x:y][first], -(-count[x:y][first] * PART // large), np.arange(len(first))
                    for i in np.flatnonzero(many > 1).tolist():
                        cells = int(many[i])
                        own, to = k % cells, np.arange(cells)
                        dealt = mix(h[i] + mix((np.minimum(own, to) * cells + np.maximum(own, to) + 1).astype(np.uint64)))
                        h, pos = np.concatenate((h, dealt)), np.concatenate((pos, np.full(cells, pos[i])))
                    use = np.concatenate((many <= 1, np.ones(len(h) - len(many), bool)))
                    ks.append(k)
                    sizes.append(n)
                    keys.append(h[use].tobytes())
                    at.append(pos[use].astype(np.int32).tobytes())
                yield pa.record_batch([pa.array(ks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.binary())], names=["k", "size", "keys", "at"])

    return run


def _dealt_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, component, size, keys, at) to (v, c, k, at), a row for each key; ``at`` holds size and place."""
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            keys = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            many = [len(x) for x in keys]
            k, c, size = (np.repeat(np.asarray(b.column(i)), many) for i in range(3))
            at = np.concatenate([np.frombuffer(x, np.int32) for x in b.column(4).to_pylist()]).astype(np.int64)
            yield pa.record_batch([pa.array(x) for x in (np.concatenate(keys), c, k, size << 32 | at)], names=["v", "c", "k", "at"])


def _unlinked(similarity: float):
    """Rows (v, c, k, at) sorted by v and at to the pairs (a, b) of different components whose sizes and places leave enough in common, with the number of keys that they must share at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            v, c, k, at = (np.asarray(t.column(i)) for i in range(4))
            start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sizes = np.diff(np.append(start, len(v)))
            mixed = np.repeat(np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start), sizes)
            group = np.repeat(np.arange(len(start)), sizes)[mixed]
            c, k, at = c[mixed], k[mixed], at[mixed]
            n, rest = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
            last = np.searchsorted(group << 33 | n, group << 33 | np.floor(n / similarity + 1e-9).astype(np.int64), "right")
            many = last - np.arange(len(n)) - 1
            upto = np.cumsum(many)
            i = 0
            while i < len(n):
                stop = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, "right")))
                one = np.repeat(np.arange(i, stop), many[i:stop])
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many[i:stop]) - many[i:stop], many[i:stop])
                # Of the shingles in common this is the first, or an earlier one leads to the same pair.
                use = (c[one] != c[two]) & (np.minimum(rest[one], rest[two]) >= similarity / (1 + similarity) * (n[one] + n[two]) - 1e-6)
                one, two = one[use], two[use]
                if len(one):
                    # All that two texts have in common is seen here, but for what lies behind the keys of the one whose keys end first.
                    behind = np.maximum(np.ceil(similarity * n[one] - 1e-9), np.ceil(similarity * n[two] - 1e-9)) - 1
                    need = np.ceil(similarity / (1 + similarity) * (n[one] + n[two]) - behind - 1e-6).astype(np.int64)
                    yield pa.record_batch([pa.array(x) for x in (np.minimum(k[one], k[two]), np.maximum(k[one], k[two]), need)], names=["a", "b", "need"])
                i = stop

    return run


def others(source: DataFrame, member: DataFrame, similarity: float, large: int = LARGE) -> DataFrame:
    """Pairs ``(a, b)``, a < b, among which is each pair of distinct texts that are similar and that ``member`` (``node, component``) has in different components."""
    part = source.select("text").where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).mapInArrow(_counts, "h long, n long")
    found = part.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    often, times = np.asarray(found["h"], dtype=np.int64), np.asarray(found["n"], dtype=np.int64)
    order = np.argsort(often)
    prefixes = source.select("text").mapInArrow(_prefixes(similarity, often[order], times[order], large), "k long, size long, keys binary, at binary")
    once = prefixes.groupBy("k").agg(F.any_value("size").alias("size"), F.any_value(F.struct("keys", "at")).alias("x"))
    of = once.join(member.select(F.col("node").alias("k"), "component").hint("merge"), "k", "left").select("k", F.coalesce("component", "k").alias("c"), "size", "x.keys", "x.at")
    rows = of.mapInArrow(_dealt_keys, "v long, c long, k long, at long")
    met = rows.repartition("v").sortWithinPartitions("v", "at").mapInArrow(_unlinked(similarity), "a long, b long, need long")
    # A shingle that is dealt to cells may count more than once, which leaves out none.
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def near_duplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, large: int = LARGE) -> DataFrame:
    """``(doc_id, component_id)`` of every row: the smallest id that links reach, itself included.

    Texts are linked if the Jaccard similarity of their shingles is ``similarity`` or more. The radius and the keys fit 0.8 or more.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(spark, source.mapInArrow(_sketch, "doc_id long, k long, fp binary, groups array<long>"))
    with scratch(spark) as own:
        texts = own(rows.groupBy("k").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("groups").alias("groups")))

        def confirmed(pairs: DataFrame) -> DataFrame:
            items = own(needed_items(spark, source, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), _sets))
            met = pairs.join(items.select(F.col("k").alias("a"), F.col("items").alias("x")).hint("merge"), "a").join(items.select(F.col("k").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
            return own(met.select("a", "b", "x", "y").mapInArrow(_confirm(similarity), "a long, b long"))

        links = confirmed(own(candidates(texts, large)))
        member = own(connected_components(links))
        left = own(others(source, member, similarity, large))
        more = None if left.isEmpty() else confirmed(left)
        if more is not None and not more.isEmpty():
            member = own(connected_components(links.unionByName(more)))
        of_component = member.join(texts, member.node == texts.k).groupBy("component").agg(F.min("least").alias("component_id"))
        moved = member.join(of_component, "component").select(F.col("node").alias("k"), "component_id")
        # Written, so that Spark shuffles both sides of the last join and can split a text with a large part of all rows.
        named = cut(spark, texts.select("k", "least").join(moved, "k", "left").select("k", F.coalesce("component_id", "least").alias("component_id")))
    return rows.select("doc_id", "k").join(named.hint("merge"), "k").select("doc_id", "component_id")
