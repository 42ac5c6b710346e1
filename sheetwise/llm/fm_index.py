"""Benchmark decontamination: an FM-index for each training shard, searched backwards for benchmark phrases.

A shard is a run of whole documents of ``shard_bytes`` or one longer document. Its words that the benchmark knows
become symbols; a run of known words shorter than the shortest phrase cannot hold one and is left out, and runs are kept
apart by separators. The shard's suffix array gives its Burrows-Wheeler transform, held in a wavelet matrix. All phrases
are searched at once, last word first, by ranks; their occurrences are located from suffix positions sampled every
``SAMPLE`` symbols, and the spans they cover are merged.

A phrase is ``window`` consecutive words of an item; an item with fewer words, but not none, is one phrase.

The benchmark reaches the tasks in blocks of ``block_chars`` characters of items at most (or one longer item). Documents pass one block after
the other, each adding its spans and items; between blocks they are written to the shared folder, so neither the broadcast nor what a task
holds grows with the benchmark.

Edge cases: a null or empty text, of a document or an item, has no words. A very long document is a shard of its own, searched whole. Bytes that are no UTF-8
count as U+FFFD, which is part of a word. Items with the same words are each reported. An item without an id is searched like any other, and only left out of the
list of ids. Repeated rows have the same result each. Empty tables give no hits or no rows. Extra columns are kept only if asked for in
``keep``; one of them that is named like a column of the result is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import no_clash, text_chunks, whole_text
from sheetwise.runtime import cut_to, remove, ship

#: Bytes that are no part of a word, after A-Z have become lower case: all ASCII but digits and letters.
TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
SAMPLE = 8
SHARD_BYTES = 4 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(TO_SPACE).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of ``seq`` in order, by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    key = seq[order]
    first = np.concatenate((np.ones(1, bool), key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    tied = np.flatnonzero(~(first & np.concatenate((first[1:], np.ones(1, bool)))))
    step = 1
    while len(tied):
        at = order[tied]
        mine, after = rank[at], rank[np.minimum(at + step, n)]
        by = np.lexsort((after, mine))
        at, mine, after = at[by], mine[by], after[by]
        order[tied] = at
        head = np.concatenate((np.ones(1, bool), (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])))
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        tied = tied[~(head & np.concatenate((head[1:], np.ones(1, bool))))]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks in a sequence of symbols: one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(symbol), np.int64)
        for level, ones, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return at - low


class FMIndex:
    """FM-index of symbols >= 1; the text is closed by a 0 of its own."""

    def __init__(self, seq: np.ndarray):
        text = np.concatenate((seq, np.zeros(1, seq.dtype)))
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        size = int(text.max()) + 2
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=size))))
        self.tree = WaveletMatrix(self.bwt, max(1, int(text.max()).bit_length()))
        marked = sa % SAMPLE == 0
        self.sampled = np.zeros(len(sa) + 1, np.int64)
        np.cumsum(marked, out=self.sampled[1:])
        self.marked, self.positions = marked, sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each phrase (rows of equal length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out = np.zeros(len(at), np.int64)
        todo, row, steps = np.arange(len(at)), at.copy(), 0
        while len(todo):
            hit = self.marked[row]
            out[todo[hit]] = self.positions[self.sampled[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out


class PhraseBlock:
    """The phrases of some items, grouped by length, and the items of each phrase."""

    def __init__(self, items: Iterable[tuple[object, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text.encode())]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[tuple(ids[i : i + size])].add(item)
        by_length: dict[int, list] = defaultdict(list)
        for phrase, of in found.items():
            by_length[len(phrase)].append((phrase, sorted(of - {None})))
        self.lengths = {n: (np.array([p for p, _ in x], np.int64), [of for _, of in x]) for n, x in sorted(by_length.items())}

    def occurrences(self, symbols: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """(phrase length, items of its phrases, starting positions, phrase at each) in a shard; symbol 0 is unknown, -1 a document's end."""
        if not self.lengths:
            return
        known = symbols > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= min(self.lengths)
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        sizes = ends - starts + 1
        first = np.cumsum(sizes) - sizes
        seq = np.ones(int(sizes.sum()), np.int64)
        origin = np.arange(len(seq)) + np.repeat(starts - first, sizes)
        inside = np.ones(len(seq), bool)
        inside[first + sizes - 1] = False
        seq[inside] = symbols[origin[inside]]
        used = np.unique(seq)
        index = FMIndex(np.searchsorted(used, seq) + 1)
        for n, (phrases, items) in self.lengths.items():
            code = np.searchsorted(used, phrases)
            here = np.flatnonzero((used[np.minimum(code, len(used) - 1)] == phrases).all(axis=1))
            low, high = index.search(code[here] + 1)
            count = np.maximum(0, high - low)
            if count.sum():
                which = np.repeat(here, count)
                row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                yield n, items, origin[index.locate(row)], which


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = "array<struct<start:int,end:int>>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), whole_text(text_col).alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > limit:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += len(r.text)
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str | Column], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_chars: int = 16 << 20, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``keep`` columns of every row, its text as ``_text``, and what the benchmark's phrases hit in it.

    ``n_words``, ``spans`` (merged word ranges, end exclusive) and ``items`` (ids as sorted strings of the items with
    phrases that occur).
    """
    spark = docs.sparkSession
    ship(spark)
    no_clash(keep, ("_text", "n_words", "spans", "items"))
    rows = docs.select(
        *keep, whole_text(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items")
    )
    schema = rows.schema

    def passed(df: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = PhraseBlock(shared.value, window)
            for b in batches:
                yield from (_search(b.slice(first, last - first), data, offsets, block) for first, last, data, offsets in text_chunks(b.column(b.num_columns - 4), shard_bytes))

        return df.mapInArrow(run, schema)

    last = None  # the table of the block before
    none = True
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        if not none:
            rows, path = cut_to(spark, rows)
            if last:
                remove(spark, last)
            last = path
        rows, none = passed(rows, items), False
    return passed(rows, []) if none else rows


def _search(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, block: PhraseBlock) -> pa.RecordBatch:
    raw, ends = data.tobytes(), offsets.tolist()
    get = block.vocabulary.get
    parts, lengths = [], np.zeros(b.num_rows, np.int64)
    for i, (s, e) in enumerate(zip(ends, ends[1:])):
        words = words_of(raw[s:e])
        lengths[i] = len(words)
        parts += [get(w, 0) for w in words]
        parts.append(-1)
    symbols = np.array(parts, np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for n, of, at, which in block.occurrences(symbols):
        doc = np.searchsorted(first, at, "right") - 1
        for d, s in zip(doc.tolist(), (at - first[doc]).tolist()):
            spans[d].append((s, s + n))
        for d, w in set(zip(doc.tolist(), which.tolist())):
            items[d].update(of[w])
    old_spans, old_items = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    if spans or old_spans.flatten().__len__():
        before = old_spans.to_pylist()
        new_spans = pa.array([[{"start": s, "end": e} for s, e in merged([*((x["start"], x["end"]) for x in before[i]), *spans.get(i, ())])] for i in range(b.num_rows)], old_spans.type)
        known = old_items.to_pylist()
        new_items = pa.array([sorted({*known[i], *items.get(i, ())}) for i in range(b.num_rows)], old_items.type)
    else:
        new_spans, new_items = old_spans, old_items
    return pa.record_batch([*b.columns[:-3], pa.array(lengths), new_spans, new_items], names=b.schema.names)


def cut_spans(found: DataFrame) -> DataFrame:
    """Adds ``clean_text`` to :func:`find_contamination`'s rows: the text without the characters of its hit words and what stands between them."""
    ship(found.sparkSession)
    schema = found.schema
    at_text, at_spans = schema.names.index("_text"), schema.names.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(at_text).to_pylist(), b.column(at_spans).to_pylist()):
                if text and spans:
                    lowered = text.translate(LOWER)
                    where = [m.span() for m in WORD.finditer(lowered)]
                    kept, last = [], 0
                    for x in spans:
                        kept.append(text[last : where[x["start"]][0]])
                        last = where[x["end"] - 1][1]
                    text = "".join(kept) + text[last:]
                out.append(text)
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "clean_text"])

    return found.mapInArrow(run, found.select("*", F.lit(None).cast("string").alias("clean_text")).schema)


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
