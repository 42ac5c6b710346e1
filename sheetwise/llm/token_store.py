"""Token ids as a binary store: each document compressed by itself, with one zstandard dictionary for all.

Format. A store is a Parquet table of shards, ordered by (part, shard); within it, documents ascend by id. A shard's
``blob`` is: magic ``SWTK``, version (uint32), SHA-256 of the dictionary (32 bytes), number of documents
(uint64), offsets of their frames counted from the end of the header (uint64, one more than documents), token counts (uint64 each),
then the frames. A frame is a zstandard frame of the ids as little-endian unsigned 32-bit integers, so any document is read
by two offsets and one small decompression. The dictionary is stored beside the shards and checked by its hash on reading.

Spark commits the shards: a task that is lost is run again, and none of its output is seen before the job ends.

The dictionary is trained on the ids of at most ``DICT_DOCS`` documents of at most ``DICT_CHARS`` characters, chosen by a hash of
their ids; every document is stored whole. Where too few documents exist to train on, the samples themselves
are the dictionary, or none.

Tokenisation: pre-tokens of a byte-level BPE do not influence each other, so the tokenizers library encodes each distinct one
once for a task, and texts are put together from those ids. A text that holds the string of an added token is encoded
whole, and code points are classed as the tokenizer itself does. The tests compare this with encoding whole texts. A tokenizer whose description says otherwise (a normaliser,
another pre-tokeniser, a prefix space, dropout) encodes every text whole.

Edge cases: a null or empty text has the end id only. A very long text is encoded whole, as a chunk of its own, and has one frame. Bytes that are no UTF-8
are encoded as U+FFFD. Null ids come first. Rows with equal ids are ordered by a hash of their frames; repeated rows are each stored. An empty table makes
an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetwise.llm.common import code_points, span_hashes, text_chunks, whole_text
from sheetwise.runtime import cut, forget, scratch, shared_dir, ship

MAGIC, VERSION = b"SWTK", 1
DICT_BYTES, DICT_DOCS, DICT_CHARS = 64 << 10, 2000, 20_000
SHARD_BYTES = 4 << 20
#: Up to this many shards, their starts are broadcast when a store is read (24 bytes each).
BROADCAST_SHARDS = 100_000
#: Distinct pre-tokens whose ids a worker keeps; later ones are encoded again for each batch.
CACHE = 150_000
HEAD = struct.Struct("<4sI32sQ")


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 other."""
    # Not made of single characters, which would take a hundred megabytes for a moment.
    every = np.concatenate((np.arange(0xD800, dtype="<u4"), np.arange(0xE000, sys.maxunicode + 1, dtype="<u4"))).tobytes().decode("utf-32-le")
    table = np.full(sys.maxunicode + 1, 3, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            s, e = m.span()
            table[s + 0x800 * (s >= 0xD800) : e + 0x800 * (e > 0xD800)] = kind
    return table


def piece_starts(points: np.ndarray, texts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE begin; ``texts`` are the offsets of the texts, ``table`` is like :func:`kinds`.

    A pre-token is a run of letters, numbers or other signs, with one space before it; an English contraction
    after such a run; or a run of white space up to the last one before something else.
    """
    n = len(points)
    kind = (kinds() if table is None else table)[points]
    start = np.ones(n + 1, bool)
    same = kind[1:] == kind[:-1]
    start[1:n] = ~same
    head = np.zeros(n + 1, bool)
    head[texts] = True
    white = kind == 0
    ends_white = np.flatnonzero(white[:-1] & ~white[1:] & ~head[1:n])
    start[ends_white] = True
    start[ends_white + 1] = points[ends_white] != 0x20
    start[texts] = True
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-2] & start[1:-1] & ~head[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        after = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~head[np.minimum(quote + 2, n)]
        for where, size in ((quote[short], 1), (quote[long], 2)):
            start[where + 1] = False
            start[where + 1 + size] = True
    return np.flatnonzero(start[:n])


def equal_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each kind, the kind of each span) of spans that cover ``points``: those of a kind are equal.

    Spans meet by their hash and are compared with the first of it; if any two differ under one hash, each is a kind of its own.
    """
    _, first, code = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][code]
    if same.all():
        same = points == points[np.repeat(starts[first][code] - starts, size) + np.arange(len(points))]
    if not same.all():
        first = code = np.arange(len(starts))
    return first, code


def splits_as_bytes(description: dict) -> bool:
    """Whether a tokenizer's description is that of a byte-level BPE whose pre-tokens :func:`piece_starts` finds."""
    split, model = description.get("pre_tokenizer") or {}, description.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain) and not description.get("normalizer") and not description.get("truncation") and model.get("type") == "BPE" and not model.get("dropout")


class Encoder:
    """Whole texts to little-endian uint32 ids, through the tokenizers library."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_pieces = splits_as_bytes(json.load(f))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.end = struct.pack("<I", end_id)
        # A character of a byte-level token stands for a byte.
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.kinds, self.checked = kinds().copy(), np.zeros(sys.maxunicode + 1, bool)

    def _check(self, points: np.ndarray) -> None:
        """Class new code points as the tokenizer does, whose Unicode tables are of another version than ours."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in np.unique(points[~self.checked[points]]).tolist():
            self.kinds[c] = next((kind for kind, probe in ((1, "a"), (2, "1"), (3, "!")) if len(split(probe + chr(c))) == 1), 0)
            self.checked[c] = True

    def _holding_added(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts that hold the string of an added token, which the library finds before it splits a text."""
        out: set[int] = set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(content) <= offsets[i + 1]
                if inside:
                    out.add(i)
                at = raw.find(content, int(offsets[i + 1]) if inside else at + 1)
        return sorted(out)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pre-tokens, how many each has): the library takes them as one pretokenised text, and the bytes of each id say where a pre-token ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in pieces])
        upto = np.cumsum(self.id_bytes[ids])
        last = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[last] == ends).all():
            return ids, np.diff(last, prepend=-1)
        own = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in own for i in x], "<u4"), np.array([len(x) for x in own], np.int64)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pre-tokens on hand, how many each has, which of them the given distinct ones are)."""
        at = np.array([self.known.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.ids, self.sizes, at
        strings = [pieces[i] for i in new.tolist()]
        made, counts = self._encode(strings)
        ids, sizes = np.concatenate((self.ids, made)), np.concatenate((self.sizes, counts))
        at[new] = np.arange(len(self.sizes), len(sizes))
        if len(sizes) <= CACHE:
            self.known.update(zip(strings, at[new].tolist()))
            self.ids, self.sizes = ids, sizes
        return ids, sizes, at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text, with the end id, of UTF-8 bytes and the texts' offsets."""
        if not self.by_pieces:
            texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:])]
            return [array("I", e.ids).tobytes() + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        points, texts = code_points(data, offsets)
        if not len(points):
            return [self.end] * (len(offsets) - 1)
        self._check(points)
        starts = piece_starts(points, texts, self.kinds)
        ends = np.append(starts[1:], len(points))
        first, code = equal_spans(points, starts, ends)
        raw = data.tobytes()
        whole = raw.decode("utf-8")
        known, sizes, at = self._ids([whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        at = at[code]
        past = np.concatenate(([0], np.cumsum(sizes[at])))
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[at] - past[:-1], sizes[at]) + np.arange(past[-1])].tobytes()
        cuts = (4 * past[np.searchsorted(starts, texts)]).tolist()
        out = [ids[s:e] + self.end for s, e in zip(cuts, cuts[1:])]
        for i in self._holding_added(raw, offsets):
            own = self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8"), add_special_tokens=False).ids
            out[i] = array("I", own).tobytes() + self.end
        return out


@lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path, end_id)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> bytes:
    """A zstandard dictionary from a bounded sample of id arrays; empty if there is nothing to learn from."""
    ship(docs.sparkSession)
    text = F.coalesce(whole_text(text_col), F.lit(""))
    short = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.length("text").between(1, DICT_CHARS))
    total = docs.count()
    wheel = max(1, total // DICT_DOCS)
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    chosen = short.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(wheel)) == 0).orderBy(turn).limit(DICT_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id).encode
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                yield pa.record_batch([pa.array(encode(data, offsets), pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(run, "ids binary").collect())
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def pack_shard(frames: list[bytes], counts: list[int], digest: bytes) -> bytes:
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    return b"".join([HEAD.pack(MAGIC, VERSION, digest, len(frames)), offsets.tobytes(), np.array(counts, "<u8").tobytes(), *frames])


class Shard:
    """Reads single documents of a shard's blob by its offset index."""

    def __init__(self, blob: bytes, dictionary: bytes):
        self.blob = memoryview(blob)
        magic, version, digest, n = HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.offsets = np.frombuffer(blob, "<u8", n + 1, HEAD.size)
        self.counts = np.frombuffer(blob, "<u8", n, HEAD.size + 8 * (n + 1))
        self.body = HEAD.size + 8 * (2 * n + 1)
        self.inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        """Token ids of the shard's i-th document."""
        frame = self.blob[self.body + int(self.offsets[i]) : self.body + int(self.offsets[i + 1])]
        return np.frombuffer(self.inflate(frame), "<u4")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 1, shard_bytes: int = SHARD_BYTES
) -> None:
    """Encode every whole text and write the store to ``path`` (``shards`` and ``dictionary``).

    Texts are encoded where they are read. Only the compressed frames are sorted and shuffled: by id, then by a hash of the frame and by place, so that neither
    one id nor one text with very many rows lies in one range.
    """
    spark = docs.sparkSession
    ship(spark)
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dictionary, digest.hex())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, raw = encoder(tokenizer_path, end_id).encode, shared.value
        deflate = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None).compress
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1)):
                ids = encode(data, offsets)
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(deflate, ids), pa.binary())], names=["doc_id", "n", "frame"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(encoded, "doc_id long, n long, frame binary")
    with scratch(spark) as cut:
        # Written first, as dealing by ranges reads its input twice.
        frames = cut(rows).withColumns({"h": F.xxhash64("frame"), "place": F.monotonically_increasing_id()})
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("place").asc()]
        ordered = frames.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, shard = TaskContext.get().partitionId(), 0
            ids: list[int | None] = []
            frames: list[bytes] = []
            counts: list[int] = []
            size = 0

            def row() -> pa.RecordBatch:
                made = [[part], [shard], [list(ids)], [sum(counts)], [pack_shard(frames, counts, digest)]]
                return pa.record_batch([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=["part", "shard", "doc_ids", "n_tokens", "blob"])

            for b in batches:
                for doc, n, frame in zip(*(c.to_pylist() for c in b.columns)):
                    ids.append(doc)
                    counts.append(n)
                    frames.append(frame)
                    size += len(frame)
                    if size >= shard_bytes:
                        yield row()
                        shard, size = shard + 1, 0
                        ids, frames, counts = [], [], []
            if ids:
                yield row()

        ordered.mapInArrow(packed, "part int, shard int, doc_ids array<long>, n_tokens long, blob binary").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the store: ``doc_id, start, n_tokens, ids_crc32, part, shard, frame_offset, frame_bytes``.

    ``start`` counts the ids of all documents before it. The totals of the parts, one row for each partition of the writing
    job, are summed first; within a part, its shards.
    """
    ship(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    shared = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    small = shards.select("part", "shard", "n_tokens")
    totals = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p"))
    starts = small.withColumn("s", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).join(before_part, "part").select("part", "shard", (F.col("p") + F.col("s")).alias("start"))

    starts = cut(spark, starts)
    if starts.count() <= BROADCAST_SHARDS:  # then the blobs are not shuffled
        starts = F.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, doc_ids, blob, start in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(blob, shared.value)
                counts = s.counts.astype(np.int64)
                crc = []
                for i in range(len(s)):
                    ids = s.ids(i)
                    if len(ids) != counts[i]:
                        raise ValueError("a document's ids do not have the length in the index")
                    crc.append(zlib.crc32(ids.tobytes()))
                n = len(s)
                cols = [doc_ids, start + np.cumsum(counts) - counts, counts, crc, [part] * n, [shard] * n, s.offsets[:-1].astype(np.int64), np.diff(s.offsets.astype(np.int64))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2)], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard", "frame_offset", "frame_bytes"])

    return shards.select("part", "shard", "doc_ids", "blob").join(starts, ["part", "shard"]).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int, frame_offset long, frame_bytes long"
    )


def new_store_path(spark: SparkSession) -> str:
    """A path in the shared folder for a store of its own, which goes with the application."""
    path = f"{shared_dir(spark)}/sheetwise-tokens-{uuid.uuid4().hex}"
    forget(spark, path)
    return path
