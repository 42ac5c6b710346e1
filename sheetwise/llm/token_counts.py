"""Token counts of whole texts without materialising ids.

A BPE with word ends never joins pieces across pre-tokens, so a text's count is the sum over its distinct pre-tokens of their frequency times the number of pieces of one. The lexicon holds each
distinct pre-token of all documents once, and the tokenizers library counts its pieces once. Per-document frequencies meet it in a join: pre-tokens that are frequent in the corpus through a
table that is sent to all tasks (at most ``FREQUENT`` hashes and counts, chosen by a power of two of their frequency), all others by their string in a shuffled join. Only rare pre-tokens of a document are thus shuffled.

Pre-tokens are cut with numpy over code points; how a code point is lower-cased and classed is asked of the tokenizer itself. Texts with characters that may
compose with their neighbours, or that change under normalisation other than one for one, are normalised by the library first, and texts that hold the string of an added token are
encoded whole. So are all texts if the tokenizer's description is not of this kind (other normalisers, other pre-tokenisers, a sentencepiece ``.model``).

A pre-token's hash has 64 bits. Hashes that several pre-tokens share are sent to the tasks only if these have equally many pieces; else the strings decide, so no collision changes a count.

Edge cases: a null or empty text has no bytes and no tokens. A very long text is a chunk of its own, cut and counted whole. Bytes that are no UTF-8 count as U+FFFD. Rows with null or repeated ids
and repeated rows are each counted; an empty table gives no rows. Extra columns are ignored unless kept; a kept one with a result's name is an error.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import BASE, INVERSE, code_points, mix, no_clash, sums, text_chunks, whole_text
from sheetwise.runtime import cut, ship

#: Hashes of frequent pre-tokens that are sent to all tasks: 10 bytes each.
FREQUENT = 1 << 19
#: Distinct pre-tokens that a task gathers before it gives them to Spark.
HELD = 1 << 17
OUT = ("n_bytes", "n_tokens", "over_limit")
#: The kind of tokenizer whose pre-tokens are cut here (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE, LETTER, NUMBER, SIGN, HARD = range(5)


def cuts_like_words(description: dict) -> bool:
    """Whether a tokenizer's description is of the kind that :class:`WordCutter` cuts."""
    steps = (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, model = steps[0], description["model"]
    return (
        description.get("normalizer") == NORMALIZER and len(steps) == 2 and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and model.get("type") == "BPE" and not model.get("dropout")
        and not description.get("truncation") and all(not t["normalized"] for t in description["added_tokens"])
    )


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.kept[0]) < n:
        made = []
        for x in (BASE, INVERSE):
            p = np.full(max(n, 1 << 18), x, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers.kept = tuple(made)
    return _powers.kept[0][:n], _powers.kept[1][:n]


_powers.kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class Pieces:
    """The pre-tokens of a chunk of texts: their hashes, and which text each belongs to."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray):
        up, down = _powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
        self.hashes = mix((total[ends] - total[starts]) * down[starts]) if len(starts) else np.zeros(0, np.uint64)
        self.points, self.starts, self.ends, self.texts = points, starts, ends, texts

    def string(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].astype("<u4").tobytes().decode("utf-32-le")


class WordCutter:
    """Cuts texts into a tokenizer's pre-tokens; texts that hold an added token are left to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kinds, self.lower = np.full(sys.maxunicode + 1, 255, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)

    def _kind(self, c: int) -> tuple[int, int]:
        """(kind, lower-case code point) of a code point, as the tokenizer has it."""
        ch = chr(c)
        low = self.tokenizer.normalizer.normalize_str(ch)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        composes = c >= 0x300 and (unicodedata.category(ch)[0] == "M" or unicodedata.category(ch) == "Cn" or 0x1100 <= c <= 0x11FF or not unicodedata.is_normalized("NFC", ch))
        if len(low) != 1 or composes:
            return HARD, c
        kind = WHITE if not split(low) else LETTER if len(split("a" + low)) == 1 else SIGN if len(split("!" + low)) == 1 else NUMBER
        return kind, ord(low)

    def _learn(self, points: np.ndarray) -> None:
        for c in np.unique(points[self.kinds[points] == 255]).tolist():
            self.kinds[c], self.lower[c] = self._kind(c)

    def _normal_kind(self, points: np.ndarray) -> np.ndarray:
        """Kinds of code points of normalised texts, where even a hard one has a place in the pattern."""
        kinds = self.kinds[points]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in np.unique(points[kinds == HARD]).tolist():
            ch = chr(c)
            kinds[points == c] = WHITE if not split(ch) else LETTER if len(split("a" + ch)) == 1 else SIGN if len(split("!" + ch)) == 1 else NUMBER
        return kinds

    def holding_added(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts with the string of an added token."""
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

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Pieces, list[int]]:
        """Pre-tokens of UTF-8 texts, and the texts that must be encoded whole (which have none here)."""
        raw = data.tobytes()
        whole = self.holding_added(raw, offsets)
        points, texts = code_points(data, offsets)
        self._learn(points)
        kinds = self.kinds[points]
        hard = set((np.searchsorted(texts, np.flatnonzero(kinds == HARD), "right") - 1).tolist())
        if hard or whole:
            # Rare: the chunk is put together again from its texts, some of them normalised by the library.
            skip, parts = set(whole), []
            for i in range(len(offsets) - 1):
                own = points[texts[i] : texts[i + 1]]
                if i in skip:
                    own = own[:0]
                elif i in hard:
                    own = np.frombuffer(self.tokenizer.normalizer.normalize_str(raw[offsets[i] : offsets[i + 1]].decode()).encode("utf-32-le"), np.uint32)
                parts.append(own)
            texts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            points = np.concatenate(parts) if parts else points
            self._learn(points)
            low, kinds = np.where(self.kinds[points] == HARD, points, self.lower[points]), self._normal_kind(points)
        else:
            low = self.lower[points]
        starts, ends = word_bounds(low, kinds, texts)
        return Pieces(low, starts, ends, np.searchsorted(texts, starts, "right") - 1), whole


def word_bounds(points: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens: an English contraction where a match begins with a quote, else runs of letters or signs, and single numbers."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    edge[texts] = True
    head = np.zeros(n + 3, bool)
    head[texts] = True
    quote = np.flatnonzero((points == 0x27) & edge[:n])
    if len(quote):
        after = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = after[quote + 1], after[quote + 2]
        inside = ~head[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~head[quote + 2] & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for where, size in ((quote[short], 1), (quote[long], 2)):
            edge[where + 1] = False
            edge[where + 1 + size] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    kept = kinds[starts] != WHITE
    return starts[kept], ends[kept]


class WholeTexts:
    """Counts every text by encoding it: for tokenizers whose pre-tokens are not cut here."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            encode = SentencePieceProcessor(model_file=path).encode
            self.count = lambda text: len(encode(text, add_bos=False, add_eos=False))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False))


@lru_cache(2)
def cutter(path: str) -> WordCutter | None:
    """A worker's cutter, kept from task to task; None if the tokenizer is of another kind."""
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        return WordCutter(path) if cuts_like_words(json.load(f)) else None


@lru_cache(2)
def whole_texts(path: str) -> WholeTexts:
    return WholeTexts(path)


def lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``(token, hash, n, pieces)``: each distinct pre-token of all documents, its occurrences, and its number of pieces."""
    ship(docs.sparkSession)

    def found(held: list[np.ndarray], times: list[np.ndarray], strings: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(strings, pa.string()), pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(times))], names=["token", "hash", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cutter(tokenizer_path)
        if words is None:
            return
        known, times, order, strings = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                pieces, _ = words.cut(data, offsets)
                own, first, n = np.unique(pieces.hashes, return_index=True, return_counts=True)
                at = np.searchsorted(known, own)
                old = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == own) if len(known) else np.zeros(len(own), bool)
                times[at[old]] += n[old]
                new = np.flatnonzero(~old)
                if len(new):
                    made = np.arange(len(strings), len(strings) + len(new))
                    strings += [pieces.string(i) for i in first[new].tolist()]
                    known, times, order = np.insert(known, at[new], own[new]), np.insert(times, at[new], n[new]), np.insert(order, at[new], made)
                if len(strings) >= HELD:
                    yield found([known], [times], [strings[i] for i in order.tolist()])
                    known, times, order, strings = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if strings:
            yield found([known], [times], [strings[i] for i in order.tolist()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoded = cutter(tokenizer_path).tokenizer.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.record_batch([*b.columns, pa.array([len(e) for e in encoded], pa.int64())], names=["token", "hash", "n", "pieces"])

    every = docs.select(F.coalesce(whole_text(text_col), F.lit("")).alias("t")).mapInArrow(gather, "token string, hash long, n long")
    return every.groupBy("token").agg(F.min("hash").alias("hash"), F.sum("n").alias("n")).mapInArrow(count, "token string, hash long, n long, pieces long")


def frequent_counts(words: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and piece counts of the most frequent pre-tokens of a lexicon: those from the lowest power of two of occurrences at which they are no more than ``most``."""
    same = words.groupBy("hash").agg(F.sum("n").alias("n"), F.min("pieces").alias("pieces"), F.max("pieces").alias("_most")).where("pieces = _most and pieces < 65536")
    power = F.floor(F.log2("n")).cast("int")
    left, least = most, 64
    for r in sorted(same.groupBy(power.alias("p")).count().collect(), key=lambda r: -r.p):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.p
    found = same.where(power >= least).select("hash", "pieces").toArrow()
    hashes, pieces = np.asarray(found.column("hash")).view(np.uint64), np.asarray(found.column("pieces")).astype(np.uint16)
    order = np.argsort(hashes)
    return hashes[order], pieces[order]


def frequencies(pieces: Pieces, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of a first occurrence, hash, frequency) of each text's distinct pre-tokens, by text."""
    own, first, code = np.unique(pieces.hashes, return_index=True, return_inverse=True)
    pair, n = np.unique(pieces.texts * max(len(own), 1) + code, return_counts=True)
    text, code = pair // max(len(own), 1), pair % max(len(own), 1)
    return text, first[code], own[code], n


def count_tokens(docs: DataFrame, tokenizer_path: str, keep: list[str | Column], limit: int = 2048, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``keep`` columns of every document, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    no_clash(keep, OUT)
    spark = docs.sparkSession
    ship(spark)
    words = cut(spark, lexicon(docs, tokenizer_path, text_col))
    table = spark.sparkContext.broadcast(frequent_counts(words, frequent))
    rows = docs.select(F.struct(*keep).alias("_keep"), F.coalesce(whole_text(text_col), F.lit("")).alias("_t"))
    schema = rows.select("_keep").schema.add("uid", "long").add("n_bytes", "long").add("known", "long").add("rest", T.ArrayType(T.StructType().add("token", "string").add("n", "long")))
    rest_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (hashes, counts) = cutter(tokenizer_path), table.value
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for start, stop, data, offsets in text_chunks(b.column(1)):
                known, rest = np.zeros(stop - start, np.int64), [[] for _ in range(stop - start)]
                whole = range(stop - start)
                if words is not None:
                    pieces, whole = words.cut(data, offsets)
                    text, first, hashed, n = frequencies(pieces, stop - start)
                    at = np.minimum(np.searchsorted(hashes, hashed), max(len(hashes) - 1, 0))
                    met = hashes[at] == hashed if len(hashes) else np.zeros(len(hashed), bool)
                    known = sums(np.where(met, n * counts[at].astype(np.int64), 0) if len(hashes) else n * 0, np.searchsorted(text, np.arange(stop - start + 1)))
                    for i in np.flatnonzero(~met).tolist():
                        rest[text[i]].append({"token": pieces.string(first[i]), "n": int(n[i])})
                count = words.tokenizer.encode if words is not None else whole_texts(tokenizer_path).count
                for i in whole:
                    t = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
                    known[i] = len(count(t, add_special_tokens=False).ids) if words is not None else count(t)
                yield pa.record_batch(
                    [b.column(0).slice(start, stop - start), pa.array(np.arange(uid, uid + stop - start)), pa.array(np.diff(offsets)), pa.array(known), pa.array(rest, rest_type)],
                    names=["_keep", "uid", "n_bytes", "known", "rest"],
                )
                uid += stop - start

    found = cut(spark, rows.mapInArrow(run, schema))
    rare = found.where(F.size("rest") > 0).select("uid", F.inline("rest")).withColumnRenamed("n", "times")
    more = rare.join(words.select("token", "pieces"), "token").groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    done = found.where(F.size("rest") == 0).withColumn("more", F.lit(0).cast("long")).drop("rest")
    total = done.unionByName(found.where(F.size("rest") > 0).drop("rest").join(more, "uid"))
    tokens = F.col("known") + F.col("more")
    return total.select("_keep.*", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
