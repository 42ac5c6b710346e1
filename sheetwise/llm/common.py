"""Helpers that the corpus operators share: id remainders, and texts as byte arrays in bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that an operator turns into arrays at once (one longer document makes a chunk of its own).
CHUNK = 1 << 18
#: Rows of sorted groups that a task works on at once (or one larger group).
ROWS = 1 << 15


def whole_text(col: str) -> Column:
    """A text column; bytes that are no UTF-8 become U+FFFD, so that code points and offsets fit each other."""
    return F.make_valid_utf8(F.col(col).cast("string"))


def no_clash(keep: list[str | Column], out: tuple[str, ...]) -> None:
    """An error if a kept column has the name of one of the result's own."""
    names = {k for k in keep if isinstance(k, str)}
    if names & set(out):
        raise ValueError(f"kept columns {sorted(names & set(out))} are named like columns of the result")


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def text_chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, past the last, their UTF-8 bytes, offsets of each) of ``limit`` bytes or one row.

    A null text counts as empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def sums(values: np.ndarray, bounds: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i; empty slices give zero."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets as code points and code point offsets."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[offsets]


#: Odd multiplier of the polynomial hash of a token's bytes, and its inverse modulo 2**64.
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
#: Byte kinds: 0 white space or control, 1 part of a word, 2 sign.
KINDS = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, x in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[starts[i]:ends[i]]``, none of them empty."""
    up, down = _power(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def token_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = KINDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each token, token offsets of the texts); a token is a run of bytes of one kind but 0."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = kinds[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    token = kind[starts] != 0
    starts, ends = starts[token], ends[token]
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group (equal first ``keys`` columns) ends, ``ROWS`` rows or one group at a time."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        total += b.num_rows
        if total >= ROWS:
            t = pa.Table.from_batches(held)
            tail = [t.column(i)[-1].as_py() for i in range(keys)]
            other = np.zeros(t.num_rows, bool)
            for i, x in enumerate(tail):
                other |= np.asarray(t.column(i)) != x
            done = np.flatnonzero(other)
            if len(done):
                yield t.slice(0, int(done[-1]) + 1)
                t = t.slice(int(done[-1]) + 1)
            held, total = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)
