"""URL filter rules in a trie over reversed host labels and path segments, with longest-match precedence.

A rule is (verdict, host, path prefix). It fits its host and all subdomains, if the URL's path starts with the
rule's. Of the rules that fit, the one with the most host labels wins, then the one with the longest path; of rules for
the same host and path, block wins over allow.

The trie is broadcast. It holds ``max_rules`` rules at most; a longer list becomes several tries, which the rows pass
one after the other, each keeping the longest match so far. So a broadcast never outgrows its bound.

A lookup looks at no more of a URL than the rules go deep, so a very long URL costs what splitting off its host and path costs.

Edge cases: a null or empty URL, or one without ``://``, has an empty host and path and gets the default verdict, as does any URL
that no rule fits. Labels and segments may be empty (``a..b``, ``//``) and count as such. Bytes that are no UTF-8 count as U+FFFD. Repeated rows
have the same result each. An empty table gives an empty one, and an empty list of rules the default verdict. Extra columns are kept only if asked for in
``keep``; one of them that is named like a column of the result is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import no_clash, whole_text
from sheetwise.runtime import cut, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
FOLD = str.maketrans(UPPER, LOWER)
#: Columns of the result beside those kept.
OUT = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Nodes are dicts. Key ``None`` of a host node leads to its path trie; key ``None`` of a path node to its prefixes.

    A rule's path ends in a prefix of one segment (empty after a final ``/``), so whole segments are edges and the
    last piece is looked up among the node's prefixes. Key ``LENGTHS`` of the prefixes has their lengths, longest first.
    """

    LENGTHS = 0

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        every: list[dict] = []
        for verdict, host, path in rules:
            if verdict not in VERDICTS:
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            host = host.translate(FOLD)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, tail = path.split("/")
            for s in segments:
                node = node.setdefault(s, {})
            tails = node.setdefault(None, {})
            if not tails:
                every.append(tails)
            if tails.get(tail, ("",))[0] != "block":
                tails[tail] = (verdict, host + path)
        for tails in every:
            tails[self.LENGTHS] = sorted({len(t) for t in tails}, reverse=True)

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, verdict, rule) of the longest rule that fits, or None."""
        best, node, depth, end = None, self.root, 0, len(host)
        while end >= 0 and host:
            dot = host.rfind(".", 0, end)
            node = node.get(host[dot + 1 : end])
            if node is None:
                break
            depth, end = depth + 1, dot
            found = self._path(node[None], path) if None in node else None
            if found:
                best = (depth, *found)
        return best

    @classmethod
    def _path(cls, node: dict, path: str) -> tuple[int, str, str] | None:
        best, start = None, 0
        while node is not None:
            tails = node.get(None)
            for n in tails[cls.LENGTHS] if tails else ():
                part = path[start : start + n]
                if part in tails:
                    best = (start + len(part), *tails[part])
                    break
            slash = path.find("/", start)
            if slash < 0:
                break
            node, start = node.get(path[start:slash]), slash + 1
        return best


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], keep: list[str], url_col: str = "url", default: str = "allow", max_rules: int = 200_000
) -> DataFrame:
    """``keep`` columns of every row with ``host``, ``path``, ``rule`` (``host`` + path prefix, or null) and ``verdict``."""
    spark = pages.sparkSession
    ship(spark)
    no_clash(keep, (*OUT, "_labels", "_length"))
    url = whole_text(url_col)
    rows = pages.select(*keep, url_host(url).alias("host"), url_path(url).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("_labels"), F.lit(-1).alias("_length"))
    schema = rows.schema
    block: list[tuple[str, str, str]] = []

    def passed(df: DataFrame, some: list[tuple[str, str, str]]) -> DataFrame:
        trie = spark.sparkContext.broadcast(UrlTrie(some))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = trie.value
            for b in batches:
                n = b.num_columns - 6
                host, path, rule, verdict, labels, length = (b.column(n + i).to_pylist() for i in range(6))
                for i, (h, p) in enumerate(zip(host, path)):
                    m = t.match(h, p)
                    if m and (m[:2] > (labels[i], length[i]) or m[:2] == (labels[i], length[i]) and m[2] == "block"):
                        labels[i], length[i], verdict[i], rule[i] = m
                made = [pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(labels, pa.int32()), pa.array(length, pa.int32())]
                yield pa.record_batch([*b.columns[: n + 2], *made], names=b.schema.names)

        return df.mapInArrow(run, schema)

    for r in rules:
        block.append(r)
        if len(block) == max_rules:
            rows, block = cut(spark, passed(rows, block)), []  # written, so that a task holds one block's trie
    if block:
        rows = passed(rows, block)
    return rows.drop("_labels", "_length")
