"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetwise import runtime
from sheetwise.llm import common, compact_windows, digest_index, fm_index, lang_bloom, mixing, near_texts, quality, simhash, token_store, toxicity, url_trie
from sheetwise.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, score double, fp long, spans string, domain string, _row int, lang_pred string"
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the quick brown fox", "en", "src0"), (2, None, "en", "src0"), (3, "", None, "src1"), (4, "the quick  brown\tfox", "en", None), (4, "the quick  brown\tfox", "en", None),
        (None, "le renard brun", "fr", "src2"), (6, "12 34 !!", "de", "src2"), (7, LONG, "de", "src3"), (8, "der schnelle fuchs", "de", "src0"),
    ]
    return spark.createDataFrame([(*r, 0.5, 1, "x", "d", 3, "zz") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language(docs, none):
    model = lang_bloom.learn_language_filters(docs)
    got = lang_bloom.identify_language(docs, model, ["doc_id"]).collect()
    assert len(got) == 9 and {r.lang_pred for r in got if r.doc_id in (2, 3, 6)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (1, 4)} == {"en"} and {r.lang_pred for r in got if r.doc_id == 7} == {"de"}
    empty = lang_bloom.learn_language_filters(none)
    assert {r.lang_pred for r in lang_bloom.identify_language(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert lang_bloom.identify_language(none, model, ["doc_id"]).count() == 0


def test_digests(spark, docs, none):
    index = digest_index.DigestIndex(spark, "edge_index", 4)
    assert index.deduplicate(none).count() == 0
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.deduplicate(docs).collect()}
    assert {(1, 1, 3, True), (4, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False), (None, None, 1, False)} <= got
    assert index.rows().count() == 6
    later = spark.createDataFrame([(50, "the quick brown fox"), (51, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(later).collect()} == {(50, 1, False), (51, 51, True)}
    assert index.rows().count() == 7


def test_simhash(docs, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert (2, "0" * 16, 2) in got and (3, "0" * 16, 2) in got and {r[2] for r in got if r[0] == 4} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_large_groups_are_dealt_again(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(400)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    of = lambda large: {frozenset(x) for x in groups((r.a, r.b) for r in simhash.near_links(df, large).collect())}
    assert of(20_000) == of(5)


def groups(links):
    out = []
    for a, b in links:
        hit = [g for g in out if a in g or b in g]
        out = [g for g in out if g not in hit] + [{a, b}.union(*hit)]
    return out


def test_mixing(docs, none):
    mix = mixing.Mix({"web": 2}, {"en": 3, "de": 1}, {}, 2, 1, 3)
    args = (F.when(F.col("source") == "src0", "web"), F.col("lang"), F.col("source"))
    got = mixing.mix_sources(docs, mix, *args).select("_row.doc_id", "n_tokens", "epoch").collect()
    assert sum(r.n_tokens for r in got) <= 2 * 30_020 and max(r.epoch for r in got) <= 2
    assert mixing.mix_sources(none, mix, *args).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, language string, origin string, tokens long")
    got = {(r.domain, r.language): r.budget for r in mixing.leaf_budgets(leaves, mixing.Mix(numerator=400, denominator=2010)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "a.net", "/x/"), ("block", "a.net", "/x/y"), ("allow", "tie.org", "/"), ("block", "tie.org", "/")]
    urls = [None, "", "no scheme", "http://A.NET", "http://q.a.net/x/1", "http://a.net/x/yes#f", "http://a.net/z?u=http://b", "http://tie.org/", "http://xnet/", "ftp://u.net//"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["allow", "allow", "allow", "allow", "allow", "block", "block", "block", "allow", "block"]
    for most in (100, 2):
        got = {r.page_id: r for r in url_trie.filter_urls(pages, rules, ["page_id"], max_rules=most).collect()}
        assert [got[i].verdict for i in range(10)] == want
        assert got[3].rule is None and got[3].host == "a.net" and got[5].rule == "a.net/x/y"
    assert url_trie.filter_urls(pages.where("false"), rules, ["page_id"]).count() == 0
    assert {r.verdict for r in url_trie.filter_urls(pages, [], ["page_id"]).collect()} == {"allow"}
    with pytest.raises(ValueError, match="named like"):
        url_trie.filter_urls(pages.withColumn("host", F.lit(1)), rules, ["host"])


def test_very_long_urls(spark):
    """10 MB of one segment, of slashes or of dots: looked up within a second, as a lookup goes no deeper than the rules."""
    trie = url_trie.UrlTrie([("block", "net", "/"), ("allow", "a.net", "/x/"), ("block", "a.net", "/x/yyyy"), ("allow", "a.net", "/x/y")])
    n = 10_000_000
    began = time.time()
    assert trie.match("a.net", "/x/" + "y" * n) == (2, 7, "block", "a.net/x/yyyy")
    assert trie.match("a.net", "/x/y") == (2, 4, "allow", "a.net/x/y")
    assert trie.match("a.net", "/" * n) == (1, 1, "block", "net/")
    assert trie.match("." * n + "net", "/q") == (1, 1, "block", "net/")
    assert time.time() - began < 1
    page = spark.createDataFrame([(1, "http://A.net/x/" + "y" * n + "?q"), (2, "x" * n)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.n) for r in url_trie.filter_urls(page, [("block", "a.net", "/x/yyyy")], ["page_id"]).select("page_id", "verdict", F.length("path").alias("n")).collect()}
    assert got == {1: ("block", n + 3), 2: ("allow", 0)}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}


def test_tokens(spark, docs, none, tmp_path):
    token_store.write_tokens(docs, f"{tmp_path}/a", tokenizer_path(), shard_bytes=20_000)
    rows = sorted(token_store.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 6, 7, 8] and [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert rows[2].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    blob = bytes(spark.read.parquet(f"{tmp_path}/a/shards").first().blob)
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(blob, b"other")
    token_store.write_tokens(none, f"{tmp_path}/b", tokenizer_path())
    assert token_store.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_pieces_equal_whole_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "'s", "'re", "!", "<|endoftext|>", "\xa0", "　", "B", "中", " \n", "\x00", "'", "ll", "'v"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    e = token_store.Encoder(tokenizer_path(), 2)
    raw = [t.encode() for t in texts]
    got = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for g, x in zip(got, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert g == np.array([*x.ids, 2], "<u4").tobytes()


def test_pieces_under_one_hash(monkeypatch):
    """Pre-tokens that differ under one hash, or whose ids do not end where they do, are encoded one by one."""
    texts = ["a bb a, bb", "", "  é a", "bb bb\n"]
    raw = [t.encode() for t in texts]
    args = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = token_store.Encoder(tokenizer_path(), 2).encode(*args)
    monkeypatch.setattr(token_store, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    e = token_store.Encoder(tokenizer_path(), 2)
    e.id_bytes[:] = 1
    assert e.encode(*args) == want


def test_pieces_equal_a_plain_tokenizer():
    """Strings of added tokens, and code points that Unicode versions class differently, against a tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["a", " ", "1", "!", "<|endoftext|>", "<|endof", "text|>", "\u0558", "\ua7ce", "\u0c5c", "\U00011de1", "\U00012475", "\u208f", "é"]
    texts = ["a<|endoftext|>b", "<|endof", "text|>", "", "<|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    got = token_store.Encoder(tokenizer_path(), 2).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got[0] == np.array([64, 50256, 65, 2], "<u4").tobytes()
    for g, x in zip(got, Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)):
        assert g == np.array([*x.ids, 2], "<u4").tobytes()


def brute_contamination(text, items):
    words = fm_index.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = fm_index.words_of((t or "").encode())
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(found - {None})


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination(spark, docs, none, block):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(str(i), words(rng.randint(8, 16))) for i in range(6)] + [("6", ""), ("7", "The Fox"), ("8", "the fox")]
    texts = [(i, words(rng.randint(0, 300)).replace("a", "A", 3) + rng.choice(["", " the, FOX!", " thé fox"])) for i in range(40)] + [(90, None), (91, "")]
    items += [(None, "a b c d a b c d a b"), ("9", None)]  # an item without an id hits like any other
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in fm_index.find_contamination(df, bench, ["doc_id"], block_chars=block, shard_bytes=500).collect()}
    for i, t in texts:
        n, hit, found = brute_contamination(t, items)
        assert (got[i].n_words, sum(s.end - s.start for s in got[i].spans), got[i]["items"]) == (n, hit, found)
    only = bench.where("item_id is null").withColumn("text", F.lit("the fox"))
    hit = fm_index.find_contamination(df, only, ["doc_id"], block_chars=block).where("size(spans) > 0")
    assert hit.count() > 0 and hit.where("size(items) > 0").count() == 0
    with pytest.raises(ValueError, match="named like"):
        fm_index.find_contamination(docs.withColumnRenamed("lang", "n_words"), bench, ["n_words"])
    assert fm_index.find_contamination(none, bench, ["doc_id"]).count() == 0
    assert fm_index.find_contamination(docs, bench.where("false"), ["doc_id"]).count() == 9


def test_spans_are_cut(spark):
    df = spark.createDataFrame([(1, "Keep this. The fox! And this"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    got = {r.doc_id: r.clean_text for r in fm_index.cut_spans(fm_index.find_contamination(df, bench, ["doc_id"])).collect()}
    assert got == {1: "Keep this. ! And this", 2: None}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.learn_toxicity(none, labels.where("false"))
    assert {round(r.score) for r in toxicity.score_toxicity(docs, nothing).collect()} == {0} and toxicity.score_toxicity(none, nothing).count() == 0


def test_passages(spark, docs, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(70)] for _ in range(5)]
    rows = []
    for i in range(60):
        own = list(passages[i % 5])
        if i % 4 == 1:
            own[30] = word()
        middle = own if i % 4 < 2 else []
        rows.append((i, " ".join([word() for _ in range(rng.randint(20, 200))] + middle + [word() for _ in range(rng.randint(20, 100))])))
    rows += [(100, rows[2][1]), (101, None), (None, rows[2][1]), (105, " ".join(passages[0][:30]))]
    got = {r.doc_id: r for r in compact_windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(60):
        assert (got[i].n_repeated >= 66) == (i % 4 < 2 or i == 2)
    assert got[100].class_id == 2 and got[100].n_repeated == got[100].n_words and got[105].n_repeated == 0
    assert {got[i].class_id for i in range(0, 60, 20)} == {0}
    assert compact_windows.near_duplicate_passages(none).count() == 0
    assert compact_windows.near_duplicate_passages(docs).count() == 9


def test_identical_passages_behind_frequent_lines(spark):
    """Passages that two documents share, each around a line that many others have too, against brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(30)]
    rows = []
    for i in range(40):
        p = [word() for _ in range(12)] + line + [word() for _ in range(12)]
        rows += [(2 * i + j, [word() for _ in range(60)] + p + [word() for _ in range(60)]) for j in (0, 1)]
    rows += [(100 + i, [word() for _ in range(60)] + line + [word() for _ in range(60)]) for i in range(40)]
    rows += [(200, [word() for _ in range(50)] + line + [word() for _ in range(50)] + rows[0][1][60:114])]
    where = {}
    for i, w in rows:
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    hit = {i: set() for i, _ in rows}
    for found in where.values():
        if len({i for i, _ in found}) > 1:
            for i, j in found:
                hit[i] |= set(range(j, j + 50))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in compact_windows.near_duplicate_passages(df).collect()}
    for i, _ in rows:
        assert hit[i] <= {j for x in got[i].spans for j in range(x.start, x.end)}
    assert all(got[2 * i].class_id == got[2 * i + 1].class_id for i in range(40)) and got[200].class_id == got[0].class_id
    assert len({got[2 * i].class_id for i in range(40)}) == 40 and all(got[100 + i].n_repeated == 0 for i in range(40))


def test_similar_passages_behind_the_smallest_text(spark):
    """Two passages with a word changed, whose smallest shingles other texts have as well: the group's smallest text is none of the two."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, pairs = [], 12
    for i in range(pairs):
        p = [word() for _ in range(54)]
        q = p[:27] + [word()] + p[28:]
        rows += [(1000 * i + j, [word() for _ in range(60)] + x + [word() for _ in range(60)]) for j, x in ((0, p), (1, q))]
        # The shingles with the smallest hashes of each function, each among words of its own, in twenty texts.
        data = " ".join(p).encode()
        s, _, _ = compact_windows.shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        least = {int(compact_windows.mix(s[:50] ^ seed)[at].argmin()) + int(at.start) for seed in compact_windows.SEEDS for at in (slice(0, 50), slice(0, 23), slice(28, 50))}
        for j in range(20):
            rows.append((1000 * i + 10 + j, [w for x in sorted(least) for w in [word() for _ in range(40)] + p[x : x + 5]] + [word() for _ in range(40)]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in compact_windows.near_duplicate_passages(df).collect()}
    for i in range(pairs):
        assert got[1000 * i].class_id == got[1000 * i + 1].class_id == 1000 * i and got[1000 * i].n_repeated >= 50
    assert all(r.n_repeated == 0 for i, r in got.items() if i % 1000 >= 10)


def test_pairs_of_large_groups_meet_in_cells(spark, monkeypatch):
    """Groups dealt to many cells give the pairs of one cell."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(60)]
    passages = [[word() for _ in range(30)] for _ in range(20)]
    rows = [(i, " ".join([word() for _ in range(60)] + line[i % 5 :] + passages[i % 20] + [word() for _ in range(60)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, compact_windows.near_duplicate_passages(df).collect()))
    monkeypatch.setattr(compact_windows, "CELL", 7)
    assert sorted(map(str, compact_windows.near_duplicate_passages(df).collect())) == want and all("class_id=0," in x for x in want)


def test_texts_of_shared_lines_are_not_written_many_times(spark, monkeypatch):
    """Texts of lines that many others have share very many hashes; no table of them is much larger than the texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = [[word() for _ in range(35)] for _ in range(30)]
    rows = [(i, " ".join(w for x in rng.sample(lines, 20) for w in [*x, word()])) for i in range(120)]
    size, sizes, cut_to = sum(len(t) for _, t in rows), [], runtime.cut_to

    def measured(spark, df):
        made, path = cut_to(spark, df)
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file:")) for f in names))
        return made, path

    monkeypatch.setattr(runtime, "cut_to", measured)
    got = compact_windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 120 and len(sizes) > 5 and max(sizes) < 3 * size, (size, sizes)


def test_runs_of_one_word(spark):
    """Texts with one word very often: each of their windows has the same smallest hashes, which makes them hot in every block."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, [word() for _ in range(40)] + ["ou"] * n + [word() for _ in range(40)]) for i, n in enumerate([160, 106, 60, 200, 52, 9, 9, 9, 130, 75])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(5, "doc_id")
    got = {r.doc_id: {j for x in r.spans for j in range(x.start, x.end)} for r in compact_windows.near_duplicate_passages(df).collect()}
    for i, w in rows:
        n = len(w) - 80
        assert set(range(40, 40 + n)) <= got[i] if n >= 50 else not got[i]


def test_verification_chains_runs_and_searches_them():
    rng = np.random.default_rng(9)
    new = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def found(a, b, shifts):
        edges = np.array([(f, 0, 0, len(a) - 1, 0, s, len(b) - 1) for f in range(2) for s in shifts])
        return compact_windows.verify(a, b, edges, 46, 0.8)

    # Six words inserted into a passage of 90: two runs of 41, ten new items between them in one document, four in the other.
    one, two = new(41), new(41)
    a, b = np.concatenate((one, new(4), two)), np.concatenate((one, new(10), two))
    assert found(a, b, (0, 6)) == [(0, 85, 0, 91)]
    # An identical passage of 60 words next to 60 words of which every seventh differs.
    tail = new(60)
    edited = np.where(np.arange(60) % 7 < 2, tail, new(60))
    same = new(56)
    got = found(np.concatenate((new(9), same, tail)), np.concatenate((new(9), same, edited)), (0,))
    assert any(s <= 9 and e >= 64 for s, e, _, _ in got)
    assert found(new(100), new(100), (0,)) == []


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 62, 300).astype(np.uint64) << np.uint64(1)
    bounds = np.array([0, 120, 120, 300])
    got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(h, bounds, 20))))
    want = set()
    for t in range(3):
        v = h[bounds[t] : bounds[t + 1]]
        for c in range(len(v)):
            low = max([i for i in range(c) if v[i] < v[c]], default=-1) + 1
            high = min([i for i in range(c + 1, len(v)) if v[i] < v[c]], default=len(v)) - 1
            if high - low + 1 >= 20:
                want.add((t, low, c, high))
    assert got == want


def test_hot_hashes_are_dealt_by_block():
    """Every row is shuffled once; of a hash with many rows of several texts, the smallest text's goes under the hash as well."""
    rng = np.random.default_rng(3)
    v = np.concatenate((np.full(500, 7), np.full(300, 9), rng.integers(100, 1 << 60, 200)))
    k = np.concatenate((rng.integers(0, 50, 500), np.full(300, 4), rng.integers(0, 50, 200)))
    row, dealt, hot = compact_windows.deal_hot(v, k, 5)
    assert sorted(row.tolist()) == sorted([*range(1000), int(row[-1])]) and k[row[-1]] == k[:500].min() and dealt[-1] == 7
    where = dict(zip(row[:-1].tolist(), dealt[:-1].tolist()))
    assert len({where[i] for i in range(500)}) == 1 and where[0] != 7 and all(where[i] == v[i] for i in range(500, 1000))
    assert hot.sum() == 501 and hot[-1] and {int(i) for i in row[hot]} == set(range(500))
    assert (compact_windows.deal_hot(v[800:], k[800:], 1)[1] == v[800:]).all() and len(compact_windows.deal_hot(v[:0], k[:0], 1)[0]) == 0


def test_abandoned_words_and_pairs():
    """In one group of 2,000 fingerprints: the pairs and distances of brute force, and most words are abandoned before the last plane."""
    rng = random.Random(11)
    for wide, radius in ((1, 2), (4, 56)):
        base = rng.getrandbits(64 * wide)
        fps = {rng.getrandbits(64 * wide) for _ in range(1700)} | {base ^ sum(1 << b for b in rng.sample(range(64 * wide), rng.randint(1, radius))) for _ in range(300)}
        f = np.array([[x >> 64 * j & 0xFFFFFFFFFFFFFFFF for j in range(wide)] for x in fps], np.uint64)
        counted = []
        got = {(int(i), int(j), int(d)) for one, two, dist in simhash.near_pairs(f, np.full(len(f), len(f)), radius, None, counted) for i, j, d in zip(one, two, dist)}
        dist = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2, dtype=int)
        assert got == {(int(i), int(j), int(dist[i, j])) for i, j in zip(*np.nonzero(dist <= radius)) if i < j}
        assert sum(counted) > 0.7 * len(f) ** 2 / 128
    # Groups one after the other meet only within themselves.
    last = np.repeat([700, 701, 1500, len(f)], [700, 1, 799, len(f) - 1500])
    own = {(int(i), int(j)) for one, two, _ in simhash.near_pairs(f, last, 56) for i, j in zip(one, two)}
    assert own == {(i, j) for i, j, _ in got if last[i] == last[j]}


def brute_texts(texts, similarity=0.8):
    """Component of each text by the Jaccard similarity of five-word shingles, of all pairs."""
    words = [tuple(re.findall("[^\x20\x09-\x0D]+", (t or "").lower())) for t in texts]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("large", [1 << 14, 8])
def test_near_texts_against_brute_force(spark, docs, none, large):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(30):
        own = [word() for _ in range(rng.randint(3, 250))]
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 8)):
            copy = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                i = rng.randrange(len(copy))
                copy[i : i + rng.randint(0, 1)] = [word() for _ in range(rng.randint(0, 2))]
            texts.append(" ".join(copy))
    texts += [None, "", " \t", "one two", "ONE  two"]
    want = brute_texts(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicate_texts(df, large=large).collect()}
    wrong = [i for i in range(len(texts)) if got[i] != want[i]]
    assert len(set(want)) > 30 and len(wrong) <= 0.01 * len(texts)
    # No text is linked to one that brute force does not reach.
    assert all(want[got[i]] == want[i] for i in range(len(texts)))
    assert near_texts.near_duplicate_texts(none).count() == 0
    rows = {(r.doc_id, r.component_id) for r in near_texts.near_duplicate_texts(docs).collect()}
    assert {(1, 1), (2, 2), (3, 2), (4, 1), (None, None), (7, 7)} <= rows


def test_passages_of_the_small_tables(spark):
    """Recall of exact runs of 50 words or more is 1, and that of near repeats, by verification of all pairs on all diagonals, at least 0.98."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
    got = {r.doc_id: {j for x in r.spans for j in range(x.start, x.end)} for r in compact_windows.near_duplicate_passages(rows).collect()}
    words = {i: re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    where = {}
    for i, w in words.items():
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    exact = {i: set() for i in texts}
    for found in where.values():
        if len({i for i, _ in found}) > 1:
            for i, j in found:
                exact[i] |= set(range(j, j + 50))
    assert sum(map(len, exact.values())) > 50_000
    assert all(exact[i] <= got[i] for i in texts)
    items, holders, common_items = {}, {}, Counter()
    for i, w in words.items():
        items[i] = np.array([zlib.crc32(" ".join(w[j : j + 5]).encode()) for j in range(max(0, len(w) - 4))], np.uint32)
        for x in np.unique(items[i]).tolist():
            holders.setdefault(x, []).append(i)
    for own in holders.values():
        common_items.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    near = {i: set() for i in texts}
    for (i, j), n in common_items.items():
        if n >= 37:
            a, b = items[i], items[j]
            shifts = {int(y - x) for x in range(len(a)) for y in np.flatnonzero(b == a[x])}
            edges = np.array([(f, 0, 0, len(a) - 1, 0, d, len(b) - 1) for f in range(2) for d in sorted(shifts)])
            for s, e, s2, e2 in compact_windows.verify(a, b, edges, 46, 0.8):
                near[i] |= set(range(s, e + 5))
                near[j] |= set(range(s2, e2 + 5))
    with_near = [i for i in texts if near[i]]
    assert len(with_near) > 150 and sum(bool(got[i]) for i in with_near) >= 0.98 * len(with_near)
    assert sum(len(near[i] & got[i]) for i in texts) >= 0.98 * sum(map(len, near.values()))
    assert sum(bool(got[i]) and not near[i] and not exact[i] for i in texts) <= 3


def test_filters_against_sets(spark):
    """The filter returns every language that contains an n-gram, and few more; counts and predictions are those of plain sets."""
    rng = random.Random(14)
    rows = [(i, "".join(rng.choice("abcdefgh "[j % 2 :]) for j in range(200)), "xy"[i % 2]) for i in range(40)] + [(50, "zzz", None), (51, None, "x")]
    model = lang_bloom.learn_language_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=12)

    def grams(t):
        padded = [" ", *t, " "]
        return [tuple(c if c.isalpha() else " " for c in padded[i - 1 : i + 2]) for i in range(1, len(padded) - 1) if padded[i].isalpha()]

    held = {lang: Counter(g for _, t, x in rows if x == lang and t for g in grams(t)) for lang in "xy"}
    every = sorted(set(held["x"]) | set(held["y"]) | set(grams("the quick brown fox jumps over a lazy dog")))
    point = lambda c: 0 if c == " " else ord(c)
    codes = np.array([point(a) << 42 | point(b) << 21 | point(c) for a, b, c in every])
    mask = model.lookup(codes)[0]
    false = 0
    for i, lang in enumerate(model.languages):
        has = [(int(m) >> i) & 1 for m in mask]
        assert all(h for g, h in zip(every, has) if held[lang][g])
        false += sum(h for g, h in zip(every, has) if not held[lang][g])
    assert false <= 0.2 * len(every)
    text = rows[3][1]
    data = np.frombuffer(text.encode(), np.uint8)
    best, score, cover = model.predict(data, np.array([0, len(data)]), np.zeros(2))
    hits = [sum((int(model.lookup(np.array([point(a) << 42 | point(b) << 21 | point(c)]))[0][0]) >> i) & 1 for a, b, c in grams(text)) for i in range(2)]
    assert best[0] == int(np.argmax(hits)) and score[0] == pytest.approx(max(hits) / sum(hits)) and cover[0] == pytest.approx(max(hits) / len(grams(text)))


def test_subword_bags_against_plain_python():
    texts = ["Bad baad BAD word", "", "é! x", "one-two three three3", "a" * 300]
    raw = [t.encode() for t in texts]
    got = list(toxicity.bags(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    for t, (ids, shares) in zip(raw, got):
        folded = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in t)
        bag = Counter()
        for w in set(folded.split()):
            w = b" " + w + b" "
            for size in toxicity.SIZES:
                for i in range(len(w) - size + 1):
                    h = w[i]
                    for c in w[i + 1 : i + size]:
                        h = (h * 0x01000193 + c) & 0xFFFFFFFF
                    bag[(((h ^ (size * 0x27D4EB2F)) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)] += 1
        n = sum(bag.values()) + toxicity.PAD
        assert dict(zip(np.frombuffer(ids, np.int32).tolist(), np.frombuffer(shares, np.float32).tolist())) == pytest.approx({b: x / n for b, x in bag.items()})


@pytest.mark.parametrize("words", [3, 60_000])
def test_word_vectors_against_plain_python(spark, words):
    """Random-indexing sums over whole texts, with words of their own and words that share a vector."""
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd!", "e"]) for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vocabulary = quality.learn_vocabulary(df, words=words)
    tokens = [re.findall("[a-z]+|!", t or "") for t in texts]
    hashed = {w: int(common.token_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for own in tokens for w in own}
    counts = Counter(w for own in tokens for w in own)
    top = sorted(counts, key=lambda w: (-counts[w], hashed[w] - (1 << 64) * (hashed[w] >> 63)))[:words]
    assert vocabulary.words.tolist() == sorted(hashed[w] for w in top)
    row = {w: vocabulary.words.tolist().index(hashed[w]) if w in top else len(vocabulary.words) + (hashed[w] >> (64 - quality.RARE_BITS)) for w in counts}
    places, signs = quality.index_vectors(len(vocabulary))
    want = np.zeros((len(vocabulary), quality.DIMS))
    for own in tokens:
        for i, w in enumerate(own):
            for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if j != i:
                    np.add.at(want[row[w]], places[row[own[j]]], signs[row[own[j]]])
    known = want.any(axis=1, keepdims=True)
    want -= want.sum(axis=0) / known.sum() * known
    want /= np.maximum(1e-9, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.allclose(quality.learn_word_vectors(df, vocabulary), want, atol=1e-4)


def test_bytes_that_are_no_utf8(spark, docs):
    """Each operator works on them as its docstring says."""
    bad = spark.sql("select 1L as doc_id, cast(x'61FF6263' as string) as text, 'en' as lang, 'src0' as source, cast(x'687474703A2F2F61FF2F' as string) as url union all select 2L, 'abc', 'en', 'src0', 'http://b/'")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = lang_bloom.learn_language_filters(bad)
    assert lang_bloom.identify_language(bad, model, ["doc_id"]).count() == 2
    assert simhash.near_duplicates(bad).count() == 2 and near_texts.near_duplicate_texts(bad).count() == 2
    assert mixing.mix_sources(bad, mixing.Mix(numerator=1, denominator=1), F.lit("d"), F.col("lang"), F.col("source")).count() == 2
    assert {r.host for r in url_trie.filter_urls(bad, [("block", "b", "/")], ["doc_id"]).collect()} == {"a\ufffd", "b"}
    assert quality.score_quality(bad, labels).count() == 2
    assert toxicity.score_toxicity(bad, toxicity.learn_toxicity(bad, labels)).count() == 2
    assert compact_windows.near_duplicate_passages(bad).count() == 2
    assert fm_index.cut_spans(fm_index.find_contamination(bad, spark.createDataFrame([(1, "abc")], "item_id long, text string"), ["doc_id"])).count() == 2
    path = token_store.new_store_path(spark)
    token_store.write_tokens(bad, path, tokenizer_path())
    assert token_store.read_tokens(spark, path).count() == 2
    assert digest_index.DigestIndex(spark, "bad_index", 4).deduplicate(bad).count() == 2


def test_training_rows_are_bounded_and_the_same_each_time(spark):
    """A labelled id that very many rows share gives no more than the stated rows and bytes, whatever the order of the input."""
    rng = random.Random(16)
    rows = [(5 if i % 2 else i, " ".join(rng.choice(["bad", "good", "fine", "word"]) + str(i % 7) for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i == 5)) for i in range(300)], "doc_id long, toxic int")
    models = []
    for seed in (1, 2):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(1 + seed)
        models.append(toxicity.learn_toxicity(df, labels, sample=40, max_bytes=60_000))
    assert np.array_equal(models[0].weight, models[1].weight) and models[0].bias == models[1].bias
    quality_rows = labels.withColumnRenamed("toxic", "quality")
    scores = [
        {(r.doc_id, round(r.score, 9)) for r in quality.score_quality(spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string"), quality_rows, sample=50).collect()}
        for seed in (1, 2)
    ]
    assert scores[0] == scores[1]


def test_near_dedup_stage(spark, docs, none):
    """Copies and repeated rows leave one document; rows without an id and unlike rows that share an id stay."""
    more = spark.createDataFrame([(9, "alpha beta gamma delta"), (9, "one two three four five"), (None, "the quick brown fox")], "doc_id long, text string")
    rows = docs.withColumn("_kept", F.lit(1)).unionByName(more, allowMissingColumns=True)
    got = corpus_pipeline.near_dedup(spark, rows, "")
    assert got.columns == rows.columns
    found = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in got.collect())
    assert found == [(0, "le renard"), (0, "the quick"), (1, "the quick"), (2, ""), (6, "12 34 !!"), (7, "wort0 wor"), (8, "der schne"), (9, "alpha bet"), (9, "one two t")]
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0


def test_other_stages_edge_cases(spark, docs, none):
    """Nulls, repeated rows, empty tables, columns named like the operators' own, and two columns of one name, through the other four stages."""
    sf = "/root/testdata/sf0.001"
    rows = docs.withColumns({"_text": F.lit(1), "n_words": F.lit(2), "coverage": F.lit(3), "origin": F.lit("o"), "epoch": F.lit(4)})
    kept = corpus_pipeline.language_id(spark, rows, sf)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 7]
    clean = corpus_pipeline.decontaminate(spark, rows, sf)
    assert clean.columns == rows.columns and clean.count() == 9
    chosen = corpus_pipeline.mix(spark, rows, sf)
    assert chosen.columns == rows.columns and chosen.count() <= 9
    # Rows that share an id are taken together or not at all.
    assert chosen.where("doc_id = 4").count() in (0, 2)
    got = corpus_pipeline.tokens(spark, rows, sf).collect()
    assert len(got) == 9 and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
    twice = docs.select("*", F.lit(1).alias("more"), F.lit(2).alias("more"))
    assert corpus_pipeline.mix(spark, twice, sf).columns == twice.columns
    assert corpus_pipeline.near_dedup(spark, twice, sf).columns == twice.columns
    assert corpus_pipeline.tokens(spark, twice, sf).count() == 9


def test_memory_of_pairs_with_very_many_diagonals():
    """Two texts with one line 100 times each: the diagonals, 1.4 million places, are gone through in parts, with the same runs as all at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    a, b = (np.concatenate([np.concatenate((np.arange(30), rng.integers(100, 1 << 30, 40))) for _ in range(100)]).astype(np.uint32) for _ in range(2))
    b[3000:3100] = a[3000:3100]
    at = np.arange(100) * 70
    x, y = (z.ravel() for z in np.meshgrid(at, at))
    edges = np.concatenate([np.stack((np.full(len(x), f), np.maximum(x - 40, 0), x + f, np.minimum(x + 100, len(a) - 1), np.maximum(y - 40, 0), y + f, np.minimum(y + 100, len(b) - 1)), axis=1) for f in range(2)])
    tracemalloc.start()
    found = compact_windows.verify(a, b, edges, 46, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert any(s <= 3000 and e >= 3099 and s2 <= 3000 and e2 >= 3099 for s, e, s2, e2 in found)
    every = compact_windows.PLACES
    try:
        compact_windows.PLACES = 1 << 30
        assert compact_windows.verify(a, b, edges, 46, 0.8) == found
    finally:
        compact_windows.PLACES = every


def test_near_texts_behind_nearer_ones_that_fail(spark):
    """A text whose nearest by fingerprint are just not similar enough, and a further one that is; with and without pairs of cells, against brute force."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(400)]
        # Of 396 shingles, 8 words changed leave 0.8165, 9 words 0.796.
        for n in [0, 8, *[9] * 40]:
            own = list(base)
            for i in rng.sample(range(5, 395, 6), n):
                own[i] = word()
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    assert sum(w != i for i, w in enumerate(want)) >= 6
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for large in (near_texts.LARGE, 16):
        assert {r.doc_id: r.component_id for r in near_texts.near_duplicate_texts(df, large=large).collect()} == dict(enumerate(want))
