"""Whitening, prefix trie and token counts: against brute force and the library, and edge cases."""

import hashlib
import math
import random
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import digest_index, mixing, prefix_trie, queries, token_counts, token_store, toxicity, whitening
from test_queries import SF, SMALL, table


# Whitening -------------------------------------------------------------------------------------------------------------------

def brute_whitening(rows):
    """(fit list, S, V as exact fractions) of usable vectors."""
    xs = {tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in rows}
    n, d = len(xs), len(next(iter(xs)))
    s = [sum(x[i] for x in xs) for i in range(d)]
    return xs, s, [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs), n**3) for j in range(d)] for i in range(d)]


def check_whitening(got, vectors, components=16):
    """``got``: rows of op11; ``vectors``: vec_id -> usable vector, all of one length."""
    xs, s, v = brute_whitening(list(vectors.values()))
    n, d = len(xs), len(s)
    exact = np.array([[float(c) for c in r] for r in v])
    e = np.linalg.eigvalsh(exact)[::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(vectors) and all(sorted(c) == list(range(1, min(components, d) + 1)) for c in by.values())
    w, centre = [], []
    for i, vector in vectors.items():
        x = [math.floor(64 * float(c)) + 1_000_000 for c in vector]
        for r in by[i].values():
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s))
            assert abs(r.explained - e[r.component - 1] / sum(e)) <= 1e-9 and r.identity_error < 1e-9
        w.append([by[i][k].whitened for k in sorted(by[i])])
        centre.append([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
    axes = np.linalg.lstsq(np.array(centre), np.array(w) * np.sqrt(e[: len(w[0])]), rcond=None)[0]
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-8) and np.allclose(exact @ axes, axes * e[: axes.shape[1]], atol=1e-8 * e[0])


def test_whitening_brute_force(spark):
    check_whitening(queries.op11_whitening(spark, SF).collect(), {r["vec_id"]: r["embedding"] for r in table(SF, "embeddings")})


VECTORS = "vec_id long, embedding array<double>, component int, n string"


def test_whitening_edges(spark):
    rng = random.Random(3)
    good = {i: [rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 1e-1)] for i in range(40)}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [1.0, float("inf"), 1.0]), (104, []), (105, [float("-inf")] * 3)]
    copies = [(200 + i, good[0]) for i in range(50)]
    rows = [*good.items(), *bad, *copies, (200, good[0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    got = whitening.whitened(df, ["vec_id"]).collect()
    assert sum(r.vec_id == 200 for r in got) == 6
    check_whitening(got, good | dict(copies))
    assert whitening.whitened(df.where("false"), ["vec_id"]).count() == 0
    assert whitening.whitened(df.where("vec_id >= 100"), ["vec_id"]).count() == 0  # one distinct vector: no direction varies
    assert whitening.whitened(df.where("vec_id between 100 and 104"), ["vec_id"]).count() == 0
    null_id = whitening.whitened(df.withColumn("vec_id", F.lit(None).cast("long")), ["vec_id"])
    assert null_id.count() == 3 * 91
    with pytest.raises(ValueError, match="named like"):
        whitening.whitened(df, ["n"])


def test_whitening_lengths_apart_and_wild_values(spark):
    two = {i: [float(i % 7), float(i * i % 11)] for i in range(30)}
    wild = {50: [1e300, 1.0, 2.0], 51: [-1e300, 3.0, 1.0], 52: [2.5, 1e17, 9.0], 53: [0.0, 0.0, 0.0]}
    got = whitening.whitened(spark.createDataFrame([(i, v, 1, "x") for i, v in (two | wild).items()], VECTORS), ["vec_id"]).collect()
    check_whitening([r for r in got if r.vec_id < 50], two)
    limited = {i: [max(-(2.0**62), min(2.0**62, c * 64)) / 64 for c in v] for i, v in wild.items()}
    xs, s, v = brute_whitening(list(limited.values()))
    far = [r for r in got if r.vec_id == 53 and r.component == 1]
    assert len(far) == 1 and far[0].deviation is None or far[0].deviation == sum((4 * 1_000_000 - b) ** 2 for b in s)


def test_polarised_sums_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 2**20, 2**40, 2**62):
        y = rng.integers(-size, size, (37, 5))
        exact = y.astype(object)
        want = [int(((exact[:, i] + (exact[:, j] if i != j else 0)) ** 2).sum()) for i, j in whitening.pair_places(5)]
        assert whitening.polarised_squares(y) == want
        n, rest = len(y), [int(c) for c in exact.sum(axis=0)]
        v, trace = whitening.covariance(5, n, want, rest)
        dev = [[Fraction(int(sum((n * a - rest[i]) * (n * b - rest[j]) for a, b in zip(exact[:, i], exact[:, j]))), n**3) for j in range(5)] for i in range(5)]
        assert all(v[i, j] == float(dev[i][j]) for i in range(5) for j in range(5)) and trace == float(sum(dev[i][i] for i in range(5)))


def test_packing_round_trip():
    rows = np.array([[0, 1, -1], [127, -128, 0], [128, 0, 0], [2**15, 0, 0], [-(2**31), 2**31 - 1, 5], [2**31, 0, 1], [2**62, -(2**62), 3]])
    packed = whitening.pack(rows + 7, 7)
    assert [p[0] for p in packed] == [1, 1, 2, 4, 4, 8, 8] and (whitening.unpack(packed, 3, 7) == rows + 7).all()


# Prefix trie -----------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    """Nodes of op12 from (conv_id, turn, role, text) rows without ties of turns of different content."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    total = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves = sum(total[b][0] for b in below) if below else 1
        total[path] = leaves, sum(total[b][1] for b in below) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
    return {
        (len(path), min(m)): (min(nodes[path[:-1]]) if path else None, len(m), len(children.get(path, [])), *total[path], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(path)).encode()).hexdigest())
        for path, m in nodes.items()
    }


def nodes_of(df):
    rows = df.collect()
    got = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


TURNS = "conv_id long, turn long, role string, text string, size int, key string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def many_turns():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "größe"])) for c in range(-120, 400, 3) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(4)]  # a large group of copies
    rows += [(5000, t, None, None if t % 7 else "long") for t in range(900)]  # one endless conversation
    return rows + [(None, 1, "user", "lost"), (700, None, "user", "first"), (700, 3, "bot", "last"), (701, 1, None, ""), (701, 1, None, "")]


def test_trie_matches_sql(compare):
    compare("op12_prefix_trie")
    compare("op12_prefix_trie", "sf0.01")


@pytest.mark.parametrize("limit, band, most", [(None, 100_000, 1 << 18), (40, 7, 5), (10**9, 3, 1 << 18), (1, 16, 64)])
def test_trie_brute_force(spark, limit, band, most):
    """Shards, bands and spilling queues of any size give the same nodes."""
    rows = many_turns()
    random.Random(1).shuffle(rows)
    assert nodes_of(prefix_trie.prefix_trie(conversations(spark, rows), limit, band, most)) == brute_trie(rows)


def test_trie_edges(spark):
    assert prefix_trie.prefix_trie(conversations(spark, []).where("false")).count() == 0
    lost = [(None, 1, "user", "x")]
    assert prefix_trie.prefix_trie(conversations(spark, lost)).count() == 0
    empty = [(1, 1, "user", "x" * 1_000_000), (2, 1, None, None)]  # all turns of 1 and 2 lie below their shared part or are their own
    assert nodes_of(prefix_trie.prefix_trie(conversations(spark, empty))) == brute_trie(empty)


def test_queue_spills():
    rng = random.Random(2)
    queue, sent = prefix_trie.MessageQueue(16), {}
    for _ in range(3000):
        node = (-rng.randrange(1, 9), rng.randrange(40))
        m = tuple(rng.randrange(100) for _ in range(3))
        queue.push((*node, *m))
        sent[node] = tuple(a + b for a, b in zip(sent.get(node, (0, 0, 0)), m))
    assert len(queue.runs) > 100
    assert {n: queue.take(*n) for n in sorted(sent)} == sent and queue.take(0, 0) == (0, 0, 0)


# Token counts ----------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer_path())


ODD = [
    None, "", " \n\t", "it's we'll YOU'RE 'tis ''s !'s o'clock don'T", "été ÉTÉ", "İstanbul STRASSE ß Σας", "a<|endoftext|>b <|startoftext|>", "<|END", "12345 ½ ² ٣", "中文字 한국어 한",
    "क्षि ไทย יִ", "🙂🙂 👩‍💻 eͅ", "\x00\x85​　x", "x" * 300_000, "zwölf " * 5000, "'", "'l", "'ll", "tail '",
]


def test_token_counts_match_the_library(spark, library):
    docs = table(SF, "documents")
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(e.ids)) for d, e in zip(docs, library.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False))}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op13_token_counts(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [0, 7, token_counts.FREQUENT])
def test_token_counts_edges(spark, library, frequent):
    """Through the shuffled join, both joins and the broadcast table."""
    rows = [*enumerate(ODD), (3, "again it's"), (3, "again it's"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, uid int, rest string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, queries.word_tokenizer_path(), ["doc_id", "uid"], frequent=frequent).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((i if i is not None else -1, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n))
    assert token_counts.count_tokens(df.where("false"), queries.word_tokenizer_path(), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(spark, name):
    """Tokenizers of another kind encode whole texts."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert token_counts.cutter(path) is None
    encode = SentencePieceProcessor(model_file=path).encode if name.endswith("model") else lambda t: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    texts = ["it's <|endoftext|>", "", "two  words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path, ["doc_id"]).collect()} == {i: len(encode(t)) for i, t in enumerate(texts)}


def test_newer_queries_are_registered():
    import __spark_entry__ as entry

    assert {"op11_whitening", "op12_prefix_trie", "op13_token_counts"} <= set(entry.queries()) and "op12_prefix_trie" in entry.oracle_sql()


# Ties in mixing, and the digest index over batches ---------------------------------------------------------------------------

@pytest.mark.parametrize("hot, same, seeds", [(None, 400, 20), (7, 1000, 2), (None, 1000, 2), (None, 0, 1)])
def test_mixing_meets_its_budget_whatever_the_ids(spark, hot, same, seeds):
    """1,000 equal rows of one leaf, some or all of them without an id or with one id: whole rows up to the budget."""
    rows = [(hot if i < same else i, "a b c d e f g h i j", i % 2 if hot else 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(4)
    for seed in range(seeds):
        mix = mixing.Mix(numerator=3005, denominator=10_000, seed=seed)
        got = mixing.mix_sources(df, mix, F.lit("d"), F.lit("l"), F.lit("s")).agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")).first()
        assert (got.n, got.e) == (3000, 0)


def test_mixing_takes_rows_of_one_place_as_the_sql_does(spark):
    """Repeated rows over two epochs: as many rows of each id as the SQL takes."""
    import duckdb

    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a b", "a b c", "", None]), rng.choice(["en", "de"]), "src0", 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for seed in range(6):
        mix = mixing.Mix({}, {"en": 3}, {}, 11, 10, 2, seed)
        got = queries.mixed(df, mix).groupBy("_row.doc_id", "_row.text", "language", "epoch").count().collect()
        c = duckdb.connect()
        c.register("documents", df.toArrow())
        want = c.sql(f"with {queries.mix_ctes(mix, 'documents')} select doc_id, text, language, epoch, count(*) from (select *, unnest(range(times)) as epoch from taken) group by all").fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want


def test_digest_index_over_batches_compacted(spark):
    name = "batches_index"
    index = digest_index.DigestIndex(spark, name, 3)
    rows = [(i, f"text  {i % 17}" if i % 2 else f"text {i % 17}", "x") for i in range(100)] + [(None, "text 3", "x"), (None, None, "x"), (55, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    files = lambda: len([r for r in index.rows().select(F.input_file_name().alias("f")).distinct().collect()])
    parts = [index.add(df.where(F.coalesce(F.col("doc_id") % 3, F.lit(0)) == k)) for k in (2, 1, 0)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.over_batches(*parts).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(" ".join((t or "").split(" ")).replace("  ", " "), []).append(i)
    want = {(i, min((x for x in g if x is not None), default=None), len(g), i is not None and i == min(x for x in g if x is not None)) for g in groups.values() for i in g}
    assert got == want
    held, before = sorted(map(tuple, index.rows().collect())), files()
    index.compact()
    assert sorted(map(tuple, index.rows().collect())) == held and files() <= 3 < before
    again = index.deduplicate(df)
    assert again.where("kept").count() <= 18 and index.rows().count() == len(held)
    with pytest.raises(ValueError, match="3 buckets"):
        digest_index.DigestIndex(spark, name, 4)
    index.drop()


# Windows and the parting score of toxicity -----------------------------------------------------------------------------------

def test_toxicity_windows_by_brute_force():
    rng = random.Random(9)
    texts = ["", "one", " two  words ", "", *(" ".join(rng.choice(["ab", "c-d", "é", "x1"]) for _ in range(rng.randrange(0, 60))) for _ in range(30)), "tail"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    fine, at = toxicity.windows(data, offsets, 7)
    assert len(at) == len(texts) + 1 and at[-1] == len(fine) - 1
    for i, text in enumerate(texts):
        words = "".join(chr(b) if b < 128 and chr(b).isalnum() or b >= 128 else " " for b in raw[i]).split()
        got = [bytes(data[a:b]) for a, b in zip(fine[at[i] : at[i + 1]], fine[at[i] + 1 : at[i + 1] + 1])]
        assert b"".join(got) == raw[i] and len(got) == max(1, -(-len(words) // 7))
        own = [len("".join(chr(b) if b < 128 and chr(b).isalnum() or b >= 128 else " " for b in g).split()) for g in got]
        assert sum(own) == len(words) and all(n == 7 for n in own[:-1])


def test_toxic_lines_in_a_long_text_count_as_their_window():
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    count, parts = toxicity.subwords(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    for b, _ in parts:
        weight[b] = 50.0
    model = toxicity.Model(weight, -1.0)
    clean = " ".join(f"word{i % 40}" for i in range(3000))
    texts = [clean, clean + " vile", "vile " + clean, ""]
    raw = [t.encode() for t in texts]
    score = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert score[1] > 2 * score[0] and score[2] > 2 * score[0] and abs(score[3] - 1 / (1 + np.e)) < 1e-9
    assert len(model.score(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_parting_costs_least():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        y = rng.integers(0, 2, n)
        z = np.round(rng.normal(0, 1, n) + y, 3) + np.arange(n) * 1e-6
        cost = lambda at: int(((y == 1) & (z < at)).sum() + toxicity.ALARM * ((y == 0) & (z >= at)).sum())  # noqa: E731, B023
        tried = np.concatenate((z - 1e-7, z + 1e-7, [z.min() - 1, z.max() + 1]))
        assert cost(toxicity.parting(z, y)) >= min(map(cost, tried))
    assert toxicity.parting(np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) == 2.5


# Token ids by tokenizers of another kind -------------------------------------------------------------------------------------

def test_token_store_encodes_whole_texts_for_other_tokenizers(spark, library):
    path = queries.word_tokenizer_path()
    assert not token_store.Encoder(path, 2).by_pieces and token_store.Encoder(queries.tokenizer_path(), 2).by_pieces
    texts = ["It's A  Test", None, "<|endoftext|> e\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = token_store.new_store_path(spark)
    token_store.write_tokens(df, store, path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(spark, store).collect()}
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


def test_classes_of_code_points_take_little_memory():
    tracemalloc.start()
    try:
        table = token_store.kinds.__wrapped__()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30 << 20
    assert [table[ord(c)] for c in " aé7! 𝔸"] == [0, 1, 1, 2, 3, 0, 1]
