"""The corpus queries against DuckDB, brute force, round trips and held-out accuracy, on the small tables."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sheetwise.llm import queries
from test_edges import brute_texts

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").to_arrow_table().to_pylist()


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_mix_sources", "op5_url_filter", "op9_decontaminate"])
def test_matches_sql(compare, name):
    compare(name)


def test_language_held_out(spark):
    lang = {d["doc_id"]: d["lang"] for d in table(SF, "documents")}
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def components(ids, fps, radius=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for x in range(len(ids)):
        for y in np.flatnonzero(np.bitwise_count(a[x + 1 :] ^ a[x]) <= radius) + x + 1:
            p, q = find(ids[x]), find(ids[y])
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark):
    docs = table(SF, "documents")
    fps = [fingerprint(d["text"]) for d in docs]
    want = components([d["doc_id"] for d in docs], fps)
    got = {r.doc_id: r for r in queries.op3_simhash(spark, SF).collect()}
    assert all(int(got[d["doc_id"]].fingerprint, 16) == f for d, f in zip(docs, fps))
    assert {i: r.component_id for i, r in got.items()} == want


def test_quality_held_out(spark):
    good = {r["doc_id"]: r["quality"] for r in table(SF, "labels")}
    rows = [r for r in queries.op6_quality(spark, SF).collect() if r.held_out and r.doc_id in good]
    # Both classes, as a constant answer is right for most rows.
    right = {k: np.mean([r.predicted == k for r in rows if good[r.doc_id] == k]) for k in (0, 1)}
    assert right[1] > 0.95 and right[0] > 0.5
    low, high = (np.array([r.score for r in rows if good[r.doc_id] == k]) for k in (0, 1))
    assert np.mean(high[:, None] > low[None]) > 0.9


def test_toxicity_ranks_held_out(spark):
    """At sf0.1, as sf0.01 has about thirty toxic rows to learn from."""
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in table(sf, "labels")}
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad, fine = (np.array([r.score for r in rows if toxic[r.doc_id] == k]) for k in (1, 0))
    assert np.mean(bad[:, None] > fine[None]) > 0.95
    assert np.mean(bad >= 0.7) > 0.85
    assert np.mean(fine >= 0.7) < 0.01
    words = {d["doc_id"]: len((d["text"] or "").split()) for d in table(sf, "documents")}
    long = [r.score for r in rows if toxic[r.doc_id] and words[r.doc_id] > 1000]
    assert len(long) >= 10 and np.mean(np.array(long) >= 0.7) > 0.8
    assert all(0 <= r.score <= 1 for r in rows)


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = sorted(table(SF, "documents"), key=lambda d: d["doc_id"])
    got = {r.doc_id: r for r in queries.op7_token_ids(spark, SF).collect()}
    start = 0
    for d, e in zip(docs, t.encode_batch([d["text"] for d in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], "<u4")
        r = got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pipeline_stages(spark):
    """Each stage against brute force on what the stage before kept."""
    docs = queries.table(spark, SMALL, "documents")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, SMALL).cache()
    assert kept.columns == columns and kept.count() == docs.where("text rlike '\\\\p{L}'").count()
    after = steps["near_dedup"](spark, kept, SMALL).cache()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    comp = brute_texts([r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for n, r in enumerate(rows) if comp[n] == n} and after.columns == columns
    clean = steps["decontaminate"](spark, after, SMALL).cache()
    c = duckdb.connect()
    c.register("documents", after.toArrow())
    c.execute(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
    want = {r[0] for r in c.sql(f"select doc_id from ({queries.ORACLE['op9_decontaminate']}) where not contaminated").fetchall()}
    assert {r.doc_id for r in clean.collect()} == want
    chosen = steps["mix"](spark, clean, SMALL).cache()
    c.register("clean", clean.toArrow())
    want = {r[0] for r in c.sql(f"with {queries.mix_ctes(queries.PIPELINE_MIX, 'clean')} select doc_id from taken where times > 0").fetchall()}
    assert {r.doc_id for r in chosen.collect()} == want and chosen.columns == columns
    tokens = steps["tokens"](spark, chosen, SMALL)
    assert {r.doc_id for r in tokens.collect()} == want
    assert corpus_pipeline.run(spark, SMALL).count() == len(want)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
