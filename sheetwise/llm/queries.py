"""The corpus operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import compact_windows, digest_index, fm_index, lang_bloom, mixing, prefix_trie, quality, simhash, token_counts, token_store, toxicity, url_trie, whitening
from sheetwise.llm.common import id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(mod: int, rest: int) -> Column:
    return F.coalesce(id_remainder("doc_id", mod) == rest, F.lit(False))


def language_model(docs: DataFrame) -> lang_bloom.LanguageFilters:
    return lang_bloom.learn_language_filters(docs.where(id_remainder("doc_id", 3) != 1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_bloom.identify_language(docs, language_model(docs), ["doc_id", held_out(3, 1).alias("held_out")])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is filled with one half of the documents, the other half is deduplicated against it, and groups are reduced over both."""
    docs = table(spark, sf_dir, "documents")
    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    late = F.coalesce(id_remainder("doc_id", 2) == 1, F.lit(False))
    batches = [index.add(docs.where(part)) for part in (~late, late)]
    found = index.over_batches(*batches)
    index.drop()  # the query's own; the result no longer reads it
    return found


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def domain_of(source: Column) -> Column:
    return F.when(source == "src0", "web").when(source.rlike("[02468]$"), "books").when(source.rlike("[13579]$"), "reference")


#: The registered query mixes to 6/10 of the corpus; the pipeline to 9/10, each document once at most.
MIX = mixing.Mix({"web": 2, "books": 5, "reference": 3}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {"src3": 3, "src4": 2}, 6, 10, 3, 17)
PIPELINE_MIX = mixing.Mix({"web": 3, "books": 4, "reference": 3}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {}, 9, 10, 1, 17)


def mixed(docs: DataFrame, mix: mixing.Mix) -> DataFrame:
    return mixing.mix_sources(docs, mix, domain_of(F.col("source")), F.col("lang"), F.col("source"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, MIX).select("_row.doc_id", "domain", "language", "origin", "n_tokens", "epoch")


#: (verdict, host, path prefix).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, ["page_id"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, table(spark, sf_dir, "documents"))


def tokens_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = token_store.new_store_path(spark)
    token_store.write_tokens(docs, path, tokenizer_path())
    return token_store.read_tokens(spark, path)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels").where(id_remainder("doc_id", 3) != 1))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), ["vec_id"]).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_tokenizer_path(), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_exact_dedup, op3_simhash, op4_mix_sources, op5_url_filter, op6_quality, op7_token_ids, op8_substring_dedup, op9_decontaminate, op10_toxicity, op11_whitening, op12_prefix_trie, op13_token_counts)
}


def _weight_sql(name: str, weights: dict[str, int]) -> str:
    return f"cast(case {' '.join(f"when {name} = '{k}' then {v}" for k, v in sorted(weights.items()))} else 1 end as bigint)" if weights else "cast(1 as bigint)"


def _level_sql(level: str, path: list[str], parent: str, weights: dict[str, int]) -> str:
    """CTEs that share each parent's budget among its children, as share_out does."""
    keys, up = ", ".join(path), path[:-1]
    by = f"partition by {', '.join(up)}" if up else ""
    source = f"join {parent} p using ({', '.join(up)})" if up else f"cross join {parent} p"
    return f"""
{level}_a as (select {keys}, cap, w, budget, cast(cap as double) / nullif(cast(w as double), 0) as fill from
  (select {keys}, cast(sum(cap) as bigint) as cap, {_weight_sql(path[-1], weights)} as w from leaves group by {keys}) x {source}),
{level}_b as (select *, budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as l,
  sum(w) over ({by}) - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) as ws from {level}_a
  window o as ({by} order by fill nulls last, concat_ws(chr(1), {keys}))),
{level}_c as (select *, cast(cap as hugeint) * ws <= cast(l as hugeint) * w as is_full from {level}_b),
{level}_d as (select *, budget - coalesce(sum(case when is_full then cap end) over ({by}), 0) as rest, coalesce(sum(case when not is_full then w end) over ({by}), 0) as op from {level}_c),
{level} as (select {keys}, cast(case when is_full then cap else coalesce(cast(rest as hugeint) * w // nullif(op, 0), 0) end as bigint) as budget from {level}_d)"""


def mix_ctes(mix: mixing.Mix, source: str) -> str:
    """CTEs from rows of ``source`` to ``ordered``: rows of the partial epoch with running token sums."""
    levels = list(mixing.LEVELS)
    return f"""
d as (select *, coalesce(case when source = 'src0' then 'web' when regexp_matches(source, '[02468]$') then 'books' when regexp_matches(source, '[13579]$') then 'reference' end, 'und') as domain,
  coalesce(lang, 'und') as language, coalesce(source, 'und') as origin, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens from {source}),
leaves as (select domain, language, origin, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) as bigint) * {mix.max_epochs} as cap from d group by all),
top as (select least(cast(coalesce(sum(tokens), 0) as bigint) * {mix.numerator} // {mix.denominator}, cast(coalesce(sum(cap), 0) as bigint)) as budget from leaves),
{_level_sql('lev1', levels[:1], 'top', mix.domains)},
{_level_sql('lev2', levels[:2], 'lev1', mix.languages)},
{_level_sql('lev3', levels, 'lev2', mix.sources)},
plan as (select domain, language, origin, cast(coalesce(budget // nullif(tokens, 0), 0) as integer) as epochs, budget - coalesce(budget // nullif(tokens, 0), 0) * tokens as rest from leaves join lev3 using (domain, language, origin)),
placed as (select *, concat_ws('-', md5(concat_ws('-', '{mix.seed}', cast(epochs as varchar), coalesce(cast(doc_id as varchar), 'null'), md5(coalesce(text, '')))), coalesce(cast(doc_id as varchar), 'null')) as place from d join plan using (domain, language, origin)),
ordered as (select *, sum(n_tokens) over (partition by domain, language, origin order by place) as upto, count(*) over (partition by domain, language, origin, place) as same,
  row_number() over (partition by domain, language, origin, place order by doc_id) as nth from placed),
taken as (select *, epochs + case when rest > 0 and (upto <= rest or upto - (same - nth) * n_tokens <= rest) then 1 else 0 end as times from ordered)"""


ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, coalesce(doc_id = min(doc_id) over w, false) as kept, text_sha256 from d window w as (partition by text_sha256)""",
    "op4_mix_sources": f"""
with {mix_ctes(MIX, 'documents')}
select doc_id, domain, language, origin, n_tokens, cast(unnest(range(times)) as integer) as epoch from taken""",
    "op5_url_filter": """
with u as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
r as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from u)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r""",
    "op9_decontaminate": """
with dw as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
bp as (select distinct item_id, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as p, least(10, len(ws)) as k from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from bw where len(ws) > 0)),
ks as (select distinct k from bp),
dp as (select doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') as p from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from dw cross join ks where len(ws) >= k)),
hits as (select doc_id, i, k, item_id from dp join bp using (p, k)),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from hits)) group by doc_id),
its as (select doc_id, count(x) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join its using (doc_id)""",
    # The crc32 of an id is reckoned bit by bit, as DuckDB has none. A node is (depth, smallest member); the nodes above it lie on its smallest member's path.
    "op12_prefix_trie": """
with t as materialized (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
c as materialized (select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(cast(conv_id as varchar), '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h from t group by conv_id),
r as (select c.conv_id, 0 as part, pos, role, text from c join t on t.conv_id = base and pos <= h union all select c.conv_id, 1, pos, role, text from c join t on t.conv_id = c.conv_id and pos > h),
p as (select conv_id, row_number() over w as d, text, list((role, text)) over w as path from r window w as (partition by conv_id order by part, pos)),
s as materialized (select conv_id, d, len(text) as size, min(conv_id) over (partition by path) as node, count(*) over (partition by path) as n from p
  union all select conv_id, 0, 0, min(conv_id) over (), count(*) over () from c),
e as (select node as conv_id, d as depth, string_agg(cast(s.conv_id as varchar), ',' order by s.conv_id) as ends from s join (select conv_id, max(d) as d from s group by conv_id) using (conv_id, d) group by all),
m as materialized (select s.d as depth, s.conv_id, u.node as parent_conv_id, s.n, (s.n - 1) * s.size as own from s left join s u on u.conv_id = s.conv_id and u.d = s.d - 1 where s.node = s.conv_id),
k as (select depth - 1 as depth, parent_conv_id as conv_id, count(*) as n_children from m where depth > 0 group by all),
f as materialized (select m.*, coalesce(n_children, 0) as n_children from m left join k using (depth, conv_id)),
b as (select s.d as depth, s.node as conv_id, count(*) filter (where n_children = 0) as n_leaves, sum(own) as saved from f join s on s.conv_id = f.conv_id and s.d <= f.depth group by all)
select conv_id, depth, parent_conv_id, n as n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256 from f join b using (depth, conv_id) left join e using (depth, conv_id)""",
}
