"""The registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.operators import corpus, heavy_keys, index, metrics, ordering, pairs, ranker, requests, urls, vocab
from querymill.runtime import new_path, written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- per-key results under heavy keys -------------------------------------------------------------


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    heavy = heavy_keys.heavy_keys(table(spark, folder, "prefix_raw_staging"), ["prefix", "match_key"], "qid", 0.025)
    return heavy.select("field_name", "key_text")


def p5_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys.key_counts(table(spark, folder, "prefix_raw_staging"), ["prefix", "match_key"], "qid")


_KEYS = """
with counted as (
  select 'prefix' as field_name, prefix as key_text, count(*) as n_rows, count(distinct qid) as n_queries from prefix_raw_staging where prefix is not null group by prefix
  union all
  select 'match_key', match_key, count(*), count(distinct qid) from prefix_raw_staging where match_key is not null group by match_key)
"""
SQL = {
    "p5_key_counts": _KEYS + "select * from counted",
    "p5_found": _KEYS + "select field_name, key_text from counted where n_rows * 40 >= (select count(*) from prefix_raw_staging)",
}

# --- query log and index --------------------------------------------------------------------------

def _log(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    rows = table(spark, folder, "queries")
    return rows if split is None else rows.where(F.col("split") == split)


def _index(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    return corpus.dedup_query_log(_log(spark, folder, split))


_WS = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_KEY = rf"lower(regexp_replace(regexp_replace(normalized_query, '^{_WS}', ''), '{_WS}', ' ', 'g'))"


def _with(where: str = "true") -> str:
    return f"""with keyed as (select qid, original_query, normalized_query, {_KEY} as match_key, split from queries),
    valid as (select * from keyed where qid is not null and original_query is not null and normalized_query <> '' and match_key <> '' and {where}),
    indexed as (select match_key, normalized_query, min(qid) as qid, arg_min(original_query, (qid, original_query)) as original_query,
      coalesce(array_to_string(list_sort(list(qid))[2:], ','), '') as duplicate_qids, count(*) - 1 as duplicate_count, count(*) as popularity from valid group by 1, 2)"""


def dedup_query_log(spark, folder):
    return _index(spark, folder)


SQL["dedup_query_log"] = _with() + "select * exclude (duplicate_qids) from indexed"


def duplicate_members(spark, folder):
    return corpus.duplicates(_log(spark, folder))


SQL["duplicate_members"] = _with() + """, c as (select normalized_query, qid as duplicate_qid, count(*) as n from valid group by 1, 2), m as (select normalized_query, min(qid) as qid from valid group by 1)
    select normalized_query, qid, duplicate_qid, n - (duplicate_qid = qid)::int as n_rows from c join m using (normalized_query) where n - (duplicate_qid = qid)::int > 0"""


def duplicate_lists(spark, folder):
    listed = corpus.with_duplicate_lists(_index(spark, folder), duplicate_members(spark, folder))
    return listed.select("normalized_query", "qid", "duplicate_qids")


SQL["duplicate_lists"] = _with() + "select normalized_query, qid, duplicate_qids from indexed"


def dedup_neutral_popularity(spark, folder):
    return corpus.dedup_query_log(_log(spark, folder), "neutral").select("match_key", "normalized_query", "qid", "popularity")


SQL["dedup_neutral_popularity"] = _with() + "select match_key, normalized_query, qid, 1::bigint as popularity from indexed"


def nfkc_match_key(spark, folder):
    return corpus.valid_rows(_log(spark, folder)).select("qid", "match_key").distinct()


SQL["nfkc_match_key"] = _with() + "select distinct qid, match_key from valid"


def build_stats(spark, folder):
    return corpus.build_stats(_log(spark, folder))


SQL["build_stats"] = _with() + """select (select count(*) from queries) as rows_seen, (select count(*) from queries) - (select count(*) from valid) as rejected,
    (select count(*) from valid) as processed, (select count(*) from indexed) as unique_queries, (select count(*) from valid) - (select count(*) from indexed) as duplicates"""


def rejected_samples(spark, folder):
    return corpus.rejected_rows(_log(spark, folder)).select("qid", "original_query", "normalized_query")


SQL["rejected_samples"] = _with() + """select qid, original_query, normalized_query from keyed where not coalesce(qid is not null and original_query is not null and normalized_query <> '' and match_key <> '', false)
    order by qid nulls first, original_query nulls first, normalized_query nulls first limit 10"""


def generated_prefixes(spark, folder):
    found = text.generate_prefixes(F.col("match_key"), 1, 20, False, 12)
    return _index(spark, folder).select("qid", "normalized_query", F.explode(found).alias("prefix"))


SQL["generated_prefixes"] = _with() + rf"""select qid, normalized_query, p as prefix from (
    select qid, normalized_query, unnest(list_filter(list_transform(range(1, least(20, length(match_key)) + 1), lambda n: match_key[1:n]), lambda p: not regexp_matches(p, '{_WS}$'))[1:12]) as p from indexed)"""


def prefix_staging(spark, folder):
    return index.explode_prefixes(_index(spark, folder)).groupBy("prefix").agg(F.count(F.lit(1)).alias("n_queries"))


SQL["prefix_staging"] = _with() + "select p as prefix, count(*) as n_queries from (select unnest(list_transform(range(1, least(6, length(match_key)) + 1), lambda n: match_key[1:n])) as p from indexed) group by p"


def hot_prefix_topk(spark, folder):
    return index.hot_prefix_cache(_index(spark, folder), 50).select("prefix", "rank", "match_key", "normalized_query", "qid", "popularity")


_STAGED = """, staged as (select *, unnest(list_transform(range(1, least({n}, length(match_key)) + 1), lambda n: match_key[1:n])) as prefix from indexed),
    ranked as (select *, (row_number() over (partition by prefix order by popularity desc, normalized_query))::int as rank from staged)"""
SQL["hot_prefix_topk"] = _with() + _STAGED.format(n=6) + "select prefix, rank, match_key, normalized_query, qid, popularity from ranked where rank <= 50"


def empty_prefix_popular(spark, folder):
    return index.popular(_index(spark, folder), 10).select("normalized_query", "qid", "popularity")


SQL["empty_prefix_popular"] = _with() + "select normalized_query, qid, popularity from indexed order by popularity desc, normalized_query limit 10"


def prefix_lookup_single(spark, folder):
    return index.lookup(_index(spark, folder), "  How TO find m", 100).select("normalized_query", "qid", "popularity")


SQL["prefix_lookup_single"] = _with() + "select normalized_query, qid, popularity from indexed where starts_with(match_key, 'how to find m') order by popularity desc, normalized_query limit 100"


def _asked(queries: DataFrame) -> DataFrame:
    """Every prefix of up to 20 characters that occurs, the empty one and one that doesn't."""
    spark = queries.sparkSession
    own = queries.select(F.explode(text.generate_prefixes(F.col("match_key"), 1, 20, True, 20)).alias("prefix")).distinct()
    return own.unionByName(spark.createDataFrame([("",), ("xyznonexistent",)], "prefix string"))


def prefix_lookup_batch(spark, folder):
    queries = written(_index(spark, folder), "index")
    return index.lookup_batch(queries, _asked(queries), 20).select("prefix", "rank", "normalized_query", "popularity")


SQL["prefix_lookup_batch"] = _with() + _STAGED.format(n=20) + """select prefix, rank, normalized_query, popularity from ranked where rank <= 20
    union all select '', (row_number() over (order by popularity desc, normalized_query))::int, normalized_query, popularity from (select * from indexed order by popularity desc, normalized_query limit 20)"""


def lookup_with_source(spark, folder):
    queries = written(_index(spark, folder), "index")
    cache = written(index.hot_prefix_cache(queries, 50), "cache")
    found = index.candidates(queries, cache, _asked(queries), 100)
    return found.select("matched_prefix", "prefix_match_length", "rank", "normalized_query", "source")


SQL["lookup_with_source"] = _with() + _STAGED.format(n=20) + """, sized as (select *, count(*) over (partition by prefix) as n from ranked)
    select prefix as matched_prefix, length(prefix)::int as prefix_match_length, rank, normalized_query, case when length(prefix) <= 6 and n < 50 then 'hot_cache' else 'range_scan' end as source
    from sized where rank <= 100
    union all select '', 0, (row_number() over (order by popularity desc, normalized_query))::int, normalized_query, 'range_scan' from (select * from indexed order by popularity desc, normalized_query limit 100)"""


def split_bucket(spark, folder):
    rows = _log(spark, folder).where("normalized_query is not null").select("normalized_query").distinct()
    return corpus.split_by_text(rows, 0.2)


SQL["split_bucket"] = "select normalized_query, case when ('0x' || sha256(normalized_query)[1:8])::bigint / 4294967295.0 < 0.2 then 'dev' else 'train' end as split from (select distinct normalized_query from queries where normalized_query is not null)"


def split_leak_check(spark, folder):
    return corpus.leaked_texts(_log(spark, folder, "train"), _log(spark, folder).where("split in ('dev', 'test')"))


SQL["split_leak_check"] = "select normalized_query from queries where split = 'train' intersect select normalized_query from queries where split in ('dev', 'test')"

# --- training pairs -------------------------------------------------------------------------------



def _pair_tables(spark, folder):
    train, dev = _log(spark, folder, "train"), _log(spark, folder, "dev")
    return train, written(corpus.dedup_query_log(train), "index"), pairs.pair_sources(dev)


def generated_pairs(spark, folder):
    train, queries, dev = _pair_tables(spark, folder)
    return pairs.generate_pairs(train, queries, dev)


def anti_leak_candidates(spark, folder):
    train, queries, dev = _pair_tables(spark, folder)
    return pairs.candidate_pools(pairs.positives(pairs.pair_sources(train)), queries, exclude=dev)


def pair_pool_stats(spark, folder):
    train, queries, dev = _pair_tables(spark, folder)
    own = written(pairs.positives(pairs.pair_sources(train)), "positives")
    return pairs.pool_stats(own, pairs.candidate_pools(own, queries, exclude=dev))


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
_POOLS = _with("split = 'train'") + _STAGED.format(n=8) + rf""", sources as (
      select normalized_query, min(qid) as qid from queries where split = 'train' and qid is not null and normalized_query <> '' and not regexp_matches(normalized_query, '{_CONTROL}') group by 1),
    own as (select normalized_query as query, unnest(list_transform(range(1, least(8, length(normalized_query)) + 1), lambda n: normalized_query[1:n])) as prefix from sources),
    asked as (select distinct prefix, {_KEY.replace("normalized_query", "prefix")} as key from own),
    dev as (select distinct normalized_query from queries where split = 'dev' and qid is not null and normalized_query <> '' and not regexp_matches(normalized_query, '{_CONTROL}')),
    tops as (select prefix as key, normalized_query as candidate from ranked where rank <= 50
      union all select '', normalized_query from (select * from indexed order by popularity desc, normalized_query limit 50)),
    found as (select * from tops where not regexp_matches(candidate, '{_CONTROL}') and candidate not in (select normalized_query from dev)),
    pools as (select own.prefix, own.query, candidate from own join asked using (prefix) join found using (key) where candidate <> own.query)"""
SQL["anti_leak_candidates"] = _POOLS + "select prefix, query, candidate from pools"
SQL["generated_pairs"] = _POOLS + """, chosen as (select prefix, query, candidate from (select *, row_number() over (partition by prefix, query order by md5(concat_ws('|', '1337', query, prefix, candidate)), candidate) as n from pools) where n <= 4),
    spare as (select normalized_query as candidate from sources where normalized_query not in (select normalized_query from dev) order by md5(concat_ws('|', '{seed}', normalized_query)), normalized_query limit 50),
    sized as (select own.prefix, own.query, coalesce(n, 0) as n from own left join (select prefix, query, count(*) as n from chosen group by 1, 2) using (prefix, query)),
    filler as (select s.prefix, s.query, s.n, spare.candidate from sized s, spare where s.n < 4 and spare.candidate <> s.query and not exists (select 1 from chosen c where c.prefix = s.prefix and c.query = s.query and c.candidate = spare.candidate)),
    fallback as (select prefix, query, candidate from (select *, row_number() over (partition by prefix, query order by md5(concat_ws('|', '1337', query, prefix, candidate)), candidate) as k from filler) where k <= 4 - n)
    select prefix, query, query as candidate, 1 as label, 'positive' as source from own
    union all select prefix, query, candidate, 0, 'index_retrieved' from chosen
    union all select prefix, query, candidate, 0, 'random_fallback' from fallback""".replace("{seed}", str(1337 ^ 0x5EED5EED))
SQL["pair_pool_stats"] = _POOLS + """, sized as (select own.prefix, own.query, coalesce(n, 0) as n from own left join (select prefix, query, count(*) as n from pools group by 1, 2) using (prefix, query))
    select count(*) as prefixes_generated, sum(n)::bigint as candidate_pool_queries, min(n) as candidate_pool_min, max(n) as candidate_pool_max, avg(n) as candidate_pool_avg,
      count(*) filter (n = 0) as prefixes_without_index_negatives, count(*) filter (n < 4) as negative_shortfalls from sized"""


def pair_label_counts(spark, folder):
    return pairs.label_counts(table(spark, folder, "training_pairs"))


SQL["pair_label_counts"] = "select source, label, count(*) as n_pairs from training_pairs group by all"


def sanitized_pairs(spark, folder):
    return pairs.sanitize(table(spark, folder, "training_pairs"))


_BAD = rf"coalesce(regexp_matches({{}}, '{_CONTROL}'), false)"
SQL["sanitized_pairs"] = f"select prefix, candidate, label, source from training_pairs where not {_BAD.format('prefix')} and not {_BAD.format('candidate')}"


def sanitizer_counts(spark, folder):
    return pairs.sanitize_counts(table(spark, folder, "training_pairs"))


SQL["sanitizer_counts"] = f"""select count(*) as scanned, count(*) filter (not p and not c) as written, count(*) filter (p or c) as skipped, count(*) filter (p) as prefix_fields, count(*) filter (c) as candidate_fields
    from (select {_BAD.format('prefix')} as p, {_BAD.format('candidate')} as c from training_pairs)"""


def control_char_audit(spark, folder):
    return pairs.control_audit(table(spark, folder, "training_pairs"))


SQL["control_char_audit"] = f"select distinct field, value from (select 'prefix' as field, prefix as value from training_pairs union all select 'candidate', candidate from training_pairs) where {_BAD.format('value')} order by field, value limit 20"

# --- vocabulary -----------------------------------------------------------------------------------

# Full width and decomposed letters are the compatibility forms in the table; the folding of sharp s goes beyond lower case.
_WIDE = ("".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''"))
_WORDS = rf"""with texts as (select distinct t from (select prefix as t from training_pairs union all select candidate from training_pairs) where t is not null),
    toks as (select t, regexp_extract_all(replace(replace(replace(lower(nfc_normalize(translate(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '{_WIDE[0]}', '{_WIDE[1]}'))), 'ß', 'ss'), '…', '...'), chr(160), ' '), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') as ts from texts),
    words as (select token, count(*) as frequency from (select unnest(ts) as token from toks) group by token)"""


def _pair_texts(spark, folder):
    return vocab.distinct_texts(table(spark, folder, "training_pairs"))


def pretokenized(spark, folder):
    return _pair_texts(spark, folder).select("text", text.pretokenize(F.col("text")).alias("tokens"))


SQL["pretokenized"] = _WORDS + "select t as text, ts as tokens from toks"


def word_frequency(spark, folder):
    return vocab.word_frequency(_pair_texts(spark, folder))


SQL["word_frequency"] = _WORDS + "select token, frequency from words"


def char_frequency(spark, folder):
    return vocab.char_frequency(word_frequency(spark, folder))


_CHARS = _WORDS + ", chars as (select token, sum(frequency)::bigint as frequency from (select unnest(string_split(token, '')) as token, frequency from words) where token <> '' group by token)"
SQL["char_frequency"] = _CHARS + "select token, frequency from chars"


def vocabulary(spark, folder):
    return vocab.vocabulary(_pair_texts(spark, folder))


_VOCAB = _CHARS + """, w as (select token, frequency, (row_number() over (order by frequency desc, token) + 3)::int as id from words qualify row_number() over (order by frequency desc, token) <= 19996),
    c as (select token, frequency, (row_number() over (order by frequency desc, token) + 3 + (select count(*) from w))::int as id from chars qualify row_number() over (order by frequency desc, token) <= 1996)"""
SQL["vocabulary"] = _VOCAB + "select 'word' as kind, token, frequency, id from w union all select 'char', token, frequency, id from c"


def vocabulary_size(spark, folder):
    return vocabulary(spark, folder).agg((F.count(F.lit(1)) + vocab.SPECIALS).alias("vocab_size"))


SQL["vocabulary_size"] = _VOCAB + "select (select count(*) from w) + (select count(*) from c) + 4 as vocab_size"


def vocabulary_reloaded(spark, folder):
    """The vocabulary after it was saved and loaded again."""
    path = new_path(spark, "tokenizer")
    vocab.Tokenizer.fit_pairs(table(spark, folder, "training_pairs")).save(path)
    return vocab.Tokenizer.load(spark, path).vocab


SQL["vocabulary_reloaded"] = SQL["vocabulary"]


def _encoded(spark, folder, modes=("hybrid",)):
    labelled = table(spark, folder, "training_pairs")
    return [vocab.Tokenizer.fit_pairs(labelled, vocab.TokenizerConfig(mode=m)) for m in modes]


def encoded_pairs(spark, folder):
    rows = table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate").distinct()
    (tokenizer,) = _encoded(spark, folder)
    return tokenizer.encode_pairs(rows, 40).select("prefix", "candidate", "padded", "mask", "length")


_ENCODED_TEXTS = """, m as (select map_from_entries(list((token, id))) as wm from w), n as (select map_from_entries(list((token, id))) as cm from c),
    enc as (select t, flatten(list_transform(ts, lambda x: case when wm[x] is not null then [wm[x]] else list_transform(string_split(x, ''), lambda y: coalesce(cm[y], 1)) end)) as ids from toks, m, n)"""
SQL["encoded_pairs"] = _VOCAB + _ENCODED_TEXTS + """
    select p.prefix, p.candidate, (ids || repeat([0], 40))[1:40] as padded, (repeat([1], len(ids)::int) || repeat([0], 40))[1:40] as mask, least(len(ids), 40)::int as length from (
      select d.prefix, d.candidate, ([2] || a.ids[1:18] || [3] || b.ids[1:19] || [3])[1:40] as ids
      from (select distinct prefix, candidate from training_pairs where prefix is not null and candidate is not null) d join enc a on a.t = d.prefix join enc b on b.t = d.candidate) p"""


def encoded_texts(spark, folder):
    """Every text by itself, with whole words and by characters only."""
    hybrid, chars = _encoded(spark, folder, ("hybrid", "char"))
    return chars.encode(hybrid.encode(_pair_texts(spark, folder), "text", "ids", 24), "text", "char_ids", 24)


SQL["encoded_texts"] = _VOCAB + _ENCODED_TEXTS + """, o as (select map_from_entries(list((token, id - (select count(*) from w)))) as om from c)
    select t as text, ids[1:24] as ids, flatten(list_transform(ts, lambda x: list_transform(string_split(x, ''), lambda y: coalesce(om[y], 1)::int)))[1:24] as char_ids from enc join toks using (t), o"""

# --- ranking quality ------------------------------------------------------------------------------


def rank_metrics_baseline(spark, folder):
    queries = written(_index(spark, folder, "train"), "index")
    dev = _log(spark, folder, "dev").where("qid is not null and normalized_query <> ''")
    asked = dev.select("qid", F.col("normalized_query").alias("target"), F.monotonically_increasing_id().alias("line"), F.explode(text.generate_prefixes(F.col("normalized_query"), 1, 20, True, 8)).alias("typed"))
    asked = written(asked.withColumn("prefix", text.normalize_prefix(F.col("typed"))), "asked")
    found = index.lookup_batch(queries, asked.select("prefix").distinct(), 50).select("prefix", "rank", F.col("normalized_query").alias("candidate"))
    ranked = asked.join(found, "prefix", "left").withColumn("relevant", F.coalesce(F.col("candidate") == F.col("target"), F.lit(False)))
    return metrics.pool_metrics(ranked, ["line", "typed"])


SQL["rank_metrics_baseline"] = _with("split = 'train'") + _STAGED.format(n=8) + rf""", asked as (select row_number() over () as line, target, typed, {_KEY.replace("normalized_query", "typed")} as prefix from (
      select normalized_query as target, unnest(list_transform(range(1, least(8, length(normalized_query)) + 1), lambda n: normalized_query[1:n])) as typed from queries where split = 'dev' and qid is not null and normalized_query <> '')),
    per as (select line, min(r.rank) filter (r.normalized_query = target) as first, max(r.rank) as pool from asked a left join (select * from ranked where rank <= 50) r using (prefix) group by line),
    f as (select *, case when first <= 5 then 1 else 0 end as hit from per where first is not null)
    select (select count(*) from f) as n_evaluated, (select count(*) from per where first is null) as n_target_missing, coalesce(avg((first = 1)::int), 0)::double as precision_at_1, coalesce(avg(hit / least(5, pool)), 0)::double as precision_at_k,
      coalesce(avg(hit), 0)::double as recall_at_k, coalesce(avg(case when first <= 5 then 1.0::double / first else 0 end), 0)::double as mrr_at_k, coalesce(avg(hit), 0)::double as hit_rate_at_k from f"""


def _scored_pairs(spark, folder):
    """Distinct pairs in a line order, with a score that depends on the text alone."""
    rows = table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate", "label").distinct()
    return ordering.numbered(rows, ["prefix", "candidate", "label"]).withColumn("score", text.split_share(F.col("candidate")))


_SCORED = """with pairs as (select distinct prefix, candidate, label from training_pairs where prefix is not null and candidate is not null),
    scored as (select *, row_number() over (order by prefix, candidate, label) as line, ('0x' || sha256(candidate)[1:8])::bigint / 4294967295.0::double as score from pairs)"""


def pair_islands_metrics(spark, folder):
    grouped = ordering.islands(_scored_pairs(spark, folder), "prefix", "line")
    ranked = metrics.rerank(grouped, ["group_id"], "score", "line").withColumn("relevant", F.col("label") == 1)
    return metrics.pool_metrics(ranked, ["group_id"])


SQL["pair_islands_metrics"] = _SCORED + """, flagged as (select *, case when prefix = lag(prefix) over (order by line) then 0 else 1 end as s from scored),
    grouped as (select *, sum(s) over (order by line) as g from flagged), ranked as (select *, row_number() over (partition by g order by score desc, line) as r from grouped),
    per as (select g, min(r) filter (label = 1) as first, max(r) as pool, count(*) filter (label = 1 and r <= 5) as hits, count(*) filter (label = 1) as rel from ranked group by g), f as (select * from per where first is not null)
    select (select count(*) from f) as n_evaluated, (select count(*) from per where first is null) as n_target_missing, avg((first = 1)::int)::double as precision_at_1, avg(hits / least(5, pool))::double as precision_at_k,
      avg(hits / rel)::double as recall_at_k, avg(case when first <= 5 then 1.0::double / first else 0 end)::double as mrr_at_k, avg((hits > 0)::int)::double as hit_rate_at_k from f"""


def bce_loss(spark, folder):
    return metrics.bce_loss(_scored_pairs(spark, folder), "score", "label")


SQL["bce_loss"] = _SCORED + "select avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))) as bce_loss from scored"


def hinge_loss(spark, folder):
    """Over mini-batches of 512 lines."""
    batched = _scored_pairs(spark, folder).withColumn("batch", F.floor(F.col("line") / 512))
    return metrics.hinge_loss(batched, ["batch", "prefix"], "score", "label", 0.3)


SQL["hinge_loss"] = _SCORED + """, b as (select *, line // 512 as batch from scored)
    select coalesce(avg(greatest(0, 0.3 - (p.score - n.score))), 0)::double as hinge_loss from b p join b n on p.batch = n.batch and p.prefix = n.prefix and p.label = 1 and n.label = 0"""


def mini_batches(spark, folder):
    rows = table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate", "label").distinct()
    return ordering.mini_batches(rows, ["candidate", "prefix", "label"], 64)


SQL["mini_batches"] = "select *, (row_number() over (order by candidate, prefix, label) - 1) // 64 as batch from (select distinct prefix, candidate, label from training_pairs where prefix is not null and candidate is not null)"


def latency_percentiles(spark, folder):
    return metrics.latency_summary(table(spark, folder, "events"), "event_type", "value")


_LATENCY = """with s as (select event_type, count(value) as n, avg(value) as avg_ms, min(value) as min_ms, max(value) as max_ms,
    quantile_cont(value, 0.5) as p50_ms, quantile_cont(value, 0.95) as p95_ms, quantile_cont(value, 0.99) as p99_ms from events group by event_type)"""
SQL["latency_percentiles"] = _LATENCY + "select * from s"


def latency_overall(spark, folder):
    return metrics.latency_overall(latency_percentiles(spark, folder), "event_type")


SQL["latency_overall"] = _LATENCY + "select avg(avg_ms) as mean_avg_ms, avg(p50_ms) as mean_p50_ms, avg(p95_ms) as mean_p95_ms, avg(p99_ms) as mean_p99_ms, max(p99_ms) as worst_p99_ms, arg_max(event_type, (p99_ms, event_type)) as worst_group from s"


def service_metrics(spark, folder):
    events = table(spark, folder, "events")
    return metrics.service_counters(events, F.col("event_type") != "error", "value", "ts", "event_id")


SQL["service_metrics"] = """select count(*) as total_requests, count(*) filter (event_type <> 'error') as served_requests, count(*) filter (event_type = 'error') as failed_requests,
    coalesce(avg(value) filter (event_type <> 'error'), 0) as avg_latency_ms, arg_max(value, (ts, event_id)) filter (event_type <> 'error') as last_latency_ms from events"""

def _trained(spark, folder):
    """The ranker at its ordinary size, after one epoch; a tenth of the prefixes is held out to measure it."""
    labelled = table(spark, folder, "training_pairs").withColumn("held", F.coalesce(text.split_share(F.col("prefix")) < 0.1, F.lit(False)))
    tokenizer = vocab.Tokenizer.fit_pairs(labelled)
    model, _ = ranker.train(tokenizer, labelled.where("not held"), labelled.where("held"), epochs=1, max_dev=2_000)
    return tokenizer, model


def reranked_pairs(spark, folder):
    """Every distinct labelled pair with its score and its rank among the pairs of its prefix."""
    tokenizer, model = _trained(spark, folder)
    rows = table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate", "label").distinct()
    scored = ranker.score_pairs(rows, tokenizer, model)
    return metrics.rerank(scored.withColumn("place", F.struct("candidate", "label")), ["prefix"], "score", "place").drop("place")


def suggestions(spark, folder):
    """Suggestions of the re-ranker for every prefix that the production values give: the first 8 of each query, of at most 20 characters."""
    tokenizer, model = _trained(spark, folder)
    queries = written(_index(spark, folder), "index")
    cache = written(index.hot_prefix_cache(queries, 50), "cache")
    asked = queries.select(F.explode(text.generate_prefixes(F.col("match_key"), 1, 20, True, 8)).alias("prefix")).distinct()
    return ranker.suggest(asked, queries, cache, tokenizer, model, 5, 50)


# --- requests -------------------------------------------------------------------------------------


def _seconds(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def rate_limit_log(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", _seconds("ts").alias("at"))
    return requests.rate_limit(events, "user_id", "at", "event_id", most=3, window=86_400.0).select("event_id", "user_id", "allowed", "retry_after")


def ttl_cache_flags(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.concat_ws(":", "event_type", "user_id").alias("key"), _seconds("ts").alias("at"))
    return requests.ttl_cache(events, "key", "at", "event_id", ttl=86_400.0).select("event_id", "key", "cached", "first_tie")


_IN_ORDER = "with recursive seq as (select *, row_number() over (partition by k order by sec, event_id) as n from (select event_id, user_id, {key} as k, epoch_us(ts) / 1e6 as sec from events) where k is not null)"
SQL["rate_limit_log"] = _IN_ORDER.format(key="user_id") + """, r as (
      select k, n, event_id, [sec] as times, true as allowed, 0 as retry_after from seq where n = 1
      union all select k, n, event_id, case when len(kept) < 3 then list_append(kept, sec) else kept end, len(kept) < 3, case when len(kept) < 3 then 0 else greatest(1, floor(kept[1] + 86400.0 - sec + 0.99)::int) end
      from (select s.k, s.n, s.event_id, s.sec, list_filter(r.times, lambda t: t > s.sec - 86400.0) as kept from r join seq s on s.k = r.k and s.n = r.n + 1))
    select event_id, k as user_id, allowed, retry_after from r"""
SQL["ttl_cache_flags"] = _IN_ORDER.format(key="concat_ws(':', event_type, user_id)") + """, r as (
      select k, n, event_id, sec as filled, event_id as first_tie, false as cached from seq where n = 1
      union all select s.k, s.n, s.event_id, case when s.sec - r.filled < 86400.0 then r.filled else s.sec end, case when s.sec - r.filled < 86400.0 then r.first_tie else s.event_id end, s.sec - r.filled < 86400.0
      from r join seq s on s.k = r.k and s.n = r.n + 1)
    select event_id, k as key, cached, first_tie from r"""


def rate_limit_stream(spark, folder):
    """The limiter over the request log as a stream, run until the log is read."""
    from querymill.runtime import new_path
    from querymill.streaming import state

    source = f"{folder}/events.parquet"
    # a pattern, as a file source takes no single file
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{folder}/events.parque[t]")
    rows = stream.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("request_id"), _seconds("ts").alias("at"))
    out = new_path(spark, "stream")
    writer = state.rate_limit_stream(rows, 3, 86_400.0).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    with state.settings(spark, state.STATE_CONF):
        writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    done = spark.read.schema("client string, request_id long, allowed boolean, retry_after int").parquet(f"{out}/rows")
    return done.select(F.col("request_id").alias("event_id"), F.col("client").cast("long").alias("user_id"), "allowed", "retry_after")


SQL["rate_limit_stream"] = SQL["rate_limit_log"]


def debounced_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return requests.debounce(events, "user_id", "ts", "event_id", "event_type", 3_600_000).select("event_id", "user_id")


SQL["debounced_events"] = "select event_id, user_id from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where (nxt is null or date_diff('microsecond', ts, nxt) >= 3600000000) and trim(coalesce(event_type, '')) <> ''"


def latest_requests(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return requests.latest_wins(events, ["user_id", "day"], "ts", "event_id").select("event_id", "user_id", "stale")


SQL["latest_requests"] = "select event_id, user_id, lead(event_id) over (partition by user_id, ts::date order by ts, event_id) is not null as stale from events"


def client_response_dedup(spark, folder):
    rows = table(spark, folder, "hot_prefix_cache").select("prefix", "original_query", F.struct("rank", "build_shard", "qid", "popularity", "original_query").alias("place"))
    return requests.client_list(rows, "prefix", "original_query", "place", 10).select("prefix", "position", "shown")


SQL["client_response_dedup"] = """with s as (select prefix, trim(original_query, ' ') as shown, (rank, build_shard, qid, coalesce(popularity, -1), original_query) as place from hot_prefix_cache where trim(original_query, ' ') <> ''),
    k as (select *, row_number() over (partition by prefix, lower(shown) order by place) as n from s),
    p as (select prefix, shown, (row_number() over (partition by prefix order by place))::int as position from k where n = 1) select prefix, position, shown from p where position <= 10"""


def highlighted(spark, folder):
    rows = table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate").distinct()
    parts = text.highlight_prefix(F.col("candidate"), F.col("prefix"))
    return rows.withColumn("h", parts).select("prefix", "candidate", F.col("h.matched").alias("matched"), text.escape_html(F.col("h.suffix")).alias("suffix"))


SQL["highlighted"] = """with d as (select distinct prefix, candidate, trim(prefix, ' ') as q from training_pairs where prefix is not null and candidate is not null), h as (select *, q <> '' and starts_with(lower(candidate), lower(q)) as hit from d)
    select prefix, candidate, case when hit then candidate[1:length(q)] else '' end as matched,
      replace(replace(replace(replace(replace(case when hit then candidate[length(q) + 1:] else candidate end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') as suffix from h"""


def request_urls(spark, folder):
    rows = table(spark, folder, "queries").where("original_query is not null").select("qid", "original_query", "duplicate_count").distinct()
    url = text.request_url(F.lit("http://localhost//"), F.col("original_query"), F.col("duplicate_count").cast("int"))
    return rows.select("qid", "original_query", url.alias("url")).distinct()


_ENCODED = "url_encode(original_query)"
for _kept, _code in (("!", "%21"), ("''", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A")):
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_kept}')"
SQL["request_urls"] = f"""select distinct qid, original_query, 'http://localhost/api/v1/suggestions?q=' || {_ENCODED} || '&top_k=' || case when coalesce(duplicate_count, 0) = 0 then 5 else greatest(1, least(20, duplicate_count)) end as url
    from queries where original_query is not null"""

_FIELD_ROWS = [
    ("password", None, "x", None, None, None, None, None, None, None), ("text", "cc-number", None, None, None, None, None, None, None, None), ("search", None, "q", None, None, None, None, None, None, None),
    (None, None, "userToken", None, None, None, None, None, None, None), ("text", None, None, "site-search", None, None, None, None, None, None), ("text", None, None, None, "Type here", None, None, "searchbox", None, None),
    ("text", None, None, None, None, None, None, None, "search", None), ("text", None, None, None, None, None, None, None, None, "/do/Search"), ("text", None, "query", None, "PIN", None, None, None, None, None), (None, None, "name", None, None, None, "q box", None, None, None),
]
_FIELD_COLUMNS = ["type", "autocomplete", "name", "id", "placeholder", "aria_label", "class_name", "role", "form_role", "form_action"]


def input_fields(spark, folder):
    """The literal fields, and a field of each labelled pair that is named by its texts."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_FIELD_ROWS)], "n int, " + ", ".join(f"{c} string" for c in _FIELD_COLUMNS))
    made = table(spark, folder, "training_pairs").where("candidate is not null").select("prefix", "candidate", "source").distinct()
    none = F.lit(None).cast("string")
    kind = F.when(F.length("candidate") % 3 == 0, "search").when(F.length("candidate") % 3 == 1, "Email")
    fields = dict.fromkeys(_FIELD_COLUMNS, none) | {"type": kind, "name": F.col("prefix"), "placeholder": F.col("candidate"), "id": F.col("source"), "form_action": F.concat(F.lit("/"), "prefix")}
    tested = rows.unionByName(made.select(F.lit(-1).alias("n"), *[v.alias(c) for c, v in fields.items()]))
    return tested.select("n", "name", "placeholder", requests.is_sensitive_field().alias("sensitive"), requests.is_search_field().alias("search"))


_VALUES = ", ".join("(" + ", ".join([str(i), *("null" if v is None else f"'{v}'" for v in r)]) + ")" for i, r in enumerate(_FIELD_ROWS))
_BLANK = lambda c: f"coalesce({c}, '')"
SQL["input_fields"] = rf"""with made as (select distinct prefix, candidate, source from training_pairs where candidate is not null),
    every as (select * from (values {_VALUES}) v(n, {", ".join(_FIELD_COLUMNS)}) union all
      select -1, case length(candidate) % 3 when 0 then 'search' when 1 then 'Email' end, null, prefix, source, candidate, null, null, null, null, '/' || prefix from made),
    f as (select *, {" || ' ' || ".join(_BLANK(c) for c in ("name", "id", "placeholder", "aria_label", "class_name"))} as names from every),
    s as (select *, lower({_BLANK('type')}) in {requests.SENSITIVE_TYPES} or lower({_BLANK('autocomplete')}) in {requests.SENSITIVE_AUTOCOMPLETE} or regexp_matches(names, '{requests.SENSITIVE_NAME}') as sensitive from f)
    select n, name, placeholder, sensitive, not sensitive and (lower({_BLANK('type')}) = 'search' or lower({_BLANK('role')}) = 'searchbox' or lower({_BLANK('form_role')}) = 'search' or contains(lower({_BLANK('form_action')}), 'search') or regexp_matches(names, '{requests.SEARCH_NAME}')) as search from s"""

_SETTINGS = [("http://localhost", 5, 200), ("ftp://x", 0, 20), ("", 21, 5000), (None, None, None), ("https://a.b/", 20, 50)]


def settings_check(spark, folder):
    """The literal settings, and one for each request."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_SETTINGS)], "n int, api_base_url string, top_k int, debounce_ms int")
    made = table(spark, folder, "events").select(
        (-F.col("event_id") - 1).cast("int").alias("n"), F.concat(F.when(F.col("user_id") % 3 > 0, "http://").otherwise("ws://"), F.coalesce("event_type", F.lit("")), F.lit("//")).alias("api_base_url"),
        (F.col("user_id") % 25).cast("int").alias("top_k"), (F.col("event_id") % 1200).cast("int").alias("debounce_ms"),
    )
    checked = requests.validate_settings(rows.unionByName(made))
    return checked.select("n", F.size("errors").alias("n_errors"), "valid", "clean_url", "clean_top_k", "clean_debounce_ms")


SQL["settings_check"] = f"""with every as (select * from (values {", ".join(f"({i}, {'null' if u is None else repr(u)}, {'null' if k is None else k}, {'null' if d is None else d})" for i, (u, k, d) in enumerate(_SETTINGS))}) v(n, u, k, d) union all
      select (-event_id - 1)::int, case when user_id % 3 > 0 then 'http://' else 'ws://' end || coalesce(event_type, '') || '//', (user_id % 25)::int, (event_id % 1200)::int from events),
    s as (select *, coalesce(regexp_matches(u, '^https?://'), false) as a, coalesce(k between 1 and 20, false) as b, coalesce(d between 50 and 1000, false) as c from every)
    select n, (not a)::int + (not b)::int + (not c)::int as n_errors, a and b and c as valid, case when a then regexp_replace(u, '/+$', '') else 'http://localhost' end as clean_url, case when b then k else 5 end as clean_top_k, case when c then d else 200 end as clean_debounce_ms from s"""

# --- addresses ------------------------------------------------------------------------------------

_MORE_URLS = (
    "https://shop.sample-market.com/cart?item=7#top", "encyclopedia.net", "https://radio.music.co.uk/live", "https://one.two.three.four.sample.org", "https://netflix.fast-payments.io/in",
    "http://localhost:9000", "plain_word", "https://xn--80ak6aa92e.com/",
)


def addresses(spark, folder):
    """An address per document, made of its repository and path, some with credentials or a number for a host, and a few literal ones."""
    docs = table(spark, folder, "documents").where("repo is not null and path is not null")
    owner, name = F.split_part("repo", F.lit("/"), F.lit(1)), F.split_part("repo", F.lit("/"), F.lit(2))
    n = F.col("doc_id")
    secure = F.when(n % 3 == 0, "http://").otherwise("https://")
    user = F.when(n % 13 == 0, F.concat(F.lit("me:"), owner, F.lit("@"))).otherwise("")
    named = F.concat(F.when(n % 5 == 0, "login.").otherwise(""), name, F.lit("."), owner, F.when(n % 7 == 0, ".co.uk:8080").otherwise(".org"))
    number = F.concat(F.when(n % 2 == 0, "10.1.2.").otherwise("93.184.216."), (n % 250).cast("string"))
    own = docs.select("doc_id", F.concat(secure, user, F.when(n % 17 == 0, number).otherwise(named), F.lit("/"), F.col("path"), F.lit("?v=1")).alias("url"))
    return own.unionByName(spark.createDataFrame([(-1 - i, u) for i, u in enumerate(_MORE_URLS)], "doc_id long, url string"))


URL_SQL = rf"""with own as (select doc_id, case when doc_id % 3 = 0 then 'http://' else 'https://' end || case when doc_id % 13 = 0 then 'me:' || split_part(repo, '/', 1) || '@' else '' end ||
      case when doc_id % 17 = 0 then case when doc_id % 2 = 0 then '10.1.2.' else '93.184.216.' end || (doc_id % 250) else
        case when doc_id % 5 = 0 then 'login.' else '' end || split_part(repo, '/', 2) || '.' || split_part(repo, '/', 1) || case when doc_id % 7 = 0 then '.co.uk:8080' else '.org' end end ||
      '/' || path || '?v=1' as url from documents where repo is not null and path is not null
      union all select * from (values {", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(_MORE_URLS))}) v(doc_id, url)),
    parts as (select doc_id, url, case when starts_with(url, 'http://') then 'http' else 'https' end as scheme, regexp_replace(url, '^https?://', '') as whole from own),
    rests as (select *, regexp_matches(whole, '^[^/?#]*@') as has_userinfo, regexp_replace(whole, '^[^/?#]*@', '') as rest from parts),
    hosts as (select *, lower(regexp_extract(rest, '^([^/?#:]*)', 1)) as hostname, try_cast(regexp_extract(rest, '^[^/?#:]*:([0-9]+)', 1) as int) as port, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as p from rests),
    local as (select *, regexp_full_match(hostname, '[0-9]+(\.[0-9]+){{3}}') as is_ip, hostname in {urls.LOCAL_NAMES} or regexp_matches(hostname, '\.(local|localhost|internal|lan|test|example|invalid)$') or starts_with(hostname, '10.') as loc, string_split(hostname, '.') as ls from hosts),
    cut as (select *, contains(hostname, '.') or loc as ok, case when is_ip or len(ls) < 2 then len(ls) when len(ls) >= 3 and array_to_string(ls[-2:], '.') in {urls.TWO_PART_SUFFIXES} then 3 else 2 end as n from local),
    named as (select *, case when ok then array_to_string(ls[-n:], '.') else hostname end as apex_domain, case when ok then array_to_string(ls[1:len(ls) - n], '.') else '' end as subdomain,
      case when ok then scheme || '://' || hostname || case when port is not null and port not in (80, 443) then ':' || port else '' end || case when p = '' then '/' else p end else '' end as normalized_url from cut)"""


def url_analysis(spark, folder):
    found = urls.analyze_urls(addresses(spark, folder), "url")
    facts = ["normalized_url", "scheme", "hostname", "apex_domain", "subdomain", "subdomain_depth", "port", "is_ip", "is_private_or_local", "is_punycode_or_idn", "has_userinfo", "suspicious_tokens"]
    return found.select("doc_id", *facts, F.col("validation_error").isNull().alias("is_valid"))


SQL["url_analysis"] = URL_SQL + f"""select doc_id, normalized_url, scheme, hostname, apex_domain, subdomain, case when subdomain = '' then 0 else len(string_split(subdomain, '.')) end::int as subdomain_depth, port, is_ip, has_userinfo,
    ok and loc as is_private_or_local, contains(hostname, 'xn--') as is_punycode_or_idn,
    list_sort(list_filter({list(urls.SUBDOMAIN_TOKENS)}, lambda t: contains(subdomain, t) and not contains(apex_domain, t))) as suspicious_tokens, ok as is_valid from named"""

_STRANGE = (
    ("https://bücher.sample.org/x", "https://xn--bcher-kva.sample.org/x", "xn--bcher-kva.sample.org", "sample.org", None, False, False, True),
    ("http://[2001:db8::1]:8443/a", "http://2001:db8::1:8443/a", "2001:db8::1", "2001:db8::1", 8443, True, True, False),
    ("http://me@[::1]/", "http://::1/", "::1", "::1", None, True, True, False),
    ("http://172.20.0.9:80", "http://172.20.0.9/", "172.20.0.9", "172.20.0.9", 80, True, True, False),
    ("https://почта.sample.co.uk", "https://xn--80a1acny.sample.co.uk/", "xn--80a1acny.sample.co.uk", "sample.co.uk", None, False, False, True),
    ("ftp://files.sample.net/x", "", "", "", None, False, False, False), ("", "", "", "", None, False, False, False), ("https:///only/path", "", "", "", None, False, False, False),
)


def strange_addresses(spark, folder):
    """Addresses of other scripts, with brackets, credentials or an unknown scheme."""
    found = urls.analyze_urls(spark.createDataFrame([(u[0],) for u in _STRANGE], "url string"), "url")
    return found.select("url", "normalized_url", "hostname", "apex_domain", "port", "is_ip", "is_private_or_local", "is_punycode_or_idn")


_LITERAL = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'"
SQL["strange_addresses"] = f"select * from (values {', '.join('(' + ', '.join(map(_LITERAL, row)) + ')' for row in _STRANGE)}) v(url, normalized_url, hostname, apex_domain, port, is_ip, is_private_or_local, is_punycode_or_idn)"


def site_registry(spark, folder):
    """Every owner's domain, those of an even length with their subdomains."""
    owners = table(spark, folder, "documents").where("repo is not null").select(F.split_part("repo", F.lit("/"), F.lit(1)).alias("owner")).distinct()
    return owners.select(
        F.concat("owner", F.lit(".org")).alias("domain"), F.col("owner").alias("organization"), (F.length("owner") % 2 == 0).alias("allow_subdomains"),
        F.crc32("owner").alias("ordinal"),
    )


def registry_match(spark, folder):
    hosts = urls.analyze_urls(addresses(spark, folder), "url").where("validation_error is null").select("doc_id", "hostname")
    return urls.suffix_lookup(hosts, "hostname", site_registry(spark, folder)).select("doc_id", "hostname", "organization")


MATCHED = """, reg as (select distinct split_part(repo, '/', 1) as owner from documents where repo is not null),
    matched as (select n.*, owner as organization from named n left join reg on hostname = owner || '.org' or (length(owner) % 2 = 0 and ends_with(hostname, '.' || owner || '.org')) where ok)"""
SQL["registry_match"] = URL_SQL + MATCHED + "select doc_id, hostname, organization from matched"

QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_key_counts, dedup_query_log, duplicate_members, duplicate_lists, dedup_neutral_popularity, nfkc_match_key, build_stats, rejected_samples, generated_prefixes, prefix_staging, hot_prefix_topk,
        empty_prefix_popular, prefix_lookup_single, prefix_lookup_batch, lookup_with_source, split_bucket, split_leak_check, generated_pairs, anti_leak_candidates, pair_pool_stats,
        pair_label_counts, sanitized_pairs, sanitizer_counts, control_char_audit, pretokenized, word_frequency, char_frequency, vocabulary, vocabulary_size, vocabulary_reloaded,
        encoded_pairs, encoded_texts, rank_metrics_baseline,
        pair_islands_metrics, mini_batches, bce_loss, hinge_loss, latency_percentiles, latency_overall, service_metrics, rate_limit_log, rate_limit_stream, ttl_cache_flags, debounced_events, latest_requests,
        client_response_dedup, highlighted, request_urls, input_fields, settings_check, url_analysis, strange_addresses, registry_match,
    )
}
