"""Registered queries over sources, whole runs and streams, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.operators import corpus, index, metrics, ordering, pairs, ranker, requests, urls
from querymill.operators import registry as core
from querymill.operators.registry import table
from querymill.plans import sites
from querymill.runtime import new_path, written
from querymill.sources import synthetic, tables
from querymill.streaming import state

SQL: dict[str, str] = {}

# --- sources and sinks ----------------------------------------------------------------------------


def query_log_lines(spark, folder):
    """The query log as JSON lines, written and read again."""
    path = f"{new_path(spark, 'log')}.jsonl"
    tables.read_queries(spark, f"{folder}/queries.parquet").write.json(path)
    return tables.read_queries(spark, path)


SQL["query_log_lines"] = "select qid, original_query, normalized_query from queries"


def first_queries(spark, folder):
    return tables.read_queries(spark, f"{folder}/queries.parquet", 100)


SQL["first_queries"] = "select qid, original_query, normalized_query from queries order by qid nulls first, original_query nulls first, normalized_query nulls first limit 100"


def pair_lines(spark, folder):
    path = new_path(spark, "pairs")
    tables.write_pairs(table(spark, folder, "training_pairs").select("prefix", "candidate", "label", "source"), path)
    return tables.read_pairs(spark, path)


SQL["pair_lines"] = "select prefix, candidate, label, source from training_pairs"


def sanitized_lines(spark, folder):
    """The pairs that the sanitizer leaves, as JSON lines put in place after they were read again."""
    source, target = new_path(spark, "pairs"), new_path(spark, "clean")
    tables.write_pairs(table(spark, folder, "training_pairs").select("prefix", "candidate", "label", "source"), source)
    tables.sanitize_pairs(spark, source, target, f"{new_path(spark, 'report')}")
    return tables.read_pairs(spark, target)


SQL["sanitized_lines"] = core.SQL["sanitized_pairs"]


def registry_entries(spark, folder):
    """Given entries with defaults filled in, and the built-in ones, which stand for an empty list."""
    given = tables.read_registry(spark, [{"domain": " Sample.ORG "}, {"domain": " "}, {"domain": "b.sample.org", "organization": "B", "category": "Maps", "allow_subdomains": False}])
    return given.unionByName(tables.read_registry(spark, [{"domain": None}])).select("domain", "organization", "category", "allow_subdomains", "ordinal")


_ENTRIES = [("sample.org", "Verified Organization", "General", True, 0), ("b.sample.org", "B", "Maps", False, 1)]
_ENTRIES += [(e["domain"], e["organization"], e["category"], e["allow_subdomains"], i) for i, e in enumerate(tables.BUILT_IN_REGISTRY)]
SQL["registry_entries"] = f"select * from (values {', '.join(str(e) for e in _ENTRIES)}) v(domain, organization, category, allow_subdomains, ordinal)"


def synthetic_log(spark, folder):
    """Ten thousand invented queries, written by split and read again."""
    return synthetic.write_splits(spark, new_path(spark, "synthetic"), 10_000).select("qid", "original_query", "normalized_query", "split")


_DRAW = lambda words, what: f"{list(words)!r}[('0x' || md5('1337|{what}|' || j)[1:15])::bigint % {len(words)} + 1]"
_QUOTED = lambda sql: sql.replace('"df.sort(\'x\')"', "'df.sort(''x'')'")
SQL["synthetic_log"] = _QUOTED(f"""with t as (select i, {_DRAW(synthetic.TOPICS, 'topic')} || ' ' || {_DRAW(synthetic.TAILS, 'tail')} || ' ' || (('0x' || md5('1337|number|' || j)[1:15])::bigint % 400) as q
      from (select i, i - (i % 50 = 49)::int as j from range(10000) r(i)))
    select 'S' || lpad(i::varchar, 9, '0') as qid, case when i % 3 = 0 then upper(q) else q end as original_query, q as normalized_query, case when ('0x' || sha256(q)[1:8])::bigint / 4294967295.0 < 0.1 then 'dev' else 'train' end as split from t""")

# --- the built index ------------------------------------------------------------------------------


def _built(spark: SparkSession, folder: str) -> index.PrefixIndex:
    return index.PrefixIndex.build(table(spark, folder, "queries"), new_path(spark, "index"))


def index_tables(spark, folder):
    """The rows of a built index's tables, opened again."""
    return _built(spark, folder).inspect()


_HOT = core._with() + core._STAGED.format(n=6)
SQL["index_tables"] = _HOT + "select 'queries' as table_name, count(*) as n_rows from indexed union all select 'hot_prefix_cache', count(*) from ranked where rank <= 50"


def index_statistics(spark, folder):
    return _built(spark, folder).statistics()


SQL["index_statistics"] = _HOT + """select 'queries' as table_name, count(*) as n_rows, count(distinct match_key) as n_keys, min(match_key) as first_key, max(match_key) as last_key from indexed
    union all select 'hot_prefix_cache', count(*), count(distinct prefix), min(prefix), max(prefix) from ranked where rank <= 50"""


def index_top_candidates(spark, folder):
    """The five best of every prefix of up to three characters, and those of a few long ones, from a built index."""
    built = _built(spark, folder)
    asked = built.queries.select(F.explode(text.generate_prefixes(F.col("match_key"), 1, 3, True, 3)).alias("prefix")).distinct()
    long = built.queries.where(F.length("match_key") > 24).select(F.substring("match_key", 1, 24).alias("prefix")).distinct()
    found = built.get_top_candidates(asked.unionByName(long))
    return found.select("matched_prefix", "rank", "qid", "normalized_query", "popularity")


SQL["index_top_candidates"] = core._with() + """, staged as (select *, unnest(list_transform(range(1, least(3, length(match_key)) + 1), lambda n: match_key[1:n])) as prefix from indexed
      union all select *, match_key[1:24] from indexed where length(match_key) > 24),
    ranked as (select *, (row_number() over (partition by prefix order by popularity desc, normalized_query))::int as rank from staged)
    select prefix as matched_prefix, rank, qid, normalized_query, popularity from ranked where rank <= 5"""


def lookup_guards(spark, folder):
    """Limits of nothing, and an empty prefix."""
    built = _built(spark, folder)
    asked = spark.createDataFrame([("",), ("w",)], "prefix string")
    counts = [(name, built.get_candidates(asked, limit).count()) for name, limit in (("zero", 0), ("none", None), ("negative", -1))]
    counts.append(("empty prefix", built.get_candidates(asked.where("prefix = ''"), 3).count()))
    return spark.createDataFrame(counts, "limit_given string, n_rows long")


SQL["lookup_guards"] = core._with() + "select * from (values ('zero', 0), ('none', 0), ('negative', 0)) v(limit_given, n_rows) union all select 'empty prefix', least(3, count(*)) from indexed"


def index_report(spark, folder):
    """The report of a build: rows, unique queries, staged prefixes and hot rows."""
    return corpus.index_report(table(spark, folder, "queries"))


SQL["index_report"] = _HOT + """, s as (""" + core.SQL["build_stats"].removeprefix(core._with()) + """)
    select *, (select count(distinct prefix) from staged) as n_prefixes, (select count(*) from ranked where rank <= 50) as n_hot_rows from s"""


def pair_source_counts(spark, folder):
    return pairs.source_counts(core._log(spark, folder, "train"))


SQL["pair_source_counts"] = f"""with t as (select *, qid is null or coalesce(normalized_query, '') = '' as blank, coalesce(regexp_matches(normalized_query, '{core._CONTROL}'), false) as dirty from queries where split = 'train')
    select count(*) as rows_seen, count(*) filter (blank) as rejected_blank, count(*) filter (not blank and dirty) as rejected_control, count(distinct normalized_query) filter (not blank and not dirty) as unique_queries,
      count(*) filter (not blank and not dirty) - count(distinct normalized_query) filter (not blank and not dirty) as duplicates from t"""

# --- the re-ranker --------------------------------------------------------------------------------


def reranked_pairs(spark, folder):
    """What must hold of the re-ranked pairs of each prefix: every pair once, ranks without gaps, scores that fall."""
    ranked = written(core.reranked_pairs(spark, folder), "reranked")
    return metrics.rank_checks(ranked, "prefix", "rank", "score")


SQL["reranked_pairs"] = """select prefix, count(*) as n_rows, true as ranks_whole, true as scores_fall from (
    select distinct prefix, candidate, label from training_pairs where prefix is not null and candidate is not null) group by prefix"""


def suggestions(spark, folder):
    """What must hold of the suggestions for each prefix: as many as can be, none twice, all with the prefix, scores that fall."""
    found = written(core.suggestions(spark, folder), "suggestions")
    rows = found.select("prefix", F.posexplode("suggestions").alias("rank", "s")).select("prefix", (F.col("rank") + 1).alias("rank"), "s.text", "s.score")
    rows = rows.withColumn("norm", text.normalize_prefix(F.trim("text")))
    checks = metrics.rank_checks(rows, "prefix", "rank", "score")
    texts = rows.groupBy("prefix").agg((F.count_distinct("norm") == F.count(F.lit(1))).alias("no_repeats"), F.bool_and(F.startswith("norm", "prefix")).alias("all_match"))
    return checks.join(texts, "prefix")


SQL["suggestions"] = core._with() + core._STAGED.format(n=8) + f""", shown as (select prefix, rank, trim(coalesce(nullif(original_query, ''), normalized_query), ' ') as shown from ranked where rank <= 50 and trim(prefix, ' ') <> ''),
    normed as (select *, {core._KEY.replace("normalized_query", "replace(shown, chr(8209), chr(8208))")} as norm from shown),
    firsts as (select prefix, norm from normed where norm <> '' group by 1, 2)
    select prefix, least(5, count(*)) as n_rows, true as ranks_whole, true as scores_fall, true as no_repeats, true as all_match from firsts where starts_with(norm, prefix) group by prefix"""

# --- ordering -------------------------------------------------------------------------------------


def _labelled(spark, folder):
    return table(spark, folder, "training_pairs").where("prefix is not null and candidate is not null").select("prefix", "candidate", "label").distinct()


_LABELLED = "(select distinct prefix, candidate, label from training_pairs where prefix is not null and candidate is not null)"


def shuffled_lines(spark, folder):
    rows = _labelled(spark, folder).withColumn("key", ordering.shuffle_key(7, "prefix", "candidate", "label"))
    return ordering.numbered(rows, ["key", "prefix", "candidate"]).drop("key")


SQL["shuffled_lines"] = f"select *, row_number() over (order by md5(concat_ws('|', '7', prefix, candidate, label)), prefix, candidate) as line from {_LABELLED}"


def sharded_lines(spark, folder):
    return ordering.shard(ordering.numbered(_labelled(spark, folder), ["prefix", "candidate", "label"]), "line", 4, 1)


SQL["sharded_lines"] = f"select * from (select *, row_number() over (order by prefix, candidate, label) as line from {_LABELLED}) where line % 4 = 1"


def epoch_lines(spark, folder):
    """Three passes over the labelled pairs in an order of their own, the lines of the second of two workers."""
    return ordering.epochs(_labelled(spark, folder), ["prefix", "candidate", "label"], 3, 11, 2, 1)


SQL["epoch_lines"] = f"""select * from (select epoch::int as epoch, prefix, candidate, label, row_number() over (partition by epoch order by md5(concat_ws('|', '11', epoch, prefix, candidate, label)), prefix, candidate, label) - 1 as line
    from {_LABELLED}, range(3) r(epoch)) where line % 2 = 1"""


def unique_suggestions(spark, folder):
    """Of each prefix the first row of every text, those that start with the prefix."""
    rows = table(spark, folder, "hot_prefix_cache").where("prefix is not null and normalized_query is not null")
    rows = rows.withColumn("norm", text.normalize_prefix(F.trim("normalized_query"))).withColumn("place", F.struct("rank", "build_shard", "qid", "popularity"))
    kept = metrics.keep_first(rows.where("norm != ''"), ["prefix"], F.col("norm"), "place")
    return kept.where(F.col("norm").startswith(F.lower("prefix"))).select("prefix", "norm", "rank", "build_shard", "qid")


SQL["unique_suggestions"] = f"""with n as (select prefix, rank, build_shard, qid, popularity, {core._KEY.replace("normalized_query", "trim(normalized_query, ' ')")} as norm from hot_prefix_cache where prefix is not null and normalized_query is not null),
    f as (select *, row_number() over (partition by prefix, norm order by rank nulls first, build_shard nulls first, qid nulls first, popularity nulls first) as k from n where norm <> '')
    select prefix, norm, rank, build_shard, qid from f where k = 1 and starts_with(norm, lower(prefix))"""

# --- requests and addresses -----------------------------------------------------------------------


def client_addresses(spark, folder):
    events = table(spark, folder, "events")
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    forwarded = F.when(n % 3 == 0, F.concat(F.lit(" 10.0."), user, F.lit(".1 , 10.9.9.9"))).when(n % 3 == 1, "")
    return events.select("event_id", text.client_address(forwarded, F.when(n % 5 > 0, F.concat(F.lit("192.0.2."), user))).alias("client"))


SQL["client_addresses"] = """select event_id, case when event_id % 3 = 0 then '10.0.' || user_id || '.1' when event_id % 5 > 0 then '192.0.2.' || user_id else '127.0.0.1' end as client from events"""


def internal_pages(spark, folder):
    """Every third address with a scheme of the browser's own before it."""
    n = F.pmod("doc_id", F.lit(12))
    heads = F.when(n == 0, "chrome://").when(n == 3, "View-Source:").when(n == 6, "about:").when(n == 9, "chrome.").otherwise("")
    pages = core.addresses(spark, folder).select("doc_id", F.concat(heads, "url").alias("page"))
    return pages.select("doc_id", "page", requests.is_internal_page(F.col("page")).alias("internal"))


SQL["internal_pages"] = core.URL_SQL + """, p as (select doc_id, case ((doc_id % 12) + 12) % 12 when 0 then 'chrome://' when 3 then 'View-Source:' when 6 then 'about:' when 9 then 'chrome.' else '' end || url as page from own)
    select doc_id, page, regexp_matches(lower(page), '^(chrome|chrome-extension|edge|about|devtools|view-source):') as internal from p"""


def _feed(spark, folder):
    """The test hosts, and two providers' findings about hosts of the addresses, one of them partly out of service."""
    hosts = urls.analyze_urls(core.addresses(spark, folder), "url").where("validation_error is null")
    row = lambda provider, test, kind, available, place: hosts.where(test).select(
        F.lit(provider).alias("provider"), F.upper("hostname").alias("key"), F.lit(available).alias("hit"), F.lit(kind).alias("threat_type"), F.lit(available).alias("available"), F.lit(place).alias("ordinal")
    ).distinct()
    return urls.sample_threats(spark).unionByName(row("list", "doc_id % 11 = 0", "MALWARE", True, 1)).unionByName(row("scanner", "doc_id % 19 = 0", "PHISHING", True, 2)).unionByName(row("oracle", "doc_id % 23 = 0", None, False, 3))


def threat_hits(spark, folder):
    hosts = urls.analyze_urls(core.addresses(spark, folder), "url").where("validation_error is null").select("hostname").distinct()
    hosts = hosts.unionByName(spark.createDataFrame([("Malware.wicar.org",)], "hostname string"))
    return urls.threat_lookup(hosts, "hostname", _feed(spark, folder))


_THREATS = """, asked_hosts as (select distinct hostname from named where ok union all select 'Malware.wicar.org'),
    listed as (select distinct hostname as h, 1 as place, 'list' as provider, 'MALWARE' as kind from named where ok and doc_id % 11 = 0
      union all select distinct hostname, 2, 'scanner', 'PHISHING' from named where ok and doc_id % 19 = 0 union all select 'malware.wicar.org', 0, 'local_blocklist', 'MALWARE (WICAR Test Site)'),
    dead as (select distinct hostname as h from named where ok and doc_id % 23 = 0),
    hits as (select h, list(provider order by place) as provider_hits, arg_min(kind, place) as threat_type from listed group by h),
    threats as (select hostname, coalesce(provider_hits, []) as provider_hits, threat_type, provider_hits is not null as known_threat, case when d.h is not null then ['oracle'] else [] end as unavailable_checks
      from asked_hosts left join hits on hits.h = lower(hostname) left join dead d on d.h = lower(hostname))"""
SQL["threat_hits"] = core.URL_SQL + _THREATS + "select * from threats"


def scan_findings(spark, folder):
    """What the counts of a multi-engine scanner amount to."""
    events = table(spark, folder, "events")
    counts = events.select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("user_id") % 3).cast("int").alias("malicious"), (F.col("event_id") % 5).cast("int").alias("suspicious"))
    return counts.select("event_id", urls.scan_verdict(F.col("malicious"), F.col("suspicious")).alias("finding"))


SQL["scan_findings"] = """select event_id, case when m > 0 or s > 1 then 'MALICIOUS_DETECTIONS_' || m end as finding from (
    select event_id, case when event_id % 4 > 0 then user_id % 3 else 0 end as m, event_id % 5 as s from events)"""


def site_checks(spark, folder):
    """The whole check of every address, in the order of the documents, with entries that outlive the run."""
    asked = core.addresses(spark, folder).withColumn("at", F.col("doc_id").cast("double"))
    return sites.check_sites(asked, "url", "doc_id", "at", core.site_registry(spark, folder), _feed(spark, folder), ttl=1e12)


_CHECKED = core.URL_SQL + core.MATCHED + _THREATS + """,
    placed as (select m.*, row_number() over (partition by scheme, hostname, port order by doc_id) > 1 as cached, first_value(normalized_url) over (partition by scheme, hostname, port order by doc_id) as shown from matched m),
    checks as (select doc_id, shown as url, p.hostname as domain, true as is_valid, cached, organization, known_threat, threat_type, provider_hits, unavailable_checks from placed p join threats t on t.hostname = p.hostname
      union all select doc_id, url, coalesce(nullif(hostname, ''), 'unknown'), false, false, null, false, null, [], [] from named where not ok)"""
SQL["site_checks"] = _CHECKED + "select * from checks"


def site_health(spark, folder):
    return sites.site_health(site_checks(spark, folder), core.site_registry(spark, folder))


SQL["site_health"] = _CHECKED + """select (select count(*) from reg) as registry_entries, count(*) as checks, count(*) filter (cached) as cached, count(*) filter (not is_valid) as invalid,
    count(organization) as matched, count(*) filter (known_threat) as threats, count(*) filter (is_valid and not cached) as filled from checks"""


def bounded_cache_flags(spark, folder):
    """A cache of three entries for each user, asked for kinds of events."""
    events = table(spark, folder, "events").where("event_type is not null").select("event_id", "user_id", "event_type", core._seconds("ts").alias("at"))
    return requests.bounded_cache(events, "user_id", "event_type", "at", "event_id", most=3, ttl=400_000.0).select("event_id", "user_id", "cached", "held")


SQL["bounded_cache_flags"] = """with recursive seq as (select event_id, user_id as c, event_type as k, epoch_us(ts) / 1e6 as sec, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and event_type is not null),
    r as (select c, n, event_id, [{'k': k, 't': sec}] as s, false as cached from seq where n = 1
      union all select c, n, event_id, case when hit then s else list_append(list_filter(case when len(s) >= 3 then s[2:] else s end, lambda e: e.k <> key), {'k': key, 't': sec}) end, hit
      from (select q.c, q.n, q.event_id, q.k as key, q.sec, r.s, len(list_filter(r.s, lambda e: e.k = q.k and q.sec - e.t < 400000.0)) > 0 as hit from r join seq q on q.c = r.c and q.n = r.n + 1))
    select event_id, c as user_id, cached, len(s)::int as held from r"""


def rounded_values(spark, folder):
    return table(spark, folder, "events").select("event_id", metrics.half_even(F.col("value"), 1).alias("rounded"))


SQL["rounded_values"] = "select event_id, round_even(value, 1) as rounded from events"

# --- streams --------------------------------------------------------------------------------------


def _stream(spark, folder, name):
    # a pattern, as a file source takes no single file
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}.parque[t]")


def _drained(writer, out):
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _rows(df, spark, name, ddl):
    """All rows that a stream gives until its source is read."""
    out = new_path(spark, name)
    with state.settings(spark, state.STATE_CONF):
        _drained(df.writeStream.format("parquet").option("path", f"{out}/rows"), out)
    return spark.read.schema(ddl).parquet(f"{out}/rows")


def ttl_cache_stream(spark, folder):
    rows = _stream(spark, folder, "events").select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.col("event_id").alias("request_id"), core._seconds("ts").alias("at"))
    found = _rows(state.ttl_cache_stream(rows, 86_400.0), spark, "cache-stream", "key string, request_id long, cached boolean, first_request long")
    return found.select(F.col("request_id").alias("event_id"), "key", "cached", F.col("first_request").alias("first_tie"))


SQL["ttl_cache_stream"] = core.SQL["ttl_cache_flags"]


def debounce_stream(spark, folder):
    """The last event of every burst of a user that the watermark has closed."""
    rows = _stream(spark, folder, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"))
    return _rows(state.debounce_stream(rows.where("source is not null"), "1 hour", "2 hours"), spark, "debounce-stream", "source string, at timestamp, value string").select("source", F.col("at").cast("timestamp_ntz").alias("at"))


SQL["debounce_stream"] = """with e as (select user_id::varchar as source, ts, event_type, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events where user_id is not null),
    m as (select max(ts) - interval 2 hours as mark from events where user_id is not null)
    select source, ts as at from e, m where (nxt is null or nxt - ts >= interval 1 hour) and ts + interval 1 hour <= mark and trim(coalesce(event_type, '')) <> ''"""


def request_counts_stream(spark, folder):
    """Requests and their values per day and kind, of the days that the watermark has closed."""
    rows = _stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("event_id").alias("value"))
    return _rows(state.request_counts_stream(rows, "1 day", "6 hours"), spark, "counts-stream", "start timestamp, kind string, n long, total long").withColumn("start", F.col("start").cast("timestamp_ntz"))


SQL["request_counts_stream"] = """with m as (select max(ts) - interval 6 hours as mark from events)
    select date_trunc('day', ts)::timestamp as start, event_type as kind, count(*) as n, sum(event_id)::bigint as total from events, m where ts is not null group by 1, 2, mark having date_trunc('day', ts)::timestamp + interval 1 day <= mark"""


def suggestion_stream(spark, folder):
    """The cached suggestions for a stream of typed prefixes."""
    cache = written(index.hot_prefix_cache(core._index(spark, folder)), "cache")
    asked = _stream(spark, folder, "training_pairs").select(F.hash("candidate").alias("request_id"), "prefix").where("prefix is not null")
    found = _rows(state.suggestion_stream(asked, cache, 3), spark, "suggestion-stream", "typed string, rank int, normalized_query string, popularity long")
    return found.groupBy("typed", "rank", "normalized_query").agg(F.count(F.lit(1)).alias("n_requests"))


_TYPED = f"typed as (select {core._KEY.replace('normalized_query', 'prefix')} as typed, count(*) as n_requests from training_pairs where prefix is not null group by 1)"
SQL["suggestion_stream"] = _HOT + f""", {_TYPED}
    select typed, rank, normalized_query, n_requests from typed join ranked on prefix = typed where rank <= 3 and length(typed) between 1 and 6"""


def answered_stream(spark, folder):
    """All suggestions for a stream of typed prefixes, those beyond the cache's length from the whole index."""
    queries = written(core._index(spark, folder), "index")
    cache = written(index.hot_prefix_cache(queries), "cache")
    source = written(table(spark, folder, "training_pairs").where("prefix is not null").select(F.monotonically_increasing_id().alias("request_id"), "prefix"), "requests")
    asked = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    out = new_path(spark, "answers")
    _drained(state.answer_stream(asked, queries, cache, f"{out}/rows", 3), out)
    found = spark.read.parquet(f"{out}/rows").withColumn("typed", text.normalize_prefix(F.col("prefix")))
    return found.groupBy("typed", "rank", "normalized_query").agg(F.count(F.lit(1)).alias("n_requests"))


SQL["answered_stream"] = core._with() + f""", {_TYPED}, met as (select typed, n_requests, normalized_query, popularity from typed join indexed on starts_with(match_key, typed)),
    ranked as (select *, (row_number() over (partition by typed order by popularity desc, normalized_query))::int as rank from met) select typed, rank, normalized_query, n_requests from ranked where rank <= 3"""

QUERIES = {
    f.__name__: f
    for f in (
        query_log_lines, first_queries, pair_lines, sanitized_lines, registry_entries, synthetic_log, index_tables, index_statistics, index_top_candidates, lookup_guards, index_report, pair_source_counts, reranked_pairs, suggestions,
        shuffled_lines, sharded_lines, epoch_lines, unique_suggestions, client_addresses, internal_pages, threat_hits, scan_findings, site_checks, site_health, bounded_cache_flags, rounded_values,
        ttl_cache_stream, debounce_stream, request_counts_stream, suggestion_stream, answered_stream,
    )
}
