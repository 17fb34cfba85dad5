"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm import dedup, mixing, overlap, packing, repair, sampling, terms, topn
from querymill.runtime import written

#: Rows of the fixed-size sample.
SAMPLE_ROWS = 500
SAMPLE_RATE = 0.1


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.top_n(_table(spark, folder, "hot_prefix_cache"), "prefix", "normalized_query", "popularity", 10)
    return best.select("prefix", "new_rank", "normalized_query")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.block_sample(spark, f"{folder}/queries.parquet", ["qid", "normalized_query"], SAMPLE_ROWS, seed=20)


def p2_sample_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """A sample over the first six pieces only, before the later ones arrived."""
    path = f"{folder}/queries.parquet"
    return sampling.block_sample(spark, path, ["qid", "normalized_query", "piece"], SAMPLE_ROWS, seed=20, arrived=F.col("piece") <= 6)


def p2_sample_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The sample of the first six pieces brought up to date with one of the later pieces."""
    path, columns = f"{folder}/queries.parquet", ["qid", "normalized_query", "piece"]
    parts = [F.col("piece") <= 6, F.col("piece") > 6]
    samples = [sampling.block_sample(spark, path, columns, SAMPLE_ROWS, seed=20 + i, arrived=part) for i, part in enumerate(parts)]
    # a running job knows the rows of the pieces it has read; here one column is counted
    sizes = _table(spark, folder, "queries").agg(*[F.count_if(part) for part in parts]).first()
    return sampling.merge_samples(samples[0], sizes[0], samples[1], sizes[1], SAMPLE_ROWS, seed=22)


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stable_sample(_table(spark, folder, "queries"), "normalized_query", SAMPLE_RATE, seed=7)


def _overlap(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return overlap.split_overlap(_table(spark, folder, "queries"), "qid", "normalized_query", "split", "source")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder)[0]


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder)[1]


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return dedup.collapse_copies(_table(spark, folder, "queries"), "qid", "original_query", "duplicate_count", "duplicate_qids")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder)[1]


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder)[0]


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(_table(spark, folder, "training_pairs"), ["prefix"], ["candidate"])


def p7_terms_spilled(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts where each hash partition spills several times over."""
    return terms.term_counts(_table(spark, folder, "training_pairs"), ["prefix"], ["candidate"], partitions=2, most_rows=100)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_terms(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(_table(spark, folder, "documents"), _table(spark, folder, "pack_capacities"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing, each as a boolean."""
    packed = written(p8_packing(spark, folder), "packed")
    return packing.packing_checks(_table(spark, folder, "documents"), packed, _table(spark, folder, "pack_capacities"))


def _mix(spark: SparkSession, folder: str, by_temperature: bool = False) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"), by_temperature=by_temperature, seed=3)


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that must be reached, and whether they and the limits are."""
    checks = mixing.mix_checks(*_mix(spark, folder))
    return checks.select("source", "target_share", "max_repeats", "expected_share", "on_target", "within_repeats")


def p9_temperature_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, True)[0]


def p9_temperature_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mix by the exponent alone has the targets' entropy and keeps the limits."""
    return mixing.mix_checks(*_mix(spark, folder, True)).select("source", "target_share", "max_repeats", "within_repeats", "entropy_reached")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repair.same_looking(_table(spark, folder, "documents"))


def p10_texts(spark: SparkSession, folder: str) -> DataFrame:
    return repair.consistent_text(_table(spark, folder, "documents"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return repair.looking_classes(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_sample, p2_sample_so_far, p2_sample_merged, p3_sample, p4_found, p4_report, p6_found, p6_records, p7_found, p7_terms, p7_terms_spilled,
        p8_packing, p8_report, p9_selection, p9_shares, p9_temperature_selection, p9_temperature_shares, p10_found, p10_texts, p10_classes,
    )
}


def _feistel_sql() -> str:
    steps = ["s0 as (select t, x >> 30 as l, x & {m} as r from (select distinct normalized_query as t, ('0x' || md5(normalized_query)[1:15])::bigint as x from queries where normalized_query is not null))"]
    for i, (key, (a, b)) in enumerate(zip(sampling.round_keys(7), sampling._ROUNDS)):
        steps.append(f"a{i} as (select t, l, r, ((xor(r, {key}::bigint)) * {a}::bigint) & {{m}} as f from s{i})")
        steps.append(f"b{i} as (select t, l, r, ((xor(f, f >> 15)) * {b}::bigint) & {{m}} as f from a{i})")
        steps.append(f"s{i + 1} as (select t, r as l, xor(l, xor(f, f >> 13)) as r from b{i})")
    end = f"select t as normalized_query from s{len(sampling._ROUNDS)} where l * 1073741824 + r < {int(SAMPLE_RATE * sampling.DOMAIN)}"
    return ("with " + ", ".join(steps)).format(m=sampling._HALF) + " " + end


def _drawn(parts: str, below: str) -> str:
    return f"('0x' || md5({parts})[1:15])::bigint % {below}"


def _block_sample_sql(name: str, seed: int, where: str = "true") -> str:
    """The sample of a table that is one row group, whose rows are numbered in file order."""
    return f"""{name} as (select r.* exclude (nth) from placed r left join (
        select {_drawn(f"'{seed}|row|' || i", "(select count(*) from placed)")} as nth, min(i) as draw from range(200000) t(i) group by 1) d using (nth)
      where {where} order by coalesce(draw, 1000000 + {_drawn(f"'{seed}|rest|0|' || nth", "(1::bigint << 59)")}) limit {SAMPLE_ROWS})"""


_PLACED = "with recursive placed as (select qid, normalized_query, piece, row_number() over () - 1 as nth from queries)"
_MERGED = f"""{_PLACED}, {_block_sample_sql("old", 20, "piece <= 6")}, {_block_sample_sql("new", 21, "piece > 6")},
sizes as (select count(*) filter (piece <= 6) as n_old, count(*) filter (piece > 6) as n_new from placed),
urn as (select 0 as i, 0::bigint as fresh union all
  select i + 1, fresh + ({_drawn("'22|urn|' || i", "(n_old + n_new - i)")} < n_new - fresh)::int from urn, sizes where i < least({SAMPLE_ROWS}, n_old + n_new)),
taken as (select max(i) as k, max(fresh) as fresh from urn)"""

_P6 = r"""
with pieces as (
  select qid, original_query, list_filter(regexp_split_to_array(lower(original_query), '[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda p: p <> '') as ps,
         greatest(coalesce(duplicate_count, 0), 0) as n, coalesce(duplicate_qids, '') as ids
  from queries where original_query is not null and qid is not null),
keys as (
  select qid, n, ids,
    regexp_replace(array_to_string(list_filter(ps, lambda p: not regexp_full_match(p, '{f}')), ''), '[^\p{L}\p{N}]+', '', 'g') || ' ' ||
    array_to_string(list_sort(list_transform(list_filter(ps, lambda p: regexp_full_match(p, '{f}')), lambda p: regexp_extract(p, '{f}', 1))), ' ') as k
  from pieces),
kept as (select * from keys where trim(k) <> ''),
firsts as (select k, min(qid) as qid_a from kept group by k),
grouped as (select qid_a, qid, n, ids from kept join firsts using (k))
""".replace("{f}", r"[^\p{L}\p{N}]*([\p{L}\p{N}]+:[\p{L}\p{N}]+)[^\p{L}\p{N}]*")

_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")

_P7 = rf"""
with words as (
  select regexp_extract_all(lower(nfc_normalize(translate(candidate, '{_FULL_WIDTH}', '{_HALF_WIDTH}'))), '[\p{{L}}\p{{N}}]+') as ws from training_pairs where candidate is not null),
counted as (
  select 'prefix' as field_name, prefix as term, count(*) as n_occurrences, count(*) as n_rows from training_pairs where prefix <> '' group by prefix
  union all
  select 'candidate', term, sum(c)::bigint, count(*) from (select rid, term, count(*) as c from (select row_number() over () as rid, ws from words), unnest(ws) as u(term) group by rid, term) group by term),
marked as (
  select *, case when n_rows < 3 then 'rare' when n_rows > floor((select count(*) from training_pairs) / 10) then 'common' end as mark from counted)
"""

# all evaluation texts against all training texts, which only small tables allow
_P4 = r"""
with canon as (
  select qid, split, source, trim(regexp_replace(lower(normalized_query), '[^\p{L}\p{N}]+', ' ', 'g')) as t
  from queries where qid is not null and normalized_query is not null and split in ('train', 'dev', 'test')),
kept as (select * from canon where t <> ''),
a as (select distinct t, string_split(t, ' ') as w from kept where split <> 'train'),
b as (select distinct t, string_split(t, ' ') as w from kept where split = 'train'),
close as (select a.t as ta, b.t as tb, a.w as wa, b.w as wb from a join b on abs(length(a.t) - length(b.t)) <= 2 or abs(len(a.w) - len(b.w)) <= 1),
near as (
  select ta, tb from close where (abs(length(ta) - length(tb)) <= 2 and levenshtein(ta, tb) <= 2)
  or (abs(len(wa) - len(wb)) <= 1 and len(list_intersect(wa, wb)) >= len(list_distinct(wa)) - 2
    and greatest(len(wa), len(wb)) - list_sum(list_transform(list_distinct(wa), lambda w: least(len(list_filter(wa, lambda v: v = w)), len(list_filter(wb, lambda v: v = w))))) <= 1))
"""

# look-alikes replaced everywhere, without tokens or a vocabulary
_WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)] + [chr(c) for c in range(0x1D670, 0x1D6A4)]
_NARROW = [chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)] + list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SPACE_KINDS = [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
_FOLD = "text"
for _ligature, _letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
    _FOLD = f"replace({_FOLD}, '{_ligature}', '{_letters}')"
_FOLD = f"translate({_FOLD}, '{''.join([*_WIDE, *_SPACE_KINDS])}', '{''.join([*_NARROW, *' ' * len(_SPACE_KINDS)])}')".replace("&'", "&''")
_FOLD = f"nfc_normalize(regexp_replace({_FOLD}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{feff}}]', '', 'g'))"
_LETTERS = ("".join(repair._LATIN), "".join(repair._LATIN.values()))
_SHAPES = f"translate({_FOLD}, '{_LETTERS[0]}', '{_LETTERS[1]}')"
_FOLDED = f"with folded as (select doc_id, text, {_SHAPES} as f from documents where text is not null and doc_id is not null)"


def _own(script: str, pairs: tuple[str, str]) -> str:
    """The token with Latin letters replaced by those of one script, if that makes it wholly of that script."""
    theirs, ours = zip(*{b: (a, b) for a, b in reversed(list(zip(*pairs)))}.values())
    own = f"translate(t, '{''.join(ours)}', '{''.join(theirs)}')"
    return f"when n_latin > 0 and n_{script} > 0 and n_latin + n_{script} = n and not regexp_matches({own}, '\\p{{Latin}}') then {own}"


# the repair in SQL: tokens of several scripts, their forms, the first form that another token of the corpus has
_REPAIRED = rf"""
with folded as (select doc_id, text, {_FOLD} as f from documents),
parts as (select doc_id, text, regexp_extract_all(f, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') as ps from folded),
tokens as (select distinct t from (select unnest(ps) as t from parts) where regexp_matches(t, '^[\p{{L}}\p{{N}}]')),
counted as (select t, {", ".join(f"len(regexp_extract_all(t, '{c}')) as {n}" for n, c in (("n", r"\p{L}"), ("n_latin", r"\p{Latin}"), ("n_cyrillic", r"\p{Cyrillic}"), ("n_greek", r"\p{Greek}"), ("n_armenian", r"\p{Armenian}")))} from tokens),
formed as (
  select t, n_latin, n, case when n_latin < n and greatest(n_latin, n_cyrillic, n_greek, n_armenian) < n and not regexp_matches(translate(t, '{_LETTERS[0]}', '{_LETTERS[1]}'), '[^\p{{Latin}}\p{{N}}]') then translate(t, '{_LETTERS[0]}', '{_LETTERS[1]}') end as latin,
    case {" ".join(_own(*x) for x in (("cyrillic", repair.CYRILLIC), ("greek", repair.GREEK), ("armenian", repair.ARMENIAN)))} end as own from counted),
words as (select t from formed where latin is null and own is null),
known as (select t, n_latin, n, case when latin in (select t from words) then latin end as latin, case when own in (select t from words) then own end as own from formed where latin is not null or own is not null),
accepted as (select map_from_entries(list((t, case when n - n_latin > n_latin then coalesce(own, latin) else coalesce(latin, own) end))) as m from known where coalesce(latin, own) is not null)
"""

_PICK = "select qid, normalized_query, piece from (select *, row_number() over (order by md5(concat_ws('|', '22', qid, normalized_query, piece)), qid, normalized_query, piece) as n from {}), taken where n <= {}"

SQL = {
    "p2_sample": f"{_PLACED}, {_block_sample_sql('sample', 20)} select qid, normalized_query from sample",
    "p2_sample_so_far": f"{_PLACED}, {_block_sample_sql('sample', 20, 'piece <= 6')} select qid, normalized_query, piece from sample",
    "p2_sample_merged": f"{_MERGED} {_PICK.format('old', 'k - fresh')} union all {_PICK.format('new', 'fresh')}",
    "p9_shares": """select source, target_share, max_repeats, round(u / sum(u) over (), 6) as expected_share, true as on_target, true as within_repeats from (
        select *, case when source in (select source from documents where text <> '') then target_share else 0 end as u from mix_targets where source is not null and target_share > 0)""",
    "p9_temperature_shares": "select source, target_share, max_repeats, true as within_repeats, true as entropy_reached from mix_targets where source is not null and target_share > 0",
    "p8_report": """select capacity_id, (select count(*) from documents where text is not null) as n_texts, true as every_token_once, true as within_capacity,
        true as divided_only_if_longer, true as nearly_full from pack_capacities where capacity_id is not null and capacity_tokens >= 1""",
    "p4_found": _P4 + """select distinct least(x.qid, y.qid) as qid_a, greatest(x.qid, y.qid) as qid_b from near join kept x on x.t = ta and x.split <> 'train' join kept y on y.t = tb and y.split = 'train' where x.qid <> y.qid""",
    "p4_report": _P4 + """, per as (select split, source, qid, max((t in (select ta from near))::int) as hit from kept where split <> 'train' group by all)
        select split, source, count(*) as n_records, sum(hit)::bigint as n_overlapping from per group by all""",
    "p10_texts": _REPAIRED + "select doc_id, case when text is not null then array_to_string(list_transform(ps, lambda p: coalesce(m[p], p)), '') end as text from parts left join accepted on true",
    "p10_classes": _FOLDED + " select doc_id, min(doc_id) over (partition by f) as class_id, count(*) over (partition by f) as n_docs from folded",
    "p10_found": _FOLDED + """
        select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from folded a join folded b on a.f = b.f and a.doc_id < b.doc_id and a.text <> b.text""",
    "p1_found": """
        select prefix, new_rank::int as new_rank, normalized_query from (
          select prefix, normalized_query, row_number() over (partition by prefix order by p desc, normalized_query) as new_rank from (
            select prefix, normalized_query, max(popularity) as p from hot_prefix_cache
            where popularity is not null and prefix is not null and normalized_query is not null group by 1, 2))
        where new_rank <= 10""",
    "p3_sample": _feistel_sql(),
    "p6_found": _P6 + "select distinct qid_a, qid as qid_b from grouped where qid <> qid_a",
    "p6_records": _P6 + """,
per as (select qid_a, qid, max(n) as n, list_filter(list_distinct(flatten(list(list_transform(string_split(ids, ','), lambda x: trim(x))))), lambda x: x <> '' and x <> qid) as ids from grouped group by qid_a, qid),
named as (select distinct qid_a, m from per, unnest(list_append(ids, qid)) as u(m)),
more as (select qid_a, sum(greatest(n - len(ids), 0)) as c from per group by qid_a)
select qid_a as qid, (any_value(c) + count(*))::bigint as n_copies from named join more using (qid_a) group by qid_a""",
    "p7_terms": _P7 + "select field_name, term, n_occurrences, n_rows, mark from marked",
    "p7_terms_spilled": _P7 + "select field_name, term, n_occurrences, n_rows, mark from marked",
    "p7_found": _P7 + "select field_name, term, mark from marked where mark is not null",
}
