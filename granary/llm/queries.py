"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align
from .bpe import digests
from .knn_join import top_k
from .markov_model import markov_scores
from .packing import pack
from .quality_rules import BULLET, ELLIPSIS, LETTER, RULES, STOP_WORDS, judge_quality
from .resampling import resample
from .sharding import shard_documents
from .simhash import near_duplicates
from .suffix_dedup import byte_digests
from .token_histogram import length_histogram
from .url_rules import judge_urls
from .word_dedup import word_digests

#: The rules of the url query: host, path, action.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op1_sql() -> str:
    tests = []
    for r in RULES:
        parts = []
        if r.low is not None:
            parts.append(f"{r.numerator} * 100 >= {r.low} * {r.denominator}")
        if r.high is not None:
            parts.append(f"{r.numerator} * 100 <= {r.high} * {r.denominator}")
        tests.append(f"(n_words < {r.from_words} or ({' and '.join(parts)}))")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
with d as (
  select row_number() over (order by doc_id, text) as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, i, list_slice(w, i, i + 7) as win from d, unnest(range(1, greatest(len(w) - 6, 1))) as u(i)),
r as (select rid, i, count(*) over (partition by rid, win) as c from g),
p as (select rid, count(distinct q) as n_repeat_words from r, unnest(range(i, i + 8)) as v(q) where c > 1 group by rid),
f as (
  select d.rid, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) as bigint) as n_letter_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    cast(len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+')), [{stop}])) as bigint) as n_stop_kinds,
    coalesce(n_repeat_words, 0) as n_repeat_words, 1 as one
  from d left join p on d.rid = p.rid),
h as (select *, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(len(list_filter(lines, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{BULLET}'))) as bigint) as n_bullet_lines,
        cast(len(list_filter(lines, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ELLIPSIS}'))) as bigint) as n_ellipsis_lines,
        (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and {' and '.join(tests)}) as kept from h"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    judged = judge_urls(_table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, row_number() over () as rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(h, q, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select rid, concat(h, q) as rule, action, row_number() over (partition by rid order by length(h) + length(q) desc, concat(h, q)) as k
  from p join r on (host = h or ends_with(host, concat('.', h))) and starts_with(path, q))
select page_id, host, path, m.rule as rule, coalesce(m.action, 'allow') as verdict from p left join m on p.rid = m.rid and m.k = 1"""


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with e as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid as qrid, q.vec_id as query_id, e.rid as rid, e.vec_id as vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score
  from e as q join e on q.vec_id % 100 = 0 and q.rid <> e.rid),
r as (select *, cast(row_number() over (partition by qrid order by score desc, vec_id, rid) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"))


def op5_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_digests(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def packing_target_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing with a target mixture: of the credit of three sources' tokens the first gets three parts, the next two, the last one."""
    return pack(_table(spark, sf_dir, "documents"), weights={"src0": 3, "src1": 2, "src2": 1})


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digests(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# checksums of runs are made a byte at a time, from a table that list_reduce makes first
OP11_SQL = r"""
with tb as (select list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
al as (select true as own, row_number() over () as rid, doc_id, text from documents union all select false, -row_number() over (), null, text from benchmark),
d as (select own, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from al),
g as (select own, rid, array_to_string(list_slice(w, i, i + n - 1), ' ') as x from d, (values (1), (2), (3)) r(n), unnest(range(1, len(w) - n + 2)) as u(i)),
c as (select own, rid, x, count(*) as k from g group by 1, 2, 3),
h as (select x, hex(encode(x)) as b from (select distinct x from c)),
b as (select x, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(b) // 2), lambda j: cast(concat('0x', substr(b, cast(2 * j + 1 as int), 2)) as bigint))), lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1])), 4294967295) % 10000 as bucket from h, tb),
f as (select own, rid, bucket, sum(k) as k from c join b using (x) group by 1, 2, 3),
q as (select bucket, coalesce(sum(k) filter (own), 0) as s, coalesce(sum(k) filter (not own), 0) as t from f group by 1),
z as (select coalesce(sum(k) filter (own), 0)::double as s, coalesce(sum(k) filter (not own), 0)::double as t from f),
ga as (select bucket, cast(floor(1000 * ln((q.t + 1)::double * (z.s + 10000) / ((q.s + 1)::double * (z.t + 10000)))) as bigint) as gain from q, z),
w as (select rid, cast(sum(k) as bigint) as n_features, cast(sum(k * gain) as bigint) as weight from f join ga using (bucket) where own group by 1),
p as (select d.rid, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, cast(concat('0x', substr(sha256(concat('42:', doc_id)), 1, 8)) as bigint) as h from d left join w on d.rid = w.rid where own),
s as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score, n_words >= 20 as able from p),
r as (select *, row_number() over (partition by able order by score desc, doc_id nulls last, n_features desc) as k, count(*) over (partition by able) as n from s)
select doc_id, n_features, weight, score, case when able and k <= 5 * n // 100 then k end as rank from r"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_scores(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_top_k": op2_top_k,
        "op3_sharding": op3_sharding,
        "op4_bpe": op4_bpe,
        "op5_word_dedup": op5_word_dedup,
        "op6_simhash": op6_simhash,
        "op7_packing": op7_packing,
        "packing_target_mixture": packing_target_mixture,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_url_filters": op10_url_filters,
        "op11_resampling": op11_resampling,
        "op12_alignment": op12_alignment,
        "op13_lm_scoring": op13_lm_scoring,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": _op1_sql(), "op2_top_k": OP2_SQL, "op10_url_filters": OP10_SQL, "op11_resampling": OP11_SQL}
