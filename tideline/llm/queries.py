"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import alignment, chat, fingerprints, lm, neardup, packing, pieces, quality, secrets, simhash, suffixes, turns, urls
from tideline.session import ship, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ship(spark), sf_dir, "documents")


URL_RULES = (
    urls.Rule("net/", "block"),
    urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"),
    urls.Rule("org/fr/", "allow"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(ship(spark), sf_dir, "pages"), URL_RULES)


OP1_SQL = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from cut),
rules(rule, rhost, rpath, verdict) as (values
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best as (
  select page_id, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict
from parts p left join best b on p.page_id = b.page_id
"""


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.profile(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), ids=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_documents(spark, sf_dir)))
    return rows.drop("n_lines")


OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (
  select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
base as (
  select doc_id, len(ws) n_words, len(array_to_string(ws, '')) word_chars,
         len(t) - len(translate(t, '#*$%&|<>', '')) n_symbols, len(ls) n_lines,
         len(ls) - len(list_distinct(ls)) n_dup_lines, ws from w),
grams as (
  select doc_id, i, array_to_string(ws[i:i+4], ' ') g
  from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from base where len(ws) >= 5)),
twice as (select doc_id, i, count(*) over (partition by doc_id, g) n from grams),
steps as (select doc_id, i - lag(i, 1, -5) over (partition by doc_id order by i) step from twice where n > 1),
rep as (select doc_id, sum(least(5, step)) n_repeat_words from steps group by doc_id),
m as (
  select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, coalesce(n_repeat_words, 0) n_repeat_words
  from base left join rep on base.doc_id = rep.doc_id),
f as (
  select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
         + 8 * (100 * n_dup_lines > 50 * n_lines)::int + 16 * (2 * word_chars < 5 * n_words)::int
         + 32 * (word_chars > 12 * n_words)::int failed from m)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
       n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, failed::bigint failed,
       (failed & 3) <> 0 base_failed, failed = 0 kept, 2::int policy
from f
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs))


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(ship(spark), sf_dir, "conversations"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure(_documents(spark, sf_dir), length=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.reports(turns.damaged(table(ship(spark), sf_dir, "conversations")), gone="gone")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.profile(_documents(spark, sf_dir))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), width=3, budget=3)


OP9_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
sh as (
  select distinct doc_id, array_to_string(ws[i:i+2], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from d where len(ws) > 0)),
n as (select d.doc_id, count(s) n from d left join sh on sh.doc_id = d.doc_id group by d.doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) i from sh a join sh b on b.s = a.s and b.doc_id > a.doc_id group by 1, 2),
links as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
both_ as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ union select r.x, b.y from reach r join both_ b on b.x = r.y),
least_ as (select x, min(y) m from reach group by x)
select n.doc_id, n.n::bigint n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) component_id, n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) kept
from n left join least_ on least_.x = n.doc_id
"""

OP10_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) b from documents),
s as (select doc_id, k, b[k + 1 : k + 100] t from (select doc_id, b, unnest(range(octet_length(b) - 99)) k from d where octet_length(b) >= 100)),
later as (select doc_id, k from (select doc_id, k, row_number() over (partition by t order by doc_id, k) r from s) where r > 1),
steps as (select doc_id, k, lag(k) over (partition by doc_id order by k) p, lead(k) over (partition by doc_id order by k) q from later),
sums as (
  select doc_id, sum(least(100, coalesce(q, k + 100) - k)) n_removed, count_if(p is null or k > p + 100) n_spans from steps group by doc_id),
first_ as (select doc_id, k, row_number() over (partition by doc_id order by k) i from steps where p is null or k > p + 100),
last_ as (select doc_id, k + 100 e, row_number() over (partition by doc_id order by k) i from steps where q is null or q > k + 100),
gaps as (
  select f.doc_id, coalesce(l.e, 0) a, f.k z from first_ f left join last_ l on l.doc_id = f.doc_id and l.i = f.i - 1
  union all select doc_id, max(e), null from last_ group by doc_id),
left_ as (
  select g.doc_id, string_agg(hex(d.b[g.a + 1 : coalesce(g.z, octet_length(d.b))]), '' order by g.a) h
  from gaps g join d on d.doc_id = g.doc_id group by g.doc_id)
select d.doc_id, octet_length(d.b)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
       sha256(coalesce(unhex(h), d.b)) kept_sha256
from d left join sums on sums.doc_id = d.doc_id left join left_ on left_.doc_id = d.doc_id
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pieces": op2_pieces,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_repair": op7_chat_repair,
    "op8_lm_scores": op8_lm_scores,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash": op13_simhash,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op5_quality_rules": OP5_SQL, "op9_near_duplicates": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
