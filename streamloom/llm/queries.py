"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, license_scan, mixing, paragraph_dedup, pii, quality, secret_scan, sentencepiece_codec, simhash, suffix_dedup
from .common import documents

STRIP = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_report(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_report(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.remove_paragraphs(documents(spark, sf_dir)).drop("kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


OP3_SQL = f"""
with t as (select doc_id, coalesce(text, '') as txt, {STRIP} as norm from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       sha256(norm) as text_sha256
from t
window w as (partition by norm order by length(txt) desc, doc_id
             rows between unbounded preceding and unbounded following)
"""

OP10_SQL = r"""
with t as (select doc_id, coalesce(text, '') as txt from documents),
w as (select doc_id, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') as ws from t),
win as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as k
  from w, lateral (select unnest(generate_series(1, len(ws) - 7)) as i)
),
dup as (select doc_id, i, count(*) over (partition by doc_id, k) as c from win),
cov as (
  select doc_id, sum(least(8, i - coalesce(prev, -8)))::bigint as n from (
    select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from dup where c > 1)
  group by doc_id
),
line as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup from (
    select doc_id, unnest(string_split(txt, chr(10))) as x from t)
  where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id
),
m as (
  select w.doc_id, len(ws)::bigint as n_words,
    length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup, 0)::bigint as n_dup_lines,
    coalesce(cov.n, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines
  from w left join cov on cov.doc_id = w.doc_id left join line on line.doc_id = w.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 2 * n_symbols > n_words
       or word_chars > 40 * n_words or 2 * n_dup_lines > n_lines) as kept
from m
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: x::hugeint)) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "len(d) between 14 and 19 and luhn % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) between 10 and 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?", "iban = 1"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "regexp_matches(lower(substr(txt, greatest(start - 40, 0) + 1, least(start, 40))), 'ssn|social security')"),
)


def _op2_sql() -> str:
    parts = []
    for ord_, (kind, pattern, valid) in enumerate(_KINDS):
        parts.append(
            f"""select * from (
  select doc_id, txt, {ord_} as ord, '{kind}' as kind, m, regexp_replace(m, '[^0-9]', '', 'g') as d,
    (sum(length(g) + length(m)) over (partition by doc_id order by i rows unbounded preceding) - length(m))::bigint as start
  from (select doc_id, txt, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, generate_subscripts(ms, 1) as i
        from (select doc_id, txt, regexp_extract_all(txt, '{pattern}') as ms,
                     string_split_regex(txt, '{pattern}') as gs from t) where len(ms) > 0))"""
        )
    luhn = (
        "list_sum(list_transform(generate_series(1, len(d)), lambda i: "
        "case when (len(d) - i) % 2 = 0 then d[i]::int when d[i]::int > 4 then 2 * d[i]::int - 9 else 2 * d[i]::int end))"
    )
    turned = "concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4))"
    number = (
        f"array_to_string(list_transform(regexp_extract_all({turned}, '.'), "
        "lambda c: case when c < 'A' then c else (ascii(c) - 55)::varchar end), '')"
    )
    iban = (
        f"list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all({number}, '.'), "
        "lambda c: c::bigint)), lambda a, b: (a * 10 + b) % 97)"
    )
    tests = " or ".join(f"(kind = '{k}' and ({v}))" for k, _, v in _KINDS[1:])
    return f"""
with t as (select doc_id, coalesce(text, '') as txt from documents),
raw as ({" union all ".join(parts)}),
s1 as (select *, case when kind = 'card' and len(d) between 14 and 19 then {luhn} end as luhn,
              case when kind = 'iban' then {iban} end as iban from raw),
s as (select *, concat(kind, ':', start, ':', start + length(m)) as span from s1 where kind = 'email' or case
  {" ".join(f"when kind = '{k}' then ({v})" for k, _, v in _KINDS[1:])} end),
g as (
  select doc_id,
    count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
    count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    string_agg(span, ',' order by start, ord) filter (ord < 4) as base,
    string_agg(span, ',' order by start, ord) as spans
  from s group by doc_id)
select t.doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip,
  coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g on g.doc_id = t.doc_id
"""


OP7_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, (length(h) // 2)::bigint as n from d),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as k from n, lateral (select unnest(range(n - 49)) as i) where n >= 50),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as lo from w) where lo < doc_id),
s as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as first from r),
g as (select doc_id, i, sum(first) over (partition by doc_id order by i rows unbounded preceding) as run from s),
sp as (select doc_id, min(i) as a, max(i) + 50 as z from g group by doc_id, run),
gap as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as f, a as t from sp
  union all select sp.doc_id, max(z), any_value(n.n) from sp join n on n.doc_id = sp.doc_id group by sp.doc_id),
k as (
  select gap.doc_id, string_agg(substr(n.h, 2 * f + 1, 2 * (t - f)), '' order by f) as kept
  from gap join n on n.doc_id = gap.doc_id group by gap.doc_id),
c as (select doc_id, count(*) as n_spans, sum(z - a)::bigint as gone from sp group by doc_id)
select n.doc_id, n.n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, n.h))) as kept_sha256
from n left join c on c.doc_id = n.doc_id left join k on k.doc_id = n.doc_id
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {
    "op2_pii": _op2_sql(),
    "op3_exact_dedup": OP3_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
}
