"""The parts of the queries that SQL can state, as queries of their own, and that SQL.

Each companion takes its rows through the operator whose contract it restates; what the method adds to
them (verdicts, term spans, model scores) is tested against plain versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, disclosure_pii, line_crf, url_templates
from .common import table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "[^\\x20\\x09-\\x0D]+"
#: crc32 of an id as text, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda e, i: xor(e >> 1, (e & 1) * 3988292384))), 4294967295)"


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of quality rules and their verdict."""
    found = line_crf.judge(table(spark, sf_dir, "documents"), line_crf.Chain())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
g AS (SELECT r, k, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d WHERE len(w) >= 3)),
c AS (SELECT r, count(DISTINCT k + j) AS n FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM g), (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (r) LEFT JOIN c USING (r)
"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact unigram side of language-model scoring."""
    found = bloom_lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 10 = 0, FALSE) AS held, list_concat(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}'), [NULL]) AS w FROM documents),
t AS (SELECT r, held, coalesce('w' || x, 'end') AS x FROM (SELECT r, held, unnest(w) AS x FROM d)),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10(coalesce(c, 0) + 0.1)) AS s FROM t LEFT JOIN c USING (x) GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, n.n AS train_tokens, round(s - n_tokens * log10(n.n + 0.1 * (n.v + 1)), 4) AS base_score FROM d JOIN s USING (r), n
"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern side of the personal data search."""
    base = disclosure_pii.base_spans(table(spark, sf_dir, "documents"))
    bare = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    return disclosure_pii.digest(base.select(F.col("_id").alias("doc_id"), bare.alias("base"), bare.alias("spans"))).drop("spans")


_KINDS = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "card": "[0-9]([\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]"}
_FOUND = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS o, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d" for n, (k, p) in enumerate(_KINDS.items()))
_LUHN = "list_sum(list_transform(range(len(g)), lambda i: CASE WHEN i % 2 = 0 THEN g[len(g) - i]::INT WHEN g[len(g) - i]::INT > 4 THEN 2 * g[len(g) - i]::INT - 9 ELSE 2 * g[len(g) - i]::INT END)) % 10 = 0"
PII_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_FOUND}),
u AS (SELECT r, kind, o, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM k WHERE len(m) > 0)),
g AS (SELECT *, string_split(regexp_replace(v, '[^0-9]', '', 'g'), '') AS g, string_split(v, '.') AS q FROM u),
f AS (SELECT r, kind, o, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM g WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'ip' THEN len(list_filter(q, lambda x: length(ltrim(x, '0')) > 3 OR try_cast(right('00' || right(x, 3), 3) AS INT) > 255)) = 0
      WHEN 'card' THEN len(g) BETWEEN 12 AND 19 AND {_LUHN} ELSE len(g) BETWEEN 9 AND 15 END)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o), '')) AS base_sha256
FROM d LEFT JOIN f USING (r) GROUP BY d.r, doc_id
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every url, and the verdict where a rule gives it."""
    found = url_templates.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


_FITS = [f"CASE WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN {{'n': {len(t)}, 'rule': '{t}', 'verdict': '{v}'}} END" for v, t in url_templates.RULES]
URL_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, list_sort(list_filter([{", ".join(_FITS)}], lambda x: x IS NOT NULL), 'DESC')[1] AS f FROM b)
SELECT page_id, host, path, f['rule'] AS rule, f['verdict'] AS ruled FROM c
"""

QUERIES = {"quality_counts": quality_counts, "lm_base": lm_base, "pii_base": pii_base, "url_rules": url_rules}
ORACLE_SQL = {"quality_counts": QUALITY_SQL, "lm_base": LM_SQL, "pii_base": PII_SQL, "url_rules": URL_SQL}
