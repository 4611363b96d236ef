"""Queries of the sentence boundary model: learned from ``documents``, applied to the review texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.operators import boundaries as B
from starlens.plans.fixtures_sql import REVIEW_TEXTS, WS, strip_sql, with_ctes
from starlens.plans.registry import register
from starlens.sources.tables import review_texts, table

_S = ""


def _core(expr: str) -> str:
    return f"""regexp_replace(regexp_replace({expr}, '^["''(\\[]+', ''), '["'')\\]]+$', '')"""


def _type(core: str) -> str:
    return f"lower(regexp_replace({core}, '[.!?,;:]+$', ''))"


def _share(n: str, of: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {n} * ln({n} / {of}) ELSE 0.0 END"


_UNSURE = "regexp_matches({0}, '^(\\p{{L}}\\.|[0-9]+\\.|.*\\.\\.)$')"
_MODEL = (
    f"""w AS (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT unnest(w) AS t, unnest(list_concat([NULL], list_slice(w, 1, len(w) - 1))) AS p FROM w WHERE len(w) > 0),
k AS (SELECT *, {_type('core')} AS type FROM (SELECT {_core('t')} AS core, {_core('p')} AS before FROM t)),
c AS (
  SELECT type, count(*) AS n, count_if(regexp_matches(core, '(^|[^.])\\.$')) AS n_dot, count_if(regexp_matches(core, '^\\p{{Ll}}')) AS n_lower,
    count_if(before IS NOT NULL AND NOT regexp_matches(before, '[.!?:]$') AND regexp_matches(core, '^\\p{{Lu}}')) AS n_capital
  FROM k WHERE regexp_matches(type, '\\p{{L}}') GROUP BY type),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n_dot) AS DOUBLE) AS dots FROM c),
a AS (
  SELECT c.*, total, coalesce(n_dot > 0 AND dots > 0 AND dots < total AND
      2 * (n_dot * (ln({B.WITH_PERIOD}) - ln(dots / total)) + (n - n_dot) * (ln(1 - {B.WITH_PERIOD}) - ln(1 - dots / total)))
      * exp(-len) * (length(type) - len + 1) * pow(CAST(len AS DOUBLE), CAST(n_dot - n AS DOUBLE)) >= {B.ABBREVIATION}, false) AS is_abbreviation
  FROM (SELECT *, length(replace(type, '.', '')) AS len FROM c) c, s),
f AS (
  SELECT type, count(*) AS n_after FROM (
    SELECT type, CASE WHEN regexp_matches(before, '[!?]$') THEN '' WHEN regexp_matches(before, '\\.$') AND NOT """
    + _UNSURE.format("before")
    + f""" THEN {_type('before')} END AS word
    FROM k WHERE regexp_matches(type, '\\p{{L}}'))
  WHERE word IS NOT NULL AND word NOT IN (SELECT type FROM a WHERE is_abbreviation) GROUP BY type),
g AS (SELECT CAST(sum(n_after) AS DOUBLE) AS b FROM f),
h AS (SELECT a.*, coalesce(n_after, 0) AS n_after, coalesce(b, 0.0) AS b, CAST(n AS DOUBLE) AS x, CAST(coalesce(n_after, 0) AS DOUBLE) AS y FROM a LEFT JOIN f USING (type), g),
model AS (
  SELECT type, n, n_dot, n_lower, n_capital, is_abbreviation, n_after,
    b > 0 AND b < total AND y * total > x * b AND 2 * ({_share('y', 'b')} + {_share('(b - y)', 'b')} + {_share('(x - y)', '(total - b)')} + {_share('(total - b - x + y)', '(total - b)')}
      - ({_share('x', 'total')}) - ({_share('(total - x)', 'total')})) >= {B.STARTER} AS is_starter
  FROM h)"""
)
_SENTENCES = (
    f"""q AS (
  SELECT review_id, unnest(p) AS piece, unnest(range(0, len(p))) AS i, unnest(list_concat(list_slice(p, 2, len(p)), [NULL])) AS next FROM (
    SELECT review_id, string_split(regexp_replace({strip_sql("coalesce(text, '')")}, '([.!?]["'')\\]]{{0,4}}){WS}+', '\\1{_S}', 'g'), '{_S}') AS p FROM review_texts)),
r AS (SELECT *, {_core("regexp_extract(piece, '([^\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+)$', 1)")} AS last, {_core("regexp_extract(next, '^([^\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+)', 1)")} AS first FROM q),
v AS (
  SELECT r.*, next IS NOT NULL AND regexp_matches(last, '\\.$') AND (coalesce(m.is_abbreviation, false) OR """
    + _UNSURE.format("last")
    + f""") AS held, coalesce(d.is_starter OR d.n_lower > 0 AND d.n_capital = 0, false) AS starts
  FROM r LEFT JOIN model m ON m.type = {_type('last')} LEFT JOIN model d ON d.type = {_type('first')}),
u AS (
  SELECT review_id, i, piece, CAST(coalesce(sum(CASE WHEN NOT held OR NOT regexp_matches(last, '^\\p{{L}}\\.$') AND regexp_matches(first, '^\\p{{Lu}}') AND starts THEN 1 ELSE 0 END)
    OVER (PARTITION BY review_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos FROM v)"""
)


@register("boundary_model", with_ctes(_MODEL) + " SELECT * FROM model")
def boundary_model(spark, sf):
    """FUN-12: abbreviations and sentence starters, with their counts, of every word type of the documents."""
    return B.learn_boundaries(table(spark, sf, "documents")).select(
        "type", "n", "n_dot", "n_lower", "n_capital", "is_abbreviation", F.col("n_after").cast("bigint").alias("n_after"), "is_starter"
    )


@register("sentence_boundaries", with_ctes(REVIEW_TEXTS, _MODEL, _SENTENCES) + " SELECT review_id, pos, string_agg(piece, ' ' ORDER BY i) AS sentence FROM u GROUP BY review_id, pos")
def sentence_boundaries(spark, sf):
    """FUN-12: the review texts' sentences by the learned boundaries."""
    from starlens.session import materialise

    model = materialise(B.learn_boundaries(table(spark, sf, "documents")), "boundary-model")
    return B.split_sentences(review_texts(spark, sf), model)
