"""Queries of the markup state machine: raw web pages, and hand-written markup around each document's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.markup import strip_markup
from starlens.plans.fixtures_sql import with_ctes
from starlens.plans.registry import register
from starlens.plans.texts import strip_html_sql
from starlens.sources.tables import table

# (before the number, after it, text before, text after): written by hand
CASES = (
    ('<a title="x > y">', "</a> u", "", " u"),
    ("<b>", " <!-- open <i>c", "", " "),
    ("a <script>if (x < 3) '</b>'</script>", "<style>p{} b", "a ", ""),
    ("5 < 10 <!-->", "<!-- e --!> f", "5 < 10 ", " f"),
    ("&copy 2020 &CounterClockwiseContourIntegral; ", " &amp;lt;", "© 2020 ∳ ", " &lt;"),
    ("</>", " <i class='x>y", "", " "),
    ("a </ b>", "<?php c ?>d<!DOCTYPE html>e", "a ", "de"),
)


def _sql(before: int, after: int) -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return " ".join(f"WHEN {i} THEN {text(c[before])} || n || {text(c[after])}" for i, c in enumerate(CASES))


@register(
    "strip_markup_cases",
    f"""SELECT doc_id, CASE doc_id % {len(CASES)} {_sql(2, 3)} END AS page_text
  FROM (SELECT doc_id, lang || CAST(doc_id AS VARCHAR) AS n FROM documents)""",
)
def strip_markup_cases(spark, sf):
    """FUN-3 by the state machine: quoted attributes, unclosed parts, scripts and references as the HTML standard reads them."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("n"))
    case = F.lit(None).cast("string")
    for i, (before, after, _, _) in enumerate(CASES):
        case = F.when(F.col("doc_id") % len(CASES) == i, F.concat(F.lit(before), "n", F.lit(after))).otherwise(case)
    return d.select("doc_id", strip_markup(case).alias("page_text"))


@register("strip_markup_pages", with_ctes("p AS (SELECT * FROM pages)") + f" SELECT page_id, {strip_html_sql('html')} AS page_text FROM p")
def strip_markup_pages(spark, sf):
    """FUN-3 by the state machine on raw web pages."""
    return table(spark, sf, "pages").select("page_id", strip_markup("html").alias("page_text"))
