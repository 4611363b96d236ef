"""Query over V2 × V3: lexicon sentiment with idioms and phrase rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.text import clean_text
from starlens.operators import phrases as P
from starlens.operators import sentiment as SE
from starlens.plans.fixtures_sql import LEXICON, REVIEW_TEXTS, WS, with_ctes
from starlens.plans.products import _in
from starlens.plans.registry import register
from starlens.plans.texts import clean_text_sql
from starlens.sources.tables import lexicon, review_texts

# Every text opens with one of these, so each rule meets the text's own first words.
OPENINGS = (
    "kind of", "sort of", "kind", "never so", "never this", "never", "without doubt", "without a doubt", "least", "at least",
    "very least", "not very", "the kiss of death", "yeah right", "they cut the mustard", "this is the bomb", "hand to mouth but", "",
)
# Words of the idioms, which the fixture lexicon lacks.
IDIOM_WORDS = (("kiss", 1.8), ("death", -2.9), ("right", 0.8), ("cut", -1.1), ("bomb", -2.2), ("hand", 0.5), ("mouth", 0.3))


def _boost(p: str, scale: float) -> str:
    return f"CASE WHEN {p} IN {_in(SE.BOOST_UP)} THEN {SE.BOOST * scale} WHEN {p} IN {_in(P.WORD_DOWN)} THEN {-SE.BOOST * scale} ELSE 0.0 END"


def _step(v: str, p: str, scale: float, factor: str) -> str:
    return f"({v} + sign({v}) * ({_boost(p, scale)})) * ({factor})"


_NEG = f"IN {_in(SE.NEGATORS)} THEN {SE.NEGATION}"
_N1 = f"CASE WHEN p1 {_NEG} ELSE 1.0 END"
_N2 = f"CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN 1.25 WHEN p2 = 'without' AND p1 = 'doubt' THEN 1.0 WHEN p2 {_NEG} ELSE 1.0 END"
_N3 = f"""CASE WHEN p3 = 'never' AND (p2 IN ('so', 'this') OR p1 IN ('so', 'this')) THEN 1.25
  WHEN p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt') THEN 1.0 WHEN p3 {_NEG} ELSE 1.0 END"""
_IDIOM = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.IDIOMS.items()) + " END"
_WINDOWS = ("tok, n1, n2", "tok, n1", "p1, tok", "p2, p1, tok", "p2, p1", "p3, p2, p1", "p3, p2")
_FOUND = "coalesce(" + ", ".join(_IDIOM.format(f"concat_ws(' ', {w})") for w in _WINDOWS) + ")"

ORACLE = (
    with_ctes(
        REVIEW_TEXTS,
        LEXICON,
        f"""words AS (SELECT token, CAST(valence AS DOUBLE) AS valence FROM lexicon WHERE valence <> 0 AND token NOT IN {_in([w for w, _ in IDIOM_WORDS])}
          UNION ALL VALUES {', '.join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in IDIOM_WORDS)})""",
        f"""opened AS (SELECT review_id, CASE review_id % {len(OPENINGS)} {' '.join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OPENINGS))} END
          || ' ' || {clean_text_sql('text')} AS t FROM review_texts)""",
        f"""toks AS (SELECT review_id, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS pos
          FROM (SELECT review_id, list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> '') AS l FROM opened))""",
        """seen AS (SELECT t.*, x.valence AS v, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3,
            lead(tok, 1) OVER w AS n1, lead(tok, 2) OVER w AS n2, min(CASE WHEN tok = 'but' THEN pos END) OVER (PARTITION BY review_id) AS but_pos
          FROM toks t LEFT JOIN words x ON t.tok = x.token WINDOW w AS (PARTITION BY review_id ORDER BY pos))""",
        f"a1 AS (SELECT *, {_step('v', 'p1', 1.0, _N1)} AS w1 FROM seen WHERE v IS NOT NULL)",
        f"a2 AS (SELECT *, {_step('w1', 'p2', 0.95, _N2)} AS w2 FROM a1)",
        f"a3 AS (SELECT *, {_step('w2', 'p3', 0.9, _N3)} AS w3 FROM a2)",
        f"""a4 AS (SELECT *, coalesce({_FOUND}, w3)
            - CASE WHEN concat_ws(' ', p3, p2) IN ('kind of', 'sort of') OR concat_ws(' ', p2, p1) IN ('kind of', 'sort of') THEN 0.293 ELSE 0.0 END AS w4 FROM a3)""",
        f"""a5 AS (SELECT *, CASE WHEN p1 = 'least' AND coalesce(p2, '') NOT IN ('at', 'very') THEN w4 * ({SE.NEGATION}) ELSE w4 END
            * CASE WHEN pos < but_pos THEN 0.5 WHEN pos > but_pos THEN 1.5 ELSE 1.0 END AS x FROM a4)""",
        "sums AS (SELECT review_id, sum(x) AS s FROM a5 GROUP BY review_id)",
    )
    + f""" SELECT review_id, round(greatest(-1.0, least(1.0, coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + {SE.ALPHA}))), 6) AS sentiment
  FROM review_texts LEFT JOIN sums USING (review_id)"""
)


@register("phrase_sentiment", ORACLE)
def phrase_sentiment(spark, sf):
    """SEN-1 with idioms and phrase rules: every review's cleaned text behind one of the openings."""
    hand = spark.createDataFrame(list(IDIOM_WORDS), "token string, valence double")
    words = lexicon(spark, sf).select("token", F.col("valence").cast("double").alias("valence"))
    words = words.where(~F.col("token").isin(*[w for w, _ in IDIOM_WORDS])).unionByName(hand)
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("review_id") % len(OPENINGS) + 1).cast("int"))
    d = review_texts(spark, sf).select("review_id", F.concat(opening, F.lit(" "), clean_text("text")).alias("clean_text"))
    return P.score_phrases(d, ["review_id"], "clean_text", words).select("review_id", F.round("sentiment", 6).alias("sentiment"))
