"""Queries over V2 ``review_texts``: merging, cleaning, word counts, buckets, topics, samples, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.functions import text as T
from starlens.operators import rollups as R
from starlens.operators import sampling as S
from starlens.operators.prepare import prepare_texts
from starlens.plans.fixtures_sql import (
    REVIEW_TEXTS,
    TEXTS_PREPARED,
    WS,
    merged_space_sql,
    strip_sql,
    with_ctes,
    word_count_sql,
)
from starlens.plans.registry import register
from starlens.sources.tables import review_texts, table

TOPIC_ID = 1
BASE = with_ctes(REVIEW_TEXTS)
PREP = with_ctes(REVIEW_TEXTS, TEXTS_PREPARED)
_VLABEL = "CASE WHEN CAST(verified_purchase AS INT) = 1 THEN 'Verified' ELSE 'Unverified' END"
_NOT_WORD = r"[^\p{L}\p{N}_\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]"


def _texts(spark, sf):
    return prepare_texts(review_texts(spark, sf))


def _hash_sql(key: str = "review_id", seed: int = S.DEFAULT_SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


# Character references of the driver tables, as text
_REFS_SQL = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def strip_html_sql(expr: str) -> str:
    e = f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    e = f"regexp_replace({e}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    e = f"regexp_replace({e}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    e = f"regexp_replace({e}, '</?[a-zA-Z!][^>]*>', '', 'g')"
    for ref, ch in _REFS_SQL:
        e = f"replace({e}, '{ref}', '{ch}')"
    return e


def clean_text_sql(expr: str) -> str:
    e = f"lower(regexp_replace({strip_html_sql(f'coalesce({expr}, {chr(39)}{chr(39)})')}, '{_NOT_WORD}', '', 'g'))"
    for abbr, full in T.ABBREVIATIONS:
        e = f"replace({e}, '{abbr}', '{full}')"
    return e


@register(
    "text_merge_period",
    BASE
    + f"""
  SELECT review_id, concat_ws('. ', nullif({strip_sql('title')}, ''), nullif({strip_sql('text')}, '')) AS merged_text
  FROM review_texts""",
)
def text_merge_period(spark, sf):
    """PRJ-4: strip title and text; 'title. text', or the non-empty one, or ''."""
    d = review_texts(spark, sf)
    return d.select("review_id", T.merge_text("title", "text", ". ", strip=True).alias("merged_text"))


@register(
    "text_merge_space",
    BASE + f" SELECT review_id, {merged_space_sql()} AS review_text FROM review_texts",
)
def text_merge_space(spark, sf):
    """PRJ-5: coalesce(title,'') || ' ' || coalesce(text,'')."""
    d = review_texts(spark, sf)
    return d.select("review_id", T.merge_text("title", "text", " ").alias("review_text"))


@register(
    "min_text_filter",
    BASE
    + f""" SELECT review_id, length({merged_space_sql()}) AS review_chars FROM review_texts
  WHERE length({merged_space_sql()}) > 20""",
)
def min_text_filter(spark, sf):
    """FLT-1 / FUN-2: rows whose merged text is longer than 20 characters."""
    return _texts(spark, sf).select("review_id", T.char_length("review_text").alias("review_chars"))


@register(
    "word_counts",
    PREP
    + f""" SELECT review_id, review_words, text_length,
         {word_count_sql(strip_sql('title'))} AS title_words FROM texts_prepared""",
)
def word_counts(spark, sf):
    """FUN-1: whitespace word counts of merged text, raw text and stripped title (null → 0)."""
    d = _texts(spark, sf)
    return d.select("review_id", "review_words", "text_length", T.word_count(T.strip_ws("title")).alias("title_words"))


@register(
    "length_buckets",
    PREP
    + f""" SELECT review_id, length_category,
         CASE WHEN review_words >= 50 THEN 'Long' ELSE 'Short' END AS length_class,
         concat_ws(' + ', CASE WHEN review_words >= 50 THEN 'Long' ELSE 'Short' END, {_VLABEL}) AS review_group,
         concat_ws(' + ', {_VLABEL}, CASE WHEN review_words >= 50 THEN 'Long' ELSE 'Short' END) AS review_group_v
  FROM texts_prepared""",
)
def length_buckets(spark, sf):
    """PRJ-7, PRJ-8, PRJ-9, PRJ-10: five length buckets, Long/Short, and both group-label orders."""
    d = _texts(spark, sf)
    cls = X.length_bucket2("review_words")
    return d.select(
        "review_id",
        "length_category",
        cls.alias("length_class"),
        X.group_label(cls, "verified_purchase", "length_first").alias("review_group"),
        X.group_label(cls, "verified_purchase", "verified_first").alias("review_group_v"),
    )


@register(
    "clean_text",
    BASE + f" SELECT review_id, {clean_text_sql('text')} AS clean_text, {clean_text_sql('title')} AS clean_title FROM review_texts",
)
def clean_text(spark, sf):
    """FUN-3 + FUN-4: HTML stripped, punctuation dropped, lower-cased, abbreviations expanded; null → ''."""
    d = review_texts(spark, sf)
    return d.select("review_id", T.clean_text("text").alias("clean_text"), T.clean_text("title").alias("clean_title"))


@register(
    "empty_text_count",
    BASE + f" SELECT count_if({clean_text_sql('text')} = '') AS empty_text_count, count(*) AS total_reviews FROM review_texts",
)
def empty_text_count(spark, sf):
    """AGG-4: reviews whose cleaned text is empty."""
    d = review_texts(spark, sf)
    return d.agg(
        F.count_if(T.clean_text("text") == "").alias("empty_text_count"), F.count(F.lit(1)).alias("total_reviews")
    )


_REF_MS = X.ref_epoch_ms()


@register(
    "time_features",
    BASE
    + f"""
  SELECT review_id, make_timestamp(timestamp * 1000) AS review_time, last_day(make_timestamp(timestamp * 1000)) AS month,
         round(coalesce(exp(-floor(({_REF_MS} - timestamp) / 86400000) / 365.0), 0.0), 6) AS time_weight,
         coalesce(len(images), 0) AS image_count, CAST(verified_purchase AS INT) AS verified_int
  FROM review_texts""",
)
def time_features(spark, sf):
    """FUN-5…FUN-9: epoch ms → time, month end, time weight (2025-04-14, whole days), image count, 0/1 flag."""
    d = review_texts(spark, sf)
    return d.select(
        "review_id",
        X.epoch_ms("timestamp").alias("review_time"),
        X.month_end(X.epoch_ms("timestamp")).alias("month"),
        F.round(X.time_weight("timestamp"), 6).alias("time_weight"),
        X.image_count("images").alias("image_count"),
        F.col("verified_purchase").cast("int").alias("verified_int"),
    )


@register(
    "truncate_preview",
    PREP
    + """ SELECT review_id, CASE WHEN length(review_text) > 400 THEN concat(substr(review_text, 1, 400), '...')
                              ELSE review_text END AS preview FROM texts_prepared""",
)
def truncate_preview(spark, sf):
    """PRJ-11: first 400 characters + '...' when longer."""
    return _texts(spark, sf).select("review_id", T.truncate_text("review_text", 400).alias("preview"))


@register(
    "review_projection",
    BASE
    + f"""
  SELECT rating, {word_count_sql('text')} AS text_word_length, coalesce(helpful_vote, 0) AS helpful_vote,
         CAST(coalesce(verified_purchase, false) AS INT) AS verified_purchase, predict_stars,
         coalesce(asin, '') AS asin, '' AS parent_asin, coalesce(user_id, '') AS user_id, timestamp,
         coalesce(title, '') AS title, coalesce(text, '') AS text
  FROM review_texts WHERE rating IS NOT NULL""",
)
def review_projection(spark, sf):
    """PRJ-1: the fixed 11-column projection with defaults; rows without a rating are dropped."""
    from starlens.sources.readers import review_projection as project

    return project(review_texts(spark, sf))


@register(
    "topic_counts",
    PREP
    + """ SELECT topic, count(*) AS n_reviews, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM texts_prepared WHERE topic IS NOT NULL GROUP BY topic""",
)
def topic_counts(spark, sf):
    """AGG-7: reviews per topic and share."""
    return R.topic_counts(_texts(spark, sf))


@register(
    "topic_rating_diff",
    PREP
    + """ SELECT topic, round(avg(rating_diff), 6) AS avg_rating_diff, count(rating_diff) AS review_count
  FROM texts_prepared WHERE topic IS NOT NULL GROUP BY topic""",
)
def topic_rating_diff(spark, sf):
    """AGG-15: mean (predict − rating) and its non-null count per topic."""
    return R.topic_rating_diff(_texts(spark, sf))


_LEN_NAMES = ("very_short_pct", "short_pct", "medium_pct", "long_pct", "very_long_pct")


def _crosstab_sql(col: str, values, names) -> str:
    cols = ", ".join(
        f"round(count_if({col} = {v}) * 100.0 / count(*), 6) AS {n}" for v, n in zip(values, names)
    )
    return PREP + f""" SELECT topic, {cols} FROM texts_prepared
  WHERE topic IS NOT NULL AND {col} IS NOT NULL GROUP BY topic"""


@register(
    "topic_length_crosstab",
    _crosstab_sql("length_category", [f"'{v}'" for v in X.LENGTH_LABELS5], _LEN_NAMES),
)
def topic_length_crosstab(spark, sf):
    """AGG-16: row-normalised % of the five length buckets per topic."""
    return R.crosstab_pct(_texts(spark, sf), "topic", "length_category", X.LENGTH_LABELS5, _LEN_NAMES)


@register(
    "topic_verified_crosstab",
    _crosstab_sql("verified_purchase", ["false", "true"], ("not_verified_pct", "verified_pct")),
)
def topic_verified_crosstab(spark, sf):
    """AGG-17: row-normalised % unverified / verified per topic (both columns always present)."""
    return R.crosstab_pct(_texts(spark, sf), "topic", "verified_purchase", (False, True), ("not_verified_pct", "verified_pct"))


_GROUP = f"concat_ws(' + ', CASE WHEN review_words >= 50 THEN 'Long' ELSE 'Short' END, {_VLABEL})"


@register(
    "group_misleading_rate",
    PREP
    + f""" SELECT {_GROUP} AS review_group, round(avg(CAST(is_misleading AS INT)) * 100.0, 6) AS misleading_rate_pct,
         count(*) AS review_count
  FROM texts_prepared WHERE topic = {TOPIC_ID} GROUP BY 1""",
)
def group_misleading_rate(spark, sf):
    """AGG-18: within topic 1, misleading % and count per length × verification group."""
    return R.group_misleading_rate(_texts(spark, sf), TOPIC_ID)


@register(
    "distinct_groups",
    PREP + f" SELECT DISTINCT {_GROUP} AS review_group FROM texts_prepared WHERE topic = {TOPIC_ID}",
)
def distinct_groups(spark, sf):
    """SET-2: unique group labels within topic 1."""
    d = _texts(spark, sf).filter(F.col("topic") == TOPIC_ID)
    return d.select(X.group_label(X.length_bucket2("review_words"), "verified_purchase").alias("review_group")).distinct()


@register(
    "overpredicted",
    PREP
    + f""" SELECT review_id, predict_stars, rating FROM texts_prepared
  WHERE topic = {TOPIC_ID} AND predict_stars - rating >= 2""",
)
def overpredicted(spark, sf):
    """FLT-3: topic-1 reviews whose prediction is at least 2 stars above the rating."""
    d = _texts(spark, sf)
    return d.filter((F.col("topic") == TOPIC_ID) & (F.col("predict_stars") - F.col("rating") >= 2)).select(
        "review_id", "predict_stars", "rating"
    )


@register(
    "overpredicted_sample",
    PREP
    + f""" SELECT review_id, predict_stars, rating FROM texts_prepared
  WHERE topic = {TOPIC_ID} AND predict_stars - rating >= 2
  ORDER BY {_hash_sql()}, review_id LIMIT 15""",
)
def overpredicted_sample(spark, sf):
    """SMP-1 on FLT-3: 15 seeded rows."""
    return S.sample_n(overpredicted(spark, sf), 15, ["review_id"])


_LUM = f"""topic = {TOPIC_ID} AND review_words >= 50 AND CAST(verified_purchase AS INT) = 0 AND is_misleading"""


@register(
    "long_unverified_misleading",
    PREP + f" SELECT review_id, review_words, predict_stars, rating FROM texts_prepared WHERE {_LUM}",
)
def long_unverified_misleading(spark, sf):
    """FLT-5: long ∧ unverified ∧ misleading, within topic 1."""
    d = _texts(spark, sf)
    cond = (
        (F.col("topic") == TOPIC_ID)
        & (F.col("review_words") >= 50)
        & (F.col("verified_purchase").cast("int") == 0)
        & F.col("is_misleading")
    )
    return d.filter(cond).select("review_id", "review_words", "predict_stars", "rating")


@register(
    "sample_reviews",
    PREP
    + f""" SELECT review_id, CASE WHEN length(review_text) > 400 THEN concat(substr(review_text, 1, 400), '...')
                          ELSE review_text END AS preview, predict_stars, rating
  FROM texts_prepared WHERE {_LUM} ORDER BY {_hash_sql()}, review_id LIMIT 5""",
)
def sample_reviews(spark, sf):
    """SMP-1 + PRJ-11: 5 seeded long/unverified/misleading topic-1 reviews with a 400-char preview."""
    d = _texts(spark, sf)
    cond = (
        (F.col("topic") == TOPIC_ID)
        & (F.col("review_words") >= 50)
        & (F.col("verified_purchase").cast("int") == 0)
        & F.col("is_misleading")
    )
    s = S.sample_n(d.filter(cond), 5, ["review_id"])
    return s.select("review_id", T.truncate_text("review_text").alias("preview"), "predict_stars", "rating")


@register(
    "strip_html_pages",
    with_ctes("p AS (SELECT * FROM pages)") + f" SELECT page_id, {strip_html_sql('html')} AS page_text FROM p",
)
def strip_html_pages(spark, sf):
    """FUN-3 on raw web pages: comments, script/style blocks and tags removed, entities decoded."""
    p = table(spark, sf, "pages")
    return p.select("page_id", T.strip_html("html").alias("page_text"))


# Markup around each document's language and number, and what a reader of the page sees (written by hand)
_HTML_CASES = (
    ("5 < 10 and 7 > 3 good {}", "5 < 10 and 7 > 3 good {}"),
    ("<p class='x'>a {}</p><br/>b", "a {}b"),
    ("&#34;{}&#34; &eacute;t&eacute; &#xe9;&#233; &hellip;&mdash;", '"{}" \u00e9t\u00e9 \u00e9\u00e9 \u2026\u2014'),
    ("a<!-- gone {} <b> -->{}<script type=x>if (a<b) {{}}</script><STYLE>p{{}}</STYLE>!", "a{}!"),
    ("&amp;lt;{}&amp;#34; &nosuch; &#0; &#x110000; AT&T", "&lt;{}&#34; &nosuch; &#0; &#x110000; AT&T"),
    ("<!DOCTYPE html><?xml v?><h1>{}</h1 >x<3 <-- &nbsp;y", "{}x<3 <--  y"),
    ("&#128512;&#x1F600; {} &apos;&lt;&gt;", "\U0001f600\U0001f600 {} '<>"),
)


def _case_sql(pick: int) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    whole = lambda t: " || ".join(quote(x.replace("{{}}", "{}")) if x != "\0" else "n" for x in _pieces(t))
    return "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {whole(c[pick])}" for i, c in enumerate(_HTML_CASES)) + " END"


def _pieces(t: str) -> list[str]:
    """The text's parts, with a mark for each place of the number."""
    out = []
    for i, x in enumerate(t.replace("{{}}", "\1").split("{}")):
        out += ["\0", x] if i else [x]
    return [x.replace("\1", "{}") for x in out]


@register(
    "strip_html_cases",
    f"SELECT doc_id, {_case_sql(1)} AS page_text FROM (SELECT doc_id, lang || CAST(doc_id AS VARCHAR) AS n FROM documents)",
)
def strip_html_cases(spark, sf):
    """FUN-3 on hand-written markup around each document's number: text that is no tag stays, references are decoded once."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("n"))
    case = None
    for i, (raw, _) in enumerate(_HTML_CASES):
        value = F.concat(*[F.col("n") if x == "\0" else F.lit(x) for x in _pieces(raw)])
        case = F.when(F.col("doc_id") % 7 == i, value) if case is None else case.when(F.col("doc_id") % 7 == i, value)
    return d.select("doc_id", T.strip_html(case).alias("page_text"))


@register(
    "misleading_nan",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 5 THEN true ELSE false END AS is_misleading FROM documents""",
)
def misleading_nan(spark, sf):
    """PRJ-5 with missing values: 5 against 1 and 1 against 3 mislead; NaN or null on either side, and a gap of one, do not."""
    k = F.col("doc_id") % 6
    nan = F.lit(float("nan"))
    p = F.when(k == 0, 5.0).when(k == 1, nan).when(k == 2, 4.0).when(k == 3, F.lit(None).cast("double")).when(k == 4, 4.0).otherwise(1.0)
    a = F.when(k == 0, 1.0).when(k == 1, 3.0).when(k == 2, nan).when(k == 3, 1.0).when(k == 4, 3.0).otherwise(3.0)
    return table(spark, sf, "documents").select("doc_id", X.misleading(p, a).alias("is_misleading"))


_NULL_COLS = ("review_id", "asin", "user_id", "category", "title", "text", "rating", "predict_stars",
              "verified_purchase", "helpful_vote", "timestamp", "topic", "images")


@register(
    "null_counts",
    BASE + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM review_texts" for c in _NULL_COLS
    ),
)
def null_counts(spark, sf):
    """AGG-3: nulls per column, one pass, long form."""
    return R.null_counts(review_texts(spark, sf), list(_NULL_COLS))
