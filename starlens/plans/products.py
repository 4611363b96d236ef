"""Queries over V2 × V3: lexicon sentiment, negative reviews, sentences, star roll-up, product risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.operators import products as P
from starlens.operators import sampling as S
from starlens.operators import sentiment as SE
from starlens.operators.groupfn import group_apply
from starlens.plans.fixtures_sql import LEXICON, REVIEW_TEXTS, WS, strip_sql, with_ctes, word_count_sql
from starlens.plans.registry import register
from starlens.plans.texts import clean_text_sql
from starlens.session import materialise
from starlens.sources.tables import lexicon, review_texts

NEG_HEAD = 10_000


def _sentiment(spark, sf):
    d = P.review_inputs(review_texts(spark, sf))
    return SE.lexicon_sentiment(d, lexicon(spark, sf), carry=P.CARRY)


def negative_scores(spark, sf, digits=None):
    """(review_id, sentiment) of the negative reviews, written once: a head reads its rows twice."""
    scored = _sentiment(spark, sf)
    scored = scored.withColumn("sentiment", F.round("sentiment", digits)) if digits else scored
    return materialise(scored.filter(F.col("sentiment") < 0).select("review_id", "sentiment"), "negative-scores")


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _boost(p: str, scale: float) -> str:
    return (
        f"CASE WHEN {p} IN {_in(SE.BOOST_UP)} THEN {SE.BOOST * scale} "
        f"WHEN {p} IN {_in(SE.BOOST_DOWN)} THEN {-SE.BOOST * scale} ELSE 0.0 END"
    )


def _neg(p: str) -> str:
    return f"CASE WHEN {p} IN {_in(SE.NEGATORS)} THEN 1 ELSE 0 END"


# The oracle scores relationally: unnest tokens, join the lexicon, look back with lag().
SENTIMENT_CTES = with_ctes(
    REVIEW_TEXTS,
    LEXICON,
    f"clean AS (SELECT *, {clean_text_sql('text')} AS clean_text FROM review_texts)",
    f"""toks AS (SELECT review_id, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS pos
      FROM (SELECT review_id, list_filter(regexp_split_to_array(clean_text, '{WS}+'), lambda w: w <> '') AS l FROM clean))""",
    """looked AS (SELECT t.review_id, t.pos, coalesce(CAST(x.valence AS DOUBLE), 0.0) AS v,
         lag(t.tok, 1) OVER w AS p1, lag(t.tok, 2) OVER w AS p2, lag(t.tok, 3) OVER w AS p3,
         min(CASE WHEN t.tok = 'but' THEN t.pos END) OVER (PARTITION BY t.review_id) AS but_pos
      FROM toks t LEFT JOIN lexicon x ON t.tok = x.token
      WINDOW w AS (PARTITION BY t.review_id ORDER BY t.pos))""",
    f"""adj AS (SELECT review_id,
         CASE WHEN v = 0 THEN 0.0 ELSE
           (v + sign(v) * ({_boost('p1', 1.0)} + {_boost('p2', 0.95)} + {_boost('p3', 0.9)}))
           * pow({SE.NEGATION}, {_neg('p1')} + {_neg('p2')} + {_neg('p3')})
           * CASE WHEN but_pos IS NULL THEN 1.0 WHEN pos < but_pos THEN {SE.BUT_BEFORE}
                  WHEN pos > but_pos THEN {SE.BUT_AFTER} ELSE 1.0 END END AS x
      FROM looked)""",
    "sums AS (SELECT review_id, sum(x) AS s FROM adj GROUP BY review_id)",
    f"""scored AS (SELECT c.*, greatest(-1.0, least(1.0, coalesce(s.s, 0.0) / sqrt(coalesce(s.s, 0.0) * coalesce(s.s, 0.0) + {SE.ALPHA}))) AS sentiment
      FROM clean c LEFT JOIN sums s ON c.review_id = s.review_id)""",
)


@register("lexicon_sentiment", SENTIMENT_CTES + " SELECT review_id, round(sentiment, 6) AS sentiment FROM scored")
def lexicon_sentiment(spark, sf):
    """SEN-1: compound sentiment of the cleaned text with the V3 lexicon."""
    return _sentiment(spark, sf).select("review_id", F.round("sentiment", 6).alias("sentiment"))


@register(
    "negative_reviews",
    SENTIMENT_CTES + " SELECT review_id, asin, round(sentiment, 6) AS sentiment FROM scored WHERE sentiment < 0",
)
def negative_reviews(spark, sf):
    """FLT-4: reviews with sentiment < 0."""
    d = _sentiment(spark, sf).filter(F.col("sentiment") < 0)
    return d.select("review_id", "asin", F.round("sentiment", 6).alias("sentiment"))


@register(
    "head_n_negative",
    SENTIMENT_CTES
    + f" SELECT review_id, round(sentiment, 6) AS sentiment FROM scored WHERE sentiment < 0 ORDER BY review_id LIMIT {NEG_HEAD}",
)
def head_n_negative(spark, sf):
    """SMP-2: the first 10,000 negative reviews by key (the reference's embedding sample)."""
    return S.head_n(negative_scores(spark, sf), NEG_HEAD, "review_id").select("review_id", F.round("sentiment", 6).alias("sentiment"))


_FEATURES_SQL = f"""feat AS (
  SELECT asin, rating, sentiment, {word_count_sql('clean_text')} AS text_length,
         coalesce(len(images), 0) AS image_count,
         coalesce(exp(-floor(({X.ref_epoch_ms()} - timestamp) / 86400000) / 365.0), 0.0) AS time_weight,
         helpful_vote, CAST(verified_purchase AS INT) AS verified_purchase, topic
  FROM scored WHERE asin IS NOT NULL)"""
_MODE_SQL = """modes AS (
  SELECT asin, arg_min(topic, rank_key) AS topic FROM (
    SELECT asin, topic, (-count(*)) * 1000000 + topic AS rank_key FROM feat WHERE topic IS NOT NULL GROUP BY asin, topic)
  GROUP BY asin)"""
_STATS_SQL = """stats AS (
  SELECT asin, round(avg(CAST(rating AS DOUBLE)), 6) AS rating, round(avg(sentiment), 6) AS sentiment,
         round(avg(CAST(text_length AS DOUBLE)), 6) AS text_length, round(avg(CAST(image_count AS DOUBLE)), 6) AS image_count,
         round(avg(time_weight), 6) AS time_weight, round(avg(CAST(helpful_vote AS DOUBLE)), 6) AS helpful_vote,
         round(avg(CAST(verified_purchase AS DOUBLE)), 6) AS verified_purchase,
         round(count(*) / (count_if(sentiment < 0) + 1) * abs(avg(sentiment)), 6) AS reputation_risk,
         round(ln(1 + count(*)), 6) AS sales_proxy
  FROM feat GROUP BY asin)"""
PRODUCT_CTES = SENTIMENT_CTES + ", " + ", ".join([_FEATURES_SQL, _MODE_SQL, _STATS_SQL])


def product_stats_df(spark, sf):
    return P.product_stats(P.product_features(_sentiment(spark, sf)))


@register("product_stats", PRODUCT_CTES + " SELECT s.*, m.topic FROM stats s LEFT JOIN modes m USING (asin)")
def product_stats(spark, sf):
    """AGG-19…21: per-product means, modal topic, reputation risk and sales proxy in one aggregate."""
    return product_stats_df(spark, sf)


@register(
    "stats_join_risk",
    PRODUCT_CTES + " SELECT asin, rating, sentiment, reputation_risk FROM stats",
)
def stats_join_risk(spark, sf):
    """JON-1: product stats ⋈ reputation risk on asin (explicit join form).

    Both sides come from the same scored reviews, so those are written once (shared checkpoint folder):
    the text is scored a single time and each aggregate re-reads a few narrow columns.  Both aggregates are
    hash-partitioned on asin, so the join itself adds no shuffle.
    """
    feats = materialise(P.product_features(_sentiment(spark, sf)), "scored-reviews")
    stats = P.product_stats(feats).select("asin", "rating", "sentiment")
    return P.stats_with_risk(stats, P.reputation_risk(feats))


@register("scatter_series", PRODUCT_CTES + " SELECT asin, rating, reputation_risk, sales_proxy, sentiment FROM stats")
def scatter_series(spark, sf):
    """VIZ-6: rating × risk × sales proxy × sentiment per product."""
    return product_stats_df(spark, sf).select("asin", "rating", "reputation_risk", "sales_proxy", "sentiment")


# Oracle form of the sentence split: mark each boundary with a private-use sentinel, then split on it.
_SENTINEL = "\ue000"
_SENT_CTE = f"""sents AS (
  SELECT review_id, unnest(parts) AS sentence, unnest(range(0, len(parts))) AS pos FROM (
    SELECT review_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g'),
                                                  '([.!?]){WS}+', '\\1{_SENTINEL}', 'g'), '{_SENTINEL}') AS parts
    FROM review_texts))"""


@register(
    "sentence_split",
    with_ctes(REVIEW_TEXTS, _SENT_CTE) + " SELECT review_id, CAST(pos AS INT) AS pos, sentence FROM sents",
)
def sentence_split(spark, sf):
    """FUN-12: (review_id, pos, sentence) — blank text gives one empty sentence."""
    return SE.sentences(review_texts(spark, sf))


# the merged "title. text", each side stripped
_MERGED_SENT_CTE = _SENT_CTE.replace("coalesce(text, '')", "coalesce(merged, '')").replace(
    "FROM review_texts", f"FROM (SELECT review_id, concat_ws('. ', nullif({strip_sql('title')}, ''), nullif({strip_sql('text')}, '')) AS merged FROM review_texts)"
)


def _star_sql() -> str:
    """Sentence stars with the lexicon scorer on title and text, mean of the sentences with a word, half-even round, default 3."""
    return with_ctes(
        REVIEW_TEXTS,
        LEXICON,
        _MERGED_SENT_CTE,
        f"sclean AS (SELECT review_id, pos, {clean_text_sql('sentence')} AS c FROM sents)",
        f"""stoks AS (SELECT review_id, pos, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS tpos
          FROM (SELECT review_id, pos, list_filter(regexp_split_to_array(c, '{WS}+'), lambda w: w <> '') AS l FROM sclean))""",
        """slooked AS (SELECT t.review_id, t.pos, t.tpos, coalesce(CAST(x.valence AS DOUBLE), 0.0) AS v,
             lag(t.tok, 1) OVER w AS p1, lag(t.tok, 2) OVER w AS p2, lag(t.tok, 3) OVER w AS p3,
             min(CASE WHEN t.tok = 'but' THEN t.tpos END) OVER (PARTITION BY t.review_id, t.pos) AS but_pos
          FROM stoks t LEFT JOIN lexicon x ON t.tok = x.token
          WINDOW w AS (PARTITION BY t.review_id, t.pos ORDER BY t.tpos))""",
        f"""sadj AS (SELECT review_id, pos,
             CASE WHEN v = 0 THEN 0.0 ELSE
               (v + sign(v) * ({_boost('p1', 1.0)} + {_boost('p2', 0.95)} + {_boost('p3', 0.9)}))
               * pow({SE.NEGATION}, {_neg('p1')} + {_neg('p2')} + {_neg('p3')})
               * CASE WHEN but_pos IS NULL THEN 1.0 WHEN tpos < but_pos THEN {SE.BUT_BEFORE}
                      WHEN tpos > but_pos THEN {SE.BUT_AFTER} ELSE 1.0 END END AS x
          FROM slooked)""",
        "ssum AS (SELECT review_id, pos, sum(x) AS s FROM sadj GROUP BY review_id, pos)",
        f"""sstar AS (SELECT c.review_id, c.pos,
             least(5, greatest(1, CAST(floor((greatest(-1.0, least(1.0, coalesce(s.s, 0.0)
               / sqrt(coalesce(s.s, 0.0) * coalesce(s.s, 0.0) + {SE.ALPHA}))) + 1.0) * 2.5) AS INT) + 1)) AS star
          FROM sclean c JOIN ssum s ON c.review_id = s.review_id AND c.pos = s.pos)""",
        "per AS (SELECT review_id, CAST(round_even(avg(star), 0) AS INT) AS stars FROM sstar GROUP BY review_id)",
    ) + """
  SELECT r.review_id, r.rating, coalesce(p.stars, 3) AS predict_stars,
         CASE WHEN p.stars IS NULL THEN 'default' ELSE 'scored' END AS predict_status
  FROM review_texts r LEFT JOIN per p ON r.review_id = p.review_id"""


@register(
    "sentence_counts",
    with_ctes(REVIEW_TEXTS)
    + f""" SELECT review_id,
         CAST(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g'), '[.!?]{WS}+')) + 1 AS BIGINT)
           AS n_sentences
  FROM review_texts""",
)
def sentence_counts(spark, sf):
    """FUN-12 roll-up: sentences per review."""
    return SE.sentences(review_texts(spark, sf)).groupBy("review_id").agg(F.count(F.lit(1)).alias("n_sentences"))


@register("star_rollup", _star_sql())
def star_rollup(spark, sf):
    """ML-6: per-sentence stars (lexicon scorer) of "title. text" → mean → half-even round → default 3 with a status column."""
    d = review_texts(spark, sf).select("review_id", "title", "text", "rating")
    out = SE.predict_stars(d, SE.lexicon_star_scorer(lexicon(spark, sf)), title="title")
    return out.select("review_id", "rating", "predict_stars", "predict_status")


_STAR_BY_ASIN = _star_sql().replace("SELECT r.review_id, r.rating,", ", stars AS (SELECT r.review_id, r.asin,", 1) + """)
  SELECT asin, count(*) AS n_rows, CAST(sum(predict_stars) AS BIGINT) AS sum_stars, count_if(predict_status = 'default') AS n_default FROM stars GROUP BY asin"""


@register("score_job", _STAR_BY_ASIN)
def score_job(spark, sf):
    """The scoring job: raw JSON lines (some broken) → title and text scored in a stream → JSON lines; resumed twice, adding nothing the second time."""
    from starlens.plans.io import scored_records
    from starlens.session import scratch_path
    from starlens.streaming.ingest import stream_score

    raw = scored_records(spark, sf).drop("predict_stars", "category")
    src, dst, ck = (scratch_path(spark, f"score-{x}") for x in ("src", "dst", "ckpt"))
    broken = lambda d: d.select(F.to_json(F.struct(*[c for c in d.columns if c != "review_id"])).alias("value")).unionByName(d.limit(3).select(F.lit('{"rating": 1, "te').alias("value")))
    scorer = SE.lexicon_star_scorer(lexicon(spark, sf))
    broken(raw.where("review_id % 2 = 0")).write.mode("append").text(src)
    stream_score(spark, src, dst, ck, scorer)
    broken(raw.where("review_id % 2 = 1")).write.mode("append").text(src)
    stream_score(spark, src, dst, ck, scorer)
    stream_score(spark, src, dst, ck, scorer)
    out = spark.read.schema("asin string, predict_stars int, predict_status string").json(dst)
    return out.groupBy("asin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("predict_stars").alias("sum_stars"), F.count_if(F.col("predict_status") == "default").alias("n_default")
    )


STAR_TRAIN_ROWS = 400


@register(
    "star_trained",
    with_ctes(REVIEW_TEXTS) + f" SELECT count(*) AS n_reviews, CAST(0 AS BIGINT) AS n_outside, least(count_if(rating IS NOT NULL AND text IS NOT NULL), {STAR_TRAIN_ROWS}) AS n_train, true AS has_scores FROM review_texts",
)
def star_trained(spark, sf):
    """ML-6 with a trained sentence scorer: TF-IDF and logistic regression on at most 400 rated reviews, applied to all."""
    from starlens.operators.vocab import STOP_WORDS_EN

    d = review_texts(spark, sf).select("review_id", "title", "text", "rating")
    model = SE.fit_star_model(d, "text", "rating", STOP_WORDS_EN, ["review_id"], max_rows=STAR_TRAIN_ROWS)
    out = SE.predict_stars(d, SE.model_star_scorer(model), title="title")
    n_train = S.sample_n(d.where("rating is not null and text is not null").select("review_id"), STAR_TRAIN_ROWS, ["review_id"]).count()
    return out.agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(~F.col("predict_stars").between(1, 5)).alias("n_outside"),
        F.lit(n_train).cast("bigint").alias("n_train"), (F.count_if(F.col("predict_status") == "scored") > 0).alias("has_scores"),
    )


HEAD_SMALL = 40


@register(
    "head_small_negative",
    SENTIMENT_CTES
    + f" SELECT review_id, round(sentiment, 6) AS sentiment FROM scored WHERE sentiment < 0 ORDER BY round(scored.sentiment, 12), review_id LIMIT {HEAD_SMALL}",
)
def head_small_negative(spark, sf):
    """SMP-2 with a limit that binds: the 40 most negative reviews, ties by key."""
    d = negative_scores(spark, sf, 12)
    return S.head_n(d, HEAD_SMALL, ["sentiment", "review_id"]).select("review_id", F.round("sentiment", 6).alias("sentiment"))


def _risk_update(state, rows):
    """(reviews, negative ones, scored ones, sum of the scores) with more rows."""
    v = [x for x in rows.column("sentiment").to_pylist() if x is not None]
    return state[0] + rows.num_rows, state[1] + sum(x < 0 for x in v), state[2] + len(v), state[3] + sum(v)


@register("group_function_risk", PRODUCT_CTES + " SELECT asin, reputation_risk FROM stats")
def group_function_risk(spark, sf):
    """AGG-20 as a user's own group function: states per task, merged, and finished per product."""
    feats = P.product_features(_sentiment(spark, sf)).where("asin is not null")
    risk = group_apply(
        feats, ["asin"], ["sentiment"], lambda: (0, 0, 0, 0.0), _risk_update, lambda a, b: tuple(x + y for x, y in zip(a, b)),
        lambda s: {"risk": s[0] / (s[1] + 1) * abs(s[3] / s[2]) if s[2] else None}, "risk double",
    )
    return risk.select("asin", F.round("risk", P.DIGITS).alias("reputation_risk"))


@register("reputation_risk", PRODUCT_CTES + " SELECT asin, reputation_risk FROM stats")
def reputation_risk(spark, sf):
    """AGG-20: n / (negatives + 1) · |mean sentiment| per product, from built-in aggregates."""
    return P.reputation_risk(P.product_features(_sentiment(spark, sf)))


@register("sales_proxy", PRODUCT_CTES + " SELECT asin, sales_proxy FROM stats")
def sales_proxy(spark, sf):
    """AGG-21: log1p(review count) per product."""
    return P.sales_proxy(P.product_features(_sentiment(spark, sf)))
