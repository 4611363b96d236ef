"""Lexicon sentiment (compound score in [-1, 1]), sentence splitting and the per-review star roll-up.

Scoring follows the published rule-based recipe (Hutto & Gilbert, 2014) on *cleaned* text, so case, "!"
and emoticon rules never apply: each token takes its lexicon valence; a booster among the three preceding
tokens shifts it by ±0.293 (×1, ×0.95, ×0.9 by distance) in the direction of its sign; every negator among
the three preceding tokens multiplies it by −0.74; tokens before the first "but" weigh ×0.5 and after it
×1.5; the sum s is normalised to s / sqrt(s² + 15).

Plan (one pipelined stage per task, then a shuffle of about one row per review):
1. tokens are split once into an array column; each token's look-back context (booster shift, negator
   count, position relative to the first "but") is computed in-row with array functions;
2. ``explode_outer`` the tokens and look valences up with a broadcast hash join — the lexicon is a bounded
   dictionary whose row count is checked before it is broadcast (a sort-merge join takes over above it);
3. ``groupBy(review) sum`` — tokens of one review sit in one task, so the partial aggregate collapses them
   before the shuffle.  A 20,000-word review is never more than one task's stream.
The SQL oracle computes the same score the textbook relational way (unnest, join, lag window).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.text import WS_RUN, clean_text, merge_text

# Negation words (cleaned text has no apostrophes).
NEGATORS = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot", "cant", "dont",
    "doesnt", "didnt", "isnt", "arent", "wasnt", "werent", "wont", "wouldnt", "shouldnt", "couldnt", "hasnt",
    "havent", "hadnt", "aint", "without", "rarely", "seldom",
)
# Intensity boosters (increase) and dampeners (decrease).
BOOST_UP = (
    "absolutely", "amazingly", "completely", "extremely", "very", "really", "so", "totally", "highly",
    "incredibly", "most", "more", "especially", "particularly", "quite", "remarkably", "truly", "hugely",
    "deeply", "entirely", "fully", "greatly", "purely", "thoroughly", "utterly",
)
BOOST_DOWN = (
    "almost", "barely", "hardly", "kind", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sort", "sorta",
)
# Scoring constants of the published recipe.
BOOST = 0.293
BOOST_DISTANCE = (1.0, 0.95, 0.9)
NEGATION = -0.74
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
ALPHA = 15.0
MAX_LEXICON_ROWS = 200_000


def _checked_lexicon(lexicon: DataFrame) -> DataFrame:
    """Materialise the lexicon once (shared checkpoint folder), count it, broadcast it only under the limit."""
    from starlens.session import materialise

    lex = lexicon.select("token", F.col("valence").cast("double").alias("valence")).filter(F.col("valence") != 0)
    lex = materialise(lex, "lexicon")
    n = lex.count()
    return F.broadcast(lex) if n <= MAX_LEXICON_ROWS else lex


def word_tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS_RUN), "")


def _shifted(arr: str, d: int) -> Column:
    """The array shifted right by d (d leading nulls, same length): element i is token i-d."""
    pad = F.array(*[F.lit(None).cast("string")] * d)
    return F.slice(F.concat(pad, F.col(arr)), 1, F.size(arr))


def score_texts(df: DataFrame, keys, clean_col: str, lexicon: DataFrame, carry=()) -> DataFrame:
    """keys + carry + ``n_words`` + compound ``sentiment`` of the (already cleaned) text column.

    The look-back uses shifted copies of the token array zipped with it (codegen-able array functions,
    no interpreted lambdas), then one ``posexplode_outer``.
    """
    keys, carry = list(keys), list(carry)
    d = df.select(*keys, *carry, word_tokens(F.col(clean_col)).alias("_toks"))
    d = d.select(
        *keys, *carry,
        F.size("_toks").alias("n_words"),
        F.array_position("_toks", "but").alias("_but"),
        F.arrays_zip(
            F.col("_toks").alias("tok"), _shifted("_toks", 1).alias("p1"), _shifted("_toks", 2).alias("p2"),
            _shifted("_toks", 3).alias("p3"),
        ).alias("_z"),
    )
    d = d.select(*keys, *carry, "n_words", "_but", F.posexplode_outer("_z").alias("_pos", "_c"))
    d = d.select(*keys, *carry, "n_words", "_but", "_pos", "_c.*")
    d = d.join(_checked_lexicon(lexicon), d["tok"] == F.col("token"), "left")
    boost, negs = F.lit(0.0), F.lit(0)
    for p, scale in zip(("p1", "p2", "p3"), BOOST_DISTANCE):
        boost = boost + F.when(F.col(p).isin(*BOOST_UP), BOOST * scale).when(F.col(p).isin(*BOOST_DOWN), -BOOST * scale).otherwise(0.0)
        negs = negs + F.when(F.col(p).isin(*NEGATORS), 1).otherwise(0)
    pos, but_pos = F.col("_pos") + 1, F.col("_but")
    but = F.when(but_pos == 0, 1.0).when(pos < but_pos, BUT_BEFORE).when(pos > but_pos, BUT_AFTER).otherwise(1.0)
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    x = F.when(v == 0, F.lit(0.0)).otherwise((v + F.signum(v) * boost) * F.pow(F.lit(NEGATION), negs) * but)
    # a text has one first token (or none at all): more of them under one key are several rows of that key
    texts = F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0)
    g = d.groupBy(*keys, *carry, "n_words").agg(F.sum(x).alias("_sum"), texts.alias("_texts"))
    twice = F.raise_error(F.lit("score_texts: equal rows share a key; add one with with_review_key"))
    g = g.withColumn("_s", F.when(F.col("_texts") > 1, twice.cast("double")).otherwise(F.col("_sum"))).drop("_sum", "_texts")
    s = F.col("_s")
    return g.withColumn("sentiment", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + ALPHA)))).drop("_s")


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, key: str = "review_id", text: str = "text", carry=()) -> DataFrame:
    """(key, carry…, n_words, sentiment) on the cleaned text."""
    d = df.withColumn("clean_text", clean_text(text))
    return score_texts(d, [key], "clean_text", lexicon, carry)


# Fixed value: sentence boundary — after . ! or ? followed by whitespace.
SENTENCE_BOUNDARY = r"(?<=[.!?])" + WS_RUN


def sentences(df: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence): rule-based sentence split; blank text gives one empty sentence."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^" + WS_RUN + "|" + WS_RUN + "$", "")
    return df.select(key, F.posexplode(F.split(t, SENTENCE_BOUNDARY)).alias("pos", "sentence"))


def lexicon_star_scorer(lexicon: DataFrame):
    """A sentence scorer: compound sentiment of the cleaned sentence mapped to 1..5 stars; without a word there is no score."""

    def score(sent: DataFrame) -> DataFrame:
        d = sent.withColumn("_clean", clean_text("sentence"))
        key = sent.columns[0]
        scored = score_texts(d, [key, "pos"], "_clean", lexicon)
        star = (F.floor((F.col("sentiment") + 1.0) * 2.5) + 1).cast("int")
        status = F.when(F.col("n_words") > 0, "scored").otherwise("default")
        return scored.withColumn("star", F.least(F.lit(5), F.greatest(F.lit(1), star))).withColumn("star_status", status)

    return score


def predict_stars(df: DataFrame, scorer, key: str = "review_id", text: str = "text", title: str | None = None) -> DataFrame:
    """Split into sentences, score each 1..5, mean of the scored ones per review, round half-to-even; no score → 3.

    With ``title`` the merged "title. text" is scored.  ``scorer`` maps (key, pos, sentence) to a frame with ``star`` and
    ``star_status``; only rows with status ``scored`` count, and ``predict_status`` tells a real 3 from the default.
    """
    d = df.select(key, (merge_text(title, text, ". ", strip=True) if title else F.col(text)).alias("_full"))
    sent = scorer(sentences(d, key, "_full"))
    stars = F.when(F.col("star_status") == "scored", F.col("star"))
    per = sent.groupBy(F.col(key).alias("_rk")).agg(F.bround(F.avg(stars), 0).cast("int").alias("_stars"))
    out = df.join(per, F.col(key) == F.col("_rk"), "left").drop("_rk")
    return out.withColumn(
        "predict_status", F.when(F.col("_stars").isNull(), "default").otherwise("scored")
    ).withColumn("predict_stars", F.coalesce(F.col("_stars"), F.lit(3))).drop("_stars")


def arrow_scorer(load_model, batch_size: int = 40):
    """Plug-in point for a user's own sentence model (e.g. a transformer run with onnxruntime).

    ``load_model()`` runs once per task and returns ``predict(list[str]) -> list[int]`` (stars 1..5).
    Sentences reach it ``batch_size`` at a time through an iterator ``pandas_udf``, whatever the session's Arrow batch size is.  Blank
    sentences and a batch that raises have no score (``star_status = 'default'``) instead of silently looking like a real 3.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<star:int, star_status:string>")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for texts in batches:
            stars: list[int | None] = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            values = texts.tolist()
            for at in range(0, len(asked), batch_size):
                part = asked[at : at + batch_size]
                try:
                    got = [int(x) for x in predict([values[i] for i in part])]
                except Exception:  # the user's model: this batch has no score
                    continue
                for i, x in zip(part, got):
                    stars[i] = x
            yield pd.DataFrame({"star": pd.array(stars, "Int32"), "star_status": ["scored" if x is not None else "default" for x in stars]})

    def score(sent: DataFrame) -> DataFrame:
        out = sent.withColumn("_s", _score(F.col("sentence")))
        return out.select("*", "_s.star", "_s.star_status").drop("_s")

    return score


TRAIN_ROWS = 100_000  # labelled reviews a star model is fitted on, at most


def fit_star_model(df: DataFrame, text: str, rating: str, stop, keys, max_rows: int = TRAIN_ROWS, vocab_size: int = 20_000, seed: int = 42):
    """TF-IDF and multinomial logistic regression on a seeded sample of at most ``max_rows`` rated reviews (the bound is this parameter)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    from starlens.operators.models import tokenise_stages
    from starlens.operators.sampling import sample_n

    rated = df.select(*keys, F.col(text).alias("sentence"), F.col(rating).cast("double").alias("_label")).where("_label between 1 and 5 and sentence is not null")
    train = sample_n(rated, max_rows, list(keys), seed)
    stages = [
        *tokenise_stages("sentence", stop),
        CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=vocab_size, minDF=2.0),
        IDF(inputCol="_tf", outputCol="_idf"),
        LogisticRegression(featuresCol="_idf", labelCol="_label", predictionCol="_star", maxIter=20, regParam=0.01, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(train)


def model_star_scorer(model):
    """A sentence scorer from ``fit_star_model``; a sentence without a token has no score."""

    def score(sent: DataFrame) -> DataFrame:
        out = model.transform(sent.withColumn("sentence", F.coalesce("sentence", F.lit(""))))
        status = F.when(F.size("_words") > 0, "scored").otherwise("default")
        return out.select(*sent.columns, F.col("_star").cast("int").alias("star"), status.alias("star_status"))

    return score
