"""Lexicon sentiment with the phrase rules of the published recipe (Hutto & Gilbert, 2014), on cleaned text.

Beside the word rules of ``sentiment.py`` a token of the lexicon sees its window of three tokens before and two after:

* idioms ("kiss of death") replace what the words gave; of several, one that starts at the token wins, longest first, then one that ends at it
  and then one before it, in the order of ``_BEFORE``;
* "kind of" / "sort of" before the token add a dampener, while "kind" and "sort" alone are no boosters here;
* "never so" / "never this" strengthen by 1.25 instead of negating, "without doubt" does not negate;
* "least" directly before the token negates, but in "at least" and "very least".

Boosters and negators act in turn by distance, so each one is signed by what the nearer ones left.  Idioms count at the start of a text too.  An idiom
with two tokens of the lexicon counts at both, as published.

Windows are shifted copies of the token array, so all rules are built-in expressions on the exploded tokens; the plan is that of
``sentiment.score_texts``: one broadcast of the checked lexicon, then one aggregate whose map side sums a text's tokens.

Defined cases: null and blank texts score 0; a key stands for one text (repeated keys raise); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.operators import sentiment as SE

# Idioms of the published recipe and their valences.
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
# Dampening phrases, words after "never" that strengthen it, words before "least" that keep it from negating.
DAMPENERS = ("kind of", "sort of")
STRENGTHENED = ("so", "this")
STRENGTH = 1.25
NOT_LEAST = ("at", "very")

WORD_DOWN = tuple(w for w in SE.BOOST_DOWN if w not in ("kind", "sort"))
# Windows in which an idiom is looked for: from the token on (the longer first), then up to or before it.
_AFTER = (("tok", "n1", "n2"), ("tok", "n1"))
_BEFORE = (("p1", "tok"), ("p2", "p1", "tok"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))


def _ahead(arr: str, d: int) -> Column:
    """The array shifted left by d (same length, nulls at the end): element i is token i+d."""
    size = F.size(arr)
    return F.slice(F.concat(F.slice(F.col(arr), d + 1, F.greatest(size - d, F.lit(0))), F.array_repeat(F.lit(None).cast("string"), d)), 1, size)


def _is(c: str, words) -> Column:
    return F.coalesce(F.col(c).isin(*words), F.lit(False))


def _negation(d: int) -> Column:
    """Factor of the token ``d`` places before."""
    far, nearer = f"p{d}", [f"p{k}" for k in range(1, d)]
    plain = F.when(_is(far, SE.NEGATORS), SE.NEGATION).otherwise(1.0)
    for word, next_words, factor in (("without", ("doubt",), 1.0), ("never", STRENGTHENED, STRENGTH)):
        follows = F.lit(False)
        for c in nearer:
            follows = follows | _is(c, next_words)
        plain = F.when(_is(far, (word,)) & follows, factor).otherwise(plain)
    return plain


def _idiom(idioms: Mapping[str, float]) -> Column:
    if not idioms:
        return F.lit(None).cast("double")
    known = F.create_map(*[F.lit(x) for k, v in idioms.items() for x in (k, float(v))])
    return F.coalesce(*[F.element_at(known, F.concat_ws(" ", *w)) for w in (*_AFTER, *_BEFORE)])


def score_phrases(df: DataFrame, keys, clean_col: str, lexicon: DataFrame, carry=(), idioms: Mapping[str, float] = IDIOMS) -> DataFrame:
    """keys + carry + ``n_words`` + compound ``sentiment`` of the (already cleaned) text column, phrase rules included."""
    rest = [*keys, *carry]
    d = df.select(*rest, SE.word_tokens(F.col(clean_col)).alias("_toks"))
    window = [F.col("_toks").alias("tok")]
    window += [SE._shifted("_toks", k).alias(f"p{k}") for k in (1, 2, 3)]
    window += [_ahead("_toks", k).alias(f"n{k}") for k in (1, 2)]
    d = d.select(*rest, F.size("_toks").alias("n_words"), F.array_position("_toks", "but").alias("_but"), F.arrays_zip(*window).alias("_z"))
    d = d.select(*rest, "n_words", "_but", F.posexplode_outer("_z").alias("_pos", "_c")).select(*rest, "n_words", "_but", "_pos", "_c.*")
    d = d.join(SE._checked_lexicon(lexicon), d["tok"] == F.col("token"), "left")
    # steps as columns: each reads the one before several times
    d = d.withColumn("_v", F.coalesce("valence", F.lit(0.0)))
    for k, scale in zip((1, 2, 3), SE.BOOST_DISTANCE):
        shift = F.when(_is(f"p{k}", SE.BOOST_UP), SE.BOOST * scale).when(_is(f"p{k}", WORD_DOWN), -SE.BOOST * scale).otherwise(0.0)
        d = d.withColumn("_v", (F.col("_v") + F.signum("_v") * shift) * _negation(k))
    dampened = F.concat_ws(" ", "p3", "p2").isin(*DAMPENERS) | F.concat_ws(" ", "p2", "p1").isin(*DAMPENERS)
    d = d.withColumn("_v", F.coalesce(_idiom(idioms), "_v") - F.when(dampened, SE.BOOST).otherwise(0.0))
    d = d.withColumn("_v", F.when(_is("p1", ("least",)) & ~_is("p2", NOT_LEAST), F.col("_v") * SE.NEGATION).otherwise(F.col("_v")))
    pos, but_pos = F.col("_pos") + 1, F.col("_but")
    but = F.when(but_pos == 0, 1.0).when(pos < but_pos, SE.BUT_BEFORE).when(pos > but_pos, SE.BUT_AFTER).otherwise(1.0)
    x = F.when(F.col("valence").isNull(), 0.0).otherwise(F.col("_v") * but)
    texts = F.count_if(F.coalesce("_pos", F.lit(0)) == 0)
    g = d.groupBy(*rest, "n_words").agg(F.sum(x).alias("_sum"), texts.alias("_texts"))
    twice = F.raise_error(F.lit("score_phrases: equal rows share a key; add one with with_review_key")).cast("double")
    s = F.when(F.col("_texts") > 1, twice).otherwise(F.col("_sum"))
    return g.select(*rest, "n_words", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + SE.ALPHA))).alias("sentiment"))
