"""Sentence boundaries learned from the corpus without labels, after the published method of Kiss and Strunk (2006).

First pass, corpus statistics per word type, one aggregate with a map-side combine:
* an abbreviation is a type that mostly stands before a period: the log-likelihood ratio of word and period, weighed by the type's
  length and inner periods and against its uses without a period;
* a sentence starter is a type that stands behind sure boundaries far more often than elsewhere (log-likelihood ratio of the two);
* beside them, how often a type is written small, and how often with a capital inside sentences.

Second pass, over the texts: pieces between end marks are candidates.  A piece ends a sentence unless its last word is an
abbreviation, an initial, a number or an ellipsis; behind an abbreviation, a number or an ellipsis it does so only if the next word has a capital and is a
starter, or is a word that is written small elsewhere and never with a capital inside sentences.

The model is a table of types and is joined, so its size needs no bound; texts are regrouped by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.text import WS_RUN, strip_ws
from starlens.operators.sentiment import word_tokens
from starlens.session import materialise

# Thresholds and the share of an abbreviation's uses that have a period, as published.
ABBREVIATION, STARTER, WITH_PERIOD = 0.3, 30.0, 0.99
OPENING, CLOSING = r"^[\"'(\[]+", r"[\"')\]]+$"
END = r"(?<=[.!?][\"')\]]{0,4})" + WS_RUN


def _core(c: Column) -> Column:
    """A token without quotes and brackets round it."""
    return F.regexp_replace(F.regexp_replace(c, OPENING, ""), CLOSING, "")


def _type(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, r"[.!?,;:]+$", ""))


def _one_period(core: Column) -> Column:
    return core.rlike(r"(^|[^.])\.$")


def _unsure(core: Column) -> Column:
    """Initials, numbers and ellipses: their period is no sign of a boundary."""
    return core.rlike(r"^(\p{L}\.|[0-9]+\.|.*\.\.)$")


def _pairs(texts: DataFrame, text: str) -> DataFrame:
    """One row per token: as it is written (t), and the one before it (p)."""
    w = texts.select(word_tokens(F.col(text)).alias("w"))
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("w")), 1, F.size("w"))
    return w.select(F.inline(F.arrays_zip(F.col("w").alias("t"), shifted.alias("p"))))


def type_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, n, n_dot, n_lower, n_capital): uses, uses before one period, written small, with a capital inside a sentence."""
    # uses are counted by token as it is written, so that the patterns see each distinct token once; written, or the filter by type would move below the sum
    inside = F.col("p").isNotNull() & ~F.col("p").rlike(r"[.!?:][\"')\]]*$")
    t = _pairs(texts, text).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.count_if(inside).alias("c_inside"))
    t = materialise(t, "boundary-tokens").select("c", "c_inside", _core(F.col("t")).alias("core")).withColumn("type", _type(F.col("core"))).where(F.col("type").rlike(r"\p{L}"))
    uses = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    return t.groupBy("type").agg(
        F.sum("c").alias("n"),
        uses("c", _one_period(F.col("core"))).alias("n_dot"),
        uses("c", F.col("core").rlike(r"^\p{Ll}")).alias("n_lower"),
        uses("c_inside", F.col("core").rlike(r"^\p{Lu}")).alias("n_capital"),
    )


def abbreviation_score(total: int, dots: int) -> Column:
    """Log-likelihood ratio of type and period, by length, inner periods and uses without a period; null where nothing can be learned."""
    if not 0 < dots < total:
        return F.lit(None).cast("double")
    plain, p = F.col("n") - F.col("n_dot"), dots / total
    length = F.length(F.replace(F.col("type"), F.lit(".")))
    ratio = F.col("n_dot") * (F.log(F.lit(WITH_PERIOD)) - F.log(F.lit(p))) + plain * (F.log(F.lit(1 - WITH_PERIOD)) - F.log(F.lit(1 - p)))
    return 2 * ratio * F.exp(-length) * (F.length("type") - length + 1) * F.pow(length.cast("double"), -plain.cast("double"))


def _log_share(n: Column, of: Column) -> Column:
    """n * ln(n / of), 0 for n = 0."""
    return F.when(n > 0, n * F.log(n / of)).otherwise(0.0)


def starter_score(total: int, boundaries: int) -> Column:
    """Log-likelihood ratio of a boundary and the type behind it (``n_after`` of its ``n`` uses)."""
    n, a = F.col("n").cast("double"), F.col("n_after").cast("double")
    b, rest, whole = F.lit(float(boundaries)), F.lit(float(total - boundaries)), F.lit(float(total))
    split = _log_share(a, b) + _log_share(b - a, b) + _log_share(n - a, rest) + _log_share(rest - n + a, rest)
    return 2 * (split - _log_share(n, whole) - _log_share(whole - n, whole))


def learn_boundaries(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, n, n_dot, n_lower, n_capital, is_abbreviation, n_after, is_starter) of every type of the corpus."""
    counts = materialise(type_counts(texts, text), "boundary-types")
    total, dots = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_dot"), F.lit(0))).first()
    marked = counts.withColumn("is_abbreviation", F.coalesce((F.col("n_dot") > 0) & (abbreviation_score(total, dots) >= ABBREVIATION), F.lit(False)))
    marked = materialise(marked, "boundary-abbreviations")
    # types behind a sure boundary: first per (word before, type), so that the abbreviations meet counts and not tokens
    before = F.col("before")
    sure = F.when(before.rlike(r"[!?]$"), F.lit("")).when(before.rlike(r"\.$") & ~_unsure(before), _type(before))
    ended = _pairs(texts, text).where(F.col("p").rlike(r"[.!?][\"')\]]*$"))  # few tokens follow an end mark: the other patterns see only those
    behind = ended.select(_core(F.col("t")).alias("core"), _core(F.col("p")).alias("before")).withColumn("type", _type(F.col("core")))
    behind = behind.where(F.col("type").rlike(r"\p{L}")).select("type", sure.alias("word")).where("word is not null")
    behind = behind.groupBy("word", "type").agg(F.count(F.lit(1)).alias("c"))
    abbreviations = marked.where("is_abbreviation").select(F.col("type").alias("word"))
    after = materialise(behind.join(abbreviations, "word", "left_anti").groupBy("type").agg(F.sum("c").alias("n_after")), "boundary-starters")
    boundaries = after.agg(F.coalesce(F.sum("n_after"), F.lit(0))).first()[0]
    m = marked.join(after, "type", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    often = F.col("n_after") * F.lit(total) > F.col("n") * F.lit(boundaries)
    starter = (often & (starter_score(total, boundaries) >= STARTER)) if 0 < boundaries < total else F.lit(False)
    return m.withColumn("is_starter", F.coalesce(starter, F.lit(False)))


def split_sentences(df: DataFrame, model: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence) by a learned model; a blank text is one empty sentence, white space between joined pieces becomes one space.

    ``key`` is unique.
    """
    pieces = F.split(strip_ws(F.coalesce(F.col(text), F.lit(""))), END)
    d = df.select(F.col(key).alias("_key"), pieces.alias("p"))
    following = F.slice(F.concat(F.col("p"), F.array(F.lit(None).cast("string"))), 2, F.size("p"))
    d = d.select("_key", F.posexplode(F.arrays_zip(F.col("p").alias("piece"), following.alias("next"))).alias("i", "z"))
    word = lambda c, place: F.regexp_extract(c, place, 1)
    last, first = _core(word(F.col("z.piece"), r"(?<![^\s\x{1C}-\x{1F}\x{85}\p{Z}])([^\s\x{1C}-\x{1F}\x{85}\p{Z}]++)$")), _core(word(F.col("z.next"), r"^([^\s\x{1C}-\x{1F}\x{85}\p{Z}]+)"))
    d = d.select("_key", "i", F.col("z.piece").alias("piece"), last.alias("last"), first.alias("first"), F.col("z.next").isNull().alias("ends"))
    d = d.withColumn("word", _type(F.col("last"))).withColumn("dot", F.col("last").rlike(r"\.$"))
    abbreviations = model.where("is_abbreviation").select(F.col("type").alias("word"), F.lit(True).alias("known"))
    d = d.join(abbreviations, "word", "left")
    initial = F.col("last").rlike(r"^\p{L}\.$")
    held = F.col("dot") & ~F.col("ends") & (F.coalesce("known", F.lit(False)) | _unsure(F.col("last")))
    d = d.withColumn("asks", held & ~initial & F.col("first").rlike(r"^\p{Lu}")).withColumn("cut", ~held)
    # only where the next word decides is it looked up
    asking = d.where("asks").withColumn("type", _type(F.col("first")))
    starts = F.col("is_starter") | (F.col("n_lower") > 0) & (F.col("n_capital") == 0)
    asking = asking.join(model.select("type", starts.alias("starts")), "type", "left").withColumn("cut", F.coalesce("starts", F.lit(False)))
    d = d.where("not asks").select("_key", "i", "piece", "cut").unionByName(asking.select("_key", "i", "piece", "cut"))
    upto = Window.partitionBy("_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # the pieces of one text
    d = d.withColumn("pos", F.coalesce(F.sum(F.col("cut").cast("int")).over(upto), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), " ")
    return d.groupBy(F.col("_key").alias(key), "pos").agg(joined.alias("sentence"))
