"""Derived review columns: mismatch flag, rating gaps, length buckets, labels, time features."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word-count buckets (right-closed, like pd.cut) and their labels.
LENGTH_BINS5 = ((0, 20, "Very Short"), (20, 50, "Short"), (50, 100, "Medium"), (100, 200, "Long"), (200, None, "Very Long"))
LENGTH_LABELS5 = tuple(b[2] for b in LENGTH_BINS5)
# Fixed value: reference date of the time weight (midnight, UTC-naive).
TIME_WEIGHT_REF = _dt.datetime(2025, 4, 14)
DAY_MS = 86_400_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def misleading(predict, actual, gap: int = 2) -> Column:
    """|predict - actual| >= gap; a missing or NaN side gives False (never NULL, never NaN-true)."""
    p, a = (F.when(F.isnan(x.cast("double")), None).otherwise(x) for x in (_c(predict), _c(actual)))
    return F.coalesce(F.abs(p - a) >= gap, F.lit(False))


def rating_diff(predict, actual) -> Column:
    return _c(predict) - _c(actual)


def length_bucket5(words) -> Column:
    """(0,20] Very Short … (200,∞) Very Long; 0 or null words → null."""
    w = _c(words)
    expr = None
    for lo, hi, label in LENGTH_BINS5:
        cond = (w > lo) if hi is None else ((w > lo) & (w <= hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def length_bucket2(words, threshold: int = 50) -> Column:
    return F.when(_c(words) >= threshold, F.lit("Long")).otherwise(F.lit("Short"))


def verified_label(flag) -> Column:
    """True/1 → Verified, False/0/null → Unverified."""
    f = _c(flag).cast("int")
    return F.when(f == 1, F.lit("Verified")).otherwise(F.lit("Unverified"))


def group_label(length_label, flag, order: str = "length_first") -> Column:
    v = verified_label(flag)
    parts = (length_label, v) if order == "length_first" else (v, length_label)
    return F.concat_ws(" + ", *[_c(p) for p in parts])


def to_number(c) -> Column:
    """A number out of text: null where it does not parse, NaN and infinities included."""
    d = _c(c).cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def to_int(c) -> Column:
    """Text to INT, cutting the fraction; null where it does not parse or fit."""
    return to_number(c).try_cast("int")


def to_long(c) -> Column:
    """Text to BIGINT: whole numbers exactly, others with the fraction cut; null where it does not parse or fit."""
    return F.coalesce(_c(c).cast("string").try_cast("bigint"), to_number(c).try_cast("bigint"))


def epoch_ms(c) -> Column:
    """Epoch milliseconds → TIMESTAMP_NTZ (UTC wall clock); unparsable or out of range → null.

    NTZ keeps the value independent of the session / client time zone (the session is pinned to UTC).
    """
    ms = _c(c).try_cast("bigint")
    ok = ms.between(-62135596800000, 253402300799999)
    return F.when(ok, F.timestamp_millis(ms)).cast("timestamp_ntz")


def month_end(ts) -> Column:
    """Month-end label (DATE)."""
    return F.last_day(_c(ts))


def ref_epoch_ms(ref: _dt.datetime = TIME_WEIGHT_REF) -> int:
    return int(ref.replace(tzinfo=_dt.timezone.utc).timestamp() * 1000)


def time_weight(ts_ms, ref: _dt.datetime = TIME_WEIGHT_REF, scale_days: int = 365) -> Column:
    """exp(-whole_days_elapsed / scale); whole days are floored (a future date weighs > 1); null → 0."""
    days = F.floor((F.lit(ref_epoch_ms(ref)) - _c(ts_ms)) / F.lit(DAY_MS))
    return F.coalesce(F.exp(-days / F.lit(float(scale_days))), F.lit(0.0))


def image_count(images) -> Column:
    return F.coalesce(F.size(_c(images)), F.lit(0))
