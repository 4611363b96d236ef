"""The one-pass cube reports equal the row-based definitions; top-k ties break by key."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from starlens.operators import rollups as R
from starlens.operators.prepare import prepare_reviews
from starlens.sources.tables import reviews


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cube_equals_row_based(spark):
    df = prepare_reviews(reviews(spark, SF_SMALL))
    for key, lo in (("product_id", 20), ("user_id", 5)):
        top = R.mismatch(df, key, lo, 10)
        cube = R.key_cube(df, key)
        assert rows(R.top_from_cube(cube, key, lo, 10)) == rows(top)
        ct = R.cube_of_top(cube, key, lo, 10)
        assert rows(R.rate_from_cube(ct, key)) == rows(R.rate_by_verified(df, top, key))
        keys = () if key == "product_id" else (key,)
        how = "count" if key == "product_id" else "sum"
        src = R.rows_of(df, top, key, only_misleading=(how == "count"))
        assert rows(R.trend_from_cube(ct, keys, how)) == rows(R.monthly_trend(src, keys, how))


def test_top_k_ties_by_key(spark):
    df = spark.createDataFrame(
        [("b", True), ("b", False), ("a", True), ("a", False), ("c", False)], "product_id string, is_misleading boolean"
    )
    got = [r[0] for r in R.mismatch(df, "product_id", 1, 2).collect()]
    assert got == ["a", "b"]


def test_rate_pivot_missing_class(spark):
    rates = spark.createDataFrame([("p", "Verified", 12.345)], "product_id string, verification string, misleading_rate_pct double")
    r = R.rate_pivot(rates, "product_id").collect()[0]
    assert r["unverified_rate_pct"] is None and r["verified_rate_pct"] == 12.34


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("x", 3), ("x", 3), ("x", 1), ("x", 1)], "asin string, topic int")
    assert df.groupBy("asin").agg(F.mode("topic", deterministic=True)).first()[1] == 1
