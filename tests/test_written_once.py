"""Steps that several passes read are written once, and written files stay of a bounded size."""

import pytest
from pyspark.sql import functions as F

from starlens.operators import rollups as R
from starlens.operators import sampling as S
from starlens.operators import vocab as V
from starlens.plans import analysis, io, ml, numeric, products
from starlens.session import scratch_root

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "query, operator",
    [(numeric.top_product_samples, "sample_n"), (analysis.cap_small, "cap_per_group"), (analysis.cap_per_category, "cap_per_group"),
     (products.head_small_negative, "head_n"), (products.head_n_negative, "head_n"), (ml.negative_clusters, "head_n")],
)
def test_samples_read_written_rows(spark, monkeypatch, query, operator):
    class Seen(Exception):
        pass

    def stop(df, *_):
        raise Seen(df.inputFiles())

    monkeypatch.setattr(S, operator, stop)
    with pytest.raises(Seen) as seen:
        query(spark, SF)
    files = seen.value.args[0]
    assert files and all(scratch_root(spark) in f for f in files)


def test_counted_texts_are_not_cut_again(spark, monkeypatch):
    df = spark.createDataFrame([(1, "sea sea car"), (1, "car sun"), (2, None), (None, "sea")], "k int, text string")
    want = sorted(map(str, V.doc_terms(df, "text", ["k"]).collect()))
    stats, n = V.corpus_terms(df, "text")
    once = V.counted(df, "text", ["k"])
    monkeypatch.setattr(V, "words", None)
    assert sorted(map(str, V.doc_terms(once, "text", ["k"]).collect())) == want
    again, m = V.corpus_terms(once, "text")
    assert m == n == 4 and sorted(map(str, again.collect())) == sorted(map(str, stats.collect()))


def test_overview_counts_each_key_alone(spark):
    rows = [("a", "x", True, 5.0), ("a", None, False, 1.0), (None, "y", None, 1.0), ("b", "x", True, None)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, verified_purchase boolean, p double")
    df = df.withColumn("is_misleading", F.col("p") > 3)
    out = R.dataset_overview(df)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(4, 2, 2, 2, 1, 33.333333, 2)]
    assert [tuple(r) for r in R.dataset_overview(df.limit(0)).collect()] == [(0, 0, 0, None, None, None, None)]


def test_landed_files_grow_with_the_text(spark):
    rec = spark.createDataFrame([("x" * 10,), ("é" * 10,), (None,)], "text string")
    assert [io.landed_files(rec, most) for most in (1000, 10, 3, 1)] == [4, 4, 10, 30]
    assert io.landed_files(rec.limit(0), 1) == 4
