"""How many tasks the fits take."""

from pyspark.sql import functions as F

from starlens.operators import models as M


def test_lda_has_no_more_tasks_than_cores(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    df = spark.range(80).select("id", F.concat(F.lit("common word"), (F.col("id") % 7).cast("string")).alias("text")).repartition(4 * spark.sparkContext.defaultParallelism)
    _, dominant = M.fit_lda(df, "text", [], k=2, max_iter=1, key="id")
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism and dominant.count() == 80
