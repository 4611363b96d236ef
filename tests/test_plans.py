"""Plan guards: no registered query pairs every row with every other (no cartesian / nested-loop join)."""

import contextlib
import io

from conftest import SF_SMALL

from __spark_entry__ import queries

# building these runs model fits or streams; their plans are covered by PLANS.md
SKIP = {
    "kmeans_topics", "kmeans_apply", "lda_topics", "lda_topic_words", "embedding_clusters", "rf_sales",
    "rf_reputation", "feature_importance", "stream_ingest", "stream_resume", "file_status", "stream_metrics",
    "stream_monthly_trend",
}


def test_no_pairwise_joins(spark):
    bad = []
    for name, fn in queries().items():
        if name in SKIP:
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, SF_SMALL).explain()
        if "CartesianProduct" in buf.getvalue() or "BroadcastNestedLoopJoin" in buf.getvalue():
            bad.append(name)
    assert bad == []
