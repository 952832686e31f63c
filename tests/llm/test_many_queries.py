import numpy as np
from pyspark.sql import functions as F

from voltmill.llm import ann


def test_more_queries_than_a_slice_holds(spark):
    """Queries of several slices of a batch, which go through the same lists."""
    x = np.random.default_rng(3).normal(size=(2300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = ann.nearest(df, F.lit(True), 2).collect()
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = s.argmax(1)
    assert len(got) == 4600 and sum(best[r.query_id] == r.vec_id for r in got if r["rank"] == 1) >= 0.9 * 2300
