from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quantspark.operators import features


def test_windows_over_many_batches_are_whole_and_share_frames(spark):
    rows = [(a, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(i * 7 % 50)) for a in ("a", None, "b") for i in range(24 * 20)]
    df = spark.createDataFrame(rows, "asset string, t string, price double").select("asset", F.to_timestamp("t").alias("ts"), "price")
    call = lambda: features.resample_apply(df, "7 days", ["asset"], "ts", lambda f: {"n": float(len(f)), "first": f["price"].iloc[0], "span": f["price"].max() - f["price"].min()}, ("n", "first", "span"))
    # A plan without a frame for each window: those of short windows cost more than the work.
    assert "FlatMapGroupsInPandas" not in call()._jdf.queryExecution().toString()
    pdf = pd.DataFrame(rows, columns=["asset", "ts", "price"]).assign(ts=lambda f: pd.to_datetime(f["ts"]))
    start = pd.to_datetime(pdf["ts"].astype("datetime64[us]").astype("int64") // (7 * 86_400_000_000) * (7 * 86_400_000_000), unit="us")
    want = {(None if pd.isna(a) else a, s): (float(len(f)), f["price"].iloc[0], f["price"].max() - f["price"].min()) for (a, s), f in pdf.groupby([pdf["asset"], start], dropna=False)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("37", "168", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.asset, pd.Timestamp(r.start)): (r.n, r["first"], r.span) for r in call().collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
