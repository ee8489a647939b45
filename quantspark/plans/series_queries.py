"""Window, cleaning and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, rounded
from quantspark.operators import quality as q
from quantspark.operators import windows as win
from quantspark.plans.indicator_queries import W, fullw, over_ticks, pick, r, rows
from quantspark.plans.registry import register
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, bars, ticks


@over_ticks(
    "rolling_stats",
    f"""a AS (SELECT *, {fullw('avg(price)', 'price', 7)} AS m, {fullw('stddev_samp(price)', 'price', 7)} AS sd, {fullw('min(price)', 'price', 7)} AS lo, {fullw('max(price)', 'price', 7)} AS hi,
 {fullw('quantile_cont(price, 0.5)', 'price', 7)} AS med, price - {fullw('avg(price)', 'price', 7)} AS g,
 list(price) OVER {rows(7)} AS l FROM ticks), final AS (SELECT *, {fullw('avg(pow(g, 4))', 'g', 7)} / nullif(pow(sd, 4), 0) - 3 AS ku, list_avg(list_transform(l, lambda y: pow(y - m, 3))) / nullif(pow(list_avg(list_transform(l, lambda y: pow(y - m, 2))), 1.5), 0) AS sk FROM a)""",
    ", ".join(r(a, b) for a, b in (("m", "roll_mean"), ("sd", "roll_std"), ("lo", "roll_min"), ("hi", "roll_max"), ("med", "roll_median"), ("CASE WHEN len(l) = 7 THEN sk END", "roll_skew"), ("coalesce(ku, 0)", "roll_kurt"))),
)
def rolling_stats(spark, sf_dir):
    return pick(win.rolling_stats(ticks(spark, sf_dir)), "roll_mean", "roll_std", "roll_min", "roll_max", "roll_median", "roll_skew", "roll_kurt")


SOFAR = f"({W} ROWS UNBOUNDED PRECEDING)"


@over_ticks(
    "expanding_stats",
    f"final AS (SELECT *, count(price) OVER {SOFAR} >= 5 AS ok, avg(price) OVER {SOFAR} AS m, stddev_samp(price) OVER {SOFAR} AS sd, min(price) OVER {SOFAR} AS lo, max(price) OVER {SOFAR} AS hi FROM ticks)",
    ", ".join(r(f"CASE WHEN ok THEN {a} END", b) for a, b in (("m", "exp_mean"), ("sd", "exp_std"), ("lo", "exp_min"), ("hi", "exp_max"))),
)
def expanding_stats(spark, sf_dir):
    return pick(win.expanding_stats(ticks(spark, sf_dir)), "exp_mean", "exp_std", "exp_min", "exp_max")


@over_ticks(
    "lag_diff_features",
    f"final AS (SELECT *, lag(price, 1) OVER ({W}) AS l1, lag(price, 2) OVER ({W}) AS l2, lag(price, 5) OVER ({W}) AS l5 FROM ticks)",
    ", ".join(f"{r(f'l{n}', f'lag_{n}')}, {r(f'price - l{n}', f'diff_{n}')}, {r(f'price / l{n} - 1', f'change_{n}')}" for n in (1, 2, 5)),
)
def lag_diff_features(spark, sf_dir):
    return pick(win.lag_features(ticks(spark, sf_dir)), *[f"{a}_{n}" for n in (1, 2, 5) for a in ("lag", "diff", "change")])


@over_ticks(
    "rolling_zscore_by_group",
    f"a AS (SELECT *, {fullw('avg(price)', 'price', 10)} AS m, {fullw('stddev_samp(price)', 'price', 10)} AS s FROM ticks), final AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (price - m) / s END AS z FROM a)",
    r("z", "zscore"),
)
def rolling_zscore_by_group(spark, sf_dir):
    return pick(win.rolling_zscore(ticks(spark, sf_dir)), "zscore")


@register(
    "cross_sectional_rank",
    f"""WITH {TICKS_SQL}, a AS (SELECT asset, CAST(ts AS DATE) AS d, avg(price) AS p FROM ticks GROUP BY 1, 2),
b AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY p) + (count(*) OVER (PARTITION BY d, p) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY d) AS n FROM a)
SELECT asset, CAST(d AS VARCHAR) AS day, round(CASE WHEN n > 1 THEN 2 * (k - 1) / (n - 1) - 1 ELSE 0 END, 6) + 0.0 AS cross_rank FROM b""",
)
def cross_sectional_rank(spark, sf_dir):
    daily = ticks(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("d")).agg(F.avg("price").alias("p"))
    return rounded(win.cross_rank(daily, "d", "p").select("asset", F.col("d").cast("string").alias("day"), "cross_rank"))


@register(
    "quantile_buckets",
    f"WITH {TICKS_SQL} SELECT asset, tie, CAST(ntile(5) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY price, tie) AS INTEGER) AS bucket FROM ticks",
)
def quantile_buckets(spark, sf_dir):
    rows_ = ticks(spark, sf_dir).withColumn("d", F.to_date("ts"))
    return win.quantile_buckets(rows_, ["d"], "price", ["tie"]).select("asset", "tie", "bucket")


HOLES = "holes AS (SELECT asset, ts, tie, CASE WHEN tie % 4 <> 0 AND tie % 7 <> 0 THEN price END AS price FROM ticks)"


def holes(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("price", F.when((F.col("tie") % 4 != 0) & (F.col("tie") % 7 != 0), F.col("price")))


@over_ticks(
    "ffill_bfill",
    f"{HOLES}, final AS (SELECT *, coalesce(last_value(price IGNORE NULLS) OVER {SOFAR}, first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM holes)",
    r("x", "price"),
)
def ffill_bfill(spark, sf_dir):
    return pick(win.fill_both_ways(holes(spark, sf_dir), TICKS, "price"), "price")


@over_ticks(
    "interpolate",
    f"""{HOLES}, p AS (SELECT *, row_number() OVER ({W}) AS p FROM holes), k AS (SELECT *, CASE WHEN price IS NOT NULL THEN p END AS kp FROM p),
n AS (SELECT *, last_value(kp IGNORE NULLS) OVER {SOFAR} AS pa, last_value(price IGNORE NULLS) OVER {SOFAR} AS va, first_value(kp IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
 first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM k),
final AS (SELECT *, coalesce(price, CASE WHEN pb - pa - 1 <= 2 THEN va + (vb - va) * (p - pa) / (pb - pa) END) AS x FROM n)""",
    r("x", "price"),
)
def interpolate(spark, sf_dir):
    return pick(win.interpolate(holes(spark, sf_dir), TICKS, "price", 2), "price")


@register(
    "time_split",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, (row_number() OVER ({W}) - 1) / count(*) OVER (PARTITION BY asset) AS f FROM ticks)
SELECT asset, part, count(*) AS n FROM (SELECT asset, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS part FROM a) GROUP BY 1, 2""",
)
def time_split(spark, sf_dir):
    return win.time_split(ticks(spark, sf_dir), TICKS).groupBy("asset", "part").agg(F.count(F.lit(1)).alias("n"))


@register(
    "walk_forward_folds",
    f"""WITH {TICKS_SQL}, a AS (SELECT asset, tie, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY asset) AS n FROM ticks),
f AS (SELECT a.*, k.fold FROM a, (SELECT unnest(range(0, 1000)) AS fold) k WHERE k.fold * 10 <= p AND p < k.fold * 10 + 40 AND k.fold * 10 + 40 <= n)
SELECT asset, CAST(fold AS INTEGER) AS fold, CASE WHEN p < fold * 10 + 30 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(tie) AS low, max(tie) AS high FROM f GROUP BY ALL""",
)
def walk_forward_folds(spark, sf_dir):
    folds = win.walk_forward_folds(ticks(spark, sf_dir), TICKS, 30, 10, 10)
    return folds.groupBy("asset", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("low"), F.max("tie").alias("high"))


@register(
    "embargo_anti",
    f"WITH {TICKS_SQL} SELECT asset, tie FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM ticks e WHERE e.kind = 'error' AND e.asset = t.asset AND e.ts <= t.ts AND t.ts < e.ts + INTERVAL 12 HOUR)",
)
def embargo_anti(spark, sf_dir):
    rows_ = ticks(spark, sf_dir)
    return win.embargo(rows_, rows_.where("kind = 'error'"), TICKS, hours=12).select("asset", "tie")


@over_ticks("forward_return", f"final AS (SELECT *, lead(price, 3) OVER ({W}) / price - 1 AS f FROM ticks)", r("f", "forward"))
def forward_return(spark, sf_dir):
    return pick(win.forward_return(ticks(spark, sf_dir), TICKS), "forward")


def _frac(d: float, n: int) -> str:
    weight, out = 1.0, ["price"]
    for k in range(1, n):
        weight *= (k - 1 - d) / k
        out.append(f"({weight!r}) * lag(price, {k}) OVER ({W})")
    return " + ".join(out)


@over_ticks("fractional_difference", f"final AS (SELECT *, {_frac(0.4, 6)} AS x FROM ticks)", r("x", "frac_diff"))
def fractional_difference(spark, sf_dir):
    return pick(win.fractional_difference(ticks(spark, sf_dir), TICKS, "price"), "frac_diff")


@register(
    "outlier_iqr",
    f"WITH {TICKS_SQL}, b AS (SELECT kind, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS c FROM ticks GROUP BY 1) SELECT asset, tie FROM ticks JOIN b USING (kind) WHERE price BETWEEN a - 0.5 * (c - a) AND c + 0.5 * (c - a)",
)
def outlier_iqr(spark, sf_dir):
    return q.drop_iqr_outliers(ticks(spark, sf_dir), "price", ["kind"], 0.5).select("asset", "tie")


@register(
    "outlier_zscore",
    f"WITH {TICKS_SQL}, b AS (SELECT kind, avg(price) AS m, stddev_samp(price) AS s FROM ticks GROUP BY 1) SELECT asset, tie FROM ticks JOIN b USING (kind) WHERE abs(price - m) <= 1.5 * s",
)
def outlier_zscore(spark, sf_dir):
    return q.drop_zscore_outliers(ticks(spark, sf_dir), "price", ["kind"], 1.5).select("asset", "tie")


@register(
    "winsorize",
    f"WITH {TICKS_SQL}, b AS (SELECT kind, quantile_cont(price, 0.05) AS l, quantile_cont(price, 0.95) AS h FROM ticks GROUP BY 1) SELECT asset, tie, round(least(greatest(price, l), h), 6) + 0.0 AS price FROM ticks JOIN b USING (kind)",
)
def winsorize(spark, sf_dir):
    return rounded(q.winsorize(ticks(spark, sf_dir), "price", ["kind"]).select("asset", "tie", "price"))


def _scale_sql(centre: str, width: str, kind: str) -> str:
    return f"WITH {TICKS_SQL}, b AS (SELECT {centre} AS c, {width} AS w FROM ticks) SELECT asset, tie, round((price - c) / w, 6) + 0.0 AS price_{kind} FROM ticks, b"


@register("scale_standard", _scale_sql("avg(price)", "stddev_samp(price)", "standard"))
def scale_standard(spark, sf_dir):
    return rounded(q.scaled(ticks(spark, sf_dir), "price", "standard").select("asset", "tie", "price_standard"))


@register("scale_minmax", _scale_sql("min(price)", "max(price) - min(price)", "minmax"))
def scale_minmax(spark, sf_dir):
    return rounded(q.scaled(ticks(spark, sf_dir), "price", "minmax").select("asset", "tie", "price_minmax"))


@register("scale_robust", _scale_sql("quantile_cont(price, 0.5)", "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)", "robust"))
def scale_robust(spark, sf_dir):
    return rounded(q.scaled(ticks(spark, sf_dir), "price", "robust").select("asset", "tie", "price_robust"))


@register(
    "ohlcv_quality",
    f"""WITH {BARS_SQL} SELECT asset, count(*) AS n_rows, count(*) FILTER (close IS NULL) AS n_null_close,
count(*) FILTER (high < low OR high < greatest(open, close) OR low > least(open, close)) AS n_bad_range, count(*) FILTER (least(open, high, low, close) <= 0) AS n_not_positive,
count(*) FILTER (volume = 0) AS n_no_volume, count(*) FILTER (high > 50 * low) AS n_wide FROM bars GROUP BY 1""",
)
def ohlcv_quality(spark, sf_dir):
    return q.bar_quality(bars(spark, sf_dir))


@register(
    "date_gaps",
    f"""WITH {TICKS_SQL}, t AS (SELECT DISTINCT asset, CAST(ts AS DATE) AS ts FROM ticks), a AS (SELECT asset, ts, lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS b FROM t),
d AS (SELECT *, list_filter(range(1, date_diff('day', b, ts)), lambda k: isodow(b + CAST(k AS INTEGER)) < 6) AS miss FROM a WHERE date_diff('day', b, ts) > 1)
SELECT asset, CAST(CAST(b + 1 AS DATE) AS VARCHAR) AS gap_start, CAST(CAST(ts - 1 AS DATE) AS VARCHAR) AS gap_end, CAST(len(miss) AS INTEGER) AS missing FROM d WHERE len(miss) > 0""",
)
def date_gaps(spark, sf_dir):
    days = ticks(spark, sf_dir).select("asset", F.to_date("ts").alias("ts")).distinct()
    gaps = q.day_gaps(days, Series(order=("ts",)))
    return gaps.select("asset", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"), "missing")


@register("dedupe_keep_last", f"WITH {TICKS_SQL} SELECT asset, kind, max_by(tie, (ts, tie)) AS tie FROM ticks GROUP BY 1, 2")
def dedupe_keep_last(spark, sf_dir):
    return q.keep_last(ticks(spark, sf_dir), ["asset", "kind"], ["ts", "tie"]).select("asset", "kind", "tie")


@register(
    "upsert",
    f"WITH {TICKS_SQL} SELECT tie, round(CASE WHEN price >= 250 THEN price + 1 ELSE price END, 6) + 0.0 AS price FROM ticks UNION ALL SELECT -1 - tie, round(price + 1, 6) + 0.0 FROM ticks WHERE price < 5",
)
def upsert(spark, sf_dir):
    """All ticks; high prices have changed and low ones came with new numbers."""
    base = ticks(spark, sf_dir).select("tie", "price")
    changed = base.where("price >= 250").unionByName(base.where("price < 5").withColumn("tie", -1 - F.col("tie")))
    return rounded(q.upsert(base, changed.withColumn("price", F.col("price") + 1), ["tie"]))


@register(
    "null_report",
    "WITH h AS (SELECT CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type FROM events)"
    + " UNION ALL ".join(f" SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, round((count(*) - count({c})) / count(*), 6) + 0.0 AS null_share FROM h" for c in ("user_id", "event_type")),
)
def null_report(spark, sf_dir):
    rows_ = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows_ = rows_.select(F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return rounded(q.null_report(rows_))


@register(
    "stale_runs",
    f"""WITH {TICKS_SQL}, c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER ({W}) THEN 1 ELSE 0 END AS c FROM ticks), g AS (SELECT *, sum(c) OVER {SOFAR} AS run FROM c)
SELECT asset, min(ts) AS first, max(ts) AS last, count(*) AS length, max(kind) AS value FROM g GROUP BY asset, run HAVING count(*) >= 3""",
)
def stale_runs(spark, sf_dir):
    return q.stale_runs(ticks(spark, sf_dir), TICKS, "kind", 3)
