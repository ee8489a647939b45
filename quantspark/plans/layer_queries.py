"""Gold features and streaming queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quantspark.frames import rounded
from quantspark.plans.indicator_queries import r
from quantspark.plans.registry import register
from quantspark.sources import layers
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, bars, ticks
from quantspark.streaming import windows as sw


@register(
    "gold_features",
    f"""WITH {BARS_SQL}, m AS (SELECT asset AS asset_id, CAST(ts AS DATE) AS d, close FROM bars), s AS (SELECT event_type AS asset_id, CAST(ts AS DATE) AS d, avg(value / 250 - 1) AS sentiment_index, count(*) AS post_count FROM events GROUP BY 1, 2),
x AS (SELECT asset_id, CAST(d AS DATE) AS d FROM (SELECT DISTINCT asset_id FROM m), (SELECT unnest(range(min(d), max(d) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS d FROM m)),
w AS (SELECT x.asset_id, x.d, list(m.close ORDER BY m.d) FILTER (m.d IS NOT NULL) AS c FROM x LEFT JOIN m ON m.asset_id = x.asset_id AND m.d BETWEEN x.d - 35 AND x.d - 1 GROUP BY 1, 2),
v AS (SELECT *, list_transform(list_filter(range(2, coalesce(len(c), 0) + 1), lambda i: c[i] <> 0 AND c[i - 1] <> 0), lambda i: c[i] / c[i - 1] - 1) AS r FROM w),
f AS (SELECT asset_id, d, CASE WHEN len(r) > 0 THEN r[-1] ELSE 0 END AS r1, CASE WHEN len(r) > 0 AND len(c) >= 6 AND c[-6] <> 0 THEN c[-1] / c[-6] - 1 WHEN len(r) > 0 THEN r[-1] ELSE 0 END AS r5, CASE WHEN len(r) > 0 THEN list_aggregate(r, 'stddev_pop') ELSE 0 END AS v FROM v)
SELECT f.asset_id, CAST(f.d AS VARCHAR) AS date, {r('r1', 'return_1d')}, {r('r5', 'return_5d')}, {r('v', 'volatility_30d')}, 0.0::DOUBLE AS related_return_1, 0.0::DOUBLE AS related_return_2, 0.0::DOUBLE AS related_return_3,
{r('coalesce(s.sentiment_index, 0)', 'sentiment_index')}, coalesce(s.post_count, 0) AS post_count FROM f ASOF LEFT JOIN s ON f.asset_id = s.asset_id AND f.d >= s.d""",
)
def gold_features(spark, sf_dir):
    market = bars(spark, sf_dir).select(F.col("asset").alias("asset_id"), F.col("ts").cast("string").alias("date"), "close")
    mood = ticks(spark, sf_dir).groupBy(F.col("kind").alias("asset_id"), F.to_date("ts").cast("string").alias("date"))
    mood = mood.agg(F.avg(F.col("price") / 250 - 1).alias("sentiment_index"), F.count(F.lit(1)).alias("post_count"))
    return rounded(layers.gold_features(market, mood))


def moods(df):
    events = df.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 250 - 1).alias("sentiment"), ((F.col("user_id") % 10) / 10).alias("influence"), F.col("value").alias("volume"))
    return sw.weigh_events(events)


WEIGHED = "e AS (SELECT event_type AS asset, ts, value / 250 - 1 AS sentiment, (user_id % 10) / 10.0::DOUBLE * least(value / 100, 5) AS w FROM events WHERE (user_id % 10) / 10.0::DOUBLE >= 0.1)"


def _windows_sql(minutes: int, slide: int, closed: str = "") -> str:
    k = minutes // slide
    return f"""WITH {WEIGHED}, x AS (SELECT *, time_bucket(INTERVAL {slide} MINUTE, ts) - INTERVAL (k * {slide}) MINUTE AS start FROM e, range({k}) t(k))
SELECT asset, start, start + INTERVAL {minutes} MINUTE AS "end", count(*) AS n, {r('sum(sentiment * w) / sum(w)', 'sentiment')}, {r('stddev_pop(sentiment)', 'std')} FROM x {closed} GROUP BY 1, 2"""


@register("sentiment_windows", _windows_sql(240, 60))
def sentiment_windows(spark, sf_dir):
    return rounded(sw.sentiment_windows(moods(spark.read.parquet(f"{sf_dir}/events.parquet")), 240, 60))


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source takes a folder or a pattern; the pattern fits the file or the folder of this name.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _folder(spark) -> str:
    """The shared folder; on a local master alone a temporary one does as well."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or f"file://{tempfile.mkdtemp(prefix='quantspark-stream-')}"


@register("stream_sentiment_windows", _windows_sql(240, 60, "WHERE start + INTERVAL 240 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)"))
def stream_sentiment_windows(spark, sf_dir):
    """The same windows from a stream: those that the watermark has closed."""
    stream = sw.sentiment_windows(moods(_stream(spark, sf_dir)), 240, 60)
    return rounded(sw.run_available(stream, _folder(spark), "sentiment"))


@register(
    "stream_trailing_stop",
    f"WITH {TICKS_SQL}, a AS (SELECT asset, ts, price, max(price * 0.9) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ticks) SELECT asset, ts, price, {r('s', 'stop')}, coalesce(price <= lag(s) OVER (PARTITION BY asset ORDER BY ts), false) AS hit FROM a",
)
def stream_trailing_stop(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return rounded(sw.run_available(sw.stop_states(rows), _folder(spark), "stops"))


@register(
    "momentum_scan",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, count(*) OVER w AS n, first_value(price) OVER w AS first FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
SELECT asset, tie, n, {r('price / first - 1', 'change')} FROM a WHERE n >= 2 AND abs(price / first - 1) >= 0.05""",
)
def momentum_scan(spark, sf_dir):
    return rounded(sw.momentum_scan(ticks(spark, sf_dir), seconds=86_400, least=0.05).select("asset", "tie", "n", "change"))


@register(
    "stream_momentum_scan",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, first_value(price) OVER w AS first, count(*) OVER w AS n FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW))
SELECT asset, ts, price, {r('price / first - 1', 'change')} FROM a WHERE n >= 2 AND abs(price / first - 1) >= 0.05""",
)
def stream_momentum_scan(spark, sf_dir):
    """The same rows from a stream."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return rounded(sw.run_available(sw.stream_momentum(rows, seconds=86_400, least=0.05), _folder(spark), "moves"))


def _window_part(minutes: int) -> str:
    return f"w{minutes} AS (SELECT asset, time_bucket(INTERVAL 60 MINUTE, ts) - INTERVAL (k * 60) MINUTE + INTERVAL {minutes} MINUTE AS e, count(*) AS n, sum(sentiment * w) / sum(w) AS m, stddev_pop(sentiment) AS s FROM e, range({minutes // 60}) t(k) GROUP BY 1, 2)"


@register(
    "sentiment_signal",
    f"""WITH {WEIGHED}, {_window_part(60)}, {_window_part(240)}, {_window_part(1440)}, j AS (SELECT a.asset, a.e, a.n, a.m, a.s, b.m AS mm, c.m AS lm, c.s AS ls, row_number() OVER (PARTITION BY a.asset ORDER BY a.e) - 1 AS k FROM w60 a JOIN w240 b USING (asset, e) JOIN w1440 c USING (asset, e))
SELECT asset, e AS "end", n, {r('m', 'sentiment')}, {r('s', 'std')}, {r('CASE WHEN mm = 0 THEN 0 ELSE greatest(-1, least(1, (m - mm) / abs(mm))) END', 'momentum')}, {r('CASE WHEN k >= 10 AND ls <> 0 AND abs(m - lm) / ls >= 1.5 THEN 1 / (1 + exp(-0.5 * (abs(m - lm) / nullif(ls, 0) - 1.5))) ELSE 0 END', 'anomaly')}, {r('least(n / 30, 1)', 'confidence')} FROM j""",
)
def sentiment_signal(spark, sf_dir):
    events = moods(spark.read.parquet(f"{sf_dir}/events.parquet"))
    short, medium, long = (sw.sentiment_windows(events, minutes, 60) for minutes in (60, 240, 1440))
    return rounded(sw.mood_signal(short, medium, long, far=1.5).select("asset", "end", "n", "sentiment", "std", "momentum", "anomaly", "confidence"))
