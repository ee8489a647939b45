"""Row and time features, trailing windows, sets, orders, user functions and further reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, rounded
from quantspark.operators import features as ft
from quantspark.operators import reports as rp
from quantspark.plans.indicator_queries import RET, W, over_bars, over_ticks, pick, r, rows
from quantspark.plans.layer_queries import _folder
from quantspark.plans.registry import register
from quantspark.plans.report_queries import RETURNS, TRADES, TW, returns
from quantspark.plans.series_queries import SOFAR
from quantspark.plans.text_queries import POSTS_SQL, TOKENS_SQL, posts
from quantspark.operators import text
from quantspark.sources import files
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, TRADES_SQL, bars, read, ticks, trades


@over_bars("row_stats", "final AS (SELECT *, [open, high, low, close] AS l FROM bars)", f"{r('list_avg(l)', 'row_mean')}, {r('list_stddev_samp(l)', 'row_std')}")
def row_stats(spark, sf_dir):
    return pick(bars(spark, sf_dir).withColumns(ft.row_stats(("open", "high", "low", "close"))), "row_mean", "row_std")


@register(
    "finite_report",
    f"WITH {TICKS_SQL}, x AS (SELECT CASE tie % 7 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE ELSE price END AS x, price FROM ticks)"
    + " UNION ALL ".join(f" SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isnan({c})) AS n_nan, count(*) FILTER (isinf({c})) AS n_infinite, count(*) FILTER (isfinite({c})) AS n_finite FROM x" for c in ("x", "price")),
)
def finite_report(spark, sf_dir):
    k = F.col("tie") % 7
    x = F.when(k == 0, F.lit(float("inf"))).when(k == 1, None).when(k == 2, F.lit(float("nan"))).otherwise(F.col("price"))
    return ft.finite_report(ticks(spark, sf_dir).select(x.alias("x"), "price"), ("x", "price"))


@over_ticks("one_hot", "final AS (SELECT * FROM ticks)", ", ".join(f"CAST(kind = '{k}' AS INTEGER) AS is_{k}" for k in ("click", "view", "error")))
def one_hot(spark, sf_dir):
    return pick(ft.one_hot(ticks(spark, sf_dir), "kind", ("click", "view", "error")), "is_click", "is_view", "is_error")


@register("utc_time", f"WITH {TICKS_SQL} SELECT tie, date_trunc('second', ts) + INTERVAL 5 HOUR AS utc FROM ticks")
def utc_time(spark, sf_dir):
    """Times read as New York's, in January five hours behind UTC."""
    told = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ticks(spark, sf_dir).select("tie", ft.utc_time(told, "yyyy-MM-dd HH:mm:ss", "America/New_York").cast("timestamp_ntz").alias("utc"))


@over_ticks("seconds_since", f"final AS (SELECT *, max(CASE WHEN price > 100 THEN epoch_us(ts) END) OVER {SOFAR} AS e FROM ticks)", r("(epoch_us(ts) - e) / 1e6", "since"))
def seconds_since(spark, sf_dir):
    return pick(ft.seconds_since(ticks(spark, sf_dir), F.col("price") > 100), "since")


@register(
    "array_sets",
    f"WITH {POSTS_SQL}, a AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS a, ['the', 'and', 'la', 'der', 'xyzzy'] AS b FROM posts WHERE text IS NOT NULL), c AS (SELECT *, len(list_intersect(a, b)) AS n FROM a)\n"
    f"SELECT id, n AS \"both\", len(a) + 5 - n AS \"any\", len(a) - n AS only_a, 5 - n AS only_b, {r('n / (len(a) + 5 - n)', 'jaccard')} FROM c",
)
def array_sets(spark, sf_dir):
    rows_ = posts(spark, sf_dir).where("text is not null").withColumn("a", text.tokens(F.col("text")))
    sets = ft.array_sets(F.col("a"), F.array(*[F.lit(w) for w in ("the", "and", "la", "der", "xyzzy")]))
    return rounded(rows_.select("id", *[v.alias(k) if k == "jaccard" else v.cast("long").alias(k) for k, v in sets.items()]))


@register(
    "reindex_days",
    f"""WITH {TICKS_SQL}, d AS (SELECT asset, CAST(ts AS DATE) AS day, arg_max(price, (ts, tie)) AS price FROM ticks GROUP BY 1, 2), x AS (SELECT asset, CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
SELECT x.asset, CAST(x.day AS VARCHAR) AS day, {r('last_value(d.price IGNORE NULLS) OVER (PARTITION BY x.asset ORDER BY x.day ROWS UNBOUNDED PRECEDING)', 'price')} FROM x LEFT JOIN d USING (asset, day)""",
)
def reindex_days(spark, sf_dir):
    daily = ticks(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct("ts", "tie")).alias("price"))
    return rounded(ft.reindex_days(daily, ["asset"], "day", ["price"]).withColumn("day", F.col("day").cast("string")))


@register(
    "join_by_name",
    "SELECT n_nationkey AS nation, n_name AS name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 GROUP BY 1, 2",
)
def join_by_name(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    rich = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return ft.joined(nations, rich, ["nation"], "left").groupBy("nation", "name").agg(F.count("s_suppkey").alias("suppliers"))


DAY = "(PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW)"


@over_ticks("trailing_day", f"final AS (SELECT *, count(*) OVER {DAY} AS n, avg(price) OVER {DAY} AS m, sum(price) OVER {DAY} AS s FROM ticks)", f"n AS n_trailing, {r('m', 'price_mean')}, {r('s', 'price_sum')}")
def trailing_day(spark, sf_dir):
    return pick(ft.trailing(ticks(spark, sf_dir), TICKS, 86_400, ("price",)), "n_trailing", "price_mean", "price_sum")


@over_ticks("quote_stuffing", f"final AS (SELECT *, count(*) OVER {DAY} > 4 AS stuffing FROM ticks)", "stuffing")
def quote_stuffing(spark, sf_dir):
    return pick(ft.stuffing(ticks(spark, sf_dir), TICKS, 86_400, 4), "stuffing")


@register("ordered_ticks", f"WITH {TICKS_SQL} SELECT tie, kind, {r('price', 'price')} FROM ticks ORDER BY kind, abs(price - 100) DESC, tie")
def ordered_ticks(spark, sf_dir):
    return rounded(ft.ordered(ticks(spark, sf_dir).select("tie", "kind", "price"), "kind", F.abs(F.col("price") - 100).desc(), "tie"))


@register("drawn_rows", f"WITH {TICKS_SQL} SELECT tie, {r('price', 'price')} FROM ticks ORDER BY md5('x' || tie), tie LIMIT 100")
def drawn_rows(spark, sf_dir):
    return rounded(ft.drawn(ticks(spark, sf_dir).select("tie", "price"), "tie", 100, "x"))


@register("common_nations", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
def common_nations(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return ft.common_rows(rich, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@register(
    "quantile_edges",
    f"WITH {TICKS_SQL}, e AS (SELECT kind, list_distinct(quantile_cont(price, [0.2, 0.4, 0.6, 0.8])) AS e FROM ticks GROUP BY 1) SELECT tie, CAST(len(list_filter(e, lambda q: q < price)) AS INTEGER) AS bucket FROM ticks JOIN e USING (kind)",
)
def quantile_edges(spark, sf_dir):
    return ft.quantile_edges(ticks(spark, sf_dir), "price", 5, ["kind"]).select("tie", "bucket")


LINES = "CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE props END"


@register("parsed_events", f"SELECT CAST(json_extract({LINES.replace('props', 'props')}, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1 UNION ALL SELECT -1, count(*) FROM events WHERE event_id % 11 = 0")
def parsed_events(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select(F.expr(LINES).alias("value"))
    good, bad = ft.parsed_events(lines, "k long")
    return good.groupBy("k").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit(-1).cast("long").alias("k"), F.count(F.lit(1)).alias("n")))


@register("json_rows", f"WITH {TICKS_SQL} SELECT tie, '{{\"asset\":' || asset || ',\"kind\":\"' || kind || '\"}}' AS line FROM ticks")
def json_rows(spark, sf_dir):
    return ticks(spark, sf_dir).select("tie", F.to_json(F.struct("asset", "kind")).alias("line"))


@register(
    "merge_keep_first",
    f"WITH {TICKS_SQL}, u AS (SELECT asset, ts, price, tie, 0 AS n FROM ticks WHERE kind <> 'view' UNION ALL SELECT asset, ts - INTERVAL 1 DAY, price + 1, tie, 1 FROM ticks WHERE kind = 'view') SELECT asset, min_by(tie, (ts, n, tie)) AS tie FROM u GROUP BY 1",
)
def merge_keep_first(spark, sf_dir):
    rows_ = ticks(spark, sf_dir).select("asset", "ts", "price", "tie", "kind")
    late = rows_.where("kind = 'view'").withColumns({"ts": F.col("ts") - F.expr("INTERVAL 1 DAY"), "price": F.col("price") + 1})
    return ft.merged_by_date(rows_.where("kind <> 'view'"), late, ["asset"], "ts", "first").select("asset", "tie")


@register("map_chunks", f"WITH {TICKS_SQL} SELECT tie, round(price * 2 + 1, 6) + 0.0 AS value FROM ticks")
def map_chunks(spark, sf_dir):
    return rounded(ft.map_chunks(ticks(spark, sf_dir).select("tie", "price"), lambda f: f.assign(value=f["price"] * 2 + 1)[["tie", "value"]], "tie long, value double"))


@over_ticks("rolling_apply", f"final AS (SELECT *, CASE WHEN count(price) OVER {rows(5)} = 5 THEN max(price) OVER {rows(5)} - min(price) OVER {rows(5)} END AS g FROM ticks)", r("g", "rolled"))
def rolling_apply(spark, sf_dir):
    return pick(ft.rolling_apply(ticks(spark, sf_dir), TICKS, "price", 5, lambda x: max(x) - min(x)), "rolled")


@register("resample_apply", f"WITH {TICKS_SQL} SELECT asset, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, {r('max(price) - min(price)', 'span')}, count(*)::DOUBLE AS n FROM ticks GROUP BY 1, 2")
def resample_apply(spark, sf_dir):
    out = ft.resample_apply(ticks(spark, sf_dir).select("asset", "ts", "price"), "7 days", ["asset"], "ts", lambda f: {"span": f["price"].max() - f["price"].min(), "n": float(len(f))}, ("span", "n"))
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@register(
    "strategy_backtest",
    f"""WITH {TICKS_SQL}, a AS (SELECT *, {RET} AS x, coalesce(sign(price - lag(price) OVER ({W})), 0) AS g FROM ticks), b AS (SELECT *, coalesce(lag(g) OVER ({W}), 0) AS p FROM a), c AS (SELECT *, p * coalesce(x, 0) - 0.0005 * abs(p - coalesce(lag(p) OVER ({W}), 0)) AS net FROM b)
SELECT asset, tie, CAST(p AS DOUBLE) AS position, {r('net', 'net')} FROM c""",
)
def strategy_backtest(spark, sf_dir):
    return pick(rp.strategy_backtest(ticks(spark, sf_dir), TICKS, "price", lambda f: f["price"].diff().map(lambda d: (d > 0) - (d < 0))), "position", "net")


@register("step_chain", f"WITH {TICKS_SQL} SELECT kind, count(*) AS n, {r('avg(price)', 'mean')} FROM ticks WHERE price > 10 GROUP BY 1")
def step_chain(spark, sf_dir):
    steps = ft.Steps().add("enough", lambda d: d.where("price > 10")).add("means", lambda d: d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean")))
    return rounded(steps.run(ticks(spark, sf_dir)))


@register("csv_round_trip", f"WITH {TICKS_SQL} SELECT asset, tie, kind, {r('price', 'price')} FROM ticks")
def csv_round_trip(spark, sf_dir):
    """Ticks as a CSV report, and read back by schema."""
    path = files.scratch(_folder(spark), "csv")
    rows_ = ticks(spark, sf_dir).select("asset", "tie", "kind", "price")
    files.write_report(rows_, path, "csv")
    return rounded(files.read_csv(spark, path, "asset long, tie long, kind string, price double"))


@register("json_round_trip", f"WITH {BARS_SQL} SELECT asset, CAST(ts AS VARCHAR) AS day, {r('close', 'close')}, volume FROM bars")
def json_round_trip(spark, sf_dir):
    path = files.scratch(_folder(spark), "json")
    files.write_report(bars(spark, sf_dir).select("asset", F.col("ts").cast("string").alias("day"), "close", "volume"), path, "json")
    return rounded(files.read_json(spark, path, "asset string, day string, close double, volume long"))


@register("parquet_rewrite", f"WITH {TICKS_SQL} SELECT kind, count(*) AS n, {r('sum(price)', 'total')} FROM ticks GROUP BY 1")
def parquet_rewrite(spark, sf_dir):
    path = files.scratch(_folder(spark), "rewrite")
    out = files.rewrite_parquet(ticks(spark, sf_dir), path, by=("kind",))
    return rounded(out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")))


PATHS = f"e AS (SELECT asset, ts, tie, ret, product(1 + ret) OVER (PARTITION BY asset ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS e FROM rets WHERE ret > -1), d AS (SELECT *, 1 - e / max(e) OVER (PARTITION BY asset ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS d FROM e)"


@register(
    "drawdown_risk",
    f"""WITH {RETURNS}, {PATHS}, q AS (SELECT asset, quantile_cont(d, 0.95) AS dar FROM d GROUP BY 1)
SELECT d.asset, count(*) AS n, {r('max(dar)', 'dar')}, {r('avg(d) FILTER (d >= dar)', 'cdar')}, round((pow(arg_max(e, (ts, tie)), 252 / count(*)) - 1) / nullif(avg(d) FILTER (d >= dar), 0), 3) + 0.0 AS cdar_ratio, round(CASE WHEN sum(d * d) > 0 THEN avg(ret) * 252 / sqrt(sum(d * d)) WHEN avg(ret) > 0 THEN 100 ELSE 0 END, 5) + 0.0 AS burke, {r('100 * sqrt(sum(d * d) / count(*))', 'ulcer')} FROM d JOIN q USING (asset) GROUP BY 1""",
)
def drawdown_risk(spark, sf_dir):
    return rounded(rp.drawdown_risk(returns(spark, sf_dir)).withColumns({"cdar_ratio": F.round("cdar_ratio", 3), "burke": F.round("burke", 5)}))


@register(
    "drawdown_recovery",
    f"""WITH {TICKS_SQL}, i AS (SELECT *, row_number() OVER ({W}) AS i, price / max(price) OVER {SOFAR} - 1 AS d FROM ticks), s AS (SELECT *, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER {SOFAR} AS s FROM i), t AS (SELECT asset, max(s) AS t FROM s GROUP BY 1),
g AS (SELECT asset, s, min(i) AS first, max(i) AS last, min(d) AS depth, arg_min(i, (d, i)) AS trough FROM s WHERE d < 0 GROUP BY 1, 2)
SELECT asset, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, {r('depth', 'depth')}, CAST(trough - first + 1 AS INTEGER) AS down, CAST(last - trough AS INTEGER) AS up, s < t AS recovered FROM g JOIN t USING (asset)""",
)
def drawdown_recovery(spark, sf_dir):
    return rounded(rp.drawdown_recovery(ticks(spark, sf_dir)))


@over_ticks(
    "path_ratios",
    f"""x AS (SELECT *, {RET} AS ret FROM ticks), a AS (SELECT *, list(price) OVER {rows(10)} AS p, CASE WHEN count(ret) OVER {rows(10)} = 10 THEN sum(greatest(ret, 0)) OVER {rows(10)} / nullif(sum(greatest(-ret, 0)) OVER {rows(10)}, 0) END AS o FROM x),
b AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: p[i] / list_max(p[1:i]) - 1) AS d FROM a), final AS (SELECT *, CASE WHEN len(p) = 10 THEN (pow(p[10] / p[1], 25.2) - 1) / nullif(abs(list_min(d)), 0) END AS c, CASE WHEN len(p) = 10 THEN 100 * sqrt(list_avg(list_transform(d, lambda y: y * y))) END AS u FROM b)""",
    f"CASE WHEN abs(c) < 1e6 THEN round(c, 4) + 0.0 END AS roll_calmar, {r('u', 'roll_ulcer')}, {r('o', 'roll_omega')}",
)
def path_ratios(spark, sf_dir):
    out = rp.path_ratios(returns(spark, sf_dir))
    return pick(out.withColumn("roll_calmar", F.when(F.abs("roll_calmar") < 1e6, F.round("roll_calmar", 4))), "roll_calmar", "roll_ulcer", "roll_omega")


@register(
    "volume_bars",
    f"""WITH {TRADES_SQL}, b AS (SELECT *, CAST(floor(sum(quantity) OVER ({TW} ROWS UNBOUNDED PRECEDING) / 5000) AS BIGINT) AS bar, row_number() OVER ({TW}) AS i FROM trades)
SELECT symbol, bar, {r('arg_min(price, i)', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, i)', 'close')}, sum(quantity) AS volume, {r('sum(price * quantity) / sum(quantity)', 'vwap')} FROM b GROUP BY 1, 2""",
)
def volume_bars(spark, sf_dir):
    return rounded(rp.volume_bars(trades(spark, sf_dir), TRADES, "price", "quantity", 5000.0))


@register(
    "side_bars",
    f"""WITH {TRADES_SQL}, g AS (SELECT *, nullif(sign(price - lag(price) OVER ({TW})), 0) AS g FROM trades), s AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER ({TW} ROWS UNBOUNDED PRECEDING), 0) AS side FROM g),
b AS (SELECT symbol, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, coalesce(sum(quantity) FILTER (side = 1), 0) AS bought, coalesce(sum(quantity) FILTER (side = -1), 0) AS sold FROM s GROUP BY 1, 2)
SELECT symbol, start, bought, sold, {r('CASE WHEN bought + sold = 0 THEN 0 ELSE (bought - sold) / (bought + sold) END', 'balance')} FROM b""",
)
def side_bars(spark, sf_dir):
    return rounded(rp.side_bars(trades(spark, sf_dir), TRADES, "7 days", "ts", "price", "quantity"))


@register(
    "sector_stats",
    f"""WITH a AS (SELECT c_mktsegment AS sector, c_custkey AS name, c_acctbal / 10000 AS x FROM customer)
SELECT sector, {r('avg(x)', 'mean')}, {r('median(x)', 'median')}, {r('stddev_samp(x)', 'std')}, count(*) AS n, {r('100 * avg(CAST(x > 0.05 AS INTEGER))', 'bullish')}, {r('100 * avg(CAST(x < -0.05 AS INTEGER))', 'bearish')}, {r('100 * avg(CAST(abs(x) <= 0.05 AS INTEGER))', 'neutral')}, arg_min(name, (-x, name)) AS strongest, arg_min(name, (x, name)) AS weakest FROM a GROUP BY 1""",
)
def sector_stats(spark, sf_dir):
    rows_ = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("name"), (F.col("c_acctbal") / 10000).alias("x"))
    return rounded(rp.sector_stats(rows_, "sector", "name", "x"))


@register(
    "sector_momentum",
    f"WITH {TICKS_SQL}, d AS (SELECT kind, CAST(ts AS DATE) AS day, avg(price / 250 - 1) AS m FROM ticks GROUP BY 1, 2) SELECT kind, CAST(day AS VARCHAR) AS day, {r('m', 'mean')}, {r('m - lag(m, 5) OVER (PARTITION BY kind ORDER BY day)', 'momentum')} FROM d",
)
def sector_momentum(spark, sf_dir):
    rows_ = ticks(spark, sf_dir).select("kind", F.to_date("ts").cast("string").alias("day"), (F.col("price") / 250 - 1).alias("x"))
    return rounded(rp.sector_momentum(rows_, "kind", "day", "x"))


@register(
    "factor_grid",
    f"WITH {TRADES_SQL}, m AS (SELECT CAST(month(ts) AS INTEGER) AS month, avg(price) / (SELECT avg(price) FROM trades) AS a FROM trades GROUP BY 1), d AS (SELECT CAST(isodow(ts) AS INTEGER) AS weekday, avg(price) / (SELECT avg(price) FROM trades) AS b FROM trades GROUP BY 1) SELECT month, weekday, {r('a', 'month_factor')}, {r('b', 'weekday_factor')}, {r('a * b', 'factor')} FROM m, d",
)
def factor_grid(spark, sf_dir):
    return rounded(rp.factor_grid(trades(spark, sf_dir), "ts", "price"))


@register(
    "turn_of_month",
    f"""WITH {RETURNS}, t AS (SELECT kind, ret, day(ts) <= 3 OR day(ts) >= day(last_day(ts)) - 2 AS t FROM rets WHERE ret IS NOT NULL)
SELECT kind, {r('coalesce(avg(ret) FILTER (t), 0)', 'turn_mean')}, {r('coalesce(avg(ret) FILTER (NOT t), 0)', 'mid_mean')}, {r('coalesce(avg(CAST(ret > 0 AS INTEGER)) FILTER (t), 0)', 'turn_wins')}, {r('coalesce(avg(CAST(ret > 0 AS INTEGER)) FILTER (NOT t), 0)', 'mid_wins')}, count(*) FILTER (t) AS turn_rows, count(*) FILTER (NOT t) AS mid_rows, {r('coalesce(avg(ret) FILTER (t), 0) - coalesce(avg(ret) FILTER (NOT t), 0)', 'excess')} FROM t GROUP BY 1""",
)
def turn_of_month(spark, sf_dir):
    return rounded(rp.turn_of_month(returns(spark, sf_dir), ["kind"], "ts", "ret"))


@register(
    "fused_signals",
    f"""WITH {TICKS_SQL}, a AS (SELECT asset, price / 250 - 1 AS x, 0.5 + (tie % 5) / 10.0::DOUBLE AS c, CASE kind WHEN 'view' THEN 1.5 WHEN 'click' THEN 0.9 ELSE 1.2 END AS b, (SELECT max(epoch_us(ts)) FROM events) AS m, epoch_us(ts) AS u FROM ticks), w AS (SELECT *, c * b * exp(-ln(2) / 24 * (m - u) / 3.6e9) AS w FROM a)
SELECT asset, count(*) AS n, {r('sum(x * w) / sum(w)', 'fused')}, {r('CASE WHEN count(*) < 2 THEN 1 ELSE 1 - least(stddev_pop(x) / 2, 1) END', 'agreement')} FROM w GROUP BY 1""",
)
def fused_signals(spark, sf_dir):
    rows_ = ticks(spark, sf_dir)
    now = rows_.agg(F.max("ts").alias("now"))
    hours = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    rows_ = rows_.crossJoin(F.broadcast(now)).select("asset", (F.col("price") / 250 - 1).alias("x"), (0.5 + (F.col("tie") % 5) / 10.0).alias("c"), F.when(F.col("kind") == "view", 1.5).when(F.col("kind") == "click", 0.9).otherwise(1.2).alias("b"), hours.alias("h"))  # one row
    return rounded(rp.fuse_signals(rows_, ["asset"], "x", "c", "b", "h"))


@register(
    "sample_confidence",
    f"WITH {TICKS_SQL}, a AS (SELECT asset, count(*) AS n FROM ticks GROUP BY 1) SELECT asset, n AS sample_count, {r('CASE WHEN n < 10 THEN n / 10 * 0.5 WHEN n >= 80 THEN 1 ELSE 0.5 + (n - 10) / 70 * 0.5 END', 'confidence')} FROM a",
)
def sample_confidence(spark, sf_dir):
    return rounded(rp.sample_confidence(ticks(spark, sf_dir), ["asset"], 10, 80))


@register(
    "hurst",
    f"""WITH {TICKS_SQL}, x AS (SELECT kind, price AS x, row_number() OVER (PARTITION BY kind ORDER BY ts, tie) - 1 AS i FROM ticks), n AS (SELECT kind, count(*) AS n, floor(count(*) / 2) AS h FROM x GROUP BY 1 HAVING count(*) >= 32),
z AS (SELECT DISTINCT kind, n, CAST(floor(8.0::DOUBLE * pow(h / 8, k / 11) + 1e-9) AS BIGINT) AS size FROM n, range(12) t(k)), c AS (SELECT x.kind, size, i // size AS c, i, x FROM x JOIN z USING (kind) WHERE i < n // size * size),
w AS (SELECT *, x - avg(x) OVER (PARTITION BY kind, size, c) AS d FROM c), v AS (SELECT *, sum(d) OVER (PARTITION BY kind, size, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM w), q AS (SELECT kind, size, c, max(w) - min(w) AS r, stddev_samp(x) AS sd FROM v GROUP BY 1, 2, 3),
m AS (SELECT kind, ln(size) AS lx, ln(avg(r / sd)) AS y FROM q WHERE sd > 0 GROUP BY kind, size) SELECT kind, count(*) AS sizes, {r('regr_slope(y, lx)', 'hurst')}, {r('regr_intercept(y, lx)', 'intercept')}, {r('regr_r2(y, lx)', 'r2')} FROM m GROUP BY 1 HAVING count(*) >= 3""",
)
def hurst(spark, sf_dir):
    return rounded(rp.hurst(ticks(spark, sf_dir), Series(key=("kind",)), "price"))


def _residual(y: str, x: str, over: str) -> str:
    return f"{y} - regr_slope({y}, {x}) OVER {over} * {x} - regr_intercept({y}, {x}) OVER {over}"


K = "(PARTITION BY kind)"


@register(
    "factor_regression",
    f"""WITH {TICKS_SQL}, a AS (SELECT kind, price AS y, CAST(hour(ts) AS DOUBLE) AS a, CAST(asset AS DOUBLE) AS b, CAST(day(ts) AS DOUBLE) AS c FROM ticks), p(factor, x, u, v) AS (SELECT * FROM (VALUES ('hour', 1, 2, 3), ('user', 2, 1, 3), ('day', 3, 1, 2)) t),
f AS (SELECT kind, factor, y, [a, b, c][x] AS x, [a, b, c][u] AS u, [a, b, c][v] AS v FROM a, p), g AS (SELECT *, {_residual('y', 'u', '(PARTITION BY kind, factor)')} AS y1, {_residual('x', 'u', '(PARTITION BY kind, factor)')} AS x1, {_residual('v', 'u', '(PARTITION BY kind, factor)')} AS v1 FROM f),
h AS (SELECT *, {_residual('y1', 'v1', '(PARTITION BY kind, factor)')} AS y2, {_residual('x1', 'v1', '(PARTITION BY kind, factor)')} AS x2 FROM g), s AS (SELECT kind, factor, count(*) - 4 AS free, regr_slope(y2, x2) AS b, regr_sxx(y2, x2) AS sxx, regr_syy(y2, x2) - pow(regr_sxy(y2, x2), 2) / regr_sxx(y2, x2) AS sse FROM h GROUP BY 1, 2)
SELECT kind, factor, {r('b', 'exposure')}, round(b / sqrt(sse / free / sxx), 4) + 0.0 AS t_stat FROM s""",
)
def factor_regression(spark, sf_dir):
    rows_ = ticks(spark, sf_dir).select("kind", "price", F.hour("ts").alias("hour"), F.col("asset").alias("user"), F.dayofmonth("ts").alias("day"))
    out = rp.factor_regression(rows_, ["kind"], "price", ("hour", "user", "day")).where("factor <> 'alpha'")
    return rounded(out.select("kind", "factor", "exposure", F.round("t_stat", 4).alias("t_stat")))


@register(
    "stress_test",
    "WITH w AS (SELECT c_nationkey AS nation, sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer) AS weight FROM customer GROUP BY 1), s(scenario, nation, shock) AS (SELECT 'crash' AS scenario, n_nationkey, -0.2 - n_nationkey / 100.0::DOUBLE FROM nation UNION ALL SELECT 'east', n_nationkey, CASE WHEN n_regionkey = 2 THEN -0.5 ELSE 0.01 END FROM nation), v AS (SELECT *, weight * shock * 1000 AS v FROM s JOIN w USING (nation))\n"
    + f"SELECT scenario, {r('sum(v)', 'change')}, arg_min(nation, (v, nation)) AS worst FROM v GROUP BY 1",
)
def stress_test(spark, sf_dir):
    sums = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("c_acctbal").alias("bal"))
    total = sums.agg(F.sum("bal").alias("total"))
    weights = sums.crossJoin(F.broadcast(total)).select("nation", (F.col("bal") / F.col("total")).alias("weight"))  # one row
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    crash = nations.select(F.lit("crash").alias("scenario"), "nation", (-0.2 - F.col("nation") / 100.0).alias("shock"))
    east = nations.select(F.lit("east").alias("scenario"), "nation", F.when(F.col("n_regionkey") == 2, -0.5).otherwise(0.01).alias("shock"))
    return rounded(rp.stressed(weights, crash.unionByName(east), "nation", 1000.0))


@register(
    "treynor",
    f"WITH {RETURNS}, m AS (SELECT kind, CAST(ts AS DATE) AS d, avg(price) AS m FROM rets GROUP BY 1, 2) SELECT asset, {r('regr_slope(ret, m)', 'beta')}, round(avg(ret) * 252 / regr_slope(ret, m), 3) + 0.0 AS treynor FROM rets r JOIN m ON m.kind = r.kind AND m.d = CAST(r.ts AS DATE) WHERE ret IS NOT NULL GROUP BY 1",
)
def treynor(spark, sf_dir):
    rows_ = returns(spark, sf_dir).withColumn("d", F.to_date("ts"))
    market = rows_.groupBy("kind", "d").agg(F.avg("price").alias("m"))
    return rounded(rp.treynor(rows_.join(market, ["kind", "d"]), ["asset"], "ret", "m").withColumn("treynor", F.round("treynor", 3)))


@over_bars("relative_volume", f"final AS (SELECT *, CASE WHEN count(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN volume / avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS v FROM bars)", r("v", "relative_volume"))
def relative_volume(spark, sf_dir):
    return pick(rp.relative_volume(bars(spark, sf_dir), TICKS, "volume"), "relative_volume")
