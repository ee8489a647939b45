"""Text, graph, statistics, portfolio and option queries."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from quantspark.frames import TICKS, Series, rounded
from quantspark.operators import graph, portfolio, text
from quantspark.operators import statistics as st
from quantspark.plans.indicator_queries import W, r
from quantspark.plans.registry import register
from quantspark.plans.report_queries import DAILY, RETURNS, daily, returns, skew
from quantspark.sources.tables import BARS_SQL, TICKS_SQL, bars, ticks

ALIASES = (("the", "THE"), ("and", "AND"), ("and", "DAN"), ("der", "DER"), ("que", "QUE"))
SCORES = (("the", 0.2), ("of", -0.4), ("and", 0.6), ("la", 0.5), ("der", -0.3), ("que", -0.7))
POSTS_SQL = "posts AS (SELECT doc_id AS id, text, source AS subreddit, doc_id % 97 AS author_id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR) AS date, 1704067200 + (doc_id % 997) * 4999 AS created_utc, CASE WHEN doc_id % 97 % 4 = 0 OR doc_id % 5 = 0 THEN 'https://x.org/' || doc_id WHEN doc_id % 5 = 1 THEN 'https://www.reddit.com/' || doc_id END AS url FROM documents)"
TOKENS_SQL = "toks AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS word FROM posts)"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows) + ")"


def posts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("string")
    url = F.when((F.col("doc_id") % 97 % 4 == 0) | (F.col("doc_id") % 5 == 0), F.concat(F.lit("https://x.org/"), "doc_id")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("https://www.reddit.com/"), "doc_id"))
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("subreddit"), (F.col("doc_id") % 97).alias("author_id"), day.alias("date"), (1704067200 + (F.col("doc_id") % 997) * 4999).alias("created_utc"), url.alias("url"))


def constants(spark, rows, names: str):
    """A table of literal rows, whose size Spark knows."""
    return spark.sql(f"SELECT * FROM {values(rows)} AS t({names})")


def lexicon(spark):
    return constants(spark, SCORES, "word, score").withColumn("score", F.col("score").cast("double"))


#: Posts with cashtags, mentions, a link and emojis behind their text.
TAGGED_SQL = "tagged AS (SELECT *, text || ' $' || substr(subreddit, 1, 3) || ' $zzz u/user' || author_id || ' 🚀📈 http://x.org/' || id || ' end' AS tagged FROM posts)"


def tagged(spark, sf_dir):
    more = F.concat("text", F.lit(" $"), F.substring("subreddit", 1, 3), F.lit(" $zzz u/user"), "author_id", F.lit(" 🚀📈 http://x.org/"), "id", F.lit(" end"))
    return posts(spark, sf_dir).withColumn("tagged", more)


def _normal(x: str) -> str:
    """Pieces between cashtags and the cashtags raised, put together again."""
    marked = f"regexp_replace({x}, 'https?://\\S+|www\\.\\S+', ' [URL] ', 'g')"
    tag = "'\\$([A-Za-z]{1,5})\\b'"
    raised = f"array_to_string(list_transform(list_zip(regexp_split_to_array({marked}, {tag}), regexp_extract_all({marked}, {tag}, 0)), lambda p: p[1] || coalesce(upper(p[2]), '')), '')"
    return f"trim(regexp_replace({raised}, '\\s+', ' ', 'g'))"


@register("normalize_text", f"WITH {POSTS_SQL}, {TAGGED_SQL}, n AS (SELECT id, {_normal('tagged')} AS t FROM tagged) SELECT id, CAST(length(t) AS INTEGER) AS length, md5(t) AS digest FROM n")
def normalize_text(spark, sf_dir):
    rows = tagged(spark, sf_dir).withColumn("t", text.normalized(F.col("tagged")))
    return rows.select("id", F.length("t").alias("length"), F.md5("t").alias("digest"))


@register(
    "social_marks",
    f"""WITH {POSTS_SQL}, {TAGGED_SQL} SELECT id, array_to_string(list_distinct(list_transform(regexp_extract_all(tagged, '\\$([A-Za-z]{{1,5}})\\b', 1), lambda t: upper(t))).list_sort(), ' ') AS cashtags,
array_to_string(regexp_extract_all(tagged, '(?:^|[^A-Za-z0-9_])/?u/([A-Za-z0-9_-]+)', 1), ' ') AS mentions, array_to_string(regexp_extract_all(tagged, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F1E6}}-\\x{{1F1FF}}]'), '') AS emojis FROM tagged""",
)
def social_marks(spark, sf_dir):
    x = F.col("tagged")
    return tagged(spark, sf_dir).select("id", F.array_join(F.array_sort(text.cashtags(x)), " ").alias("cashtags"), F.array_join(text.mentions(x), " ").alias("mentions"), F.array_join(text.emojis(x), "").alias("emojis"))


TICKERS = (("THE", False), ("AND", False), ("DER", True), ("QUE", False), ("SRC", False))


@register(
    "entity_links",
    f"""WITH {POSTS_SQL}, {TAGGED_SQL}, {TOKENS_SQL}, t(asset_id, crypto) AS {values(TICKERS)}, k0(alias, asset_id) AS {values(ALIASES)}, k AS (SELECT * FROM k0 JOIN t USING (asset_id)), a AS (SELECT alias, count(DISTINCT asset_id) AS assets FROM k GROUP BY 1),
c AS (SELECT w.id, k.asset_id, a.assets, count(*) AS n FROM toks w JOIN k ON w.word = k.alias JOIN a ON a.alias = k.alias JOIN posts p ON p.id = w.id WHERE p.subreddit <> 'src1' OR k.crypto GROUP BY w.id, k.alias, k.asset_id, a.assets), f AS (SELECT id, asset_id, least(1.0, 0.5 / assets + 0.1 * (n - 1)) AS x FROM c UNION ALL
 SELECT id, upper(g) AS asset_id, 1.0 AS x FROM (SELECT id, unnest(regexp_extract_all(tagged, '\\$([A-Za-z]{{1,5}})\\b', 1)) AS g FROM tagged) WHERE upper(g) IN (SELECT asset_id FROM t))
SELECT id, asset_id, {r('max(x)', 'confidence')} FROM f WHERE x >= 0.35 GROUP BY 1, 2""",
)
def entity_links(spark, sf_dir):
    """The forum src1 stands for one of crypto currencies."""
    rows = tagged(spark, sf_dir).withColumn("text", F.col("tagged"))
    return rounded(text.link_entities(rows, constants(spark, ALIASES, "alias, asset_id"), constants(spark, TICKERS, "asset_id, crypto"), crypto_places=("src1",)))


POLARITY = f"""{POSTS_SQL}, {TOKENS_SQL}, lx(word, score) AS {values(SCORES)}, s AS (SELECT id, sum(score) / count(*) AS p, count(*) AS hits FROM toks JOIN lx USING (word) GROUP BY 1), pol AS (SELECT posts.*, coalesce(p, 0) AS polarity, coalesce(hits, 0) AS hits FROM posts LEFT JOIN s USING (id))"""


@register("polarity", f"WITH {POLARITY} SELECT id, {r('polarity', 'polarity')}, hits FROM pol")
def polarity(spark, sf_dir):
    return rounded(text.polarity(posts(spark, sf_dir), lexicon(spark)))


def scored(spark, sf_dir):
    rows = posts(spark, sf_dir)
    return rows.join(text.polarity(rows, lexicon(spark)), "id")


@register(
    "sentiment_daily_weighted",
    f"WITH {POLARITY}, w AS (SELECT author_id, CASE WHEN author_id % 3 <> 0 THEN (author_id % 5 + 1) / 5.0::DOUBLE ELSE 1 END AS w FROM (SELECT DISTINCT author_id FROM posts)) SELECT date, subreddit, {r('sum(polarity * w) / sum(w)', 'sentiment_index')}, count(*) AS post_count FROM pol JOIN w USING (author_id) GROUP BY 1, 2",
)
def sentiment_daily_weighted(spark, sf_dir):
    authors = posts(spark, sf_dir).select("author_id").distinct().where("author_id % 3 <> 0").withColumn("weight", (F.col("author_id") % 5 + 1) / 5.0)
    return rounded(text.weighted_sentiment(scored(spark, sf_dir), authors, ["date", "subreddit"]))


@register(
    "sentiment_bucket_3h",
    f"WITH {TICKS_SQL} SELECT kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(floor(hour(ts) / 3) AS INTEGER) AS bucket, {r('avg(price / 250 - 1)', 'mean')}, {r('stddev_samp(price / 250 - 1)', 'std')}, count(*) AS n FROM ticks GROUP BY 1, 2, 3",
)
def sentiment_bucket_3h(spark, sf_dir):
    rows = ticks(spark, sf_dir).withColumn("polarity", F.col("price") / 250 - 1)
    return rounded(text.sentiment_buckets(rows, "ts", 3, ["kind"]).withColumn("date", F.col("date").cast("string")))


@register(
    "sentiment_divergence",
    f"""WITH {DAILY}, t AS (SELECT event_type AS asset, CAST(ts AS DATE) AS ts, avg(value / 250 - 1) AS si FROM events GROUP BY 1, 2)
SELECT asset, CAST(ts AS VARCHAR) AS day, CAST(CASE WHEN sign(si) * sign(ret) < 0 THEN 1 WHEN ret IS NULL THEN NULL ELSE 0 END AS DOUBLE) AS diverges FROM t JOIN daily USING (asset, ts)""",
)
def sentiment_divergence(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    mood = rows.groupBy(F.col("kind").alias("asset"), F.to_date("ts").alias("ts")).agg(F.avg(F.col("price") / 250 - 1).alias("sentiment_index"))
    return text.divergence(mood, daily(spark, sf_dir), ["asset", "ts"]).select("asset", F.col("ts").cast("string").alias("day"), F.col("diverges").cast("double").alias("diverges"))


MOOD = "mood AS (SELECT event_type AS asset, CAST(ts AS DATE) AS ts, avg(value / 250 - 1) AS x FROM events GROUP BY 1, 2)"
B5 = "(PARTITION BY asset ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register(
    "sentiment_features",
    f"""WITH {MOOD}, a AS (SELECT *, CASE WHEN count(x) OVER {B5} = 5 THEN avg(x) OVER {B5} END AS m, CASE WHEN count(x) OVER {B5} = 5 THEN stddev_samp(x) OVER {B5} END AS s, x - lag(x) OVER (PARTITION BY asset ORDER BY ts) AS c FROM mood)
SELECT asset, CAST(ts AS VARCHAR) AS day, {r('m', 'sentiment_ma')}, {r('c', 'sentiment_change')}, {r('CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END', 'sentiment_z')} FROM a""",
)
def sentiment_features(spark, sf_dir):
    mood = ticks(spark, sf_dir).groupBy(F.col("kind").alias("asset"), F.to_date("ts").alias("ts")).agg(F.avg(F.col("price") / 250 - 1).alias("sentiment_index"))
    out = text.sentiment_features(mood, Series(order=("ts",)))
    return rounded(out.select("asset", F.col("ts").cast("string").alias("day"), "sentiment_ma", "sentiment_change", "sentiment_z"))


@register(
    "author_profiles",
    f"""WITH {POSTS_SQL}, {TAGGED_SQL}, g AS (SELECT *, CASE WHEN author_id % 3 = 0 THEN tagged ELSE '$abc $abc $abc $abc' END AS t FROM tagged), h AS (SELECT author_id, -sum(f * log2(f)) AS e FROM (SELECT author_id, n / sum(n) OVER (PARTITION BY author_id) AS f FROM (SELECT author_id, created_utc // 3600 % 24 AS hr, count(*) AS n FROM g GROUP BY 1, 2)) GROUP BY 1),
p AS (SELECT author_id, -sum(f * log2(f)) AS e FROM (SELECT author_id, n / sum(n) OVER (PARTITION BY author_id) AS f FROM (SELECT author_id, subreddit, count(*) AS n FROM g GROUP BY 1, 2)) GROUP BY 1),
a AS (SELECT author_id, count(*) AS posts, avg(CASE WHEN url IS NOT NULL AND NOT contains(url, 'reddit.com') THEN 1.0 ELSE 0.0 END) AS l, avg(coalesce(length(t), 0)) AS c, avg(coalesce(len(regexp_extract_all(t, '\\$([A-Za-z]{{1,5}})\\b')), 0)) AS d FROM g GROUP BY 1),
b AS (SELECT a.*, h.e AS he, p.e AS pe, CASE WHEN h.e < 2 THEN 0.3 ELSE 0 END + CASE WHEN l > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN c < 50 THEN 0.2 ELSE 0 END + CASE WHEN d > 3 THEN 0.2 ELSE 0 END AS bot FROM a JOIN h USING (author_id) JOIN p USING (author_id))
SELECT author_id, posts, {r('posts / 90', 'posts_per_day')}, {r('he', 'hour_entropy')}, {r('pe', 'place_entropy')}, {r('l', 'link_ratio')}, {r('d', 'cashtag_density')}, {r('c', 'mean_length')}, {r('bot', 'bot_probability')}, {r('1 - bot', 'credibility')} FROM b""",
)
def author_profiles(spark, sf_dir):
    """Authors of two in three ids write nothing but cashtags."""
    rows = tagged(spark, sf_dir).withColumn("cleaned_text", F.when(F.col("author_id") % 3 == 0, F.col("tagged")).otherwise("$abc $abc $abc $abc"))
    return rounded(text.author_profiles(rows))


@register("exact_copies", f"WITH {POSTS_SQL}, n AS (SELECT id, lower({_normal('text')}) AS t FROM posts) SELECT id, min(id) OVER (PARTITION BY t) AS first_id FROM n")
def exact_copies(spark, sf_dir):
    return text.exact_copies(posts(spark, sf_dir))


@register(
    "co_thread_edges",
    f"WITH {POSTS_SQL}, m AS (SELECT DISTINCT subreddit, date, author_id FROM posts WHERE author_id IN (SELECT author_id FROM posts GROUP BY 1 HAVING count(*) >= 3)) SELECT x.author_id AS src, y.author_id AS dst, count(*) AS weight FROM m x JOIN m y ON x.subreddit = y.subreddit AND x.date = y.date AND x.author_id <> y.author_id GROUP BY 1, 2",
)
def co_thread_edges(spark, sf_dir):
    return graph.co_thread_edges(posts(spark, sf_dir), "author_id", ["subreddit", "date"], min_interactions=3)


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(i.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN (SELECT e.dst, sum(r.rank * e.weight / o.total) AS x FROM e JOIN o USING (src) JOIN r{k - 1} r ON r.node = e.src GROUP BY 1) i ON i.dst = n.node)"
        )
    return (
        f"WITH {POSTS_SQL}, m AS (SELECT DISTINCT subreddit, date, author_id FROM posts), e AS (SELECT x.author_id AS src, y.author_id AS dst, count(*) AS weight FROM m x JOIN m y ON x.subreddit = y.subreddit AND x.date = y.date AND x.author_id <> y.author_id GROUP BY 1, 2), "
        f"o AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1), n AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e), {', '.join(steps)} SELECT node, round(rank, 6) + 0.0 AS rank FROM r{rounds}"
    )


@register("pagerank", _pagerank_sql(4))
def pagerank(spark, sf_dir):
    return rounded(graph.thread_pagerank(posts(spark, sf_dir), "author_id", ["subreddit", "date"], rounds=4))


@register(
    "autocorrelation",
    f"""WITH {RETURNS}, a AS (SELECT asset, ret, lag(ret, 1) OVER ({W}) AS l1, lag(ret, 2) OVER ({W}) AS l2, lag(ret, 3) OVER ({W}) AS l3 FROM rets) SELECT asset, count(ret) AS n, {r('corr(ret, l1)', 'acf_1')}, {r('corr(ret, l2)', 'acf_2')}, {r('corr(ret, l3)', 'acf_3')} FROM a GROUP BY 1""",
)
def autocorrelation(spark, sf_dir):
    return rounded(st.autocorrelation(returns(spark, sf_dir)))


CHANGE = f"{TICKS_SQL}, a AS (SELECT asset, lag(price) OVER ({W}) AS b, price - lag(price) OVER ({W}) AS d FROM ticks)"


@register("half_life", f"WITH {CHANGE}, c AS (SELECT asset, regr_slope(d, b) AS s, count(*) AS n FROM a WHERE b IS NOT NULL GROUP BY 1) SELECT asset, {r('s', 'slope')}, n, {r('CASE WHEN s < 0 THEN -ln(2) / s END', 'half_life')} FROM c")
def half_life(spark, sf_dir):
    return rounded(st.half_life(ticks(spark, sf_dir)))


@register(
    "dickey_fuller",
    f"WITH {CHANGE}, c AS (SELECT asset, count(*) AS n, regr_slope(d, b) AS s, regr_sxx(d, b) AS sxx, regr_syy(d, b) AS syy, regr_sxy(d, b) AS sxy FROM a WHERE b IS NOT NULL GROUP BY 1) SELECT asset, n, {r('s', 'slope')}, {r('s / sqrt((syy - s * sxy) / (n - 2) / sxx)', 't_stat')} FROM c",
)
def dickey_fuller(spark, sf_dir):
    return rounded(st.dickey_fuller(ticks(spark, sf_dir)))


@register("variance_ratio", f"WITH {TICKS_SQL}, a AS (SELECT asset, ln(price) - ln(lag(price) OVER ({W})) AS a, ln(price) - ln(lag(price, 4) OVER ({W})) AS k FROM ticks) SELECT asset, {r('var_samp(k) / (4 * var_samp(a))', 'variance_ratio')}, count(a) AS n FROM a GROUP BY 1")
def variance_ratio(spark, sf_dir):
    return rounded(st.variance_ratio(ticks(spark, sf_dir)))


@register("jarque_bera", f"WITH {RETURNS} SELECT asset, count(ret) AS n, round(count(ret) / 6 * (pow({skew('ret')}, 2) + pow(kurtosis_pop(ret), 2) / 4), 4) + 0.0 AS jarque_bera FROM rets GROUP BY 1")
def jarque_bera(spark, sf_dir):
    return rounded(st.jarque_bera(returns(spark, sf_dir), ["asset"]).withColumn("jarque_bera", F.round("jarque_bera", 4)))


def cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


_G = 0.5772156649015329
_CHANCE = 0.1 * ((1 - _G) * NormalDist().inv_cdf(1 - 1 / 10) + _G * NormalDist().inv_cdf(1 - 1 / (10 * math.e)))


@register(
    "deflated_sharpe",
    f"""WITH {RETURNS}, a AS (SELECT asset, count(ret) AS n, avg(ret) / stddev_samp(ret) AS s, {skew('ret')} AS g, kurtosis_pop(ret) AS k FROM rets GROUP BY 1), b AS (SELECT *, 1 - g * s + (k + 2) / 4 * s * s AS v FROM a), c AS (SELECT *, CASE WHEN v > 0 THEN (s - {_CHANCE!r}) * sqrt(n - 1) / sqrt(v) END AS z FROM b)
SELECT asset, n, {r('s', 'sharpe')}, {r(f"CASE WHEN z IS NOT NULL THEN {cdf('z')} END", 'deflated_sharpe')} FROM c""",
)
def deflated_sharpe(spark, sf_dir):
    return rounded(st.deflated_sharpe(returns(spark, sf_dir), ["asset"]))


@register(
    "black_scholes",
    f"""WITH a AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * 1.05 AS x, p_size / 50.0::DOUBLE AS t FROM part), b AS (SELECT *, (ln(s / x) + (0.03 + 0.02) * t) / (0.2 * sqrt(t)) AS d1 FROM a), c AS (SELECT *, d1 - 0.2 * sqrt(t) AS d2 FROM b)
SELECT id, {r(f"s * {cdf('d1')} - x * exp(-0.03 * t) * {cdf('d2')}", 'call')}, {r(f"x * exp(-0.03 * t) * {cdf('(-d2)')} - s * {cdf('(-d1)')}", 'put')}, {r(cdf('d1'), 'delta')}, {r(cdf('d1') + ' - 1', 'put_delta')}, {r('exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (s * 0.2 * sqrt(t))', 'gamma')}, {r('s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) / 100', 'vega')},
{r(f"(-s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * 0.2 / (2 * sqrt(t)) - 0.03 * x * exp(-0.03 * t) * {cdf('d2')}) / 365", 'theta')}, {r(f"(-s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * 0.2 / (2 * sqrt(t)) + 0.03 * x * exp(-0.03 * t) * {cdf('(-d2)')}) / 365", 'put_theta')},
{r(f"x * t * exp(-0.03 * t) * {cdf('d2')} / 100", 'rho')}, {r(f"-x * t * exp(-0.03 * t) * {cdf('(-d2)')} / 100", 'put_rho')} FROM c""",
)
def black_scholes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.col("p_retailprice")
    return rounded(rows.select(F.col("p_partkey").alias("id"), *[v.alias(k) for k, v in st.black_scholes(price, price * 1.05, F.col("p_size") / 50.0, 0.03, 0.2).items()]))


@register(
    "granger",
    f"""WITH {BARS_SQL}, a AS (SELECT asset, close AS y, lag(close) OVER ({W}) AS y1, lag(CAST(volume AS DOUBLE)) OVER ({W}) AS x1 FROM bars), b AS (SELECT asset, count(*) AS n, var_pop(y) AS yy, var_pop(y1) AS aa, var_pop(x1) AS bb, covar_pop(y1, x1) AS ab, covar_pop(y, y1) AS ya, covar_pop(y, x1) AS yb FROM a WHERE y1 IS NOT NULL AND x1 IS NOT NULL GROUP BY 1),
c AS (SELECT *, yy - ya * ya / aa AS sh, yy - (ya * bb - yb * ab) / (aa * bb - ab * ab) * ya - (yb * aa - ya * ab) / (aa * bb - ab * ab) * yb AS lo FROM b) SELECT asset, n, {r('(sh - lo) * (n - 3) / lo', 'f_stat')} FROM c""",
)
def granger(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    return rounded(st.granger(rows, TICKS, "volume", "close"))


@register("allocations")
def allocations(spark, sf_dir):
    return rounded(portfolio.allocations(spark, daily(spark, sf_dir)))


@register("monte_carlo")
def monte_carlo(spark, sf_dir):
    stats = returns(spark, sf_dir).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).first()
    return portfolio.monte_carlo(spark, stats["m"] or 0.0, stats["s"] or 0.0)
