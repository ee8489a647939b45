"""Layered ingestion: raw JSON to bronze, silver, daily sentiment and gold features, as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.frames import Series
from quantspark.operators import text
from quantspark.operators.joins import as_of
from quantspark.operators.quality import keep_last

POST = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "author_id", "subreddit", "author", "title", "selftext", "url", "permalink")],
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("retrieved_at", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("num_comments", T.LongType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(posts, corrupt records): one JSON document a file or a line; broken ones are kept apart, not dropped unseen."""
    rows = spark.read.schema(POST).option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    return rows.where(~bad).drop("_corrupt"), rows.where(bad).select("_corrupt", F.input_file_name().alias("file"))


def write_days(df: DataFrame, path: str, column: str = "date") -> None:
    """Parquet by day, zstandard; only the days that df holds are replaced."""
    rows = df.repartition(F.col(column))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)


def read_days(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """What write_days wrote, the day as an ISO string again; conditions on it prune folders."""
    return spark.read.parquet(path).withColumn(column, F.col(column).cast("string"))


def bronze_posts(posts: DataFrame) -> DataFrame:
    """Posts with their day; the last retrieval of an id counts, authors are hashed."""
    rows = posts.withColumn("date", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd"))
    rows = rows.withColumn("author_id", F.coalesce("author_id", F.sha2("author", 256))).drop("author")
    return keep_last(rows, ["id"], ["retrieved_at"])


def silver_posts(bronze: DataFrame, aliases: DataFrame, tickers: DataFrame) -> DataFrame:
    """Cleaned text, entity links as array<struct<asset_id, confidence>>, the first of near copies over all days."""
    rows = bronze.withColumn("cleaned_text", text.normalized(F.concat_ws(" ", "title", "selftext"))).withColumn("__k", F.concat_ws("|", "date", "id"))
    first = text.near_copies(rows, "__k", "cleaned_text")
    rows = rows.join(first.where("id = first_id").select(F.col("id").alias("__k")), "__k").drop("__k")
    links = text.link_entities(rows, aliases, tickers, "id", "cleaned_text").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("asset_id", "confidence"))).alias("entity_links"))
    return rows.join(links, "id", "left")


def daily_sentiment(silver: DataFrame, lexicon: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, asset_id, sentiment_index, post_count): one row per linked asset and day."""
    scored = silver.join(text.polarity(silver, lexicon, "id", "cleaned_text"), "id")
    rows = scored.select("date", "author_id", "polarity", F.explode("entity_links").alias("link")).select("date", "author_id", "polarity", "link.asset_id")
    return text.weighted_sentiment(rows, weights, ["date", "asset_id"])


def gold_features(market: DataFrame, sentiment: DataFrame, start: str | None = None, end: str | None = None, look_back: int = 35, most_days: int = 1000) -> DataFrame:
    """One row per asset and calendar day from the prices of the look_back days before it, and the latest sentiment up
    to it. Days run from start to end, by default from the first market day to the day after the last, most_days at most.

    return_1d is the last return of the window, return_5d spans five intervals (return_1d where there are fewer) and
    volatility_30d is the population deviation. A price of zero or null counts as missing: returns that touch one are
    left out. Without two prices all are 0. The related returns look at one day alone, which holds no interval: 0.

    market: (asset_id, date, close); sentiment: (asset_id, date, sentiment_index, post_count), dates as ISO strings.
    """
    s = Series(key=("asset_id",), order=("date",))
    close = F.when(F.col("close") != 0, F.col("close"))
    prices = market.select("asset_id", "date", F.coalesce("close", F.lit(0.0)).alias("close"), (close / F.lag(close).over(s.window()) - 1).alias("r"), F.lit(False).alias("asked"))
    span = market.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first = F.lit(start).cast("date") if start else F.to_date("a")
    last = F.lit(end).cast("date") if end else F.date_add(F.to_date("b"), 1)
    days = F.slice(F.sequence(first, last), 1, most_days)
    spine = market.select("asset_id").distinct().crossJoin(F.broadcast(span)).select("asset_id", F.explode(days).alias("date"))  # span is one row
    spine = spine.select("asset_id", F.col("date").cast("string").alias("date"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("r"), F.lit(True).alias("asked"))
    both = prices.unionByName(spine).withColumn("day", F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")))
    frame = Window.partitionBy("asset_id").orderBy("day").rangeBetween(-look_back, -1)
    # Days asked for have no price; the first price of a window has its return from before the window.
    window = F.filter(F.collect_list(F.struct("asked", "day", "close", "r")).over(frame), lambda x: ~x["asked"])
    rows = both.withColumn("w", window).where("asked").withColumn("c", F.transform("w", lambda x: x["close"]))
    rows = rows.withColumn("x", F.filter(F.transform(F.slice("w", 2, look_back), lambda x: x["r"]), lambda r: r.isNotNull()))
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, r: a + r) / n
    spread = F.aggregate("x", F.lit(0.0), lambda a, r: a + (r - F.col("mean")) * (r - F.col("mean"))) / n
    rows = rows.withColumn("mean", F.when(n > 0, mean)).withColumn("return_1d", F.when(n > 0, F.element_at("x", -1)).otherwise(0.0))
    far = F.when(F.size("c") >= 6, F.element_at("c", -6))
    five = F.when((n > 0) & (far != 0), F.element_at("c", -1) / far - 1).otherwise(F.col("return_1d"))
    rows = rows.select("asset_id", "date", "return_1d", five.alias("return_5d"), F.when(n > 0, F.sqrt(spread)).otherwise(0.0).alias("volatility_30d"), *[F.lit(0.0).alias(f"related_return_{i}") for i in (1, 2, 3)])
    out = as_of(rows, sentiment, ["asset_id"], "date", ["sentiment_index", "post_count"], prefix="")
    return out.fillna({"sentiment_index": 0.0, "post_count": 0})
