"""Posts: normalising, cashtags, entity links, polarity, weighted sentiment, credibility, exact copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.frames import Series, lag, ratio, rolling_mean, rolling_std, settled

#: Signatures in a block of those that share a band.
NEAR_BLOCK = 512
URL = r"https?://\S+|www\.\S+"
CASHTAG = r"\$([A-Za-z]{1,5})\b"
MENTION = r"(?:^|[^A-Za-z0-9_])/?u/([A-Za-z0-9_-]+)"
#: Pictographs, symbols, dingbats and flags.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
#: Forums about crypto-currencies, in lower case.
CRYPTO_PLACES = ("cryptocurrency", "bitcoin", "ethereum", "cryptomarkets")


def normalized(text: Column) -> Column:
    """Links as [URL], cashtags in upper case, white space squeezed and trimmed; null stays null."""
    marked = F.regexp_replace(text, URL, " [URL] ")
    parts = F.zip_with(F.split(marked, CASHTAG, -1), F.regexp_extract_all(marked, F.lit(CASHTAG), F.lit(0)), lambda p, t: F.concat(p, F.coalesce(F.upper(t), F.lit(""))))
    raised = F.when(marked.rlike(CASHTAG), F.array_join(parts, "")).otherwise(marked)
    return F.trim(F.regexp_replace(raised, r"\s+", " "))


def cashtags(text: Column) -> Column:
    """Distinct upper-case tags of one to five letters behind a dollar sign."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), F.upper))


def mentions(text: Column) -> Column:
    """User names behind u/ or /u/, in order."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def emojis(text: Column) -> Column:
    """The emoji characters, in order."""
    return F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def link_entities(posts: DataFrame, aliases: DataFrame, tickers: DataFrame, id_col: str = "id", text_col: str = "text", place_col: str = "subreddit", least: float = 0.35, crypto_places: Sequence[str] = CRYPTO_PLACES) -> DataFrame:
    """(id, asset_id, confidence): known cashtags with 1, aliases with the share of the alias among its assets plus what
    repeated mentions add.

    aliases: (alias, asset_id), lower-case; tickers: (asset_id, crypto). Only tickers are assets; in a place of crypto
    currencies an alias means such a currency. Spark
    broadcasts the two dimensions while they are small, and then only words that are aliases are shuffled.
    """
    known = aliases.distinct().join(tickers.select("asset_id", "crypto"), "asset_id")
    ambiguous = known.groupBy("alias").agg(F.countDistinct("asset_id").alias("assets"))
    named = known.join(ambiguous, "alias")
    tags = posts.select(F.col(id_col).alias("id"), F.explode(cashtags(F.col(text_col))).alias("asset_id"))
    tags = tags.join(tickers.select("asset_id"), "asset_id", "left_semi").withColumn("confidence", F.lit(1.0))
    words = posts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(place_col), F.lit(""))).isin(*crypto_places).alias("in_crypto"), F.explode(tokens(F.col(text_col))).alias("alias"))
    counts = words.join(named, "alias").where(~F.col("in_crypto") | F.col("crypto")).groupBy("id", "alias", "asset_id", "assets").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.withColumn("confidence", F.least(F.lit(1.0), 0.5 / F.col("assets") + 0.1 * (F.col("n") - 1))).where(F.col("confidence") >= least)
    return tags.unionByName(scored.select("id", "asset_id", "confidence")).groupBy("id", "asset_id").agg(F.max("confidence").alias("confidence"))


def polarity(posts: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, polarity, hits): mean score of the words that the lexicon (word, score) knows, 0 without any.

    The lexicon comes first, so that only words it knows are aggregated; Spark broadcasts it while its known size is
    small, and then no word is shuffled.
    """
    words = posts.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("word"))
    sums = words.join(lexicon, "word").groupBy("id").agg(F.avg("score").alias("polarity"), F.count(F.lit(1)).alias("hits"))
    return posts.select(F.col(id_col).alias("id")).join(sums, "id", "left").fillna({"polarity": 0.0, "hits": 0})


def weighted_sentiment(posts: DataFrame, weights: DataFrame, by: Sequence[str], author: str = "author_id") -> DataFrame:
    """Mean polarity weighted by author (1 where unknown), 0 where the weights sum to nothing."""
    rows = posts.join(weights, author, "left").withColumn("__w", F.coalesce("weight", F.lit(1.0)))
    total = F.sum("__w")
    return rows.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("polarity") * F.col("__w")) / total).otherwise(0.0).alias("sentiment_index"), F.count(F.lit(1)).alias("post_count"))


def sentiment_buckets(posts: DataFrame, ts: str, hours: int = 3, by: Sequence[str] = ()) -> DataFrame:
    bucket = F.floor(F.hour(ts) / hours).cast("int")
    return posts.groupBy(*by, F.to_date(ts).alias("date"), bucket.alias("bucket")).agg(F.avg("polarity").alias("mean"), F.stddev_samp("polarity").alias("std"), F.count(F.lit(1)).alias("n"))


def sentiment_features(daily: DataFrame, s: Series, x: str = "sentiment_index", n: int = 5) -> DataFrame:
    """Moving mean, change, and z score against the n rows up to the current one."""
    return daily.withColumns(
        {
            "sentiment_ma": rolling_mean(F.col(x), s, n),
            "sentiment_change": F.col(x) - lag(x, s),
            "sentiment_z": ratio(F.col(x) - rolling_mean(F.col(x), s, n), rolling_std(F.col(x), s, n), 0.0),
        }
    )


def divergence(sentiment: DataFrame, prices: DataFrame, on: Sequence[str]) -> DataFrame:
    """1 where sentiment and return point opposite ways."""
    rows = sentiment.join(prices, list(on))
    return rows.withColumn("diverges", ((F.signum("sentiment_index") * F.signum("ret")) < 0).cast("int"))


def author_profiles(posts: DataFrame, author: str = "author_id", place: str = "subreddit", text: str = "cleaned_text", url: str = "url", created: str = "created_utc", days: int = 90) -> DataFrame:
    """One row per author: posts, posts a day, entropies of hours and places in bits, share of posts that link elsewhere,
    cashtags a post, mean length, bot probability and credibility (1 less it).

    Few different hours, links in most posts, short texts and many cashtags speak of a bot. Without a time all posts are
    at noon, without links none has one. Rows are counted by author, hour and place first, so that a prolific author is
    some hundreds of rows when the entropies are taken.
    """
    has = {c: c in posts.columns for c in (place, url, created)}
    words = F.coalesce(F.col(text), F.lit(""))
    hour = F.hour(F.timestamp_seconds(F.col(created))) if has[created] else F.lit(12)
    linked = (F.col(url) != "") & ~F.contains(F.col(url), F.lit("reddit.com")) if has[url] else F.lit(False)
    rows = posts.select(
        author, F.coalesce(hour, F.lit(12)).alias("__h"), (F.col(place) if has[place] else F.lit(None).cast("string")).alias("__p"), F.coalesce(linked, F.lit(False)).cast("long").alias("__l"),
        F.length(words).alias("__c"), F.size(F.regexp_extract_all(words, F.lit(CASHTAG), F.lit(0))).alias("__t")
    )
    cells = rows.groupBy(author, "__h", "__p").agg(F.count(F.lit(1)).alias("__n"), F.sum("__l").alias("__l"), F.sum("__c").alias("__c"), F.sum("__t").alias("__t"))

    def entropy(by: str, name: str) -> DataFrame:
        sums = cells.groupBy(author, by).agg(F.sum("__n").alias("__n"))
        p = F.col("__n") / F.sum("__n").over(Window.partitionBy(author))
        return sums.withColumn("__e", -p * F.log2(p)).groupBy(author).agg(F.sum("__e").alias(name))

    total = cells.groupBy(author).agg(F.sum("__n").alias("posts"), F.sum("__l").alias("__l"), F.sum("__c").alias("__c"), F.sum("__t").alias("__t"))
    out = total.join(entropy("__h", "hour_entropy"), author).join(entropy("__p", "place_entropy"), author)
    out = out.withColumns({"link_ratio": F.col("__l") / F.col("posts"), "mean_length": F.col("__c") / F.col("posts"), "cashtag_density": F.col("__t") / F.col("posts"), "posts_per_day": F.col("posts") / days})
    points = ((F.col("hour_entropy") < 2, 0.3), (F.col("link_ratio") > 0.7, 0.3), (F.col("mean_length") < 50, 0.2), (F.col("cashtag_density") > 3, 0.2))
    bot = sum((F.when(test, F.lit(x)).otherwise(F.lit(0.0)) for test, x in points), F.lit(0.0))
    out = out.withColumn("bot_probability", F.least(bot, F.lit(1.0))).withColumn("credibility", F.greatest(F.lit(0.0), 1 - F.col("bot_probability")))
    return out.select(author, "posts", "posts_per_day", "hour_entropy", "place_entropy", "link_ratio", "cashtag_density", "mean_length", "bot_probability", "credibility")


def exact_copies(posts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, first_id): the smallest id with the same normalised lower-case text; null texts stand alone."""
    key = F.md5(F.lower(normalized(F.col(text_col))))
    rows = posts.select(F.col(id_col).alias("id"), key.alias("key"))
    first = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"))
    return rows.join(first, "key", "left").select("id", F.coalesce("first_id", "id").alias("first_id"))


def minhash_signatures(posts: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 128, shingle: int = 1) -> DataFrame:
    """(id, signature): the least value of each of so many hash functions over the text's words, or shingles of words."""
    def sign(texts: pd.Series) -> pd.Series:
        rng = np.random.default_rng(1)
        a, b = rng.integers(1, 1 << 61, size, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, size, dtype=np.uint64)
        out = []
        for value in texts:
            words = (value or "").lower().split()
            parts = {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
            # A least value needs no order, and words of a set none to be looked for twice.
            hashed = pd.util.hash_array(np.array(list(parts), dtype=object), categorize=False).astype(np.uint64)
            low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(hashed), 4096):
                low = np.minimum(low, ((hashed[at : at + 4096, None] * a + b) >> np.uint64(2)).min(axis=0))
            out.append(low.astype(np.int64))
        return pd.Series(out)

    return posts.select(F.col(id_col).alias("id"), F.pandas_udf(sign, "array<long>")(F.col(text_col)).alias("signature"))


def near_copies(posts: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, size: int = 128, shingle: int = 1) -> DataFrame:
    """(id, first_id): the smallest earlier id whose signature agrees in at least threshold of its values, else the id.
    Texts that are null or have no word stand alone.

    Signatures that may differ in d values are cut into d + 1 bands: two that agree enough agree in some band whole, so
    no pair is missed. Under a band key every two distinct signatures are compared, in blocks of NEAR_BLOCK by
    NEAR_BLOCK; rows of one signature are compared once. Bands are counted as pairs of numbers, and only signatures that
    share one travel whole. Signatures are computed once.
    """
    bands = size - math.ceil(threshold * size - 1e-9) + 1
    if not 1 <= bands <= size:
        raise ValueError("threshold must be above 0 and at most 1")
    spoken = posts.where(F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = minhash_signatures(spoken, "id", "text", size, shingle).withColumn("sig", F.md5(F.array_join("signature", ",")))
    signed = settled(signed)
    distinct = signed.where("id is not null").groupBy("sig").agg(F.min("id").alias("low"), F.first("signature").alias("signature"))
    ends = [size * k // bands for k in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("signature", a + 1, b - a)).alias("key")) for k, (a, b) in enumerate(zip(ends, ends[1:]))])
    slim = distinct.select("sig", F.explode(keys).alias("b")).select("sig", "b.band", "b.key")
    # Near texts agree in most bands, and then the same signatures meet under many keys: one key for each such set, known
    # by its size and 128 bits of hashes, is compared.
    sets = slim.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y")).where("n > 1")
    sets = sets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"))
    counts = sets.select("b.band", "b.key", F.ceil(F.col("n") / NEAR_BLOCK).cast("int").alias("chunks"))
    banded = slim.join(counts, ["band", "key"]).join(distinct, "sig").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    # A pair of chunks (i, j), i <= j, meets in one task: chunk i goes to every (i, j) and to every (k, i).
    cells = banded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "sig", "low", "signature", "band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second")
    )
    least = size - bands + 1

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low", kind="stable", ignore_index=True)
        values, low, second = np.stack(frame["signature"].to_numpy()), frame["low"], frame["second"].to_numpy()
        apart = frame["i"].iloc[0] != frame["j"].iloc[0]
        rows, found = [], []
        for at in range(len(frame)):
            # Rows are in the order of ids: the first that agrees enough has the smallest.
            near = (values[:at] == values[at]).sum(axis=1) >= least
            if apart:
                near &= second[:at] != second[at]
            if near.any():
                rows.append(at)
                found.append(int(near.argmax()))
        return pd.DataFrame({"sig": frame["sig"].iloc[rows].to_numpy(), "first_id": low.iloc[found].to_numpy()})

    kind = dict(signed.dtypes)["id"]
    found = cells.groupBy("band", "key", "i", "j").applyInPandas(compare, f"sig string, first_id {kind}").groupBy("sig").agg(F.min("first_id").alias("near"))
    firsts = distinct.select("sig", "low").join(found, "sig", "left").select("sig", F.least("low", "near").alias("first_id"))
    told = signed.select("id", "sig").join(firsts, "sig", "left").select("id", F.when(F.col("id").isNotNull(), F.col("first_id")).alias("first_id"))
    alone = posts.where(~F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))).select(F.col(id_col).alias("id"), F.col(id_col).alias("first_id"))
    return told.unionByName(alone)
