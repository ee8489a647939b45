"""URL filters: host-and-path rules first, association rules mined by FP-growth for the rest.

Labelled URLs become transactions of tokens; Spark's FP-growth mines the token combinations that go with a bad
label. Rules below the least confidence or support go, rules of which chance may be the reason, and rules that a
shorter one makes needless. A rule is posted in an inverted index under its rarest token, so that common tokens fetch
few rules, and a fetched rule fits where the URL holds all of its tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch, fold_ascii

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
DEFAULT_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BAD = "label=bad"
#: Labelled URLs that a rule rests on at least, however few are labelled.
MIN_COUNT = 5
#: Least lower bound of a rule's confidence (Wilson's, at Z deviations): more bad than good beyond doubt.
MIN_SURE, Z = 0.5, 2.576


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// and for null."""
    return fold_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prefix_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host suffixes of up to three labels, whole host, words of path segments without
    digits, extension, query keys, fragment. Null has none."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    tail = lambda n: F.when(F.size(labels) >= n, F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), "."))).otherwise(F.lit(None))
    words = F.transform(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("[0-9]")), lambda s: F.concat(F.lit("path:"), fold_ascii(s)))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("query:"), fold_ascii(k)))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    single = F.array(
        F.concat(F.lit("scheme:"), fold_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        tail(1),
        tail(2),
        tail(3),
        F.concat(F.lit("site:"), host),
        F.when(ending != "", F.concat(F.lit("type:"), fold_ascii(ending))),
        F.when(F.regexp_extract(url, r"#(.+)$", 1) != "", F.concat(F.lit("anchor:"), F.regexp_extract(url, r"#(.+)$", 1))),
    )
    known = F.filter(F.concat(single, words, keys), lambda t: t.isNotNull())
    return F.when(F.instr(url, "://") > 0, F.array_distinct(known)).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, scratch: Scratch, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """(rule_id, tokens, anchor, confidence, support) from rows (url, bad).

    Rules name tokens whose URLs are bad with at least min_confidence and min_lift times the usual share, on MIN_COUNT
    URLs at least and with a lower confidence limit of MIN_SURE. All such rules stay. A rule is needless where a
    rule of fewer of its tokens is at least as sure. Null labels are left out; an empty table, or one without bad rows,
    gives no rules.
    """
    rows = labelled.where(F.col("bad").isNotNull()).select(F.when(F.col("bad"), F.concat(url_tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(url_tokens(F.col("url"))).alias("items"))
    rows = scratch.save(rows.where(F.size("items") > 0), "transactions")
    total = rows.count()
    least = min(1.0, max(min_support, MIN_COUNT / max(total, 1)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    n, p = F.col("support") * total / F.col("confidence"), F.col("confidence")
    sure = (p + Z**2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n))) / (1 + Z**2 / n)
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", sure.alias("sure")).where(F.col("sure") >= MIN_SURE)
    found = scratch.save(found, "mined")
    # A shorter rule is needed to make a longer one needless: join on a token they share, then compare whole sets.
    wide = found.select(F.col("tokens").alias("wide"), F.col("confidence").alias("certain"), F.explode("tokens").alias("token"))
    short = found.select(F.col("tokens").alias("short"), F.col("confidence").alias("also"), F.element_at("tokens", 1).alias("token"))
    needless = wide.join(short, "token").where((F.size("short") < F.size("wide")) & (F.size(F.array_except("short", "wide")) == 0) & (F.col("also") >= F.col("certain"))).select(F.col("wide").alias("tokens")).distinct()
    kept = found.join(needless, "tokens", "left_anti").withColumn("rule_id", F.array_join("tokens", " "))
    common = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = kept.select("rule_id", F.explode("tokens").alias("token")).join(common, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    return scratch.save(kept.join(posted, "rule_id"), "rules")


def matched_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, mined_rule, confidence): the surest mined rule of each row (row, url) that one fits. Rows are numbered, so
    null and repeated URLs share no key; rules meet rows by their anchors, however many there are."""
    looked = rows.select("row", url_tokens(F.col("url")).alias("tokens")).select("row", "tokens", F.explode("tokens").alias("anchor"))
    fetched = looked.join(rules.select(F.col("tokens").alias("needed"), "anchor", "rule_id", "confidence"), "anchor")
    fits = fetched.where(F.size(F.array_except("needed", "tokens")) == 0)
    return fits.groupBy("row").agg(F.max(F.struct("confidence", "rule_id")).alias("best")).select("row", F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    The longest prefix rule decides; elsewhere a URL that a mined rule fits is blocked and any other allowed. Null
    URLs and those without :// have empty host and path and are allowed. URLs of any length are read whole; null ids
    and repeated rows stay. No pages give no rows, no labelled pages no mined rules.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    slim = scratch.save(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "pages")
    rows = slim.join(matched_rows(slim.select("row", "url"), mine_rules(labelled, scratch, **mining)), "row", "left")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    name, verdict = prefix_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host, "path": path})
    method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined_rule", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose document is labelled; bad means low quality or toxic. An unknown half of a label
    counts as fine, an unknown label leaves the page out."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    judged = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return pages.select("page_id", "url").join(judged.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").select("url", "bad")
