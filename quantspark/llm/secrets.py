"""Secret scans by pattern and by sliding-window entropy (DataFrame functions only).

Positions are code points, end exclusive. Spark's regular expression functions give the matches but not their
places; the places are the running lengths of the pieces between the matches, as split() returns them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import free_name

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_ASSIGNED = 6
#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits per character of some window, by the narrowest character class that holds the candidate.
#: Candidates of letters alone or digits alone are words and numbers.
MIN_ENTROPY = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that look random and are not secrets: identifiers, sample values, counting and repeating strings.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|redacted",
    r"(?i)01234567|12345678|abcdefgh|deadbeef",
    r"(.)\1{5}",
)
SPAN = "struct<start:int,kind:int,end:int,text:string>"
EMPTY = f"array<{SPAN}>"
#: Characters of candidates; a character's place is its counter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Elements in a block of a running total. Appending copies an array, so no array grows beyond a block while it is built.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers, join folded over those before it, from 0. join is associative: a sum or a maximum.

    Blocks are folded each for itself, then the blocks' totals, and every block is moved by what lies before it.
    """

    def fold(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, zero, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.array_append(s["before"], s["at"]).alias("before")))

    def whole(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: fold(F.slice(items, at, F.lit(BLOCK))))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, lambda x: x["at"]))["before"], lambda x, first: F.transform(x["before"], lambda v: join(first, v)))))

    return bound(values, whole)


def located(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind, end, text>>; empty without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A match and the piece before it; what is behind the last match is left away.
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match")))
    pairs = F.filter(pairs, lambda x: x["match"].isNotNull())

    def spans(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda x: x["gap"] + F.length(x["match"])), lambda a, b: a + b)
        return F.zip_with(
            before,
            pairs,
            lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("text")),
        )

    return F.when(text.rlike(pattern), bound(pairs, spans)).otherwise(F.array().cast(EMPTY))


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of any window of the candidate (0 if it is shorter).

    One pass. The counts of the window's characters are kept in the state, several to a number; when the window moves,
    the entering and the leaving character change their counts and their terms of sum(c log2 c), nothing else.
    Characters outside ALPHABET share one counter.
    """
    width = window.bit_length()
    each = 63 // width
    numbers = len(ALPHABET) // each + 1
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    ones = F.array(*[F.lit(1 << (width * k)).cast("long") for k in range(each)])

    def gain(count: Column) -> Column:
        return F.element_at(terms, count + 2) - F.element_at(terms, count + 1)

    def step(codes: Column) -> Callable[[Column, Column], Column]:
        def count(state: Column, code: Column) -> Column:
            packed = F.element_at(state["counts"], F.floor(code / each).cast("int") + 1)
            return (F.call_function("shiftright", packed, code % each * width) % (1 << width)).cast("int")

        def move(state: Column, i: Column) -> Column:
            entering = F.element_at(codes, i)
            full = i > window
            leaving = F.when(full, F.element_at(codes, F.when(full, i - window).otherwise(F.lit(1)))).otherwise(F.lit(-1))
            same = F.when(leaving == entering, F.lit(1)).otherwise(F.lit(0))
            total = state["total"] + gain(count(state, entering) - same) - F.when(full, gain(count(state, leaving) - 1)).otherwise(F.lit(0.0))
            one = lambda code, k: F.when(F.floor(code / each) == k, F.element_at(ones, code % each + 1)).otherwise(F.lit(0).cast("long"))
            counts = F.transform(state["counts"], lambda n, k: n + one(entering, k) - F.when(full, one(leaving, k)).otherwise(F.lit(0).cast("long")))
            entropy = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(state["peak"], entropy).alias("peak"))

        return move

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak"))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return bound(codes, lambda codes: F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step(codes), lambda s: s["peak"]))


def looks_random(candidate: Column) -> Column:
    """True where some window reaches the entropy of its class and no allow-list pattern fits."""
    has = lambda pattern: candidate.rlike(pattern)
    needed = (
        F.when(has(r"^[0-9]+$") | has(r"^[A-Za-z/_-]+=*$"), F.lit(math.inf))
        .when(has(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(MIN_ENTROPY["hex"]))
        .when(has(r"^[A-Za-z0-9]+$"), F.lit(MIN_ENTROPY["alnum"]))
        .otherwise(F.lit(MIN_ENTROPY["base64"]))
    )
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | has(pattern)
    return F.when(needed == F.lit(math.inf), F.lit(False)).when(allowed, F.lit(False)).otherwise(peak_entropy(candidate) >= needed)


def secret_spans(docs: DataFrame, text_col: str = "text", base_col: str = "__base", extra_col: str = "__extra") -> DataFrame:
    """docs with two columns of spans: those of the patterns, and those that entropy adds beside them.

    Null texts count as empty and give empty arrays; repeated rows stay; other columns stay as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(located(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= MIN_ASSIGNED)
    out = docs.withColumn(base_col, F.concat(assign, located(text, ACCESS, 1), located(text, HEX, 2)))
    out = out.withColumn(extra_col, F.filter(located(text, CANDIDATE, 3), lambda s: s["text"].rlike("[0-9]")))
    free = bound(F.col(extra_col), lambda extra: apart(extra, F.col(base_col)))
    return out.withColumn(extra_col, F.filter(free, lambda s: looks_random(s["text"])))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.

    One overlaps a span where it starts before the span's end and ends behind its start. Both are sorted together,
    the others by start and the spans by end: the largest end among the others before a span decides.
    """
    marked = lambda x, at, own: F.struct(x[at].alias("at"), F.lit(own).alias("own"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["text"].alias("text"))
    # At equal places a span (0) precedes one of the others (1), which only touches it.
    both = F.array_sort(F.concat(F.transform(spans, lambda x: marked(x, "end", 0)), F.transform(others, lambda x: marked(x, "start", 1))))

    def free(items: Column) -> Column:
        reach = running(F.transform(items, lambda x: x["own"] * x["end"]), F.greatest)
        kept = F.filter(F.zip_with(items, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda y: (y["x"]["own"] == 0) & (y["r"] <= y["x"]["start"]))
        return F.transform(kept, lambda y: F.struct(*[y["x"][c].alias(c) for c in ("start", "kind", "end", "text")]))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(both, free))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, and all spans.

    Null texts count as empty: no spans and the hash of the empty string. Null ids and repeated rows keep a row each,
    an empty table gives an empty result. Very long texts, candidates and many matches are scanned whole, in time that
    grows little faster than their length.
    """
    found = secret_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter(F.col("__base"), lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("__base")), 256).alias("base_sha256"),
        spans_text(F.concat("__base", "__extra")).alias("spans"),
    )


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with every run of overlapping spans replaced by a mark. The spans are sorted and not none.

    The text is first cut once for each block of spans, so that no short piece is counted from the start of a long text.
    """

    def replaced(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        # A span opens a mark unless one before it reaches into it; a piece is the text from there to its start.
        pieces = F.zip_with(reach, spans, lambda r, s: F.struct(r.alias("low"), s["start"].alias("high"), s["end"].alias("end")))
        return bound(F.filter(pieces, lambda p: p["high"] >= p["low"]), joined)

    def joined(pieces: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))

        def part(at: Column) -> Column:
            block = F.slice(pieces, at, F.lit(BLOCK))
            low, high = F.element_at(block, 1)["low"], F.element_at(block, -1)["high"]
            cut = F.struct(block.alias("block"), low.alias("low"), F.substring(text, low + 1, high - low).alias("text"))
            return bound(cut, lambda c: F.array_join(F.transform(c["block"], lambda p: F.concat(F.substring(c["text"], p["low"] - c["low"] + 1, p["high"] - p["low"]), F.lit(mark))), ""))

        return F.array_join(F.transform(starts, part), "")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(bound(spans, replaced), F.substring(text, last + 1, F.length(text)))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by a mark (overlapping spans by one); count_col follows the text's length.

    Null texts stay null and texts without a secret as they are; no row is added or dropped, an empty table stays empty.
    """
    base, extra = free_name(docs, "__base"), free_name(docs, "__extra")
    found = secret_spans(docs, text_col, base, extra)
    spans = F.array_sort(F.concat(base, extra))
    text = F.col(text_col)
    out = found.withColumn(text_col, F.when(F.size(F.col(base)) + F.size(F.col(extra)) == 0, text).otherwise(without_spans(text, spans, mark)))
    if count_col and count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.size(F.col(base)) + F.size(F.col(extra)) == 0, F.col(count_col)).otherwise(F.length(text_col).cast(kind)))
    return out.select(*docs.columns)
