"""Best-fit packing by the sum-of-squares rule.

Texts become token ids once, in Arrow batches; from then on only slim rows (one for each piece of a text) move.
Full pieces are sequences of their own. The others are dealt by hash into groups of bounded size, and each group is
packed by itself: a piece goes to the open sequence, or to a new one, for which the sum over residual gaps of the
squared number of open sequences with that gap becomes smallest. Pieces come by falling length. Sequences that keep a
gap are taken apart and packed again, first within the group, then once more in new groups made of what is left over
everywhere, so that the number of groups hardly costs sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import Scratch

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs.
GROUP = 16_384
#: Gaps above these are packed again: within the group, and across groups.
INNER_GAP, OUTER_GAP = 2, 8
INNER_ROUNDS = 4
VOCABULARY = "byte_bpe_50k"
PIECES_TYPE = "array<struct<piece:int, start:long, length:long, crc:long>>"
#: Texts of other characters, or with the mark of a special token, take the slower tokenizer. Both have the same
#: vocabulary and agree on these characters; beyond them their Unicode tables may differ.
UNUSUAL = re.compile(r"[^\x09\x0a\x0d\x20-\x7e¡-ɏ‐-‧€]|<\|")
FAST_CHARS = 1_000_000


@lru_cache(maxsize=2)
def _tokenizers(vocabulary: str) -> tuple:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public.path(f"{vocabulary}.json")), fast


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of a text and the end id; null texts have the end id alone."""
    if not text:
        return [END_ID]
    exact, fast = _tokenizers(vocabulary)
    if len(text) <= FAST_CHARS and not UNUSUAL.search(text):
        return [*fast.encode_ordinary(text), END_ID]
    return [*exact.encode(text, add_special_tokens=False).ids, END_ID]


def pieces_of(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids): pieces of full capacity behind a first one that may be shorter."""
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    raw = np.array(ids, "<u4").tobytes()
    return [(k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def text_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, row, piece, start, length, crc), one row per piece."""

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([pieces_of(token_ids(x, vocabulary), capacity) for x in batch], dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.pandas_udf(cut, PIECES_TYPE)(F.col(text_col)).alias("pieces"))
    return rows.select("doc_id", "row", F.explode("pieces").alias("p")).select("doc_id", "row", "p.*")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces of each sequence, as indices into lengths, in the order in which they were placed.

    With N(h) open sequences of level h, moving one from h to t changes the sum of squares by 2 (N(t) - N(h) + 1), a
    new one of level t adds 2 N(t) + 1, and filling one up takes its 2 N(h) - 1 away. Ties go to the fuller level.
    """
    level_count = np.zeros(capacity + 1)
    level_count[capacity] = -0.5  # full sequences are closed: with this value the first formula holds for them too
    held = np.full(capacity + 1, -np.inf)  # the counts again, levels without a sequence being out of reach
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        reach = level_count[size + 1 :] - held[1 : capacity - size + 1]
        at = len(reach) - 1 - int(reach[::-1].argmin()) if len(reach) else -1
        fresh = 2 * level_count[size] + 1 if size < capacity else -np.inf
        if at >= 0 and 2 * (reach[at] + 1) <= fresh:
            level = at + 1
            number = open_at[level].pop()
            level_count[level] -= 1
            held[level] = level_count[level] if open_at[level] else -np.inf
            level += size
            sequences[number].append(i)
        else:
            number, level = len(sequences), size
            sequences.append([i])
        if level < capacity:
            open_at[level].append(number)
            level_count[level] += 1
            held[level] = level_count[level]
    return sequences


def pack(lengths: np.ndarray, capacity: int = CAPACITY, rounds: int = INNER_ROUNDS) -> list[list[int]]:
    """sum_of_squares, with sequences that keep a gap taken apart and packed again while that saves any."""
    done: list[list[int]] = []
    left = np.arange(len(lengths))
    last = None
    for _ in range(rounds + 1):
        packed = [left[x] for x in map(np.array, sum_of_squares(lengths[left], capacity))] if len(left) else []
        if last is not None and len(packed) >= len(last):
            break
        full = [x for x in packed if capacity - lengths[x].sum() <= INNER_GAP]
        last = [x for x in packed if capacity - lengths[x].sum() > INNER_GAP]
        done.extend(full)
        if not last:
            break
        left = np.sort(np.concatenate(last))
    return [x.tolist() for x in [*done, *(last or [])]]


def _pack_groups(rows: DataFrame, capacity: int, level: int) -> DataFrame:
    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        number, offset, gap = (np.zeros(len(frame), np.int64) for _ in range(3))
        for k, items in enumerate(pack(lengths, capacity)):
            ends = np.cumsum(lengths[items])
            number[items], offset[items], gap[items] = k, ends - lengths[items], capacity - ends[-1]
        return frame.assign(sequence_id=(level << 60) + (frame["pack_group"].to_numpy() << 20) + number, offset=offset, gap=gap)

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.groupBy("pack_group").applyInPandas(place, f"{kinds}, sequence_id long, offset long, gap long")


def _grouped(rows: DataFrame, count: int, level: int) -> DataFrame:
    groups = max(1, -(-count // GROUP))
    return rows.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(groups)))


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """pieces(row, piece, length, ...) with sequence_id and offset: each sequence is gapless from 0."""
    slim = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    first = scratch.save(_pack_groups(_grouped(short, short.count(), 0), capacity, 0), "packed")
    open_ = first.where(F.col("gap") > OUTER_GAP).select(*slim)
    again = _pack_groups(_grouped(open_, open_.count(), 1), capacity, 1)
    full = pieces.where(F.col("length") >= capacity).select(*slim, (F.lit(2 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [*slim, "sequence_id", "offset"]
    return first.where(F.col("gap") <= OUTER_GAP).select(*placed).unionByName(again.select(*placed)).unionByName(full)


def pack_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id. Rows that repeat are packed each for itself; an empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.save(text_pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    return pack_pieces(pieces, scratch, capacity).select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
