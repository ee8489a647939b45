from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def documents(spark, texts, sources=None, schema=DOCS):
    """Rows of documents with ids from 0."""
    rows = [(i, t, "en", sources[i] if sources else "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Null, empty, blank, very long, repeated and accented texts, null ids and sources, and clashing extra columns."""
    rows = [
        (0, None, "src1"),
        (1, "", None),
        (2, " \t\n", "src1"),
        (3, "Ünïcode wörter 😀 emoji " * 3, "src2"),
        (3, "Ünïcode wörter 😀 emoji " * 3, "src2"),
        (4, "one two three " * 9000, None),
        (None, "null id text", "src1"),
        (5, "x", "src3"),
    ]
    wide = [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "fp", 5.0, [1]) for i, t, s in rows]
    return spark.createDataFrame(wide, f"{DOCS}, row int, size int, hash int, fp string, `__stats` double, `__base` array<int>")
