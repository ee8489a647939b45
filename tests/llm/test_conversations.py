from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import conversations, queries

TYPE = "conv_id long, turn long, role string, text string"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by trying every edit at every place."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state):
        """state: 0 nothing, 1 system, 2 user, 3 assistant; at most three inserts in a row help."""

        def go(i, state, inserts):
            found = []
            if i == n and state in (0, 3):
                found.append((0, "", ()))
            into = 3 if state == 2 else 2
            name = {2: "user", 3: "assistant"}[into]
            if inserts < 3:
                found += [(c + 3, "I" + a, ((name, ""), *t)) for c, a, t in go(i, into, inserts + 1)]
            if i < n:
                role, text = rows[i][2:]
                found += [(c + 4, "D" + a, t) for c, a, t in [best(i + 1, state)]]
                if faults[i] not in (1, 2):
                    more = 3 * (faults[i] == 3)
                    kept = {"s": 1 if state == 0 else 0, "u": 2 if state != 2 else 0, "a": 3 if state == 2 else 0}.get(role[:1], 0)
                    if kept:
                        found += [(c + more, "K" + a, ((role, text), *t)) for c, a, t in [best(i + 1, kept)]]
                    found += [(c + 3 + more, "R" + a, ((name, text), *t)) for c, a, t in [best(i + 1, into)]]
            return found

        return min(go(i, state, 0))

    return best(0, 0)


def brute(rows, damaging=True):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]]
    for row in damage(rows) if damaging else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        groups[row[0]].append(row)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            shown = SEEN.findall(text)
            faults.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, told = cheapest(tuple(mine), tuple(faults))
        text = "\n".join(f"{r}:{t}" for r, t in told)
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(rng, count, longest, many_turns=True):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "A long one.", None, "Same.", "then. ", "word" * 30]
    rows = []
    for conv in range(count):
        for at in range(rng.integers(1, longest + 1)):
            turn = at if rng.random() < 0.8 else None if rng.random() < 0.2 else int(rng.integers(0, longest))
            rows.append((conv, turn, roles[rng.integers(len(roles))] if rng.random() < 0.5 else ("user", "assistant")[at % 2], texts[rng.integers(len(texts))] if rng.random() < 0.7 else f"Text {at}."))
    return rows


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_equals_every_edit_tried(spark):
    rows = random_rows(np.random.default_rng(1), 150, 7) + [(None, 1, "user", "Null id."), (None, 2, None, None)]
    df = spark.createDataFrame(rows, TYPE).repartition(3)
    assert told(conversations.repair_digest(df)) == brute(rows)


@pytest.mark.parametrize("max_rows", [1, 2, 5])
def test_pieces_give_what_whole_conversations_give(spark, max_rows):
    rows = random_rows(np.random.default_rng(max_rows), 25, 9)
    df = conversations.as_rows(spark.createDataFrame(rows, TYPE))
    got = conversations.repair(df, keep_rows=False, partitions=7, max_rows=max_rows)
    assert told(got) == brute(rows, damaging=False)


def test_a_conversation_with_most_rows_is_spread_over_tasks(spark):
    rng = np.random.default_rng(9)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", f"Turn {t}." if rng.random() < 0.9 else "again") for t in range(6000)] + random_rows(rng, 20, 6)
    rows = [r for r in rows if r[0] != 7 or r[1] is not None]
    df = conversations.as_rows(spark.createDataFrame(rows, TYPE))
    whole = told(conversations.repair(df, keep_rows=False, partitions=1, max_rows=10**6))
    parts = told(conversations.repair(df, keep_rows=False, partitions=9, max_rows=100))
    assert whole == parts and sum(c in "DKR" for c in parts[7][6]) >= 6000


def test_repaired_rows_are_well_formed_and_those_of_the_digest(spark):
    rows = random_rows(np.random.default_rng(3), 60, 8)
    df = conversations.as_rows(spark.createDataFrame(rows, TYPE))
    expected = brute(rows, damaging=False)
    got = defaultdict(list)
    for r in conversations.repair(df, keep_rows=True, partitions=5, max_rows=3).collect():
        got[r.conv_id].append(r)
    for conv, want in expected.items():
        mine = sorted(got[conv], key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert "".join(r.edit for r in mine) == want[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == want[7]


def test_the_table_stays_small(spark):
    rng = np.random.default_rng(4)
    automaton, state = conversations.Automaton(), 0
    state, _ = automaton.state(conversations.START)
    for symbol in rng.integers(0, 9, 50_000):
        state, _ = automaton.step(state, int(symbol))
    assert len(automaton.costs) < 200


def test_many_copies_of_a_row_and_awkward_rows(spark):
    rows = [(1, 0, "user", "Hi.")] * 60 + [(1, 1, "assistant", "Ho.")] + [(2, None, None, None)] * 40 + [(3, 5, "user", "x " * 60_000 + ".")] + [(4, t, "Sys", "é😀 .\n") for t in (3, 3, 9)]
    df = spark.createDataFrame(rows, TYPE).selectExpr("*", "1 AS n", "'x' AS fault", "2 AS block")
    assert told(conversations.repair_digest(df)) == brute(rows)
    plain = conversations.repair(conversations.as_rows(df), keep_rows=False)
    assert told(plain) == brute(rows, damaging=False)
    assert conversations.repair_digest(df.limit(0)).count() == 0
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.")], TYPE)
    assert told(conversations.repair_digest(one)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_equals_its_sql(spark, tmp_path):
    con = duckdb.connect()
    rows = random_rows(np.random.default_rng(12), 40, 7) + [(None, None, "user", None)]
    spark.createDataFrame(rows, TYPE).write.parquet(f"{tmp_path}/conversations.parquet")
    for path in (str(tmp_path), "/root/testdata/sf0.001"):
        source = f"{path}/conversations.parquet" + ("/*.parquet" if path == str(tmp_path) else "")
        con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{source}'")
        want = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op13_conversation_repair"]).fetchall()}
        got = told(queries.op13_conversation_repair(spark, path))
        assert got == want and got == brute([tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_hot_groups_are_one_row_before_they_are_shuffled(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")] * 1000, TYPE)
    got = conversations.repair_digest(df.withColumn("turn", F.lit(2).cast("long"))).first()
    assert got.duplicate == 999 and got.audit.count("D") == 999
