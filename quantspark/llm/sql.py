"""DuckDB SQL for the corpus queries that SQL can express: every pair by brute force, every span by its definition."""

from __future__ import annotations

from quantspark.llm import elkan, secrets
from quantspark.llm.pivots import MIN_COSINE


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located(pattern: str, kind: int) -> str:
    """Spans of all matches: a match starts where the pieces and the matches before it end."""
    found, pieces = f"regexp_extract_all(t, {_text(pattern)}, 0)", f"regexp_split_to_array(t, {_text(pattern)})"
    at = f"list_sum(list_transform({pieces}[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda p: length(p))), 0)"
    span = f"{{'s': CAST({at} AS INTEGER), 'k': {kind}, 'e': CAST({at} + length({found}[i]) AS INTEGER), 'm': {found}[i]}}"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {span})"


def _told(spans: str) -> str:
    names = "[" + ", ".join(map(_text, secrets.KINDS)) + "]"
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda s: {names}[s.k + 1] || ':' || s.s || ':' || s.e), ','), '')"


def _secret_sql() -> str:
    n = secrets.WINDOW
    assigned = f"list_filter({_located(secrets.ASSIGN, 0)}, lambda s: length(regexp_extract(s.m, {_text(secrets.ASSIGN)}, 2)) >= {secrets.MIN_ASSIGNED})"
    entropy = f"log2({n}) - list_sum(list_transform(map_values(list_aggregate(string_split(substr(c.m, w, {n}), ''), 'histogram')), lambda x: x * log2(x))) / {n}"
    peak = f"list_max(list_transform(range(1, length(c.m) - {n} + 2), lambda w: {entropy}))"
    fits = lambda p: f"regexp_matches(c.m, {_text(p)})"
    needed = (
        f"CASE WHEN {fits('^[0-9]+$')} OR {fits('^[A-Za-z/_-]+=*$')} THEN 99 WHEN {fits('^(?:[0-9a-f]+|[0-9A-F]+)$')} THEN {secrets.MIN_ENTROPY['hex']} "
        f"WHEN {fits('^[A-Za-z0-9]+$')} THEN {secrets.MIN_ENTROPY['alnum']} ELSE {secrets.MIN_ENTROPY['base64']} END"
    )
    # RE2 has no back-reference: a character six times in a row is looked for by name.
    runs = " OR ".join(f"contains(c.m, '{ch * 6}')" for ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")
    allowed = " OR ".join(fits(p) for p in secrets.ALLOW if "\\1" not in p)
    clear = "len(list_filter(base, lambda b: b.s < c.e AND c.s < b.e)) = 0"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_concat({assigned}, list_concat({_located(secrets.ACCESS, 1)}, {_located(secrets.HEX, 2)})) AS base FROM d),
e AS (SELECT *, list_filter(list_filter({_located(secrets.CANDIDATE, 3)}, lambda c: regexp_matches(c.m, '[0-9]')), lambda c: {clear} AND NOT ({allowed} OR {runs}) AND {peak} >= {needed}) AS extra FROM b)
SELECT doc_id, len(list_filter(base, lambda s: s.k = 0)) AS n_assign, len(list_filter(base, lambda s: s.k = 1)) AS n_access, len(list_filter(base, lambda s: s.k = 2)) AS n_hex,
sha256({_told('base')}) AS base_sha256, {_told('list_concat(base, extra)')} AS spans FROM e"""


_LINK_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
 WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {MIN_COSINE}),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def _cluster_sql() -> str:
    """Every distance of every round: vectors and centroids by component, one pair of steps for each round."""
    fits = f"len(v) = {elkan.DIMENSIONS} AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) * {elkan.SCALE} >= {elkan.MAX_COMPONENT})) = 0"
    steps = [
        "e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)",
        f"k AS MATERIALIZED (SELECT rid, vec_id, list_transform(v, lambda x: CAST(floor(x * {elkan.SCALE}) AS BIGINT)) AS v FROM e WHERE {fits})",
        f"p AS MATERIALIZED (SELECT rid, unnest(range(1, {elkan.DIMENSIONS} + 1)) AS i, unnest(v) AS x FROM k)",
        f"f AS (SELECT v, row_number() OVER (ORDER BY sha256('{elkan.SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM k QUALIFY cluster < {elkan.CLUSTERS})",
        f"c0 AS MATERIALIZED (SELECT cluster, unnest(range(1, {elkan.DIMENSIONS} + 1)) AS i, unnest(v) AS c FROM f)",
    ]
    for n in range(elkan.ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT rid, cluster, sum((x - c) * (x - c)) AS d FROM p JOIN c{n} USING (i) GROUP BY rid, cluster)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d FROM d{n} GROUP BY rid)")
        mean = "(s - ((s % n) + n) % n) // n"
        sums = f"SELECT cluster, i, sum(x) AS s, count(*) AS n FROM p JOIN a{n} USING (rid) GROUP BY cluster, i"
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.cluster, o.i, CASE WHEN m.n IS NULL THEN o.c ELSE CAST({mean} AS BIGINT) END AS c FROM c{n} o LEFT JOIN ({sums}) m USING (cluster, i))")
    last = elkan.ROUNDS
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY cluster)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM k JOIN a{last} USING (rid) JOIN h USING (cluster)"""


def _repair_sql() -> str:
    """The cheapest edits by a step for each row: of each of the four states the least (cost, edits, repaired rows)."""
    far = 1 << 40
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"

    def then(x: str, cost: str, letter: str, row: str | None = None) -> str:
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t" + (f" || [{row}]}}" if row else "}")

    insert = lambda x, name: then(x, "3", "I", f"'{name}:'")
    closed = lambda v: f"(SELECT [a, b, c, {least('d', insert('c', 'assistant'))}] FROM (SELECT {v}[1] AS a, {v}[2] AS b, {v}[4] AS d, {least(f'{v}[3]', *[insert(f'{v}[{i}]', 'user') for i in (1, 2, 4)])} AS c))"
    gone = lambda i: then(f"w[{i}]", "4", "D")
    keep = lambda i, initial: then(f"w[{i}]", f"(CASE WHEN fault IN (1, 2) OR role[1:1] <> '{initial}' THEN {far} ELSE cut END)", "K", "role || ':' || text")
    name_ = lambda i, name: then(f"w[{i}]", f"(CASE WHEN fault IN (1, 2) THEN {far} ELSE 3 + cut END)", "R", f"'{name}:' || text")
    users = [f(i, x) for i in (1, 2, 4) for f, x in ((keep, "u"), (name_, "user"))]
    row = f"[{gone(1)}, {least(gone(2), keep(1, 's'))}, {least(gone(3), *users)}, {least(gone(4), keep(3, 'a'), name_(3, 'assistant'))}]"
    start = ", ".join(f"{{'c': CAST({c} AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}" for c in (0, far, far, far))
    spaces = r"[\x20\x09-\x0D]"
    return f"""WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, z),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
 lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{spaces}*$') THEN 3 ELSE 0 END AS fault FROM n),
q AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM f),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, [{start}] AS v FROM conversations
 UNION ALL SELECT conv_id, i, {row} AS v FROM (SELECT q.*, {closed('s.v')} AS w FROM s JOIN q ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.i = s.i + 1)),
e AS (SELECT conv_id, w, {least('w[1]', 'w[4]')} AS best FROM (SELECT conv_id, {closed('s.v')} AS w FROM s QUALIFY i = max(i) OVER (PARTITION BY conv_id))),
m AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(CAST(fault = 1 AS INT)) AS blank, sum(CAST(fault = 2 AS INT)) AS duplicate, sum(CAST(fault = 3 AS INT)) AS truncated,
 sum(CAST(before IS NOT NULL AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au') AS INT)) AS illegal FROM q GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256 FROM e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES: dict[str, str] = {"op4_pivot_dedup": _LINK_SQL, "op6_secret_scan": _secret_sql(), "op11_elkan_clusters": _cluster_sql(), "op13_conversation_repair": _repair_sql()}
