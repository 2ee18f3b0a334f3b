"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, BARE, BARE_TEST, EXAMPLE_OWNERS, HEX


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(rank: int, pattern: str, group: int, keep: str) -> str:
    p = _q(pattern)
    return f"""
  SELECT doc_id, source, {rank} AS kind, e - len(hit) AS s, e, v FROM (
    SELECT doc_id, source, hit, v, list_sum(list_transform(gaps[:i], lambda x: len(x)))
           + list_sum(list_transform(hits[:i], lambda x: len(x))) AS e
    FROM (SELECT doc_id, source, string_split_regex(t, {p}) AS gaps, hits,
                 unnest(hits) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS v,
                 unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT *, regexp_extract_all(t, {p}, 0) AS hits
                FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents))))
  WHERE {keep}"""


_NAME = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END"
_SPAN = f"{_NAME} || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"

OP5 = f"""
WITH c AS ({_kind(0, ASSIGN, 2, "len(v) >= 8")}
  UNION ALL {_kind(1, ACCESS, 0, "true")}
  UNION ALL {_kind(2, HEX, 0, "true")}
  UNION ALL {_kind(3, BARE, 0, f"regexp_matches(v, {_q(BARE_TEST)}) AND regexp_matches(v, '[A-Za-z]')")}),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM c GROUP BY v),
k AS (SELECT c.*, n_owners >= {EXAMPLE_OWNERS} AS example FROM c JOIN own USING (v)),
found AS (SELECT * FROM k WHERE kind < 3 UNION ALL
  SELECT * FROM k WHERE kind = 3 AND NOT example AND NOT EXISTS (
    SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.kind < 3 AND b.s < k.e AND k.s < b.e)),
g AS (SELECT doc_id,
  count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
  count(*) FILTER (example) AS n_example,
  coalesce(string_agg({_SPAN}, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
  string_agg({_SPAN}, ',' ORDER BY s, kind) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN g USING (doc_id)"""

OP10 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 19) AS v
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s,
            row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id),
runs AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - lag(p, 1, -1) OVER (PARTITION BY doc_id ORDER BY p) AS gap
         FROM gone) WHERE gap > 1 GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, coalesce(runs.n, 0) AS n_spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)"""

OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, v FROM (
  SELECT doc_id, list_slice(w, s, s + 4) AS v
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0))),
ids AS (SELECT v, row_number() OVER () AS i FROM (SELECT v FROM g GROUP BY v HAVING count(*) > 1)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, i FROM g JOIN ids USING (v)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.i = b.i AND a.doc_id < b.doc_id
         GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents
          UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""

# crc32 bit by bit over the decimal digits of the id; a stretch of words equal to the word
# q further on is a run unless a longer or equal stretch of a divisor of q holds it.
OP13 = r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, c: xor(xor(s, c) >> 1, 3988292384 * (xor(s, c) & 1))), 4294967295) AS h
  FROM documents),
l AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM h),
t AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS v
  FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p, unnest(range(n)) AS i FROM l)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y
  ON x.doc_id = y.doc_id AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
same AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs)
  GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM same r WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.doc_id = r.doc_id AND b.q < r.q
  AND r.q % b.q = 0 AND b.s <= r.s AND b.s + b.m >= r.s + r.m)),
g AS (SELECT doc_id, count(*) AS n_runs, min({'m': -m, 's': s, 'q': q}) AS top,
  string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(v, ' ' ORDER BY i) AS c
  FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.m AS length, top.q AS period,
  1000 * -top.m // top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(c, '')) AS collapsed_sha256, n AS n_words
FROM l LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op3_ngram_jaccard_join": OP3, "op4_substring_dedup": OP4, "op5_secret_scan": OP5, "op10_exact_dedup": OP10,
              "op13_periodic_runs": OP13}
