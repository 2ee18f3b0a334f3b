import hashlib
import re

from pyspark.sql import functions as F

from splitlift.llm import secrets as S
from splitlift.llm._rows import look_up

from llm_fixtures import make  # noqa: F401

A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               re.IGNORECASE | re.ASCII)
KEY = "AKIA" + "Q" * 16
HEX = "0123456789abcdef" * 3
LIVE = "Zk3x9-Qw81mmPLs0aaQ2"


def base(text):
    out = []
    for m in A.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    "", None, "plain words only", "é😀 password=abcdefgh1 x", "PassWord = 'short' token: abcdefghij",
    f"{KEY} and api_key:\"{KEY}\" {HEX}", "password=token: abcdefghij", "secret=" + "x" * 50_000,
    f"token={HEX}{HEX} {HEX}", "passwd:12345678,passwd:12345678", f"bare {LIVE} here", f"again {LIVE}",
    "ſecret=abcdefghij", "\n\ttoken\x20\x20=\x20\"aaaaaaaa\n", "AKIA" * 10 + "1", f"{LIVE}-two token={LIVE}",
]


def test_spans_match_a_plain_scan(make):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in S.secrets_digest(S.scan_secrets(make(rows))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans = base(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), t
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == q for _, k, _ in spans) for q in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == [
            s for s in joined(spans).split(",") if s]


def test_ownership_separates_examples_from_live_values(make, spark):
    rows = [(i, f"see {LIVE} there") for i in (1, 4, 7)] + [(2, "see copied-0123-ABCD-4567 x")] * 2
    rows += [(i, "see copied-0123-ABCD-4567 y") for i in (3, 4, 5)]
    found = S.scan_secrets(make(rows))
    digest = S.secrets_digest(found)
    live = {(r.doc_id, r.spans) for r in digest.collect() if r.spans}
    assert live == {(i, "live:4:24") for i in (1, 4, 7)}  # one owner; the other has three
    assert digest.count() == len(rows)


def test_repeated_rows_nulls_and_empty_table(make):
    rows = [(None, "token=abcdefgh12")] * 2 + [(1, "token=abcdefgh12")]
    got = S.secrets_digest(S.scan_secrets(make(rows))).collect()
    assert [r.n_assign for r in got] == [1, 1, 1]
    assert S.secrets_digest(S.scan_secrets(make([]))).collect() == []


def test_value_in_most_rows_is_dealt_out(make, spark):
    """Without help from skew joins no task gets more than a few lanes of a hot value."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spans = spark.range(20_000).selectExpr(
        "id as uid", "if(id % 10 < 9, 'hot', concat('v', id)) as hash", "cast(id % 7 as string) as owner",
        "cast(id as string) as repo")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        known = look_up(spans, S.ownership(spans), "hash", "uid")
        sizes = [r["count"] for r in known.groupBy(F.spark_partition_id()).count().collect()]
        hot = known.where("hash = 'hot'").select("n_owners", "n_repos").distinct().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes)
    assert [tuple(r) for r in hot] == [(7, 18_000)]


def test_main_path_is_native(make):
    plan = S.scan_secrets(make([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
