import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablepulse.llm import revisits as R

SCHEMA = "record_id long, type string, url string, ts long, status int, headers map<string,string>, payload_digest string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?ref=x", "example.com"),
        ("http://m.example.com/A?refer=1&&ref", "m.example.com/A?refer=1"),
        ("https://www2.example.com:443?q#f", "example.com?q"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("base", "far"), [(2, 60), (7, 60), (1000, 2**40)])
def test_against_brute_force(spark, base, far):
    rng = random.Random(base)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = {k: v for k, v in (("etag", rng.choice(["a", "W/a", "b", None])), ("last-modified", rng.choice(["1", "2", None])), ("date", str(i)), ("server", f"s{i}")) if v}
        rows.append((i, kind, rng.choice(["http://x/", "https://x", "y", None, "hot"] + ["hot"] * 6), rng.choice([None] + [rng.randrange(-20, 40)] * 9), rng.choice([200, 200, 404]), headers if rng.random() < 0.9 else None, f"p{i}"))
    rows += [rows[5], (401, "revisit", "hot", far, 304, {"server": "x" * 200_000}, None), (402, "response", "hot", -far, 200, None, "early")]
    got = sorted((r.record_id, r.outcome, r.response_id, tuple(r.headers), r.payload_digest) for r in R.resolve_revisits(spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)).withColumn("near", F.lit("clash")), base).collect())
    want = []
    canon = lambda u: None if u is None else u.split("//")[-1].rstrip("/")
    for i, kind, url, ts, _, headers, _ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        old = max((r for r in rows if r[1] == "response" and r[4] == 200 and url is not None and canon(r[2]) == canon(url) and ts is not None and r[3] is not None and r[3] < ts), key=lambda r: (r[3], r[0]), default=None)
        outcome, shown, payload = "no_earlier_response", headers, None
        if old:
            before = old[5] or {}
            a, b = (h.get("etag", "").removeprefix("W/") for h in (headers, before))
            c, d = (h.get("last-modified") for h in (headers, before))
            outcome = "resolved" if (a == b if a and b else not (c and d) or c == d) else "validator_mismatch"
            if outcome == "resolved":
                shown, payload = before | {k: v for k, v in headers.items() if k in R.PERMITTED}, old[6]
        want.append((i, outcome, old and old[0], tuple(sorted(f"{k}={v}" for k, v in shown.items())), payload))
    assert got == sorted(want, key=lambda x: x[0])
    assert {x[1] for x in got} == {"resolved", "validator_mismatch", "no_earlier_response"}


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    names = "record_id, url, outcome, response_id, headers, payload_digest"
    want = sorted(con.sql(f"select {names} from ({R.OP8_SQL})").fetchall())
    assert sorted(tuple(r) for r in R.op8_revisits(spark, "/root/testdata/sf0.01").collect()) == want
    assert R.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
