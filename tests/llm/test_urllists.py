import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from plumbline.llm.urllists import filter_captures

DAY = datetime(2024, 1, 1)


def keys(url):
    parts = urlsplit(url)
    host = (parts.hostname or "").removesuffix(".")
    labels, steps = host.split("."), [s for s in parts.path.split("/") if s]
    return ([("host", host)] + [("domain", ".".join(labels[k:])) for k in range(len(labels) - 1)] + [("prefix", host + "/" + "/".join(steps[: k + 1])) for k in range(len(steps))]) if host else []


def brute(captures, entries):
    """The last entry at or before the fetch, for each key and list."""
    out = []
    for page, url, at in captures:
        active = []
        for kind, value in keys(url) if url and at else []:
            for name in ("allow", "block"):
                past = [(t, action) for n, k, v, action, t in entries if (n, k, v) == (name, kind, value) and t is not None and t <= at]
                if past and max(past)[1] == "add":
                    active.append(({"prefix": 2, "host": 1, "domain": 0}[kind], len(value), name == "allow", f"{name}:{kind}:{value}"))
        best = max(active, default=None)
        out.append((page, len(active), best and best[3], bool(best) and not best[2]))
    return sorted(out, key=str)


def test_matches_history(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "m.other.org", "solo"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{h}{rng.choice(['', ':80', '.'])}{p}" for h in hosts for p in ("", "/", "/en/1?x=/y", "/en/2#q", "//en//3/")]
    captures = [(k, rng.choice(urls), DAY + timedelta(hours=rng.randrange(24 * 700))) for k in range(300)]
    captures += [(900, None, DAY), (901, "nonsense", DAY), (902, urls[0], None), (903, "", DAY), *captures[:20]]
    pool = sorted({k for u in urls for k in keys(u)})
    entries = [(rng.choice(["allow", "block"]), *rng.choice(pool), rng.choice(["add", "add", "remove"]), DAY + timedelta(days=rng.randrange(-200, 800))) for _ in range(120)]
    entries += [*entries[:9], ("block", "host", None, "add", DAY), ("block", "host", "solo", "add", None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("kind", F.lit("k"))
    e = spark.createDataFrame(entries, "list string, kind string, value string, action string, at timestamp")
    for rows in (50_000, 0):
        got = sorted(((r["page_id"], r["n_active"], r["matched"], r["blocked"]) for r in filter_captures(c, e, broadcast_rows=rows).collect()), key=str)
        assert got == brute(captures, entries)
    assert filter_captures(c, e.limit(0)).where("blocked or n_active > 0").count() == 0
    assert filter_captures(c.limit(0), e).count() == 0


def test_paths_of_many_steps(spark):
    deep = "http://h.example/" + "/".join("a" * (k % 3 + 1) for k in range(20_000))
    captures = spark.createDataFrame([(deep, "2024-03-01"), (deep + "x", "2024-03-01"), (None, "2024-03-01"), ("http://h.example/a", None)], "url string, fetched_at string")
    entries = [("block", "prefix", "h.example/a/aa", "add", "2024-01-01"), ("allow", "prefix", "h.example/a/aa/aaa", "add", "2024-02-01"), ("block", "prefix", "h.example", "add", "2024-01-01")]
    got = filter_captures(captures, spark.createDataFrame(entries, "list string, kind string, value string, action string, at string")).collect()
    assert sorted((r["n_active"], r["matched"] or "", r["blocked"]) for r in got) == [(0, "", False)] * 2 + [(2, "allow:prefix:h.example/a/aa/aaa", False)] * 2
