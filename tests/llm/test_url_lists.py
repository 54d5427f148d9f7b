import random

from jobmeter.llm import url_lists

CAPTURES = "n int, url string, fetched_at long, decision string, `key` int, t int"
ENTRIES = "list string, `key` string, action string, listed_at long"


def keys_of(url):
    """Host, keys from the most to the least specific."""
    rest = url.split("//", 1)[1] if "//" in url else None
    if rest is None:
        return None, []
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = [s for s in ("/" + rest.split("/", 1)[1] if "/" in rest else "").split("?")[0].split("#")[0].split("/") if s]
    labels = host.split(".")
    return host, ["/".join([host, *path[:i]]) for i in range(len(path), 0, -1)] + [".".join(labels[i:]) for i in range(len(labels))]


def brute_force(url, at, entries):
    host, keys = keys_of(url) if url is not None else (None, [])
    if not host or at is None:
        return ("invalid", None, None, None)
    strength = {"remove": 0, "allow": 1, "block": 2}
    for key in keys:
        active = []
        for name in sorted({e[0] for e in entries}):
            own = [(e[3], strength[e[2]]) for e in entries if e[0] == name and e[1] == key and e[2] in strength and e[3] is not None and e[3] <= at]
            if own and max(own)[1]:
                since, s = max(own)
                active.append((-s, -since, name))
        if active:
            s, since, name = min(active)
            return ("block" if s == -2 else "allow", key, name, -since)
    return ("none", None, None, None)


def test_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "com", "10.0.0.1"]
    keys = hosts + ["a.com/p", "x.a.com/p", "x.a.com/p/q", "b.org/r"]
    entries = [(rng.choice("LM"), rng.choice(keys), rng.choice(["block", "allow", "remove"]), rng.randint(0, 9)) for _ in range(60)]
    entries += entries[:5] + [("L", None, "block", 1), ("L", "b.org", "block", None), ("L", "b.org", "other", 3)]
    urls = [f"http://{h}{p}" for h in [*hosts, "q.b.org", "xa.com", "c.net"] for p in ("", "/", "/p", "/p/q/z?u=1", "/r#f", "/pq")]
    urls += ["HTTP://user@X.A.com:80/p", "//b.org./r", None, "", "no url", "http://", "x" * 5000]
    captures = [(i, u, rng.randint(0, 10), "clash", 1, 2) for i, u in enumerate(urls * 3)]
    captures += [(-1, "http://a.com/p", None, "clash", 1, 2), captures[0]]
    long_list = [(n, k, a, t) for n, k, a, t in entries]
    df = spark.createDataFrame(captures, CAPTURES)
    given = spark.createDataFrame(long_list, ENTRIES)
    day = lambda c: f"timestamp_seconds({c} * 86400)"
    df = df.selectExpr("n", "url", f"{day('fetched_at')} as fetched_at", "decision", "`key`", "t")
    given = given.selectExpr("list", "`key`", "action", f"{day('listed_at')} as listed_at")
    found = url_lists.judge(df, given)
    assert found.columns == ["n", "url", "fetched_at", "key", "t", "decision", "rule", "rule_list", "rule_from"]
    rows = found.selectExpr("n", "url", "decision", "rule", "rule_list", "cast(unix_seconds(rule_from) / 86400 as int) as since").collect()
    assert len(rows) == len(captures)
    expected = {(n, u): brute_force(u, t, entries) for n, u, t, *_ in captures}
    for r in rows:
        assert (r["decision"], r["rule"], r["rule_list"], r["since"]) == expected[r["n"], r["url"]], r


def test_hosts_that_are_numbers_in_brackets(spark):
    urls = ["http://[2001:db8::1]:8080/p/q", "http://u@[2001:DB8::1]/", "http://[2001:db8::2]/p"]
    df = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)], "n int, url string, fetched_at long")
    given = spark.createDataFrame([("L", "http://[2001:db8::1]/p", "block", 1), ("L", "[2001:db8::1]", "allow", 2)], ENTRIES)
    df, given = (t.withColumn(c, t[c].cast("timestamp")) for t, c in ((df, "fetched_at"), (given, "listed_at")))
    found = {r["n"]: (r["decision"], r["rule"]) for r in url_lists.judge(df, given).collect()}
    assert found == {0: ("block", "[2001:db8::1]/p"), 1: ("allow", "[2001:db8::1]"), 2: ("none", None)}


def test_no_entries_and_no_captures(spark):
    df = spark.createDataFrame([(1, "http://a.com", 3)], "n int, url string, fetched_at long")
    given = spark.createDataFrame([], "list string, `key` string, action string, listed_at long")
    df, given = (t.withColumn(c, t[c].cast("timestamp")) for t, c in ((df, "fetched_at"), (given, "listed_at")))
    assert [r["decision"] for r in url_lists.judge(df, given).collect()] == ["none"]
    assert url_lists.judge(df.limit(0), given).collect() == []


def test_main_path_is_native(spark):
    import inspect

    source = inspect.getsource(url_lists)
    assert not any(word in source for word in ("udf", "pandas", "Arrow", ".rdd"))
