"""The url filter against its SQL, a brute-force computation, and literal urls."""

import math
import random

import duckdb
import pytest

from siftlake.llm import queries
from siftlake.llm.reputation import judge_urls, rule_of, with_domain

RULES = queries.URL_RULES
PAGE, BAD = "page_id long, url string", "page_id long, bad boolean"
FIELDS = ["page_id", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_rows_equal_the_sql(spark, sf):
    c = duckdb.connect()
    for name in ("pages", "labels"):
        c.sql(f"create view {name} as select * from '/root/testdata/{sf}/{name}.parquet'")
    got = queries.QUERIES["op12_url_reputation"](spark, f"/root/testdata/{sf}")
    assert got.columns == FIELDS
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(got.collect()) == key(c.sql(queries.ORACLES["op12_url_reputation"]).fetchall())


def brute(pages, outcomes, most, z):
    """Hosts below .test only: the last label is the suffix, the last two the domain."""
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, 0), int(b))
    hosts = {}
    for i, url in pages:
        if url and "://" in url:
            n = hosts.setdefault(url.split("://", 1)[1].split("/")[0].lower(), [0, 0])
            if i in bad:
                n[0] += 1
                n[1] += bad[i]

    def weight(groups):
        over = sum((x - n * m) ** 2 - n * m * (1 - m) for n, x, m in groups)
        of = sum(n * (n - 1) * m * (1 - m) for n, x, m in groups)
        return 1 / (min(max(over / of, 1e-4), 0.999) if of else 0.1) - 1

    def level(parent, of):
        groups = {}
        for h, (n, x) in hosts.items():
            g = groups.setdefault(of(h), [0, 0, parent(h)])
            g[0], g[1] = g[0] + n, g[1] + x
        k = weight(groups.values())
        return {g: (x + k * m) / (n + k) for g, (n, x, m) in groups.items()}, k

    n, x = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    suffixes, _ = level(lambda h: (x + 1) / (n + 2), lambda h: h.split(".")[-1])
    domains, _ = level(lambda h: suffixes[h.split(".")[-1]], lambda h: ".".join(h.split(".")[-2:]))
    shares, k = level(lambda h: domains[".".join(h.split(".")[-2:])], lambda h: h)
    return {h for h, s in shares.items() if s - z * math.sqrt(s * (1 - s) / (hosts[h][0] + k + 1)) > most}


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 3), (3, 1)])
def test_blocked_hosts_equal_a_brute_force_computation(spark, seed, hot):
    rng = random.Random(seed)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "x") for b in ("good", "bad", "mixed", "new") for c in ("net", "info", "xyz")]
    pages = [(i, f"http://{rng.choice(hosts[: 3 + i % len(hosts)])}/{i}") for i in range(1500)] + [(None, "http://www.bad.net/n"), (5, None), (6, "no host"), (7, "http:///x")]
    share = lambda url: 0.9 if ".bad." in url else 0.5 if ".mixed." in url else 0.1
    outcomes = [(i, rng.random() < share(url)) for i, url in pages[:1500] if ".new." not in url and rng.random() < 0.5] + [(None, True), (3, None)]
    got = judge_urls(spark.createDataFrame(pages, PAGE), spark.createDataFrame(outcomes, BAD), (), hot=hot).collect()
    blocked = brute(pages[:-4] + [(None, "http://www.bad.net/n")], outcomes, 0.5, 1.645)
    assert len(got) == len(pages)
    assert {r.host for r in got if r.verdict == "block"} == blocked
    assert blocked and all(".bad." in h or ".mixed." in h for h in blocked)
    assert all(r.verdict == ("block" if r.host in blocked else "allow") for r in got)


def test_rules(spark):
    urls = {
        "http://a.Example.ORG/es/1?x=/en/": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "https://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
        "https://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "https://x.com?/fr/": ("x.com", "", None, "allow"),
        "https://com/de/": ("com", "/de/", "com/de/", "block"),
        "https://x.org": ("x.org", "", None, "allow"),
        "https://telecom/de/": ("telecom", "/de/", None, "allow"),
        "http://a://b.com/de/": ("a:", "//b.com/de/", None, "allow"),
        "a.com/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://É.com/fr/": ("É.com", "/fr/", "com/fr/", "allow"),
    }
    rows = list(enumerate([*urls, None]))
    got = judge_urls(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], BAD), RULES).collect()
    want = [*urls.values(), ("", "", None, "allow")]
    assert {r.page_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_without_rules_none_fits(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("a", "/")], "host string, path string").select(rule_of(F.col("host"), F.col("path"), ()).alias("r")).first().r is None


def test_registered_domains(spark):
    hosts = {
        "a.b.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"),
        "u:p@h.net:80": ("h.net", "net"), "h.net.": ("h.net", "net"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "": ("", ""),
    }
    got = with_domain(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == hosts


def test_repeated_rows_empty_tables_other_columns_and_long_urls(spark):
    assert judge_urls(spark.createDataFrame([], PAGE), spark.createDataFrame([], BAD), RULES).count() == 0
    rows = [(1, "http://spam.net/" + "x" * 100_000, "a", 1, "p")] * 60
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, address string, n int, path string"), spark.createDataFrame([(1, True), (1, False)], BAD), RULES).collect()
    assert len(got) == 60 and {(r.host, len(r.path), r.verdict) for r in got} == {("spam.net", 100_001, "block")}
