"""URL filter: rules first, else the reputation of a page's host, shrunk by empirical Bayes.

A rule is a verdict, a host and a path; it fits its host and all subdomains where the url's path
starts with the rule's, and the longest fitting rule (host and path together) decides.

Other pages are judged by outcomes: pages that are labelled, good or bad. Of a host with few
labelled pages little is known, so its share of bad pages is shrunk towards that of its
registered domain, this towards that of its suffix, and this towards that of all pages. At each
level the groups' shares are taken as draws from a beta distribution about their parent's posterior
mean. How far they scatter is estimated from all groups of the level by moments: with n outcomes, x
of them bad, and m expected, (x - n m)^2 exceeds the binomial n m (1 - m) by rho (n - 1) n m (1 - m) on
average; the prior then weighs 1 / rho - 1 outcomes. A host is blocked if the lower bound of its
posterior share, its mean less ``z`` standard deviations, is above ``most``: one bad page isn't
evidence enough, unless the domain or the suffix is bad as a whole.

Addresses: for reputations user names, ports and a last dot don't count. The registered domain is
the suffix and the label before it; the suffix is the last label, or the last two where they are in
``second``; an IP address is its own domain and suffix.

Hot hosts: outcomes and pages are folded by host before anything is joined. Hosts, domains or suffixes
that hold 1/``HOT`` of the rows or more, at most ``HOT`` of them as shares sum to one, come by a
broadcast, all others by a join in which none is hot.

Defined results: a null url and one without ``://`` have an empty host and path and are allowed; so
are hosts without any outcome whose ancestors are good; pages without any label of either kind, or
without an id, aren't outcomes; of several labels of a page the worst counts; repeated pages count
each; without outcomes all is allowed; an empty table gives no rows; columns other than page_id and
url are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered; a parameter, as such lists change.
SECOND = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr")
#: Keys with this share of rows (one in so many) are joined by a broadcast.
HOT = 1000
#: Bounds of the scatter rho; without any group of two outcomes it is ``NO_RHO``.
LEAST_RHO, MOST_RHO, NO_RHO = 1e-4, 0.999, 0.1


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules) -> Column:
    """rule and verdict of the longest fitting one of rules(verdict, host, path); null if none fits. The rules become one expression, so there should be some hundreds at most."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in order], F.lit(None).cast("struct<rule:string,verdict:string>"))


def with_domain(rows: DataFrame, second=SECOND) -> DataFrame:
    """rows(host) with address, domain and suffix."""
    address = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    rows = rows.withColumn("address", address)
    a, two = F.col("address"), F.regexp_extract("address", r"(?:[^.]+\.)?[^.]+$", 0)
    numeric = a.rlike(r"^\[|^[0-9.]+$")
    suffix = F.when(numeric, a).when(two.isin(*second), two).otherwise(F.regexp_extract("address", r"[^.]+$", 0))
    domain = F.when(numeric, a).when(two.isin(*second), F.regexp_extract("address", r"(?:[^.]+\.)?[^.]+\.[^.]+$", 0)).otherwise(two)
    return rows.withColumn("domain", domain).withColumn("suffix", suffix)


def tallies(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """address, domain, suffix, pages, n, bad: each host's pages, those with an outcome, and the bad ones."""
    found = outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = with_domain(pages.select("page_id", host_of(F.col("url")).alias("host"))).filter("address <> ''").drop("host")
    rows = rows.join(found, "page_id", "left")
    return rows.groupBy("address", "domain", "suffix").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))


def joined(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, hot: int = HOT) -> DataFrame:
    """rows with the columns of side, one row a key; ``weight`` is how many rows a key has, ``total`` how many there are."""
    heavy = side.filter(F.col(weight) * hot >= total).drop(weight)
    light = side.filter(F.col(weight) * hot < total).drop(weight)
    # weights sum to the total, so there are ``hot`` heavy keys at most
    by_key = F.broadcast(heavy)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(by_key, key).unionByName(cold.join(light, key, "left"))


def prior_weight(groups: DataFrame) -> float:
    """How many outcomes the parent's share m weighs, from all groups(n, bad, m)."""
    n, m = F.col("n"), F.col("m")
    spread = (F.col("bad") - n * m) * (F.col("bad") - n * m) - n * m * (1 - m)
    over, of = groups.agg(F.sum(spread), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = NO_RHO if not of else min(max(over / of, LEAST_RHO), MOST_RHO)
    return 1 / rho - 1


def reputations(hosts: DataFrame, z: float = 1.645, hot: int = HOT) -> DataFrame:
    """address, pages, share, bound: the posterior share of bad pages of each host, and its lower bound, of ``tallies``."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts")).first()
    if not total["hosts"]:
        return hosts.select("address", "pages", F.lit(0.0).alias("share"), F.lit(0.0).alias("bound"))
    fold = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("members"))
    domains = common.cut(fold(hosts, "domain", "suffix"), "domains")
    suffixes = fold(domains, "suffix").withColumn("m", F.lit((total["bad"] + 1) / (total["n"] + 2)))
    share = lambda k: (F.col("bad") + k * F.col("m")) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", "members", share(prior_weight(suffixes)).alias("m"))
    domains = common.cut(joined(domains.withColumnRenamed("members", "held"), suffixes, "suffix", "members", domains.count(), hot), "domain-priors")
    below = domains.select("domain", "suffix", F.col("held").alias("members"), share(prior_weight(domains)).alias("m"))
    own = common.cut(joined(hosts, below.drop("suffix"), "domain", "members", total["hosts"], hot), "host-priors")
    k = prior_weight(own)
    own = own.withColumn("share", share(k))
    s = F.col("share")
    return own.select("address", "pages", "share", (s - z * F.sqrt(s * (1 - s) / (F.col("n") + k + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules, most: float = 0.5, z: float = 1.645, hot: int = HOT) -> DataFrame:
    """page_id, host, path, rule, verdict of pages(page_id, url), by rules and outcomes(page_id, bad)."""
    pages = pages.select("page_id", "url")
    hosts = common.cut(tallies(pages, outcomes), "hosts")
    verdicts = common.cut(reputations(hosts, z, hot).select("address", "pages", (F.round("bound", 9) > most).alias("blocked")), "host-verdicts")
    rows = with_domain(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))).drop("domain", "suffix")
    rows = joined(rows, verdicts, "address", "pages", verdicts.agg(F.sum("pages")).first()[0] or 0, hot)
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    rows = rows.withColumn("ruled", ruled)
    return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"))
