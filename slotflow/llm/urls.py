"""URL filter: fixed rules first, else the empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted per host. The bad rate of a suffix is shrunk to that
of all pages, a registered domain's to its suffix, a host's to its domain, each through a
beta-binomial prior whose strength is estimated from the spread between groups of that level.
A host is blocked when the lower bound of its posterior bad rate is above a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.llm.common import fresh, quoted
from slotflow.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and paths that begin with the rule's."""

    verdict: str
    text: str  # host and path, like "example.com/en/"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class Reputation:
    """How outcomes become verdicts."""

    most_bad: float = 1 / 3  # a host with a bad rate surely above it is blocked
    deviations: float = 1.6448536269514722  # 95 % one-sided
    least_spread: float = 1 / 1001  # prior strength at most 1,000 pages
    most_spread: float = 0.5  # and at least one
    #: Labels under which a country's registry gives out names: with a country code they are a suffix of two parts.
    registries: tuple[str, ...] = tuple("ac co com edu go gob gov govt gv id info ltd mil ne net nhs nom or org plc res sch web".split())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; of equally long ones a block, then the first by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == BLOCK, [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule], how: Reputation = Reputation(), *, url: str = "url", bad: str | None = "bad") -> DataFrame:
    """All columns with ``host``, ``path``, ``rule`` and ``verdict``; own columns of these names go.

    ``bad`` names a column with the labelled outcome of a page: 1 bad, 0 good, NULL unlabelled
    (any page, if ``bad`` is None). A NULL or odd url has an empty host, a group like any other.
    A host without labelled pages has the reputation of its domain, and so on upwards; without
    any label every host is allowed. Repeated rows count as often as they occur.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    outcome = fresh("__bad", pages.columns)
    mark = F.col(quoted(bad)).cast("int") if bad else F.lit(None).cast("int")
    named = pages.select(
        *(F.col(quoted(c)) for c in keep),
        F.when(mark.isin(0, 1), mark).alias(outcome),
        host_of(F.col(quoted(url))).alias("host"),
        path_of(F.col(quoted(url))).alias("path"),
    )
    hosts = cut_lineage(named.groupBy("host").agg(F.count(outcome).alias("n"), F.coalesce(F.sum(outcome), F.lit(0)).alias("x")))
    known, limit = fresh("__host", [*named.columns]), fresh("__bound", [*named.columns])
    bounds = reputation(hosts, how).select(F.col("host").alias(known), F.col("bound").alias(limit))
    fixed = fresh("__fixed", [*named.columns])
    by_method = F.when(F.col(limit) > how.most_bad, BLOCK).otherwise(ALLOW)
    return (
        named.join(bounds, F.col("host") == F.col(known), "left")
        .withColumn(fixed, matched_rule(F.col("host"), F.col("path"), rules))
        .select(*(F.col(quoted(c)) for c in keep), "host", "path", F.col(fixed)["rule"].alias("rule"), F.coalesce(F.col(fixed)["verdict"], by_method).alias("verdict"))
    )


def reputation(hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """(host, n, x, domain, suffix, bound) from hosts with their labelled pages ``n``, of which ``x`` bad."""
    placed = hosts.withColumn("suffix", suffix_of(F.col("host"), how)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    mean = total.x / total.n if total.n else 0.0
    suffixes = placed.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("mean", F.lit(mean))
    suffixes = _shrunk(suffixes, how).select("suffix", F.col("post").alias("mean"))
    domains = placed.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(suffixes, "suffix")
    domains = _shrunk(domains, how).select("suffix", "domain", F.col("post").alias("mean"))
    return _shrunk(placed.join(domains, ["suffix", "domain"]), how).select("host", "n", "x", "domain", "suffix", "bound")


def _shrunk(groups: DataFrame, how: Reputation) -> DataFrame:
    """Groups with ``post``, the posterior mean, and ``bound``, its lower bound; ``mean`` is the prior's.

    The spread r of the groups' rates follows from E (x - n m)^2 = n m (1 - m) (1 + (n - 1) r);
    a beta prior with that spread has the strength 1 / r - 1.
    """
    noise = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    found = groups.agg(
        F.sum((F.col("x") - F.col("n") * F.col("mean")) * (F.col("x") - F.col("n") * F.col("mean")) - noise).alias("over"),
        F.sum(noise * (F.col("n") - 1)).alias("scale"),
    ).first()
    spread = found.over / found.scale if found.scale else how.least_spread
    strength = 1 / min(max(spread, how.least_spread), how.most_spread) - 1
    a, b = F.lit(strength) * F.col("mean") + F.col("x"), F.lit(strength) * (1 - F.col("mean")) + (F.col("n") - F.col("x"))
    shaped = groups.withColumn("a", a).withColumn("b", b)
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return shaped.withColumn("post", F.col("a") / total).withColumn("bound", F.col("a") / total - how.deviations * deviation)


def suffix_of(host: Column, how: Reputation = Reputation()) -> Column:
    """The last label, or the last two where a registry's stands before a country code; a host of one label or an IPv4 address has none."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    return F.when((F.instr(name, ".") == 0) | name.rlike("^[0-9.]*$"), "").when(two.rlike(_two_parts(how)), two).otherwise(last)


def _two_parts(how: Reputation) -> str:
    return f"^({'|'.join(how.registries)})[.][a-z][a-z]$"


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one label more; the host without its port if there is no suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.when(F.instr(suffix, ".") > 0, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(suffix == "", name).otherwise(labels)
