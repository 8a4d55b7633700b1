"""URL filters: fixed rules first, then the reputation of the host.

The share of bad pages of a host is estimated by empirical Bayes. A suffix is shrunk toward all pages, a registered
domain toward its suffix, a host toward its domain; how strongly is estimated at each level from how much the groups
differ (beta-binomial, method of moments). A host without labelled pages has its domain's mean and a wide posterior.
A page is blocked when even the lower bound of its host's posterior is above the limit; the bound is the mean less
some standard deviations of the beta posterior, not its quantile.

A host's reputation is that of its name: the host without user, port and a dot at the end. A numeric address is its own
domain and has the suffix of all such addresses. ``page_outcomes`` labels pages by themselves: a page is bad if a quality
rule rejects the text between its tags.

Counts are aggregated before they are shuffled, so a host with a third of all pages is one row a task. Pages stay on
the left of the join with the hosts, which Spark splits or broadcasts by size.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged with all
others of an empty host. Labels without a page, and null outcomes, are left out; a page that is labelled twice counts
as bad if one label says so. Rows that share a page_id are each judged by their own url. A null or empty html has no words and
is bad; very long ones are read whole. Columns other than page_id, url and html are not looked at. Empty tables give
empty results; without labels no host is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import ascii_lower
from mercato.llm.quality import RULES as QUALITY
from mercato.llm.quality import verdict
from mercato.session import written

#: Verdict, host and path of each rule. Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Second-level labels under which names are registered in country domains. Fixed values.
SECOND_LEVEL = "ac|co|com|edu|go|gob|gov|govt|gouv|ltd|me|mil|ne|net|nom|or|org|plc|sch"
#: The suffix of numeric addresses; no name has it.
ADDRESS = "[]"
#: A host is blocked if its share of bad pages is above the limit, at so many standard deviations.
LIMIT, DEVIATIONS = 0.5, 1.645

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SUFFIX = rf"(?:^|\.)((?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+)$"
_ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])\z"
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]{1,32};"
_DOMAIN = rf"(?:^|\.)([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def name_of(host: Column) -> Column:
    """The host without user, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::[0-9]*)?\z", "")


def page_outcomes(pages: DataFrame) -> DataFrame:
    """page_id and bad (1 or 0) of each page: whether a quality rule rejects what is left of its html without markup."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), _MARKUP, " ")
    texts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), text.alias("text"))
    return texts.select("page_id", verdict(F.col("text"), list(QUALITY)).isNotNull().cast("int").alias("bad"))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F
    for decision, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = name.when(fits, F.lit(at + start)), verdict.when(fits, F.lit(decision))
    return name.otherwise(F.lit(None).cast("string")), verdict.otherwise(F.lit(None).cast("string"))


def _strength(groups: DataFrame) -> Column:
    """Pseudo-counts of a level's prior from its groups (n, bad, mean of the parent), as an aggregate."""
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.sum((F.col("bad") - F.col("n") * F.col("mean")) ** 2 / F.col("n")) - F.sum(noise)
    # Without a group of two labelled pages nothing tells how much groups differ: null, taken as alike.
    rho = spread / F.nullif(F.sum((F.col("n") - 1) * noise), F.lit(0.0))
    # Between a prior worth 10,000 pages (groups alike) and one worth a hundredth of a page.
    rho = F.greatest(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(0.99)), F.lit(0.0001))
    return (1 / rho - 1).alias("strength")


def reputations(pages: DataFrame) -> DataFrame:
    """name, mean, deviation for each name in ``pages`` (name, outcome: 1 bad, 0 good, null unknown)."""
    address, domain = F.col("name").rlike(_ADDRESS), F.regexp_extract("name", _DOMAIN, 1)
    hosts = pages.groupBy("name").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    hosts = written(
        hosts.select(
            "*",
            F.when(address | (domain == ""), F.col("name")).otherwise(domain).alias("domain"),
            F.when(address, F.lit(ADDRESS)).otherwise(F.regexp_extract("name", _SUFFIX, 1)).alias("suffix"),
        ),
        "hosts",
    )
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    everything = hosts.agg(*counts).first()
    mean = ((everything["bad"] or 0) + 1) / ((everything["n"] or 0) + 2)

    def posterior(groups: DataFrame) -> DataFrame:
        """The groups with their own mean, shrunk toward ``mean`` of the parent. One aggregate row reaches the driver."""
        strength = float(groups.where("n > 0").agg(_strength(groups)).first()[0])
        alpha = F.col("bad") + F.lit(strength) * F.col("mean")
        beta = F.col("n") - F.col("bad") + F.lit(strength) * (1 - F.col("mean"))
        return groups.select("*", alpha.alias("alpha"), beta.alias("beta"))

    own = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")
    suffixes = posterior(hosts.groupBy("suffix").agg(*counts).withColumn("mean", F.lit(mean))).select("suffix", own)
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes, "suffix")
    domains = posterior(written(domains, "domains")).select("domain", "suffix", own)
    known = posterior(written(hosts.join(domains, ["domain", "suffix"]), "hosts-shrunk"))
    total = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return known.select("name", own, deviation.alias("deviation"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's mean and lower bound of the share of bad pages.

    ``pages`` has page_id and url; ``labels`` has page_id and bad (0 or 1).
    """
    host, path = parsed(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("name", name_of(F.col("host")))
    known = labels.where("page_id is not null and bad is not null")
    known = known.groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.max("bad").cast("bigint").alias("outcome"))
    hosts = written(reputations(urls.select("page_id", "name").join(known, "page_id", "left")), "reputations")
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    lower = F.col("mean") - F.lit(deviations) * F.col("deviation")
    own = F.when(lower > limit, "block").otherwise("allow")
    return urls.join(hosts, "name").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(decided, own).alias("verdict"),
        F.col("mean").alias("bad_share"),
        lower.alias("lower_bound"),
    )
