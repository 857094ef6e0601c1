"""URL filter: rules first, then Empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain
and public suffix.  Each level's rate of bad pages is shrunk towards its
parent's by a beta-binomial prior, whose strength (concentration) is fitted
from the spread of the observed rates: whole corpus -> suffix -> domain ->
host.  A host is blocked when the lower bound of its posterior bad rate lies
above ``max_bad``; a host without outcomes keeps its domain's prior, whose wide
posterior does not block.

Everything is DataFrame expressions.  Outcomes are pre-aggregated per host, so
a host with a third of all pages is one row after the map side; only the three
fitted concentrations (one number a level) reach the driver.  The reputation
table is written before the last join, so both join sides are plain exchanges
and adaptive execution can split a hot host.

Edge cases: a null url or one without ``://`` has an empty host and path; it
belongs to no rule and to the empty host's reputation.  Null outcomes are
ignored; repeated rows count as often as they occur; very long pages are read whole; an empty table gives an
empty result; a page keeps every row it has; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import lower_ascii, shared_table, without_spaces, word_count


@dataclass(frozen=True)
class UrlRule:
    """``allow`` or ``block`` a host, its subdomains and a path prefix."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(found)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct(rule, verdict) of the longest fitting rule; null fields if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


# Public suffixes of two labels that hold many owners' domains; every other suffix is the last label.  A parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.nz", "co.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "co.za")


def public_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that ends the host, else its last label."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix and the label before it (the whole host if it has no more)."""
    suffix = public_suffix(host, suffixes)
    labels = F.size(F.split(suffix, r"\."))
    return F.array_join(F.slice(F.split(host, r"\."), -F.least(labels + 1, F.size(F.split(host, r"\."))), labels + 1), ".")


def page_outcomes(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_words: int = 50,
                  max_shouting: float = 0.1, max_symbols: float = 0.05) -> DataFrame:
    """Label pages from their own markup: (host, bad), for corpora whose pages nobody has labelled.

    ``bad`` is 1 when the visible text has fewer than ``min_words`` words, ends more than ``max_shouting`` of its words in
    ``!!``, or is made of more than ``max_symbols`` symbols (``#*$%&|``, character entities counted as one each).
    Null html gives a null outcome, which the reputation ignores.
    """
    html = F.col(html_col)
    visible = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    seen = pages.select(url_host(F.col(url_col)).alias("host"), F.regexp_replace(visible, r"&#?[0-9A-Za-z]{1,10};", "&").alias("seen"))
    text = F.col("seen")
    n, tight = word_count(text), F.char_length(without_spaces(text))
    symbols = tight - F.char_length(F.translate(without_spaces(text), "#*$%&|", ""))
    shouts = F.regexp_count(text, F.lit("!!"))
    bad = (n < min_words) | (shouts > max_shouting * n) | (symbols > max_symbols * tight)
    return seen.select("host", F.when(text.isNotNull(), bad.cast("int")).alias("bad"))


def _concentration(groups: DataFrame, rate: str) -> float:
    """Beta-binomial concentration of child groups around their parents' rates.

    Method of moments: the squared, binomially scaled deviations of n trials
    have the mean 1 + (n - 1) * rho, with rho = 1 / (m + 1).
    """
    mean = F.least(F.greatest(F.col(rate), F.lit(1e-6)), F.lit(1 - 1e-6))
    scaled = F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2) / (mean * (1 - mean))
    row = groups.filter("n > 0").agg(F.sum(scaled).alias("d"), F.count(F.lit(1)).alias("g"),
                                     F.sum(F.col("n") - 1).alias("t")).first()
    if not row["t"]:
        return 1.0
    rho = min(max((row["d"] - row["g"]) / row["t"], 1e-4), 0.5)
    return 1.0 / rho - 1.0


def _shrunk(groups: DataFrame, prior: str, m: float, name: str) -> DataFrame:
    return groups.withColumn(name, (F.col("k") + m * F.col(prior)) / (F.col("n") + m))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, max_bad: float = 0.25, z: float = 2.0,
                    suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior bad rate of each host: (host, n, k, bad_rate, bad_low, verdict).

    ``outcomes`` has (host, bad 0/1/null); ``hosts`` lists the hosts to judge
    in a column ``host``.  ``bad_low`` is the posterior mean less ``z``
    posterior standard deviations.
    """
    counted = (hosts.select("host", F.lit(None).cast("int").alias("bad"))
               .unionByName(outcomes.select("host", F.col("bad").cast("int")))
               .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    counted = counted.withColumns({"domain": registered_domain(F.col("host"), suffixes),
                                   "suffix": public_suffix(F.col("host"), suffixes)})
    counted = shared_table(counted, "host-counts")

    total = counted.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = (domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
                .withColumn("overall", F.lit(overall)))
    m0 = _concentration(suffixes, "overall")
    suffixes = _shrunk(suffixes, "overall", m0, "suffix_rate").select("suffix", "suffix_rate")
    domains = domains.join(suffixes, "suffix")
    m1 = _concentration(domains, "suffix_rate")
    domains = shared_table(_shrunk(domains, "suffix_rate", m1, "domain_rate").select("domain", "domain_rate"),
                           "domain-rates")
    judged = counted.join(domains, "domain")
    m2 = _concentration(judged, "domain_rate")

    a = F.col("k") + m2 * F.col("domain_rate")
    b = F.col("n") - F.col("k") + m2 * (1 - F.col("domain_rate"))
    judged = judged.select("host", "n", "k", a.alias("a"), b.alias("b"))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(rate * (1 - rate) / (F.col("a") + F.col("b") + 1))
    judged = judged.select("host", "n", "k", rate.alias("bad_rate"), (rate - z * spread).alias("bad_low"))
    return shared_table(judged.withColumn("verdict", F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")),
                        "host-reputation")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = (), id_col: str = "page_id",
               url_col: str = "url", max_bad: float = 0.25, z: float = 2.0,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, bad_rate, bad_low.

    The longest fitting rule decides; without one, the host's reputation does.
    """
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    reputation = host_reputation(outcomes, urls.select("host"), max_bad, z, suffixes)
    ruled = urls.withColumn("matched", match_rule(F.col("host"), F.col("path"), rules))
    joined = ruled.join(reputation.withColumnRenamed("verdict", "host_verdict"), "host", "left")
    return joined.select(F.col(id_col), "host", "path", F.col("matched.rule").alias("rule"),
                         F.coalesce("matched.verdict", "host_verdict").alias("verdict"), "bad_rate", "bad_low")
