"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host; DataFrame operations only.

Labelled outcomes of pages are counted per host.  A host's rate of bad pages is
shrunk towards its registered domain's, that towards its suffix's, that towards
the overall rate; how strongly each level holds its children is fitted from the
beta-binomial excess variance over all of them.  A page without a rule is
blocked if the lower bound of its host's posterior bad rate passes a limit.

A null URL, or one without ``://``, has an empty host and path and is judged by
the overall rate.  Pages or labels repeat: each row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label of a host, or its last two where they are a known long suffix; ports and user names are left out."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def match_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _strength(level: DataFrame) -> float:
    """Pseudo-count of the prior, from how far the children (n, bad, prior mean m) spread beyond binomial chance."""
    v = F.col("m") * (1 - F.col("m"))
    row = level.agg(F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2), F.sum(F.col("n") * v),
                    F.sum(F.col("n") * (F.col("n") - 1) * v)).first()
    square, chance, room = (float(x or 0) for x in row)
    rho = (square - chance) / room if room > 0 else 0.0
    return 1 / min(0.5, max(0.0005, rho)) - 1


def _shrunk(level: DataFrame, s: float) -> DataFrame:
    return level.withColumn("mean", (F.col("bad") + s * F.col("m")) / (F.col("n") + s)).withColumn("weight", F.col("n") + s)


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad) of every host, n >= 0 -> host, n, bad and the posterior's lower bound ``low``.

    Only counts per host, domain and suffix are joined; the driver sees four sums per level.
    """
    table = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    n, bad = (float(x or 0) for x in table.agg(F.sum("n"), F.sum("bad")).first())
    top = (bad + 1) / (n + 20)  # one bad page in twenty, until labels say otherwise
    suffixes = table.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit(top))
    suffixes = staged(_shrunk(suffixes, _strength(suffixes)), "hosts-suffix").select("suffix", F.col("mean").alias("m"))
    domains = table.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = staged(_shrunk(domains, _strength(domains)), "hosts-domain").select("domain", F.col("mean").alias("m"))
    leaves = table.join(domains, "domain")
    leaves = _shrunk(leaves, _strength(leaves))
    return leaves.select("host", "n", "bad", (
        F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.2, z: float = 1.645,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict per page.

    ``outcomes`` (id, bad) labels some pages, ``bad`` 0 or 1 (null: no label).
    Returns page_id, host, path, rule, verdict, host_labelled, host_bad.
    """
    url = F.col(f"`{url_col}`").cast("string")
    seen = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = outcomes.where("bad IS NOT NULL").select(F.col("id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad"))
    # labels fold to one row per page first, so that a repeated label multiplies nothing
    marks = marks.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = (seen.select("page_id", "host").join(marks, "page_id", "left").groupBy("host")
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    known = staged(reputation(staged(counts, "hosts-counts"), z), "hosts-reputation")
    rule, verdict = match_rule(rules, F.col("host"), F.col("path"))
    found = seen.join(known, "host", "left")
    return found.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"),
                        F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"))
