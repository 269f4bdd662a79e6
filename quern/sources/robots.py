"""robots.txt of many hosts as a table of rules, and a predicate over URLs; columns and joins alone.

Groups and rules are read as the standard library's parser reads them: a group begins with a user-agent line, an empty line
ends it, the first group that names the agent counts, else the first one for all; of its rules the first that the
path starts with decides, and without one a URL is allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.text import _c, blank, strip
from quern.operators.frames import checkpointed, small

RULES = "host string, pos long, allow boolean, pattern string"


def body_of(fetch: Callable[[], tuple[int, str]] | None) -> str | None:
    """One host's robots.txt, or None if it can't be had (an error, or a status from 400): then all is allowed."""
    if fetch is None:
        return None
    try:
        status, body = fetch()
    except Exception:
        return None
    return None if status >= 400 else body


def quoted(c: Column | str) -> Column:
    """Percent signs read and written anew, so that two ways to write a path are one; what can't be read stays as it is."""
    c = _c(c)
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    out = F.url_encode(plain)
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def rules_of(bodies: DataFrame, agent: str = "*") -> DataFrame:
    """(host, pos, allow, pattern) of bodies (host, body): the rules that hold for an agent, by host in order of pos.

    A host has one row; a null body has no rules. Lines of one host meet in one task, as a robots.txt is a small file.
    """
    name = agent.split("/")[0].lower()
    lines = bodies.select("host", F.posexplode(F.split(blank("body"), "\r\n|[\n\r]")).alias("at", "line"))
    line = strip(F.regexp_replace("line", "#.*", ""))
    key = F.lower(strip(F.regexp_extract(line, r"\A([^:]*):", 1)))
    kind = F.when(F.col("line") == "", "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), "rule").when(key.isin("crawl-delay", "request-rate"), "other_rule")
    rows = lines.select("host", "at", kind.alias("kind"), (key == "allow").alias("allow"), strip(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)).alias("value")).filter("kind IS NOT NULL")
    of_host = Window.partitionBy("host").orderBy("at")
    before = of_host.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts", (F.col("kind") == "agent") & F.coalesce(F.lag("kind").over(of_host) != "agent", F.lit(True)))
    last = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("at"))).over(before), F.lit(-1))
    rows = rows.withColumn("group", F.sum(F.col("starts").cast("int")).over(before)).withColumn("live", last("agent") > last("blank"))
    rows = checkpointed(rows.filter("live"))
    value = F.lower(F.when(F.col("kind") == "agent", F.col("value")))
    whole = rows.groupBy("host", "group").agg(F.max((F.col("kind") != "agent").cast("int")).alias("any_rule"), F.max((value == "*").cast("int")).alias("for_all"), F.max(F.contains(F.lit(name), value).cast("int")).alias("named"))
    whole = whole.filter("any_rule = 1 AND (for_all = 1 OR named = 1)").withColumn("order", F.struct("for_all", "group"))
    chosen = whole.groupBy("host").agg(F.min("order").alias("o")).select("host", F.col("o.group").alias("group"))
    rows = rows.filter("kind = 'rule'").join(small(checkpointed(chosen)), ["host", "group"])
    # An empty Disallow allows all.
    return rows.select("host", F.col("at").cast("long").alias("pos"), (F.col("allow") | (F.col("value") == "")).alias("allow"), quoted("value").alias("pattern"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", name: str = "allowed") -> DataFrame:
    """pages with `name`: whether the rules of a URL's host allow it; hosts without rules allow all."""
    own = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "allow", "pattern"))).alias("__rules"))
    rest = F.regexp_extract(blank(url), r"(?s)\A[^:]*://[^/?#]*(.*)\z", 1)
    rows = pages.withColumn("__host", urls.host(url)).withColumn("__path", F.when(rest == "", "/").otherwise(quoted(rest)))
    rows = rows.join(small(checkpointed(own.withColumnRenamed("host", "__host"))), "__host", "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["pattern"]))
    return rows.withColumn(name, F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True))).drop("__host", "__path", "__rules")
