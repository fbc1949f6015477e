"""Which URLs a host's robots rules allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accountlake.functions.text import col, let
from accountlake.functions.urls import url_host
from accountlake.operators.keys import lookup_join, one_per_key

_PATH_QUERY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def rule_groups(body: Column | str) -> Column:
    """``array<struct<agents,rules<allow,path>>>`` of a robots text.

    Lines are reduced to U/A/D/C marks (user-agent, allow, disallow, other rule that
    closes the agent list) and B (blank). Groups end at a blank line, or where an
    agent line follows a rule; a group needs both agents and rules.
    """
    def mark(line: Column) -> Column:
        bare = F.btrim(F.regexp_replace(line, "#.*$", ""))
        key = F.lower(F.btrim(F.substring_index(bare, ":", 1)))
        value = F.btrim(F.regexp_replace(bare, "^[^:]*:", ""))
        return (
            F.when(line == "", F.lit("B"))
            .when(~bare.contains(":"), F.lit(""))
            .when(key == "user-agent", F.concat(F.lit("U"), F.lower(value)))
            .when(key == "allow", F.concat(F.lit("A"), value))
            .when(key == "disallow", F.concat(F.when(value == "", "A").otherwise("D"), value))
            .when(key.isin("crawl-delay", "request-rate"), F.lit("C"))
            .otherwise(F.lit(""))
        )

    marks = F.filter(F.transform(F.split(col(body), r"\r\n|\r|\n", -1), mark), lambda m: m != "")
    text = F.regexp_replace(F.array_join(marks, "\n"), r"(?m)^([ADC].*)\n(?=U)", "$1\nB\n")
    blocks = F.transform(F.split(text, r"(?m)^B$"), lambda b: F.filter(F.split(b, "\n"), lambda m: m != ""))

    def group(lines: Column) -> Column:
        def starting(kinds: str) -> Column:
            return F.filter(lines, lambda m: F.left(m, F.lit(1)).isin(*kinds))

        def value(m: Column) -> Column:
            return F.substring(m, 2, F.length(m))

        return F.struct(
            F.transform(starting("U"), value).alias("agents"),
            F.transform(
                starting("AD"),
                lambda m: F.struct(m.startswith("A").alias("allow"), value(m).alias("path")),
            ).alias("rules"),
            (F.size(starting("ADC")) > 0).alias("closed"),
            F.get(lines, F.lit(0)).startswith("U").alias("opened"),
        )

    return F.filter(F.transform(blocks, group), lambda g: g["closed"] & g["opened"])


def rules_for(body: Column | str, agent: str) -> Column:
    """Rules of the first group naming the agent, else of the first ``*`` group; null without one."""
    name = agent.split("/")[0].lower()

    def pick(groups: Column) -> Column:
        named = F.filter(
            groups,
            lambda g: ~F.array_contains(g["agents"], "*")
            & F.exists(g["agents"], lambda a: F.lit(name).contains(a)),
        )
        star = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
        return F.coalesce(F.get(named, F.lit(0))["rules"], F.get(star, F.lit(0))["rules"])

    return let(rule_groups(body), pick)


def unescaped(path: Column) -> Column:
    """A path with its percent escapes read, so that ``/a%20b``, ``/a b`` and ``/%61 b`` are one path."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def allowed(rules: Column, url: Column | str) -> Column:
    """First rule whose path starts the URL's path decides; no such rule allows. Escapes are read on both sides."""
    target = F.regexp_extract(col(url), _PATH_QUERY, 1)
    return let(
        unescaped(F.when(target == "", "/").otherwise(target)),
        lambda t: F.coalesce(
            F.get(
                F.filter(rules, lambda r: (r["path"] == "*") | t.startswith(unescaped(r["path"]))), F.lit(0)
            )["allow"],
            F.lit(True),
        ),
    )


def robots_gate(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url", **join) -> DataFrame:
    """Add ``allowed``. ``robots`` has ``host, status, body``; of several good answers of a host the smallest counts.

    Rules travel as one array per host, so a URL meets its host's rules once instead
    of once per rule. A missing file, or one answered with an error, allows all.
    """
    good = one_per_key(robots.where("status < 400").select("host", "status", "body"), ["host"], ["status", "body"])
    rules = good.select("host", rules_for("body", agent).alias("_rules"))
    joined = lookup_join(urls.withColumn("host", url_host(url)), rules, ["host"], **join)
    return joined.withColumn("allowed", allowed(F.col("_rules"), url)).drop("_rules").select(
        *urls.columns, "allowed"
    )
