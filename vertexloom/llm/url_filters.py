"""URL filters: pattern rules that are found by their rarest literal token.

Each rule is indexed under the one of its literal tokens that the fewest URLs hold. A URL's tokens fetch the
candidate rules, and only those run their regular expressions. A rule without a literal token stands under the
empty token, which every URL has.

Two kinds of rule:

* ``host/path``: fits the host and its subdomains if the URL's path starts with the rule's;
* ``*glob*``: any string with ``*`` in it, matched against ``host`` + ``path`` whatever the case of A-Z.

Where several fit, the longest rule wins, host/path rules before globs, then the smaller string.

Defined results: a null URL, or one without ``://``, has an empty host and path; globs alone can fit it. Repeated
rows are judged each. An empty table gives an empty result. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER

#: Rules up to this many become one literal map, so that judging is row-local; more are joined by token.
MAX_INLINE = 500

#: The rules that op1 is asked for, and beside them globs for advertising and link-farm hosts.
HOST_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
GLOBS = [("*ads-track.*", "block"), ("*spam-farm.*", "block")]


@dataclass(frozen=True)
class Rule:
    rule: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def compile_rule(rule: str, action: str) -> Rule:
    """Its expression over host + path, and the literal tokens that every URL it fits must hold whole."""
    if "*" in rule:
        regex = "^" + ".*".join(_quoted(p) for p in rule.lower().split("*")) + "$"
        # A token is whole if the rule itself has a separator on either side of it.
        tokens = [m[0] for p in rule.lower().split("*") for m in re.finditer(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", p)]
        return Rule(rule, action, f"(?is){regex}", tuple(dict.fromkeys(tokens)), len(rule))
    host, slash, path = rule.partition("/")
    host = host.translate(str.maketrans(UPPER, UPPER.lower()))
    regex = r"^(?:[^/]*\.)?" + _quoted(host) + (_quoted(slash + path) if slash else "(?:/|$)")
    tokens = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.translate(str.maketrans(UPPER, UPPER.lower())))
    return Rule(rule, action, regex, tuple(dict.fromkeys(tokens)), 1_000_000 + len(rule))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def url_tokens(target: Column) -> Column:
    """Its distinct tokens, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(target, UPPER, UPPER.lower()), "[^a-z0-9]+")))


def _index(df: DataFrame, target: str, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; what comes to the driver is a count for each token of the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    if len(known) > 1:
        found = df.select(F.explode(url_tokens(F.col(target))).alias("t")).where(F.col("t").isin(known)).groupBy("t").count()
        seen = {r["t"]: r["count"] for r in found.collect()}
    else:
        seen = {}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=""), []).append(r)
    return index


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow", max_inline: int = MAX_INLINE) -> DataFrame:
    """df with host, path, rule (null: none fits) and verdict.

    Up to max_inline rules are one literal map: no shuffle. Beyond it the distinct host + path strings are joined to
    the rules by token, and the winners back to the rows."""
    spark, made = df.sparkSession, [compile_rule(*r) for r in dict(rules).items()]
    host, path = host_and_path(F.col(url))
    df = df.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    target = F.concat(F.col("host"), F.col("path"))
    if not made:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    index = _index(df.select(target.alias("_target")), "_target", made)
    if len(made) <= max_inline:
        row = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))
        lookup = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(row, rs)))])
        fetched = F.filter(F.transform(url_tokens(target), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull())
        fits = F.filter(F.flatten(fetched), lambda x: F.rlike(F.concat(F.col("host"), F.col("path")), x["regex"]))
        best = F.reduce(fits, F.lit(None).cast("struct<rank:int,rule:string,action:string,regex:string>"), lambda a, x: F.when(a.isNull() | (x["rank"] > a["rank"]) | ((x["rank"] == a["rank"]) & (x["rule"] < a["rule"])), x).otherwise(a))
        df = df.withColumn("_best", best)
        return df.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce(F.col("_best.action"), F.lit(default))).drop("_best")
    by_token = _rules_table(spark, index)
    urls = df.select(target.alias("_target")).distinct()
    hits = urls.select("_target", F.explode(url_tokens(F.col("_target"))).alias("_token")).join(by_token, "_token").where("rlike(_target, _regex)")
    best = hits.groupBy("_target").agg(F.min(F.struct(-F.col("_rank"), F.col("_rule"), F.col("_action"))).alias("_best"))
    df = df.withColumn("_target", target).join(best, "_target", "left").drop("_target")
    return df.withColumn("rule", F.col("_best._rule")).withColumn("verdict", F.coalesce(F.col("_best._action"), F.lit(default))).drop("_best")


def _rules_table(spark: SparkSession, index: dict[str, list[Rule]]) -> DataFrame:
    rows = [(t, r.rank, r.rule, r.action, r.regex) for t, rs in index.items() for r in rs]
    return spark.createDataFrame(rows, "_token string, _rank int, _rule string, _action string, _regex string")
