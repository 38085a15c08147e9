"""URL filters: pattern rules indexed by their rarest literal token, DataFrame work only.

A rule is a regular expression over ``host/path`` with the literal tokens that any URL it
fits must hold. It is filed under the one of them that fewest URLs hold; a URL's tokens
fetch the rules filed under them, and only those expressions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: host, path, verdict.
SITE_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Where no site rule fits, a URL with one of these tokens is blocked: token patterns.
TOKEN_PATTERNS = ["casino", "porn", "xxx", "viagra", "torrent", "warez"]
#: What splits a lowered URL into tokens: all but ASCII letters and digits, as in the edges of token rules.
SEPARATORS = r"[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def site_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, regex, verdict, tokens, rank) of host and path rules: the longest wins."""
    import re

    rows = []
    for host, path, verdict in rules:
        whole = path.rsplit("/", 1)[0]  # a last part without its slash may go on
        tokens = [t for t in re.split(SEPARATORS, f"{host} {whole}".translate(str.maketrans(UPPER, LOWER))) if t]
        rows.append((host + path, rf"(?s)^(?:[^/]*\.)?{quoted(host)}{quoted(path)}", verdict, tokens, 1000 + len(host + path)))
    return _rules(spark, rows)


def token_rules(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """Rules of the method itself: they give a verdict but no rule name."""
    edge = "[^a-z0-9]"
    rows = [(None, rf"(?si)(?:^|{edge}){quoted(t)}(?:{edge}|$)", "block", [t], 1) for t in tokens]
    return _rules(spark, rows)


def _rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A rule table made of literals, which no Python worker has to serve."""
    names = ("rule", "regex", "verdict", "tokens", "rank")
    kinds = ("string", "string", "string", "array<string>", "int")

    def cell(value) -> Column:
        return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)

    made = [F.struct(*[cell(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds)]) for row in rows]
    none = F.array().cast("array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(names, kinds)) + ">>")
    return spark.range(1).select(F.inline(F.array(*made) if made else none))


def tokens_of(target: Column) -> Column:
    """Distinct lower-case tokens; the empty one, under which rules without literals are filed."""
    return F.array_union(F.split(F.translate(target, UPPER, LOWER), SEPARATORS, -1), F.array(F.lit("")))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lowered;
    empty for a null URL or one without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for a null URL or one without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row, repeated ones too.

    Of the rules that fit, the one of the highest rank wins, among equals block before
    allow, then the smaller name. A null URL, or one without ``://``, has an empty host
    and path and gets the default. ``rules`` may be a table of any size.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        "page_id",
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    target = F.concat("host", "path")
    # How many URLs hold each token that a rule names; counts combine before the shuffle.
    named = rules.select(F.explode_outer("tokens").alias("token")).where("token IS NOT NULL").distinct()
    held = pages.select(F.explode(tokens_of(F.concat(host_of(F.col(url)), path_of(F.col(url))))).alias("token"))
    counts = named.join(held.groupBy("token").agg(F.count("*").alias("n")), "token", "left").select(
        "token", F.coalesce("n", F.lit(0)).alias("n")
    )
    ranked = rules.withColumn("_rule", F.xxhash64("regex", "rule", "verdict")).withColumn("token", F.explode_outer("tokens"))
    filed = (
        ranked.join(counts, "token", "left")
        .groupBy("_rule")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("least"),
            *[F.first(c).alias(c) for c in ("rule", "regex", "verdict", "rank")],
        )
        .select(F.col("least.token").alias("token"), "rule", "regex", F.col("verdict").alias("said"), "rank")
    )
    # A token may be in a third of the URLs: rules stand once per salt, URLs take one each.
    salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = rows.withColumn("token", F.explode(tokens_of(target))).withColumn(
        "salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
    )
    fetched = asked.join(salted, ["token", "salt"], "left")
    fits = F.when(F.rlike(target, F.col("regex")), F.struct(
        (-F.col("rank")).alias("rank"), F.when(F.col("said") == "block", 0).otherwise(1).alias("mild"), "rule", "said"
    ))
    return (
        fetched.groupBy("_row", "page_id", "host", "path")
        .agg(F.min(fits).alias("won"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("won.rule").alias("rule"),
            F.coalesce("won.said", F.lit(default)).alias("verdict"),
        )
    )
