"""URL block and allow rules found through their rarest literal token, in DataFrame operations only.

A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's. Each rule is filed under one
token that every fitting URL must hold whole: of its candidates, the one that the fewest URLs hold. The tokens of a URL
fetch rules from that index by an equi-join, and only fetched rules are tried as regular expressions. The longest fitting
rule decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules (a few MB) the index is broadcast; beyond that it is joined by shuffle.
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _literals(host: str, path: str) -> list[str]:
    """The tokens of a rule that a fitting URL must hold whole: the path's last one only if something ends it."""
    return [f"h{x}" for x in re.findall("[A-Za-z0-9]+", host)] + [f"p{x}" for x in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]


def parse_rule(text: str) -> tuple[str, str]:
    """Host and path of a rule as written, ``example.com/en/7`` or ``example.com``."""
    host, slash, path = text.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; rules are (verdict, ``host/path``).

    A null URL, or one without ``://``, has an empty host and path and gets ``default``, like any that no rule fits (its
    rule is null). Of several fitting rules the longest decides, of equally long ones the first given. Repeated rows
    and ids keep a row each; very long URLs are taken whole; other columns are ignored; no rules or no rows are fine."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.concat(
        F.array(F.lit("")),  # rules without a literal are filed under the empty token, which every URL has
        F.transform(F.regexp_extract_all("host", F.lit("[A-Za-z0-9]+"), 0), lambda x: F.concat(F.lit("h"), x)),
        F.transform(F.regexp_extract_all("path", F.lit("[A-Za-z0-9]+"), 0), lambda x: F.concat(F.lit("p"), x)),
    ))
    tokens = urls.withColumn("token", F.explode(tokens))

    parsed = [(n, verdict, text, *parse_rule(text)) for n, (verdict, text) in enumerate(rules)]
    book = spark.createDataFrame(
        [
            (n, verdict, text, f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}" if path else f"^(?:[^/]*\\.)?{_quoted(host)}(?:/|\\z)", (len(text) << 32) - n, _literals(host, path) or [""])
            for n, verdict, text, host, path in parsed
        ],
        "n int, rule_verdict string, rule string, pattern string, rank long, tokens array<string>",
    )
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    options = book.select("n", F.explode("tokens").alias("token"))
    wanted = small(options.select("token").distinct())
    counts = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    options = options.join(counts, "token", "left").fillna(0, ["urls"])
    index = options.groupBy("n").agg(F.min(F.struct("urls", "token")).alias("best")).select("n", "best.token").join(book.drop("tokens"), "n")

    fetched = tokens.join(small(index.select("token", "pattern", "rank")), "token", "left")
    fits = F.when(F.expr("concat(host, path) rlike pattern"), F.col("rank"))
    judged = fetched.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("rank"))
    return judged.join(small(book.select("rank", "rule", "rule_verdict")), "rank", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )


def _quoted(text: str) -> str:
    """A literal for Java's regular expressions."""
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)
