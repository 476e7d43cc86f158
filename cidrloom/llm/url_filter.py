"""Operator 10: URL rules by a sort-merge range join on reversed-host keys.

A host is written backwards label by label (``www.example.com`` becomes
``com.example.www.``). A rule for a host and all its subdomains is then the
interval of keys that start with the rule's key, and such intervals nest or
are disjoint. The ends of all intervals, sorted, cut the key space into
segments; sweeping over them keeps a stack of the rules that are active, and
that stack is written at every cut. The URLs are merged into the same sort
order, and each takes the stack of the last cut before it; of its rules, those
whose path starts the URL's path fit, and the longest wins.

Scale: rules are an argument of the call, so the cuts (two a rule) are bounded
by it, and they are repeated in each of ``splits`` groups of URLs made by hash
of the whole row. Groups are even whatever the hosts are: a host that holds a
third of all rows is spread over all of them. One shuffle of (id, host, path).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; ASCII lower case; null or none: empty."""
    rest = F.substring_index(url, "://", 1)
    rest = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(
        F.when(url.contains("://"), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)), F.lit("")
    )


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; null or no ``://``: empty."""
    rest = F.substring_index(url, "://", 1)
    rest = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; a host without name: empty."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def _cuts(rules: Sequence[tuple[str, str]]) -> list[dict]:
    """Sorted interval ends with the stack of rules that hold from there on."""
    spans: dict[str, list[dict]] = {}
    for text, verdict in rules:
        host, slash, path = text.partition("/")
        host = host.translate(str.maketrans(_UPPER, _LOWER))
        key = ".".join(reversed(host.split("."))) + "." if host else ""
        spans.setdefault(key, []).append({"rule": text, "path": slash + path, "verdict": verdict})
    out, stack = [], []

    def leave(upto: str | None) -> None:
        while stack and (upto is None or not upto.startswith(stack[-1])):
            gone = stack.pop()
            if gone:  # the empty key covers everything and never ends
                out.append((gone[:-1] + "/", None))

    for key in sorted(spans, key=lambda k: k.encode()):
        leave(key)
        stack.append(key)
        out.append((key, key))
    leave(None)
    # A cut's stack: rules of every key that starts it. Ends take what remains around them.
    cuts, active = [], []
    for at, opened in out:
        if opened is None:
            active.pop()
        else:
            active.append(opened)
        cuts.append({"k": at, "stack": [r for key in active for r in spans[key]]})
    last = {c["k"]: c for c in cuts}  # of several cuts at one place the last holds
    return list(last.values())


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    splits: int | None = None,
) -> DataFrame:
    """Judge every row's URL: id, host, path, rule (null: none fits) and verdict.

    ``rules`` are (``host/path``, verdict) pairs. A rule fits its host and all
    subdomains if the URL's path starts with the rule's path; an empty host
    fits every host. The longest rule text wins; between equal texts the
    greater verdict. A null URL or one without ``://`` has an empty host and
    path. Repeated rows are judged each for itself, an empty table gives no
    rows, and columns other than the two named are not looked at.
    """
    spark = pages.sparkSession
    splits = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = "struct<rule:string,path:string,verdict:string>"
    text = json.dumps(_cuts(rules))
    cuts = (
        spark.range(1)
        .select(F.inline(F.from_json(F.lit(text), f"array<struct<k:string,stack:array<{entry}>>>")))
        .select(F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), "k", "stack")
    )
    url = F.col("url")
    urls = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .select("id", host_of(url).alias("host"), path_of(url).alias("path"))
        .select(
            F.pmod(F.xxhash64("id", "host", "path"), F.lit(splits)).cast("int").alias("part"),
            host_key(F.col("host")).alias("k"),
            "id",
            "host",
            "path",
        )
    )
    merged = urls.withColumn("stack", F.lit(None).cast(f"array<{entry}>")).withColumn("point", F.lit(1)).unionByName(
        cuts.withColumn("point", F.lit(0)), allowMissingColumns=True
    )
    sweep = Window.partitionBy("part").orderBy("k", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (
        merged.withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .filter("point = 1")
        .select(F.col("id").alias(id_col), "host", "path", best.alias("best"))
        .select(
            id_col,
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )


#: The rules of the registered query.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

ORACLE = """
WITH rules(host, rpath, rule, verdict) AS (VALUES
  ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'),
  ('net', '/de/', 'net/de/', 'allow'), ('example.net', '/de/8', 'example.net/de/8', 'block'),
  ('org', '/es/', 'org/es/', 'block')),
u AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT r.rule FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host))
     AND starts_with(u.path, r.rpath) ORDER BY length(r.rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host))
     AND starts_with(u.path, r.rpath) ORDER BY length(r.rule) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
