"""URL filters by a sort-merge range join, in DataFrame operations only (operator 7).

A rule is a host and a path prefix. With its labels reversed and a dot after each, a host's key is a prefix of the keys
of all its subdomains: the rule covers the interval of keys from its own up to the end of what begins with it.
Intervals of prefixes are nested or apart. So in one sorted pass over rule beginnings, rule ends and URL
keys the active rules are a stack: after a beginning the top is that rule, after an end it is the rule around it. The
top at each URL is the last such event before it.

Paths are prefixes too, and a rule asks for both. The rules of one path are a *lane*: a first sweep over paths finds
the innermost rule path of each URL, whose enclosing rule paths are known from the rules; a second sweep over lane and
host key finds the innermost host in each of these lanes; the longest rule wins (of equally long ones the last in
order).

The sorted pass is spread over range partitions. A partition takes over the top that the rule events of the partitions
before it leave; these are one row a partition. Many URLs with one key are dealt by further sort columns, and each
different host and path is judged once.

Cases: null URLs and URLs without ``://`` have an empty host and path, and no rule; a null page id is carried along;
repeated rows repeat in the result; the same rule twice with two verdicts blocks; no rules: every verdict is the
default; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_RULE = ""
#: Before each path, so that the empty path has a key; between a lane's path and the host; after everything.
PATH_MARK, HOST_MARK, HIGHEST = "\x02", "\x01", "\U0010ffff"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for a null or a URL without ://."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(there > 0, F.substr(url, there + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot after it."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _after(prefix: Column) -> Column:
    """A string after all strings with a prefix and before all others that follow it."""
    return F.concat(prefix, F.lit(HIGHEST))


def _around(nodes: DataFrame, prefixes: Column) -> DataFrame:
    """(key, inside, parent): for each key of nodes all keys that are among its prefixes, itself too, and the longest
    other one. prefixes: array of a key's proper prefixes that could be keys."""
    keys = nodes.select("key").distinct()
    tried = keys.select("key", F.explode(prefixes).alias("prefix"))
    known = tried.join(keys.select(F.col("key").alias("prefix")), "prefix").groupBy("key")
    known = known.agg(F.collect_list("prefix").alias("outer"), F.max_by("prefix", F.length("prefix")).alias("parent"))
    return keys.join(known, "key", "left").select("key", F.concat(F.coalesce("outer", F.array().cast("array<string>")), F.array("key")).alias("inside"), F.coalesce("parent", F.lit(NO_RULE)).alias("parent"))


def sweep(points: DataFrame, nodes: DataFrame, order_by: list[str]) -> DataFrame:
    """points with ``top``: the innermost of the prefix intervals of nodes (key, parent) that holds their key.

    order_by: further columns by which points with one key are dealt out.
    """
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c != "key"]
    starts = nodes.select("key", *nothing, F.lit(1).alias("kind"), F.length("key").alias("rank"), F.col("key").alias("now"))
    ends = nodes.select(_after(F.col("key")).alias("key"), *nothing, F.lit(0).alias("kind"), (-F.length("key")).alias("rank"), F.col("parent").alias("now"))
    at = points.select("key", *[c for c in points.columns if c != "key"], F.lit(2).alias("kind"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("now"))
    order = ["key", "kind", "rank", *order_by]
    events = at.unionByName(starts).unionByName(ends).repartitionByRange(*order)
    events = written(events.withColumn("part", F.spark_partition_id()), "sweep")
    last = events.filter("kind < 2").groupBy("part").agg(F.max_by("now", F.struct("key", "kind", "rank")).alias("leaves"))
    parts = events.select("part").distinct().join(last, "part", "left")  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    taken = parts.select("part", F.last("leaves", ignorenulls=True).over(before).alias("taken"))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("now", F.last("now", ignorenulls=True).over(so_far)).filter("kind = 2")
    return swept.join(taken, "part").select(*points.columns, F.coalesce("now", "taken", F.lit(NO_RULE)).alias("top"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of each row of urls; rules: (host, path, verdict)."""
    host, path = split_url(F.col(url_col))
    pages = urls.select(id_col, host.alias("host"), path.alias("path"))
    pairs = pages.select("host", "path").distinct()
    own = rules.filter("host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    path_key = F.concat(F.lit(PATH_MARK), "path")
    # First sweep: lanes, which are the rule paths that a path begins with.
    lane_prefixes = F.when(F.length("key") < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1))), lambda n: F.substr("key", F.lit(1), n)))
    lanes = written(_around(own.select(path_key.alias("key")), lane_prefixes), "lanes")
    found = sweep(pairs.select(path_key.alias("key"), "host", "path"), lanes.select("key", "parent"), ["host"])
    lanes = lanes.select(F.col("key").alias("top"), F.explode("inside").alias("lane"))
    in_lanes = found.join(lanes, "top").select(F.concat("lane", F.lit(HOST_MARK), host_key(F.col("host"))).alias("key"), "host", "path")
    # Second sweep: hosts within each lane.
    nodes = own.select(F.concat(path_key, F.lit(HOST_MARK), host_key(F.col("host"))).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    labels = F.split(F.substring_index("key", HOST_MARK, -1), r"\.")
    shorter = F.when(F.size(labels) < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda n: F.concat(F.substring_index("key", HOST_MARK, 1), F.lit(HOST_MARK), F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    )
    hosts = written(_around(nodes, shorter), "hosts")
    held = sweep(in_lanes, hosts.select("key", "parent"), ["host", "path"]).filter(F.col("top") != NO_RULE)
    held = held.join(nodes.select(F.col("key").alias("top"), "rule", "verdict"), "top")
    best = held.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
