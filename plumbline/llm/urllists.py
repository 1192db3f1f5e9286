"""URL filters with dated lists: a temporal list join.

A list is a history of dated entries that add or remove a key: a domain (with its subdomains), a host, or a path prefix
of a host. Histories become validity intervals [from, to). Every capture is asked for all its keys at its fetch time,
so a list applies as it stood then. The as-of join is an equi-join on key and period (a fixed span of days that cuts
long intervals), with the instant compared inside; a list of at most ``broadcast_rows`` interval rows is broadcast, a
longer one is shuffled.

Block entries reject a capture unless an allow entry of a key at least as specific (prefix over host over domain, then
the longer key) is active too.

Defined results: null or unparsable URLs have no keys and pass; a null fetch time passes; entries with a null key, time
or list are ignored; of entries of one key and list at one instant a removal wins; repeated entries count once;
repeated captures are each answered; a URL of any length takes time by its length and the depths of entries; empty lists pass everything; extra columns of the captures pass through, output
columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a period of the equi-join.
PERIOD = 64
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, depths: Column) -> Column:
    """All (kind, value) keys that an entry may name to match a URL; of path prefixes those of ``depths``, the numbers of steps
    that entries have, so that a path of many steps is not written out once for each."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domains = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: key("domain", F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    reached = F.filter(depths, lambda k: k <= F.size(steps))
    prefixes = F.transform(reached, lambda k: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/"))))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    found = F.concat(F.array(key("host", host)), F.coalesce(domains, empty), F.coalesce(prefixes, empty))
    return F.when(F.coalesce(host, F.lit("")) == "", empty).otherwise(found)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, valid_from, valid_to) of a history (list, kind, value, action, at); an open end is null."""
    clean = entries.select("list", "kind", "value", "action", F.col("at").cast("timestamp").alias("at")).dropna().distinct()
    merged = clean.groupBy("list", "kind", "value", "at").agg(F.max("action").alias("action"))  # "remove" > "add"
    after = F.lead("at").over(Window.partitionBy("list", "kind", "value").orderBy("at"))
    return merged.withColumn("valid_to", after).where(F.col("action") == "add").select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def period_of(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (86_400 * PERIOD))


def active_entries(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(url, fetched_at, list, kind, value) of every entry that was active when a capture was fetched, once per distinct
    capture."""
    distinct = captures.select(F.col(url).alias("url"), F.col(fetched_at).cast("timestamp").alias("fetched_at")).where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct()
    steps = F.size(F.split("value", "/")) - 1
    depths = entries.where("kind = 'prefix'").select(steps.alias("k")).where("k > 0").agg(F.array_sort(F.collect_set("k")).alias("depths"))  # one row
    asked = distinct.crossJoin(F.broadcast(depths)).select("url", "fetched_at", F.explode(keys_of(F.col("url"), F.col("depths"))).alias("key")).select("url", "fetched_at", "key.kind", "key.value", period_of(F.col("fetched_at")).alias("period"))
    last = F.timestamp_micros(F.lit(distinct.agg(F.unix_micros(F.max("fetched_at"))).first()[0]).cast("long"))  # one value; null without captures
    valid = intervals(entries).where(F.col("valid_from") <= last)
    until = F.least(F.coalesce("valid_to", last), last)
    cut = valid.select("list", "kind", "value", "valid_from", "valid_to", F.explode(F.sequence(period_of(F.col("valid_from")), period_of(until))).alias("period"))
    if cut.limit(broadcast_rows + 1).count() <= broadcast_rows:
        cut = F.broadcast(cut)
    met = asked.join(cut, ["kind", "value", "period"])
    inside = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    return met.where(inside).select("url", "fetched_at", "list", "kind", "value")


def filter_captures(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at", **options) -> DataFrame:
    """``captures`` with ``n_active`` (entries active at fetch time), ``matched`` (the deciding entry as
    list:kind:value, or null) and ``blocked``."""
    captures = captures.drop("n_active", "matched", "blocked")
    found = active_entries(captures, entries, url=url, fetched_at=fetched_at, **options)
    rank = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    order = F.struct(rank.alias("rank"), F.length("value").alias("size"), F.when(F.col("list") == "allow", 1).otherwise(0).alias("allow"), F.concat_ws(":", "list", "kind", "value").alias("name"))
    said = found.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(order).alias("__best"))
    said = said.select(F.col("url").alias("__url"), F.col("fetched_at").alias("__at"), "n_active", "__best")
    timed = F.col(url).isNotNull() & F.col(fetched_at).isNotNull()
    own = captures.where(timed)
    joined = own.join(said, (own[url] == said["__url"]) & (own[fetched_at].cast("timestamp") == said["__at"]), "left")
    answered = joined.select(
        *[own[c] for c in captures.columns], F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("__best.name").alias("matched"), F.coalesce(F.col("__best.allow") == 0, F.lit(False)).alias("blocked"),
    )
    passed = captures.where(~timed).select("*", F.lit(0).cast("long").alias("n_active"), F.lit(None).cast("string").alias("matched"), F.lit(False).alias("blocked"))
    return answered.unionByName(passed)  # rows without a URL or a time go round the join
