"""Temporal URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

An entry is a host (`a.example.org`), a domain that covers the hosts below it, or a host with the first parts of a path
(`a.example.org/en`). Lists are small beside captures, but either may have hot keys: captures are reduced to distinct
(url, time) first and the list's rows are copied over SALTS parts, so that a host with a third of all captures is met in
as many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def validity(events: DataFrame) -> DataFrame:
    """(entry, verdict, valid_from, valid_to) from dated list events (entry, verdict, action, at).

    action is add or remove. An entry counts from its add (included) to the next remove of the same entry and verdict
    (excluded; null: still listed). Repeated adds and removes change nothing; of an add and a remove at one time the
    remove holds. Events with a null entry, verdict or time, or another action, are ignored.
    """
    e = events.where("entry is not null and verdict is not null and at is not null and action in ('add', 'remove')")
    last = e.groupBy(F.lower("entry").alias("entry"), "verdict", "at").agg(F.max("action").alias("action"))  # remove > add
    turns = last.withColumn("was", F.expr("lag(action, 1, 'remove') over (partition by entry, verdict order by at)")).where("was <> action")
    ends = turns.withColumn("valid_to", F.expr("lead(at) over (partition by entry, verdict order by at)"))
    return ends.where("action = 'add'").select("entry", "verdict", F.col("at").alias("valid_from"), "valid_to")


def host_of(url) -> F.Column:
    """The lower-cased host of an absolute URL, without user, port and trailing dot; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def path_of(url) -> F.Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def depths_of(events: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of the list's domains and of path parts of its path entries, without repeats."""
    entry = F.col("entry")
    parts = F.when(entry.contains("/"), F.size(F.split(entry, "/")) - 1).otherwise(0)
    labels = F.when(~entry.contains("/"), F.size(F.split(entry, r"\."))).otherwise(0)
    rows = events.where("entry is not null").select(parts.alias("p"), labels.alias("l")).distinct().collect()
    return sorted({r.l for r in rows} - {0}), sorted({r.p for r in rows} - {0})


def keys_of(host, path, labels_in: list[int], parts_in: list[int]) -> F.Column:
    """All entries of these depths that could cover a URL, each with its specificity: domains by their labels, then the host, then path prefixes."""
    depths = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<int>")
    labels = F.split(host, r"\.")
    domains = F.transform(F.filter(depths(labels_in), lambda k: k < F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("entry"), F.lit(0).alias("kind"), k.alias("depth")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.filter(depths(parts_in), lambda k: k <= F.size(parts)), lambda k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("entry"), F.lit(2).alias("kind"), k.alias("depth")))
    whole = F.array(F.struct(host.alias("entry"), F.lit(1).alias("kind"), F.lit(0).alias("depth")))
    return F.when(host != "", F.concat(domains, whole, prefixes))


def judge(captures: DataFrame, events: DataFrame, key: str, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, host, fetched_at, verdict, entry, valid_from, n_active) for every capture.

    verdict is that of the most specific entry active at the fetch time (path prefix, host, then nearest domain; at
    equal specificity `allow` over `block`), else `none`. A capture without a host or time has verdict none, and so
    has every capture of an empty list. Repeated captures are answered row by row; a long URL is read whole; no capture
    gives no row. Columns of captures other than the three named are not read.
    """
    rows = captures.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(at).alias("t"))
    host = host_of(F.col("u"))
    asked = rows.where("u is not null and t is not null").select("u", "t").distinct()
    met = asked.select("u", "t", F.explode(keys_of(host, path_of(F.col("u")), *depths_of(events))).alias("e")).select("u", "t", "e.*").withColumn("salt", F.pmod(F.xxhash64("u", "t"), F.lit(SALTS)).cast("int"))
    spans = validity(events).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = met.join(spans, ["entry", "salt"]).where("valid_from <= t and (valid_to is null or t < valid_to)")
    best = active.groupBy("u", "t").agg(
        F.max_by(F.struct("verdict", "entry", "valid_from"), F.struct(F.col("kind"), F.col("depth"), (F.col("verdict") == "allow").cast("int"), F.col("verdict"), "valid_from")).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    found = rows.join(best.withColumnRenamed("u", "u2").withColumnRenamed("t", "t2"), (F.col("u") == F.col("u2")) & (F.col("t") == F.col("t2")), "left")
    return found.select(
        F.col("k").alias(key), F.coalesce(host, F.lit("")).alias("host"), F.col("t").alias("fetched_at"), F.coalesce("b.verdict", F.lit("none")).alias("verdict"), F.col("b.entry").alias("entry"), F.col("b.valid_from").alias("valid_from"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active")
    )


def keep_allowed(captures: DataFrame, events: DataFrame, key: str, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures that no active entry blocks; rows that repeat a key share their fate if any of them is blocked."""
    blocked = judge(captures, events, key, url, at).where("verdict = 'block'").select(key).distinct()
    return captures.join(blocked, key, "left_anti").select(*captures.columns)
