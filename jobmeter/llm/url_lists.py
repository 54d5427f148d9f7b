"""URL filters: dated list entries as validity intervals, captures judged as of their fetch time.

A list entry blocks or allows a key from a date on, until the list's next entry for that key; the
action ``remove`` ends it without a successor. Keys are hosts, which cover their subdomains, or hosts
with the beginning of a path. A capture is judged by the most specific entry active when it was
fetched, so that a later change of a list leaves earlier captures as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm.tables import col, packed, unpacked
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

STRENGTH = {"remove": 0, "allow": 1, "block": 2}
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host without a final dot, and the path's segments; the host is empty if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")
    path = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
    return host, path


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, valid_from, valid_to) from entries (list, key, action, listed_at).

    Scheme, capital letters of the host and a final slash of a key do not count. Entries of one list,
    key and time are reduced to the strongest (block, allow, remove) before the times are put in
    order. Entries without key or time, or with another action, have no interval.
    """
    key = F.trim(F.regexp_replace("key", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host, path = host_and_path(F.concat(F.lit("//"), key))
    strength = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in STRENGTH.items()])
    strongest = (
        entries.select(
            F.coalesce(F.col("list"), F.lit("")).alias("list"),
            F.array_join(F.concat(F.array(host), path), "/").alias("key"),
            strength.alias("strength"),
            F.col("listed_at").alias("valid_from"),
        )
        .where("key <> '' AND strength IS NOT NULL AND valid_from IS NOT NULL")
        .groupBy("list", "key", "valid_from")
        .agg(F.max("strength").alias("strength"))
    )
    following = F.lead("valid_from").over(W.partitionBy("list", "key").orderBy("valid_from"))
    return (
        strongest.withColumn("valid_to", following)
        .where("strength > 0")
        .select(
            "list",
            "key",
            F.when(F.col("strength") == STRENGTH["block"], "block").otherwise("allow").alias("action"),
            "valid_from",
            "valid_to",
        )
    )


def _keys(host: Column, path: Column, depth: int) -> Column:
    """All keys that may cover a URL: the host, its parent domains, and beginnings of its path."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    if not depth:
        return parents
    steps = F.least(F.size(path), F.lit(depth))
    prefixes = F.when(
        steps > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(parents, prefixes)


def judge(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Every row of ``captures`` with decision, rule, rule_list and rule_from.

    ``decision`` is the action (block or allow) of the most specific entry active at the fetch time:
    longer paths before shorter ones, then hosts with more labels. Of entries with one key, a block
    goes before an allow, then the later entry, then the first list by name. It is ``none`` without
    an active entry and ``invalid`` without a host or a fetch time; the rule columns are then null.

    An entry is active from its own time up to, not including, the time of the list's next entry for
    its key. Captures are judged once for each different URL and time: repeated rows get equal
    results. Result columns replace columns of the same name; other columns pass through. Without
    entries every valid capture has ``none``; an empty table gives an empty table.
    """
    valid = materialize(intervals(entries), "intervals")
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    depth = valid.agg(F.max(slashes)).first()[0] or 0
    # The list side stays a plain table: if it is too large to broadcast, adaptive execution can
    # split the captures of a host that holds a large share of them.
    rules = small_side(valid)

    host, path = host_and_path(col(url).cast("string"))
    asked = captures.select(col(url).cast("string").alias("u"), col(fetched_at).alias("t"))
    asked = asked.where(F.col("u").isNotNull() & F.col("t").isNotNull()).distinct()
    host, path = host_and_path(F.col("u"))
    keys = asked.select("u", "t", host.alias("host"), path.alias("path")).where("host <> ''")
    keys = keys.select("u", "t", F.explode(_keys(F.col("host"), F.col("path"), depth)).alias("key"))
    active = keys.join(rules, "key").where(
        (F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    )
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    rank = F.struct(
        (-slashes).alias("a"), (-labels).alias("b"), (F.col("action") != "block").alias("c"),
        (-F.unix_micros(F.col("valid_from").cast("timestamp"))).alias("d"), F.col("list").alias("e"),
        F.col("action"), F.col("key"), F.col("valid_from"),
    )
    # The second grouping column depends on the first: the join below can then still split hot URLs.
    best = active.groupBy("u", "t", F.length("u").alias("n")).agg(F.min(rank).alias("best")).drop("n")

    keyed = packed(captures, u=col(url).cast("string"), t=col(fetched_at))
    judged = keyed.join(best, ["u", "t"], "left")
    own_host, _ = host_and_path(F.col("u"))
    invalid = F.col("u").isNull() | F.col("t").isNull() | (own_host == "")
    return unpacked(
        judged,
        captures.columns,
        {
            "decision": F.when(invalid, "invalid").otherwise(F.coalesce("best.action", F.lit("none"))),
            "rule": F.col("best.key"),
            "rule_list": F.col("best.e"),
            "rule_from": F.col("best.valid_from"),
        },
    )
