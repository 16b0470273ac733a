"""Who may see which collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what the name of a copy ends with.
COPY = r"__(?:tuning|importing)_[0-9a-f]{32}"


def collection_chain(name: Column) -> Column:
    """The name and what it is a copy of, step by step down to the original, however often it was copied."""
    tail = F.regexp_extract(name, rf"(?:{COPY})*$", 0)
    ends = F.regexp_extract_all(tail, F.lit(f"({COPY})"), 1)
    base = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(tail))
    return F.transform(F.sequence(F.size(ends), F.lit(0), F.lit(-1)), lambda i: F.concat(base, F.array_join(F.slice(ends, F.lit(1), i), "")))


def granted(grants: DataFrame, group_grants: DataFrame, members: DataFrame) -> DataFrame:
    """user, collection: direct grants and those of the user's groups."""
    via = group_grants.join(members, "grp").select("user", "collection")
    return grants.select("user", "collection").unionByName(via).distinct()


def visible_collections(users: DataFrame, collections: DataFrame, restricted: DataFrame, grants: DataFrame, group_grants: DataFrame, members: DataFrame) -> DataFrame:
    """user, collection: all to engineers; to others those whose every restricted ancestor is granted.

    Users with few grants don't multiply with collections: open collections are one row each for
    the role, and only restricted ones are matched with grants.
    """
    chain = collections.select("collection", F.explode(collection_chain(F.col("collection"))).alias("link"))
    need = chain.join(restricted.select(F.col("collection").alias("link")), "link").groupBy("collection").agg(F.count("*").alias("need"), F.collect_set("link").alias("links"))
    held = granted(grants, group_grants, members).select("user", F.col("collection").alias("link"))
    have = need.select("collection", "need", F.explode("links").alias("link")).join(held, "link").groupBy("user", "collection", "need").agg(F.count("*").alias("n")).where("n = need").select("user", "collection")
    open_ones = collections.join(need, "collection", "left_anti").select("collection", F.lit("open").alias("via"))
    engineers = users.where("role = 'engineer'").select("user")
    everyone = users.where("role <> 'engineer'").select("user")
    seen = have.join(everyone, "user", "left_semi").withColumn("via", F.lit("grant"))
    public = open_ones.withColumn("user", F.lit("*")).select("user", "collection", "via")
    all_of = engineers.withColumn("collection", F.lit("*")).withColumn("via", F.lit("role")).select("user", "collection", "via")
    return public.unionByName(seen.select("user", "collection", "via")).unionByName(all_of)


def narrowest_access(chains: DataFrame, restricted: DataFrame, grants: DataFrame) -> DataFrame:
    """copy, user: users granted every restricted link of the copy's chain."""
    need = chains.join(restricted.select(F.col("collection").alias("link")), "link")
    n = need.groupBy("copy").agg(F.count("*").alias("need"))
    have = need.join(grants.select("user", F.col("collection").alias("link")), "link").groupBy("copy", "user").agg(F.count("*").alias("have"))
    return have.join(n, "copy").where("have = need").select("copy", "user")


def access_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def collection_overview(configs: DataFrame, chunks: DataFrame, registry: DataFrame | None = None, visible: DataFrame | None = None) -> DataFrame:
    """``configs`` with object_count; with ``registry`` (collection, created_at) that time, null where unregistered.

    ``visible`` (collection) leaves the others out.
    """
    counts = chunks.groupBy("collection").agg(F.count("*").alias("object_count"))
    out = configs.join(counts, "collection", "left").withColumn("object_count", F.coalesce("object_count", F.lit(0)))
    if registry is not None:
        out = out.join(registry.groupBy("collection").agg(F.min("created_at").alias("created_at")), "collection", "left")
    return out if visible is None else out.join(visible.select("collection").distinct(), "collection", "left_semi")


def may_use(asked: DataFrame, visible: DataFrame) -> DataFrame:
    """``asked`` (user, collection, ...) with allowed, from the rows of ``visible_collections``."""
    named = visible.where("user <> '*' and collection <> '*'").select("user", "collection").distinct().withColumn("_n", F.lit(True))
    everyone = visible.where("user = '*'").select("collection").distinct().withColumn("_e", F.lit(True))
    every = visible.where("collection = '*'").select("user").distinct().withColumn("_a", F.lit(True))
    out = asked.join(named, ["user", "collection"], "left").join(everyone, "collection", "left").join(every, "user", "left")
    return out.withColumn("allowed", F.coalesce("_n", "_e", "_a", F.lit(False))).drop("_n", "_e", "_a")
