"""The catalogue for a whole table of viewers.

Viewers with the same affiliation and the same memberships that matter see the same. They are
factored to such classes; what a class may read is a sparse table of (class, collection), since
its other collections all share one state; viewers meet it by their class. No product of
viewers and collections is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.operators.access import active_memberships

NOBODY = "anonymous"


def viewer_classes(viewers: DataFrame, memberships: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(viewers with their class_id, classes).

    viewers: user_id (NULL: anonymous), affiliation_community_id. A class: class_id,
    affiliation, communities (of active memberships that some collection asks for), and
    locked_state, the state of every collection that it may not read.
    """
    asked = collections.select("community_id").where("community_id IS NOT NULL").distinct()
    own = active_memberships(memberships).join(asked, "community_id", "left_semi").groupBy("user_id").agg(
        F.array_sort(F.collect_set("community_id")).alias("communities"))
    none = F.array().cast("array<string>")
    known = viewers.where("user_id IS NOT NULL").join(own, "user_id", "left").withColumn("communities", F.coalesce("communities", none))
    looks = F.to_json(F.struct("affiliation_community_id", "communities"))
    known = known.withColumn("class_id", F.sha2(looks, 256))
    nobody = viewers.where("user_id IS NULL").withColumn("communities", none).withColumn("class_id", F.lit(NOBODY))
    every = known.unionByName(nobody)
    locked = F.when(F.col("class_id") == NOBODY, "locked_requires_signin").otherwise("locked_wrong_affiliation")
    classes = every.select("class_id", F.when(F.col("class_id") != NOBODY, F.col("affiliation_community_id")).alias("affiliation"), "communities",
                           locked.alias("locked_state")).distinct()
    return every.drop("communities"), classes


def readable(classes: DataFrame, collections: DataFrame) -> DataFrame:
    """(class_id, collection) of the restricted collections that a class may read: it is a
    member of the community, and its affiliation is unknown or the same."""
    pairs = classes.select("class_id", "affiliation", F.explode("communities").alias("community_id")).where(
        F.col("affiliation").isNull() | (F.col("affiliation") == F.col("community_id")))
    return pairs.join(collections.select(F.col("name").alias("collection"), "community_id"), "community_id").select("class_id", "collection")


def open_to_all(collections: DataFrame) -> DataFrame:
    return collections.where("community_id IS NULL").select(F.col("name").alias("collection"))


def class_listings(classes: DataFrame, collections: DataFrame) -> DataFrame:
    """Per class: the names it may read, in order, how many it may not, and their state. A
    class's restricted names are bounded by its own memberships, the open ones are the same
    one row for all."""
    opened = open_to_all(collections).agg(F.array_sort(F.collect_list("collection")).alias("_open"))
    total = collections.agg(F.count(F.lit(1)).alias("_total"))
    own = readable(classes, collections).groupBy("class_id").agg(F.collect_list("collection").alias("_own"))
    one = opened.join(F.broadcast(total))  # one row each
    names = F.array_sort(F.concat("_open", F.coalesce("_own", F.array().cast("array<string>"))))
    return classes.join(own, "class_id", "left").join(F.broadcast(one)).withColumn("accessible", names).select(
        "class_id", "accessible", (F.col("_total") - F.size("accessible")).alias("locked"), "locked_state")


def allowed_queries(queries: DataFrame, viewers: DataFrame, pairs: DataFrame, opened: DataFrame) -> DataFrame:
    """Queries whose user may read their collection. viewers: (user_id, class_id); queries of
    no known user read what is open to all."""
    free = queries.join(opened, "collection", "left_semi")
    rest = queries.join(opened, "collection", "left_anti").where("user_id IS NOT NULL")
    held = rest.join(viewers.select("user_id", "class_id"), "user_id").join(pairs, ["class_id", "collection"], "left_semi")
    return free.unionByName(held.select(*queries.columns))
