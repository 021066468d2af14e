"""References to records that do not exist.

Parents and children are put in one long table of tagged keys; one aggregation per
key shows whether any parent row carries that key, and what stays without a
parent (or got it too late) is reported per field and month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.operators.skew import keyed_join

#: Days after which a parent counts as late.
LATE_DAYS = 7


def key_states(children: DataFrame, parents: DataFrame, tombstones: DataFrame, late_days: int = LATE_DAYS) -> DataFrame:
    """Keys with at least one orphan candidate: key, parent_at, has_parent, deleted, n_refs.

    ``children``: key, at. ``parents``: key, at. ``tombstones``: key.
    Partial aggregation happens before the shuffle, so a key that a third of all
    references share arrives as a few rows.
    """
    none_ts = F.lit(None).cast("timestamp")
    tagged = (
        children.select("key", F.lit(1).alias("refs"), F.col("at").alias("child_at"), none_ts.alias("parent_at"), F.lit(0).alias("p"), F.lit(0).alias("d"))
        .unionByName(parents.select("key", F.lit(0).alias("refs"), none_ts.alias("child_at"), F.col("at").alias("parent_at"), F.lit(1).alias("p"), F.lit(0).alias("d")))
        .unionByName(tombstones.select("key", F.lit(0).alias("refs"), none_ts.alias("child_at"), none_ts.alias("parent_at"), F.lit(0).alias("p"), F.lit(1).alias("d")))
    )
    states = tagged.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.sum("refs").alias("n_refs"),
        F.min("child_at").alias("first_child_at"),
        F.min("parent_at").alias("parent_at"),
        (F.max("p") == 1).alias("has_parent"),
        (F.max("d") == 1).alias("deleted"),
    )
    late = F.col("parent_at") > F.col("first_child_at") + F.expr(f"INTERVAL {late_days} DAYS")
    return states.where((F.col("n_refs") > 0) & (~F.col("has_parent") | F.coalesce(late, F.lit(False)))).drop("first_child_at")


def orphan_references(
    links: DataFrame,
    pages: DataFrame,
    tombstones: DataFrame,
    fields: Sequence[str] = ("from_page", "to_page"),
    late_days: int = LATE_DAYS,
) -> DataFrame:
    """One row per orphan reference: link_id, ref_field, key, discovered_at, kind.

    ``kind`` is ``missing`` (key in neither table), ``deleted`` (only in the tombstones)
    or ``late`` (first crawled more than ``late_days`` after the link was found).
    Null references are none; a redelivered link (same link_id) counts once with its
    earliest discovered_at; references without a link_id are told apart by key and time; a null discovered_at or
    crawled_at is never late. Empty tables give an empty result (all references missing if
    pages are empty). Further columns of the inputs are ignored.
    """
    refs = links.select(
        "link_id",
        "discovered_at",
        F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("key")) for f in fields])).alias("r"),
    ).select("link_id", "discovered_at", "r.ref_field", "r.key").where(F.col("key").isNotNull())
    states = key_states(
        refs.select("key", F.col("discovered_at").alias("at")),
        pages.select(F.col("page_id").cast("long").alias("key"), F.col("crawled_at").alias("at")),
        tombstones.select(F.col("page_id").cast("long").alias("key")),
        late_days,
    )
    orphans = keyed_join(refs, states, ["key"], "n_refs")
    late = F.col("parent_at") > F.col("discovered_at") + F.expr(f"INTERVAL {late_days} DAYS")
    kind = F.when(~F.col("has_parent"), F.when(F.col("deleted"), "deleted").otherwise("missing")).when(late, "late")
    return (
        orphans.withColumn("kind", kind)
        .groupBy("link_id", "ref_field", F.when(F.col("link_id").isNull(), F.struct("key", "discovered_at")).alias("__own"))
        .agg(F.min_by(F.struct("key", "discovered_at", "kind"), F.coalesce("discovered_at", F.lit("9999-01-01").cast("timestamp"))).alias("r"))
        .select("link_id", "ref_field", "r.key", "r.discovered_at", "r.kind")
        .where(F.col("kind").isNotNull())
    )


def orphan_report(orphans: DataFrame, child_table: str = "link_records") -> DataFrame:
    """Counts per child table, field, month of discovery and kind; a null time is month null."""
    return (
        orphans.groupBy(F.lit(child_table).alias("child_table"), "ref_field", F.date_format("discovered_at", "yyyy-MM").alias("month"), "kind")
        .agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("key").alias("n_keys"))
    )
