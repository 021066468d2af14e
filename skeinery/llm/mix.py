"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order and repeated if needed, form a line of tokens
that is cut into blocks. Weight w gives block k of a source the release time
floor(k / w) and the deadline ceil((k + 1) / w), counted in slots of one block; serving
the released block with the earliest deadline in each slot keeps every source within one
block of its share at any time.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.operators.skew import prefix_sum
from skeinery.session import cut

#: Slots of a schedule: a block is this part of the mix, which bounds the schedule at any size.
SLOTS = 10_000

#: Ranges of the pseudo-random order in which a source's tokens are summed.
BUCKETS = 1024


def schedule(weights: dict[str, Fraction], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline first among released blocks; ties by heavier weight, then name.

    Weights sum to one, so each slot has a block and none misses its deadline.
    """
    if not weights:
        return []
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, Fraction, str, int]] = []
    limit = {s: math.ceil(w * slots) for s, w in weights.items()}

    def place(source: str, block: int) -> None:
        w = weights[source]
        heapq.heappush(waiting, (math.floor(block / w), source, block))

    for s in sorted(weights):
        place(s, 0)
    out = []
    for slot in range(slots + len(weights)):
        while waiting and waiting[0][0] <= slot:
            _, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((block + 1) / weights[s]), -weights[s], s, block))
        if not ready:
            if not waiting:
                break
            continue
        _, _, s, block = heapq.heappop(ready)
        out.append((s, block, slot))
        if block + 1 < limit[s]:
            place(s, block + 1)
    return out


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[list[tuple], int]:
    """Per target source (source, share, repeats, tokens, quota), and the mix's total.

    The total is the largest at which every source that has tokens reaches its share within its
    repeats, unless ``total_tokens`` asks for another; a source may then fall short. Shares
    are taken relative to the sources that have tokens. ``targets`` holds a few rows per source by
    nature and is the only table read on the driver, with the sums of its sources.
    """
    wanted = (
        targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share"))
        .groupBy("source")
        .agg(F.max("target_share").alias("share"), F.greatest(F.lit(1), F.max(F.coalesce("max_repeats", F.lit(1)))).alias("repeats"))
    )
    got = wanted.join(sizes, "source", "left").select("source", "share", "repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").collect()
    served = [r for r in got if r["tokens"] > 0]
    whole = sum(Fraction(r["share"]).limit_denominator(10**9) for r in served)
    if total_tokens is None:
        total_tokens = min((int(r["tokens"] * r["repeats"] / (Fraction(r["share"]).limit_denominator(10**9) / whole)) for r in served), default=0)
    plan = []
    for r in got:
        share = Fraction(r["share"]).limit_denominator(10**9) / whole if r["tokens"] > 0 else Fraction(0)
        quota = min(int(share * total_tokens), r["tokens"] * r["repeats"])
        plan.append((r["source"], share, r["repeats"], r["tokens"], quota, r["share"]))
    return plan, total_tokens


def listed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents of sources with a positive target share, filtered where they lie; targets hold a row per source, read on the driver as ``_plan`` does."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share")).select("source").distinct()
    return docs.where(F.col("source").isin([r["source"] for r in wanted.collect()]))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """The drawn documents: doc_id, source, copy (from 0), n_tokens, slot, place.

    ``docs`` has doc_id, source, n_tokens. A document is used in whole, at most ``max_repeats``
    times (a null or smaller cap counts as 1); every source's copies 0 come before its copies 1, each in an order of its own. The
    last document of a source is drawn if that brings its tokens closer to the quota. Ordering the result by (slot, source, place)
    gives the interleaved mix. Repeated doc_ids count once; null or unlisted sources, documents without tokens
    and sources without a positive share are not drawn. Without any listed source the result is empty.
    """
    spark = docs.sparkSession
    one = cut(docs.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).dropDuplicates(["doc_id"]))
    sizes = one.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan, total = _plan(sizes, targets, total_tokens)
    block = max(1, total // slots)
    weights = {s: share for s, share, *_ in plan if share > 0}
    served = schedule(weights, slots)
    plan_df = spark.createDataFrame([(s, tokens, quota, -(-quota // tokens) if tokens else 0) for s, _, _, tokens, quota, _ in plan], "source string, tokens bigint, quota bigint, copies bigint")
    slots_df = spark.createDataFrame(served or [], "source string, block bigint, slot bigint")
    use = one.join(F.broadcast(plan_df.where("quota > 0")), "source")
    copies = use.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "copy", "doc_id"))
    # equal ranges of the hash agree with its order, so a source of any size is summed in parts
    bucket = F.shiftright("h", 64 - int(math.log2(BUCKETS)))
    laid = prefix_sum(copies, ["source", "copy"], bucket, ["h", "doc_id"], F.col("n_tokens"), "within")
    laid = laid.withColumn("start", F.col("copy") * F.col("tokens") + F.col("within")).where(F.col("start") + F.col("n_tokens") / 2 <= F.col("quota"))
    last = max((-(-quota // block) for *_, quota, _ in plan), default=0)
    numbered = laid.withColumn("block", F.least(F.floor(F.col("start") / block), F.lit(last).cast("long")))
    placed = numbered.join(F.broadcast(slots_df), ["source", "block"], "left")
    # rounding may leave a source's last tokens beyond its last scheduled block
    return placed.select("doc_id", "source", "copy", "n_tokens", F.coalesce("slot", F.lit(slots).cast("long")).alias("slot"), F.col("start").alias("place"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, reached_share, tokens, documents, most_repeats; sources without documents too."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("drawn"), F.count_distinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_repeats")
    )
    got = cut(got)  # a row per source
    total = got.agg(F.sum("tokens")).first()[0] or 1
    named = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("drawn"), zero("documents"), zero("most_repeats")
    )
