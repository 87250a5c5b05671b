"""Choosing items for human studies: consensus, strata, strides, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consensus(rows: DataFrame, group: str, judge: str, signature: str, least_pool: int = 2, required: int = 2, drop_tied: bool = True) -> DataFrame:
    """Each candidate with rejection, null if kept: tied_overall, small_pool, no_consensus or dissent.

    A group keeps the judges of its largest equal-signature bucket if the pool and
    the bucket are large enough; of equal buckets, the one whose first judge (by
    name) comes first. Buckets are counted by an aggregate, not by a window.
    """
    tied = F.lower(F.coalesce(signature, F.lit("none"))).isin("", "none", "tie") if drop_tied else F.lit(False)
    rows = rows.withColumn("__tied", tied)
    live = rows.where(~F.col("__tied"))
    buckets = live.groupBy(group, signature).agg(F.count("*").alias("n"), F.min(judge).alias("first"))
    pool = buckets.groupBy(group).agg(F.sum("n").alias("pool"), F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(signature).alias("signature"))).alias("top"))
    out = rows.join(pool, group, "left")
    reason = (
        F.when(F.col("__tied"), "tied_overall").when(F.coalesce("pool", F.lit(0)) < least_pool, "small_pool")
        .when(-F.col("top.n") < required, "no_consensus").when(F.col(signature) != F.col("top.signature"), "dissent")
    )
    return out.withColumn("rejection", reason).drop("__tied", "pool", "top")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) by ``order``: an aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    packed = F.struct(*order, *rest)
    return rows.groupBy(*key).agg((F.max(packed) if last else F.min(packed)).alias("r")).select(*key, *(f"r.{c}" for c in [*order, *rest]))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds each row's place (from 1) by a unique ``order``.

    Places are counted without one task for all: rows are dealt into ranges of
    ``order``, each range is numbered by itself, and the counts of the ranges
    before it, a row each, are added.
    """
    parts = rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = parts.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(order))).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + F.col(name)).drop("__part", "__n", "__before")


def stride(rows: DataFrame, order: str, step: int, offset: int = 0) -> DataFrame:
    """Every ``step``-th row by a unique ``order`` from ``offset`` on."""
    at = F.col("__at") - 1 - offset
    return numbered(rows, order, "__at").where((at >= 0) & (at % step == 0)).drop("__at")


def equal_allocation(rows: DataFrame, strata: Sequence[str], per_stratum: int, order: str) -> DataFrame:
    """The first ``per_stratum`` rows, by a hash of ``order``, of each combination of the observed values of ``strata``; one with fewer rows, or none, fails."""
    from quillon.operators.study import equal_allocation as allocate
    from quillon.operators.study import strata_of

    return allocate(rows, strata, per_stratum * strata_of(rows, strata).count(), 0, [order])


def without_prior(rows: DataFrame, prior: DataFrame, key: str, protected: DataFrame | None = None) -> DataFrame:
    """Rows whose key isn't in ``prior``, but for those in ``protected``."""
    used = prior.select(key).distinct()
    if protected is not None:
        used = used.join(protected.select(key).distinct(), key, "left_anti")
    return rows.join(used, key, "left_anti")


def interleave(frames: Sequence[DataFrame], order: str) -> DataFrame:
    """Round robin over frames: each row's place in its own frame, then the frame. Places are counted by ranges, as in ``stride``."""
    out = None
    for i, df in enumerate(frames):
        own = numbered(df, order, "round").withColumn("source_index", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def multiselect_counts(rows: DataFrame, answer: str, separator: str = ";", least: int = 1) -> DataFrame:
    """How many respondents chose each answer, with the number of respondents."""
    given = rows.where(F.col(answer).isNotNull())
    chosen = given.select(F.explode(F.split(answer, separator)).alias("choice")).select(F.trim("choice").alias("choice")).where("choice <> ''")
    out = chosen.groupBy("choice").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.crossJoin(F.broadcast(given.agg(F.count("*").alias("respondents"))))  # one row


def best_submission(rows: DataFrame, annotator: str, order: Sequence[str]) -> DataFrame:
    """Each annotator's submission that is best by ``order`` descending; two equally good ones fail."""
    ranked = F.struct(*order)
    rest = [c for c in rows.columns if c != annotator]
    out = rows.groupBy(annotator).agg(F.max(F.struct(ranked.alias("o"), F.struct(*rest).alias("r"))).alias("m"), F.max(ranked).alias("top"))
    same = rows.join(out.select(F.col(annotator).alias("__who"), "top"), (F.col(annotator) == F.col("__who")) & (ranked == F.col("top"))).groupBy(annotator).agg(F.count("*").alias("__same"))
    tie = F.raise_error(F.lit("two equally good submissions")).cast("boolean")
    return out.join(same, annotator).where(F.when(F.col("__same") == 1, True).otherwise(tie)).select(annotator, "m.r.*")


def annotation_stats(rows: DataFrame, item: str, annotator: str, choice: str) -> DataFrame:
    """Items, annotations, annotators, items with several annotations, and those of them that agree fully."""
    per = rows.groupBy(item).agg(F.count("*").alias("n"), F.count_distinct(choice).alias("k"))
    items = per.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_annotations"), F.count_if(F.col("n") > 1).alias("n_overlap"), F.count_if((F.col("n") > 1) & (F.col("k") == 1)).alias("n_full_agreement"))
    return items.crossJoin(rows.agg(F.count_distinct(annotator).alias("n_annotators")))  # one row each
