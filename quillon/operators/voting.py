"""Pairwise comparisons: building them from scores, tie-breaks, and overall winners by vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.normalize import confidence_rank, error_rationale
from quillon.schema import require


def label(a: Column, b: Column) -> Column:
    """model_a, model_b or tie by the larger of two values; null if either is."""
    return F.when(a > b, "model_a").when(b > a, "model_b").when(a == b, "tie")


def pairs_from_scores(cells: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """All model pairs a < b of a key, with a winner for each dimension and by majority.

    ``cells`` has the keys, model_name and scores, an array in the order of
    ``dimensions``. Keys may be null and then meet nulls. One equi-join on the key;
    the models' order only filters within it.
    """
    require(cells, [*keys, "model_name", "scores"])
    a = cells.select(*keys, F.col("model_name").alias("model_a"), F.col("scores").alias("sa"))
    b = cells.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("model_name").alias("model_b"), F.col("scores").alias("sb"))
    on = F.col("model_a") < F.col("model_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = a.join(b, on).drop(*[f"__{k}" for k in keys])
    winners = F.transform(F.arrays_zip("sa", "sb"), lambda s: label(s["sa"], s["sb"]))
    out = out.withColumn("winners", winners).drop("sa", "sb")
    return with_majority(out.withColumn("winners", F.map_from_arrays(F.array(*map(F.lit, dimensions)), "winners")))


def with_majority(pairs: DataFrame) -> DataFrame:
    """Adds win_a, win_b, win_tie over the map ``winners`` and overall, the side with more; nulls aren't votes."""
    votes = F.map_values("winners")
    count = lambda x: F.size(F.filter(votes, lambda v: v == x))
    out = pairs.withColumns({"win_a": count("model_a"), "win_b": count("model_b"), "win_tie": count("tie")})
    return out.withColumn("overall", label(F.col("win_a"), F.col("win_b")))


def dimension_rows(pairs: DataFrame) -> DataFrame:
    """One row for each pair and dimension: winner_label beside the other columns."""
    return pairs.select(*[c for c in pairs.columns if c != "winners"], F.explode("winners").alias("dimension", "winner_label"))


def canonical_order(pairs: DataFrame, key_a: Column, key_b: Column, labels: Sequence[str]) -> DataFrame:
    """Swaps model_a and model_b where key_a > key_b, and with them what the columns ``labels`` say."""
    swap = key_a > key_b
    turned = {c: F.when(swap & (F.col(c) == "model_a"), "model_b").when(swap & (F.col(c) == "model_b"), "model_a").otherwise(F.col(c)) for c in labels}
    same = F.when(key_a == key_b, F.raise_error(F.lit("both names of a pair mean one model")).cast("string"))
    models = {"model_a": F.coalesce(same, F.when(swap, F.col("model_b")).otherwise(F.col("model_a"))), "model_b": F.when(swap, F.col("model_a")).otherwise(F.col("model_b"))}
    return pairs.withColumns(models | turned)


def swap_tested(pos1: Column, conf1: Column, pos2: Column, conf2: Column, finegrained: bool) -> tuple[Column, Column]:
    """(winner, biased) of two runs of a judge with the answers in either order.

    Positions are A, B or tie; the second run's are turned back. Runs that differ
    are biased: strictly a tie; fine-grained, a side against a tie wins from
    medium confidence on, and of two sides the surer one.
    """
    first = F.when(pos1 == "A", "model_a").when(pos1 == "B", "model_b").otherwise("tie")
    second = F.when(pos2 == "A", "model_b").when(pos2 == "B", "model_a").otherwise("tie")
    if not finegrained:
        return F.when(first == second, first).otherwise("tie"), first != second
    r1, r2 = confidence_rank(conf1), confidence_rank(conf2)
    broken = (
        F.when(second == "tie", F.when(r1 >= 2, first).otherwise("tie"))
        .when(first == "tie", F.when(r2 >= 2, second).otherwise("tie"))
        .when(r1 > r2, first).when(r2 > r1, second).otherwise("tie")
    )
    return F.when(first == second, first).otherwise(broken), first != second


def recompute_overall(pairs: DataFrame, mode: str = "ignore", omit: Sequence[str] = (), weights: DataFrame | None = None, correctness_weight: float = 5.0) -> DataFrame:
    """Overall winners anew from the map ``winners``: adds votes_a, votes_b, votes_tie, overall and valid.

    Dimensions in ``omit``, null ones and those whose entry in a map ``rationales``
    reports an error don't vote. mode: ``ignore`` takes dimensions only;
    ``dimension`` adds a vote for the side with the larger pass_a, pass_b; ``gate``
    lets the one side that passes at all win alone, with votes of 0. ``weights``
    (user_id, dimension, weight) gives each vote its persona's weight, the
    correctness vote that of ``correctness`` or ``correctness_weight``. Ties never
    decide. Rows without any vote aren't valid.
    """
    kept = F.map_filter("winners", lambda d, w: w.isNotNull() & ~d.isin(list(omit)))
    if "rationales" in pairs.columns:
        kept = F.map_filter(kept, lambda d, w: ~error_rationale(F.try_element_at("rationales", d)))
    out = pairs.withColumn("__kept", kept)
    if weights is not None:
        own = weights.groupBy(F.col("user_id").alias("__user")).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "weight"))).alias("__weights"))
        out = out.join(own, F.col("user_id") == F.col("__user"), "left").drop("__user")
    one = F.lit(1.0)
    weight = (lambda d: F.coalesce(F.try_element_at("__weights", d), one)) if weights is not None else (lambda d: one)
    total = lambda side: F.aggregate(F.map_entries("__kept"), F.lit(0.0), lambda s, e: s + F.when(e["value"] == side, weight(e["key"])).otherwise(0.0))
    votes = {f"votes_{n}": total(side) for n, side in (("a", "model_a"), ("b", "model_b"), ("tie", "tie"))}
    out = out.withColumns(votes)
    if mode in ("dimension", "gate"):
        require(out, ["pass_a", "pass_b"])
    if mode == "dimension":
        extra = F.coalesce(F.try_element_at("__weights", F.lit("correctness")), F.lit(correctness_weight)) if weights is not None else one
        better = label(F.col("pass_a"), F.col("pass_b"))
        out = out.withColumns({f"votes_{n}": F.col(f"votes_{n}") + F.when(F.coalesce(better == side, F.lit(False)), extra).otherwise(0.0) for n, side in (("a", "model_a"), ("b", "model_b"), ("tie", "tie"))})
    overall = label(F.col("votes_a"), F.col("votes_b"))
    valid = F.col("votes_a") + F.col("votes_b") + F.col("votes_tie") > 0
    if mode == "gate":
        a, b = F.coalesce(F.col("pass_a") > 0, F.lit(False)), F.coalesce(F.col("pass_b") > 0, F.lit(False))
        gated = F.col("pass_a").isNotNull() & F.col("pass_b").isNotNull() & (a != b)
        overall = F.when(gated, F.when(a, "model_a").otherwise("model_b")).otherwise(overall)
        valid = valid | gated
        out = out.withColumn("__overall", overall).withColumn("__valid", valid).withColumns({f"votes_{n}": F.when(gated, 0.0).otherwise(F.col(f"votes_{n}")) for n in ("a", "b", "tie")})
        return out.withColumn("overall", F.col("__overall")).withColumn("valid", F.col("__valid")).drop("__kept", "__weights", "__overall", "__valid")
    return out.withColumn("overall", overall).withColumn("valid", valid).drop("__kept", "__weights")
