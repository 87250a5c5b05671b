"""Summaries of comparisons, attempts and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stats import binomial_p, pass_at_k, passed_in_k
from quillon.schema import PAIR, present

SIDES = ("model_a", "model_b", "tie")


def outcome_counts(c: Column) -> list[Column]:
    return [F.count("*").alias("total"), *(F.count_if(c == s).alias(f"n_{s}") for s in SIDES)]


def with_rates(df: DataFrame) -> DataFrame:
    """Rates over all comparisons, ties included, and the probability that a wins without ties (1/2 if there are only ties)."""
    decided = F.col("n_model_a") + F.col("n_model_b")
    rates = {f"rate_{s}": F.try_divide(F.col(f"n_{s}"), F.col("total")) for s in SIDES}
    return df.withColumns(rates | {"win_prob": F.when(decided > 0, F.col("n_model_a") / decided).otherwise(0.5)})


def pair_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outcomes of each model pair, within optional further keys; with bias rates their mean, and pass@k rates where known (see ``objective_outcomes``)."""
    counted = outcome_counts(F.col("overall"))
    if "bias_rate" in pairs.columns:
        counted.append(F.avg("bias_rate").alias("avg_bias_rate"))
    for a in [c for c in pairs.columns if c.startswith("pass_a_")]:
        counted += _pass_rates(a, a.replace("pass_a_", "pass_b_"), a.removeprefix("pass_a_"))
    return with_rates(pairs.groupBy(*keys, *PAIR).agg(*counted))


def _pass_rates(a: str, b: str, name: str) -> list[Column]:
    """How often either side passes more; rows without one of the two don't count, rates without rows are null."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    total = F.count_if(known)
    hits = {"a": F.col(a) > F.col(b), "b": F.col(b) > F.col(a), "tie": F.col(a) == F.col(b)}
    return [total.alias(f"{name}_total"), *(F.try_divide(F.count_if(known & c), total).alias(f"{name}_rate_{s}") for s, c in hits.items())]


def objective_rows(summary: DataFrame, dimensions: DataFrame, name: str) -> DataFrame:
    """A dimension table with rows for a pass rate ``name`` of the pair summary: wins are rates times totals, half to even."""
    wins = {f"n_model_{s}": F.bround(F.col(f"{name}_rate_{s}") * F.col(f"{name}_total")).cast("bigint") for s in "ab"}
    rows = summary.where(F.col(f"{name}_total") > 0).select(*PAIR, F.lit(name).alias("dimension"), F.col(f"{name}_total").alias("total"), *(c.alias(n) for n, c in wins.items()))
    rows = rows.withColumns({"n_tie": F.col("total") - F.col("n_model_a") - F.col("n_model_b"), "n_errors": F.lit(0).cast("bigint")})
    return dimensions.unionByName(with_rates(rows), allowMissingColumns=True)


def rubric_details(pairs: DataFrame, details: DataFrame, keys: Sequence[str], by: Sequence[str] = ("user_id", "variant_label")) -> DataFrame:
    """Means and sample deviations (0 for one) of each numeric rubric detail for both models of a pair.

    ``details`` has the keys, model_name and details, a map of maps of texts; what
    is no number is left out. A comparison without details of one of its models fails.
    """
    packed = details.withColumn("__j", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("details", lambda k, v: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(v))))))))))
    one = packed.groupBy(*keys, "model_name").agg(F.min("__j").alias("__lo"), F.max("__j").alias("__hi"), F.min_by("details", "__j").alias("details"))
    clash = F.raise_error(F.lit("a model has two sets of details for one key")).cast("boolean")
    one = one.where(F.when(F.col("__lo") == F.col("__hi"), True).otherwise(clash))
    a = one.select(*keys, F.col("model_name").alias("model_a"), F.col("details").alias("da"))
    b = one.select(*keys, F.col("model_name").alias("model_b"), F.col("details").alias("db"))
    both = pairs.select(*keys, *PAIR, *[c for c in by if c not in keys]).join(a, [*keys, "model_a"], "left").join(b, [*keys, "model_b"], "left")
    lost = F.raise_error(F.lit("a comparison lacks details of a model")).cast("map<string,map<string,string>>")
    both = both.withColumns({c: F.coalesce(c, lost) for c in ("da", "db")})
    rows = both.select(*by, *PAIR, "db", F.explode("da").alias("dimension", "own")).select(*by, *PAIR, "dimension", F.try_element_at("db", F.col("dimension")).alias("other"), F.explode("own").alias("detail", "x"))
    rows = rows.select(*by, *PAIR, "dimension", "detail", F.col("x").try_cast("double").alias("row"), F.try_element_at("other", F.col("detail")).try_cast("double").alias("col")).where("row is not null and col is not null")
    spread = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0).alias(f"{c}_std")
    return rows.groupBy(*by, *PAIR, "dimension", "detail").agg(F.count("*").alias("n"), F.avg("row").alias("row_mean"), spread("row"), F.avg("col").alias("col_mean"), spread("col"))


def resolution_rate(rows: DataFrame, keys: Sequence[str], given: str | None = None) -> DataFrame:
    """Share of resolved rows; a value that a group brings itself wins."""
    own = F.avg(F.col("resolved").cast("double"))
    return rows.groupBy(*keys).agg((F.coalesce(F.first(given, ignorenulls=True), own) if given else own).alias("resolution_rate"))


def weighted_overall(scores: Column, preferred: Column, factor: float = 2.0) -> Column:
    """Mean of a map of scores by dimension, preferred dimensions weighing ``factor``, in [0, 1]; null without scores."""
    entries = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull())
    weight = lambda e: F.when(F.array_contains(F.coalesce(preferred, F.array().cast("array<string>")), e["key"]), factor).otherwise(1.0)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + weight(e) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["value"])))
    return F.try_divide(total, F.aggregate(entries, F.lit(0.0), lambda s, e: s + weight(e)))


def components(breakdowns: Column, part: str) -> Column:
    """Map of one component (judge or rubric) by dimension from a map of structs."""
    return F.map_filter(F.transform_values(breakdowns, lambda k, v: v["components"][part]), lambda k, v: v.isNotNull())


def persona_labels(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds each user's persona, or unknown."""
    labels = profiles.select("user_id", F.col("user_profile_type").alias("persona_label")).dropDuplicates(["user_id"])
    return df.join(labels, "user_id", "left").withColumn("persona_label", F.coalesce("persona_label", F.lit("unknown")))


def with_user_ids(objective: DataFrame, subjective: DataFrame, default: str | None = None) -> DataFrame:
    """user_id of results from scores of the same task and variant, then ``default``."""
    known = subjective.where("user_id is not null").groupBy("task_id", "variant_id").agg(F.min("user_id").alias("__user"))
    own = [F.col("user_id")] if "user_id" in objective.columns else []
    return objective.join(known, ["task_id", "variant_id"], "left").withColumn("user_id", F.coalesce(*own, "__user", F.lit(default))).drop("__user")


def objective_lookup(objective: DataFrame, order: Sequence[str], ks: Sequence[int] = (1, 5)) -> DataFrame:
    """One row for each sample, variant and model: pass@k overall, else base, else plus, and plus pass@1 apart; a later row's value wins if it isn't null."""
    at = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    chosen = {f"pass_at_{k}": F.coalesce(*[F.col(f"obj_{p}_pass_at_{k}") for p in ("overall", "base", "plus")]) for k in ks}
    return objective.groupBy("sample_key", "variant_label", "model_name").agg(*[last(c).alias(n) for n, c in chosen.items()], last(F.col("obj_plus_pass_at_1")).alias("plus_pass_at_1"))


def pair_summary_sets(pairs: DataFrame, axes: Sequence[str] = ("user_id", "judge_model_name", "variant_label")) -> DataFrame:
    """Pair summaries for every combination of axes at once; an axis that a row sums over reads ``all``."""
    finest = pairs.groupBy(*PAIR, *axes).agg(*outcome_counts(F.col("overall")))  # each comparison is counted once, its counts are spread
    every = [F.array(F.lit("all"), F.col(c)) for c in axes]
    for c, both in zip(axes, every, strict=True):
        finest = finest.withColumn(c, F.explode(both))
    sums = ["total", *(f"n_{s}" for s in SIDES)]
    return with_rates(finest.groupBy(*PAIR, *axes).agg(*(F.sum(c).alias(c) for c in sums)))


def weighted_pair_summary(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Rates as means of each user's rates, by weights (user_id, weight) above 0."""
    per_user = pair_summary(pairs, ["user_id"]).join(weights.where("weight > 0"), "user_id")
    return per_user.groupBy(*PAIR).agg(F.sum("total").alias("total"), *(F.try_divide(F.sum(F.col("weight") * F.col(f"rate_{s}")), F.sum("weight")).alias(f"rate_{s}") for s in SIDES))


def dimension_win_rates(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outcomes of each pair and dimension; rows whose rationale is an error don't count in rates but in n_errors."""
    from quillon.functions.normalize import error_rationale

    bad = error_rationale(F.col("rationale")) if "rationale" in rows.columns else F.lit(False)
    rows = rows.withColumns({"__bad": bad, "__label": F.when(~bad, F.col("winner_label"))})
    counted = [F.count_if(~F.col("__bad")).alias("total"), *(F.count_if(F.col("__label") == s).alias(f"n_{s}") for s in SIDES), F.count_if("__bad").alias("n_errors")]
    if "confidence" in rows.columns:
        counted += [F.count_if(~F.col("__bad") & (F.col("confidence") == c)).alias(f"confidence_{c}") for c in ("low", "medium", "high")]
    if "biased" in rows.columns:
        counted += [F.count_if(~F.col("__bad") & F.col("biased")).alias("n_biased")]
    return with_rates(rows.groupBy(*keys, *PAIR, "dimension").agg(*counted))


def attempts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """(keys, flags): the attempts of each key in order; keys have as many attempts as were made, a handful."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(flag).alias("flag"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["flag"]).alias("flags"))


def pass_metrics(df: DataFrame, ks: Sequence[int] = (1, 5), flags: str = "flags") -> DataFrame:
    """Adds n_attempts, n_passed, pass_rate and, for each k, pass_at_k (unbiased) and passed_in_k."""
    c = F.col(flags)
    out = {"n_attempts": F.size(c), "n_passed": F.size(F.filter(c, lambda x: x))}
    out |= {f"pass_at_{k}": pass_at_k(c, k) for k in ks} | {f"passed_in_{k}": passed_in_k(c, k) for k in ks}
    return df.withColumns(out).withColumn("pass_rate", F.try_divide("n_passed", "n_attempts"))


def objective_outcomes(pairs: DataFrame, objective: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """pairs with pass_a and pass_b: the metric of either model for the same keys, null where unknown."""
    a = objective.select(*keys, F.col("model_name").alias("model_a"), F.col(metric).alias("pass_a"))
    b = objective.select(*keys, F.col("model_name").alias("model_b"), F.col(metric).alias("pass_b"))
    return pairs.join(a, [*keys, "model_a"], "left").join(b, [*keys, "model_b"], "left")


def flip_rates(objective: DataFrame, metric: str = "pass_at_1", least: float = 0.5) -> DataFrame:
    """How often a variant's correctness differs from the original's: flips from right, reverse flips from wrong."""
    right = objective.withColumn("ok", F.col(metric) >= least)
    base = right.where("variant_label = 'original'").select("user_id", "task_id", "model_name", F.col("ok").alias("base_ok"))
    both = right.where("variant_label <> 'original'").join(base, ["user_id", "task_id", "model_name"])
    flip, back = F.col("base_ok") & ~F.col("ok"), ~F.col("base_ok") & F.col("ok")
    rate = lambda c: F.avg(c.cast("double"))
    return both.groupBy("model_name", "variant_label").agg(F.count("*").alias("n_items"), rate(flip).alias("flip_rate"), rate(back).alias("reverse_flip_rate"), rate(flip | back).alias("change_rate"))


def sample_level(subjective: DataFrame, objective: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys that may be null, with has_objective, has_subjective and has_both."""
    s = subjective.withColumn("__s", F.lit(True))
    o = objective.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__o", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = s.join(o, on, "full_outer").withColumns({k: F.when(F.col("__s"), F.col(k)).otherwise(F.col(f"__{k}")) for k in keys})
    out = out.withColumns({"has_subjective": F.coalesce("__s", F.lit(False)), "has_objective": F.coalesce("__o", F.lit(False))})
    return out.withColumn("has_both", F.col("has_subjective") & F.col("has_objective")).drop("__s", "__o", *(f"__{k}" for k in keys))


def variant_summary(samples: DataFrame, means: Sequence[str], spreads: Sequence[str], config: Sequence[str] = ()) -> DataFrame:
    """Per user, model and variant: counts, coverage, means, and population deviations of ``spreads``."""
    keys = ["user_id", "model_name", "variant_label", *present(samples, config)]
    counts = [F.count("*").alias("sample_count"), *(F.count_if(f"has_{n}").alias(f"{n}_count") for n in ("objective", "subjective", "both"))]
    out = samples.groupBy(*keys).agg(*counts, *(F.avg(c).alias(f"{c}_mean") for c in means), *(F.stddev_pop(c).alias(f"{c}_std") for c in spreads))
    return out.withColumn("coverage_ratio", F.try_divide("both_count", "sample_count"))


def personalization_deltas(summary: DataFrame, objective: str, subjective: str) -> DataFrame:
    """Personalized minus original for every mean, and whether the subjective one rose, without objective loss."""
    means = [c for c in summary.columns if c.endswith("_mean")]
    base = summary.where("variant_label = 'original'").select("user_id", "model_name", *(F.col(c).alias(f"{c}_original") for c in means))
    own = summary.where("variant_label = 'personalized'").select("user_id", "model_name", *(F.col(c).alias(f"{c}_personalized") for c in means))
    out = own.join(base, ["user_id", "model_name"]).withColumns({f"{c}_delta": F.col(f"{c}_personalized") - F.col(f"{c}_original") for c in means})
    up = F.coalesce(f"{subjective}_mean_delta", F.lit(0.0)) > 0
    return out.withColumns({"improves_subjective": up, "boost_without_loss": up & (F.coalesce(f"{objective}_mean_delta", F.lit(0.0)) >= 0)})


def mean_of_means(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted means over groups, with summed sample counts."""
    means = [c for c in summary.columns if c.endswith("_mean")]
    return summary.groupBy(*keys).agg(F.sum("sample_count").alias("sample_count"), F.avg("coverage_ratio").alias("coverage_ratio"), *(F.avg(c).alias(c) for c in means))


def ranking_reversals(summary: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Best model by each metric for each user and variant (ties: the least name), and whether the best by objective isn't by the others."""
    best = []
    for name, metric in metrics.items():
        known = F.col(metric).isNotNull()
        top = F.array_sort(F.collect_list(F.when(known, F.struct((-F.col(metric)).alias("m"), "model_name"))))
        best.append(F.get(top, F.lit(0))["model_name"].alias(f"best_{name}"))
    out = summary.groupBy("user_id", "variant_label").agg(*best)
    others = [n for n in metrics if n != "objective"]
    return out.withColumns({f"reversal_{n}": F.coalesce(F.col("best_objective") != F.col(f"best_{n}"), F.lit(False)) for n in others})


def model_rankings(summary: DataFrame) -> DataFrame:
    """Each model's win rates over its pairs: count, mean, min, max, and rank by mean (ties: by name)."""
    sides = F.inline(F.array(F.struct(F.col("model_a").alias("model_name"), F.col("rate_model_a").alias("rate")), F.struct(F.col("model_b").alias("model_name"), F.col("rate_model_b").alias("rate"))))
    out = summary.select(sides).groupBy("model_name").agg(F.count("*").alias("n_pairs"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_rate"), "model_name")))


def preference_matrix(summary: DataFrame) -> DataFrame:
    """Long matrix (row_model, col_model, win_rate): 1/2 on the diagonal and for unplayed pairs."""
    both = F.inline(F.array(F.struct(F.col("model_a").alias("row_model"), F.col("model_b").alias("col_model"), F.col("rate_model_a").alias("rate")), F.struct(F.col("model_b").alias("row_model"), F.col("model_a").alias("col_model"), F.col("rate_model_b").alias("rate"))))
    played = summary.select(both)
    models = played.select("row_model").distinct()
    grid = models.crossJoin(models.withColumnRenamed("row_model", "col_model"))  # models x models, the result itself
    return grid.join(played, ["row_model", "col_model"], "left").select("row_model", "col_model", F.coalesce("rate", F.lit(0.5)).alias("win_rate"))


def directional(pairs: DataFrame) -> DataFrame:
    """Each comparison from both sides: row_model, col_model, outcome row/col/tie, win 0/1, score -1/0/1."""
    other = [c for c in pairs.columns if c not in PAIR]
    side = lambda row, col, won, lost: F.struct(
        F.col(row).alias("row_model"), F.col(col).alias("col_model"),
        F.when(F.col("overall") == won, "row").when(F.col("overall") == lost, "col").when(F.col("overall") == "tie", "tie").alias("outcome"),
    )
    out = pairs.select(*other, F.inline(F.array(side("model_a", "model_b", "model_a", "model_b"), side("model_b", "model_a", "model_b", "model_a"))))
    return out.withColumns({"win": (F.col("outcome") == "row").cast("int"), "score": F.when(F.col("outcome") == "row", 1).when(F.col("outcome") == "col", -1).when(F.col("outcome") == "tie", 0)})


def joint_long(rows: DataFrame, keys: Sequence[str] = ("user_id", "variant_label"), alpha: float = 0.05) -> DataFrame:
    """Wins, losses and ties of each ordered pair per persona and prompt type, win rate over all, and an exact test.

    The test counts ties as trials, as published figures do; p_value_excl_ties
    leaves them out. Equal wins and losses are never significant.
    """
    out = rows.groupBy(*keys, "row_model", "col_model").agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("row", "wins"), ("col", "losses"), ("tie", "ties"))), F.count("*").alias("total"))
    out = out.withColumns({"win_rate": F.try_divide("wins", "total"), "tie_rate": F.try_divide("ties", "total"), "p_value": binomial_p(F.col("wins"), F.col("total")), "p_value_excl_ties": binomial_p(F.col("wins"), F.col("wins") + F.col("losses"))})
    return out.withColumn("significant", F.coalesce((F.col("p_value") < alpha) & (F.col("wins") != F.col("losses")), F.lit(False)))


def weighted_joint(joint: DataFrame, weights: DataFrame) -> DataFrame:
    """Win rates of ordered pairs over personas by weight; weights of 0 or less take no part."""
    rows = joint.join(weights.where("weight > 0"), "user_id")
    return rows.groupBy("variant_label", "row_model", "col_model").agg(F.count("*").alias("n_personas"), F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("win_rate")), F.sum("weight")), F.lit(0.5)).alias("win_rate"))
