"""Agreement between judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stats import kappa

CATEGORIES = ("model_a", "model_b", "tie")


def ratings(rows: DataFrame, item: Sequence[str], judge: str, outcome: str) -> DataFrame:
    """(item keys, judge, outcome) once each; a judge with two outcomes for an item fails, null outcomes are unrated."""
    known = rows.where(F.col(outcome).isNotNull()).groupBy(*item, F.col(judge).alias("judge")).agg(F.min(outcome).alias("outcome"), F.max(outcome).alias("__max"))
    clash = F.raise_error(F.lit("a judge rated one item in two ways")).cast("string")
    return known.withColumn("outcome", F.when(F.col("outcome") == F.col("__max"), F.col("outcome")).otherwise(clash)).drop("__max")


def judge_pairs(rated: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each two judges: items both rated, share of equal outcomes, Cohen's kappa, and the same without ties.

    ``by`` are item keys to report separately. Judges meet in an equi-join on the
    item; an item has as many rows as judges.
    """
    a = rated.withColumnsRenamed({"judge": "judge_a", "outcome": "oa"})
    b = rated.withColumnsRenamed({"judge": "judge_b", "outcome": "ob"} | {k: f"__{k}" for k in item})
    on = F.col("judge_a") < F.col("judge_b")
    for k in item:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = a.join(b, on)
    n = F.count("*")
    share = lambda c, v: F.count_if(F.col(c) == v) / n
    expected = sum((share("oa", v) * share("ob", v) for v in CATEGORIES[1:]), share("oa", CATEGORIES[0]) * share("ob", CATEGORIES[0]))
    same = F.count_if(F.col("oa") == F.col("ob"))
    firm = (F.col("oa") != "tie") & (F.col("ob") != "tie")
    out = both.groupBy(*by, "judge_a", "judge_b").agg(n.alias("n_items"), (same / n).alias("percent"), kappa(same / n, expected).alias("kappa"), F.count_if(firm).alias("n_firm"), F.count_if(firm & (F.col("oa") == F.col("ob"))).alias("__firm"))
    return out.withColumn("percent_firm", F.try_divide("__firm", "n_firm")).drop("__firm")


def fleiss(rated: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fleiss' kappa over the items that all judges of a group rated."""
    judges = rated.groupBy(*by).agg(F.count_distinct("judge").alias("n_judges"))
    counts = rated.groupBy(*item).agg(F.count("*").alias("m"), *(F.count_if(F.col("outcome") == c).alias(f"n_{c}") for c in CATEGORIES))
    joined = counts.join(judges, list(by)) if by else counts.crossJoin(judges)  # one row
    full = joined.where((F.col("m") == F.col("n_judges")) & (F.col("m") > 1))
    squares = sum((F.col(f"n_{c}") * F.col(f"n_{c}") for c in CATEGORIES[1:]), F.col("n_model_a") * F.col("n_model_a"))
    agreed = F.avg((squares - F.col("m")) / (F.col("m") * (F.col("m") - 1)))
    shares = [F.sum(f"n_{c}") / F.sum("m") for c in CATEGORIES]
    chance = shares[0] * shares[0] + shares[1] * shares[1] + shares[2] * shares[2]
    return full.groupBy(*by).agg(F.first("n_judges").alias("n_judges"), F.count("*").alias("n_items"), agreed.alias("observed"), chance.alias("chance"), kappa(agreed, chance).alias("fleiss_kappa"))


def majority(rated: DataFrame, item: Sequence[str]) -> DataFrame:
    """Each item's commonest outcome, null if two lead; how many judges rated it, and by how many it isn't unanimous."""
    counts = rated.groupBy(*item, "outcome").agg(F.count("*").alias("n"))
    out = counts.groupBy(*item).agg(F.sum("n").alias("n_judges"), F.max("n").alias("top"), F.count("*").alias("n_outcomes"), F.max(F.struct("n", "outcome")).alias("best"), F.min(F.struct(-F.col("n"), "outcome")).alias("other"))
    alone = F.col("best.outcome") == F.col("other.outcome")
    return out.select(*item, "n_judges", (F.col("n_outcomes") - 1).alias("n_disagreeing"), F.when(alone, F.col("best.outcome")).alias("winner"))


def ranking_stability(pairs: DataFrame, judge: str = "judge_model_name") -> tuple[DataFrame, DataFrame]:
    """(ranks, correlations): models by mean win probability for each judge, and Spearman's rho for each two judges."""
    from quillon.operators.aggregate import pair_summary

    summary = pair_summary(pairs, [judge])
    sides = F.inline(F.array(F.struct(F.col("model_a").alias("model_name"), F.col("win_prob").alias("p")), F.struct(F.col("model_b").alias("model_name"), (1 - F.col("win_prob")).alias("p"))))
    means = summary.select(judge, sides).groupBy(judge, "model_name").agg(F.avg("p").alias("win_prob"))
    by = Window.partitionBy(judge)
    ranks = means.withColumn("rank", F.dense_rank().over(by.orderBy(F.desc("win_prob"))))
    middle = ranks.withColumn("r", F.rank().over(by.orderBy("rank")) + (F.count("*").over(Window.partitionBy(judge, "rank")) - 1) / 2)
    a = middle.select(F.col(judge).alias("judge_a"), "model_name", F.col("r").alias("ra"))
    b = middle.select(F.col(judge).alias("judge_b"), "model_name", F.col("r").alias("rb"))
    both = a.join(b, "model_name").where("judge_a < judge_b")
    spread = F.stddev_pop("ra") * F.stddev_pop("rb")
    rho = both.groupBy("judge_a", "judge_b").agg(F.count("*").alias("n_models"), F.when(spread > 0, F.covar_pop("ra", "rb") / spread).alias("spearman"))
    return ranks, rho


def agreement_kinds(agreed: DataFrame, human_prefixes: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (0 for one pair) of judge-pair agreement by kind of pair: llm_llm, human_human, human_llm."""
    human = lambda c: _starts(c, human_prefixes)
    kind = F.when(human("judge_a") & human("judge_b"), "human_human").when(human("judge_a") | human("judge_b"), "human_llm").otherwise("llm_llm")
    spread = lambda c: F.when(F.count(c) <= 1, 0.0).otherwise(F.stddev_samp(c))
    return agreed.groupBy(kind.alias("pair_type")).agg(F.count("*").alias("n_pairs"), F.sum("n_items").alias("n_items"), F.avg("percent").alias("percent_mean"), spread("percent").alias("percent_std"), F.avg("kappa").alias("kappa_mean"), spread("kappa").alias("kappa_std"))


def _starts(column: str, prefixes: Sequence[str]):
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(column).startswith(p)
    return out


def judge_win_rates(rated: DataFrame, by: Sequence[str] = (), won: str = "model_a") -> DataFrame:
    """Over judges: mean, sample deviation (null for one judge), least and largest share of items that each gave to one side."""
    each = rated.groupBy(*by, "judge").agg(F.avg((F.col("outcome") == won).cast("double")).alias("r"), F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.avg("r").alias("judge_win_rate_mean"), F.stddev_samp("r").alias("judge_win_rate_std"), F.min("r").alias("judge_win_rate_min"), F.max("r").alias("judge_win_rate_max"), F.count("*").alias("n_judges"), F.avg("n").alias("items_per_judge_mean"))


def tables(rated: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row for each condition ``by`` (keys of the item): items, judges, pairs and their overlap, mean agreement over pairs, win rates by judge, Fleiss' kappa.

    A condition with one judge has its counts and win rates, and nulls else.
    """
    items = rated.groupBy(*item).agg(F.count("*").alias("__m")).groupBy(*by).agg(F.count("*").alias("n_items"))
    pairs = judge_pairs(rated, item, by).groupBy(*by).agg(
        F.count("*").alias("n_judge_pairs"), F.avg("n_items").alias("overlap_mean"), F.min("n_items").alias("overlap_min"), F.avg("percent").alias("percent_mean"), F.stddev_samp("percent").alias("percent_std"), F.avg("kappa").alias("kappa_mean")
    )
    whole = fleiss(rated, item, by).select(*by, "fleiss_kappa", F.col("n_items").alias("fleiss_items"))
    out = items
    for part in (judge_win_rates(rated, by), pairs, whole):
        out = out.join(part, list(by), "left") if by else out.crossJoin(part)  # one row each
    return out.withColumns({"n_judge_pairs": F.coalesce("n_judge_pairs", F.lit(0).cast("bigint")), "fleiss_items": F.coalesce("fleiss_items", F.lit(0).cast("bigint"))})


def weighted(rows: DataFrame, by: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Weighted means and population deviations; a null value, and a weight of 0 or less, takes no part. One value alone has deviation 0."""
    out = []
    for v in values:
        w = F.when(F.col(v).isNotNull() & (F.col(weight) > 0), F.col(weight)).cast("double")
        mean = F.try_divide(F.sum(w * F.col(v)), F.sum(w))
        square = F.try_divide(F.sum(w * F.col(v) * F.col(v)), F.sum(w))
        out += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"{v}_std")]
    return rows.groupBy(*by).agg(*out)


def pooled(rated: DataFrame, item: Sequence[str], condition: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Agreement over conditions, each weighing as many items as it has; ``by`` are keys of the condition to report separately."""
    each = tables(rated, item, condition)
    sums = each.groupBy(*by).agg(F.count("*").alias("n_conditions"), F.sum("n_items").alias("n_items"), F.max("n_judge_pairs").alias("n_judge_pairs"), F.min("overlap_min").alias("overlap_min"))
    means = weighted(each.select(*by, "n_items", F.col("percent_mean").alias("percent"), F.col("kappa_mean").alias("kappa"), F.col("fleiss_kappa").alias("fleiss")), by, ["percent", "kappa", "fleiss"], "n_items")
    return sums.join(means, list(by)) if by else sums.crossJoin(means)  # one row each


def across_conditions(each: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean and sample deviation of condition tables."""
    spread = lambda c: [F.avg(c).alias(f"{c}_mean"), F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0).alias(f"{c}_std")]
    return each.groupBy(*by).agg(F.count("*").alias("n_conditions"), *[x for c in ("percent_mean", "kappa_mean", "fleiss_kappa") for x in spread(c)])


def intervals(rated: DataFrame, item: Sequence[str], by: Sequence[str], resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bootstrap intervals over items of each condition's mean agreement, mean kappa and Fleiss' kappa; null for one item.

    Items that all judges rated alike are one pattern, so that a condition reaches
    Python as a few counted patterns; drawing patterns by their shares is drawing
    items. Each condition has its own generator, seeded by its key.
    """
    import zlib

    schema = ", ".join([*(f"{k} string" for k in by), *(f"{n}_{e} double" for n in ("percent", "kappa", "fleiss") for e in ("low", "high"))])

    def draw(pdf):
        import numpy as np
        import pandas as pd

        name = [str(pdf[k].iloc[0]) for k in by]
        rng = np.random.default_rng(zlib.crc32("|".join([str(seed), *name]).encode()))
        patterns = [dict(x.split("=", 1) for x in p.split("\x1f")) for p in pdf["pattern"]]
        counts = pdf["n"].to_numpy()
        judges = sorted({j for p in patterns for j in p})
        n = int(counts.sum())
        empty = [None] * 6
        if n < 2 or len(judges) < 2:
            return pd.DataFrame([[*name, *empty]], columns=schema_names)
        drawn = rng.multinomial(n, counts / n, size=resamples)
        percents, kappas = [], []
        for i, a in enumerate(judges):
            for b in judges[i + 1 :]:
                cells = np.zeros((len(patterns), 3, 3))
                for row, p in enumerate(patterns):
                    if a in p and b in p:
                        cells[row, CATEGORIES.index(p[a]), CATEGORIES.index(p[b])] = 1
                met = np.tensordot(drawn, cells, axes=1)
                total = met.sum(axis=(1, 2))
                with np.errstate(all="ignore"):
                    same = np.trace(met, axis1=1, axis2=2) / total
                    chance = (met.sum(axis=2) * met.sum(axis=1)).sum(axis=1) / total**2
                    kappas.append(np.where(np.abs(1 - chance) > 1e-12, (same - chance) / (1 - chance), np.nan))
                percents.append(same)
        whole = np.array([len(p) == len(judges) for p in patterns])
        rates = np.array([[list(p.values()).count(c) for c in CATEGORIES] for p in patterns], float)
        m = len(judges)
        with np.errstate(all="ignore"):
            full = rng.multinomial(int(counts[whole].sum()), counts[whole] / counts[whole].sum(), size=resamples) if counts[whole].sum() > 1 else np.zeros((resamples, int(whole.sum())))
            items = full.sum(axis=1)
            agreed = full @ (((rates[whole] ** 2).sum(axis=1) - m) / (m * (m - 1))) / items
            shares = full @ rates[whole] / (items * m)[:, None]
            chance = (shares**2).sum(axis=1)
            fleiss_values = np.where(np.abs(1 - chance) > 1e-12, (agreed - chance) / (1 - chance), np.nan)
        out = []
        for values in (np.nanmean(percents, axis=0), np.nanmean(kappas, axis=0), fleiss_values):
            known = values[~np.isnan(values)]
            out += [None, None] if not len(known) else np.percentile(known, [50 * (1 - level), 50 * (1 + level)]).tolist()
        return pd.DataFrame([[*name, *out]], columns=schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    ratings_of = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "judge", "outcome"))), "\x1f")
    patterns = rated.groupBy(*item).agg(ratings_of.alias("pattern")).groupBy(*by, "pattern").agg(F.count("*").alias("n"))
    return patterns.groupBy(*by).applyInPandas(draw, schema)


def long_winners(rated: DataFrame, item: Sequence[str]) -> DataFrame:
    """Every item by every judge, with a null outcome where there is none. Judges are a few."""
    items, judges = rated.select(*item).distinct(), rated.select("judge").distinct()
    grid = items.crossJoin(judges)  # the result itself
    return grid.join(rated, [*item, "judge"], "left")


def wide_winners(rated: DataFrame, item: Sequence[str], judges: Sequence[str]) -> DataFrame:
    """A column for each judge named, beside the majority's winner."""
    wide = rated.groupBy(*item).pivot("judge", list(judges)).agg(F.first("outcome"))
    return majority(rated, item).join(wide, list(item))


def judge_overview(ranks: DataFrame, judge: str = "judge_model_name") -> DataFrame:
    """The model that most judges rank first (ties: the least name), and by what share of judges."""
    first = ranks.where("rank = 1").groupBy(judge).agg(F.min("model_name").alias("model_name"))
    counts = first.groupBy("model_name").agg(F.count("*").alias("n"))
    total = first.agg(F.count("*").alias("n_judges"))
    top = counts.agg(F.max_by("model_name", F.struct("n", F.transform(F.split("model_name", ""), lambda c: -F.ascii(c)))).alias("top_model"), F.max("n").alias("n"))
    return top.crossJoin(total).select("top_model", "n_judges", F.try_divide("n", "n_judges").alias("top_share"))  # one row each
