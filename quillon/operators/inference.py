"""Tests over paired items: sign-flip permutation, bootstrap intervals, false-discovery control."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTRASTS = (("personalized", "original"), ("control", "original"), ("personalized", "control"))


def item_deltas(rows: DataFrame, keys: Sequence[str] = ("user_id", "row_model", "col_model")) -> DataFrame:
    """Mean win and score of each item and variant, paired across variants: (keys, task_id, contrast, delta_w, delta_s)."""
    means = rows.groupBy(*keys, "task_id", "variant_label").agg(F.avg("win").alias("w"), F.avg("score").alias("s"))
    wide = means.groupBy(*keys, "task_id").pivot("variant_label", ["original", "personalized", "control"]).agg(F.first("w").alias("w"), F.first("s").alias("s"))
    made = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(f"{a}_w") - F.col(f"{b}_w")).alias("delta_w"), (F.col(f"{a}_s") - F.col(f"{b}_s")).alias("delta_s")) for a, b in CONTRASTS])
    return wide.select(*keys, "task_id", F.inline(made)).where("delta_w is not null")


def delta_means(deltas: DataFrame, keys: Sequence[str] = ("user_id", "row_model", "col_model")) -> DataFrame:
    return deltas.groupBy(*keys, "contrast").agg(F.count("*").alias("n_items"), F.avg("delta_w").alias("mean_w"), F.avg("delta_s").alias("mean_s"))


def paired_tests(deltas: DataFrame, keys: Sequence[str] = ("user_id", "row_model", "col_model"), permutations: int = 10_000, resamples: int = 2_000, seed: int = 42, margin: float = 0.05) -> DataFrame:
    """Mean win delta of each group and contrast, bootstrap interval, sign-flip p value and equivalence within +-margin.

    Items are first counted by distinct delta, so a group reaches Python as a
    histogram of a few rows however many items it has; each group's generator is
    seeded by the crc32 of its key, so that order and partitioning don't matter.
    The interval is drawn before the permutations.
    """
    schema = ", ".join([*(f"{k} string" for k in keys), "contrast string, n_items long, mean_w double, ci_low double, ci_high double, p_value double, equivalent boolean"])

    def test(pdf):
        import numpy as np
        import pandas as pd

        name = [str(pdf[k].iloc[0]) for k in (*keys, "contrast")]
        rng = np.random.default_rng(zlib.crc32("|".join([str(seed), *name]).encode()))
        values, counts = pdf["delta"].to_numpy(), pdf["n"].to_numpy()
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        n, mean = int(counts.sum()), float((values * counts).sum() / counts.sum())
        drawn = rng.multinomial(n, counts / n, size=resamples) @ values / n
        low, high = (mean, mean) if n == 1 else np.percentile(drawn, [2.5, 97.5])
        sums = np.zeros(permutations)
        for v, c in zip(values, counts, strict=True):  # the sum of c signs is 2 * Binomial(c, 1/2) - c
            sums += v * (2 * rng.binomial(c, 0.5, size=permutations) - c)
        extreme = int((np.abs(sums) >= abs(mean * n) - 1e-12).sum())
        p = 1.0 if np.allclose(values, 0) else (extreme + 1) / (permutations + 1)
        return pd.DataFrame([[*name, n, mean, float(low), float(high), p, bool(low >= -margin and high <= margin)]], columns=[*keys, "contrast", "n_items", "mean_w", "ci_low", "ci_high", "p_value", "equivalent"])

    counted = deltas.groupBy(*keys, "contrast", F.round("delta_w", 12).alias("delta")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys, "contrast").applyInPandas(test, schema)


def bh_qvalues(df: DataFrame, by: Sequence[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q values within groups; null p values get null and don't count."""
    known = Window.partitionBy(*by, F.col(p).isNull())
    rank, m = F.row_number().over(known.orderBy(p)), F.count(p).over(known)
    raw = df.withColumns({"__rank": rank, "__m": m}).withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    tail = known.orderBy("__rank").rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(tail)))).drop("__rank", "__m", "__raw")


def proportion_intervals(df: DataFrame, k: str, n: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Adds Clopper-Pearson and bootstrap intervals of k of n."""
    from collections.abc import Iterator

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            ks, ns = pdf[k].to_numpy(), pdf[n].to_numpy()
            exact = [clopper_pearson(int(a), int(b), level) if b else (None, None) for a, b in zip(ks, ns, strict=True)]
            boots = [np.percentile(np.random.default_rng(seed).binomial(b, a / b, resamples) / b, [50 * (1 - level), 50 * (1 + level)]) if b else (None, None) for a, b in zip(ks, ns, strict=True)]
            yield pdf.assign(exact_low=[x[0] for x in exact], exact_high=[x[1] for x in exact], boot_low=[x[0] for x in boots], boot_high=[x[1] for x in boots])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, exact_low double, exact_high double, boot_low double, boot_high double")


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion, by halving on the binomial tails.

    A tail is an incomplete beta function, whose continued fraction takes some
    sqrt(n) steps where the sum of its terms takes n.
    """
    from math import exp, lgamma, log, log1p

    def beta(a: int, b: int, x: float) -> float:
        """I_x(a, b), the chance of at least a successes in a + b - 1 trials."""
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1.0 - beta(b, a, 1.0 - x)
        least = 1e-300
        c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or least)
        value, m, step = d, 0, 0.0
        while abs(step - 1.0) > 1e-15 and m < 100 + 20 * (a + b) ** 0.5:
            m += 1
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                c, d = (1.0 + term / c) or least, 1.0 / ((1.0 + term * d) or least)
                step = c * d
                value *= step
        return value / a * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))

    def solve(tail, rising: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (tail(mid) < (1 - level) / 2) == rising else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: beta(k, n - k + 1, p), True)
    return low, 1.0 if k == n else solve(lambda p: beta(n - k, k + 1, 1 - p), False)
