"""Exact statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(flags: Column, k: int) -> Column:
    """Unbiased 1 - C(n-c,k) / C(n,k) of boolean attempts; 0 without attempts or passes, 1 where fewer than k failed."""
    n, c = F.size(flags), F.size(F.filter(flags, lambda x: x))
    fails = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / F.greatest(n - i, F.lit(1)))
    return F.when((n == 0) | (c == 0), 0.0).when((n < k) | (n - c < k), 1.0).otherwise(1.0 - fails)


def passed_in_k(flags: Column, k: int) -> Column:
    """1 if one of the first k attempts passed."""
    return F.exists(F.slice(flags, 1, max(1, k)), lambda x: x).cast("double")


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided test of k of n against 1/2: twice the smaller tail, 1 at most; null without trials."""
    k, n = k.cast("long"), n.cast("long")
    low = F.least(k, n - k)
    start = F.struct(F.lit(0.0).alias("term"), F.lit(1.0).alias("total"))
    # log C(n, i) grows from C(n, 0); the tail is summed relative to its largest term, C(n, low).
    logs = F.when(low > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), low), F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))).otherwise(0.0)
    steps = F.when(low > 0, F.sequence(low, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, lambda s, i: F.struct((s["term"] + F.log(i / (n - i + 1))).alias("term"), (s["total"] + F.exp(s["term"] + F.log(i / (n - i + 1)))).alias("total")))["total"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(logs - n * math.log(2.0)) * tail))


def kappa(observed: Column, expected: Column) -> Column:
    """Chance-corrected agreement; null where chance alone agrees."""
    return F.when(F.abs(1 - expected) > 1e-12, (observed - expected) / (1 - expected))
