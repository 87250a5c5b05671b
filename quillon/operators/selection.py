"""Choosing rows: equality, allow and deny lists, length limits, exact types, verification, tags, judges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.schema import DIMENSIONS

#: Older names of dimensions.
OLDER_DIMENSIONS = {"efficiency": "workflow_fit", "frustration": "friction_loss_of_control"}
Selector = Mapping[str, Sequence[str]]


def equal_to(df: DataFrame, values: Mapping[str, str | None], strict: bool = True) -> DataFrame:
    """Rows with the given values, those that are None left out; no row at all is an error if ``strict``."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if strict and df.isEmpty():
        raise ValueError(f"no row has {dict(values)}")
    return df


def omitted(tokens: Sequence[str | None]) -> tuple[set[str], set[str]]:
    """(dimensions, subj_ columns) that tokens name: older names and - for _ are allowed, other tokens are ignored."""
    dims, columns = set(), set()
    for raw in tokens:
        name = (raw or "").strip().lower().replace("-", "_")
        if name.startswith("subj_"):
            columns.add(name)
        base = OLDER_DIMENSIONS.get(name.removeprefix("subj_"), name.removeprefix("subj_"))
        if base in DIMENSIONS:
            dims.add(base)
            if not name.startswith("subj_"):
                columns.add(f"subj_{base}")
    return dims, columns


def without_dimensions(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Drops what tokens name: rows of a long table, entries of maps by dimension, and columns dim_<d>_* and subj_<d>."""
    dims, columns = omitted(tokens)
    if "dimension" in df.columns:
        df = df.where(~F.col("dimension").isin(*dims)) if dims else df
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map" and f.dataType.keyType.typeName() == "string"]
    df = df.withColumns({m: F.map_filter(m, lambda k, v: ~k.isin(*dims, *columns)) for m in maps}) if dims or columns else df
    return df.drop(*[c for c in df.columns if c in columns or any(c.startswith(f"dim_{d}_") for d in dims)])


def matches(selector: Selector) -> Column:
    """Whether a row's fields, as trimmed lower-case text, are among the selector's values."""
    out = F.lit(True)
    for field, values in sorted(selector.items()):
        own = F.lower(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))))
        out = out & own.isin(*[str(v).strip().lower() for v in ([values] if isinstance(values, str) else values)])
    return out


def label_of(selector: Selector) -> str:
    return "|".join(f"{k}={','.join(sorted(str(v).strip().lower() for v in ([vs] if isinstance(vs, str) else vs)))}" for k, vs in sorted(selector.items()))


def exact_types(df: DataFrame, selectors: Sequence[Selector]) -> DataFrame:
    """Rows of one of the types; a type without a row is an error. ``sample_type`` names the first that fits."""
    out = df.withColumn("sample_type", F.coalesce(*[F.when(matches(s), label_of(s)) for s in selectors])).where("sample_type is not null")
    found = {r[0] for r in out.select("sample_type").distinct().collect()}  # no more rows than selectors
    if missing := sorted({label_of(s) for s in selectors} - found):
        raise ValueError(f"no row is of type {missing}")
    return out


def longest_output(default: int | None, overrides: Sequence[tuple[Selector, int | None]]) -> Column:
    """The limit of each row: that of the last override that fits, else the default; null is none."""
    out = F.lit(default).cast("int")
    for selector, limit in overrides:
        out = F.when(matches(selector), F.lit(limit).cast("int")).otherwise(out)
    return out


def rejection(allow: Selector, deny: Selector, limit: Column | None = None, no_ties: bool = False, no_dimension_ties: bool = False) -> Column:
    """The first reason against a candidate: allow:<field>, deny:<field>, max_output_chars, overall_tie, dimension_tie; null for none."""
    reasons = [F.when(~matches({f: v}), f"allow:{f}") for f, v in allow.items()] + [F.when(matches({f: v}), f"deny:{f}") for f, v in deny.items()]
    if limit is not None:
        reasons.append(F.when(F.greatest(F.length("model_a_output"), F.length("model_b_output")) > limit, "max_output_chars"))
    if no_ties:
        reasons.append(F.when(F.lower(F.coalesce("overall", F.lit("none"))).isin("", "none", "tie"), "overall_tie"))
    if no_dimension_ties:
        reasons.append(F.when(F.exists(F.map_values("winners"), lambda w: F.coalesce(w, F.lit("tie")) == "tie"), "dimension_tie"))
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def unverified(label: Column, verification: Column) -> Column:
    """Whether a unit is to be skipped: personalized, with a verification that failed. A verification with one answer only fails."""
    goal, truth = verification["same_end_goal"], verification["same_ground_truth"]
    partial = F.raise_error(F.lit("a verification lacks an answer")).cast("boolean")
    failed = F.when(goal.isNull() & truth.isNull(), False).when(goal.isNull() | truth.isNull(), partial).otherwise(~(goal & truth))
    return F.when((label == "personalized") & verification.isNotNull(), failed).otherwise(False)


def with_human_items(rows: DataFrame, item: Sequence[str], judge: str = "judge_model_name", prefix: str = "human_") -> DataFrame:
    """Rows of items that a person judged."""
    human = rows.where(F.col(judge).startswith(prefix)).select(*item).distinct()
    return rows.join(human, list(item), "left_semi")


def by_confidence(rows: DataFrame, item: Sequence[str], levels: Sequence[str], judge: str = "judge_model_name", confidence: str = "confidence", prefix: str = "human_") -> DataFrame:
    """Rows of items that a person judged with one of these confidences."""
    sure = rows.where(F.col(judge).startswith(prefix) & F.lower(confidence).isin(*[x.lower() for x in levels])).select(*item).distinct()
    return rows.join(sure, list(item), "left_semi")


def within_group(agreed: DataFrame, judges: Sequence[str]) -> DataFrame:
    return agreed.where(F.col("judge_a").isin(*judges) & F.col("judge_b").isin(*judges))


def between_groups(agreed: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    a, b = F.col("judge_a"), F.col("judge_b")
    return agreed.where((a.isin(*first) & b.isin(*second)) | (a.isin(*second) & b.isin(*first)))


def tagged(tasks: DataFrame, models: Sequence[str] | None = None, personas: Sequence[str] | None = None) -> DataFrame:
    """Tasks of models and personas that carry a tag.

    Tasks have stage, model (``a_vs_b`` for pairs) and persona; stages without a
    model stay whatever the models. Both models of a pair must be named.
    """
    out = tasks
    if models is not None:
        named = F.size(F.array_except(F.split("model", "_vs_"), F.array(*map(F.lit, models)).cast("array<string>"))) == 0
        out = out.where(F.col("model").isNull() | F.col("stage").isin("dataset", "analyze") | named)
    if personas is not None:
        out = out.where(F.col("persona").isNull() | F.col("persona").isin(*personas))
    return out


def carriers(catalog: DataFrame, tags: Sequence[str], name: str = "name") -> list[str]:
    """Names in a catalog (name, tags) that have one of the tags; a catalog is configuration, a few rows."""
    return sorted(r[0] for r in catalog.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select(name).collect())


def task_numbers(spec: str) -> list[int]:
    """``1,3-5,8`` as numbers, ascending."""
    out: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        lo, dash, hi = part.partition("-")
        first, last = int(lo), int(hi) if dash else int(lo)
        if last < first:
            raise ValueError(f"a range ends before it starts: {part}")
        out |= set(range(first, last + 1))
    return sorted(out)
