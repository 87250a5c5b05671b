"""Benchmarks, personalized samples and their prompts: adapters, hooks, control prompts, comparison inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a unified benchmark row.
UNIFIED = ("benchmark", "task_id", "prompt", "ground_truth", "language", "difficulty", "inputs", "tests", "metadata")
VARIATION = "struct<variation_id:string,applied_changes:array<string>,modified_prompt:string,prompt_type:string,variant_label:string,verification:struct<same_end_goal:boolean,same_ground_truth:boolean>>"


def _col(df: DataFrame, path: str) -> Column:
    """A column or a field of a struct column; null where the table has none."""
    head, _, field = path.partition(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    if field and (df.schema[head].dataType.typeName() != "struct" or field not in df.schema[head].dataType.names):
        return F.lit(None).cast("string")
    return F.col(f"`{head}`.`{field}`") if field else F.col(f"`{head}`")


def _first(*paths: str) -> Callable[[DataFrame], Column]:
    """The first path that isn't null, as text; 0 is a value."""
    return lambda df: F.coalesce(*[_col(df, p).cast("string") for p in paths])


def _filled(*paths: str) -> Callable[[DataFrame], Column]:
    """The first path that is neither null nor empty, as text."""
    return lambda df: F.coalesce(*[F.nullif(_col(df, p).cast("string"), F.lit("")) for p in paths])


def _json(**fields: str) -> Callable[[DataFrame], Column]:
    """A JSON object of paths, null ones included."""
    return lambda df: F.to_json(F.struct(*[_col(df, p).alias(n) for n, p in fields.items()]), {"ignoreNullFields": "false"})


def _rest(*known: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in known]), {"ignoreNullFields": "false"})


def last_function(code: Column) -> Column:
    """The last function that a program defines at its top level."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(code, F.lit(r"(?m)^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))), -1)


def _plus_tests(df: DataFrame) -> Column:
    return F.to_json(F.struct(_col(df, "test").alias("test"), last_function(_col(df, "code")).alias("entry_point")), {"ignoreNullFields": "false"})


def _solutions(df: DataFrame) -> Column:
    return F.get(F.col("solutions"), F.lit(0)) if "solutions" in df.columns else F.lit(None).cast("string")


_PYTHON: Callable[[DataFrame], Column] = lambda df: F.lit("python")
#: Where each benchmark keeps what a unified row holds.
ADAPTERS: dict[str, Mapping[str, Callable[[DataFrame], Column]]] = {
    "humaneval": {"task_id": _first("task_id"), "prompt": _first("prompt"), "ground_truth": _first("canonical_solution"), "language": _PYTHON, "tests": _json(test="test"), "metadata": _json(entry_point="entry_point")},
    "mbpp": {"task_id": _filled("task_id", "id"), "prompt": _filled("text", "prompt"), "ground_truth": _first("code"), "language": _PYTHON, "tests": _json(test_list="test_list", test="test")},
    "mbpp_sanitized": {"task_id": _filled("task_id", "id"), "prompt": _filled("text", "prompt"), "ground_truth": _first("code"), "language": _PYTHON, "tests": _json(test_list="test_list", test="test")},
    "mbpp_plus": {"task_id": _filled("task_id", "id"), "prompt": _first("prompt"), "ground_truth": _first("code"), "language": _PYTHON, "tests": _plus_tests, "metadata": _json(source_file="source_file", test_imports="test_imports", original_test_list="test_list", prompt_tests="test_list")},
    "humaneval_plus": {"task_id": _first("task_id"), "prompt": _first("prompt"), "ground_truth": _first("canonical_solution"), "language": _PYTHON, "tests": _json(test="test", entry_point="entry_point"), "metadata": _json(entry_point="entry_point")},
    "apps": {"task_id": _filled("problem_id", "id"), "prompt": _first("question"), "ground_truth": _solutions, "language": _PYTHON, "difficulty": _first("difficulty"), "inputs": _first("input_output"), "metadata": _json(solutions="solutions")},
    "ds1000": {"task_id": _first("metadata.id", "id", "problem_id", "metadata.problem_id", "metadata.instance_id", "instance_id"), "prompt": _first("prompt"), "language": _PYTHON, "metadata": _json(metadata="metadata"), "tests": _json(code_context="code_context")},
    "swe_bench_verified": {"task_id": _first("instance_id"), "prompt": _first("problem_statement"), "ground_truth": _first("patch"), "language": _PYTHON, "difficulty": _first("difficulty"), "metadata": _json(repo="repo", base_commit="base_commit", version="version", created_at="created_at", difficulty="difficulty"), "tests": _json(test_patch="test_patch", FAIL_TO_PASS="FAIL_TO_PASS", PASS_TO_PASS="PASS_TO_PASS")},
    "bigcodebench": {"task_id": _filled("task_id", "id"), "prompt": _first("prompt"), "ground_truth": _first("canonical_solution"), "language": _first("language"), "metadata": _rest("task_id", "prompt", "language")},
    "humaneval_x": {"task_id": _first("task_id"), "prompt": _first("prompt"), "ground_truth": _first("canonical_solution"), "tests": _json(test="test"), "metadata": _json(entry_point="entry_point")},
    "mbxp": {"task_id": _filled("task_id", "id"), "prompt": _first("prompt"), "ground_truth": _first("canonical_solution"), "tests": _json(test="test"), "metadata": _json(source="source")},
    "codexglue_code_to_text": {"task_id": _filled("id"), "prompt": _filled("code", "func_code_string"), "ground_truth": _filled("docstring", "func_documentation_string")},
    "codexglue_text_to_code": {"task_id": _filled("id"), "prompt": _first("nl"), "ground_truth": _first("code"), "language": lambda df: F.coalesce(_filled("language")(df), F.lit("python"))},
    "codexglue_code_to_code_trans": {"task_id": _filled("id"), "prompt": _first("code"), "ground_truth": _first("target"), "language": _filled("lang", "src_lang"), "metadata": _json(target_lang="tgt_lang")},
    "codesearchnet_docs": {"task_id": _filled("id"), "prompt": _filled("docstring", "text"), "ground_truth": _first("code"), "language": _first("language"), "metadata": _json(repo="repo", func_name="func_name")},
}
#: Benchmarks whose language is a choice of the reader, not a field.
BY_LANGUAGE = ("humaneval_x", "mbxp", "codexglue_code_to_text")


def adapted(benchmark: str, rows: DataFrame, language: str = "python") -> DataFrame:
    """A benchmark's rows with the unified columns, all text; what a benchmark doesn't hold is null, a missing id empty where it must not be null."""
    if benchmark not in ADAPTERS:
        raise ValueError(f"unknown benchmark: {benchmark}")
    known = ADAPTERS[benchmark]
    out = {c: known[c](rows).cast("string") if c in known else F.lit(None).cast("string") for c in UNIFIED[1:]}
    if benchmark in BY_LANGUAGE:
        out["language"] = F.lit(language)
    return rows.select(F.lit(benchmark).alias("benchmark"), *(c.alias(n) for n, c in out.items()))


def load(rows: DataFrame, keep: Column | None = None, change: Callable[[DataFrame], DataFrame] | None = None, fields: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The loader's hooks in their order: filter, change, fields, limit."""
    out = rows if keep is None else rows.where(keep)
    out = out if change is None else out.transform(change)
    out = out.select(*fields) if fields else out
    return out if limit is None else out.limit(limit)


def unified(parts: Mapping[str, DataFrame], language: str = "python") -> DataFrame:
    """Several benchmarks as one table."""
    out = None
    for name, rows in parts.items():
        own = adapted(name, rows, language)
        out = own if out is None else out.unionByName(own)
    return out


def control_prompts(raw: DataFrame) -> DataFrame:
    """(source_benchmark, sample_id, controls) of rows (benchmark, position, task_id, prompt, variation_count); a row without task or prompt fails."""
    task = F.when(F.col("task_id").isNotNull(), F.col("task_id").cast("string")).otherwise(F.raise_error(F.lit("a control prompt has no task_id")).cast("string"))
    prompt = F.when(F.coalesce(F.col("prompt"), F.lit("")) != "", F.col("prompt")).otherwise(F.raise_error(F.lit("a control prompt has no text")).cast("string"))
    made = F.struct(
        F.concat(F.lit("control_"), F.coalesce(F.col("variation_count").cast("string"), F.lit("unknown"))).alias("variation_id"), F.array().cast("array<string>").alias("applied_changes"), prompt.alias("modified_prompt"), F.lit("control").alias("prompt_type"),
        F.lit("control").alias("variant_label"), F.struct(F.lit(True).alias("same_end_goal"), F.lit(True).alias("same_ground_truth")).alias("verification"),
    )
    rows = raw.select(F.col("benchmark").alias("source_benchmark"), task.alias("sample_id"), F.struct("position", made.alias("v")).alias("c"))
    return rows.groupBy("source_benchmark", "sample_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["v"]).alias("controls"))


def with_controls(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """Samples with as many control variations behind their own as they have of these, or as there are."""
    out = samples.join(controls, ["source_benchmark", "sample_id"], "left")
    own = F.coalesce("variations", F.array().cast(f"array<{VARIATION}>"))
    none = F.array().cast(f"array<{VARIATION}>")
    more = F.when(F.size(own) > 0, F.slice(F.coalesce("controls", none), F.lit(1), F.size(own))).otherwise(none)
    return out.withColumn("variations", F.concat(own, more)).drop("controls")


def units(samples: DataFrame) -> DataFrame:
    """One row for the original and for each variation of a sample: unit_id, variant_label, prompt, verification."""
    original = F.struct(F.col("sample_id").alias("unit_id"), F.lit("original").alias("variant_label"), F.col("prompt").alias("unit_prompt"), F.lit(None).cast("struct<same_end_goal:boolean,same_ground_truth:boolean>").alias("verification"))
    varied = F.transform(F.coalesce("variations", F.array().cast(f"array<{VARIATION}>")), lambda v: F.struct(F.concat("sample_id", F.lit("::variation::"), v["variation_id"]).alias("unit_id"), F.coalesce(v["variant_label"], F.lit("personalized")).alias("variant_label"), v["modified_prompt"].alias("unit_prompt"), v["verification"].alias("verification")))
    return samples.select(*[c for c in samples.columns if c not in ("variations", "prompt")], F.inline(F.concat(F.array(original), varied)))


def backfilled(primary: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs with those of a reference persona, original and control only, where the primary has none."""
    shared = reference.where(F.col("variant_label").isin("original", "control"))
    return primary.unionByName(shared.join(primary.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def comparison_inputs(a: DataFrame, b: DataFrame, prompts: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Outputs (sample_id, output) of two models for the samples that both have, with their prompt; without one and without a fallback it fails."""
    missing = F.raise_error(F.concat(F.lit("no prompt for "), "sample_id")).cast("string") if fallback is None else fallback
    both = a.select("sample_id", F.col("output").alias("model_a_output")).join(b.select("sample_id", F.col("output").alias("model_b_output")), "sample_id")
    return both.join(prompts.select("sample_id", F.col("prompt").alias("__p")), "sample_id", "left").withColumn("input_text", F.coalesce("__p", missing)).drop("__p")


def overlap(a: DataFrame, b: DataFrame, by: str = "prompt_type") -> DataFrame:
    """For each prompt type: sample ids that both models have, and those that only one has."""
    x, y = (df.select("sample_id", by).distinct().withColumn(n, F.lit(1)) for df, n in ((a, "a"), (b, "b")))
    met = x.join(y, ["sample_id", by], "full_outer")
    return met.groupBy(by).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b"))


def experiment_tasks(spark: SparkSession, personas: Sequence[str], models: Sequence[str], prompt_types: Sequence[str], judges: Sequence[str]) -> DataFrame:
    """All tasks of an experiment: each model by persona and prompt type, each pair a < b by judge besides."""
    single = [(p, m, k, "objective", None) for p, m, k in product(personas, models, prompt_types)]
    duels = [(p, f"{a}_vs_{b}", k, "pairwise", j) for p, (a, b), k, j in product(personas, combinations(sorted(models), 2), prompt_types, judges)]
    return spark.createDataFrame(single + duels, "persona string, model string, prompt_type string, stage string, judge string")
