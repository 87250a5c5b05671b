"""Raw artifact rows made of the driver's tables, in the shapes that the readers of ``sources.records`` take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans import facts
from quillon.schema import DIMENSIONS
from quillon.sources.samples import VARIATION

#: Names under which the models of the facts stand in records.
RAW_MODELS = {"model_0": "OLD_gpt5", "model_1": "gpt4", "model_2": "qwen/qwen3-8b", "model_3": "own-model"}
LEVELS = ("low", "medium", "high")


def raw_model(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RAW_MODELS.items() for x in kv])[c]


def raw_task(task: Column, label: Column) -> Column:
    return F.when(label == "control", F.concat(task, F.lit("::variation::control_1"))).when(label == "personalized", F.concat(task, F.lit("::variation::"), task, F.lit("-u-var1"))).otherwise(task)


def pairwise_raw(spark, sf_dir) -> DataFrame:
    """Comparisons as judges leave them: every second task with its models the other way round."""
    n = F.col("task_id").cast("bigint")
    flip = n % 2 == 1
    raw_a, raw_b = raw_model(F.col("model_a")), raw_model(F.col("model_b"))
    order = "struct<position_winner:string,confidence:string,rationale:string>"

    def result(i: int, d: str) -> Column:
        won = F.col("winners")[d]
        position = F.when(won == "tie", "tie").when((won == "model_a") != flip, "A").otherwise("B")
        named = F.when(won == "model_a", raw_a).when(won == "model_b", raw_b)
        return F.struct(
            position.alias("winner"), F.when(n % 3 == 0, named).alias("winner_model"), F.get(F.array(*map(F.lit, LEVELS)), ((n + i) % 3).cast("int")).alias("confidence"), F.lit("because").alias("rationale"), ((n + i) % 5 == 0).alias("position_bias_detected"),
            F.struct(position.alias("position_winner"), F.lit("high").alias("confidence"), F.lit("").alias("rationale")).cast(order).alias("original_order_result"),
            F.struct(F.when((n + i) % 4 == 0, position).when(position == "A", "B").when(position == "B", "A").otherwise("tie").alias("position_winner"), F.get(F.array(*map(F.lit, LEVELS)), ((n + i) % 3).cast("int")).alias("confidence"), F.lit("").alias("rationale")).cast(order).alias("swapped_order_result"),
        )

    results = F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*[result(i, d) for i, d in enumerate(DIMENSIONS)]))
    overall = F.when(F.col("overall") == "model_a", raw_a).when(F.col("overall") == "model_b", raw_b)
    meta = "struct<pairwise_judgment_type:string,annotated_dimensions:array<string>,position_swap_enabled:boolean,bias_measured:boolean,source_persona:string>"
    public = "struct<overall_choice:string,human_overall_choice:string,human_overall_confidence:string,annotated_dimensions:array<string>,bias_measured:boolean>"
    return facts.pairs(spark, sf_dir).select(
        "user_id", raw_task(F.col("task_id"), F.col("variant_label")).alias("task_id"), F.when(flip, raw_b).otherwise(raw_a).alias("model_a_name"), F.when(flip, raw_a).otherwise(raw_b).alias("model_b_name"), overall.alias("overall_winner"), "judge_model_name",
        F.lit(None).cast("string").alias("input_text"), F.when(F.col("variant_label") == "original", "General_User").otherwise("persona").alias("pairwise_judgment_type"), results.alias("dimension_results"), F.lit(None).cast(public).alias("metadata"), F.lit(None).cast(meta).alias("_model_metadata"),
    )


def objective_raw(spark, sf_dir) -> DataFrame:
    """Test results; every third sample keeps its blocks under ``metrics``."""
    both = facts.objective(spark, sf_dir).select("user_id", "task_id", "variant_label", "model_name", "flags", "pass_at_1", "pass_at_5")
    nested = F.col("task_id").cast("bigint") % 3 == 0
    block = F.struct(F.create_map(F.lit("1"), F.col("pass_at_1"), F.lit("5"), F.col("pass_at_5")).alias("pass_at_k"), F.col("flags").alias("per_attempt"))
    none = F.lit(None).cast("struct<pass_at_k:map<string,double>,per_attempt:array<boolean>>")
    inner = F.struct(F.lit(False).alias("verification_failed"), raw_model(F.col("model_name")).alias("model_name"), F.lit(None).cast("string").alias("source"), block.alias("base"), none.alias("plus"), F.lit(None).cast("map<string,double>").alias("pass_at_k"))
    return both.select(
        F.concat_ws("::variation::", "task_id", F.when(F.col("variant_label") != "original", F.col("variant_label"))).alias("sample_id"), F.lit(None).cast("string").alias("task_id"), F.when(~nested, raw_model(F.col("model_name"))).alias("model_name"), F.lit("").alias("source"), "variant_label",
        F.lit(None).cast("string").alias("variant_id"), F.when(~nested, block).alias("base"), F.when(~nested, block).alias("plus"), F.create_map(F.lit("1"), F.col("pass_at_1")).alias("pass_at_k"), F.when(nested, inner).alias("metrics"),
    )


def subjective_raw(spark, sf_dir) -> DataFrame:
    """Scores; every second task has older names for two of them, some with the new name besides."""
    own = facts.subjective(spark, sf_dir)
    old = F.col("task_id").cast("bigint") % 2 == 1
    columns = {f"{d}_score": F.when(old, F.lit(None)).otherwise(F.col(f"subj_{d}")) if d in ("workflow_fit", "friction_loss_of_control") else F.col(f"subj_{d}") for d in DIMENSIONS}
    return own.select(
        "user_id", raw_task(F.col("task_id"), F.col("variant_label")).alias("task_id"), raw_model(F.col("model_name")).alias("model_name"), F.lit(None).cast("string").alias("variant_label"), F.lit(None).cast("string").alias("variant_id"), *(c.cast("double").alias(n) for n, c in columns.items()),
        F.col("subj_workflow_fit").alias("efficiency_score"), (1 - F.col("subj_friction_loss_of_control")).alias("frustration_indicator"), F.col("subj_overall").alias("overall_subjective_score"), (F.col("subj_overall") / 2).alias("combined_score"),
    )


def indicator_raw(spark, sf_dir) -> DataFrame:
    """Indicator records, one for each attempt of a cell."""
    cells = facts.cells(spark, sf_dir).where("judge_model_name = 'judge_O'")
    meta = F.struct(F.lit("gpt4").alias("generator_model_name"), F.lit("own-model").alias("filter_model_name"), raw_model(F.col("model_name")).alias("evaluated_model_name"), F.col("variant_label").alias("prompt_type")).cast("struct<generator_model_name:string,filter_model_name:string,evaluated_model_name:string,prompt_type:string>")
    numbers = F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.transform("scores", lambda s: s.cast("double")))
    details = F.create_map(F.lit("clarity"), F.create_map(F.lit("words"), F.get("scores", F.lit(0)).cast("string"), F.lit("persona_type"), F.lit("novice")), F.lit("tone_style_fit"), F.create_map(F.lit("steps"), F.get("scores", F.lit(1)).cast("string")))
    return cells.select(
        "user_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("k"), "task_id", raw_model(F.col("model_name")).alias("model_name"), "variant_label", F.lit(None).cast("string").alias("variant_id"), numbers.alias("input_side_indicators"), numbers.alias("output_side_indicators"),
        numbers.alias("vibe_text_metrics_flat"), numbers.alias("rubric_dimension_scores"), details.alias("rubric_dimension_details"), F.lit(0.5).alias("static_correctness_score"), meta.alias("_model_metadata"),
    ).withColumn("task_id", F.concat_ws("::attempt::", "task_id", F.col("k").cast("string"))).drop("k")


def profile_raw(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    given = F.create_map(F.lit("clarity_and_comprehensibility"), (k % 5 + 1).cast("string"), F.lit("workflow_fit"), F.lit("4"), F.lit("reliability"), F.when(k % 2 == 0, "high"))
    inner = F.struct(
        F.when(k % 4 == 0, F.array(F.lit(0.1))).when(k % 4 == 1, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.1), F.lit(0.9))).alias("task_complexity_gradient"), F.col("c_name").alias("real_world_context_embedding"),
        F.when(k % 3 == 0, "novice").when(k % 3 == 1, "").alias("persona_based_task_framing"), F.lit("ask").alias("preference_and_underspecification_handling"),
    )
    return facts.table(spark, sf_dir, "customer").select(
        F.when(k % 7 != 0, F.concat(k.cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))).alias("user_id"), F.col("c_name").alias("description"), F.lit("p").alias("persona_description"), F.array().cast("array<string>").alias("tasks"), inner.alias("input_dimensions"), given.alias("output_dimensions")
    )


def sample_raw(spark, sf_dir) -> DataFrame:
    """Samples (source_benchmark, sample_id, prompt, variations) of orders: up to three variations each, some with a failed verification."""
    k = F.col("o_orderkey")
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 4).cast("int"))), lambda i: F.struct(
        F.concat(F.lit("u-var"), i.cast("string")).alias("variation_id"), F.array().cast("array<string>").alias("applied_changes"), F.concat(F.lit("p"), i.cast("string")).alias("modified_prompt"), F.lit("personalized").alias("prompt_type"), F.lit("personalized").alias("variant_label"),
        F.when((k + i) % 5 != 0, F.struct(F.lit(True).alias("same_end_goal"), ((k + i) % 3 != 0).alias("same_ground_truth"))).alias("verification"),
    ))
    rows = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").distinct()
    return rows.select(F.col("o_orderstatus").alias("source_benchmark"), k.cast("string").alias("sample_id"), F.lit("original").alias("prompt"), F.when(k % 4 != 0, made).otherwise(F.array().cast(f"array<{VARIATION}>")).cast(f"array<{VARIATION}>").alias("variations"))


def control_raw(spark, sf_dir) -> DataFrame:
    """Two control prompts for every second order."""
    rows = facts.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus").distinct()
    return rows.select(F.col("o_orderstatus").alias("benchmark"), F.explode(F.array(F.lit(2), F.lit(1))).alias("position"), F.col("o_orderkey").cast("string").alias("task_id")).withColumns({"prompt": F.concat(F.lit("control "), F.col("position").cast("string")), "variation_count": F.col("position")})


def annotation_raw(spark, sf_dir) -> DataFrame:
    """What people chose, by item: the human rows of the facts as choices A, B or tie; two dimensions only."""
    human = facts.pairs(spark, sf_dir).where("judge_model_name like 'human_%'")
    choice = lambda d: F.when(F.col("winners")[d] == "model_a", "A").when(F.col("winners")[d] == "model_b", "B").otherwise("tie")
    return human.select(
        "user_id", raw_task(F.col("task_id"), F.col("variant_label")).alias("task_id"), raw_model(F.col("model_a")).alias("model_a_name"), raw_model(F.col("model_b")).alias("model_b_name"), F.lit("annotator_1").alias("annotator_id"),
        F.when(F.col("overall") == "model_a", "A").when(F.col("overall") == "model_b", "B").otherwise("tie").alias("overall_choice"), F.lit("high").alias("confidence"), F.create_map(F.lit("clarity"), choice("clarity"), F.lit("workflow_fit"), choice("workflow_fit")).alias("dimension_choices"),
    )


def paths(spark, sf_dir) -> DataFrame:
    """(file_path, modified) as a tree of artifacts would list them, made of parts."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("file:///data/root/"), F.get(F.array(F.lit("novice"), F.lit("expert")), (k % 2).cast("int")), F.lit("/pairwise/models_"), F.get(F.array(F.lit("gpt-4o_vs_qwen3-8b"), F.lit("qwen3-8b_vs_gpt-4o"), F.lit("a_vs_b")), (k % 3).cast("int")),
        F.lit("/judge_model_j"), (k % 2).cast("string"), F.lit("/gen_model_g/filter_model_f/"), F.when(k % 5 < 2, "judgment_type_general_user/").otherwise(""), F.when(k % 4 != 3, F.concat(F.lit("prompt_type_"), F.get(F.array(F.lit("original"), F.lit("personalized"), F.lit("control")), (k % 3).cast("int")), F.lit("/"))).otherwise(""),
        F.lit("pairwise-comparison_run_x_v0"), (k % 9 + 1).cast("string"), F.lit(".json"),
    )
    return facts.table(spark, sf_dir, "part").select(text.alias("file_path"), F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("modified"))
