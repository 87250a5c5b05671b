"""Raw evaluation records as analysis rows: profiles, scores, test results, indicators and pairwise comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.normalize import error_rationale, model_name, safe_div, token, user_id, variant_fields
from quillon.operators.voting import swap_tested
from quillon.schema import DIMENSIONS

#: The fields of the artifacts, as Spark DDL.
PROFILE = (
    "user_id string, description string, persona_description string, tasks array<string>, "
    "input_dimensions struct<task_complexity_gradient:array<double>,real_world_context_embedding:string,persona_based_task_framing:string,preference_and_underspecification_handling:string>, "
    "output_dimensions map<string,string>"
)
PASS_BLOCK = "struct<pass_at_k:map<string,double>,per_attempt:array<boolean>>"
OBJECTIVE = (
    f"sample_id string, task_id string, model_name string, source string, variant_label string, variant_id string, base {PASS_BLOCK}, plus {PASS_BLOCK}, pass_at_k map<string,double>, "
    f"metrics struct<verification_failed:boolean,model_name:string,source:string,base:{PASS_BLOCK},plus:{PASS_BLOCK},pass_at_k:map<string,double>>"
)
SUBJECTIVE = "user_id string, task_id string, model_name string, variant_label string, variant_id string, " + ", ".join(f"{d}_score double" for d in DIMENSIONS) + ", efficiency_score double, frustration_indicator double, overall_subjective_score double, combined_score double"
INDICATOR = (
    "user_id string, task_id string, model_name string, variant_label string, variant_id string, input_side_indicators map<string,double>, output_side_indicators map<string,double>, "
    "vibe_text_metrics_flat map<string,double>, rubric_dimension_scores map<string,double>, rubric_dimension_details map<string,map<string,string>>, static_correctness_score double, "
    "_model_metadata struct<generator_model_name:string,filter_model_name:string,evaluated_model_name:string,prompt_type:string>"
)
_ORDER = "struct<position_winner:string,confidence:string,rationale:string>"
PAIRWISE = (
    "user_id string, task_id string, model_a_name string, model_b_name string, overall_winner string, judge_model_name string, input_text string, pairwise_judgment_type string, "
    f"dimension_results map<string,struct<winner:string,winner_model:string,confidence:string,rationale:string,position_bias_detected:boolean,original_order_result:{_ORDER},swapped_order_result:{_ORDER}>>, "
    "metadata struct<overall_choice:string,human_overall_choice:string,human_overall_confidence:string,annotated_dimensions:array<string>,bias_measured:boolean>, "
    "_model_metadata struct<pairwise_judgment_type:string,annotated_dimensions:array<string>,position_swap_enabled:boolean,bias_measured:boolean,source_persona:string>"
)
#: Older names of score fields, and the kinds of judgment.
OLDER_SCORES = {"workflow_fit": "efficiency_score", "friction_loss_of_control": "frustration_indicator"}
JUDGMENTS = ("persona", "general_user")
#: Preferences of a profile by the column that reports them.
PREFERENCES = {
    "output_clarity_preference": ("clarity_and_comprehensibility",), "output_workflow_fit_preference": ("workflow_fit",), "output_efficiency_preference": ("efficiency", "workflow_fit"),
    "output_friction_preference": ("friction_and_frustration",), "output_reliability_preference": ("reliability",), "output_persona_context_preference": ("persona_consistency_and_context_awareness",),
    "output_safety_preference": ("safety_and_refusal_behavior",), "output_anthropomorphism_preference": ("anthropomorphism",), "output_creativity_preference": ("creativity_and_originality",), "output_expressive_style": ("expressive_style",),
}


def _held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that a generator makes, so that the optimizer does not write their expressions out wherever they are read."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _fail(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _variant(df: DataFrame, identifier: Column) -> DataFrame:
    """Sets task_id, variant_label and variant_id from an identifier and what the record gives."""
    task, label, variant = variant_fields(identifier, F.col("variant_label"), F.col("variant_id"))
    return df.withColumn("__v", F.struct(task.alias("t"), label.alias("l"), variant.alias("v"))).withColumns({"task_id": F.col("__v.t"), "variant_label": F.col("__v.l"), "variant_id": F.col("__v.v")}).drop("__v")


def profiles(raw: DataFrame) -> DataFrame:
    """Profiles with flat columns; those without a user_id go."""
    i, o = "input_dimensions", F.col("output_dimensions")
    steps = F.col(f"{i}.task_complexity_gradient")
    wanted = {name: F.coalesce(*[F.try_element_at(o, F.lit(k)) for k in keys]) for name, keys in PREFERENCES.items()}
    return raw.where(F.col("user_id").isNotNull()).select(
        user_id(F.col("user_id")).alias("user_id"), F.coalesce(_filled(F.col(f"{i}.persona_based_task_framing")), "user_id").alias("user_profile_type"), "persona_description", F.col("description").alias("profile_description"),
        F.get(steps, F.lit(0)).alias("input_task_complexity_min"), F.get(steps, F.lit(1)).alias("input_task_complexity_max"), F.col(f"{i}.real_world_context_embedding").alias("input_real_world_context"),
        F.col(f"{i}.preference_and_underspecification_handling").alias("input_underspec_handling"), *(c.alias(n) for n, c in wanted.items()),
    )


def subjective(raw: DataFrame, default_model: str | None = None) -> DataFrame:
    """Scores as subj_*; a new field name wins over its older one; rows without a task go."""
    rows = _variant(raw.where(_filled(F.col("task_id")).isNotNull()), F.col("task_id"))
    raw_name = F.coalesce(_filled(F.col("model_name")), F.lit(default_model))
    scores = [F.coalesce(f"{d}_score", OLDER_SCORES[d]) if d in OLDER_SCORES else F.col(f"{d}_score") for d in DIMENSIONS]
    return rows.select("user_id", "task_id", "variant_label", "variant_id", raw_name.alias("raw_model_name"), model_name(raw_name).alias("model_name"), F.col("overall_subjective_score").alias("subj_overall"), "combined_score", *(c.alias(f"subj_{d}") for c, d in zip(scores, DIMENSIONS, strict=True)))


def pass_columns(block: Column, prefix: str, ks: tuple[int, ...] = (1, 5)) -> dict[str, Column]:
    """Pass@k and counts of attempts of one block; null where it has none."""
    flags = F.when(F.size(block["per_attempt"]) > 0, block["per_attempt"])
    passed = F.size(F.filter(flags, lambda x: F.coalesce(x, F.lit(False))))
    out = {f"{prefix}_pass_at_{k}": F.try_element_at(block["pass_at_k"], F.lit(str(k))) for k in ks}
    return out | {f"{prefix}_attempt_count": F.size(flags), f"{prefix}_pass_count": passed, f"{prefix}_pass_rate": F.try_divide(passed, F.size(flags))}


def objective(raw: DataFrame, default_model: str | None = None) -> DataFrame:
    """Test results with flat columns; fields under ``metrics`` count where the record has none; rows without an id go."""
    lifted = raw.withColumns({c: F.coalesce(c, f"metrics.{c}") for c in ("base", "plus", "pass_at_k", "model_name", "source")})
    lifted = lifted.withColumn("__id", F.coalesce(_filled(F.col("sample_id")), _filled(F.col("task_id")))).where("__id is not null")
    rows = _variant(lifted, F.col("__id"))
    raw_name = F.coalesce(_filled(F.col("model_name")), F.lit(default_model))
    ks = {f"obj_overall_pass_at_{k}": F.try_element_at("pass_at_k", F.lit(str(k))) for k in (1, 5)}
    columns = pass_columns(F.col("base"), "obj_base") | pass_columns(F.col("plus"), "obj_plus") | ks
    return rows.select("task_id", "variant_label", "variant_id", raw_name.alias("raw_model_name"), model_name(raw_name).alias("model_name"), F.coalesce(_filled(F.col("source")), F.lit("function_eval")).alias("objective_source"), *(c.alias(n) for n, c in columns.items()))


def objective_csv(rows: DataFrame, default_model: str | None = None) -> DataFrame:
    """Rows of a result CSV: sample_id is its task_id where it has none."""
    if "task_id" not in rows.columns and "sample_id" in rows.columns:
        rows = rows.withColumnRenamed("sample_id", "task_id")
    missing = {c: F.lit(None).cast("string") for c in ("variant_label", "variant_id", "model_name") if c not in rows.columns}
    rows = rows.withColumns(missing | {"raw_model_name": F.coalesce("model_name" if "model_name" in rows.columns else F.lit(None), F.lit(default_model))})
    return _variant(rows, F.col("task_id")).withColumn("model_name", model_name(F.col("raw_model_name")))


def indicators(raw: DataFrame, default_model: str | None = None, default_user: str | None = None) -> DataFrame:
    """Indicator records; an ``::attempt::n`` mark leaves the task id for the column attempt; rows without user or model go."""
    rows = raw.where(_filled(F.col("task_id")).isNotNull()).withColumns({"raw_task_id": F.col("task_id"), "attempt": F.regexp_extract("task_id", "::attempt::([0-9]+)", 1).try_cast("int")})
    rows = _variant(rows, F.substring_index("raw_task_id", "::attempt::", 1))
    raw_name, meta = F.coalesce(_filled(F.col("model_name")), F.lit(default_model)), "_model_metadata"
    rows = rows.withColumns({"user_id": F.coalesce(_filled(F.col("user_id")), F.lit(default_user)), "raw_model_name": raw_name, "model_name": model_name(raw_name)}).where("user_id is not null and model_name is not null")
    names = {"generator_model": f"{meta}.generator_model_name", "filter_model": f"{meta}.filter_model_name", "evaluated_model": f"{meta}.evaluated_model_name"}
    return rows.withColumns({n: model_name(F.col(c)) for n, c in names.items()} | {"prompt_type": F.col(f"{meta}.prompt_type")}).drop(meta)


def first_attempts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The record of each key's smallest attempt."""
    rest = [c for c in rows.columns if c not in (*keys, "attempt")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct("attempt", *rest), F.coalesce("attempt", F.lit(-1))).alias("r")).select(*keys, "r.*")


def judgment_type(c: Column) -> Column:
    """persona or general_user; another value fails."""
    low = F.lower(F.trim(F.coalesce(_filled(c), F.lit(JUDGMENTS[0]))))
    return F.when(low.isin(*JUDGMENTS), low).otherwise(_fail("unknown kind of judgment"))


def pairwise(raw: DataFrame, finegrained: bool = False) -> DataFrame:
    """Comparisons as rows in canonical order of models: maps by dimension, counts and overall winner anew.

    Models are put in order by (token, canonical name, raw name), and what was won
    by either side turns with them. A record without a task id or a model name,
    of two names for one model, or with a winner that is neither model fails.
    Dimensions that weren't annotated are missing in all maps. With
    ``finegrained`` a dimension's winner follows from its two runs where both are
    kept, and the overall winner from the dimensions; else stored winners count.
    """
    name = F.when(_filled(F.col("task_id")).isNull(), _fail("a comparison has no task_id")).otherwise(F.col("task_id"))
    both = F.col("model_a_name").isNotNull() & F.col("model_b_name").isNotNull()
    rows = raw.withColumns({"raw_task_id": name, "__a": F.when(both, model_name(F.col("model_a_name"))).otherwise(_fail("a comparison lacks a model")), "__b": model_name(F.col("model_b_name")), "variant_label": F.lit(None).cast("string"), "variant_id": F.lit(None).cast("string")})
    rows = _variant(rows, F.col("raw_task_id"))
    one = F.when(F.col("__a") == F.col("__b"), _fail("a comparison has two names of one model")).otherwise(F.col("__a"))
    key = lambda c, r: F.struct(token(F.col(c)), F.col(c), F.col(r))
    rows = _held(rows, {"__a": one, "__b": F.col("__b"), "raw_task_id": F.col("raw_task_id"), "task_id": F.col("task_id"), "variant_label": F.col("variant_label"), "variant_id": F.col("variant_id")})
    given = F.coalesce(F.when(F.size("_model_metadata.annotated_dimensions") > 0, F.col("_model_metadata.annotated_dimensions")), F.when(F.size("metadata.annotated_dimensions") > 0, F.col("metadata.annotated_dimensions")), F.array_sort(F.map_keys("dimension_results")))
    given = F.coalesce(F.filter(given, lambda d: d.isin(*DIMENSIONS)), F.array().cast("array<string>"))
    rows = _held(rows, {"swapped": key("__a", "model_a_name") > key("__b", "model_b_name"), "annotated_dimensions": given})

    def side(winner: Column) -> Column:
        """a, b or tie in the record's own order, from a position or a model's name."""
        said = F.trim(winner)
        named = model_name(said)
        return (
            F.when(said.isNull() | F.lower(said).isin("", "tie"), "tie").when(said == "A", "a").when(said == "B", "b")
            .when(named == F.col("__a"), "a").when(named == F.col("__b"), "b").otherwise(_fail("a winner is neither model"))
        )

    def turned(own: Column) -> Column:
        first, second = F.when(F.col("swapped"), "model_b").otherwise("model_a"), F.when(F.col("swapped"), "model_a").otherwise("model_b")
        return F.when(own == "a", first).when(own == "b", second).otherwise("tie")

    def judged(d: Column) -> Column:
        r = F.try_element_at("dimension_results", d)
        stored, biased, sure = side(F.coalesce(r["winner_model"], r["winner"])), r["position_bias_detected"], r["confidence"]
        if finegrained:
            p, q = r["original_order_result"], r["swapped_order_result"]
            again, differ = swap_tested(p["position_winner"], p["confidence"], q["position_winner"], q["confidence"], True)
            kept = p["position_winner"].isNotNull() & q["position_winner"].isNotNull()
            stored = F.when(kept, F.when(again == "model_a", "a").when(again == "model_b", "b").otherwise("tie")).otherwise(stored)
            biased = F.when(kept, differ).otherwise(biased)
        return F.struct(turned(stored).alias("label"), biased.alias("biased"), sure.alias("confidence"), F.coalesce(r["rationale"], F.lit("")).alias("rationale"))

    rows = _held(rows, {"__d": F.transform("annotated_dimensions", judged)})
    of = lambda f: F.map_from_arrays("annotated_dimensions", F.transform("__d", lambda x: x[f]))
    count = lambda s: F.size(F.filter("__d", lambda x: x["label"] == s))
    rows = rows.withColumns({"winners": of("label"), "confidences": of("confidence"), "biases": of("biased"), "rationales": of("rationale"), "win_a": count("model_a"), "win_b": count("model_b"), "win_tie": count("tie"), "n_biased": F.size(F.filter("__d", lambda x: F.coalesce(x["biased"], F.lit(False))))})
    overall = F.when(F.col("win_a") > F.col("win_b"), "model_a").when(F.col("win_b") > F.col("win_a"), "model_b").otherwise("tie") if finegrained else turned(side(F.col("overall_winner")))
    kind = judgment_type(F.coalesce(_filled(F.col("_model_metadata.pairwise_judgment_type")), "pairwise_judgment_type"))
    return rows.select(
        user_id(F.col("user_id")).alias("user_id"), "task_id", "raw_task_id", "variant_label", "variant_id", F.when(F.col("swapped"), F.col("__b")).otherwise(F.col("__a")).alias("model_a"), F.when(F.col("swapped"), F.col("__a")).otherwise(F.col("__b")).alias("model_b"),
        "swapped", F.col("model_a_name").alias("raw_model_a_name"), F.col("model_b_name").alias("raw_model_b_name"), model_name(F.col("judge_model_name")).alias("judge_model_name"), F.col("judge_model_name").alias("raw_judge_model_name"), "input_text",
        overall.alias("overall"), "winners", "confidences", "biases", "rationales", "win_a", "win_b", "win_tie", "n_biased", safe_div(F.col("n_biased"), F.size("annotated_dimensions")).alias("bias_rate"), "annotated_dimensions",
        F.size("annotated_dimensions").alias("n_dimensions"), kind.alias("judgment_type"), F.col("_model_metadata.source_persona").alias("source_persona"), F.coalesce("_model_metadata.position_swap_enabled", F.lit(True)).alias("position_swap_enabled"),
        F.coalesce("_model_metadata.bias_measured", "metadata.bias_measured", F.lit(True)).alias("bias_measured"), F.col("metadata.human_overall_choice").alias("human_overall_choice"), F.col("metadata.human_overall_confidence").alias("human_overall_confidence"),
    )


def assert_canonical(pairs: DataFrame) -> DataFrame:
    """``pairs``; a row whose models stand in the wrong order, or under a name that isn't canonical, fails when it is read."""
    a, b = F.col("model_a"), F.col("model_b")
    right = (F.struct(token(a), a) < F.struct(token(b), b)) & (model_name(a) == a) & (model_name(b) == b)
    return pairs.withColumn("model_a", F.when(right, a).otherwise(_fail("a pair is not in canonical order")))


def dimension_rows(pairs: DataFrame) -> DataFrame:
    """One row for each annotated dimension: winner_label, confidence, biased, rationale."""
    each = F.transform("annotated_dimensions", lambda d: F.struct(d.alias("dimension"), *[F.try_element_at(m, d).alias(n) for m, n in (("winners", "winner_label"), ("confidences", "confidence"), ("biases", "biased"), ("rationales", "rationale"))]))
    return pairs.select(*[c for c in pairs.columns if c not in ("winners", "confidences", "biases", "rationales")], F.inline(each))


def usable(pairs: DataFrame) -> DataFrame:
    """Comparisons with a dimension that votes: annotated and without an error as its rationale."""
    good = F.filter("annotated_dimensions", lambda d: ~error_rationale(F.try_element_at("rationales", d)))
    return pairs.where(F.size(good) > 0)


def align_judgment_types(pairs: DataFrame, item: list[str], human_prefix: str = "human_") -> DataFrame:
    """judgment_type of the human row of the same item for all its rows; human rows that disagree fail."""
    human = pairs.where(F.col("judge_model_name").startswith(human_prefix)).groupBy(*[F.col(c).alias(f"__{c}") for c in item]).agg(F.min("judgment_type").alias("__lo"), F.max("judgment_type").alias("__hi"))
    on = F.lit(True)
    for c in item:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).when(F.col("__lo").isNotNull(), _fail("human rows disagree on the kind of judgment"))
    return pairs.join(human, on, "left").withColumn("judgment_type", F.coalesce(own, "judgment_type")).drop("__lo", "__hi", *[f"__{c}" for c in item])


def failed_verifications(samples: DataFrame) -> DataFrame:
    """How many variations there are and how many failed their verification; ``samples`` has an array ``variations``."""
    units = samples.select(F.explode("variations").alias("v"))
    ok = F.coalesce(F.col("v.verification.same_end_goal"), F.lit(True)) & F.coalesce(F.col("v.verification.same_ground_truth"), F.lit(True))
    return units.agg(F.count("*").alias("n_units"), F.count_if(~ok).alias("n_failed"))
