"""Further registered queries: records, agreement by condition, samples, studies, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import indicators as D
from quillon.functions import normalize as N
from quillon.functions import parsing as P
from quillon.operators import aggregate as A
from quillon.operators import agreement as G
from quillon.operators import selection as C
from quillon.operators import study as Y
from quillon.operators import voting as V
from quillon.plans import facts, records
from quillon.plans.queries import CONDITION, ITEM, QUERIES, query, rated, rounded
from quillon.schema import DIMENSIONS, PAIR
from quillon.sources import records as R
from quillon.sources import samples as M
from quillon.sources import sinks as W
from quillon.sources import trees as T

__all__ = ["QUERIES"]
TASK = ["user_id", "task_id", "variant_label"]
ANNOTATORS = ("ann", "bob", "cy")


def joined(m: str) -> F.Column:
    return F.array_join(F.transform(F.array(*map(F.lit, DIMENSIONS)), lambda d: F.coalesce(F.try_element_at(m, d), F.lit("-"))), ",")


def compared(spark, sf_dir, finegrained=False):
    return R.pairwise(records.pairwise_raw(spark, sf_dir), finegrained)


@query
def pairwise_records(spark, sf_dir):
    out = R.assert_canonical(compared(spark, sf_dir))
    return rounded(out.select("user_id", "task_id", "raw_task_id", "variant_label", "variant_id", "judge_model_name", "model_a", "model_b", "swapped", "overall", joined("winners").alias("winners"), "win_a", "win_b", "win_tie", "n_biased", "bias_rate", "n_dimensions", "judgment_type"))


@query
def pairwise_records_finegrained(spark, sf_dir):
    out = compared(spark, sf_dir, True)
    return rounded(out.select(*TASK, "judge_model_name", "model_a", "model_b", "overall", joined("winners").alias("winners"), "win_a", "win_b", "win_tie", "n_biased", "bias_rate"))


@query
def pairwise_dimension_rows(spark, sf_dir):
    rows = R.dimension_rows(R.usable(compared(spark, sf_dir)))
    return rows.groupBy(*PAIR, "dimension", "winner_label", "confidence").agg(F.count("*").alias("n"), F.count_if("biased").alias("n_biased"))


@query
def dimension_win_rates_full(spark, sf_dir):
    """Win rates with confidences, biases and rows whose rationale reports an error."""
    rows = R.dimension_rows(compared(spark, sf_dir)).withColumn("rationale", F.when(F.col("task_id").cast("bigint") % 10 == 0, "Parse error: x").otherwise(F.col("rationale")))
    return rounded(A.dimension_win_rates(rows))


@query
def judgment_types_aligned(spark, sf_dir):
    pairs = compared(spark, sf_dir).withColumn("judgment_type", F.when(F.col("judge_model_name") == "judge_O", "persona").otherwise(F.col("judgment_type")))
    out = R.align_judgment_types(pairs, [*TASK, *PAIR])
    return out.groupBy("judge_model_name", "variant_label", "judgment_type").agg(F.count("*").alias("n"))


@query
def objective_records(spark, sf_dir):
    out = R.objective(records.objective_raw(spark, sf_dir))
    return rounded(out.select("task_id", "variant_label", "variant_id", "raw_model_name", "model_name", "objective_source", "obj_base_pass_at_1", "obj_base_attempt_count", "obj_base_pass_count", "obj_base_pass_rate", "obj_plus_pass_at_5", "obj_overall_pass_at_1"))


@query
def objective_lookup(spark, sf_dir):
    rows = R.objective(records.objective_raw(spark, sf_dir)).withColumn("sample_key", N.sample_key(F.col("task_id"), F.col("variant_id")))
    return rounded(A.objective_lookup(rows, ["raw_model_name"]))


@query
def subjective_records(spark, sf_dir):
    return rounded(R.subjective(records.subjective_raw(spark, sf_dir)))


@query
def indicator_records(spark, sf_dir):
    out = R.first_attempts(R.indicators(records.indicator_raw(spark, sf_dir)), [*TASK, "model_name"])
    return rounded(out.select(*TASK, "model_name", "raw_task_id", "attempt", "raw_model_name", "generator_model", "evaluated_model", F.try_element_at("rubric_dimension_scores", F.lit("clarity")).alias("clarity")))


@query
def profile_records(spark, sf_dir):
    return rounded(R.profiles(records.profile_raw(spark, sf_dir)).select("user_id", "user_profile_type", "profile_description", "input_task_complexity_min", "input_task_complexity_max", "input_underspec_handling", "output_clarity_preference", "output_efficiency_preference", "output_reliability_preference"))


@query
def verification_failures(spark, sf_dir):
    return R.failed_verifications(records.sample_raw(spark, sf_dir))


@query
def rubric_detail_summary(spark, sf_dir):
    base = R.first_attempts(R.indicators(records.indicator_raw(spark, sf_dir)), [*TASK, "model_name"])
    pairs = compared(spark, sf_dir).where("judge_model_name = 'judge_O'")
    return rounded(A.rubric_details(pairs, base.select(*TASK, "model_name", F.col("rubric_dimension_details").alias("details")), TASK))


@query
def pair_summary_objective(spark, sf_dir):
    """Pair summary with bias rates and rates by pass@1 and pass@5."""
    pairs = facts.pairs(spark, sf_dir).withColumn("bias_rate", F.col("win_tie") / 9.0)
    tests = facts.objective(spark, sf_dir)
    for k in (1, 5):
        met = A.objective_outcomes(pairs, tests, ITEM, f"pass_at_{k}")
        pairs = met.withColumnsRenamed({"pass_a": f"pass_a_at_{k}", "pass_b": f"pass_b_at_{k}"})
    return rounded(A.pair_summary(pairs))


@query
def dimension_rates_with_objective(spark, sf_dir):
    pairs = facts.pairs(spark, sf_dir)
    met = A.objective_outcomes(pairs, facts.objective(spark, sf_dir), ITEM, "pass_at_1").withColumnsRenamed({"pass_a": "pass_a_at_1", "pass_b": "pass_b_at_1"})
    return rounded(A.objective_rows(A.pair_summary(met), A.dimension_win_rates(V.dimension_rows(pairs)), "at_1"))


@query
def agreement_tables(spark, sf_dir):
    return rounded(G.tables(rated(spark, sf_dir), CONDITION, ["user_id", "variant_label", *PAIR]))


@query
def agreement_pooled(spark, sf_dir):
    return rounded(G.pooled(rated(spark, sf_dir), CONDITION, ["user_id", "variant_label", *PAIR], ["variant_label"]))


@query
def agreement_across_conditions(spark, sf_dir):
    return rounded(G.across_conditions(G.tables(rated(spark, sf_dir), CONDITION, ["user_id", "variant_label", *PAIR]), ["variant_label"]))


@query
def agreement_intervals(spark, sf_dir):
    return rounded(G.intervals(rated(spark, sf_dir), CONDITION, ["user_id", "variant_label"], resamples=200))


@query
def agreement_human_items(spark, sf_dir):
    """Agreement between people and models, and within models, on items that a person judged."""
    human = C.with_human_items(rated(spark, sf_dir), CONDITION, "judge")
    agreed = G.judge_pairs(human, CONDITION)
    both = C.between_groups(agreed, ["human_annotator_1"], ["judge_O", "judge_F"]).unionByName(C.within_group(agreed, ["judge_O", "judge_F"]))
    return rounded(both.select("judge_a", "judge_b", "n_items", "percent", "kappa"))


@query
def winners_long(spark, sf_dir):
    out = G.long_winners(rated(spark, sf_dir), CONDITION)
    return out.groupBy("judge", F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def winners_wide(spark, sf_dir):
    return G.wide_winners(rated(spark, sf_dir), CONDITION, ["human_annotator_1", "judge_F", "judge_O"])


@query
def top_model_over_judges(spark, sf_dir):
    return rounded(G.judge_overview(rounded(G.ranking_stability(facts.pairs(spark, sf_dir))[0])))


@query
def human_records(spark, sf_dir):
    """People's choices, exported as comparison records and read again."""
    made = Y.human_records(records.annotation_raw(spark, sf_dir), "dimension_majority")
    out = R.pairwise(made)
    return rounded(out.select(*TASK, "judge_model_name", "model_a", "model_b", "overall", joined("winners").alias("winners"), "win_a", "win_b", "win_tie", "n_dimensions", "bias_measured", "human_overall_confidence"))


@query
def candidate_rejections(spark, sf_dir):
    pairs = facts.pairs(spark, sf_dir).withColumns({"model_a_output": F.repeat(F.lit("x"), F.col("win_a").cast("int")), "model_b_output": F.repeat(F.lit("x"), F.col("win_b").cast("int"))})
    limit = C.longest_output(6, [({"variant_label": ["Control"]}, 4), ({"user_id": ["persona_1"]}, None)])
    out = pairs.withColumn("rejection", C.rejection({"variant_label": ["original", "CONTROL"]}, {"judge_model_name": ["judge_F"]}, limit, no_ties=True))
    return W.filter_audit(out, ["variant_label", "user_id"])


@query
def exact_sample_types(spark, sf_dir):
    out = C.exact_types(facts.pairs(spark, sf_dir), [{"variant_label": "original", "user_id": ["persona_0", "persona_1"]}, {"variant_label": ["control"]}])
    return out.groupBy("sample_type").agg(F.count("*").alias("n"))


@query
def omitted_dimensions(spark, sf_dir):
    rows = C.without_dimensions(V.dimension_rows(facts.pairs(spark, sf_dir)), ["efficiency", "Anthropomorphism", "subj_clarity", "unknown"])
    return rows.groupBy("dimension", "winner_label").agg(F.count("*").alias("n"))


@query
def skipped_units(spark, sf_dir):
    """Units of samples with controls added, and those that a failed verification skips."""
    samples = M.with_controls(records.sample_raw(spark, sf_dir), M.control_prompts(records.control_raw(spark, sf_dir)))
    out = M.units(samples)
    return out.groupBy("source_benchmark", "variant_label").agg(F.count("*").alias("n"), F.count_if(C.unverified(F.col("variant_label"), F.col("verification"))).alias("n_skipped"))


@query
def sample_units(spark, sf_dir):
    samples = M.with_controls(records.sample_raw(spark, sf_dir), M.control_prompts(records.control_raw(spark, sf_dir)))
    return M.units(samples).select("sample_id", "unit_id", "variant_label", "unit_prompt")


def outputs(spark, sf_dir, model):
    rows = facts.objective(spark, sf_dir).where(F.col("model_name") == model)
    return rows.select(F.concat_ws("|", "user_id", "task_id", "variant_label").alias("sample_id"), "user_id", F.col("variant_label"), F.col("variant_label").alias("prompt_type"), F.col("n_passed").cast("string").alias("output"))


@query
def comparison_inputs(spark, sf_dir):
    a, b = (outputs(spark, sf_dir, m) for m in ("model_0", "model_1"))
    prompts = a.where("user_id <> 'persona_2'").select("sample_id", F.concat(F.lit("prompt of "), "sample_id").alias("prompt"))
    return M.comparison_inputs(a, b, prompts, P.fallback_input(F.col("sample_id"), F.lit(None), F.lit("f"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))))


@query
def outputs_backfilled(spark, sf_dir):
    own, reference = outputs(spark, sf_dir, "model_0").where("user_id <> 'persona_1'"), outputs(spark, sf_dir, "model_0")
    return M.backfilled(own, reference, ["sample_id"]).groupBy("user_id", "variant_label").agg(F.count("*").alias("n"))


@query
def sample_overlap(spark, sf_dir):
    return M.overlap(outputs(spark, sf_dir, "model_0"), outputs(spark, sf_dir, "model_3"))


@query
def benchmark_rows(spark, sf_dir):
    """Three benchmarks of one table, as unified rows."""
    rows = facts.table(spark, sf_dir, "benchmark")
    parts = {
        "codexglue_text_to_code": rows.select(F.col("item_id").alias("id"), F.col("text").alias("nl"), F.lit("c").alias("code"), F.when(F.col("item_id") % 2 == 0, "java").otherwise("").alias("language")),
        "ds1000": rows.select(F.struct((F.col("item_id") - 1).alias("id")).alias("metadata"), F.col("text").alias("prompt")),
        "mbpp": rows.select(F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("task_id"), F.col("item_id").alias("id"), F.lit("").alias("text"), F.col("text").alias("prompt"), F.lit("x").alias("code")),
    }
    return M.unified(parts).select("benchmark", "task_id", "prompt", "ground_truth", "language")


@query
def experiment_tasks(spark, sf_dir):
    made = M.experiment_tasks(spark, ["persona_0", "persona_1", "persona_2"], [f"model_{i}" for i in range(4)], ["original", "personalized"], ["judge_O", "judge_F"])
    tasks = C.tagged(made, ["model_0", "model_1", "model_3"], ["persona_0", "persona_1"])
    return tasks.select("persona", "model", "prompt_type", "stage", F.coalesce("judge", F.lit("none")).alias("judge"))


@query
def artifact_places(spark, sf_dir):
    out = T.with_place(records.paths(spark, sf_dir), "/data/root")
    return out.select("file_path", "persona", "model_a", "model_b", "judge", "generator", "filter", "prompt_type", "judgment_type", F.col("name.version").alias("version"))


@query
def artifacts_newest(spark, sf_dir):
    placed = T.with_place(records.paths(spark, sf_dir), "/data/root")
    out = T.newest(placed, ["persona", "model_a", "model_b", "judge", "judgment_type"])
    return out.select("persona", "model_a", "model_b", "judge", "judgment_type", "file_path")


@query
def artifacts_shared(spark, sf_dir):
    placed = T.with_place(records.paths(spark, sf_dir), "/data/root")
    return T.with_shared_reference(placed, "novice").groupBy("persona", "shared", F.coalesce("prompt_type", F.lit("none")).alias("prompt_type")).agg(F.count("*").alias("n"))


@query
def artifact_model_pairs(spark, sf_dir):
    return T.model_pairs(T.with_place(records.paths(spark, sf_dir), "/data/root")).select("model_a", "model_b")


@query
def assignment_counts(spark, sf_dir):
    """How many items of each type an annotator gets."""
    items = facts.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), (F.col("s_suppkey") % 3).alias("kind")).distinct()
    return Y.assign(items, ANNOTATORS, 5, "item_id", ["kind"], 2).groupBy("annotator", "kind").agg(F.count("*").alias("n"))


@query
def equal_allocation_counts(spark, sf_dir):
    """A draw of equally many orders of each status and priority, five pinned ones included."""
    orders = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").distinct()
    pinned = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").orderBy("o_orderkey").limit(2)
    out = Y.equal_allocation(orders, ["o_orderstatus", "o_orderpriority"], 45, 7, ["o_orderkey"], pinned)
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query
def study_draw(spark, sf_dir):
    """Rows for weighted types, drawn one type after the other."""
    pairs = facts.pairs(spark, sf_dir).where("judge_model_name = 'judge_O'").withColumn("source_key", F.concat_ws("|", *CONDITION))
    kinds = [{"variant_label": "original"}, {"variant_label": "original"}, {"variant_label": "control"}]
    return Y.explicit_targets(pairs, Y.type_quotas(pairs, kinds, 30, "source_key"), 11, ["source_key"]).select("target", "source_key", "variant_label")


@query
def benchmark_draw(spark, sf_dir):
    orders = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").distinct()
    out = Y.stratified(orders, "o_orderstatus", 60, 3, "o_orderkey", orders.where("o_orderkey % 2 = 0"))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("n_excluded"))


@query
def survey_answers(spark, sf_dir):
    """Answers of a wide survey, placed by what each annotator was shown."""
    users = facts.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("annotator_id")).agg(F.count("*").alias("n"))
    pick = lambda c: F.get(F.array(*map(F.lit, ("A", "B", "tie"))), (c % 3).cast("int"))
    wide = users.select("annotator_id", pick(F.col("n")).alias("q1"), F.when(F.col("n") % 4 != 0, pick(F.col("n") + 1)).alias("q2"))
    assigned = users.select("annotator_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"), "n").select("annotator_id", "slot", F.concat_ws("_", F.lit("item"), F.col("slot").cast("string")).alias("item_id"), (F.col("n") % 2 == 1).alias("shown_swapped"))
    questions = spark.createDataFrame([(1, "overall", "q1"), (2, "overall", "q2")], "slot int, field string, column string")
    return Y.answers(wide, assigned, questions)


@query
def judge_answers(spark, sf_dir):
    k = F.col("l_partkey")
    base = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    said = F.concat_ws("\n", F.when(k % 5 != 0, F.concat(F.lit(" Winner: "), F.get(F.array(*map(F.lit, ("a", "B", "tie", "neither", "C"))), (k % 5).cast("int")))), F.when(k % 3 != 0, F.concat(F.lit("CONFIDENCE: "), F.get(F.array(*map(F.lit, ("x", "very high", "low"))), (k % 3).cast("int")))), F.when(k % 2 == 0, "Rationale: short").otherwise("some words\nand more"))
    return base.withColumn("r", P.judge_answer(said)).select("l_orderkey", "l_linenumber", "l_partkey", "r.winner", "r.confidence", "r.rationale")


@query
def answers_as_json(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('Here: ```json\n{"k": '), k.cast("string"), F.lit(",}\n``` done"))).when(k % 4 == 1, F.concat(F.lit('so {"k": '), k.cast("string"), F.lit("} ok"))).when(k % 4 == 2, F.concat(F.lit('[{"k": '), k.cast("string"), F.lit("},]"))).otherwise("none { here")
    return facts.table(spark, sf_dir, "part").select("p_partkey", P.lenient_json(text).alias("json"))


@query
def scalar_forms(spark, sf_dir):
    """Flags, numbers, marks and scalars over made-up values."""
    k, d = F.col("l_partkey"), F.col("l_discount")
    base = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax").distinct()
    ok, plus = F.when(k % 3 != 0, d < 0.05), F.when(k % 4 != 0, d < 0.03)
    maps = F.create_map(F.lit("1"), d), F.create_map(F.lit("5"), F.col("l_tax"))
    return rounded(base.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", P.correctness(ok, plus, *maps).alias("correctness"), F.array_join(P.error_types(ok, plus), ",").alias("errors"),
        P.delta_mark(d - 0.05, F.col("l_tax"), F.when(k % 2 == 0, d), words=True).alias("mark"), P.blended(d, F.col("l_tax")).alias("blend"), P.loose_bool(F.get(F.array(*map(F.lit, (" Yes", "0", "TRUE", "x"))), (k % 4).cast("int"))).alias("flag"),
        P.loose_int(F.get(F.array(*map(F.lit, ("7", " 8.9 ", "x"))), (k % 3).cast("int")), -1).alias("number"), P.display_name(records.raw_model(F.concat(F.lit("model_"), (k % 4).cast("string")))).alias("shown"), P.canonical_choice(F.lit("A"), k % 2 == 0).alias("choice"),
    ))


@query
def survey_times(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "3/2/2025 4:05").when(k % 4 == 1, "2025-02-03 04:05:06").when(k % 4 == 2, "13/12/2024").otherwise("soon")
    return facts.table(spark, sf_dir, "customer").select("c_custkey", F.date_format(P.day_first(text), "yyyy-MM-dd HH:mm:ss").alias("recorded"))


@query
def indicators_in_all(spark, sf_dir):
    p = F.col("prompt")
    columns = D.input_side(p, F.array(p, F.lit("task")), F.array(F.lit("clarity"), F.lit("tone_style_fit")), F.create_map(F.lit("a"), F.lit("b")))
    return rounded(facts.dialogues(spark, sf_dir).select("conv_id", "turn", *(c.alias(n) for n, c in columns.items())))


@query
def indicators_out_all(spark, sf_dir):
    columns = D.output_side(F.col("prompt"), F.col("response"), F.create_map(F.lit("a"), F.lit("the"), F.lit("b"), F.lit(" "), F.lit("c"), F.lit("Qqq")), F.lit(0.6))
    return rounded(facts.dialogues(spark, sf_dir).select("conv_id", "turn", *(c.alias(n) for n, c in columns.items())))


@query
def subjective_weighted(spark, sf_dir):
    """Overall scores with preferred dimensions weighing twice."""
    own = facts.subjective(spark, sf_dir)
    scores = F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(f"subj_{d}"))])
    preferred = F.when(F.col("user_id") == "persona_0", F.array(F.lit("clarity"), F.lit("workflow_fit")))
    return rounded(own.select(*ITEM, "model_name", A.weighted_overall(scores, preferred).alias("overall")))


@query
def resolution_rates(spark, sf_dir):
    rows = facts.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_discount") < 0.05).alias("resolved"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(0.25)).alias("given"))
    return rounded(A.resolution_rate(rows, ["run"], "given"))


@query
def paired_deltas_by_judge(spark, sf_dir):
    from quillon.operators import inference as I

    keys = ["user_id", "judge_model_name", "row_model", "col_model"]
    return rounded(I.delta_means(I.item_deltas(A.directional(facts.pairs(spark, sf_dir)), keys), keys))


@query
def persona_text_metrics(spark, sf_dir):
    from quillon.functions.text_metrics import with_metrics

    rows = facts.dialogues(spark, sf_dir).withColumn("who", F.lit("python_novice_1"))
    out = with_metrics(rows, "response", "prompt", ["persona_lexicon_rate_per_100w", "cross_persona_contamination_per_100w", "register_drift_score", "deictic_terms_count", "deictic_resolutions_count"], user="who")
    return rounded(out.select("conv_id", "turn", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in ("persona_lexicon_rate_per_100w", "cross_persona_contamination_per_100w", "register_drift_score", "deictic_terms_count", "deictic_resolutions_count")]))


@query
def sanitized_code(spark, sf_dir):
    from quillon.functions.code import sanitize

    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("Sure:\n```python\ndef g"), k.cast("string"), F.lit("(x):\n    return x\nnot code here\n```"))).otherwise("no code at all")
    return facts.table(spark, sf_dir, "part").select("p_partkey", sanitize(text, F.lit("solve")).alias("code"))


