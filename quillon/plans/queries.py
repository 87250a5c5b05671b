"""All registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import normalize as N
from quillon.functions import text as X
from quillon.operators import aggregate as A
from quillon.operators import agreement as G
from quillon.operators import inference as I
from quillon.operators import sampling as S
from quillon.operators import voting as V
from quillon.plans import facts
from quillon.schema import DIMENSIONS, PAIR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ITEM = ["user_id", "task_id", "variant_label"]
CONDITION = [*ITEM, *PAIR]
#: Names that the name query spreads over customers.
RAW_NAMES = ("OLD_gpt5", "openai/gpt-oss-20b", "Qwen3-8B", "home/own-model", "vendor/gpt-4", "old_OLD_claude-3-opus", "plain model")
RAW_USERS = ("3.0", " 7 ", "nan", "", "None", "u_1", "1e3")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def pick(values: Sequence[str], by: str) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


@query
def norm_model_names(spark, sf_dir):
    raw = facts.table(spark, sf_dir, "customer").select("c_custkey", pick(RAW_NAMES, "c_custkey").alias("raw_model_name"))
    return raw.withColumns({"model_name": N.model_name(F.col("raw_model_name")), "token": N.token(F.col("raw_model_name"))})


@query
def norm_variant_fields(spark, sf_dir):
    base = facts.ratings_base(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "task_id", "variant_label").distinct()
    mark = F.when(F.col("variant_label") == "control", "::variation::control_1").when(F.col("variant_label") == "personalized", F.concat(F.lit("::variation::"), "task_id", F.lit("-u-var1"))).otherwise("")
    named = base.withColumn("raw_task_id", F.concat("task_id", mark)).select("l_orderkey", "l_linenumber", "l_suppkey", "raw_task_id").distinct()
    task, label, variant = N.variant_fields(F.col("raw_task_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return named.select("l_orderkey", "l_linenumber", "l_suppkey", "raw_task_id", task.alias("task_id"), label.alias("variant_label"), variant.alias("variant_id"), N.sample_key(task, variant).alias("sample_key"))


@query
def norm_user_ids(spark, sf_dir):
    raw = facts.table(spark, sf_dir, "customer").select("c_custkey", pick(RAW_USERS, "c_custkey").alias("raw_user_id"))
    return raw.withColumn("user_id", N.user_id(F.col("raw_user_id")))


@query
def stable_ids(spark, sf_dir):
    parts = facts.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return parts.select("p_partkey", N.item_id(F.col("p_brand"), F.col("p_name")).alias("item_id"), N.stable_seed(F.lit("42"), F.col("p_brand"), F.col("p_name")).alias("seed"))


@query
def synthetic_pairwise(spark, sf_dir):
    return rounded(facts.pairs(spark, sf_dir).withColumn("winners", F.array_join(F.transform(F.array(*map(F.lit, DIMENSIONS)), lambda d: F.col("winners")[d]), ",")))


@query
def pair_summary(spark, sf_dir):
    return rounded(A.pair_summary(facts.pairs(spark, sf_dir)))


@query
def user_pair_summary(spark, sf_dir):
    return rounded(A.pair_summary(facts.pairs(spark, sf_dir), ["user_id"]))


@query
def pair_summary_cube(spark, sf_dir):
    return rounded(A.pair_summary_sets(facts.pairs(spark, sf_dir)))


@query
def pair_summary_weighted(spark, sf_dir):
    return rounded(A.weighted_pair_summary(facts.pairs(spark, sf_dir), facts.persona_weights(spark)))


@query
def dimension_win_rates(spark, sf_dir):
    return rounded(A.dimension_win_rates(V.dimension_rows(facts.pairs(spark, sf_dir))))


@query
def model_rankings(spark, sf_dir):
    return rounded(A.model_rankings(A.pair_summary(facts.pairs(spark, sf_dir))))


@query
def preference_matrix_long(spark, sf_dir):
    return rounded(A.preference_matrix(A.pair_summary(facts.pairs(spark, sf_dir))))


@query
def joint_long(spark, sf_dir):
    return rounded(A.joint_long(A.directional(facts.pairs(spark, sf_dir))))


@query
def joint_long_by_judge(spark, sf_dir):
    return rounded(A.joint_long(A.directional(facts.pairs(spark, sf_dir)), ["user_id", "variant_label", "judge_model_name"]))


@query
def joint_weighted(spark, sf_dir):
    return rounded(A.weighted_joint(A.joint_long(A.directional(facts.pairs(spark, sf_dir))), facts.persona_weights(spark)))


@query
def passk_samples(spark, sf_dir):
    return rounded(facts.objective(spark, sf_dir).drop("flags"))


@query
def passk_summary(spark, sf_dir):
    both = [facts.objective(spark, sf_dir, s).withColumn("suite", F.lit(s)) for s in ("passed", "plus")]
    return rounded(both[0].unionByName(both[1]).groupBy("suite", "model_name").agg(F.count("*").alias("n"), F.sum(F.col("n_attempts") - F.col("n_passed")).alias("n_failed"), *(F.avg(c).alias(c) for c in ("pass_at_1", "pass_at_5", "passed_in_1", "passed_in_5"))))


@query
def objective_flip_rates(spark, sf_dir):
    return rounded(A.flip_rates(facts.objective(spark, sf_dir)))


@query
def objective_pair_outcomes(spark, sf_dir):
    met = A.objective_outcomes(facts.pairs(spark, sf_dir), facts.objective(spark, sf_dir), ITEM, "pass_at_1")
    return rounded(A.with_rates(met.where("pass_a is not null and pass_b is not null").groupBy(*PAIR).agg(*A.outcome_counts(V.label(F.col("pass_a"), F.col("pass_b"))))))


def samples(spark, sf_dir):
    keys = [*ITEM, "model_name"]
    out = A.sample_level(facts.subjective(spark, sf_dir), facts.objective(spark, sf_dir).select(*keys, "pass_at_1", "pass_at_5"), keys)
    return out.withColumn("combined_score", 0.5 * F.col("subj_overall") + 0.5 * F.col("pass_at_1"))


@query
def sample_level(spark, sf_dir):
    return rounded(samples(spark, sf_dir).select(*ITEM, "model_name", "subj_overall", "pass_at_1", "combined_score", "has_objective", "has_subjective", "has_both"))


def summary(spark, sf_dir):
    return A.variant_summary(samples(spark, sf_dir), ["pass_at_1", "pass_at_5", "subj_overall", "combined_score"], ["subj_overall", "combined_score"])


@query
def variant_summary(spark, sf_dir):
    return rounded(summary(spark, sf_dir))


@query
def user_model_deltas(spark, sf_dir):
    out = A.personalization_deltas(summary(spark, sf_dir), "pass_at_1", "subj_overall")
    return rounded(out.select("user_id", "model_name", "pass_at_1_mean_delta", "subj_overall_mean_delta", "combined_score_mean_delta"))


@query
def persona_summary(spark, sf_dir):
    return rounded(A.mean_of_means(summary(spark, sf_dir), ["user_id", "variant_label"]))


@query
def global_summary(spark, sf_dir):
    return rounded(A.mean_of_means(summary(spark, sf_dir), ["model_name", "variant_label"]))


@query
def ranking_reversals(spark, sf_dir):
    return A.ranking_reversals(rounded(summary(spark, sf_dir)), {"objective": "pass_at_1_mean", "subjective": "subj_overall_mean", "combined": "combined_score_mean"})


def voted(spark, sf_dir, mode, weights=None):
    met = A.objective_outcomes(facts.pairs(spark, sf_dir), facts.objective(spark, sf_dir), ITEM, "pass_at_1")
    out = V.recompute_overall(met, mode, omit=["anthropomorphism"], weights=weights)
    return rounded(out.groupBy(*PAIR, F.coalesce("overall", F.lit("none")).alias("overall")).agg(F.count("*").alias("n"), F.sum("votes_a").alias("votes_a"), F.sum("votes_b").alias("votes_b"), F.count_if("valid").alias("n_valid")))


@query
def recompute_winner_plain(spark, sf_dir):
    return voted(spark, sf_dir, "ignore")


@query
def recompute_winner_gate(spark, sf_dir):
    return voted(spark, sf_dir, "gate")


@query
def recompute_winner_dimension(spark, sf_dir):
    return voted(spark, sf_dir, "dimension")


@query
def recompute_winner_weighted(spark, sf_dir):
    return voted(spark, sf_dir, "dimension", facts.dimension_weights(spark))


def swap_runs(spark, sf_dir):
    base = facts.ratings_base(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    choice = lambda n: F.get(F.array(*map(F.lit, ("A", "B", "tie"))), (n % 3).cast("int"))
    sure = lambda n: F.get(F.array(*map(F.lit, ("low", "medium", "high"))), (n % 3).cast("int"))
    return base.select("l_orderkey", choice(F.col("l_orderkey")).alias("pos1"), sure(F.col("l_partkey")).alias("conf1"), choice(F.col("l_suppkey")).alias("pos2"), sure(F.col("l_linenumber") + F.col("l_suppkey")).alias("conf2"))


@query
def tiebreak_strict(spark, sf_dir):
    winner, biased = V.swap_tested(F.col("pos1"), F.col("conf1"), F.col("pos2"), F.col("conf2"), False)
    return swap_runs(spark, sf_dir).groupBy("pos1", "pos2", winner.alias("winner")).agg(F.count("*").alias("n"), F.count_if(biased).alias("n_biased"))


@query
def tiebreak_finegrained(spark, sf_dir):
    winner, biased = V.swap_tested(F.col("pos1"), F.col("conf1"), F.col("pos2"), F.col("conf2"), True)
    return swap_runs(spark, sf_dir).groupBy("pos1", "conf1", "pos2", "conf2", winner.alias("winner")).agg(F.count("*").alias("n"), F.count_if(biased).alias("n_biased"))


def rated(spark, sf_dir):
    return G.ratings(facts.pairs(spark, sf_dir), CONDITION, "judge_model_name", "overall")


@query
def judge_pair_agreement(spark, sf_dir):
    return rounded(G.judge_pairs(rated(spark, sf_dir), CONDITION))


@query
def judge_pair_agreement_by_dim(spark, sf_dir):
    rows = V.dimension_rows(facts.pairs(spark, sf_dir))
    return rounded(G.judge_pairs(G.ratings(rows, [*CONDITION, "dimension"], "judge_model_name", "winner_label"), [*CONDITION, "dimension"], ["dimension"]))


@query
def human_vs_llm(spark, sf_dir):
    by = ["variant_label"]
    return rounded(G.agreement_kinds(G.judge_pairs(rated(spark, sf_dir), CONDITION, by), ["human_"]))


@query
def fleiss_kappa(spark, sf_dir):
    return rounded(G.fleiss(rated(spark, sf_dir), CONDITION, ["variant_label"]))


@query
def majority_winner(spark, sf_dir):
    return G.majority(rated(spark, sf_dir), CONDITION)


@query
def ranking_stability(spark, sf_dir):
    return rounded(G.ranking_stability(facts.pairs(spark, sf_dir))[1])


@query
def binomial_tests(spark, sf_dir):
    out = A.joint_long(A.directional(facts.pairs(spark, sf_dir)), ["user_id"])
    return rounded(out.select("user_id", "row_model", "col_model", "wins", "total", "p_value", "p_value_excl_ties", "significant"))


def deltas(spark, sf_dir):
    return I.item_deltas(A.directional(facts.pairs(spark, sf_dir)))


@query
def paired_deltas(spark, sf_dir):
    return rounded(I.delta_means(deltas(spark, sf_dir)))


@query
def paired_tests(spark, sf_dir):
    return I.bh_qvalues(I.paired_tests(deltas(spark, sf_dir)), ["user_id", "contrast"])


@query
def bh_qvalues(spark, sf_dir):
    tests = A.joint_long(A.directional(facts.pairs(spark, sf_dir)), ["user_id", "variant_label"]).select("user_id", "variant_label", "row_model", "col_model", "p_value")
    return rounded(I.bh_qvalues(rounded(tests), ["user_id"]))


@query
def proportion_intervals(spark, sf_dir):
    return rounded(I.proportion_intervals(A.pair_summary(facts.pairs(spark, sf_dir)).select(*PAIR, "n_model_a", "total"), "n_model_a", "total"))


@query
def text_basic(spark, sf_dir):
    docs = facts.table(spark, sf_dir, "documents")
    f = X.features(F.col("text"))
    names = ("word_count", "sentence_count", "paragraph_count", "bullet_count", "step_count", "heading_count", "url_count", "code_block_count", "contraction_count", "type_token_ratio")
    return rounded(docs.select("doc_id", *(f[n].alias(n) for n in names)))


@query
def rubric_scores(spark, sf_dir):
    docs = facts.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("lang") == "en", "novice").when(F.col("lang") == "fr", "researcher").otherwise("other").alias("persona"), *(c.alias(n) for n, c in X.features(F.col("text")).items()))
    return rounded(rows.select("doc_id", *(c.alias(n) for n, c in X.rubric(F.col("persona")).items())))


@query
def indicators_in(spark, sf_dir):
    f, prompt = X.features(F.col("prompt")), F.col("prompt")
    return rounded(facts.dialogues(spark, sf_dir).select("conv_id", "turn", F.length(prompt).alias("input_length_chars"), f["word_count"].alias("input_length_tokens"), (F.length(prompt) > 1000).alias("is_long_context"), f["sentence_count"].alias("input_sentence_count"), f["bullet_count"].alias("input_bullet_count"), f["type_token_ratio"].alias("input_unique_token_ratio"), (f["word_count"] > 250).alias("is_high_complexity_task")))


@query
def indicators_out(spark, sf_dir):
    f = X.features(F.col("response"))
    return rounded(facts.dialogues(spark, sf_dir).select("conv_id", "turn", f["word_count"].alias("output_length_tokens"), f["avg_sentence_length"].alias("avg_sentence_length_output"), f["type_token_ratio"].alias("output_unique_token_ratio"), X.jaccard(F.col("prompt"), F.col("response")).alias("prompt_output_token_overlap_jaccard")))


@query
def prompt_keywords(spark, sf_dir):
    return X.top_keywords(facts.dialogues(spark, sf_dir).select("conv_id", "turn", "prompt"), ["conv_id", "turn"], "prompt")


@query
def repeated_4grams(spark, sf_dir):
    return rounded(facts.table(spark, sf_dir, "documents").select("doc_id", X.repeated_grams(F.col("text")).alias("repeated_4gram_ratio")))


@query
def text_metrics(spark, sf_dir):
    from quillon.functions.text_metrics import with_metrics

    return with_metrics(facts.dialogues(spark, sf_dir), "response", "prompt")


@query
def consensus_filter(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumn("item", F.concat_ws("|", *CONDITION))
    return S.consensus(rows, "item", "judge", "outcome").select("item", "judge", "outcome", "rejection")


@query
def dedup_keep_last(spark, sf_dir):
    rows = facts.table(spark, sf_dir, "lineitem").select("l_partkey", *[c for c in facts.ORDER if c != "l_shipdate"])
    return S.first_per_key(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"], last=True).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query
def dedup_stride(spark, sf_dir):
    keys = facts.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return S.stride(keys, "key", 7, 3)


@query
def equal_allocation(spark, sf_dir):
    orders = facts.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.equal_allocation(orders, ["o_orderstatus", "o_orderpriority"], 5, "o_orderkey")


@query
def anti_join_prior(spark, sf_dir):
    orders = facts.table(spark, sf_dir, "orders")
    rows, prior = orders.select("o_orderkey", "o_custkey"), orders.where("o_orderstatus = 'F'").select("o_custkey")
    return S.without_prior(rows, prior, "o_custkey", orders.where("o_orderkey % 97 = 0").select("o_custkey"))


@query
def interleave_sources(spark, sf_dir):
    nation, region = facts.table(spark, sf_dir, "nation"), facts.table(spark, sf_dir, "region")
    return S.interleave([nation.select(F.col("n_name").alias("name")), region.select(F.col("r_name").alias("name"))], "name").withColumns({"source_index": F.col("source_index").cast("bigint"), "round": F.col("round").cast("bigint")})


@query
def multiselect_counts(spark, sf_dir):
    per_user = facts.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("answer"))
    return S.multiselect_counts(per_user, "answer", least=2)


@query
def best_submission(spark, sf_dir):
    rows = facts.table(spark, sf_dir, "events").select(F.col("user_id").alias("annotator_id"), F.col("event_id"), "ts", "event_type")
    return S.best_submission(rows, "annotator_id", ["ts", "event_id"])


@query
def annotation_stats(spark, sf_dir):
    return S.annotation_stats(rated(spark, sf_dir).withColumn("item", F.concat_ws("|", *CONDITION)), "item", "judge", "outcome")
