import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import code, parsing
from quillon.functions.text_metrics import compute, deictic_metrics, persona_metrics, register_drift
from quillon.operators import agreement as G
from quillon.operators import selection as C
from quillon.operators import study as Y
from quillon.sources import readers, sinks
from quillon.sources import records as R
from quillon.sources import samples as M
from quillon.sources import settings


def record(**changes):
    dim = {"winner": "A", "winner_model": None, "confidence": "high", "rationale": "", "position_bias_detected": False, "original_order_result": None, "swapped_order_result": None}
    base = {"user_id": "3.0", "task_id": "12::variation::12-u-var1", "model_a_name": "qwen3-8b", "model_b_name": "gpt4", "overall_winner": "qwen/qwen3-8b", "judge_model_name": "gpt5", "input_text": None, "pairwise_judgment_type": None}
    return {**base, "dimension_results": {"clarity": dim, "workflow_fit": {**dim, "winner": "tie"}, "other": dim}, "metadata": None, "_model_metadata": None, **changes}


def test_pairwise_record(spark):
    r = R.pairwise(spark.createDataFrame([record()], R.PAIRWISE)).first()
    assert (r["user_id"], r["task_id"], r["variant_label"], r["model_a"], r["model_b"], r["swapped"]) == ("3", "12", "personalized", "gpt-4o", "qwen3-8b", True)
    assert r["winners"] == {"clarity": "model_b", "workflow_fit": "tie"} and r["overall"] == "model_b" and (r["win_a"], r["win_b"], r["win_tie"]) == (0, 1, 1)
    assert r["judge_model_name"] == "gpt-5.1" and r["judgment_type"] == "persona"


@pytest.mark.parametrize("changes", [{"task_id": None}, {"model_b_name": None}, {"model_b_name": "Qwen/Qwen3-8B"}, {"overall_winner": "someone"}, {"pairwise_judgment_type": "odd"}])
def test_bad_pairwise_records_fail(spark, changes):
    with pytest.raises(Exception):
        R.pairwise(spark.createDataFrame([record(**changes)], R.PAIRWISE)).collect()


def test_survey_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Who,Q1,Q1\nlabel,"a, b",c\n"{""ImportId"":""x""}",y,z\nann,1,2\nbob,nan,3\n')
    assert [tuple(r) for r in readers.read_survey(spark, str(tmp_path / "s.csv")).collect()] == [("ann", "1", "2"), ("bob", None, "3")]
    (tmp_path / "t.csv").write_text("who,q\nann,1\n")
    assert [tuple(r) for r in readers.read_survey(spark, str(tmp_path / "t.csv")).collect()] == [("ann", "1")]


def test_json_lines_keep_their_places(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"task_id": str(i)}) + "\n" for i in range(50)))
    rows = readers.read_artifacts(spark, str(tmp_path), "task_id string").collect()
    assert {r["artifact_index"]: r["task_id"] for r in rows} == {i: str(i) for i in range(50)}


def test_text_metrics():
    assert deictic_metrics("see above 2024-01-02, next week; the previous message") == {"deictic_terms_count": 2.0, "deictic_resolutions_count": 2.0}
    assert deictic_metrics("today " + "x " * 11 + "January")["deictic_resolutions_count"] == 0
    assert register_drift("no header") == 0 and register_drift("# A\nmaybe so.\n# B\none two three four five.") > 0
    assert persona_metrics("explain the pitfall", "python_novice_1")["persona_lexicon_rate_per_100w"] == pytest.approx(200 / 3)
    with pytest.raises(ValueError):
        persona_metrics("x", "nobody")
    assert "register_drift_score" in compute("x", "y", "ai_researcher_2")


def test_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert tuple(one(parsing.judge_answer(F.lit("Winner: b\nConfidence: LOW!\nbecause\nof it")))) == ("B", "low", "because of it")
    assert one(parsing.lenient_json(F.lit('x {"a": [1,2,],} y'))) == '{"a": [1,2]}' and one(parsing.lenient_json(F.lit("none"))) is None
    assert one(parsing.delta_mark(F.lit(0.1), F.lit(0.9), F.lit(0.01))) == parsing.UP and one(parsing.delta_mark(F.lit(0.1), F.lit(0.9), F.lit(None).cast("double"))) == ""
    assert code.sanitized("```\ndef f(x):\n    return f(x)\n```", "g") == "def g(x):\n    return g(x)" and code.sanitized("no code here", "g") == ""


def test_selection(spark):
    assert C.task_numbers("1,3-5,8") == [1, 3, 4, 5, 8]
    assert C.omitted(["frustration", "subj_clarity"]) == ({"friction_loss_of_control", "clarity"}, {"subj_friction_loss_of_control", "subj_clarity"})
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        C.equal_to(df, {"k": "b"})
    with pytest.raises(ValueError):
        C.exact_types(df, [{"k": "a"}, {"k": "z"}])


def test_study(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2], "pq"[i // 2 % 2]) for i in range(40)], "id int, a string, b string")
    assert {r["count"] for r in Y.equal_allocation(df, ["a", "b"], 12, 1, ["id"]).groupBy("a", "b").count().collect()} == {3}
    for total in (13, 400):
        with pytest.raises(ValueError):
            Y.equal_allocation(df, ["a", "b"], total, 1, ["id"])
    kinds = [{"a": "x"}, {"a": "x"}, {"a": "y"}]
    drawn = Y.explicit_targets(df, Y.type_quotas(df, kinds, 9, "id"), 3, ["id"]).groupBy("a").count().collect()
    assert {r["a"]: r["count"] for r in drawn} == {"x": 6, "y": 3}
    with pytest.raises(ValueError):
        Y.type_quotas(df, [{"a": "x"}, {"b": "p"}], 2, "id")
    assert Y.subtracted(kinds, [{"a": "x"}]) == [{"a": "x"}, {"a": "y"}]
    shared = Y.assign_shared(df, ["m", "n"], 2, "id", 4, ["a"])
    assert Y.packets(shared, 22).count() == 44 and shared.where("shared").select("id").distinct().count() == 4


def test_agreement_with_one_judge(spark):
    rated = spark.createDataFrame([(1, "g", "j", "model_a"), (2, "g", "j", "tie"), (1, "h", "j", "tie"), (1, "h", "k", "tie"), (2, "h", "j", "model_a"), (2, "h", "k", "model_b")], "item int, g string, judge string, outcome string")
    rows = {r["g"]: r for r in G.tables(rated, ["g", "item"], ["g"]).collect()}
    assert rows["g"]["n_judge_pairs"] == 0 and rows["g"]["percent_mean"] is None and rows["h"]["percent_mean"] == 0.5 and rows["h"]["fleiss_items"] == 2
    low = {r["g"]: (r["percent_low"], r["percent_high"]) for r in G.intervals(rated, ["g", "item"], ["g"], 200).collect()}
    assert low["g"] == (None, None) and low["h"] == (0.0, 1.0)


def test_controls_and_units(spark):
    variation = ("v", [], "p", "personalized", "personalized", None)
    samples = spark.createDataFrame([("b", "1", "q", [variation]), ("b", "2", "q", [])], f"source_benchmark string, sample_id string, prompt string, variations array<{M.VARIATION}>")
    controls = spark.createDataFrame([("b", 2, "1", "c2", 2), ("b", 1, "1", "c1", 1), ("b", 1, "2", "c", 1)], "benchmark string, position int, task_id string, prompt string, variation_count int")
    got = M.units(M.with_controls(samples, M.control_prompts(controls)))
    assert sorted(r["unit_id"] for r in got.collect()) == ["1", "1::variation::control_1", "1::variation::v", "2"]


def test_settings(tmp_path):
    (tmp_path / "p.yaml").write_text("user_id: u\noutput_dimensions:\n  workflow_fit: 3\n  reliability: high\n")
    weights = {d: w for _, d, w in settings.persona_weights([str(tmp_path / "p.yaml")])}
    assert weights["workflow_fit"] == 3.0 and weights["reliability_user_trust"] == 1.0
    (tmp_path / "q.yaml").write_text("user_id: w\noutput_dimensions:\n  workflow_fit: 0\n")
    with pytest.raises(ValueError):
        settings.persona_weights([str(tmp_path / "q.yaml")])


def test_printed_tables(spark):
    long = spark.createDataFrame([("u", "original", "a", "b", 0.125, True), ("u", "original", "b", "a", 0.875, False)], "user_id string, variant_label string, row_model string, col_model string, win_rate double, significant boolean")
    assert "b vs a & original & 0.88" in sinks.overall_latex(long)
    assert sinks.half_even(0.125) == "0.12" and sinks.half_even(None) == "--"
