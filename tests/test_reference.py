import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import normalize as N
from quillon.functions import stats
from quillon.functions.text import repeated_grams
from quillon.functions.text_metrics import compute
from quillon.operators import agreement as G
from quillon.operators import inference as I
from quillon.operators import voting as V
from quillon.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("flags,k,unbiased,first", [([], 1, 0.0, 0.0), ([True], 5, 1.0, 1.0), ([False, True, False, False], 1, 0.25, 0.0), ([False, True, False, False], 2, 0.5, 1.0), ([True, True, False, False], 2, 5 / 6, 1.0), ([False, False], 2, 0.0, 0.0)])
def test_pass_at_k(spark, flags, k, unbiased, first):
    c = F.array(*map(F.lit, flags)).cast("array<boolean>")
    assert one(spark, stats.pass_at_k(c, k)) == pytest.approx(unbiased)
    assert one(spark, stats.passed_in_k(c, k)) == first


@pytest.mark.parametrize("k,n,p", [(5, 10, 1.0), (9, 10, 0.021484375), (0, 5, 0.0625), (4, 9, 1.0)])
def test_binomial(spark, k, n, p):
    assert one(spark, stats.binomial_p(F.lit(k), F.lit(n))) == pytest.approx(p)


@pytest.mark.parametrize("raw,name", [("OLD_gpt5", "gpt-5.1"), ("old_OLD_gpt4", "gpt-4o"), ("x/qwen3-8b", "qwen3-8b"), ("Own Model", "Own Model")])
def test_model_names(spark, raw, name):
    assert one(spark, N.model_name(F.lit(raw))) == name


@pytest.mark.parametrize("p1,c1,p2,c2,strict,fine", [("A", "high", "B", "low", "model_a", "model_a"), ("A", "high", "A", "low", "tie", "model_a"), ("A", "medium", "tie", "low", "tie", "model_a"), ("A", "low", "tie", "high", "tie", "tie"), ("A", "high", "A", "high", "tie", "tie")])
def test_swap(spark, p1, c1, p2, c2, strict, fine):
    args = [F.lit(x) for x in (p1, c1, p2, c2)]
    assert one(spark, V.swap_tested(*args, False)[0]) == strict
    assert one(spark, V.swap_tested(*args, True)[0]) == fine


def test_bh(spark):
    df = spark.createDataFrame([("g", 0.01), ("g", 0.04), ("g", 0.03), ("g", None)], "g string, p_value double")
    got = {r["p_value"]: r["q_value"] for r in I.bh_qvalues(df, ["g"]).collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.04] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.04) and got[None] is None


def test_kappa_and_fleiss(spark):
    rows = [(i, j, o) for j, outcomes in (("j1", "aatb"), ("j2", "abtb")) for i, o in enumerate(outcomes)]
    names = {"a": "model_a", "b": "model_b", "t": "tie"}
    rated = spark.createDataFrame([(i, j, names[o]) for i, j, o in rows], "item int, judge string, outcome string")
    r = G.judge_pairs(rated, ["item"]).first()
    assert (r["n_items"], r["percent"]) == (4, 0.75) and r["kappa"] == pytest.approx((0.75 - 0.3125) / (1 - 0.3125))
    same = spark.createDataFrame([(i, j, o) for j in ("x", "y", "z") for i, o in ((1, "model_a"), (2, "model_b"))], "item int, judge string, outcome string")
    assert G.fleiss(same, ["item"]).first()["fleiss_kappa"] == 1.0


def test_clopper_pearson():
    low, high = I.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(0.30849710781876)


def test_clopper_pearson_of_millions():
    from math import comb
    from time import process_time

    began = process_time()
    low, high = I.clopper_pearson(1_500_000, 3_000_000)
    assert (low, high) == (pytest.approx(0.4994340406950757, abs=1e-9), pytest.approx(1 - 0.4994340406950757, abs=1e-9)) and process_time() - began < 5
    for k, n in ((1, 7), (6, 7), (30, 57), (200, 400)):  # the tails at the ends are what the level leaves
        low, high = I.clopper_pearson(k, n)
        tail = lambda p, at: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in at)  # noqa: B023, E731
        assert tail(low, range(k, n + 1)) == pytest.approx(0.025) and tail(high, range(k + 1)) == pytest.approx(0.025)


def test_text(spark):
    assert one(spark, repeated_grams(F.lit("a b c d a b c d"))) == pytest.approx(1 / 5)
    m = compute("# One\n# One\nWhat input? Do you need it? it depends", "must use `foo_bar`")
    assert m["num_headers_all"] == 2 and m["sectional_symmetry_score_all"] == 0.5 and m["num_questions_to_user_all"] == 2 and m["blocking_questions_all"] == 1
    assert compute(None)["word_count_all"] == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "persona_x").mkdir(parents=True)
    (tmp_path / "in" / "persona_x" / "a.json").write_text(json.dumps({"results": [{"task_id": "1"}, {"task_id": "2"}]}))
    (tmp_path / "in" / "persona_x" / "b.jsonl").write_text('{"task_id": "3"}\n{"task_id": "4"}\n')
    got = readers.read_artifacts(spark, str(tmp_path / "in"), "task_id string")
    assert sorted(r["task_id"] for r in got.collect()) == ["1", "2", "3", "4"]
    assert got.select(readers.path_fields(F.col("file_path"), {"persona": "persona"})["persona"]).distinct().collect()[0][0] == "x"
    (tmp_path / "s.csv").write_text('Who,Q1,Q1\nlabel,"a, b",c\n"{""ImportId"":""x""}",y,z\nann,1,2\n')
    assert readers.read_survey(spark, str(tmp_path / "s.csv")).columns == ["who", "q1", "q1__2"]
    sinks.write_csv(spark.createDataFrame([("m", 1, 0.5)], "model_name string, n_x int, a_mean double"), str(tmp_path / "out"))
    assert "0.50" in sinks.latex_table(spark.createDataFrame([("m_1", 0.5)], "model_name string, rate double"), ["model_name", "rate"], "x")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
