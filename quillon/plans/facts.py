"""Evaluation facts derived from the driver's tables, which hold no model comparisons of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.aggregate import attempts, pass_metrics
from quillon.operators.voting import pairs_from_scores
from quillon.schema import DIMENSIONS

KEY = ["user_id", "task_id", "variant_label", "judge_model_name"]
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
PERSONA_WEIGHTS = [("persona_0", 1.0), ("persona_1", 2.0), ("persona_2", 0.5)]
DIMENSION_WEIGHTS = [(u, d, float(1 + (i + j) % 3)) for i, (u, _) in enumerate(PERSONA_WEIGHTS) for j, d in enumerate(DIMENSIONS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumns({
        "task_id": F.col("l_partkey").cast("string"),
        "model_name": F.concat(F.lit("model_"), (F.col("l_suppkey") % 4).cast("string")),
        "user_id": F.concat(F.lit("persona_"), (F.col("l_partkey") % 3).cast("string")),
        "variant_label": F.when(flag == "A", "original").when(flag == "N", "personalized").otherwise("control"),
        "judge_model_name": F.when(line == 1, "human_annotator_1").otherwise(F.concat(F.lit("judge_"), F.col("l_linestatus"))),
    })


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score vector for each model, item and judge: that of the first row in full row order."""
    first = ratings_base(spark, sf_dir).groupBy(*KEY, "model_name").agg(F.min(F.struct(*ORDER)).alias("r"))
    score = lambda d: (F.col("r.l_quantity").cast("bigint") * (7 * d + 3) + F.col("r.l_linenumber") * d + F.col("r.l_suppkey")) % 5
    return first.select(*KEY, "model_name", F.array(*[score(d).cast("bigint") for d in range(9)]).alias("scores"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_scores(cells(spark, sf_dir), KEY, DIMENSIONS)


def objective(spark: SparkSession, sf_dir: str, flag: str = "passed") -> DataFrame:
    least = 0.05 if flag == "passed" else 0.03
    rows = ratings_base(spark, sf_dir).withColumn("ok", F.col("l_discount") < least)
    return pass_metrics(attempts(rows, ["user_id", "task_id", "variant_label", "model_name"], ORDER, "ok"))


def subjective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores in [0, 1] of each model and item over the LLM judges."""
    llm = cells(spark, sf_dir).where(~F.col("judge_model_name").startswith("human_"))
    each = [F.avg(F.col("scores")[i] / 4.0).alias(f"subj_{d}") for i, d in enumerate(DIMENSIONS)]
    out = llm.groupBy("user_id", "task_id", "variant_label", "model_name").agg(*each)
    total = sum((F.col(f"subj_{d}") for d in DIMENSIONS[1:]), F.col(f"subj_{DIMENSIONS[0]}"))
    return out.withColumn("subj_overall", total / len(DIMENSIONS))


def persona_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONA_WEIGHTS, "user_id string, weight double")


def dimension_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSION_WEIGHTS, "user_id string, dimension string, weight double")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt, response): assistant turns with the user turn before them."""
    turns = table(spark, sf_dir, "conversations").distinct()
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response")).join(asked, ["conv_id", "turn"])
