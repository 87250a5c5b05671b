"""Trees of artifacts: what a path says, which file counts, which judges, pairs and settings there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.normalize import artifact_name, model_name, token
from quillon.sources.records import judgment_type


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_path, modified) of all files below ``path``; contents aren't read."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return out.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"))


def _part(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def with_place(df: DataFrame, root: str, path: str = "file_path") -> DataFrame:
    """Adds what directories below ``root`` say: persona, pair, judge, generator, filter, prompt and judgment type.

    A pair's models come in canonical order of their tokens, whatever their
    order in the path.
    """
    inside = F.substring_index(F.regexp_replace(path, "^file:/+", "/"), root.rstrip("/") + "/", -1)
    p = F.concat(F.lit("/"), inside)
    a, b = _part(p, "/models_([^/]+?)_vs_[^/]+/"), _part(p, "/models_[^/]+?_vs_([^/]+)/")
    swap = F.struct(token(a), a) > F.struct(token(b), b)
    return df.withColumns({
        "persona": _part(p, "^/([^/]+)/"), "model": _part(p, "/model_([^/]+)/"), "model_a": F.when(swap, b).otherwise(a), "model_b": F.when(swap, a).otherwise(b), "judge": _part(p, "/(?:OLD_)?judge_model_([^/]+)/"), "generator": _part(p, "/gen_model_([^/]+)/"),
        "filter": _part(p, "/filter_model_([^/]+)/"), "prompt_type": _part(p, "/prompt_type_([^/]+)/"), "judgment_type": judgment_type(_part(p, "/judgment_type_([^/]+)/")),
        "run": _part(p, "/run_([^/]+)/"), "name": artifact_name(F.element_at(F.split(path, "/"), -1)),
    })


def newest(placed: DataFrame, by: Sequence[str], prefer_json: bool = True) -> DataFrame:
    """One file for each place: JSON before CSV, prompt directories before older layouts, then version, timestamp, time of change, path."""
    order = F.struct(
        (F.col("file_path").endswith(".json") | F.col("file_path").endswith(".jsonl") if prefer_json else F.lit(True)).alias("json"), F.col("prompt_type").isNotNull().alias("typed"),
        F.coalesce("name.version", F.lit("")).alias("version"), F.coalesce("name.timestamp", F.lit("")).alias("at"), "modified", "file_path",
    )
    rest = [c for c in placed.columns if c not in by]
    return placed.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def with_shared_reference(placed: DataFrame, reference: str) -> DataFrame:
    """Artifacts, and for each other persona those of the reference persona that hold for all: general_user judgments of original and control prompts."""
    shared = placed.where((F.col("persona") == reference) & (F.col("judgment_type") == "general_user") & F.col("prompt_type").isin("original", "control"))
    others = placed.select(F.col("persona").alias("__p")).distinct().where(F.col("__p") != reference)
    again = shared.crossJoin(others).withColumn("persona", F.col("__p")).drop("__p")  # each shared artifact once for each persona: the result itself
    return placed.withColumn("shared", F.lit(False)).unionByName(again.withColumn("shared", F.lit(True)))


def settings(placed: DataFrame) -> DataFrame:
    """Distinct (persona, generator, filter, prompt type, judgment type), in order of their tokens."""
    keys = ["persona", "generator", "filter", "prompt_type", "judgment_type"]
    return placed.select(*keys).distinct().orderBy(*[token(F.col(k)) for k in keys])


def judges(placed: DataFrame, model_a: str, model_b: str) -> DataFrame:
    return placed.where((F.col("model_a") == model_a) & (F.col("model_b") == model_b)).select("judge").distinct().orderBy("judge")


def model_pairs(placed: DataFrame) -> DataFrame:
    """Each unordered pair once, under its canonical names, with the first directory that holds it."""
    named = placed.where("model_a is not null").select(model_name(F.col("model_a")).alias("model_a"), model_name(F.col("model_b")).alias("model_b"), F.regexp_replace("file_path", "/[^/]+$", "").alias("directory"))
    return named.groupBy("model_a", "model_b").agg(F.min("directory").alias("directory")).orderBy(token(F.col("model_a")), token(F.col("model_b")))


def candidates(rows: DataFrame, keys: Sequence[str], allow: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Records of artifacts with source_key, the keys joined by |; ``allow`` limits fields to lists of values."""
    out = rows
    for field, values in (allow or {}).items():
        out = out.where(F.col(field).isin(*values))
    return out.withColumn("source_key", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def task_ids(parts: Sequence[DataFrame]) -> DataFrame:
    """All task ids of several judges' artifacts, sorted."""
    out = parts[0].select("task_id")
    for p in parts[1:]:
        out = out.union(p.select("task_id"))
    return out.distinct().orderBy("task_id")
