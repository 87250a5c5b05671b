"""Scans of evaluation artifacts: JSON, JSON lines, CSV, trees of them, and survey exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.functions.normalize import artifact_name, missing

WRAPPERS = ("results", "profiles", "samples")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row for each element of a JSON array, or for a bare object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, rename: dict[str, str] | None = None) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).withColumnsRenamed(rename or {})


def read_artifacts(spark: SparkSession, path: str, schema: str, recursive: bool = True, pattern: str = "*.json*") -> DataFrame:
    """Records of all artifacts below ``path`` with their place: file_path, modified, artifact_index.

    ``.jsonl`` files hold a record a line and are split like any text; other
    files hold an array, an object that wraps one (results, profiles, samples) or
    a bare object, and are read whole. A record that isn't JSON fails.
    """
    source = spark.read.option("recursiveFileLookup", recursive)
    place = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")]
    lined = source.option("pathGlobFilter", f"{pattern.rstrip('*')}l" if pattern.endswith(".json*") else pattern)
    lines = lined.text(path).select("value", *place, F.col("_metadata.file_block_start").alias("start")).where("file_path like '%.jsonl' and trim(value) <> ''")
    own = F.from_json("value", f"struct<{schema}>", {"mode": "FAILFAST"})
    at = Window.partitionBy("file_path").orderBy("start", "line")
    rows = lines.withColumn("line", F.monotonically_increasing_id()).select("file_path", "modified", (F.row_number().over(at) - 1).cast("bigint").alias("artifact_index"), own.alias("record"))
    whole = source.option("pathGlobFilter", pattern).text(path, wholetext=True).select("value", *place).where("file_path not like '%.jsonl'")
    listed = F.coalesce(*[F.get_json_object("value", f"$.{w}") for w in WRAPPERS], F.col("value"))
    listed = F.when(F.trim(listed).startswith("["), listed).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    items = whole.select("file_path", "modified", F.posexplode(F.from_json(listed, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("artifact_index", "record"))
    both = items.withColumn("artifact_index", F.col("artifact_index").cast("bigint")).unionByName(rows)
    return both.select("file_path", "modified", "artifact_index", "record.*")


def path_fields(path: Column, fields: dict[str, str]) -> dict[str, Column]:
    """Columns from directories named ``prefix_value``: {column: prefix}; null where the path has none."""
    return {name: F.nullif(F.regexp_extract(path, f"/{prefix}_([^/]+)/", 1), F.lit("")) for name, prefix in fields.items()}


def newest(files: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last file of each group by ``order``, such as version, timestamp, modified, path."""
    return files.groupBy(*by).agg(F.max_by("file_path", F.struct(*order)).alias("file_path"))


def with_artifact_name(files: DataFrame) -> DataFrame:
    return files.withColumn("name", artifact_name(F.element_at(F.split("file_path", "/"), -1)))


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """A survey export: a row of names, optional rows of labels and import ids, then responses.

    Names are lower-cased and joined by _; a repeated name gets __2, __3 and so
    on. The header is one line; responses stay distributed.
    """
    raw = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    header = raw.limit(1).collect()[0]
    names, seen = [], {}
    for value in header:
        name = "_".join("".join(c if c.isalnum() else " " for c in (value or "column").lower()).split())
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    rows = raw.toDF(*names)
    # Up to two more rows describe the columns: those before, and the one that holds, the import ids.
    top = raw.limit(3).collect()
    ids = next((i for i, row in enumerate(top) if any((x or "").startswith('{"ImportId"') for x in row)), 0)
    done = rows
    for row in top[: ids + 1]:
        is_it = F.lit(True)
        for n, x in zip(names, row, strict=True):
            is_it = is_it & F.col(f"`{n}`").eqNullSafe(F.lit(x))
        done = done.where(~is_it)
    return done.withColumns({n: missing(F.col(f"`{n}`")) for n in names})


def unify(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def attempts_of(results: DataFrame, flags: str = "per_attempt") -> DataFrame:
    """One row for each attempt of a result: attempt (from 0) and passed."""
    return results.select(*[c for c in results.columns if c != flags], F.posexplode(flags).alias("attempt", "passed"))
