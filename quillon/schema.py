"""Names and guards shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The nine quality dimensions in report order, prompt types and confidence levels.
DIMENSIONS = ("clarity", "tone_style_fit", "workflow_fit", "cognitive_load", "context_awareness", "persona_consistency", "friction_loss_of_control", "reliability_user_trust", "anthropomorphism")
PROMPT_TYPES = ("original", "personalized", "control")
CONFIDENCE = ("low", "medium", "high")
PAIR = ("model_a", "model_b")
ITEM = ("user_id", "task_id", "variant_label")


def require(df: DataFrame, columns: Sequence[str], non_null: bool = False) -> DataFrame:
    """``df`` if it has the columns; with ``non_null`` a row that lacks a value fails when it is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if not non_null:
        return df
    checked = {c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}"))) for c in columns}
    return df.withColumns(checked)


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that ``df`` has: optional parts of a key."""
    return [c for c in columns if c in df.columns]
