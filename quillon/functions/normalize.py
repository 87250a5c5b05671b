"""Canonical forms of names, identifiers and labels, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which a model occurs, and its canonical name.
BY_ALIAS = {
    "gpt5": "gpt-5.1",
    "gpt5.1": "gpt-5.1",
    "gpt-5.1": "gpt-5.1",
    "gpt-5.1-2025-11-13": "gpt-5.1",
    "gpt4": "gpt-4o",
    "gpt4-o": "gpt-4o",
    "gpt-4o": "gpt-4o",
    "gpt-oss": "gpt-oss-20b",
    "gpt-oss-20b": "gpt-oss-20b",
    "gpt-oss-low-effort": "gpt-oss-20b",
    "gpt-oss-low-effort-4bit": "gpt-oss-20b",
    "gpt-oss-medium-effort": "gpt-oss-20b",
    "gpt-oss-high-effort": "gpt-oss-20b",
    "openai/gpt-oss-20b": "gpt-oss-20b",
    "unsloth/gpt-oss-20b": "gpt-oss-20b",
    "unsloth/gpt-oss-20b-unsloth-bnb-4bit": "gpt-oss-20b",
    "gpt-oss-120b": "gpt-oss-120b",
    "gpt-oss-120b-low-effort": "gpt-oss-120b",
    "openai/gpt-oss-120b": "gpt-oss-120b",
    "qwen3-4b": "qwen3-4b",
    "qwen/qwen3-4b": "qwen3-4b",
    "unsloth/qwen3-4b": "qwen3-4b",
    "unsloth/qwen3-4b-unsloth-bnb-4bit": "qwen3-4b",
    "qwen3-8b": "qwen3-8b",
    "qwen/qwen3-8b": "qwen3-8b",
    "unsloth/qwen3-8b": "qwen3-8b",
    "unsloth/qwen3-8b-unsloth-bnb-4bit": "qwen3-8b",
    "qwen3-14b": "qwen3-14b",
    "qwen3_14b": "qwen3-14b",
    "qwen3-14b-low-max-tokens": "qwen3-14b",
    "qwen/qwen3-14b": "qwen3-14b",
    "unsloth/qwen3-14b": "qwen3-14b",
    "unsloth/qwen3-14b-unsloth-bnb-4bit": "qwen3-14b",
    "qwen3-32b": "qwen3-32b",
    "qwen3_32b": "qwen3-32b",
    "qwen3-32b-low-max-tokens": "qwen3-32b",
    "qwen/qwen3-32b": "qwen3-32b",
    "unsloth/qwen3-32b": "qwen3-32b",
    "unsloth/qwen3-32b-unsloth-bnb-4bit": "qwen3-32b",
    "gemma3-4b": "gemma-3-4b-it",
    "gemma-3-4b-it": "gemma-3-4b-it",
    "google/gemma-3-4b-it": "gemma-3-4b-it",
    "gemini3-pro": "gemini-3-pro-preview",
    "gemini-3-pro-preview": "gemini-3-pro-preview",
    "gemini3-flash": "gemini-3-flash-preview",
    "gemini-3-flash-preview": "gemini-3-flash-preview",
    "llama3-70b": "llama-3.3-70b-instruct",
    "llama-3.3-70b-instruct": "llama-3.3-70b-instruct",
    "meta-llama/llama-3.3-70b-instruct": "llama-3.3-70b-instruct",
    "meta-llama/llama-3.1-70b-instruct": "llama-3.1-70b-instruct",
    "meta-llama/llama-3.1-8b-instruct": "llama-3.1-8b-instruct",
    "meta-llama/llama-3-70b-instruct": "llama-3-70b-instruct",
    "claude-3-5-sonnet": "claude-3.5-sonnet",
    "claude-3-5-sonnet-20241022": "claude-3.5-sonnet",
    "claude-3-opus": "claude-3-opus",
    "claude-3-opus-20240229": "claude-3-opus",
    "gpt-4": "gpt-4",
    "gpt-4-turbo": "gpt-4-turbo",
    "gpt-4-turbo-preview": "gpt-4-turbo",
    "gpt-3.5-turbo": "gpt-3.5-turbo",
}
#: The pattern of artifact file names.
ARTIFACT_NAME = r"^([a-z0-9_-]+)_([a-z0-9_-]+)_([a-z0-9\-_:]+?)(?:_([0-9]{8}T[0-9]{6}Z))?_(v[0-9]{2})\.([a-z0-9]+)$"
VARIATION = "::variation::"


def _mapped(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), key)


def model_name(c: Column) -> Column:
    """Without leading OLD_ marks, by the alias of the whole lower-case name, then of what follows its last slash, else as it is."""
    raw = F.regexp_replace(F.trim(c), "^(?i)(old_)+", "")
    low = F.lower(raw)
    return F.coalesce(_mapped(low, BY_ALIAS), F.when(low.contains("/"), _mapped(F.element_at(F.split(low, "/"), -1), BY_ALIAS)), raw)


def token(c: Column) -> Column:
    """Lower case, runs of other characters than letters, digits, - and _ become one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9\\-_]+", "-"), "^-+|-+$", "")


def prompt_type(c: Column) -> Column:
    """original, personalized or control, by marks in an identifier; control marks come first."""
    low = F.lower(F.coalesce(c, F.lit("")))
    control = _any(low, ("control_var", "::control", "-control-metrics", "::variation::control_", "variation_control_"))
    personal = _any(low, ("::variation::", "-var", "-variation-", "-personalized-metrics"))
    return F.when(control, "control").when(personal, "personalized").otherwise("original")


def _any(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | c.contains(mark)
    return out


def variant_fields(identifier: Column, label: Column, variant: Column) -> tuple[Column, Column, Column]:
    """(task_id, variant_label, variant_id) of an identifier ``task::variation::variant``, given values first."""
    parts = F.split(identifier, VARIATION, 2)
    task = parts[0]
    variant_id = F.coalesce(F.nullif(variant, F.lit("")), F.nullif(F.get(parts, F.lit(1)), F.lit("")), task)
    given = F.lower(F.coalesce(label, F.lit("")))
    known = F.when(given.isin("original", "personalized", "control"), given)
    return task, F.coalesce(known, prompt_type(F.concat_ws(" ", F.coalesce(identifier, F.lit("")), variant_id))), variant_id


def missing(c: Column) -> Column:
    """Null for null and for the texts that stand for it."""
    return F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.trim(c))


def user_id(c: Column) -> Column:
    """Text ids; what reads as a whole number is written without a fraction."""
    text = missing(c)
    number = text.try_cast("double")
    whole = number.isNotNull() & (F.abs(number) < 9e15) & (number == F.floor(number))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(text)


def sample_key(task: Column, variant: Column) -> Column:
    return F.when(variant.isNotNull() & (variant != task), F.concat_ws("::", task, variant)).otherwise(task)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def error_rationale(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^(evaluation|parse) error:"), F.lit(False))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def swap_choice(c: Column) -> Column:
    return F.when(c == "A", "B").when(c == "B", "A").otherwise(c)


def correctness_bucket(c: Column) -> Column:
    return F.when(c >= 0.9, 1.0).when(c >= 0.5, 0.5).otherwise(0.0)


def judge_score(c: Column) -> Column:
    """``score: 7/10`` and the like as 0 to 1; values above 1 are tenths; 0.5 without a number."""
    value = F.regexp_extract(F.lower(c), r"score\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(value.isNull(), 0.5).otherwise(clamp(F.when(value > 1, value / 10).otherwise(value)))


def item_id(target: Column, part: Column) -> Column:
    return F.concat(F.lit("ha_"), F.substring(F.sha1(F.concat_ws("|", target, part).cast("binary")), 1, 12))


def stable_seed(*parts: Column) -> Column:
    """crc32 of the parts with | between them."""
    return F.crc32(F.concat_ws("|", *parts).cast("binary"))


def artifact_name(c: Column) -> Column:
    """Struct of an artifact file name ``artifact_evaluation_detail[_timestamp]_vNN.ext``."""
    names = ("artifact", "evaluation", "detail", "timestamp", "version", "ext")
    return F.struct(*[F.nullif(F.regexp_extract(c, ARTIFACT_NAME, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])
