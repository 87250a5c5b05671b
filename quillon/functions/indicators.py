"""Indicators of prompts and answers, as column expressions; an empty text counts nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.normalize import clamp, correctness_bucket
from quillon.schema import DIMENSIONS

#: Terms counted over runs of letters and apostrophes, phrases that disclaim.
HEDGING = ("maybe", "might", "perhaps", "likely", "probably", "unsure", "unclear")
OVERCONFIDENT = ("definitely", "certainly", "guaranteed", "always", "never", "obviously")
REFUSAL = ("can't", "cannot", "won't", "unable", "refuse")
FIRST_PERSON = ("i", "i'm", "ive", "i've", "me", "my", "we", "our", "us")
SECOND_PERSON = ("you", "your", "yours")
DISCLAIMERS = ("as an ai language model", "i cannot", "i can't", "i am unable")


def terms(c: Column, among: Sequence[str]) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1)), lambda t: t.isin(*among)))


def _shape(c: Column, prefix: str) -> dict[str, Column]:
    words, plain = X.tokens(c), X.plain_tokens(c)
    ends = F.regexp_count(c, F.lit("[.!?]"))
    return {
        f"{prefix}_length_chars": F.length(c), f"{prefix}_length_tokens": F.size(words), f"{prefix}_sentence_count": F.when(c == "", 0).otherwise(F.greatest(ends, F.lit(1))),
        f"{prefix}_paragraph_count": F.size(F.filter(F.split(c, "\n\n"), lambda p: F.trim(p, F.lit(" \t\r\n")) != "")), f"{prefix}_bullet_count": X.matching(X.lines(c), r"^\s*[-*•]"), f"{prefix}_heading_count": X.matching(X.lines(c), r"^\s*#"),
        f"{prefix}_url_count": F.regexp_count(c, F.lit(r"https?://\S+")), f"{prefix}_inline_code_span_count": F.regexp_count(c, F.lit(r"`[^`\n]+`")),
        f"{prefix}_unique_token_ratio": F.when(F.size(plain) > 0, F.size(F.array_distinct(plain)) / F.size(plain)).otherwise(0.0),
    }


def _doubles(columns: dict[str, Column]) -> dict[str, Column]:
    return {k: v.cast("double") for k, v in columns.items()}


def input_side(prompt: Column, tasks: Column, preferred: Column, context: Column) -> dict[str, Column]:
    """The prompt's indicators and those of a profile: texts ``tasks``, dimensions ``preferred``, a map ``context``."""
    c = F.coalesce(prompt, F.lit(""))
    own = _shape(c, "input")
    n = F.greatest(F.coalesce(F.size(tasks), F.lit(0)), F.lit(0))
    mean = F.when(n > 0, F.aggregate(tasks, F.lit(0.0), lambda s, t: s + F.length(t)) / n).otherwise(0.0)
    return _doubles(own | {
        "is_long_context": (F.length(c) > 1000).cast("int"), "input_code_fence_count": F.regexp_count(c, F.lit("```")), "task_count": n, "avg_task_complexity_proxy": clamp(mean / 800),
        "preferred_dimension_coverage": clamp(F.greatest(F.coalesce(F.size(preferred), F.lit(0)), F.lit(0)) / len(DIMENSIONS)), "context_constraints_count": F.greatest(F.coalesce(F.size(context), F.lit(0)), F.lit(0)),
        "is_high_complexity_task": (own["input_length_tokens"] > 250).cast("int"),
    })


def output_side(prompt: Column, output: Column, context: Column, correctness: Column) -> dict[str, Column]:
    """The answer's indicators; ``context`` is a map of a profile, ``correctness`` a score in [0, 1]."""
    c = F.coalesce(output, F.lit(""))
    own = _shape(c, "output")
    fences, low = F.regexp_count(c, F.lit("```")), F.lower(c)
    values = F.filter(F.map_values(context), lambda v: F.trim(v) != "")
    n = F.greatest(F.coalesce(F.size(values), F.lit(0)), F.lit(0))
    hits = F.when(n > 0, F.size(F.filter(values, lambda v: low.contains(F.lower(v))))).otherwise(0)
    disclaimed = sum((low.contains(p).cast("int") for p in DISCLAIMERS[1:]), low.contains(DISCLAIMERS[0]).cast("int"))
    return _doubles(own | {
        "code_block_count": fences, "code_block_pair_count": F.floor(fences / 2), "has_code_block": (fences > 0).cast("int"), "num_steps_in_explanation": X.matching(X.lines(c), r"^\s*[0-9]+[\).\]]"),
        "output_markdown_link_count": F.regexp_count(c, F.lit(r"\[[^\]]+\]\([^)]+\)")), "output_hedging_term_count": terms(c, HEDGING), "output_overconfidence_term_count": terms(c, OVERCONFIDENT), "output_refusal_term_count": terms(c, REFUSAL),
        "output_disclaimer_term_count": disclaimed, "output_first_person_pronoun_count": terms(c, FIRST_PERSON), "output_second_person_pronoun_count": terms(c, SECOND_PERSON),
        "prompt_output_token_overlap_jaccard": X.jaccard(prompt, c), "context_term_hit_count": hits, "context_term_coverage": F.when(n > 0, hits / n).otherwise(0.0),
        "static_correctness": clamp(correctness), "static_correctness_bucket": correctness_bucket(correctness), "avg_sentence_length_output": own["output_length_tokens"] / F.greatest(F.regexp_count(c, F.lit("[.!?]")), F.lit(1)),
    })
