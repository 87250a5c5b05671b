"""Reading answers, flags and forms that models and people wrote, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.normalize import model_name

#: Names to show, spellings of yes, formats of dates (day first), marks of a change.
DISPLAY_NAMES = {
    "gpt-5.1": "GPT-5.1", "gpt-4o": "GPT-4o", "gpt-oss-20b": "GPT-OSS-20B", "gpt-oss-120b": "GPT-OSS-120B", "qwen3-4b": "Qwen3-4B", "qwen3-8b": "Qwen3-8B", "qwen3-14b": "Qwen3-14B", "qwen3-32b": "Qwen3-32B",
    "gemma-3-4b-it": "Gemma-3-4B", "gemini-3-pro-preview": "Gemini-3-Pro", "gemini-3-flash-preview": "Gemini-3-Flash", "llama-3.3-70b-instruct": "Llama-3.3-70B", "llama-3.1-70b-instruct": "Llama-3.1-70B", "llama-3.1-8b-instruct": "Llama-3.1-8B",
}
YES = ("1", "true", "yes", "y", "t")
DATE_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
UP, DOWN, SAME = "↑", "↓", "•"


def display_name(c: Column) -> Column:
    canonical = model_name(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv]), canonical), canonical)


def judge_answer(c: Column) -> Column:
    """Struct (winner, confidence, rationale) of lines ``winner:``, ``confidence:`` and ``rationale:``; the first of each counts.

    Without a winner line, or with another value, it is a tie; without a
    confidence it is medium. Without a rationale, the other lines are it.
    """
    rows = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda mark: F.get(F.transform(F.filter(rows, lambda x: F.lower(x).startswith(mark)), lambda x: F.trim(F.substring(x, len(mark) + 1, 1 << 30))), F.lit(0))
    said, sure = F.upper(value("winner:")), F.lower(value("confidence:"))
    other = F.array_join(F.filter(rows, lambda x: ~F.lower(x).startswith("winner:") & ~F.lower(x).startswith("confidence:")), " ")
    return F.struct(
        F.when(said.isin("A", "B"), said).otherwise("tie").alias("winner"),
        F.when(sure.contains("high"), "high").when(sure.contains("low"), "low").otherwise("medium").alias("confidence"),
        F.coalesce(value("rationale:"), other).alias("rationale"),
    )


def repaired_json(c: Column) -> Column:
    """Without commas before a closing bracket."""
    return F.regexp_replace(c, r",\s*(?=[}\]])", "")


def lenient_json(c: Column) -> Column:
    """The JSON text inside an answer: in a fence, else from the first to the last bracket; repaired if need be, null if it's none."""
    fence = F.nullif(F.regexp_extract(c, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"([\[{][\s\S]*[}\]])", 1), F.lit(""))
    text = F.coalesce(fence, braces, c)
    fixed = repaired_json(text)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(fixed).isNotNull(), fixed)


def modified_prompt(c: Column) -> Column:
    """A prompt given as text, or as JSON that holds it under ``modified_prompt``."""
    return F.when(F.trim(c).startswith("{"), F.coalesce(F.get_json_object(c, "$.modified_prompt"), c)).otherwise(c)


def pass_at_1(m: Column) -> Column:
    """Pass@1 of a map by k, else its first value."""
    return F.coalesce(F.try_element_at(m, F.lit("1")), F.get(F.map_values(m), F.lit(0)))


def correctness(base_passed: Column, plus_passed: Column, base: Column, plus: Column) -> Column:
    """Mean of the two flags that are there, else of pass@1 of the two maps, else 0."""
    def mean(*parts: Column) -> Column:
        known = F.array_compact(F.array(*parts))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))

    return F.coalesce(mean(base_passed.cast("int").cast("double"), plus_passed.cast("int").cast("double")), mean(pass_at_1(base), pass_at_1(plus)), F.lit(0.0))


def error_types(base_passed: Column, plus_passed: Column) -> Column:
    return F.array_compact(F.array(F.when(~base_passed, "base_failure"), F.when(~plus_passed, "plus_failure")))


def blended(judge: Column, rubric: Column, share: float = 0.7) -> Column:
    return judge * share + rubric * (1 - share)


def loose_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*YES), F.lit(False))


def loose_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.floor(F.trim(c).try_cast("double")).try_cast("bigint"), F.lit(default).cast("bigint"))


def day_first(c: Column) -> Column:
    """A time with the day before the month, or in ISO order; the earliest time if it's neither."""
    tried = [F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tried, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def canonical_choice(choice: Column, shown_swapped: Column) -> Column:
    """A choice among shown answers as one among the record's."""
    turned = F.when(choice == "A", "B").when(choice == "B", "A").otherwise(choice)
    return F.when(F.coalesce(shown_swapped, F.lit(False)), turned).otherwise(choice)


def delta_mark(delta: Column, p: Column, q: Column, alpha: float = 0.05, words: bool = False) -> Column:
    """Direction of a change that is significant by q, or by p where there is no q; empty if it isn't or isn't known."""
    up, down, same = ("Higher", "Lower", "Equal") if words else (UP, DOWN, SAME)
    sure = F.coalesce(F.coalesce(q, p) <= alpha, F.lit(False)) & delta.isNotNull()
    return F.when(sure, F.when(delta > 0, up).when(delta < 0, down).otherwise(same)).otherwise("")


def baseline_cell(rate: Column, against_original: Column, against_control: Column) -> Column:
    """``rate o(p:..,q:..) c(p:..,q:..)`` from two structs (delta, p, q); empty without a rate."""
    part = lambda s: F.concat(F.lit("(p:"), delta_mark(s["delta"], s["p"], F.lit(None)), F.lit(",q:"), F.when(s["q"].isNotNull(), delta_mark(s["delta"], s["p"], s["q"])).otherwise(""), F.lit(")"))
    return F.when(F.coalesce(rate, F.lit("")) == "", "").otherwise(F.concat(rate, F.lit(" o"), part(against_original), F.lit(" c"), part(against_control)))


def short_label(c: Column, names: dict[str, str]) -> Column:
    """A label's short name, whatever its quotes."""
    plain = F.trim(F.translate(c, "‘’“”", "''\"\""))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), plain), plain)


def background(c: Column) -> Column:
    """technical or other, by what a person said of their work."""
    low = F.lower(F.coalesce(c, F.lit("")))
    marks = ("software", "engineer", "developer", "computer", "data", "research")
    found = F.lit(False)
    for mark in marks:
        found = found | low.contains(mark)
    return F.when(low == "", "unknown").when(found, "technical").otherwise("other")


def flat_annotation(c: Column, fields: list[str]) -> Column:
    """Struct of texts of an annotation in JSON, with ``error`` where it is none; lists are joined by ;."""
    text = lenient_json(c)
    parsed = F.from_json(text, "map<string,string>")
    part = lambda f: F.coalesce(F.array_join(F.from_json(F.try_element_at(parsed, F.lit(f)), "array<string>"), "; "), F.try_element_at(parsed, F.lit(f)))
    return F.struct(*[part(f).alias(f) for f in fields], F.when(text.isNull(), "no JSON").alias("error"))


def nested_annotation(flat: Column, lists: list[str], texts: list[str]) -> Column:
    """The reverse: lists from texts joined by ;."""
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(*[items(flat[f]).alias(f) for f in lists], *[flat[f].alias(f) for f in texts])


def fallback_input(sample: Column, label: Column, entry_point: Column, tests: Column) -> Column:
    """An instruction made of what is known where a prompt is missing: three tests at most."""
    return F.concat(
        F.lit("Sample "), sample, F.lit(" ("), F.coalesce(label, F.lit("unknown")), F.lit("). Implement entry point `"), F.coalesce(entry_point, F.lit("unknown_entry_point")), F.lit("`. Key tests: "),
        F.coalesce(F.array_join(F.slice(tests, 1, 3), "; "), F.lit("")),
    )


def entry_point(tests: Column) -> Column:
    """The function that the first assertion calls."""
    return F.nullif(F.regexp_extract(tests, r"assert\s+(?:not\s+)?\(?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), F.lit(""))


def test_text(test_list: Column, code_context: Column, test: Column) -> Column:
    """Tests by the first of three forms that is there."""
    return F.coalesce(F.when(F.size(test_list) > 0, F.array_join(test_list, "\n")), F.nullif(code_context, F.lit("")), F.nullif(test, F.lit("")))
