"""Deterministic text features as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.normalize import clamp, safe_div

#: Words and phrases that the features count.
FRIENDLY = ("let's", "awesome", "great", "friendly")
DIRECTIVE = ("must", "ensure", "required")
APOLOGY = ("sorry", "apologies")
HEDGING = ("maybe", "might", "perhaps")
OVERCONFIDENT = ("definitely", "certainly", "guaranteed", "always", "never", "obviously")
REFUSAL = ("can't", "cannot", "won't", "unable", "refuse")
FIRST_PERSON = ("i", "i'm", "ive", "i've", "me", "my", "we", "our", "us")
SECOND_PERSON = ("you", "your", "yours", "you're")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "hers", "him", "his", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "ours", "she", "so", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this", "to", "too", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your", "yours")


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def plain_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.?!]"), lambda x: F.trim(x)), lambda x: x != "")


def without_code(c: Column) -> Column:
    return F.regexp_replace(c, r"```[\s\S]*?```", "")


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"```[^\n`]*\n([\s\S]*?)```"), F.lit(1))


def among(words: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda x: F.lower(x).isin(list(terms))))


def matching(parts: Column, pattern: str) -> Column:
    return F.size(F.filter(parts, lambda x: x.rlike(pattern)))


def features(c: Column) -> dict[str, Column]:
    """The counters that rubric scores are made of; null text counts as empty."""
    text = F.coalesce(c, F.lit(""))
    words, plain, rows = tokens(text), plain_tokens(text), lines(text)
    ends = F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1))
    out = {
        "word_count": F.size(words),
        "sentence_count": ends,
        "avg_sentence_length": F.size(words) / ends,
        "paragraph_count": F.greatest(F.size(F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != "")), F.lit(1)),
        "bullet_count": matching(rows, r"^\s*[-*•]"),
        "step_count": matching(rows, r"^\s*[0-9]+[\).\]]"),
        "code_block_count": F.regexp_count(text, F.lit("```")),
        "url_count": F.regexp_count(text, F.lit(r"https?://\S+")),
        "inline_code_count": F.regexp_count(text, F.lit(r"`[^`\n]+`")),
        "heading_count": matching(rows, r"^\s*#"),
        "contraction_count": F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+'[A-Za-z0-9_]+")),
        "type_token_ratio": safe_div(F.size(F.array_distinct(plain)).cast("double"), F.size(plain)),
        "friendly_markers": among(words, FRIENDLY),
        "directive_markers": among(words, DIRECTIVE),
        "apology_terms": among(words, APOLOGY),
        "hedging_terms": among(words, HEDGING),
        "overconfidence_terms": among(words, OVERCONFIDENT),
        "refusal_terms": among(words, REFUSAL),
        "disclaimer_terms": F.lower(text).contains("as an ai language model").cast("int"),
        "first_person_pronouns": among(words, FIRST_PERSON),
    }
    return {k: v.cast("double") for k, v in out.items()}


def rubric(persona: Column) -> dict[str, Column]:
    """Scores in [0, 1] from a table with the columns of ``features``."""
    f = F.col
    most = lambda name, n: F.least(f(name), F.lit(float(n)))
    clarity = clamp(1 - F.least(f("avg_sentence_length") / 30, F.lit(1.2)) + most("bullet_count", 5) * 0.04 + most("paragraph_count", 6) * 0.02)
    who = F.lower(F.coalesce(persona, F.lit("")))
    novice, expert = who.contains("novice"), who.contains("expert") | who.contains("researcher")
    tone = clamp(
        F.when(novice, 0.5 + most("step_count", 6) * 0.05 + most("friendly_markers", 4) * 0.04 - most("directive_markers", 3) * 0.05)
        .when(expert, 0.5 + (1 - F.least(f("word_count") / 600, F.lit(1.0))) * 0.4 + most("code_block_count", 4) * 0.05 - most("friendly_markers", 3) * 0.03)
        .otherwise(0.5 + most("bullet_count", 5) * 0.03)
    )
    varied = F.when(f("type_token_ratio") > 0, F.least(f("type_token_ratio"), F.lit(0.65)) / 0.65 * 0.1).otherwise(0.0)
    return {
        "clarity": clarity,
        "tone_style_fit": tone,
        "workflow_fit": clamp(1 - F.least(f("word_count") / 450, F.lit(1.2)) + most("code_block_count", 4) * 0.05 + most("step_count", 6) * 0.03),
        "cognitive_load": clamp((clarity + most("step_count", 6) * 0.05) / 1.1),
        "persona_consistency": clamp(tone + F.when(novice, most("step_count", 5) * 0.03).otherwise(most("code_block_count", 4) * 0.04)),
        "friction_loss_of_control": clamp(1 - (most("apology_terms", 3) * 0.1 + most("hedging_terms", 5) * 0.05) + most("paragraph_count", 5) * 0.02),
        "reliability_user_trust": clamp(
            0.55 + most("code_block_count", 4) * 0.05 + most("step_count", 6) * 0.02 + most("url_count", 3) * 0.03 - most("overconfidence_terms", 4) * 0.06
            - F.when(f("refusal_terms") > 0, 0.15).otherwise(0.0) - most("disclaimer_terms", 2) * 0.1 - F.when(f("hedging_terms") > 8, 0.05).otherwise(0.0)
        ),
        "anthropomorphism": clamp(0.45 + most("contraction_count", 6) * 0.03 + most("first_person_pronouns", 6) * 0.02 + most("friendly_markers", 4) * 0.05 + varied - most("disclaimer_terms", 2) * 0.15),
    }


def context_coverage(c: Column, terms: Column) -> Column:
    """Context awareness: share of the context terms that the text has, weighted; 0.5 without terms."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: (t != "") & low.contains(F.lower(t))))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, 0.5).otherwise(clamp(hits / F.greatest(F.size(terms), F.lit(1)) * 0.6 + 0.2))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the plain tokens of two texts; 0 if neither has any."""
    x, y = F.array_distinct(plain_tokens(F.coalesce(a, F.lit("")))), F.array_distinct(plain_tokens(F.coalesce(b, F.lit(""))))
    return safe_div(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))


def repeated_grams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams that occur more than once, per n-gram; grams are counted by a sort, not by comparing all with all."""
    def bound(value: Column, body) -> Column:  # what a lambda reads must be computed before it, once
        return F.transform(F.array(value), body)[0]

    def grams(words: Column) -> Column:
        total = F.size(words) - (n - 1)
        made = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(total > 0, F.array_sort(made)).otherwise(F.array().cast("array<string>"))

    def ratio(ordered: Column) -> Column:
        first = F.filter(ordered, lambda g, i: (F.coalesce(F.get(ordered, i + 1), F.lit("")) == g) & ((i == 0) | (F.coalesce(F.get(ordered, i - 1), F.lit("")) != g)))
        return safe_div(F.size(first).cast("double"), F.size(ordered))

    return bound(bound(plain_tokens(F.coalesce(c, F.lit(""))), grams), ratio)


def top_keywords(df, keys: Sequence[str], column: str, k: int = 20, least: int = 5):
    """(keys, rank, keyword, n): each row's commonest plain tokens of at least ``least`` characters but stop words, ties by token."""
    from pyspark.sql.window import Window

    words = df.select(*keys, F.explode(plain_tokens(F.col(column))).alias("keyword")).where((F.length("keyword") >= least) & ~F.col("keyword").isin(list(STOPWORDS)))
    counts = words.groupBy(*keys, "keyword").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "keyword")).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select(*keys, "rank", "keyword", "n")
