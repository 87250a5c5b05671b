"""The full set of deterministic text metrics, with Python's Unicode-aware patterns, as one Arrow UDF."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOPWORDS

#: Phrases that metrics count (per 100 words, or as numbers), and other marks.
PHRASES = {
    "hedge_rate_per_100w": ("maybe", "might", "could", "probably", "i think", "it depends"),
    "contraction_rate_per_100w": ("i'm", "don't", "can't", "you're", "we'll"),
    "politeness_rate_per_100w": ("please", "thanks", "sorry"),
    "uncertainty_markers_per_100w": ("i'm not sure", "may", "depends", "likely", "approx"),
    "overconfidence_markers_per_100w": ("definitely", "guaranteed", "always", "never"),
    "vagueness_marker_rate_per_100w": ("some", "stuff", "things", "etc"),
    "boilerplate_rate_per_100w": ("production-ready", "structured for clarity", "ready to be integrated", "ci and test suite"),
    "discourse_marker_rate_per_100w": ("so", "now", "ok", "let's", "note that", "by the way"),
    "legalistic_rate_per_100w": ("hereby", "shall", "pursuant"),
    "encouragement_count": ("you can", "don't worry", "nice", "great"),
    "obstruction_phrases_count": ("i can't", "i cannot", "i won't", "unable to", "not possible", "will not"),
    "num_edge_case_mentions": ("edge case", "n <= 0", "empty", "none", "overflow", "o("),
}
IMPERATIVES = ("Do ", "Run ", "Use ", "Set ", "Add ", "Install ")
REFERENCES = ("Step ", "In the code", "Above", "Below", "Next")
CHECKS = ("sanity check", "quick check", "assert", "verify", "print(")
BLOCKING = ("need", "must", "cannot", "can't", "required")
OPTIONS = ("Option", "Alternatively", "Either", "Or:", "You can also")
CONSTRAINTS = ("must", "do not", "don't", "avoid", "required", "format", "constraint")
ALLOWED_QUESTIONS = ("input", "data", "code", "version", "environment", "example")
FALSE_CLAIMS = ("done", "i created", "as you can see", "implemented")
LEXICONS = {
    "novice": ("step-by-step", "example", "explain", "remember", "pitfall"),
    "intermediate": ("pitfall", "common", "debug", "check", "explain"),
    "researcher": ("reproducible", "traceable", "ablation", "seed", "benchmark"),
    "advanced": ("assumption", "edge case", "complexity", "perf", "benchmark"),
}
PERSONAS = {"python_novice": "novice", "intermediate_learner": "intermediate", "ai_researcher": "researcher", "advanced_developer": "advanced"}
DEICTIC = ("today", "tomorrow", "yesterday", "above", "below", "next week")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December")
#: Tokens on either side within which a date or an earlier message resolves a deictic word.
NEARBY = 10
_STOP = frozenset(STOPWORDS)
_DATE = re.compile(rf"\b(?:{'|'.join(MONTHS)})\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b", re.IGNORECASE)
_FENCE = re.compile(r"```[\s\S]*?```")
_BLOCK = re.compile(r"```[^\n`]*\n([\s\S]*?)```")


def plain(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", _folded(text))


def _folded(text: str) -> str:
    return text.lower().translate({0x2018: "'", 0x2019: "'"})


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"[.?!]", text) if s.strip()]


def phrase_count(text: str, phrases: Iterable[str]) -> int:
    """A phrase with a space counts as a substring, a word within word boundaries."""
    return sum(text.count(p) if " " in p else len(re.findall(rf"\b{re.escape(p)}\b", text)) for p in phrases)


def questions(text: str) -> list[str]:
    return [s for s in re.findall(r"[^.?!]*\?", text) if any(x.isalpha() for x in s)]


def _ratio(a: float, b: float) -> float:
    return a / max(1, b)


def _paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n\s*\n", text) if p.strip()]


def response_metrics(text: str) -> dict[str, float]:
    """Metrics of a response alone; a null one counts as empty."""
    low, words, tokens, said = _folded(text), text.split(), plain(text), sentences(text)
    rows, code = text.splitlines(), _BLOCK.findall(text)
    per_100 = 100 / max(1, len(words))
    filled = [sum(bool(x.strip()) for x in block.splitlines()) for block in code]
    asked, paragraphs = questions(text), _paragraphs(_FENCE.sub("", text))
    outside, inside = [], False
    for row in rows:
        if "```" in row:
            inside = not inside
        elif not inside and row.strip():
            outside.append(len(row.split()))
    steps, bullets = len(re.findall(r"(?m)^\s*\d+\.", text)), len(re.findall(r"(?m)^\s*(?:-|\*|•)\s", text))
    headers = [re.sub(r"^#{1,6}\s*", "", x.strip()).strip().lower() for x in rows if re.match(r"#{1,6}\s", x)]
    grams = Counter(zip(tokens, tokens[1:], tokens[2:], tokens[3:], strict=False))
    out = {
        "num_headers": len(re.findall(r"(?m)^#{1,6}\s", text)), "num_numbered_steps": steps, "bullet_lines_ratio": _ratio(bullets, len(rows)),
        "avg_tokens_per_sentence": _ratio(sum(len(s.split()) for s in said), len(said)), "num_explicit_refs": sum(map(text.count, REFERENCES)),
        "num_code_fences": text.count("```") // 2, "has_single_primary_solution_block": float(len(filled) == 1 and filled[0] >= 8),
        "word_count": len(words), "compression_ratio": _ratio(len(set(tokens)), len(tokens)), "imperative_rate": _ratio(sum(s.startswith(IMPERATIVES) for s in said), len(said)),
        "num_runnable_commands": sum(bool(re.match(r"\s*(?:pip|conda|python|pytest|git|srun|sbatch)\b", x)) for x in rows), "num_copy_paste_code_blocks": sum(n >= 5 for n in filled),
        "num_quick_checks": sum(text.lower().count(x) for x in CHECKS), "num_questions_to_user": len(asked), "blocking_questions": sum(any(b in _folded(q) for b in BLOCKING) for q in asked),
        "num_prereq_steps": int(bool(re.match(r"(?i)\s*(?:Prereq|Prerequisite|Requirements|Install|Setup)\b", text))),
        "avg_content_tokens_per_line": _ratio(sum(outside), len(outside)), "paragraph_mean_length": _ratio(sum(len(p.split()) for p in paragraphs), len(paragraphs)),
        "num_options_markers": sum(map(text.count, OPTIONS)), "max_options_in_section": max([0, *(len(re.findall(r"(?i)\b(?:Option|Alternatively)\b", p)) for p in paragraphs)]),
        "num_glossary_defs": len(re.findall(r"\b\w+\s+is\b", text)) + sum(len(re.findall(rf"(?i)\b{x}\b", text)) for x in ("means", r"i\.e\.", "aka")),
        "approx_new_technical_terms": len({t for t in plain(_FENCE.sub("", text)) if len(t) >= 6 and t not in _STOP and not t.isdigit()}),
        "avg_stepsize": _ratio(len(_FENCE.sub("", text).split()), steps + bullets),
        "false_completion_claims_count": 0 if "```" in text else phrase_count(low, FALSE_CLAIMS), "multi_question_clusters": sum(p.count("?") >= 2 for p in _paragraphs(text)),
        "num_asserts": len(re.findall(r"\bassert\b", text)), "unresolved_refs_count": 0 if headers or "```" in text else phrase_count(low, ("above", "below")),
        "numeric_specificity_rate_per_100w": len(re.findall(r"\b\d+(?:\.\d+)?\b", text)) * per_100,
        "ngram_repetition_4gram_ratio": _ratio(sum(n > 1 for n in grams.values()), grams.total()), "sectional_symmetry_score": _ratio(len(headers) - len(set(headers)), len(headers)),
    }
    for name, phrases in PHRASES.items():
        out[name] = phrase_count(low, phrases) * (per_100 if name.endswith("_100w") else 1)
    unsure, sure = (phrase_count(low, PHRASES[f"{x}_markers_per_100w"]) for x in ("uncertainty", "overconfidence"))
    return {k: float(v) for k, v in (out | {"calibration_balance": unsure / (sure + 1)}).items()}


def keywords(prompt: str, k: int = 20) -> list[str]:
    counts = Counter(t for t in plain(prompt) if len(t) >= 5 and t not in _STOP)
    return sorted(counts, key=lambda t: (-counts[t], t))[:k]


def prompt_metrics(text: str, prompt: str) -> dict[str, float]:
    """Metrics of a response against its prompt."""
    own, top, said = set(plain(text)), set(keywords(prompt)), sentences(text)
    asked = [row for row in prompt.splitlines() if row.strip() and any(x in _folded(row) for x in CONSTRAINTS)]
    met = sum(len({t for t in plain(row) if len(t) >= 4 and t not in _STOP} & own) >= 2 for row in asked)
    named = [x.strip() for x in re.findall(r"`([^`\n]+)`", prompt)] + re.findall(r"(?i)\b(?:function|class)\s+([A-Za-z_][A-Za-z0-9_]*)", prompt)
    named += [x for block in _BLOCK.findall(prompt) for x in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\b", block)]
    names = set(re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\b", text))
    flat = {re.sub(r"[^a-z0-9]+", "", x.lower()) for x in names}
    reused = changed = 0
    for name in dict.fromkeys(x for x in named if x):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            reused += name.lower() in text.lower()
        elif name in names:
            reused += 1
        else:
            changed += re.sub(r"[^a-z0-9]+", "", name.lower()) in flat
    return {
        "constraint_mention_rate": _ratio(met, len(asked)), "num_reused_entities": float(reused), "num_incorrect_entity_mutations": float(changed),
        "unrequested_clarifications_count": float(sum(not any(x in q.lower() for x in ALLOWED_QUESTIONS) for q in questions(text))),
        "offtask_ratio": _ratio(sum(len(set(plain(s)) & top) < 2 for s in said), len(said)),
    }


def deictic_metrics(text: str) -> dict[str, float]:
    """How many words point to a time or place, and how many of them have a date or "previous message" nearby."""
    raw = text.split()
    words = [re.sub(r"[^\w-]+", "", x).lower() for x in raw]
    pairs = list(zip(words, words[1:], strict=False))
    anchors = {i for i, x in enumerate(raw) if _DATE.search(x)} | {j for i, p in enumerate(pairs) if p == ("previous", "message") for j in (i, i + 1)}
    places = [(i, i) for i, w in enumerate(words) if w in DEICTIC] + [(i, i + 1) for i, p in enumerate(pairs) if p == ("next", "week")]
    near = sum(any(first - NEARBY <= a <= last + NEARBY for a in anchors) for first, last in places)
    return {"deictic_terms_count": float(phrase_count(_folded(text), DEICTIC)), "deictic_resolutions_count": float(near)}


def register_drift(text: str) -> float:
    """How far sections under headers differ: ranges of sentence length, hedges and contractions per 100 words, added up; 0 without headers."""
    rows = text.splitlines()
    starts = [i for i, row in enumerate(rows) if re.match(r"#{1,6}\s", row)]
    measured = []
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=False):
        part = "\n".join(rows[a:b]).strip()
        n, low = len(part.split()), _folded(part)
        rates = [100 * phrase_count(low, PHRASES[f"{x}_rate_per_100w"]) / max(1, n) for x in ("hedge", "contraction")]
        measured.append((_ratio(n, len(sentences(part))), *rates))
    return float(sum(max(x) - min(x) for x in zip(*measured, strict=True)))


def persona_metrics(text: str, user: str) -> dict[str, float]:
    """Rates per 100 words of the persona's words and of the commonest other persona's, and the register's drift; an unknown user fails."""
    target = next((p for prefix, p in PERSONAS.items() if user.startswith(prefix)), None)
    if target is None:
        raise ValueError(f"no persona for user {user!r}")
    low, n = _folded(text), max(1, len(text.split()))
    rates = {p: 100 * phrase_count(low, words) / n for p, words in LEXICONS.items()}
    return {"persona_lexicon_rate_per_100w": rates.pop(target), "cross_persona_contamination_per_100w": max(rates.values()), "register_drift_score": register_drift(text)}


#: Which dimension reports which metrics, by parts of their names.
BUCKETS = {
    "clarity": ("header", "numbered_steps", "bullet", "tokens_per_sentence", "explicit_refs", "code_fences", "primary_solution"), "tone_style_fit": ("imperative", "hedge", "contraction", "politeness", "compression", "word_count"),
    "workflow_fit": ("runnable", "copy_paste", "quick_checks", "questions", "prereq", "blocking"), "cognitive_load": ("tokens_per_line", "paragraph", "options", "glossary", "technical_terms", "stepsize"),
    "context_awareness": ("constraint", "entities", "entity", "deictic"), "persona_consistency": ("persona", "register"), "friction_loss_of_control": ("obstruction", "unrequested", "offtask", "false_completion", "clusters"),
    "reliability_user_trust": ("uncertainty", "overconfidence", "calibration", "asserts", "edge_case", "unresolved", "numeric", "vagueness"), "anthropomorphism": ("boilerplate", "ngram", "discourse", "legalistic", "symmetry", "encouragement"),
}


def by_dimension(metrics: dict[str, float]) -> dict[str, dict[str, float]]:
    """Metrics under the first dimension that a part of their name belongs to."""
    out: dict[str, dict[str, float]] = {d: {} for d in BUCKETS}
    for name, value in metrics.items():
        home = next((d for d, parts in BUCKETS.items() if any(p in name for p in parts)), None)
        if home:
            out[home][name] = value
    return out


def compute(text: str | None, prompt: str | None = None, user: str | None = None) -> dict[str, float]:
    """All metrics by name: those of the response with and without its code, with a prompt those against it, with a user those of the persona."""
    text = text or ""
    out = {f"{k}_{suffix}": v for suffix, part in (("all", text), ("no_code", _FENCE.sub("", text))) for k, v in response_metrics(part).items()}
    return out | (prompt_metrics(text, prompt) | deictic_metrics(text) if prompt is not None else {}) | (persona_metrics(text, user) if user is not None else {})


def with_metrics(df: DataFrame, response: str, prompt: str, names: Sequence[str] | None = None, user: str | None = None) -> DataFrame:
    """``df`` without its texts, plus the map ``metrics``."""
    def run(texts: pa.Array, prompts: pa.Array, *users: pa.Array) -> pa.Array:
        who = users[0].to_pylist() if users else [None] * len(texts)
        rows = [compute(t, p, u) for t, p, u in zip(texts.to_pylist(), prompts.to_pylist(), who, strict=True)]
        kept = [[(k, v) for k, v in row.items() if names is None or k in names] for row in rows]
        return pa.array(kept, pa.map_(pa.string(), pa.float64()))

    return df.withColumn("metrics", F.arrow_udf(run, "map<string,double>")(response, prompt, *([user] if user else []))).drop(response, prompt)
