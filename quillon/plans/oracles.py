"""DuckDB SQL for the registered queries, written against the tables alone."""

from __future__ import annotations

from quillon.functions.normalize import BY_ALIAS
from quillon.functions.text import APOLOGY, DIRECTIVE, FIRST_PERSON, FRIENDLY, HEDGING, OVERCONFIDENT, REFUSAL, STOPWORDS
from quillon.plans.facts import DIMENSION_WEIGHTS, PERSONA_WEIGHTS
from quillon.plans.queries import RAW_NAMES, RAW_USERS
from quillon.schema import DIMENSIONS

ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
ITEM = "user_id, task_id, variant_label"
CONDITION = f"{ITEM}, model_a, model_b"


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)


FACTS = f"""
base AS (SELECT *, CAST(l_partkey AS VARCHAR) AS task_id, 'model_' || (l_suppkey % 4) AS model_name, 'persona_' || (l_partkey % 3) AS user_id,
  CASE l_returnflag WHEN 'A' THEN 'original' WHEN 'N' THEN 'personalized' ELSE 'control' END AS variant_label,
  CASE WHEN l_linenumber = 1 THEN 'human_annotator_1' ELSE 'judge_' || l_linestatus END AS judge_model_name FROM lineitem),
firsts AS (SELECT *, row_number() OVER (PARTITION BY {ITEM}, judge_model_name, model_name ORDER BY {ORDER}) AS rn FROM base),
cells AS (SELECT {ITEM}, judge_model_name, model_name, [(CAST(l_quantity AS BIGINT) * (7 * d + 3) + l_linenumber * d + l_suppkey) % 5 for d in range(0, 9)] AS s FROM firsts WHERE rn = 1),
won AS (SELECT a.user_id, a.task_id, a.variant_label, a.judge_model_name, a.model_name AS model_a, b.model_name AS model_b,
  [CASE WHEN a.s[i] > b.s[i] THEN 'model_a' WHEN a.s[i] < b.s[i] THEN 'model_b' ELSE 'tie' END for i in range(1, 10)] AS w
  FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.task_id = b.task_id AND a.variant_label = b.variant_label AND a.judge_model_name = b.judge_model_name AND a.model_name < b.model_name),
counted AS (SELECT *, len([x for x in w if x = 'model_a']) AS win_a, len([x for x in w if x = 'model_b']) AS win_b, len([x for x in w if x = 'tie']) AS win_tie FROM won),
pairs AS (SELECT *, CASE WHEN win_a > win_b THEN 'model_a' WHEN win_b > win_a THEN 'model_b' ELSE 'tie' END AS overall FROM counted),
dims AS (SELECT {CONDITION}, judge_model_name, unnest([{_list(DIMENSIONS)}]) AS dimension, unnest(w) AS winner_label FROM pairs),
tried AS (SELECT {ITEM}, model_name, list(l_discount < 0.05 ORDER BY {ORDER}) AS f, list(l_discount < 0.03 ORDER BY {ORDER}) AS g FROM base GROUP BY ALL)
"""


def _passed(flags: str) -> str:
    n, c = f"len({flags})", f"len([x for x in {flags} if x])"
    at = lambda k: f"CASE WHEN {c} = 0 THEN 0.0 WHEN {n} < {k} OR {n} - {c} < {k} THEN 1.0 ELSE 1 - list_product([({n} - {c} - i)::DOUBLE / ({n} - i) for i in range(0, {k})]) END"
    within = lambda k: f"CASE WHEN list_contains({flags}[1:{k}], true) THEN 1.0::DOUBLE ELSE 0.0 END"
    return f"{n} AS n_attempts, {c} AS n_passed, {at(1)} AS pass_at_1, {at(5)} AS pass_at_5, {within(1)} AS passed_in_1, {within(5)} AS passed_in_5, {c}::DOUBLE / {n} AS pass_rate"


OBJECTIVE = f"objective AS (SELECT {ITEM}, model_name, {_passed('f')} FROM tried)"
DIRECTED = f"""directed AS (SELECT {ITEM}, judge_model_name, model_a AS row_model, model_b AS col_model, CASE overall WHEN 'model_a' THEN 'row' WHEN 'model_b' THEN 'col' ELSE 'tie' END AS outcome FROM pairs
 UNION ALL SELECT {ITEM}, judge_model_name, model_b, model_a, CASE overall WHEN 'model_b' THEN 'row' WHEN 'model_a' THEN 'col' ELSE 'tie' END FROM pairs)"""
COUNTS = "count(*) AS total, count(*) FILTER ({c} = 'model_a') AS n_model_a, count(*) FILTER ({c} = 'model_b') AS n_model_b, count(*) FILTER ({c} = 'tie') AS n_tie"
RATES = "round(n_model_a / total, 6) AS rate_model_a, round(n_model_b / total, 6) AS rate_model_b, round(n_tie / total, 6) AS rate_tie, round(CASE WHEN n_model_a + n_model_b > 0 THEN n_model_a / (n_model_a + n_model_b) ELSE 0.5 END, 6) AS win_prob"


def _counts(column: str = "overall") -> str:
    return COUNTS.replace("{c}", column)


def _summary(keys: str = "", source: str = "pairs", column: str = "overall") -> str:
    k = f"{keys}, " if keys else ""
    return f"WITH {FACTS}, {OBJECTIVE}, t AS (SELECT {k}model_a, model_b, {_counts(column)} FROM {source} GROUP BY ALL) SELECT *, {RATES} FROM t"


def _binomial(k: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN least(1.0, 2 * list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)) for i in range(0, least({k}, {n} - {k}) + 1)])) END"


def _joint(keys: str) -> str:
    return f"""WITH {FACTS}, {DIRECTED}, t AS (SELECT {keys}, row_model, col_model, count(*) FILTER (outcome = 'row') AS wins, count(*) FILTER (outcome = 'col') AS losses, count(*) FILTER (outcome = 'tie') AS ties, count(*) AS total FROM directed GROUP BY ALL),
    p AS (SELECT *, {_binomial("wins", "total")} AS pv, {_binomial("wins", "(wins + losses)")} AS px FROM t),
    joint AS (SELECT {keys}, row_model, col_model, wins, losses, ties, total, round(wins / total, 6) AS win_rate, round(ties / total, 6) AS tie_rate, round(pv, 6) AS p_value, round(px, 6) AS p_value_excl_ties, pv < 0.05 AND wins <> losses AS significant FROM p)"""


_SAMPLES = f"""WITH {FACTS}, {OBJECTIVE},
subj AS (SELECT {ITEM}, model_name, [avg(s[1] / 4.0), avg(s[2] / 4.0), avg(s[3] / 4.0), avg(s[4] / 4.0), avg(s[5] / 4.0), avg(s[6] / 4.0), avg(s[7] / 4.0), avg(s[8] / 4.0), avg(s[9] / 4.0)] AS d FROM cells WHERE NOT starts_with(judge_model_name, 'human_') GROUP BY ALL),
samples AS (SELECT coalesce(s.user_id, o.user_id) AS user_id, coalesce(s.task_id, o.task_id) AS task_id, coalesce(s.variant_label, o.variant_label) AS variant_label, coalesce(s.model_name, o.model_name) AS model_name,
  list_sum(d) / 9 AS subj_overall, pass_at_1, pass_at_5, 0.5 * list_sum(d) / 9 + 0.5 * pass_at_1 AS combined_score, o.user_id IS NOT NULL AS has_objective, s.user_id IS NOT NULL AS has_subjective, o.user_id IS NOT NULL AND s.user_id IS NOT NULL AS has_both
  FROM subj s FULL JOIN objective o ON s.user_id = o.user_id AND s.task_id = o.task_id AND s.variant_label = o.variant_label AND s.model_name = o.model_name),
summary AS (SELECT user_id, model_name, variant_label, count(*) AS sample_count, count(*) FILTER (has_objective) AS objective_count, count(*) FILTER (has_subjective) AS subjective_count, count(*) FILTER (has_both) AS both_count,
  avg(pass_at_1) AS pass_at_1_mean, avg(pass_at_5) AS pass_at_5_mean, avg(subj_overall) AS subj_overall_mean, avg(combined_score) AS combined_score_mean, stddev_pop(subj_overall) AS subj_overall_std, stddev_pop(combined_score) AS combined_score_std,
  count(*) FILTER (has_both) / count(*) AS coverage_ratio FROM samples GROUP BY ALL)"""
_MEANS = ("pass_at_1_mean", "pass_at_5_mean", "subj_overall_mean", "combined_score_mean")


def _means(keys: str) -> str:
    return f"{_SAMPLES} SELECT {keys}, CAST(sum(sample_count) AS BIGINT) AS sample_count, round(avg(coverage_ratio), 6) AS coverage_ratio, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEANS)} FROM summary GROUP BY ALL"


def _votes(mode: str, weighted: bool = False) -> str:
    """Omits the last dimension; correctness is a vote, a gate or nothing."""
    w = "coalesce(dw.weight, 1.0)" if weighted else "1.0"
    extra = ("5.0" if weighted else "1.0") if mode == "dimension" else "0.0"
    gated = "pa IS NOT NULL AND pb IS NOT NULL AND (pa > 0) <> (pb > 0)" if mode == "gate" else "false"
    join = f"LEFT JOIN (VALUES {_rows(DIMENSION_WEIGHTS)}) dw(user_id, dimension, weight) ON dw.user_id = x.user_id AND dw.dimension = x.dimension" if weighted else ""
    return f"""WITH {FACTS}, {OBJECTIVE},
    v AS (SELECT x.user_id, task_id, variant_label, judge_model_name, model_a, model_b, sum(CASE WHEN winner_label = 'model_a' THEN {w} ELSE 0 END) AS a, sum(CASE WHEN winner_label = 'model_b' THEN {w} ELSE 0 END) AS b
      FROM dims x {join} WHERE x.dimension <> 'anthropomorphism' GROUP BY ALL),
    m AS (SELECT v.*, p.pass_at_1 AS pa, q.pass_at_1 AS pb FROM v
      LEFT JOIN objective p ON p.user_id = v.user_id AND p.task_id = v.task_id AND p.variant_label = v.variant_label AND p.model_name = model_a
      LEFT JOIN objective q ON q.user_id = v.user_id AND q.task_id = v.task_id AND q.variant_label = v.variant_label AND q.model_name = model_b),
    n AS (SELECT model_a, model_b, pa, {gated} AS gated, a + CASE WHEN pa > pb THEN {extra} ELSE 0 END AS a, b + CASE WHEN pb > pa THEN {extra} ELSE 0 END AS b FROM m)
    SELECT model_a, model_b, CASE WHEN gated THEN CASE WHEN pa > 0 THEN 'model_a' ELSE 'model_b' END WHEN a > b THEN 'model_a' WHEN b > a THEN 'model_b' ELSE 'tie' END AS overall,
      count(*) AS n, round(CAST(sum(CASE WHEN gated THEN 0 ELSE a END) AS DOUBLE), 6) AS votes_a, round(CAST(sum(CASE WHEN gated THEN 0 ELSE b END) AS DOUBLE), 6) AS votes_b, count(*) AS n_valid FROM n GROUP BY ALL"""


_SWAPS = """WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
r AS (SELECT ['A', 'B', 'tie'][1 + l_orderkey % 3] AS pos1, ['low', 'medium', 'high'][1 + l_partkey % 3] AS conf1, ['A', 'B', 'tie'][1 + l_suppkey % 3] AS pos2, ['low', 'medium', 'high'][1 + (l_linenumber + l_suppkey) % 3] AS conf2, 1 + l_partkey % 3 AS r1, 1 + (l_linenumber + l_suppkey) % 3 AS r2 FROM b),
t AS (SELECT *, CASE pos1 WHEN 'A' THEN 'model_a' WHEN 'B' THEN 'model_b' ELSE 'tie' END AS w1, CASE pos2 WHEN 'A' THEN 'model_b' WHEN 'B' THEN 'model_a' ELSE 'tie' END AS w2 FROM r)"""


def _kappa(by: str, item: str, source: str, outcome: str) -> str:
    k = f"{by}, " if by else ""
    sel = f"a.{by}, " if by else ""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in item.split(","))
    return f"""WITH {FACTS}, met AS (SELECT {sel}a.judge_model_name AS judge_a, b.judge_model_name AS judge_b, a.{outcome} AS x, b.{outcome} AS y FROM {source} a JOIN {source} b ON {on} AND a.judge_model_name < b.judge_model_name),
    g AS (SELECT {k}judge_a, judge_b, count(*) AS n_items, count(*) FILTER (x = y) / count(*) AS po, {" + ".join(f"(count(*) FILTER (x = '{v}') / count(*)) * (count(*) FILTER (y = '{v}') / count(*))" for v in ("model_a", "model_b", "tie"))} AS pe,
      count(*) FILTER (x <> 'tie' AND y <> 'tie') AS n_firm, count(*) FILTER (x = y AND x <> 'tie') AS same_firm FROM met GROUP BY ALL),
    agreed AS (SELECT {k}judge_a, judge_b, n_items, po AS percent, CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END AS kappa, n_firm, same_firm / nullif(n_firm, 0) AS percent_firm FROM g)"""


_AGREED = "SELECT {k}judge_a, judge_b, n_items, round(percent, 6) AS percent, round(kappa, 6) AS kappa, n_firm, round(percent_firm, 6) AS percent_firm FROM agreed"
_DELTAS = f"""WITH {FACTS}, {DIRECTED}, m AS (SELECT user_id, row_model, col_model, task_id, variant_label, avg(CASE outcome WHEN 'row' THEN 1 ELSE 0 END) AS w, avg(CASE outcome WHEN 'row' THEN 1 WHEN 'col' THEN -1 ELSE 0 END) AS s FROM directed GROUP BY ALL),
d AS (SELECT a.user_id, a.row_model, a.col_model, a.variant_label || '-' || b.variant_label AS contrast, a.w - b.w AS dw, a.s - b.s AS ds FROM m a JOIN m b USING (user_id, row_model, col_model, task_id)
  WHERE (a.variant_label, b.variant_label) IN (('personalized', 'original'), ('control', 'original'), ('personalized', 'control')))"""
_PER_ITEM = f"rated AS (SELECT concat_ws('|', user_id, task_id, variant_label, model_a, model_b) AS item, judge_model_name AS judge, overall AS outcome FROM pairs)"


def _features(c: str) -> dict[str, str]:
    words = f"[x for x in string_split_regex({c}, '\\s+') if x <> '']"
    plain = f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    rows = f"string_split({c}, chr(10))"
    lined = lambda p: f"len([x for x in {rows} if regexp_matches(x, '{p}')])"
    among = lambda terms: f"len([x for x in {words} if lower(x) IN ({_list(terms)})])"
    ends = f"greatest(len(regexp_extract_all({c}, '[.!?]')), 1)"
    return {
        "word_count": f"len({words})", "sentence_count": ends, "avg_sentence_length": f"len({words}) / {ends}",
        "paragraph_count": f"greatest(len([x for x in string_split({c}, chr(10) || chr(10)) if trim(x) <> '']), 1)",
        "bullet_count": lined(r"^\s*[-*•]"), "step_count": lined(r"^\s*[0-9]+[\).\]]"), "heading_count": lined(r"^\s*#"),
        "code_block_count": f"len(regexp_extract_all({c}, '```'))", "url_count": f"len(regexp_extract_all({c}, 'https?://\\S+'))",
        "contraction_count": f"len(regexp_extract_all({c}, '[A-Za-z0-9_]+''[A-Za-z0-9_]+'))", "type_token_ratio": f"coalesce(len(list_distinct({plain})) / nullif(len({plain}), 0), 0.0)",
        "friendly_markers": among(FRIENDLY), "directive_markers": among(DIRECTIVE), "apology_terms": among(APOLOGY), "hedging_terms": among(HEDGING), "overconfidence_terms": among(OVERCONFIDENT),
        "refusal_terms": among(REFUSAL), "disclaimer_terms": f"CASE WHEN contains(lower({c}), 'as an ai language model') THEN 1 ELSE 0 END", "first_person_pronouns": among(FIRST_PERSON),
    }


def _d(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


_F = _features("text")
_CLAMP = lambda x: f"greatest(0.0, least(1.0, {x}))"
_CLARITY = _CLAMP("1 - least(avg_sentence_length / 30, 1.2) + least(bullet_count, 5) * 0.04 + least(paragraph_count, 6) * 0.02")
_TONE = _CLAMP("CASE persona WHEN 'novice' THEN 0.5 + least(step_count, 6) * 0.05 + least(friendly_markers, 4) * 0.04 - least(directive_markers, 3) * 0.05 WHEN 'researcher' THEN 0.5 + (1 - least(word_count / 600, 1.0)) * 0.4 + least(code_block_count, 4) * 0.05 - least(friendly_markers, 3) * 0.03 ELSE 0.5 + least(bullet_count, 5) * 0.03 END")
_RUBRIC = {
    "clarity": _CLARITY, "tone_style_fit": _TONE, "workflow_fit": _CLAMP("1 - least(word_count / 450, 1.2) + least(code_block_count, 4) * 0.05 + least(step_count, 6) * 0.03"),
    "cognitive_load": _CLAMP(f"({_CLARITY} + least(step_count, 6) * 0.05) / 1.1"), "persona_consistency": _CLAMP(f"{_TONE} + CASE persona WHEN 'novice' THEN least(step_count, 5) * 0.03 ELSE least(code_block_count, 4) * 0.04 END"),
    "friction_loss_of_control": _CLAMP("1 - (least(apology_terms, 3) * 0.1 + least(hedging_terms, 5) * 0.05) + least(paragraph_count, 5) * 0.02"),
    "reliability_user_trust": _CLAMP("0.55 + least(code_block_count, 4) * 0.05 + least(step_count, 6) * 0.02 + least(url_count, 3) * 0.03 - least(overconfidence_terms, 4) * 0.06 - CASE WHEN refusal_terms > 0 THEN 0.15 ELSE 0 END - least(disclaimer_terms, 2) * 0.1 - CASE WHEN hedging_terms > 8 THEN 0.05 ELSE 0 END"),
    "anthropomorphism": _CLAMP("0.45 + least(contraction_count, 6) * 0.03 + least(first_person_pronouns, 6) * 0.02 + least(friendly_markers, 4) * 0.05 + least(type_token_ratio, 0.65) / 0.65 * 0.1 - least(disclaimer_terms, 2) * 0.15"),
}
_TALK = "t AS (SELECT DISTINCT * FROM conversations), talk AS (SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS response FROM t a JOIN t u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"
_P, _R = _features("prompt"), _features("response")
_SETS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
_LOW = "lower(regexp_replace(trim(raw_model_name), '^(?i:old_)+', ''))"
_MAP = f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in BY_ALIAS.items())}}}"

ORACLE_SQL = {
    "norm_model_names": f"""WITH r AS (SELECT c_custkey, [{_list(RAW_NAMES)}][1 + c_custkey % {len(RAW_NAMES)}] AS raw_model_name FROM customer)
      SELECT *, coalesce({_MAP}[{_LOW}], CASE WHEN contains({_LOW}, '/') THEN {_MAP}[string_split({_LOW}, '/')[-1]] END, regexp_replace(trim(raw_model_name), '^(?i:old_)+', '')) AS model_name,
      trim(regexp_replace(lower(trim(raw_model_name)), '[^a-z0-9\\-_]+', '-', 'g'), '-') AS token FROM r""",
    "norm_variant_fields": f"""WITH {FACTS}, r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, task_id || CASE variant_label WHEN 'control' THEN '::variation::control_1' WHEN 'personalized' THEN '::variation::' || task_id || '-u-var1' ELSE '' END AS raw_task_id FROM base),
      q AS (SELECT *, regexp_extract(raw_task_id, '^[0-9]+') AS task_id, CASE WHEN contains(raw_task_id, 'control_') THEN 'control' WHEN contains(raw_task_id, '-var') THEN 'personalized' ELSE 'original' END AS variant_label, coalesce(nullif(regexp_extract(raw_task_id, '::variation::(.*)$', 1), ''), raw_task_id) AS variant_id FROM r)
      SELECT *, CASE WHEN variant_id = task_id THEN task_id ELSE task_id || '::' || variant_id END AS sample_key FROM q""",
    "norm_user_ids": f"SELECT c_custkey, [{_list(RAW_USERS)}][1 + c_custkey % {len(RAW_USERS)}] AS raw_user_id, [{', '.join(repr(v) if v else 'NULL' for v in ('3', '7', None, None, None, 'u_1', '1000'))}][1 + c_custkey % {len(RAW_USERS)}] AS user_id FROM customer",
    "synthetic_pairwise": f"WITH {FACTS} SELECT {CONDITION}, judge_model_name, array_to_string(w, ',') AS winners, win_a, win_b, win_tie, overall FROM pairs",
    "pair_summary": _summary(),
    "user_pair_summary": _summary("user_id"),
    "pair_summary_cube": f"WITH {FACTS}, t AS (SELECT model_a, model_b, CASE WHEN grouping(user_id) = 1 THEN 'all' ELSE user_id END AS user_id, CASE WHEN grouping(judge_model_name) = 1 THEN 'all' ELSE judge_model_name END AS judge_model_name, CASE WHEN grouping(variant_label) = 1 THEN 'all' ELSE variant_label END AS variant_label, {_counts()} FROM pairs GROUP BY model_a, model_b, CUBE (user_id, judge_model_name, variant_label)) SELECT *, {RATES} FROM t",
    "pair_summary_weighted": f"WITH {FACTS}, t AS (SELECT user_id, model_a, model_b, {_counts()} FROM pairs GROUP BY ALL) SELECT model_a, model_b, CAST(sum(total) AS BIGINT) AS total, {', '.join(f'round(sum(weight * n_{s} / total) / sum(weight), 6) AS rate_{s}' for s in ('model_a', 'model_b', 'tie'))} FROM t JOIN (VALUES {_rows(PERSONA_WEIGHTS)}) p(user_id, weight) USING (user_id) GROUP BY model_a, model_b",
    "dimension_win_rates": f"WITH {FACTS}, t AS (SELECT model_a, model_b, dimension, {_counts('winner_label')}, CAST(0 AS BIGINT) AS n_errors FROM dims GROUP BY ALL) SELECT *, {RATES} FROM t",
    "model_rankings": f"WITH {FACTS}, t AS (SELECT model_a, model_b, {_counts()} FROM pairs GROUP BY ALL), s AS (SELECT model_a AS model_name, n_model_a / total AS r FROM t UNION ALL SELECT model_b, n_model_b / total FROM t), g AS (SELECT model_name, count(*) AS n_pairs, avg(r) AS m, min(r) AS lo, max(r) AS hi FROM s GROUP BY 1) SELECT model_name, n_pairs, round(m, 6) AS mean_rate, round(lo, 6) AS min_rate, round(hi, 6) AS max_rate, row_number() OVER (ORDER BY m DESC, model_name) AS rank FROM g",
    "preference_matrix_long": f"WITH {FACTS}, t AS (SELECT model_a, model_b, {_counts()} FROM pairs GROUP BY ALL), s AS (SELECT model_a AS x, model_b AS y, n_model_a / total AS r FROM t UNION ALL SELECT model_b, model_a, n_model_b / total FROM t), m AS (SELECT DISTINCT x FROM s) SELECT a.x AS row_model, b.x AS col_model, round(coalesce(r, 0.5), 6) AS win_rate FROM m a CROSS JOIN m b LEFT JOIN s ON s.x = a.x AND s.y = b.x",
    "joint_long": _joint(keys="user_id, variant_label") + " SELECT * FROM joint",
    "joint_long_by_judge": _joint(keys="user_id, variant_label, judge_model_name") + " SELECT * FROM joint",
    "joint_weighted": _joint(keys="user_id, variant_label") + f" SELECT variant_label, row_model, col_model, count(*) AS n_personas, round(sum(weight * wins / total) / sum(weight), 6) AS win_rate FROM joint JOIN (VALUES {_rows(PERSONA_WEIGHTS)}) p(user_id, weight) USING (user_id) GROUP BY ALL",
    "passk_samples": f"WITH {FACTS}, {OBJECTIVE} SELECT {ITEM}, model_name, n_attempts, n_passed, {', '.join(f'round({c}, 6) AS {c}' for c in ('pass_at_1', 'pass_at_5', 'passed_in_1', 'passed_in_5', 'pass_rate'))} FROM objective",
    "passk_summary": f"WITH {FACTS}, o AS (SELECT 'passed' AS suite, model_name, {_passed('f')} FROM tried UNION ALL SELECT 'plus', model_name, {_passed('g')} FROM tried) SELECT suite, model_name, count(*) AS n, CAST(sum(n_attempts - n_passed) AS BIGINT) AS n_failed, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('pass_at_1', 'pass_at_5', 'passed_in_1', 'passed_in_5'))} FROM o GROUP BY ALL",
    "objective_flip_rates": f"WITH {FACTS}, {OBJECTIVE} SELECT v.model_name, v.variant_label, count(*) AS n_items, round(avg(CASE WHEN o.pass_at_1 >= 0.5 AND v.pass_at_1 < 0.5 THEN 1 ELSE 0 END), 6) AS flip_rate, round(avg(CASE WHEN o.pass_at_1 < 0.5 AND v.pass_at_1 >= 0.5 THEN 1 ELSE 0 END), 6) AS reverse_flip_rate, round(avg(CASE WHEN (o.pass_at_1 >= 0.5) <> (v.pass_at_1 >= 0.5) THEN 1 ELSE 0 END), 6) AS change_rate FROM objective v JOIN objective o USING (user_id, task_id, model_name) WHERE o.variant_label = 'original' AND v.variant_label <> 'original' GROUP BY ALL",
    "objective_pair_outcomes": f"WITH {FACTS}, {OBJECTIVE}, x AS (SELECT model_a, model_b, CASE WHEN p.pass_at_1 > q.pass_at_1 THEN 'model_a' WHEN q.pass_at_1 > p.pass_at_1 THEN 'model_b' ELSE 'tie' END AS o FROM pairs v JOIN objective p ON p.user_id = v.user_id AND p.task_id = v.task_id AND p.variant_label = v.variant_label AND p.model_name = model_a JOIN objective q ON q.user_id = v.user_id AND q.task_id = v.task_id AND q.variant_label = v.variant_label AND q.model_name = model_b), t AS (SELECT model_a, model_b, {_counts('o')} FROM x GROUP BY ALL) SELECT *, {RATES} FROM t",
    "sample_level": f"{_SAMPLES} SELECT {ITEM}, model_name, round(subj_overall, 6) AS subj_overall, round(pass_at_1, 6) AS pass_at_1, round(combined_score, 6) AS combined_score, has_objective, has_subjective, has_both FROM samples",
    "variant_summary": f"{_SAMPLES} SELECT user_id, model_name, variant_label, sample_count, objective_count, subjective_count, both_count, {', '.join(f'round({m}, 6) AS {m}' for m in (*_MEANS, 'subj_overall_std', 'combined_score_std', 'coverage_ratio'))} FROM summary",
    "user_model_deltas": f"{_SAMPLES} SELECT user_id, model_name, {', '.join(f'round(p.{m} - o.{m}, 6) AS {m}_delta' for m in ('pass_at_1_mean', 'subj_overall_mean', 'combined_score_mean'))} FROM summary p JOIN summary o USING (user_id, model_name) WHERE p.variant_label = 'personalized' AND o.variant_label = 'original'",
    "persona_summary": _means("user_id, variant_label"),
    "global_summary": _means("model_name, variant_label"),
    "ranking_reversals": f"{_SAMPLES}, r AS (SELECT user_id, variant_label, {', '.join(f'first(model_name ORDER BY round({m}, 6) DESC, model_name) AS best_{n}' for n, m in (('objective', 'pass_at_1_mean'), ('subjective', 'subj_overall_mean'), ('combined', 'combined_score_mean')))} FROM summary GROUP BY ALL) SELECT *, best_objective <> best_subjective AS reversal_subjective, best_objective <> best_combined AS reversal_combined FROM r",
    "recompute_winner_plain": _votes("ignore"),
    "recompute_winner_gate": _votes("gate"),
    "recompute_winner_dimension": _votes("dimension"),
    "recompute_winner_weighted": _votes("dimension", True),
    "tiebreak_strict": f"{_SWAPS} SELECT pos1, pos2, CASE WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner, count(*) AS n, count(*) FILTER (w1 <> w2) AS n_biased FROM t GROUP BY ALL",
    "tiebreak_finegrained": f"{_SWAPS} SELECT pos1, conf1, pos2, conf2, CASE WHEN w1 = w2 THEN w1 WHEN w2 = 'tie' THEN CASE WHEN r1 >= 2 THEN w1 ELSE 'tie' END WHEN w1 = 'tie' THEN CASE WHEN r2 >= 2 THEN w2 ELSE 'tie' END WHEN r1 > r2 THEN w1 WHEN r2 > r1 THEN w2 ELSE 'tie' END AS winner, count(*) AS n, count(*) FILTER (w1 <> w2) AS n_biased FROM t GROUP BY ALL",
    "judge_pair_agreement": f"{_kappa('', CONDITION, 'pairs', 'overall')} {_AGREED.replace('{k}', '')}",
    "judge_pair_agreement_by_dim": f"{_kappa('dimension', CONDITION + ', dimension', 'dims', 'winner_label')} {_AGREED.replace('{k}', 'dimension, ')}",
    "human_vs_llm": f"{_kappa('variant_label', CONDITION, 'pairs', 'overall')} SELECT CASE WHEN starts_with(judge_a, 'human_') OR starts_with(judge_b, 'human_') THEN 'human_llm' ELSE 'llm_llm' END AS pair_type, count(*) AS n_pairs, CAST(sum(n_items) AS BIGINT) AS n_items, round(avg(percent), 6) AS percent_mean, round(stddev_samp(percent), 6) AS percent_std, round(avg(kappa), 6) AS kappa_mean, round(stddev_samp(kappa), 6) AS kappa_std FROM agreed GROUP BY ALL",
    "fleiss_kappa": f"WITH {FACTS}, c AS (SELECT {CONDITION}, count(*) AS m, count(*) FILTER (overall = 'model_a') AS a, count(*) FILTER (overall = 'model_b') AS b, count(*) FILTER (overall = 'tie') AS t FROM pairs GROUP BY ALL), j AS (SELECT variant_label, count(DISTINCT judge_model_name) AS n_judges FROM pairs GROUP BY 1), g AS (SELECT variant_label, n_judges, count(*) AS n_items, avg((a * a + b * b + t * t - m) / (m * (m - 1))) AS po, pow(sum(a) / sum(m), 2) + pow(sum(b) / sum(m), 2) + pow(sum(t) / sum(m), 2) AS pe FROM c JOIN j USING (variant_label) WHERE m = n_judges GROUP BY ALL) SELECT variant_label, n_judges, n_items, round(po, 6) AS observed, round(pe, 6) AS chance, round((po - pe) / (1 - pe), 6) AS fleiss_kappa FROM g",
    "majority_winner": f"WITH {FACTS}, c AS (SELECT {CONDITION}, overall, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY {CONDITION}) AS top FROM c) SELECT {CONDITION}, CAST(sum(n) AS BIGINT) AS n_judges, count(*) - 1 AS n_disagreeing, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(overall) FILTER (n = top) END AS winner FROM m GROUP BY {CONDITION}",
    "ranking_stability": f"WITH {FACTS}, t AS (SELECT judge_model_name AS j, model_a, model_b, {_counts()} FROM pairs GROUP BY ALL), u AS (SELECT *, CASE WHEN n_model_a + n_model_b > 0 THEN n_model_a / (n_model_a + n_model_b) ELSE 0.5 END AS p FROM t), s AS (SELECT j, model_a AS m, p FROM u UNION ALL SELECT j, model_b, 1 - p FROM u), r AS (SELECT j, m, rank() OVER (PARTITION BY j ORDER BY avg(p) DESC) AS k FROM s GROUP BY j, m) SELECT a.j AS judge_a, b.j AS judge_b, count(*) AS n_models, round(corr(a.k, b.k), 6) AS spearman FROM r a JOIN r b ON a.m = b.m AND a.j < b.j GROUP BY ALL",
    "binomial_tests": _joint(keys="user_id") + " SELECT user_id, row_model, col_model, wins, total, p_value, p_value_excl_ties, significant FROM joint",
    "paired_deltas": f"{_DELTAS} SELECT user_id, row_model, col_model, contrast, count(*) AS n_items, round(avg(dw), 6) AS mean_w, round(avg(ds), 6) AS mean_s FROM d GROUP BY ALL",
    "bh_qvalues": _joint(keys="user_id, variant_label") + ", k AS (SELECT user_id, variant_label, row_model, col_model, p_value, row_number() OVER (PARTITION BY user_id ORDER BY p_value) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM joint) SELECT user_id, variant_label, row_model, col_model, p_value, round(least(1.0, min(p_value * m / i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM k",
    "text_basic": f"SELECT doc_id, {', '.join(_d(_F[n], n) for n in ('word_count', 'sentence_count', 'paragraph_count', 'bullet_count', 'step_count', 'heading_count', 'url_count', 'code_block_count', 'contraction_count', 'type_token_ratio'))} FROM documents",
    "rubric_scores": f"WITH f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'novice' WHEN 'fr' THEN 'researcher' ELSE 'other' END AS persona, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _F.items())} FROM documents) SELECT doc_id, {', '.join(_d(e, n) for n, e in _RUBRIC.items())} FROM f",
    "indicators_in": f"WITH {_TALK} SELECT conv_id, turn, length(prompt) AS input_length_chars, {_d(_P['word_count'], 'input_length_tokens')}, length(prompt) > 1000 AS is_long_context, {_d(_P['sentence_count'], 'input_sentence_count')}, {_d(_P['bullet_count'], 'input_bullet_count')}, {_d(_P['type_token_ratio'], 'input_unique_token_ratio')}, {_P['word_count']} > 250 AS is_high_complexity_task FROM talk",
    "indicators_out": f"WITH {_TALK} SELECT conv_id, turn, {_d(_R['word_count'], 'output_length_tokens')}, {_d(_R['avg_sentence_length'], 'avg_sentence_length_output')}, {_d(_R['type_token_ratio'], 'output_unique_token_ratio')}, {_d(f'coalesce(len(list_intersect({_SETS("prompt")}, {_SETS("response")})) / nullif(len(list_distinct(list_concat({_SETS("prompt")}, {_SETS("response")}))), 0), 0)', 'prompt_output_token_overlap_jaccard')} FROM talk",
    "prompt_keywords": f"WITH {_TALK}, w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(prompt), '[a-z0-9]+')) AS keyword FROM talk), c AS (SELECT conv_id, turn, keyword, count(*) AS n FROM w WHERE length(keyword) >= 5 AND keyword NOT IN ({_list(STOPWORDS)}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, keyword) AS rank FROM c) SELECT conv_id, turn, rank, keyword, n FROM r WHERE rank <= 20",
    "repeated_4grams": "WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM d), g AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), c AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL), r AS (SELECT doc_id, count(*) FILTER (n > 1) AS again FROM c GROUP BY 1) SELECT doc_id, round(coalesce(again, 0) / greatest(len(t) - 3, 1), 6) AS repeated_4gram_ratio FROM d LEFT JOIN r USING (doc_id)",
    "consensus_filter": f"WITH {FACTS}, {_PER_ITEM}, b AS (SELECT item, outcome, count(*) AS n, min(judge) AS f FROM rated WHERE outcome <> 'tie' GROUP BY ALL), p AS (SELECT item, sum(n) AS pool, max(n) AS top, first(outcome ORDER BY n DESC, f) AS sig FROM b GROUP BY 1) SELECT item, judge, outcome, CASE WHEN outcome = 'tie' THEN 'tied_overall' WHEN coalesce(pool, 0) < 2 THEN 'small_pool' WHEN top < 2 THEN 'no_consensus' WHEN outcome <> sig THEN 'dissent' END AS rejection FROM rated LEFT JOIN p USING (item)",
    "dedup_keep_last": "WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM r WHERE rn = 1",
    "dedup_stride": "WITH k AS (SELECT DISTINCT l_partkey AS key FROM lineitem), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM k) SELECT key FROM r WHERE i >= 3 AND (i - 3) % 7 = 0",
    "anti_join_prior": "WITH used AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 97 = 0) SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM used)",
    "interleave_sources": "SELECT n_name AS name, CAST(0 AS BIGINT) AS source_index, row_number() OVER (ORDER BY n_name) AS round FROM nation UNION ALL SELECT r_name, 1, row_number() OVER (ORDER BY r_name) FROM region",
    "multiselect_counts": "WITH u AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT event_type AS choice, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 2) SELECT choice, n, (SELECT count(DISTINCT user_id) FROM events) AS respondents FROM r",
    "best_submission": "WITH r AS (SELECT user_id AS annotator_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT annotator_id, event_id, ts, event_type FROM r WHERE i = 1",
    "annotation_stats": f"WITH {FACTS}, {_PER_ITEM}, p AS (SELECT item, count(*) AS n, count(DISTINCT outcome) AS k FROM rated GROUP BY 1) SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_annotations, count(*) FILTER (n > 1) AS n_overlap, count(*) FILTER (n > 1 AND k = 1) AS n_full_agreement, (SELECT count(DISTINCT judge) FROM rated) AS n_annotators FROM p",
}
