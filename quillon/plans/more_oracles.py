"""DuckDB SQL for the queries of ``plans.more``."""

from __future__ import annotations

from quillon.plans.oracles import CONDITION, DIRECTED, FACTS, ITEM, OBJECTIVE, ORACLE_SQL, _counts, _features, _kappa, RATES
from quillon.plans.records import RAW_MODELS
from quillon.schema import DIMENSIONS

#: Canonical names and tokens of the models of the facts, in SQL.
_CANON = {"model_0": "gpt-5.1", "model_1": "gpt-4o", "model_2": "qwen3-8b", "model_3": "own-model"}
_TOKEN = {"model_0": "gpt-5-1", "model_1": "gpt-4o", "model_2": "qwen3-8b", "model_3": "own-model"}


def _map(c: str, names: dict[str, str]) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_RAWTASK = "task_id || CASE variant_label WHEN 'control' THEN '::variation::control_1' WHEN 'personalized' THEN '::variation::' || task_id || '-u-var1' ELSE '' END"
_VARIANT = "CASE variant_label WHEN 'control' THEN 'control_1' WHEN 'personalized' THEN task_id || '-u-var1' ELSE task_id END"
_N = "CAST(task_id AS BIGINT)"
_TURN = "CASE WHEN {x} = 'tie' THEN 'tie' WHEN ({x} = 'model_a') = keep THEN 'model_a' ELSE 'model_b' END"
#: Records in canonical order: keep is whether the facts' order is the canonical one.
RECORDS = f"""ordered AS (SELECT *, {_map("model_a", _TOKEN)} < {_map("model_b", _TOKEN)} AS keep, {_N} % 2 = 1 AS flip FROM pairs),
recs AS (SELECT user_id, task_id, {_RAWTASK} AS raw_task_id, variant_label, {_VARIANT} AS variant_id, judge_model_name,
  CASE WHEN keep THEN {_map("model_a", _CANON)} ELSE {_map("model_b", _CANON)} END AS model_a, CASE WHEN keep THEN {_map("model_b", _CANON)} ELSE {_map("model_a", _CANON)} END AS model_b, keep = flip AS swapped,
  {_TURN.format(x="overall")} AS overall, [{_TURN.format(x="x")} for x in w] AS w, CASE WHEN keep THEN win_a ELSE win_b END AS win_a, CASE WHEN keep THEN win_b ELSE win_a END AS win_b, win_tie,
  len([i for i in range(0, 9) if ({_N} + i) % 5 = 0]) AS n_biased, 9 AS n_dimensions, CASE variant_label WHEN 'original' THEN 'general_user' ELSE 'persona' END AS judgment_type, {_N} AS n FROM ordered),
rdims AS (SELECT *, unnest(range(0, 9)) AS i, unnest(w) AS winner_label FROM recs),
rlong AS (SELECT * EXCLUDE (w), [{", ".join(f"'{d}'" for d in DIMENSIONS)}][i + 1] AS dimension, ['low', 'medium', 'high'][(n + i) % 3 + 1] AS confidence, (n + i) % 5 = 0 AS biased FROM rdims)"""
_R = f"WITH {FACTS}, {RECORDS}"
#: Fine-grained: the first run's position at high confidence, the second's turned or kept, at the level of (n + i) % 3.
_FINE = f"""{_R}, f AS (SELECT *, CASE WHEN winner_label = 'tie' THEN 'tie' WHEN (n + i) % 4 <> 0 THEN winner_label WHEN (n + i) % 3 < 2 THEN winner_label ELSE 'tie' END AS fine, winner_label <> 'tie' AND (n + i) % 4 = 0 AS differ FROM rlong),
g AS (SELECT {ITEM}, judge_model_name, model_a, model_b, string_agg(fine, ',' ORDER BY i) AS winners, count(*) FILTER (fine = 'model_a') AS win_a, count(*) FILTER (fine = 'model_b') AS win_b, count(*) FILTER (fine = 'tie') AS win_tie, count(*) FILTER (differ) AS n_biased FROM f GROUP BY ALL)"""
_ITEMS = "user_id, variant_label, model_a, model_b"
_TABLES = f"""WITH {FACTS}, met AS (SELECT a.user_id, a.variant_label, a.model_a, a.model_b, a.judge_model_name AS ja, b.judge_model_name AS jb, a.overall AS x, b.overall AS y FROM pairs a JOIN pairs b ON {" AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in CONDITION.split(","))} AND a.judge_model_name < b.judge_model_name),
jp AS (SELECT {_ITEMS}, ja, jb, count(*) AS n, count(*) FILTER (x = y) / count(*) AS po, {" + ".join(f"(count(*) FILTER (x = '{v}') / count(*)) * (count(*) FILTER (y = '{v}') / count(*))" for v in ("model_a", "model_b", "tie"))} AS pe FROM met GROUP BY ALL),
pp AS (SELECT {_ITEMS}, count(*) AS n_judge_pairs, avg(n) AS overlap_mean, min(n) AS overlap_min, avg(po) AS percent_mean, stddev_samp(po) AS percent_std, avg(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END) AS kappa_mean FROM jp GROUP BY ALL),
jw AS (SELECT {_ITEMS}, judge_model_name, avg(CASE WHEN overall = 'model_a' THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM pairs GROUP BY ALL),
jj AS (SELECT {_ITEMS}, avg(r) AS judge_win_rate_mean, stddev_samp(r) AS judge_win_rate_std, min(r) AS judge_win_rate_min, max(r) AS judge_win_rate_max, count(*) AS n_judges, avg(n) AS items_per_judge_mean FROM jw GROUP BY ALL),
ic AS (SELECT {CONDITION}, count(*) AS m, count(*) FILTER (overall = 'model_a') AS a, count(*) FILTER (overall = 'model_b') AS b, count(*) FILTER (overall = 'tie') AS t FROM pairs GROUP BY ALL),
fk AS (SELECT {_ITEMS}, count(*) AS fleiss_items, avg((a * a + b * b + t * t - m) / (m * (m - 1))) AS po, pow(sum(a) / sum(m), 2) + pow(sum(b) / sum(m), 2) + pow(sum(t) / sum(m), 2) AS pe FROM ic JOIN jj USING ({_ITEMS}) WHERE m = n_judges AND m > 1 GROUP BY ALL),
ni AS (SELECT {_ITEMS}, count(*) AS n_items FROM ic GROUP BY ALL),
tabs AS (SELECT ni.*, judge_win_rate_mean, judge_win_rate_std, judge_win_rate_min, judge_win_rate_max, n_judges, items_per_judge_mean, coalesce(n_judge_pairs, 0) AS n_judge_pairs, overlap_mean, overlap_min, percent_mean, percent_std, kappa_mean,
  CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END AS fleiss_kappa, coalesce(fleiss_items, 0) AS fleiss_items FROM ni LEFT JOIN jj USING ({_ITEMS}) LEFT JOIN pp USING ({_ITEMS}) LEFT JOIN fk USING ({_ITEMS}))"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _weighted(c: str, name: str) -> str:
    w = f"CASE WHEN {c} IS NOT NULL THEN n_items END"
    mean = f"sum({w} * {c}) / sum({w})"
    return f"round({mean}, 6) AS {name}_mean, round(sqrt(greatest(sum({w} * {c} * {c}) / sum({w}) - pow({mean}, 2), 0)), 6) AS {name}_std"


_PASS = """JOIN objective p ON p.user_id = v.user_id AND p.task_id = v.task_id AND p.variant_label = v.variant_label AND p.model_name = model_a JOIN objective q ON q.user_id = v.user_id AND q.task_id = v.task_id AND q.variant_label = v.variant_label AND q.model_name = model_b"""


def _passing(k: int) -> str:
    a, b = f"pa{k}", f"pb{k}"
    return f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS at_{k}_total, " + ", ".join(f"round(count(*) FILTER ({c}) / count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), 6) AS at_{k}_rate_{n}" for n, c in (("a", f"{a} > {b}"), ("b", f"{b} > {a}"), ("tie", f"{a} = {b}")))


_TALK = "t AS (SELECT DISTINCT * FROM conversations), talk AS (SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS response FROM t a JOIN t u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"
_UNITS = """o AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s FROM orders),
u AS (SELECT k, s, CAST(k AS VARCHAR) AS unit_id, 'original' AS variant_label, 'original' AS unit_prompt, false AS bad FROM o
  UNION ALL SELECT k, s, k || '::variation::u-var' || i, 'personalized', 'p' || i, (k + i) % 5 <> 0 AND (k + i) % 3 = 0 FROM (SELECT k, s, unnest(range(1, k % 4 + 1)) AS i FROM o)
  UNION ALL SELECT k, s, k || '::variation::control_' || i, 'control', 'control ' || i, false FROM (SELECT k, s, unnest(range(1, least(k % 4, 2) + 1)) AS i FROM o WHERE k % 2 = 1))"""
_PATHS = """p AS (SELECT *, ['novice', 'expert'][p_partkey % 2 + 1] AS persona, p_partkey % 3 AS m, 'j' || (p_partkey % 2) AS judge, CASE WHEN p_partkey % 5 < 2 THEN 'general_user' ELSE 'persona' END AS judgment_type,
  CASE WHEN p_partkey % 4 <> 3 THEN ['original', 'personalized', 'control'][p_partkey % 3 + 1] END AS prompt_type, 'v0' || (p_partkey % 9 + 1) AS version FROM part),
f AS (SELECT 'file:///data/root/' || persona || '/pairwise/models_' || ['gpt-4o_vs_qwen3-8b', 'qwen3-8b_vs_gpt-4o', 'a_vs_b'][m + 1] || '/judge_model_' || judge || '/gen_model_g/filter_model_f/' || CASE WHEN judgment_type = 'general_user' THEN 'judgment_type_general_user/' ELSE '' END
  || coalesce('prompt_type_' || prompt_type || '/', '') || 'pairwise-comparison_run_x_' || version || '.json' AS file_path, persona, CASE WHEN m = 2 THEN 'a' ELSE 'gpt-4o' END AS model_a, CASE WHEN m = 2 THEN 'b' ELSE 'qwen3-8b' END AS model_b, judge, judgment_type, prompt_type, version, p_partkey FROM p)"""
_OUT = f"WITH {FACTS}, {OBJECTIVE}, o AS (SELECT concat_ws('|', user_id, task_id, variant_label) AS sample_id, user_id, variant_label, model_name, CAST(n_passed AS VARCHAR) AS output FROM objective)"


def _shape(c: str, prefix: str) -> dict[str, str]:
    f = _features(c)
    lined = lambda p: f"len([x for x in string_split({c}, chr(10)) if regexp_matches(x, '{p}')])"
    return {
        f"{prefix}_length_chars": f"length({c})", f"{prefix}_length_tokens": f["word_count"], f"{prefix}_sentence_count": f"CASE WHEN {c} = '' THEN 0 ELSE greatest(len(regexp_extract_all({c}, '[.!?]')), 1) END",
        f"{prefix}_paragraph_count": f"len([x for x in string_split({c}, chr(10) || chr(10)) if trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''])", f"{prefix}_bullet_count": lined(r"^\s*[-*•]"), f"{prefix}_heading_count": lined(r"^\s*#"),
        f"{prefix}_url_count": f"len(regexp_extract_all({c}, 'https?://\\S+'))", f"{prefix}_inline_code_span_count": f"len(regexp_extract_all({c}, '`[^`\\n]+`'))", f"{prefix}_unique_token_ratio": f["type_token_ratio"],
    }


def _terms(terms) -> str:
    return "len([x for x in regexp_extract_all(lower(response), '[a-z'']+') if x IN (" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + ")])"


def _indicators() -> tuple[str, str]:
    from quillon.functions.indicators import DISCLAIMERS, FIRST_PERSON, HEDGING, OVERCONFIDENT, REFUSAL, SECOND_PERSON

    ins = _shape("prompt", "input") | {
        "is_long_context": "CASE WHEN length(prompt) > 1000 THEN 1 ELSE 0 END", "input_code_fence_count": "len(regexp_extract_all(prompt, '```'))", "task_count": "2", "avg_task_complexity_proxy": "greatest(0.0, least(1.0, (length(prompt) + 4) / 2 / 800))",
        "preferred_dimension_coverage": "2 / 9", "context_constraints_count": "1", "is_high_complexity_task": f"CASE WHEN {_features('prompt')['word_count']} > 250 THEN 1 ELSE 0 END",
    }
    f = _features("response")
    sets = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
    hits = "(CASE WHEN contains(lower(response), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(response), 'qqq') THEN 1 ELSE 0 END)"
    outs = _shape("response", "output") | {
        "code_block_count": f["code_block_count"], "code_block_pair_count": f"({f['code_block_count']}) // 2", "has_code_block": f"CASE WHEN {f['code_block_count']} > 0 THEN 1 ELSE 0 END", "num_steps_in_explanation": f["step_count"],
        "output_markdown_link_count": "len(regexp_extract_all(response, '\\[[^\\]]+\\]\\([^)]+\\)'))", "output_hedging_term_count": _terms(HEDGING), "output_overconfidence_term_count": _terms(OVERCONFIDENT), "output_refusal_term_count": _terms(REFUSAL),
        "output_disclaimer_term_count": " + ".join("CASE WHEN contains(lower(response), '" + p.replace("'", "''") + "') THEN 1 ELSE 0 END" for p in DISCLAIMERS), "output_first_person_pronoun_count": _terms(FIRST_PERSON), "output_second_person_pronoun_count": _terms(SECOND_PERSON),
        "prompt_output_token_overlap_jaccard": f"coalesce(len(list_intersect({sets('prompt')}, {sets('response')})) / nullif(len(list_distinct(list_concat({sets('prompt')}, {sets('response')}))), 0), 0)",
        "context_term_hit_count": hits, "context_term_coverage": f"{hits} / 2", "static_correctness": "0.6", "static_correctness_bucket": "0.5", "avg_sentence_length_output": f["avg_sentence_length"],
    }
    made = lambda cols: ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in cols.items())
    return made(ins), made(outs)


_IN, _OUTS = _indicators()
MORE_SQL = {
    "pairwise_records": f"{_R} SELECT * EXCLUDE (w, n), array_to_string(w, ',') AS winners, round(n_biased / 9, 6) AS bias_rate FROM recs",
    "pairwise_records_finegrained": f"{_FINE} SELECT *, CASE WHEN win_a > win_b THEN 'model_a' WHEN win_b > win_a THEN 'model_b' ELSE 'tie' END AS overall, round(n_biased / 9, 6) AS bias_rate FROM g",
    "pairwise_dimension_rows": f"{_R} SELECT model_a, model_b, dimension, winner_label, confidence, count(*) AS n, count(*) FILTER (biased) AS n_biased FROM rlong GROUP BY ALL",
    "dimension_win_rates_full": f"{_R}, t AS (SELECT model_a, model_b, dimension, count(*) FILTER (n % 10 <> 0) AS total, {', '.join(f'''count(*) FILTER (n % 10 <> 0 AND winner_label = '{s}') AS n_{s}''' for s in ('model_a', 'model_b', 'tie'))}, count(*) FILTER (n % 10 = 0) AS n_errors, {', '.join(f'''count(*) FILTER (n % 10 <> 0 AND confidence = '{c}') AS confidence_{c}''' for c in ('low', 'medium', 'high'))}, count(*) FILTER (n % 10 <> 0 AND biased) AS n_biased FROM rlong GROUP BY ALL) SELECT *, {RATES} FROM t",
    "judgment_types_aligned": f"{_R}, j AS (SELECT * REPLACE (CASE WHEN judge_model_name = 'judge_O' THEN 'persona' ELSE judgment_type END AS judgment_type) FROM recs), h AS (SELECT DISTINCT {CONDITION}, judgment_type AS own FROM j WHERE judge_model_name LIKE 'human_%') SELECT judge_model_name, variant_label, coalesce(own, judgment_type) AS judgment_type, count(*) AS n FROM j LEFT JOIN h USING ({CONDITION}) GROUP BY ALL",
    "objective_records": f"WITH {FACTS}, {OBJECTIVE} SELECT task_id, variant_label, CASE variant_label WHEN 'original' THEN task_id ELSE variant_label END AS variant_id, {_map('model_name', RAW_MODELS)} AS raw_model_name, {_map('model_name', _CANON)} AS model_name, 'function_eval' AS objective_source, round(pass_at_1, 6) AS obj_base_pass_at_1, n_attempts AS obj_base_attempt_count, n_passed AS obj_base_pass_count, round(pass_rate, 6) AS obj_base_pass_rate, CASE WHEN {_N} % 3 <> 0 THEN round(pass_at_5, 6) END AS obj_plus_pass_at_5, round(pass_at_1, 6) AS obj_overall_pass_at_1 FROM objective",
    "objective_lookup": f"WITH {FACTS}, {OBJECTIVE} SELECT CASE variant_label WHEN 'original' THEN task_id ELSE task_id || '::' || variant_label END AS sample_key, variant_label, {_map('model_name', _CANON)} AS model_name, round(pass_at_1, 6) AS pass_at_1, round(pass_at_5, 6) AS pass_at_5, CASE WHEN {_N} % 3 <> 0 THEN round(pass_at_1, 6) END AS plus_pass_at_1 FROM objective",
    "pair_summary_objective": f"WITH {FACTS}, {OBJECTIVE}, v AS (SELECT v.*, p.pass_at_1 AS pa1, q.pass_at_1 AS pb1, p.pass_at_5 AS pa5, q.pass_at_5 AS pb5 FROM pairs v {_PASS.replace('JOIN objective', 'LEFT JOIN objective')}), t AS (SELECT model_a, model_b, {_counts()}, round(avg(win_tie / 9.0), 6) AS avg_bias_rate, {_passing(1)}, {_passing(5)} FROM v GROUP BY ALL) SELECT *, {RATES} FROM t",
    "agreement_tables": f"{_TABLES} SELECT {_ITEMS}, n_items, n_judges, n_judge_pairs, overlap_min, fleiss_items, {_r('judge_win_rate_mean', 'judge_win_rate_std', 'judge_win_rate_min', 'judge_win_rate_max', 'items_per_judge_mean', 'overlap_mean', 'percent_mean', 'percent_std', 'kappa_mean', 'fleiss_kappa')} FROM tabs",
    "agreement_pooled": f"{_TABLES} SELECT variant_label, count(*) AS n_conditions, CAST(sum(n_items) AS BIGINT) AS n_items, max(n_judge_pairs) AS n_judge_pairs, min(overlap_min) AS overlap_min, {_weighted('percent_mean', 'percent')}, {_weighted('kappa_mean', 'kappa')}, {_weighted('fleiss_kappa', 'fleiss')} FROM tabs GROUP BY ALL",
    "agreement_across_conditions": f"{_TABLES} SELECT variant_label, count(*) AS n_conditions, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0 END, 6) AS {c}_std' for c in ('percent_mean', 'kappa_mean', 'fleiss_kappa'))} FROM tabs GROUP BY ALL",
    "agreement_human_items": _kappa("", CONDITION, "hp", "overall").replace(", met AS", f", hi AS (SELECT DISTINCT {CONDITION} FROM pairs WHERE judge_model_name LIKE 'human_%'), hp AS (SELECT * FROM pairs SEMI JOIN hi USING ({CONDITION})), met AS", 1) + " SELECT judge_a, judge_b, n_items, round(percent, 6) AS percent, round(kappa, 6) AS kappa FROM agreed",
    "winners_long": f"WITH {FACTS}, i AS (SELECT DISTINCT {CONDITION} FROM pairs), j AS (SELECT DISTINCT judge_model_name FROM pairs) SELECT j.judge_model_name AS judge, coalesce(overall, 'none') AS outcome, count(*) AS n FROM i CROSS JOIN j LEFT JOIN pairs p USING ({CONDITION}, judge_model_name) GROUP BY ALL",
    "winners_wide": f"WITH {FACTS}, c AS (SELECT {CONDITION}, overall, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY {CONDITION}) AS top FROM c), g AS (SELECT {CONDITION}, CAST(sum(n) AS BIGINT) AS n_judges, count(*) - 1 AS n_disagreeing, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(overall) FILTER (n = top) END AS winner FROM m GROUP BY {CONDITION}), w AS (SELECT {CONDITION}, {', '.join(f'''max(overall) FILTER (judge_model_name = '{j}') AS {j}''' for j in ('human_annotator_1', 'judge_F', 'judge_O'))} FROM pairs GROUP BY ALL) SELECT * FROM g JOIN w USING ({CONDITION})",
    "human_records": f"{_R}, h AS (SELECT r.*, w[1] AS c, w[3] AS f FROM recs r WHERE judge_model_name LIKE 'human_%'), k AS (SELECT *, CAST(c = 'model_a' AS INT) + CAST(f = 'model_a' AS INT) AS a, CAST(c = 'model_b' AS INT) + CAST(f = 'model_b' AS INT) AS b FROM h) SELECT {ITEM}, 'human_annotator_1' AS judge_model_name, model_a, model_b, CASE WHEN a > b THEN 'model_a' WHEN b > a THEN 'model_b' ELSE 'tie' END AS overall, c || ',-,' || f || ',-,-,-,-,-,-' AS winners, CAST(a AS BIGINT) AS win_a, CAST(b AS BIGINT) AS win_b, CAST(2 - a - b AS BIGINT) AS win_tie, CAST(2 AS BIGINT) AS n_dimensions, false AS bias_measured, 'high' AS human_overall_confidence FROM k",
    "candidate_rejections": f"WITH {FACTS}, l AS (SELECT *, CASE WHEN user_id = 'persona_1' THEN NULL WHEN variant_label = 'control' THEN 4 ELSE 6 END AS lim FROM pairs), r AS (SELECT variant_label, user_id, CASE WHEN variant_label = 'personalized' THEN 'allow:variant_label' WHEN judge_model_name = 'judge_F' THEN 'deny:judge_model_name' WHEN greatest(win_a, win_b) > lim THEN 'max_output_chars' WHEN overall = 'tie' THEN 'overall_tie' ELSE 'kept' END AS outcome FROM l) SELECT 'all' AS field, 'all' AS value, outcome, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'variant_label', variant_label, outcome, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'user_id', user_id, outcome, count(*) FROM r GROUP BY ALL",
    "exact_sample_types": f"WITH {FACTS}, t AS (SELECT CASE WHEN variant_label = 'original' AND user_id IN ('persona_0', 'persona_1') THEN 'user_id=persona_0,persona_1|variant_label=original' WHEN variant_label = 'control' THEN 'variant_label=control' END AS sample_type FROM pairs) SELECT sample_type, count(*) AS n FROM t WHERE sample_type IS NOT NULL GROUP BY ALL",
    "omitted_dimensions": f"WITH {FACTS} SELECT dimension, winner_label, count(*) AS n FROM dims WHERE dimension NOT IN ('workflow_fit', 'anthropomorphism', 'clarity') GROUP BY ALL",
    "sample_units": f"WITH {_UNITS} SELECT CAST(k AS VARCHAR) AS sample_id, unit_id, variant_label, unit_prompt FROM u",
    "skipped_units": f"WITH {_UNITS} SELECT s AS source_benchmark, variant_label, count(*) AS n, count(*) FILTER (bad) AS n_skipped FROM u GROUP BY ALL",
    "verification_failures": f"WITH {_UNITS} SELECT count(*) AS n_units, count(*) FILTER (bad) AS n_failed FROM u WHERE variant_label = 'personalized'",
    "comparison_inputs": f"{_OUT} SELECT a.sample_id, a.output AS model_a_output, b.output AS model_b_output, CASE WHEN a.user_id <> 'persona_2' THEN 'prompt of ' || a.sample_id ELSE 'Sample ' || a.sample_id || ' (unknown). Implement entry point `f`. Key tests: a; b; c' END AS input_text FROM o a JOIN o b ON a.sample_id = b.sample_id WHERE a.model_name = 'model_0' AND b.model_name = 'model_1'",
    "outputs_backfilled": f"{_OUT} SELECT user_id, variant_label, count(*) AS n FROM o WHERE model_name = 'model_0' AND (user_id <> 'persona_1' OR variant_label IN ('original', 'control')) GROUP BY ALL",
    "sample_overlap": f"{_OUT}, x AS (SELECT sample_id, variant_label AS prompt_type FROM o WHERE model_name = 'model_0'), y AS (SELECT sample_id, variant_label AS prompt_type FROM o WHERE model_name = 'model_3') SELECT coalesce(x.prompt_type, y.prompt_type) AS prompt_type, count(*) FILTER (x.sample_id IS NOT NULL AND y.sample_id IS NOT NULL) AS n_both, count(*) FILTER (y.sample_id IS NULL) AS n_only_a, count(*) FILTER (x.sample_id IS NULL) AS n_only_b FROM x FULL JOIN y ON x.sample_id = y.sample_id GROUP BY ALL",
    "benchmark_rows": "SELECT 'codexglue_text_to_code' AS benchmark, CAST(item_id AS VARCHAR) AS task_id, text AS prompt, 'c' AS ground_truth, CASE WHEN item_id % 2 = 0 THEN 'java' ELSE 'python' END AS language FROM benchmark UNION ALL SELECT 'ds1000', CAST(item_id - 1 AS VARCHAR), text, NULL, 'python' FROM benchmark UNION ALL SELECT 'mbpp', CAST(item_id AS VARCHAR), text, 'x', 'python' FROM benchmark",
    "artifact_places": f"WITH {_PATHS} SELECT file_path, persona, model_a, model_b, judge, 'g' AS generator, 'f' AS filter, prompt_type, judgment_type, version FROM f",
    "artifacts_newest": f"WITH {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY persona, model_a, model_b, judge, judgment_type ORDER BY prompt_type IS NOT NULL DESC, version DESC, p_partkey DESC, file_path DESC) AS i FROM f) SELECT persona, model_a, model_b, judge, judgment_type, file_path FROM r WHERE i = 1",
    "artifacts_shared": f"WITH {_PATHS}, s AS (SELECT persona, prompt_type, false AS shared FROM f UNION ALL SELECT 'expert', prompt_type, true FROM f WHERE persona = 'novice' AND judgment_type = 'general_user' AND prompt_type IN ('original', 'control')) SELECT persona, shared, coalesce(prompt_type, 'none') AS prompt_type, count(*) AS n FROM s GROUP BY ALL",
    "artifact_model_pairs": f"WITH {_PATHS} SELECT DISTINCT model_a, model_b FROM f",
    "assignment_counts": "WITH i AS (SELECT DISTINCT s_suppkey AS item_id, s_suppkey % 3 AS kind FROM supplier), p AS (SELECT kind, (row_number() OVER (ORDER BY kind) - 1) * 2 AS pos FROM i), e AS (SELECT kind, pos + unnest([0, 1]) + 2 AS pos FROM p) SELECT ['ann', 'bob', 'cy'][CAST(pos % 3 AS INT) + 1] AS annotator, kind, count(*) AS n FROM e GROUP BY ALL",
    "equal_allocation_counts": "WITH o AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) SELECT a.o_orderstatus, b.o_orderpriority, CAST(45 // count(*) OVER () AS BIGINT) AS n FROM (SELECT DISTINCT o_orderstatus FROM o) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM o) b",
    "benchmark_draw": "SELECT DISTINCT o_orderstatus, CAST(60 // (SELECT count(DISTINCT o_orderstatus) FROM orders) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_excluded FROM orders",
    "judge_answers": """WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS k FROM lineitem) SELECT l_orderkey, l_linenumber, k AS l_partkey, CASE k % 5 WHEN 1 THEN 'B' ELSE 'tie' END AS winner, CASE k % 3 WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN k % 2 = 0 THEN 'short' ELSE 'some words and more' END AS rationale FROM b""",
    "survey_answers": "WITH u AS (SELECT CAST(user_id AS VARCHAR) AS annotator_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, ['A', 'B', 'tie'][n % 3 + 1] AS q1, CASE WHEN n % 4 <> 0 THEN ['A', 'B', 'tie'][(n + 1) % 3 + 1] END AS q2 FROM u), l AS (SELECT annotator_id, 'item_1' AS item_id, n, q1 AS a FROM w UNION ALL SELECT annotator_id, 'item_2', n, q2 FROM w) SELECT annotator_id, item_id, 'overall' AS field, CASE WHEN n % 2 = 1 THEN CASE a WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE a END ELSE a END AS answer FROM l WHERE a IS NOT NULL",
    "answers_as_json": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"k": ' || p_partkey || '}' WHEN 1 THEN '{"k": ' || p_partkey || '}' WHEN 2 THEN '[{"k": ' || p_partkey || '}]' END AS json FROM part""",
    "survey_times": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '2025-02-03 04:05:00' WHEN 1 THEN '2025-02-03 04:05:06' WHEN 2 THEN '2024-12-13 00:00:00' ELSE '0001-01-01 00:00:00' END AS recorded FROM customer",
    "indicators_in_all": f"WITH {_TALK} SELECT conv_id, turn, {_IN} FROM talk",
    "indicators_out_all": f"WITH {_TALK} SELECT conv_id, turn, {_OUTS} FROM talk",
    "resolution_rates": "SELECT l_suppkey AS run, round(CASE WHEN l_suppkey % 5 = 0 THEN 0.25 ELSE avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) END, 6) AS resolution_rate FROM lineitem GROUP BY l_suppkey",
    "paired_deltas_by_judge": f"WITH {FACTS}, {DIRECTED}, m AS (SELECT user_id, judge_model_name, row_model, col_model, task_id, variant_label, avg(CASE outcome WHEN 'row' THEN 1 ELSE 0 END) AS w, avg(CASE outcome WHEN 'row' THEN 1 WHEN 'col' THEN -1 ELSE 0 END) AS s FROM directed GROUP BY ALL), d AS (SELECT a.user_id, a.judge_model_name, a.row_model, a.col_model, a.variant_label || '-' || b.variant_label AS contrast, a.w - b.w AS dw, a.s - b.s AS ds FROM m a JOIN m b USING (user_id, judge_model_name, row_model, col_model, task_id) WHERE (a.variant_label, b.variant_label) IN (('personalized', 'original'), ('control', 'original'), ('personalized', 'control'))) SELECT user_id, judge_model_name, row_model, col_model, contrast, count(*) AS n_items, round(avg(dw), 6) AS mean_w, round(avg(ds), 6) AS mean_s FROM d GROUP BY ALL",
    "subjective_weighted": f"WITH {FACTS}, s AS (SELECT {ITEM}, model_name, {', '.join(f'avg(s[{i + 1}] / 4.0) AS d{i}' for i in range(9))} FROM cells WHERE NOT starts_with(judge_model_name, 'human_') GROUP BY ALL) SELECT {ITEM}, model_name, round(({' + '.join(f'd{i}' for i in range(9))} + CASE WHEN user_id = 'persona_0' THEN d0 + d2 ELSE 0 END) / CASE WHEN user_id = 'persona_0' THEN 11 ELSE 9 END, 6) AS overall FROM s",
    "profile_records": "SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'novice' ELSE c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END END AS user_profile_type, c_name AS profile_description, CASE WHEN c_custkey % 4 <> 1 THEN 0.1 END AS input_task_complexity_min, CASE WHEN c_custkey % 4 > 1 THEN 0.9 END AS input_task_complexity_max, 'ask' AS input_underspec_handling, CAST(c_custkey % 5 + 1 AS VARCHAR) AS output_clarity_preference, '4' AS output_efficiency_preference, CASE WHEN c_custkey % 2 = 0 THEN 'high' END AS output_reliability_preference FROM customer WHERE c_custkey % 7 <> 0",
    "subjective_records": f"WITH {FACTS}, s AS (SELECT {ITEM}, model_name, {', '.join(f'avg(s[{i + 1}] / 4.0) AS d{i}' for i in range(9))} FROM cells WHERE NOT starts_with(judge_model_name, 'human_') GROUP BY ALL), t AS (SELECT *, ({' + '.join(f'd{i}' for i in range(9))}) / 9 AS o FROM s) SELECT user_id, task_id, variant_label, {_VARIANT} AS variant_id, {_map('model_name', RAW_MODELS)} AS raw_model_name, {_map('model_name', _CANON)} AS model_name, round(o, 6) AS subj_overall, round(o / 2, 6) AS combined_score, {', '.join((f'round(CASE WHEN {_N} % 2 = 1 THEN 1 - d{i} ELSE d{i} END, 6)' if d == 'friction_loss_of_control' else f'round(d{i}, 6)') + f' AS subj_{d}' for i, d in enumerate(DIMENSIONS))} FROM t",
    "indicator_records": f"WITH {FACTS} SELECT {ITEM}, {_map('model_name', _CANON)} AS model_name, task_id || '::attempt::0' AS raw_task_id, CAST(0 AS BIGINT) AS attempt, {_map('model_name', RAW_MODELS)} AS raw_model_name, 'gpt-4o' AS generator_model, {_map('model_name', _CANON)} AS evaluated_model, CAST(s[1] AS DOUBLE) AS clarity FROM cells WHERE judge_model_name = 'judge_O'",
    "rubric_detail_summary": f"{_R}, c AS (SELECT {ITEM}, {_map('model_name', _CANON)} AS model_name, s FROM cells WHERE judge_model_name = 'judge_O'), d AS (SELECT {ITEM}, model_name, 'clarity' AS dimension, 'words' AS detail, s[1] AS x FROM c UNION ALL SELECT {ITEM}, model_name, 'tone_style_fit', 'steps', s[2] FROM c), j AS (SELECT r.user_id, r.variant_label, r.model_a, r.model_b, a.dimension, a.detail, a.x AS x, b.x AS y FROM recs r JOIN d a ON a.user_id = r.user_id AND a.task_id = r.task_id AND a.variant_label = r.variant_label AND a.model_name = r.model_a JOIN d b ON b.user_id = r.user_id AND b.task_id = r.task_id AND b.variant_label = r.variant_label AND b.model_name = r.model_b AND a.detail = b.detail WHERE judge_model_name = 'judge_O') SELECT user_id, variant_label, model_a, model_b, dimension, detail, count(*) AS n, round(avg(x), 6) AS row_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(x) ELSE 0 END, 6) AS row_std, round(avg(y), 6) AS col_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(y) ELSE 0 END, 6) AS col_std FROM j GROUP BY ALL",
}
__all__ = ["MORE_SQL", "ORACLE_SQL"]
