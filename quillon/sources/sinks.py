"""Writers of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ("user_id", "model_name", "model_a", "model_b", "row_model", "col_model", "judge_model_name", "variant_label", "task_id", "variant_id", "dimension")


def column_order(columns: Sequence[str]) -> list[str]:
    """Identity, counts, means, deviations, deltas, then the rest, each by name."""
    kinds = [lambda c: c.endswith("_count") or c.startswith("n_") or c == "total", lambda c: c.endswith("_mean"), lambda c: c.endswith("_std"), lambda c: c.endswith("_delta"), lambda c: True]
    out = [c for c in IDENTITY if c in columns]
    for kind in kinds:
        out += sorted(c for c in columns if c not in out and kind(c))
    return out


def write_csv(df: DataFrame, path: str, sort: Sequence[str] = (), single: bool = True) -> None:
    """CSV with a header and a stable column order; ``single`` is for result tables of few rows."""
    out = df.select(*column_order(df.columns))
    out = out.orderBy(*sort) if sort else out
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def wide_matrix(long: DataFrame, row: str, col: str, value: str, models: Sequence[str]) -> DataFrame:
    """A long matrix as a square one, for the models named."""
    return long.groupBy(row).pivot(col, list(models)).agg(F.first(value)).orderBy(row)


def latex_table(df: DataFrame, columns: Sequence[str], caption: str, most_rows: int = 1000) -> str:
    """A result table as LaTeX; figures have two digits, half to even. More than ``most_rows`` rows are an error."""
    rows = df.select(*columns).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a printed table")
    cell = lambda v: "--" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    head = " & ".join(c.replace("_", r"\_") for c in columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(columns)}}}\n{head} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"


#: Sort orders of the result tables.
ORDERS = {
    "sample_level_flat": ("user_id", "model_name", "variant_label", "task_id", "variant_id"),
    "pairwise_sample_level": ("user_id", "model_a", "model_b", "variant_label", "task_id", "variant_id", "raw_task_id"),
    "pairwise_dimension_summary": ("model_a", "model_b", "dimension"),
    "pairwise_user_summary": ("user_id", "model_a", "model_b"),
}
#: Names that a core set of tables and a pairwise set may hold.
CORE = ("user_model_variant_summary", "user_model_deltas", "global_summary", "sample_level_flat", "ranking_reversals", "persona_summary")
PAIRWISE_SET = ("pairwise_sample_level", "pairwise_pair_summary", "pairwise_dimension_summary", "pairwise_user_summary", "pairwise_preference_matrix", "pairwise_statistical_tests", "pairwise_model_rankings")


def write_tables(tables: Mapping[str, DataFrame], path: str, allowed: Sequence[str], large: Sequence[str] = ("sample_level_flat", "pairwise_sample_level")) -> list[str]:
    """Writes a set of tables as CSV below ``path``, each in its order; tables of rows by sample stay in parts. An unknown name is an error."""
    if unknown := sorted(set(tables) - set(allowed)):
        raise ValueError(f"unknown tables: {unknown}")
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes])
        write_csv(flat, f"{path}/{name}", [c for c in ORDERS.get(name, ()) if c in df.columns], name not in large)
    return [f"{path}/{name}" for name in tables]


def joint_table(long: DataFrame, agreed: DataFrame | None = None, paired: DataFrame | None = None, flips: DataFrame | None = None) -> DataFrame:
    """The long table with what is known of each condition: agreement by its keys, paired tests and flips by theirs; fixed columns first, then agreement, then the rest by name."""
    head = [c for c in ("user_id", "variant_label", "judge_model_name", "row_model", "col_model", "wins", "losses", "ties", "total", "win_rate", "tie_rate", "p_value", "significant") if c in long.columns]
    out, second = long, []
    for part in (agreed, paired, flips):
        if part is not None:
            keys = [c for c in part.columns if c in long.columns and c in IDENTITY]
            part = part.select(*keys, *[c for c in part.columns if c not in long.columns])
            second += part.columns[len(keys) :] if part is agreed or agreed is not None and not second else []
            out = out.join(part, keys, "left")
    return out.select(*head, *second, *sorted(c for c in out.columns if c not in (*head, *second)))


def half_even(value: float | None, digits: int = 2, mark: str = "") -> str:
    """A figure for print, half to even on the exact value; -- where there is none."""
    return "--" if value is None else f"{value:.{digits}f}{mark}"


def _latex(head: Sequence[str], rows: Sequence[Sequence[str]], caption: str, label: str) -> str:
    body = "\n".join(" & ".join(r) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * (len(head) - 1)}}}", r"\toprule", " & ".join(head) + r" \\", r"\midrule", body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def _escaped(text: str) -> str:
    return "".join({"_": r"\_", "&": r"\&", "%": r"\%", "#": r"\#"}.get(c, c) for c in text)


def _few(df: DataFrame, most: int = 5000) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a printed table")
    return rows


def overall_latex(long: DataFrame, caption: str = "Win rates", label: str = "tab:overall", order: Sequence[str] = ("original", "personalized", "control")) -> str:
    """Pairs by prompt type and persona; a pair stands in the direction whose mean win rate is 1/2 or more, a star marks significance."""
    rows = _few(long.select("user_id", "variant_label", "row_model", "col_model", "win_rate", "significant"))
    cells = {(r["row_model"], r["col_model"], r["variant_label"], r["user_id"]): (r["win_rate"], r["significant"]) for r in rows}
    users = sorted({k[3] for k in cells})
    means: dict[tuple[str, str], list[float]] = {}
    for (a, b, _, _), (rate, _) in cells.items():
        if rate is not None:
            means.setdefault((a, b), []).append(rate)
    picked = sorted({(a, b) if sum(v) / len(v) >= 0.5 else (b, a) for (a, b), v in means.items() if (a, b) <= (b, a)} & (set(means) | {(b, a) for a, b in means}))
    out = []
    for a, b in picked:
        for kind in sorted({k[2] for k in cells}, key=lambda x: (order.index(x) if x in order else len(order), x)):
            found = [cells.get((a, b, kind, u), (None, False)) for u in users]
            if any(x[0] is not None for x in found):
                out.append([_escaped(f"{a} vs {b}"), _escaped(kind), *(half_even(x, mark="*" * bool(s)) for x, s in found)])
    return _latex(["Pair", "Prompt", *map(_escaped, users)], out, caption, label)


def agreement_latex(pooled: DataFrame, by: str, caption: str = "Agreement of judges", label: str = "tab:agreement") -> str:
    """Pooled agreement, mean and deviation over conditions by their size, a row for each value of ``by``."""
    rows = sorted(_few(pooled), key=lambda r: str(r[by]))
    cell = lambda r, n: f"{half_even(r[f'{n}_mean'])} $\\pm$ {half_even(r[f'{n}_std'])}"
    return _latex([_escaped(by), "Items", "Percent", "Cohen", "Fleiss"], [[_escaped(str(r[by])), str(r["n_items"]), *(cell(r, n) for n in ("percent", "kappa", "fleiss"))] for r in rows], caption, label)


def human_agreement_latex(kinds: DataFrame, by: Sequence[str] = (), caption: str = "People and models", label: str = "tab:human") -> str:
    """Agreement by kind of judge pair (see ``agreement_kinds``), and by dimension where ``by`` has it."""
    order = ("overall", "human_human", "human_llm", "llm_llm")
    rows = sorted(_few(kinds), key=lambda r: (*[str(r[c]) for c in by], order.index(r["pair_type"]) if r["pair_type"] in order else 9))
    cell = lambda r, n: f"{half_even(r[f'{n}_mean'])} $\\pm$ {half_even(r[f'{n}_std'])}"
    return _latex([*map(_escaped, by), "Judges", "Pairs", "Items", "Percent", "Kappa"], [[*(_escaped(str(r[c])) for c in by), _escaped(r["pair_type"]), str(r["n_pairs"]), str(r["n_items"]), cell(r, "percent"), cell(r, "kappa")] for r in rows], caption, label)


def write_passk(samples: DataFrame, summary: DataFrame, path: str) -> None:
    """Test results by sample as JSON lines and CSV, and their summary."""
    write_json(samples, f"{path}/samples_json")
    write_csv(samples.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in samples.dtypes]), f"{path}/samples_csv", single=False)
    write_csv(summary, f"{path}/summary")


def write_human_records(records: DataFrame, path: str) -> None:
    """Human comparisons as JSON, a directory for each judge: the layout that artifacts have."""
    write_json(records.withColumn("judge", F.col("judge_model_name")), path, ["judge"])


def filter_audit(rows: DataFrame, by: Sequence[str], reason: str = "rejection") -> DataFrame:
    """How many candidates a filter kept and rejected, for each reason and each value of the fields ``by``."""
    out = rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n")).select(F.lit("all").alias("field"), F.lit("all").alias("value"), "outcome", "n")
    for c in by:
        own = rows.groupBy(F.col(c).cast("string").alias("value"), F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
        out = out.unionByName(own.select(F.lit(c).alias("field"), F.coalesce("value", F.lit("missing")).alias("value"), "outcome", "n"))
    return out


def survey_plan(items: DataFrame, columns: Sequence[str] = ("item_id", "annotator", "input_text", "model_a_output", "model_b_output"), most: int = 10_000) -> str:
    """A study's items as an importable survey text: a block for each annotator, a matrix question for each item. A study is small; a larger one is an error."""
    rows = _few(items.select(*columns).orderBy("annotator", "item_id"), most)
    out, last = ["[[AdvancedFormat]]"], None
    for r in rows:
        if r["annotator"] != last:
            last = r["annotator"]
            out += ["", f"[[Block:{last}]]"]
        out += ["", "[[Question:Matrix]]", f"[[ID:{r['item_id']}]]", *(str(r[c] or "") for c in columns[2:]), "", "[[Choices]]", "Overall", "", "[[Answers]]", "A", "Tie", "B"]
    return "\n".join(out) + "\n"
