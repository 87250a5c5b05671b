"""Human studies: drawing items, quotas, repeats, calibration, and dealing items to annotators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.selection import Selector, label_of, matches


def drawn_order(seed: int, *columns: str) -> Column:
    """A place in a shuffle that depends on the seed and the row alone: crc32, then the text itself."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.struct(F.crc32(text.cast("binary")).alias("h"), text.alias("t"))


def select_n(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows at random; fewer are an error. A bounded top-n per task, then over tasks."""
    out = rows.orderBy(drawn_order(seed, *key)).limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"asked for {n} rows, there are {found}")
    return out


def _per_stratum(rows: DataFrame, strata: Sequence[str], key: Sequence[str], quota: DataFrame, seed: int) -> DataFrame:
    """The first ``quota`` (strata, quota) rows of each stratum in drawn order; a stratum with fewer fails.

    A stratum's rows never meet in one task: each part of the table keeps its
    own first rows, and only these are ranked.
    """
    most = quota.agg(F.max("quota")).first()[0] or 0
    salted = rows.withColumns({"__o": drawn_order(seed, *key), "__part": F.pmod(F.xxhash64(*key), F.lit(64))})
    own = Window.partitionBy(*strata, "__part").orderBy("__o")
    kept = salted.withColumn("__i", F.row_number().over(own)).where(F.col("__i") <= most)
    ranked = kept.withColumn("__i", F.row_number().over(Window.partitionBy(*strata).orderBy("__o"))).join(F.broadcast(quota), list(strata))
    short = quota.join(kept.groupBy(*strata).agg(F.count("*").alias("n")), list(strata), "left").where("coalesce(n, 0) < quota")
    if not short.isEmpty():
        raise ValueError(f"strata with too few rows: {short.limit(5).collect()}")
    return ranked.where(F.col("__i") <= F.col("quota")).drop("__i", "__o", "__part", "quota")


def strata_of(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """All combinations of the fields' observed values, whether they occur together or not: a study's design, a few rows."""
    out = None
    for f in fields:
        values = rows.select(f).distinct()
        out = values if out is None else out.crossJoin(values)  # values x values, the design itself
    return out


def equal_allocation(rows: DataFrame, fields: Sequence[str], total: int, seed: int, key: Sequence[str], pinned: DataFrame | None = None) -> DataFrame:
    """``total`` rows, equally many of each combination of observed values.

    ``pinned`` rows (with the columns of ``rows``) are taken first and count
    towards their combination. A total that doesn't divide, a combination without
    enough rows and too many pinned rows are errors.
    """
    strata = strata_of(rows if pinned is None else rows.unionByName(pinned), fields)
    n = strata.count()
    if not n or total % n:
        raise ValueError(f"{total} rows don't divide among {n} combinations")
    quota = strata.withColumn("quota", F.lit(total // n))
    if pinned is None:
        return _per_stratum(rows, fields, key, quota, seed).select(*rows.columns)
    held = pinned.groupBy(*fields).agg(F.count("*").alias("held"))
    quota = quota.join(held, list(fields), "left").select(*fields, (F.col("quota") - F.coalesce("held", F.lit(0))).cast("int").alias("quota"))
    if not quota.where("quota < 0").isEmpty():
        raise ValueError("more pinned rows than a combination's share")
    rest = rows.join(pinned.select(*key).distinct(), list(key), "left_anti")
    return pinned.select(*rows.columns).unionByName(_per_stratum(rest, fields, key, quota, seed).select(*rows.columns))


def explicit_targets(rows: DataFrame, targets: Sequence[tuple[str, Selector, int]], seed: int, key: Sequence[str]) -> DataFrame:
    """Rows for named targets (name, selector, n), one after the other; a row serves one target. Adds ``target``."""
    out, left = None, rows
    for i, (name, selector, n) in enumerate(targets):
        own = select_n(left.where(matches(selector)), n, seed + i, *key).withColumn("target", F.lit(name))
        out = own if out is None else out.unionByName(own)
        left = left.join(own.select(*key), list(key), "left_anti")
    return out


def type_quotas(rows: DataFrame, selectors: Sequence[Selector], total: int, source: str) -> list[tuple[str, Selector, int]]:
    """Targets from repeated selectors: each weighs as often as it stands there.

    A total that the weights don't divide, a type with too few sources and a
    source of two types are errors.
    """
    weights = Counter(label_of(s) for s in selectors)
    by_label = {label_of(s): s for s in selectors}
    if total % sum(weights.values()):
        raise ValueError(f"{total} rows don't divide by a weight of {sum(weights.values())}")
    unit = total // sum(weights.values())
    hits = {label: F.max(matches(s).cast("int")).alias(f"t{i}") for i, (label, s) in enumerate(by_label.items())}
    per = rows.groupBy(source).agg(*hits.values())
    number = sum((F.col(f"t{i}") for i in range(1, len(hits))), F.col("t0"))
    found = per.agg(F.count_if(number > 1).alias("both"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(hits))]).first()
    if found["both"]:
        raise ValueError(f"{found['both']} sources are of more than one type")
    for i, label in enumerate(by_label):
        if (found[f"t{i}"] or 0) < weights[label] * unit:
            raise ValueError(f"{label} has {found[f't{i}'] or 0} sources, {weights[label] * unit} are asked for")
    return [(label, s, weights[label] * unit) for label, s in by_label.items()]


def subtracted(selectors: Sequence[Selector], calibration: Sequence[Selector]) -> list[Selector]:
    """Selectors without one occurrence of each of calibration's; one that isn't there is an error."""
    left = Counter(map(label_of, calibration))
    out = []
    for s in selectors:
        if left[label_of(s)] > 0:
            left[label_of(s)] -= 1
        else:
            out.append(s)
    if missing := sorted(k for k, n in left.items() if n > 0):
        raise ValueError(f"calibration types that the packet lacks: {missing}")
    return out


def repeats(rows: DataFrame, earlier: DataFrame, key: Sequence[str], mode: str) -> tuple[DataFrame, DataFrame]:
    """(pool, pinned): with ``include_only`` the rows of earlier studies are the pool, with ``pin_and_fill`` they are pinned and the rest is."""
    again = rows.join(earlier.select(*key).distinct(), list(key), "left_semi")
    if mode == "include_only":
        return again, again.limit(0)
    if mode == "pin_and_fill":
        return rows.join(earlier.select(*key).distinct(), list(key), "left_anti"), again
    raise ValueError(f"unknown mode: {mode}")


def stratified(rows: DataFrame, by: str, total: int, seed: int, key: str, excluded: DataFrame | None = None) -> DataFrame:
    """total // n rows of each of n benchmarks, without excluded keys."""
    rows = rows if excluded is None else rows.join(excluded.select(F.col(key).cast("string").alias("__x")).distinct(), F.col(key).cast("string") == F.col("__x"), "left_anti")
    quota = rows.select(by).distinct()
    return _per_stratum(rows, [by], [by, key], quota.withColumn("quota", F.lit(total // max(1, quota.count()))), seed).select(*rows.columns)


def variation_combos(options: Mapping[str, Sequence[str]], n: int, seed: int) -> list[dict[str, str]]:
    """n combinations of one option each, at random without repeats; all of them if there are fewer."""
    import itertools
    import random

    every = [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


# Items of a study go to people: hundreds of rows, dealt one after the other, so these work on ids in order.


def _shuffled(items: DataFrame, seed: int, key: str) -> Column:
    return F.row_number().over(Window.orderBy(drawn_order(seed, key))) - 1


def assign(items: DataFrame, annotators: Sequence[str], seed: int, key: str, balance_by: Sequence[str] = (), per_item: int = 1) -> DataFrame:
    """(annotator, columns of items): each item goes to ``per_item`` annotators, who get equally many, or one more.

    With ``balance_by`` each type is dealt by itself, going on where the last one
    stopped, so each annotator's numbers of a type differ by one at most. Items are
    a study's sample; the place that decides is computed over the whole of it.
    """
    who = F.array(*map(F.lit, annotators))
    n = len(annotators)
    if per_item > n:
        raise ValueError(f"{per_item} annotators an item, there are {n}")
    order = [*balance_by, drawn_order(seed, key)]
    placed = items.withColumn("__at", (F.row_number().over(Window.orderBy(*order)) - 1) * per_item)
    each = placed.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))))
    start = seed % n
    return each.select(F.get(who, ((F.col("__at") + F.col("__turn") + start) % n).cast("int")).alias("annotator"), *items.columns)


def assign_shared(items: DataFrame, annotators: Sequence[str], seed: int, key: str, anchors: int, balance_by: Sequence[str] = ()) -> DataFrame:
    """The first ``anchors`` items, taken from the types in turn, go to everyone, the others to one annotator each. Adds ``shared``."""
    own = Window.partitionBy(*balance_by).orderBy(drawn_order(seed, key)) if balance_by else Window.orderBy(drawn_order(seed, key))
    turn = items.withColumn("__turn", F.row_number().over(own))
    ranked = turn.withColumn("__at", F.row_number().over(Window.orderBy("__turn", drawn_order(seed + 1, key))))
    shared = ranked.where(F.col("__at") <= anchors).select(F.explode(F.array(*map(F.lit, annotators))).alias("annotator"), *items.columns).withColumn("shared", F.lit(True))
    rest = ranked.where(F.col("__at") > anchors).select(*items.columns)
    return shared.unionByName(assign(rest, annotators, seed, key, balance_by).withColumn("shared", F.lit(False)))


def packets(assigned: DataFrame, size: int) -> DataFrame:
    """``assigned``; an annotator with another number of items than ``size`` is an error."""
    wrong = assigned.groupBy("annotator").agg(F.count("*").alias("n")).where(F.col("n") != size)
    if not wrong.isEmpty():
        raise ValueError(f"packets of another size than {size}: {wrong.limit(5).collect()}")
    return assigned


def human_overall(overall_choice: Column, choices: Column, policy: str) -> Column:
    """A person's overall winner A, B or tie: as chosen, or by the majority of the map of choices by dimension."""
    if policy == "human_overall":
        return F.when(overall_choice.isin("A", "B"), overall_choice).otherwise("tie")
    if policy != "dimension_majority":
        raise ValueError(f"unknown policy: {policy}")
    count = lambda x: F.size(F.filter(F.map_values(choices), lambda c: c == x))
    return F.when(count("A") > count("B"), "A").when(count("B") > count("A"), "B").otherwise("tie")


def human_records(annotations: DataFrame, policy: str = "human_overall") -> DataFrame:
    """Annotations as comparison records, with the annotator as judge: what ``sources.records.pairwise`` reads."""
    winner = human_overall(F.col("overall_choice"), F.col("dimension_choices"), policy)
    model = lambda c: F.when(c == "A", F.col("model_a_name")).when(c == "B", F.col("model_b_name"))
    order = "struct<position_winner:string,confidence:string,rationale:string>"
    result = lambda d, c: F.struct(
        F.when(c.isin("A", "B"), c).otherwise("tie").alias("winner"), model(c).alias("winner_model"), F.lit(None).cast("string").alias("confidence"), F.lit("").alias("rationale"), F.lit(None).cast("boolean").alias("position_bias_detected"),
        F.lit(None).cast(order).alias("original_order_result"), F.lit(None).cast(order).alias("swapped_order_result"),
    )
    names = F.array_sort(F.map_keys("dimension_choices"))
    return annotations.select(
        "user_id", "task_id", "model_a_name", "model_b_name", model(winner).alias("overall_winner"), F.concat(F.lit("human_"), "annotator_id").alias("judge_model_name"), F.lit(None).cast("string").alias("input_text"), F.lit("persona").alias("pairwise_judgment_type"),
        F.transform_values("dimension_choices", result).alias("dimension_results"),
        F.struct(F.col("overall_choice"), F.col("overall_choice").alias("human_overall_choice"), F.col("confidence").alias("human_overall_confidence"), names.alias("annotated_dimensions"), F.lit(False).alias("bias_measured")).alias("metadata"),
        F.struct(F.lit("persona").alias("pairwise_judgment_type"), names.alias("annotated_dimensions"), F.lit(False).alias("position_swap_enabled"), F.lit(False).alias("bias_measured"), F.lit(None).cast("string").alias("source_persona")).alias("_model_metadata"),
    )


def answers(responses: DataFrame, assignments: DataFrame, questions: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """Survey responses (a column a question) as rows (annotator, item_id, field, answer).

    ``assignments`` has (annotator, item_id, slot, shown_swapped); ``questions``
    (slot, field, column) says in which column a slot's answer stands. An item
    without an answer for a field has no row of it.
    """
    columns = [c for c in responses.columns if c != annotator]
    long = responses.select(annotator, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))).alias("column", "answer")).where("answer is not null")
    return assignments.join(questions, "slot").join(long, [annotator, "column"]).select(annotator, "item_id", "field", F.when(F.col("shown_swapped") & F.col("answer").isin("A", "B"), F.when(F.col("answer") == "A", "B").otherwise("A")).otherwise(F.col("answer")).alias("answer"))
