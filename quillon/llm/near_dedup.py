"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct w-word shingles, hashed by one 64-bit function;
its sketch is the k smallest hashes. The steps, none of which collects a group:

1. Documents with equal sets become one class, whose least doc_id stands for it.
2. Inverted lists hold, per class, its rarest retained values. Classes as alike
   as asked for share most retained values, so that leaving out the commonest
   ones, as many as must be shared less one, loses no pair (a value that a third
   of the corpus shares is seldom among the rarest of any document).
3. In each list, the class with the most shared values is the pivot; the others
   are paired with it, which takes as many pairs as the list has members, and
   links most of a large group of near copies.
4. Lists whose members are then still in different components leave these to an
   exact prefix join on the full sets: shingles put from rare to common, a pair
   meets early enough in both to leave the overlap that it needs, or never.
5. The Jaccard estimate of the two sketches' union drops poor pairs, and exact
   Jaccard similarity of the full sets confirms links.
6. Components of the links are the groups.

Texts never move: a bitmap of fixed size names the documents that pairs hold, and
these send their sets. A value, pivot or document that many rows share is dealt to
several tasks in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.components import components
from quillon.llm.shared import marked, named, release, salted_join, stored
from quillon.llm.textbytes import U64, eased, mix, shingle_sets

_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
_LINK = "a long, b long"


def sketches(docs: DataFrame, w: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, h1, h2, sketch): set size, 128-bit identity of the set and its k smallest hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sizes, kept = [], [], [], [0], []
            for own in shingle_sets(batch.column(1), w):
                n.append(len(own))
                with np.errstate(over="ignore"):
                    h1.append(int(np.add.reduce(mix(own))) if len(own) else 0)
                    h2.append(int(np.bitwise_xor.reduce(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)))) if len(own) else 0)
                kept.append(own[:k].copy())
                sizes.append(sizes[-1] + min(k, len(own)))
            values = np.concatenate([*kept, np.zeros(0, U64)]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
            hashes = [pa.array(np.array(x, dtype=U64).view(np.int64)) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *hashes, lists], names=_SKETCH.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(eased(run), _SKETCH)


def _sides(pairs: DataFrame, own: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b), a stored table, with ``column`` of ``own`` (doc_id, column) for both ids as xa and xb."""
    a, b = (own.select(F.col("doc_id").alias(x), F.col(column).alias(f"x{x}")) for x in "ab")
    return salted_join(salted_join(pairs, a, "a", "b"), b, "b", "a", pairs)


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, least: float, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule the similarity out."""
    whole = (F.size("xa") < k) & (F.size("xb") < k)  # such sketches are the sets
    union = F.slice(F.array_sort(F.array_union("xa", "xb")), 1, k)
    both = F.array_intersect(union, F.array_intersect("xa", "xb"))
    exact = 100 * F.size(F.array_intersect("xa", "xb")) >= percent * F.size(F.array_union("xa", "xb"))
    likely = F.size(both) >= F.lit(least) * F.size(union)
    return _sides(pairs, reps, "sketch").where(F.when(whole, exact).otherwise(likely)).select("a", "b")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose doc_id is in ``ids``, and surely some others."""
    return marked(docs, "doc_id", named(ids, "doc_id")).where("__named").select("doc_id", "text")


def _once(df: DataFrame, *order: str) -> DataFrame:
    """A stored table with one row for each doc_id, the least by ``order``; nothing moves where none repeats."""
    if df.count() == df.select("doc_id").distinct().count():
        return df
    rest = [c for c in df.columns if c != "doc_id" and c not in order]
    return stored(df.groupBy("doc_id").agg(F.min(F.struct(*order, *rest)).alias("r")).select("doc_id", *(f"r.{c}" for c in (*order, *rest))), "once")


def _confirmed(pairs: DataFrame, docs: DataFrame, w: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a stored table whose full sets have 100 * intersection >= percent * union.

    Each set is computed where its text is read, travels as packed hashes, and
    meets its partners in joins, so no group of pairs shares a task.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.tobytes() for x in shingle_sets(batch.column(1), w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "items"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    own = _once(stored(_of(docs, ids).mapInArrow(eased(sets), "doc_id long, items binary"), "sets"), "items")
    out = stored(_sides(pairs, own, "items").select("a", "b", "xa", "xb").mapInArrow(eased(judge), _LINK), "confirmed")
    release(own)
    return out


def _shingle_rows(docs: DataFrame, ids: DataFrame, w: int) -> DataFrame:
    """(doc_id, h): every shingle of the documents in ``ids``, and surely of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, found, rows = [], [], 0
            for doc_id, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), w), strict=True):
                held.append(np.full(len(own), doc_id, np.int64))
                found.append(own)
                rows += len(own)
                if rows > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "h"])
                    held, found, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "h"])

    return _of(docs, ids).mapInArrow(eased(run), "doc_id long, h long")


def _across(docs: DataFrame, rest: DataFrame, w: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of ``rest`` (doc_id, n, c) in different components c that may be alike enough.

    An exact prefix join on the full sets: with each document's shingles put from
    rare to common, a pair first meets at places early enough to leave the
    overlap that it needs behind them. In a list, only documents outside its
    largest component look for partners.
    """
    wanted = rest.select("doc_id").distinct()
    rows = stored(_shingle_rows(docs, wanted, w).join(wanted, "doc_id", "left_semi").distinct(), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("doc_id")
    held = salted_join(rows, often, "h", "doc_id").withColumns({"s": F.count("*").over(own), "at": F.row_number().over(own.orderBy("f", "h"))})
    sizes = rest.groupBy("c").agg(F.count("*").alias("size"))
    held = held.join(rest.join(sizes, "c"), "doc_id")
    # What a document has from a place on, its shingles that no other has coming first.
    held = held.withColumn("left", F.col("s") - F.col("at") + 1).where(F.col("left") * 100 >= F.col("n") * percent)
    held = stored(held.select("h", "doc_id", "n", "c", "size", "left"), "prefixes")
    mixed = held.groupBy("h").agg(F.max(F.struct("size", "c")).alias("t"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", F.col("t.c").alias("main"))
    x = salted_join(held, mixed, "h", "doc_id").where("c <> main").alias("x")
    y = held.drop("size").alias("y")
    near = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and (100 + {percent}) * least(x.left, y.left) >= {percent} * (x.n + y.n)")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & near)
    out = stored(pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "across")
    release(rows, held)
    return out


def near_duplicates(docs: DataFrame, w: int = 5, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Links documents whose sets of distinct ``w``-word shingles have
    100 * intersection >= percent * union; component_id is the least doc_id that
    links reach, and kept marks it. Defined cases: null or blank text has an
    empty set and is linked with nothing; a text with 1 to w-1 words has one
    shingle, the whole sequence; equal sets are linked whatever their number;
    rows that repeat a doc_id are one document if their texts agree, else each
    row follows its own text and links are confirmed on the text whose set is
    least by its hashes; a null
    doc_id takes part in nothing and gives component_id null and kept true. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = stored(sketches(docs, w, k), "sketches")
    known = sk.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    first = classes.select(F.col("rep").alias("doc_id"), F.struct("n", "h1", "h2").alias("set"))
    reps = known.join(first, "doc_id").where(F.col("set") == F.struct("n", "h1", "h2"))
    reps = reps.groupBy("doc_id").agg(F.min_by(F.struct("n", "sketch"), F.struct("h1", "h2")).alias("r")).select("doc_id", "r.n", "r.sketch")
    reps = stored(reps, "reps")

    # The rarest retained values; a value of one class only can't make a pair, but fills a place. Of two sets that fit
    # into their sketches, and whose partners must fit too, the shared values are known; else five deviations below the mean.
    size, share = F.least(F.col("n"), F.lit(k)).cast("int"), percent / 100
    whole = F.lit(percent) * size / 100
    likely = F.floor(size * (share - 5 * (share * (1 - share) / k) ** 0.5))
    needed = F.greatest(F.lit(1), F.when(F.col("n") <= k * percent // 100, F.ceil(whole)).otherwise(likely)).cast("int")
    places = size - needed + 1
    values = reps.select("doc_id", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    values = salted_join(values, often, "v", "doc_id")
    own = Window.partitionBy("doc_id")
    values = values.withColumns({"shared": F.count("*").over(own), "at": F.row_number().over(own.orderBy("f", "v"))})
    lists = stored(values.where(F.col("at") <= places - (size - F.col("shared"))).select("v", "doc_id", "n", "shared"), "lists")

    def able(x: str, y: str) -> F.Column:
        return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")

    sure = max(0.0, percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5)
    top = lists.groupBy("v").agg(F.max(F.struct("shared", (-F.col("doc_id")).alias("p"), "n")).alias("t")).select("v", (-F.col("t.p")).alias("pivot"), F.col("t.n").alias("pn"))
    near = salted_join(lists, top, "v", "doc_id").where(F.col("doc_id") != F.col("pivot")).where(able("n", "pn"))
    tried = stored(near.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct(), "tried")
    links = _confirmed(stored(_estimated(tried, reps, k, sure, percent), "pairs"), docs, w, percent)

    # Lists that still hold several components: pairs across components that were not tried.
    group = stored(components(links), "groups")
    placed = lists.join(group, lists.doc_id == group.node, "left").select("v", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    mixed = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2").select("v")
    rest = stored(salted_join(placed, mixed, "v", "doc_id", lists).select("doc_id", "n", "c").distinct(), "rest")
    across = _across(docs, rest, w, percent)
    untried = across.join(tried, ["a", "b"], "left_anti")
    more = _confirmed(stored(_estimated(untried, reps, k, sure, percent), "pairs"), docs, w, percent)
    final = stored(components(links.unionByName(more)), "components")
    release(lists, tried, group, rest, across, reps)

    to = classes.join(final, classes.rep == final.node, "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = sk.join(to, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
