"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash of doc_id. A source whose
target is T and size S takes floor(T / S) whole epochs and, for what is left, the
first blocks of a seeded permutation of its blocks; the block on the boundary is
taken in part. So each source has an exact number of block slots. A tree halves
the output shards again and again and splits the slots of all sources between
the halves by a multivariate-hypergeometric draw, down to one shard: each shard
knows how many blocks of each source it holds, the numbers add up exactly, and
slots in permuted order make the draws disjoint. A shard larger than one task
should sort is cut into parts by block. What a document's copies and shards are
follows from its doc_id, its source and small tables, so that texts move once, to
their shards. The driver holds a row of figures for each source, at most SHARDS
numbers of slots for each, sums per range of blocks and per block of one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stored
from quillon.llm.textbytes import buffer_of, eased, pieces, spans

#: Documents in a block on average, and ranges of blocks whose sums the driver sees at once.
BLOCK_ROWS, RANGES = 64, 256
#: Copies of a document at most, words in a shard (or in a part of it), and shards at most.
MOST, SHARD_WORDS, SHARDS = 3, 20_000_000, 4096


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(repr, parts)).encode()).digest()[:8], "big")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), most: float = MOST) -> dict[str | None, float]:
    """Each source's words: all sizes shared by weight, sources in code point order with null last.

    A target stops at ``most`` times its source's size; what is above is shared
    again by weight among the rest until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, open_, out = float(sum(n for _, n in order)), dict(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s: float(most * n) for s, n in open_.items() if left * weight[s] / total > most * n}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= full
        left -= sum(full.values())
        open_ = {s: n for s, n in open_.items() if s not in full}
    return out


def split_slots(slots: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many of each source's slots each shard holds; columns add up to ``slots``."""
    out = np.zeros((shards, len(slots)), np.int64)

    def halve(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        total = int(own.sum())
        rng = np.random.default_rng([seed, lo, hi])
        want, rest, left = round(total * (mid - lo) / (hi - lo)), total, np.zeros_like(own)
        for i, n in enumerate(own.tolist()):  # a multivariate draw, one source after the other
            rest -= n
            left[i] = want if not rest else _drawn(rng, n, rest, want) if n and want else 0
            want -= int(left[i])
        halve(lo, mid, left)
        halve(mid, hi, own - left)

    halve(0, shards, np.asarray(slots, np.int64))
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    share, all_ = good / (good + bad), good + bad  # numpy's limit; so large, the draw is normal
    spread = (drawn * share * (1 - share) * (all_ - drawn) / (all_ - 1)) ** 0.5
    return int(min(good, drawn, max(0, drawn - bad, round(rng.normal(drawn * share, spread)))))


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words ``[^\\x20\\x09-\\x0D]+`` of each text, null having none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column(2))
            sizes = [np.zeros(0, np.int64)]
            for a, b in pieces(offsets):
                sizes.append(np.diff(spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes))], names=["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(eased(run), "doc_id long, source string, size long")


_PLAN = "__key string, __blocks long, __step long, __shift long, __size long, __target double, __whole int, __need double"


def _placed(df: DataFrame, plan: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Adds what the plan says of each row's source, the row's block, and its place in the permutation of the blocks."""
    joined = df.join(F.broadcast(plan), df[f"`{source_col}`"].cast("string").eqNullSafe(plan["__key"])).drop("__key")
    block = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1)), F.lit(seed)), F.col("__blocks"))
    return joined.withColumn("__block", block).withColumn("__place", F.pmod(F.col("__block") * F.col("__step") + F.col("__shift"), F.col("__blocks")))


class Mix:
    """What is taken of each source: figures per source, the cut through its blocks, and the shards of its slots."""

    def __init__(self, docs: DataFrame, weights: Sequence[float], shards: int | None, seed: int) -> None:
        spark, self.seed = docs.sparkSession, seed
        self.sizes = stored(word_sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))), "sizes")
        found = sorted(self.sizes.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
        target = targets([(s, n) for s, n, _ in found], weights)
        total = sum(n for _, n, _ in found)
        self.shards = shards or max(32, min(SHARDS, -(-total // SHARD_WORDS)))
        self.parts = max(1, -(-total // (self.shards * SHARD_WORDS)))
        rows = []
        for source, size, n in found:
            blocks = max(1, -(-n // BLOCK_ROWS))
            step = 1 + _seed(seed, source, "step") % blocks
            while np.gcd(step, blocks) != 1:
                step += 1
            whole = min(MOST, int(target[source] // size)) if size else 0
            rows.append((source, blocks, step % blocks or 1, _seed(seed, source, "shift") % blocks, size, target[source], whole, target[source] - whole * size if whole < MOST and size else 0.0))
        self.plan = spark.createDataFrame(rows, _PLAN)
        need = {r[0]: (0, r[1], r[7]) for r in rows if r[7] > 0}
        edges, partial = self._cut(need)
        slots = [r[6] * r[1] + (edges[r[0]] + 1 if r[0] in edges else 0) for r in rows]
        shares = split_slots(slots, self.shards, seed).cumsum(axis=0) if rows else np.zeros((self.shards, 0), np.int64)
        self.ends = spark.createDataFrame([(r[0], edges.get(r[0], 0), shares[:, i].tolist()) for i, r in enumerate(rows)], "__key string, __edge long, __ends array<long>")
        self.partial = spark.createDataFrame(partial, "__part_key string, __part_id long").distinct().withColumn("__in_part", F.lit(True))

    def _cut(self, cut: dict[str | None, tuple[int, int, float]]) -> tuple[dict[str | None, int], list[tuple[str | None, int | None]]]:
        """The block of each source in which its words are reached, and the documents of it that are taken: range by range down to one block."""
        spark, placed = self.sizes.sparkSession, _placed(self.sizes, self.plan, self.seed)

        def between() -> DataFrame:
            edges = spark.createDataFrame([(s, lo, hi) for s, (lo, hi, _) in cut.items()], "key string, lo long, hi long")
            near = placed["source"].eqNullSafe(edges["key"]) & (placed["__place"] >= edges["lo"]) & (placed["__place"] < edges["hi"])
            return placed.join(F.broadcast(edges), near).drop("key")

        while any(hi - lo > 1 for lo, hi, _ in cut.values()):
            rows = between().withColumn("r", F.expr(f"(__place - lo) * {RANGES} div (hi - lo)")).groupBy("source", "r").agg(F.sum("size").alias("w")).collect()
            for source, steps in _grouped(rows).items():
                lo, hi, need = cut[source]
                for r, w in steps:
                    if w >= need:
                        break
                    need -= w
                cut[source] = lo - (-r * (hi - lo) // RANGES), lo - (-(r + 1) * (hi - lo) // RANGES), need
        order = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(self.seed + 1)).alias("o")
        partial: list[tuple[str | None, int | None]] = []
        for source, members in _grouped(between().groupBy("source", order, "doc_id").agg(F.sum("size").alias("w")).collect()).items():
            need, over = cut[source][2], []
            for _, doc_id, w in members:
                if w <= need:
                    partial.append((source, doc_id))
                    need -= w
                else:
                    over.append((w, doc_id))
            if over and min(over, key=lambda x: x[0])[0] < 2 * need:
                partial.append((source, min(over, key=lambda x: x[0])[1]))
        return {s: lo for s, (lo, _, _) in cut.items()}, partial

    def decide(self, df: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
        """Adds __size and __target of the row's source, __copies, and __shards, the output shard of each copy."""
        out = _placed(df, self.plan, self.seed, id_col, source_col)
        source = F.col(f"`{source_col}`").cast("string")
        out = out.join(F.broadcast(self.ends), source.eqNullSafe(F.col("__key"))).drop("__key")
        out = out.join(F.broadcast(self.partial), source.eqNullSafe(F.col("__part_key")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__part_id")), "left").drop("__part_key", "__part_id")
        extra = (F.col("__need") > 0) & ((F.col("__place") < F.col("__edge")) | ((F.col("__place") == F.col("__edge")) & F.coalesce("__in_part", F.lit(False))))
        out = out.withColumn("__copies", F.col("__whole") + extra.cast("int"))
        slot = F.expr("transform(sequence(0, __copies - 1), e -> e * __blocks + __place)")
        # How many shards end at or before a slot, by halving.
        halving = "aggregate(sequence(1, 1 + int(ceil(log2(1 + size(__ends))))), named_struct('lo', 0, 'hi', size(__ends)), (b, i) -> if(b.lo >= b.hi, b, if(__ends[(b.lo + b.hi) div 2] <= s, named_struct('lo', int((b.lo + b.hi) div 2) + 1, 'hi', b.hi), named_struct('lo', b.lo, 'hi', int((b.lo + b.hi) div 2)))), b -> b.lo)"
        out = out.withColumn("__slots", slot).withColumn("__shards", F.when(F.col("__copies") > 0, F.expr(f"transform(__slots, s -> {halving})")).otherwise(F.array().cast("array<int>")))
        return out.drop("__slots", "__edge", "__ends", "__in_part", "__need", "__whole", "__step", "__shift", "__blocks", "__place")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), shards: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, shards) for ``docs(doc_id, source, text)``, one row per row.

    shards lists the output shard of each copy; without a number given there is
    one for each SHARD_WORDS words, 32 at least and SHARDS at most. Reruns agree,
    whatever the order of rows. Defined cases: null text has size 0 and may be
    taken any number of times at no words; a null source is a source of its own,
    the last; a null doc_id is dealt like any other; repeated rows count each; a
    source without words has target 0; an empty table gives an empty result; other
    columns are ignored. No document is taken more than three times.
    """
    plan = Mix(docs, weights, shards, seed)
    out = plan.decide(plan.sizes)
    return out.select("doc_id", "source", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"), F.col("__shards").alias("shards"))


def _grouped(rows: Sequence[tuple]) -> dict[str | None, list[tuple]]:
    """Rows (source, ...) by source, each list sorted."""
    out: dict[str | None, list[tuple]] = {}
    for row in rows:
        out.setdefault(row[0], []).append(tuple(row[1:]))
    return {s: sorted(x, key=lambda y: [(v is None, v or 0) for v in y]) for s, x in out.items()}


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), shards: int | None = None, seed: int = 11) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy, each shard in partitions of its own, shuffled within these.

    Texts move once. Defined cases are those of ``mix``; all columns of ``docs``
    stay, but for names with two leading underscores that clash with those used
    here.
    """
    plan = Mix(docs, weights, shards, seed)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = plan.decide(docs).where("__copies > 0").select(*columns, "__block", F.posexplode("__shards").alias("__copy", "__shard"))
    part = (F.col("__shard") * plan.parts + F.pmod(F.xxhash64("__block", F.lit(seed + 3)), F.lit(plan.parts))).cast("int")
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("__copy"), F.lit(seed + 2))
    out = taken.withColumn("__part", part).repartitionById(plan.shards * plan.parts, F.col("__part"))
    return out.sortWithinPartitions("__part", order).select(*columns)
