"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions; decision ``m`` (1 to 255, the bits so far
behind a leading 1) has one context tree over the previous ``depth`` bytes. A
node's Krichevsky-Trofimov estimate and the product of its children's weighted
probabilities are mixed with weight 1/2 each, at all depths:

    Pw(node) = 1/2 KT(node) + 1/2 product of Pw(child)

The tree keeps every context of the training texts. Texts are dealt into chunks;
a chunk sends its distinct runs of depth + 1 bytes, packed, to the part of the
tree under the run's last two context bytes, where the chunks' counts are added
up and the part is weighed; the counts of many chunks are first added up by FAN
chunks at a time, and the costs go back the same way, so that no task gets a row
from every chunk. What lies above the parts has a fixed size (256 x 256
decisions) and is weighed on the driver; the parts then send each chunk the costs
of its own runs. Only decisions that some text meets are held. Weights are those
after the last training byte and stay fixed, so scores don't depend on the order
of documents and sum to 1 over all texts.

With ``nodes`` given, the tree is one broadcast table of the commonest contexts
(a context's own suffixes are at least as common, so the tree is closed), and what
a kept node's dropped children have seen is one child more, "the rest", a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import release, stored, text_bytes
from quillon.llm.textbytes import LOWER, U64, buffer_of, pieces, spans, word_hashes

#: Bytes of text in a chunk, chunks whose runs meet in one task, and places of a stream that are looked up at once.
CHUNK_BYTES, FAN, BLOCK = 24 << 20, 64, 1 << 16


def _streams(column: pa.Array, depth: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, stream, ends): rows a to b as one stream, each as ``depth`` zeros, its A-Z lower-cased bytes and a final zero.

    ends[i] is where row a + i stops; its final zero is a symbol of the text.
    """
    raw, offsets = buffer_of(column)
    for a, b in pieces(offsets, limit):
        sizes = np.diff(offsets[a : b + 1])
        ends = np.cumsum(sizes + depth + 1)
        stream = np.zeros(int(ends[-1]), np.uint8)
        own = np.arange(int(offsets[b] - offsets[a])) + np.repeat(np.arange(b - a) * (depth + 1) + depth, sizes)
        stream[own] = LOWER[raw[offsets[a] : offsets[b]]]
        yield a, b, stream, ends


def _coded(stream: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the stream that are symbols, not the zeros before a text."""
    real = np.ones(len(stream), dtype=bool)
    for d in range(depth):
        real[np.concatenate([[0], ends[:-1]]) + d] = False
    return np.flatnonzero(real)


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n) over all texts of ``docs(text)``: runs of depth + 1 bytes as big-endian numbers, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([x for x, _ in held])
            counts = np.concatenate([x for _, x in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(counts, first)

        for batch in batches:
            for _a, _b, stream, ends in _streams(batch.column(0), depth):
                at = _coded(stream, ends, depth)
                gram = np.zeros(len(at), np.int64)
                for d in range(depth, -1, -1):
                    gram = (gram << 8) | stream[at - d]
                held.append(np.unique(gram, return_counts=True))
                if len(held) > 8:
                    held = [merge()]
        if held:
            keys, counts = merge()
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)].astype(np.int64))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: eight steps up, then Stirling's series."""
    down = np.ones_like(x)
    for i in range(8):
        down *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at the 255 decisions of rows of 256 byte counts; column 0 is unused."""
    rows = len(counts)
    zero, one = np.zeros((rows, 256)), np.zeros((rows, 256))
    level = counts.astype(np.float64)
    for bit in range(7, -1, -1):
        level = level.reshape(rows, 2 << bit)
        zero[:, 1 << bit : 2 << bit], one[:, 1 << bit : 2 << bit] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return zero, one


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - _log_gamma(zero + one + 1.0) - np.log(np.pi)


def weigh(counts: np.ndarray, parent: np.ndarray, level: np.ndarray, depth: int) -> np.ndarray:
    """log10 P(byte | node) as float32 of shape (nodes, 256), for texts whose longest kept context is the node.

    counts: byte counts of each node, ``parent`` its index one byte shorter,
    ``level`` its context's length; parents come before children, node 0 is the
    empty context. Below a node of full depth there is nothing to mix; a text
    that leaves the tree earlier meets the node's rest.
    """
    nodes = len(counts)
    rest = counts.copy()
    np.subtract.at(rest, parent[1:], counts[1:])
    block = 2048
    inside = np.zeros((nodes, 256), np.float32)  # log of the product of the children's Pw
    stop = np.ones((nodes, 256), np.float32)  # weight of the node's own estimate
    for d in range(depth, -1, -1):
        at = np.flatnonzero(level == d)
        for i in range(0, len(at), block):
            rows = at[i : i + block]
            own = _log_kt(*_halves(counts[rows]))
            if d < depth:
                children = inside[rows] + _log_kt(*_halves(rest[rows]))
                whole = np.logaddexp(own, children) - np.log(2)
                stop[rows] = np.exp(own - np.log(2) - whole)
            else:
                whole = own
            if d:
                np.add.at(inside, parent[rows], whole.astype(np.float32))
    del inside
    table = np.zeros((nodes, 256), np.float32)
    gone, left = np.zeros((nodes, 256), np.float32), np.ones((nodes, 256), np.float32)
    for d in range(depth + 1):
        at = np.flatnonzero(level == d)
        for i in range(0, len(at), block):
            rows = at[i : i + block]
            before, share = (gone[parent[rows]], left[parent[rows]]) if d else (0.0, 1.0)
            zero, one = _halves(counts[rows])
            gone[rows] = before + share * stop[rows] * ((one + 0.5) / (zero + one + 1.0))
            left[rows] = share * (1 - stop[rows])
            zero, one = _halves(rest[rows])
            ones = np.clip(gone[rows] + left[rows] * ((one + 0.5) / (zero + one + 1.0)), 1e-9, 1 - 1e-7).astype(np.float64)
            out = np.zeros((len(rows), 256))
            node = np.ones(256, np.int64)
            for bit in range(7, -1, -1):
                high = (np.arange(256) >> bit) & 1
                out += np.log10(np.where(high, ones[:, node], 1 - ones[:, node]))
                node = node * 2 + high
            table[rows] = out
    return table


def train(docs: DataFrame, depth: int = 5, nodes: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(table, child) from all texts of ``docs(text)``: log10 P(byte | node) and the node one byte longer or -1, both (nodes, 256)."""
    grams = stored(gram_counts(docs, depth), "grams")
    spread = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    context = F.expr("(gram >> 8) & ((1L << (8 * d)) - 1)")
    kept = grams.select("gram", "n", spread).groupBy("d", context.alias("c")).agg(F.sum("n").alias("n"))
    kept = kept.orderBy(F.desc("n"), "d", "c").limit(nodes).select("d", "c").toArrow()
    d, c = kept["d"].to_numpy().astype(np.int64), kept["c"].to_numpy().astype(np.int64)
    if not len(d):
        d, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    order = np.lexsort((c, d))
    d, c = d[order], c[order]
    keys = (d << 48) | c
    shorter = (np.maximum(d - 1, 0) << 48) | (c & ((np.int64(1) << (8 * np.maximum(d - 1, 0))) - 1))
    parent = np.searchsorted(keys, shorter)
    child = np.full((len(d), 256), -1, np.int32)
    grown = np.flatnonzero(d)
    child[parent[grown], (c[grown] >> (8 * (d[grown] - 1)))] = grown

    # Byte counts of the kept nodes: bounded by nodes x 256, whatever the corpus.
    spark = docs.sparkSession
    index = spark.createDataFrame(pa.table({"d": d, "c": c, "node": np.arange(len(d))}))
    rows = grams.select("gram", "n", spread).select("d", context.alias("c"), F.expr("gram & 255").alias("byte"), "n")
    seen = rows.join(F.broadcast(index), ["d", "c"]).groupBy("node", "byte").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(d), 256), np.int64)
    counts[seen["node"].to_numpy(), seen["byte"].to_numpy()] = seen["n"].to_numpy()
    release(grams)
    return weigh(counts, parent, d, depth), child


def code_lengths(column: pa.Array, table: np.ndarray, child: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text, its end included; bits per byte are -score * log2(10) / (bytes + 1)."""
    out = np.zeros(len(column))
    flat, down = table.reshape(-1), child.reshape(-1)
    for a, b, stream, ends in _streams(column, depth):
        at = _coded(stream, ends, depth)
        node = np.zeros(len(at), np.int32)
        live = np.arange(len(at), dtype=np.int32)
        for d in range(1, depth + 1):
            longer = down[node[live] * 256 + stream[at[live] - d]]
            found = longer >= 0
            live = live[found]
            node[live] = longer[found]
        costs = flat[node.astype(np.int64) * 256 + stream[at]].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(costs)])
        stops = np.cumsum(np.diff(np.concatenate([[0], ends])) - depth)
        out[a:b] = np.diff(np.concatenate([[0.0], total[stops]]))
    return out


def _runs(stream: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The bytes at the positions, each behind its context with the nearest byte first: runs under one context are neighbours in order."""
    # All places of the stream step by step, then those wanted: no gather for each byte of a run.
    n = len(stream) - depth
    run = np.zeros(n, np.int64)
    for d in [*range(1, depth + 1), 0]:
        run <<= 8
        run |= stream[depth - d : depth - d + n]
    return run[at - depth]


def _added(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, ascending, and the sums of their counts."""
    if not len(runs):
        return runs, counts
    order = np.argsort(runs, kind="stable")
    runs, counts = runs[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    return runs[first], np.add.reduceat(counts, first)


def run_counts(column: pa.Array, learns: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of the texts, ascending, and how often each occurs in those that ``learns`` marks."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b, stream, ends in _streams(column, depth):
        at = _coded(stream, ends, depth)
        sizes = np.diff(np.concatenate([[0], ends])) - depth
        marked = np.sort((_runs(stream, at, depth) << 1) | np.repeat(learns[a:b], sizes))
        own = marked >> 1
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        held.append((own[first], np.add.reduceat(marked & 1, first)))
        if len(held) > 8:
            held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
    return _added(*map(np.concatenate, zip(*held, strict=True)))


def distinct_runs(column: pa.Array, depth: int) -> np.ndarray:
    """Distinct runs of the texts, ascending."""
    held = [np.zeros(0, np.int64)]

    def merged() -> np.ndarray:
        runs = np.sort(np.concatenate(held))
        return runs[np.concatenate([[True], runs[1:] != runs[:-1]])] if len(runs) else runs

    for _a, _b, stream, ends in _streams(column, depth):
        own = np.sort(_runs(stream, _coded(stream, ends, depth), depth))
        held.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        if len(held) > 8:
            held = [merged()]
    return merged()


def _pack(values: np.ndarray) -> bytes:
    """Longs as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _sent(runs: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, runs, counts) for each part of the tree: its two nearest bytes, the rest of the runs as packed steps, packed counts."""
    low = 8 * (depth - 1)
    part = runs >> low
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(runs) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(runs)], strict=True):
        yield int(part[a]), _pack(np.diff(runs[a:b] & ((1 << low) - 1), prepend=0)), _pack(counts[a:b])


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A part's runs and their counts over all chunks, added up a few million at a time."""
    held, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for runs, counts in zip(table["runs"].to_pylist(), table["counts"].to_pylist(), strict=True):
        held.append((np.cumsum(_unpack(runs)), _unpack(counts)))
        waiting += len(held[-1][0])
        if waiting > 1 << 21:
            held, waiting = [_added(*map(np.concatenate, zip(*held, strict=True)))], 0
    return _added(*map(np.concatenate, zip(*held, strict=True)))


def _decided(runs: np.ndarray, counts: np.ndarray, depth: int, bit: int) -> tuple[np.ndarray, list[tuple]]:
    """(decision of each run, nodes from length 2 to ``depth``) of a part for bit ``bit`` of the byte.

    Nodes of a length: (node of each run, zeros seen, ones seen, log Pw, weight of the own estimate).
    """
    byte = runs & 255
    decision = (1 << bit) | (byte >> (8 - bit))
    ones = counts * ((byte >> (7 - bit)) & 1)
    nodes, below = [], None
    for d in range(depth, 1, -1):
        keys, node = np.unique(((runs >> (8 * (depth - d + 1))) << 8) | decision, return_inverse=True)
        one = np.bincount(node, ones, len(keys))
        zero = np.bincount(node, counts, len(keys)) - one
        own = _log_kt(zero, one)
        if below is None:
            whole, stop = own, np.ones(len(keys))
        else:
            up = np.empty(len(below[1]), np.int64)
            up[below[0]] = node
            whole = np.logaddexp(own, np.bincount(up, below[1], len(keys))) - np.log(2)
            stop = np.exp(own - np.log(2) - whole)
        below = node, whole
        nodes.append((node, zero, one, whole, stop))
    return decision, nodes[::-1]


def _costs(part: int, runs: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """log10 P(byte | context) of each of a part's runs; ``top`` is what the lengths 0 and 1 give, and the weight left below."""
    out = np.zeros(len(runs))
    for bit in range(8):
        decision, nodes = _decided(runs, counts, depth, bit)
        gone, left = (x[part >> 8, decision] for x in top)
        for node, zero, one, _whole, stop in nodes:
            gone = gone + left * (stop * ((one + 0.5) / (zero + one + 1.0)))[node]
            left = left * (1 - stop)[node]
        ones = np.clip(gone, 1e-9, 1 - 1e-7)
        out += np.log10(np.where((runs >> (7 - bit)) & 1, ones, 1 - ones))
    return out


def _top(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(gone, left), both (256, 256) by nearest byte and decision, from sums over the parts under each byte."""
    zero, one, inside = (np.zeros((256, 256)) for _ in range(3))
    at = rows["near"].to_numpy(), rows["decision"].to_numpy()
    for x, name in ((zero, "zero"), (one, "one"), (inside, "inside")):
        x[at] = rows[name].to_numpy()
    own = _log_kt(zero, one)
    whole = np.logaddexp(own, inside) - np.log(2)
    stop = np.exp(own - np.log(2) - whole)
    estimate = (one + 0.5) / (zero + one + 1.0)
    zero, one, own = zero.sum(axis=0), one.sum(axis=0), _log_kt(zero.sum(axis=0), one.sum(axis=0))
    first = np.exp(own - np.logaddexp(own, whole.sum(axis=0)))
    return first * ((one + 0.5) / (zero + one + 1.0)) + (1 - first) * stop * estimate, (1 - first) * (1 - stop)


def run_costs(sent: DataFrame, depth: int, chunks: int) -> DataFrame:
    """(chunk, part, costs): for each row of ``sent(chunk, part, runs, counts)`` the costs of its runs, as floats, under the tree of all rows' counts."""

    def merged(group: pa.Table) -> pa.Table:
        runs, counts = _gathered(group)
        return pa.table({"chunk": group["above"][:1], "part": group["part"][:1], "runs": pa.array([_pack(np.diff(runs, prepend=0))], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary())})

    levels = [sent]
    while chunks > FAN:
        above = levels[-1].withColumn("above", F.expr(f"int(chunk div {FAN})"))
        levels.append(stored(above.groupBy("part", "above").applyInArrow(merged, "chunk int, part int, runs binary, counts binary"), "runs"))
        chunks = -(-chunks // FAN)

    def spread(children: pa.Table, parent: pa.Table) -> pa.Table:
        runs, costs = np.cumsum(_unpack(parent["runs"][0].as_py())), np.frombuffer(parent["costs"][0].as_py(), "<f4")
        own = [costs[np.searchsorted(runs, np.cumsum(_unpack(x)))].tobytes() for x in children["runs"].to_pylist()]
        return pa.table({"chunk": children["chunk"], "part": children["part"], "costs": pa.array(own, pa.binary())})

    costs = _top_costs(levels[-1], depth)
    for i in range(len(levels) - 2, -1, -1):
        parent = levels[i + 1].select("chunk", "part", "runs").join(costs, ["chunk", "part"]).withColumnRenamed("chunk", "above")
        children = levels[i].select("chunk", "part", "runs").withColumn("above", F.expr(f"int(chunk div {FAN})"))
        costs = children.groupBy("part", "above").cogroup(parent.groupBy("part", "above")).applyInArrow(spread, "chunk int, part int, costs binary")
    return costs


def _top_costs(sent: DataFrame, depth: int) -> DataFrame:
    """The same for a table with at most FAN rows of each part."""
    def weighed(group: pa.Table) -> pa.Table:
        part, (runs, counts) = group["part"][0].as_py(), _gathered(group)
        found = []
        for bit in range(8):
            decision, nodes = _decided(runs, counts, depth, bit)
            node, zero, one, whole, _stop = nodes[0]
            name = np.zeros(len(zero), np.int32)
            name[node] = decision
            found.append((name, zero, one, whole))
        name, zero, one, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"near": np.full(len(name), part >> 8, np.int32), "far": np.full(len(name), part & 255, np.int32), "decision": name, "zero": zero, "one": one, "whole": whole})

    parts = sent.groupBy("part").applyInArrow(weighed, "near int, far int, decision int, zero double, one double, whole double")
    inside = F.aggregate(F.array_sort(F.collect_list(F.struct("far", "whole"))), F.lit(0.0), lambda s, x: s + x["whole"])
    top = _top(parts.groupBy("near", "decision").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), inside.alias("inside")).toArrow())
    shared = sent.sparkSession.sparkContext.broadcast(top)

    def costed(group: pa.Table) -> pa.Table:
        part, (runs, counts) = group["part"][0].as_py(), _gathered(group)
        costs = _costs(part, runs, counts, shared.value, depth).astype("<f4")
        own = [costs[np.searchsorted(runs, np.cumsum(_unpack(x)))].tobytes() for x in group["runs"].to_pylist()]
        return pa.table({"chunk": group["chunk"], "part": group["part"], "costs": pa.array(own, pa.binary())})

    return sent.groupBy("part").applyInArrow(costed, "chunk int, part int, costs binary")


def run_scores(column: pa.Array, runs: np.ndarray, costs: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text, its end included, from the costs of all its runs."""
    out = np.zeros(len(column))
    for a, b, stream, ends in _streams(column, depth):
        own = _runs(stream, _coded(stream, ends, depth), depth)
        each = np.empty(len(own))
        for i in range(0, len(own), BLOCK):
            # A run of up to 48 bits and its place in the block are one number: a plain sort, and one search for equal runs.
            part = own[i : i + BLOCK].astype(U64)
            part <<= U64(16)
            part |= np.arange(len(part), dtype=U64)
            part.sort()
            place = (part & U64(BLOCK - 1)).astype(np.int64)
            part >>= U64(16)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            found = costs[np.searchsorted(runs, part[first].astype(np.int64))]
            each[i + place] = np.repeat(found, np.diff(first, append=len(part)))
        total = np.concatenate([[0.0], np.cumsum(each)])
        stops = np.cumsum(np.diff(np.concatenate([[0], ends])) - depth)
        out[a:b] = np.diff(np.concatenate([[0.0], total[stops]]))
    return out


def _dictionary(column: pa.Array, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of the texts, and how often each occurs in those that ``learns`` marks."""
    words, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    raw, offsets = buffer_of(column)
    for a, b in pieces(offsets):
        part = LOWER[raw[offsets[a] : offsets[b]]]
        starts, ends, bounds = spans(part, offsets[a : b + 1] - offsets[a])
        hashes = word_hashes(part, starts, ends)
        own, at = np.unique(hashes, return_inverse=True)
        words.append(own)
        counts.append(np.bincount(at, np.repeat(learns[a:b], np.diff(bounds)), minlength=len(own)).astype(np.int64))
    keys, at = np.unique(np.concatenate(words), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def score(docs: DataFrame, depth: int = 5, nodes: int | None = None, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with scores learnt from rows whose crc32(doc_id as text) mod ``folds`` isn't ``fold``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams over words and one end per text), score (log10 probability under
    the context trees of the lower-cased bytes and one end) and bits_per_byte.
    All contexts of 0 to ``depth`` (2 to 5) bytes are kept, or the ``nodes`` commonest.
    Defined cases: null text counts as empty (one token, the end); a null doc_id
    is learnt from and not held out; repeated rows each count; an empty table
    gives an empty result; without a training row, counts are 0 and the trees
    give every bit 1/2. Other columns are ignored.

    Word counts reach the texts without a table of all words in one place: texts
    are dealt into chunks of about 24 MB, a partition each; a chunk sends its
    distinct words, gets back their counts over all chunks, and looks its words up
    there. A word has at most one row for each chunk, so no word is hot.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold, F.lit(True))
    chunks = max(32, -(-text_bytes(docs, "text") // CHUNK_BYTES))
    docs = docs.withColumn("learns", learns)
    model = spark.sparkContext.broadcast(train(docs.where("learns"), depth, nodes)) if nodes else None
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        text = group["text"].combine_chunks()
        learnt = group["learns"].to_numpy().astype(bool)
        keys, counts = _dictionary(text, learnt)
        own = group["chunk"][0].as_py()
        parts = [] if nodes else list(_sent(*run_counts(text, learnt, depth), depth))
        some = pa.table({"chunk": np.full(len(keys), own, np.int32), "word": keys.view(np.int64), "n": counts})
        other = pa.table({"chunk": np.full(len(parts), own, np.int32)} | {name: pa.array([p[i] for p in parts], kind) for i, (name, kind) in enumerate((("part", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())))})
        yield from pa.concat_tables([some, other], promote_options="default").select(["chunk", "word", "n", "part", "runs", "counts"]).to_batches(1 << 16)

    both = stored(dealt.repartitionById(chunks, F.col("chunk")).mapInArrow(words, "chunk int, word long, n long, part int, runs binary, counts binary"), "words")
    sent = both.where("part is null").select("chunk", "word", "n")
    totals = sent.groupBy("word").agg(F.sum("n").alias("n"))
    known = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    texts = docs.where("learns").count()
    train_tokens, kinds = int(known["words"]) + texts, int(known["kinds"]) + bool(texts)
    scale = float(np.log10(train_tokens + kinds + 1))
    back = sent.join(totals.withColumnRenamed("n", "c").hint("merge"), "word").select("chunk", "word", "c")
    costs = run_costs(both.where("part is not null").select("chunk", "part", "runs", "counts"), depth, chunks) if not nodes else spark.createDataFrame([], "chunk int, part int, costs binary")
    back = back.unionByName(costs, allowMissingColumns=True)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        is_text = pc.is_valid(whole["text"])
        group, counted = whole.filter(is_text), whole.filter(pc.invert(is_text))
        if not group.num_rows:
            return
        is_word = pc.is_null(counted["part"])
        of_runs = counted.select(["part", "costs"]).filter(pc.invert(is_word)).sort_by("part")
        costs = np.frombuffer(b"".join(of_runs["costs"].to_pylist()), "<f4")
        counted = counted.select(["word", "c"]).filter(is_word)
        keys = counted["word"].to_numpy().view(U64)
        order = np.argsort(keys)
        keys, counts = keys[order], counted["c"].to_numpy()[order]
        column = group["text"].combine_chunks()
        raw, offsets = buffer_of(column)
        tokens, hits, base = (np.zeros(len(column), kind) for kind in (np.int64, np.int64, np.float64))
        for a, b in pieces(offsets):
            part = LOWER[raw[offsets[a] : offsets[b]]]
            starts, ends, bounds = spans(part, offsets[a : b + 1] - offsets[a])
            c = counts[np.searchsorted(keys, word_hashes(part, starts, ends))] if len(starts) else np.zeros(0, np.int64)
            sums = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0))])
            found = np.concatenate([[0], np.cumsum(c > 0)])
            tokens[a:b] = np.diff(bounds) + 1
            hits[a:b] = np.diff(found[bounds]) + (texts > 0)
            base[a:b] = np.diff(sums[bounds]) + np.log10(texts + 1.0) - tokens[a:b] * scale
        if model:
            scores = code_lengths(column, *model.value, depth)
        else:
            scores = run_scores(column, distinct_runs(column, depth), costs, depth)
        yield from pa.table({
            "doc_id": group["doc_id"], "held_out": pa.array(~group["learns"].to_numpy().astype(bool)), "n_tokens": tokens, "n_known": hits,
            "train_tokens": np.full(len(column), train_tokens), "base_score": base, "score": scores, "bits_per_byte": scores * -np.log2(10) / (np.diff(offsets) + 1),
        }).to_batches(1 << 14)

    met = dealt.unionByName(back, allowMissingColumns=True).select(*_MET).repartitionById(chunks, F.col("chunk"))
    return met.mapInArrow(look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


_MET = ["doc_id", "text", "learns", "chunk", "word", "c", "part", "costs"]
