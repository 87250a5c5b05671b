"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every token has a fixed sparse ternary index vector; a token's word vector is its
own index vector plus the mean of its neighbours', gathered from all documents by
one aggregate into a table of fixed size.
A document is the mean of its tokens' vectors, of two kinds: words (A-Z
lower-cased) and shapes (letters, digits and other signs with runs collapsed, so
that ``WORD!!`` and ``word***`` have a shape however rare the word). A network of
one hidden layer gives a logit, a temperature fitted on rows kept out of training
turns it into a probability. Pooling and the first layer are linear, so a token's
part in the hidden layer is one row of a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.textbytes import LOWER, U64, buffer_of, eased, give_back, mix, pieces, spans, word_hashes

#: Hash buckets of tokens, size of a word vector, index entries that aren't 0, hidden units, neighbours on each side.
BUCKETS, DIMS, NONZERO, HIDDEN, REACH = 1 << 16, 32, 4, 16, 2
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def tokens(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, shape buckets, bounds of rows): of all words in bytes ``part`` with row offsets."""
    starts, ends, bounds = spans(part, offsets)
    words = word_hashes(LOWER[part], starts, ends)
    kinds = _CLASS[part]
    new = np.ones(len(part), dtype=bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    before = np.concatenate([[0], np.cumsum(new)])
    shapes = word_hashes(kinds[new], before[starts], before[ends])
    low = U64(BUCKETS - 1)
    return (words & low).astype(np.int64), (shapes & low).astype(np.int64), bounds


def _entries(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), both (BUCKETS, NONZERO): the entries of each token's index vector, fixed by the seed."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=U64).reshape(BUCKETS, NONZERO) + U64(seed << 32))
    return (h % U64(DIMS)).astype(np.int64), np.where(h >> U64(63), 1, -1).astype(np.int8)


def index_vectors(seed: int) -> np.ndarray:
    """(BUCKETS, DIMS): the index vectors, NONZERO entries of +1 or -1 each; entries at one place add up."""
    places, signs = _entries(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for i in range(NONZERO):
        out[np.arange(BUCKETS), places[:, i]] += signs[:, i]
    return out


def _context(entries: tuple[np.ndarray, np.ndarray], buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, sums, counts): sums of the neighbours' index vectors of each bucket that has any, and how many there were, as integers; rows don't touch."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mine, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, REACH + 1):
        near = row[step:] == row[:-step]
        left, right = buckets[:-step][near], buckets[step:][near]
        mine += [left, right]
        other += [right, left]
    own, near = np.concatenate(mine), np.concatenate(other)
    cells, cell = np.unique(own, return_inverse=True)
    total = np.zeros((len(cells), DIMS), np.int64)
    for i in range(NONZERO):
        total += np.bincount(cell * DIMS + entries[0][near, i], entries[1][near, i], len(cells) * DIMS).astype(np.int64).reshape(-1, DIMS)
    return cells, total, np.bincount(cell, minlength=len(cells))


def _gathered(columns, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sums and counts of ``_context`` over text columns, for words and for shapes."""
    entries = [_entries(seed + kind) for kind in range(2)]
    sums = [(np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)) for _ in range(2)]
    for column in columns:
        raw, offsets = buffer_of(column)
        for a, b in pieces(offsets, 1 << 19):
            *kinds, bounds = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for own, fixed, buckets in zip(sums, entries, kinds, strict=True):
                at, total, seen = _context(fixed, buckets, bounds)
                own[0][at] += total
                own[1][at] += seen
        give_back()
    return sums


def corpus_context(docs: DataFrame, seed: int = 5, text_col: str = "text") -> list[tuple[np.ndarray, np.ndarray]]:
    """The same over all documents: one row per task and bucket that occurs, added up; whole numbers, so order doesn't matter."""
    names = ["kind", "bucket", "seen", *(f"d{i}" for i in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (total, seen) in enumerate(_gathered((x.column(0) for x in batches), seed)):
            at = np.flatnonzero(seen)
            for lo in range(0, len(at), 8192):
                own = at[lo : lo + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind)), pa.array(own), pa.array(seen[own]), *(pa.array(total[own, i]) for i in range(DIMS))], names=names)

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(eased(run), ", ".join(f"{n} long" for n in names))
    rows = rows.groupBy("kind", "bucket").agg(*(F.sum(n).alias(n) for n in names[2:])).toArrow()
    sums = [(np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)) for _ in range(2)]
    kinds, buckets = rows["kind"].to_numpy(), rows["bucket"].to_numpy()
    for kind, (total, seen) in enumerate(sums):
        own = kinds == kind
        seen[buckets[own]] = rows["seen"].to_numpy()[own]
        for i in range(DIMS):
            total[buckets[own], i] = rows[f"d{i}"].to_numpy()[own]
    return sums


class Model(NamedTuple):
    """first: (2, BUCKETS, HIDDEN), each token's share in the hidden layer. A tuple of arrays, which workers can read without this library."""

    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: float
    temperature: float

    def scores(self, column: pa.Array) -> np.ndarray:
        return scores(tuple(self), column)


def scores(model: tuple, column: pa.Array) -> np.ndarray:
    """Calibrated probability of label 1 for each text; a null one counts as empty."""
    first, bias, second, last, temperature = model
    raw, offsets = buffer_of(column)
    hidden = np.zeros((len(column), HIDDEN), np.float32)
    for a, b in pieces(offsets, 1 << 20):
        words, shapes, bounds = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hidden[a:b] = pooled(first[0], words, bounds) + pooled(first[1], shapes, bounds)
    logits = np.tanh(hidden + bias) @ second + last
    return 1 / (1 + np.exp(-np.clip(logits / temperature, -40, 40)))


def pooled(table: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each row's tokens; rows without tokens are 0."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(table[buckets], bounds[:-1][full], axis=0) / np.diff(bounds)[full, None]
    return out


def fit(texts: pa.Array, labels: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]] | None = None, epochs: int = 60, seed: int = 5) -> Model:
    """Fit on labelled texts; a fifth of them, spread evenly, is kept for the temperature.

    ``sums`` are the corpus's neighbour sums, by default those of the texts. With
    labels of one kind, or none at all, every text has the smoothed share of label
    1 as its score: 1/2 without labels.
    """
    vectors = [(index_vectors(seed + kind) + total / np.maximum(seen, 1)[:, None]).astype(np.float32) for kind, (total, seen) in enumerate(sums or _gathered([texts], seed))]
    y = labels.astype(np.float64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((2, BUCKETS, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1.0)
    raw, offsets = buffer_of(texts)
    x = np.zeros((len(texts), 2 * DIMS), np.float32)
    for a, b in pieces(offsets):
        *kinds, bounds = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        x[a:b] = np.hstack([pooled(v, buckets, bounds) for v, buckets in zip(vectors, kinds, strict=True)])
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - center) / spread
    kept = np.arange(len(y)) % 5 == 4
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 0.2, (2 * DIMS, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, 0.2, HIDDEN), np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    weights = [w1, b1, w2, b2]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    train, step = np.flatnonzero(~kept), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 64):
            at = train[i : i + 64]
            h = np.tanh(z[at] @ w1 + b1)
            gap = (1 / (1 + np.exp(-(h @ w2 + b2))) - y[at]) / len(at)
            back = np.outer(gap, w2) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ gap + 1e-4 * w2, gap.sum()]
            step += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if kept.any():
        logits = np.tanh(z[kept] @ w1 + b1) @ w2 + b2
        tried = np.geomspace(0.25, 8, 61)
        costs = [np.logaddexp(0, -(2 * y[kept] - 1) * logits / t).mean() for t in tried]
        temperature = float(tried[int(np.argmin(costs))])
    scaled = w1 / spread[:, None]
    first = np.stack([v @ scaled[i * DIMS : (i + 1) * DIMS] for i, v in enumerate(vectors)]).astype(np.float32)
    return Model(first, (b1 - center @ scaled).astype(np.float32), w2.astype(np.float32), float(b2), temperature)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_chars: int = 24_000_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id as text) mod ``folds`` isn't 0.

    The sample is taken in the order of a hash of doc_id; a text that would bring
    its code points above ``sample_chars`` is left out, so what the driver gets has
    a fixed bound. Texts are read whole, word vectors come from all rows of
    ``docs``. Defined cases: of several labels of a document the least counts;
    null labels and ids are left out; rows that repeat a doc_id count once, by
    their least text; without a usable label, or with an empty table, every score
    is 1/2; other columns are ignored.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    marked = marked.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0)
    marked = marked.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.xxhash64("doc_id", F.lit(23))
    least = marked.orderBy(order, "doc_id").limit(2 * sample)
    sizes = known.select("doc_id", F.length("text").alias("size")).join(F.broadcast(least), "doc_id").groupBy("doc_id", "label").agg(F.min("size").alias("size"))
    picked, used = [], 0
    for row in sizes.orderBy(order, "doc_id").limit(sample).collect():
        if used + row["size"] <= sample_chars:
            used += row["size"]
            picked.append((row["doc_id"], row["label"]))
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    rows = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(order, "doc_id").toArrow()
    return fit(rows["text"].combine_chunks(), rows["label"].to_numpy().astype(np.int64), corpus_context(docs, text_col=text_col))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` plus held_out, score and predicted (1 if score >= threshold).

    Defined cases: null or blank text is scored as empty; a null doc_id isn't held
    out; repeated rows score alike; an empty table gives an empty result; columns
    of ``docs`` with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def score(column: pa.Array) -> pa.Array:
        out = pa.array(scores(shared.value, column))
        give_back()
        return out

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    added = F.arrow_udf(score, "double")(F.col(text_col).cast("string"))
    return docs.withColumns({"held_out": held, "score": added}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
