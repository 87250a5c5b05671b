"""Document fingerprints from closed syncmers.

A window of K bytes is a closed syncmer if the least hash of its inner runs of S
bytes stands first or last in it. Whether a window is chosen depends on its own
bytes only, so an edit changes anchors near it and no others, and equal passages
have equal anchors wherever they stand; of K - S + 1 windows in a row one at least
is chosen. A fingerprint keeps every anchor and its place; two fingerprints are
compared by the share of all their anchors that both have at one common offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import text_bytes
from quillon.llm.textbytes import U64, mix

#: Bytes of a window and of its inner runs: 2 of K - S + 1 windows are chosen on average.
K, S = 32, 4
#: Anchors within so many bytes of one offset agree in position: insertions shift what follows.
SLACK = 64
#: Bytes of text in a range of doc_ids, and ranges at most (a range is read as a stream).
PART_BYTES, PARTS = 16 << 20, 10_000
_ANCHOR = np.dtype([("hash", ">u8"), ("gap", "u1")])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of one text's bytes, by position; a text of 1 to K-1 bytes is one anchor."""
    n = len(raw)
    if n < K:
        return (np.frombuffer(hashlib.sha256(raw.tobytes()).digest()[:8], U64) | U64(1), np.zeros(1, np.int64)) if n else (np.zeros(0, U64), np.zeros(0, np.int64))
    inner = np.lib.stride_tricks.as_strided(raw, (n - S + 1, S), (1, 1))
    runs = np.ascontiguousarray(inner).view(np.uint32).reshape(-1).astype(U64)
    hashes = mix(runs)
    width = K - S + 1
    least, have = hashes, 1
    while have < width:  # minima of windows twice as long, then of the width itself
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = np.flatnonzero((hashes[: n - K + 1] == least) | (hashes[width - 1 :] == least))
    whole = np.zeros(len(chosen), U64)
    for step in range(0, K, S):
        whole = mix(whole ^ runs[chosen + step])
    return whole, chosen


def _numbered(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors made distinct by how often they stood before in the text, ascending, and their places."""
    order = np.lexsort((at, hashes))
    hashes, at = hashes[order], at[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    places = np.arange(len(hashes))
    before = places - np.maximum.accumulate(np.where(first, places, 0))
    own = np.where(before > 0, mix(hashes ^ mix(before.astype(U64))), hashes)
    own, first = np.unique(own, return_index=True)
    return own, at[first]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the share of all anchors that both have, near the commonest offset; two empty texts are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (ha, pa_), (hb, pb) = _numbered(*a), _numbered(*b)
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    bins, counts = np.unique((pa_[ia] - pb[ib]) // SLACK, return_counts=True)
    near = counts.copy()
    near[:-1] += np.where(bins[1:] == bins[:-1] + 1, counts[1:], 0)
    return float(near.max()) / (len(ha) + len(hb) - len(both))


def text_of(prints: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: for each anchor 16 hexadecimal digits of its hash and 2 of how far it stands behind the last one."""
    out = np.zeros(len(prints[0]), _ANCHOR)
    out["hash"], out["gap"] = prints[0], np.diff(prints[1], prepend=0)
    return out.tobytes().hex()


def _cuts(docs: DataFrame, parts: int) -> np.ndarray:
    """Descending doc_ids, each the first of one of about ``parts`` equal ranges."""
    found = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], PARTS)).first()
    return np.array(sorted({x for x in [found[0], *(found[1] or [])] if x is not None}, reverse=True), np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document by descending doc_id; after the
    last comes the first. Defined cases: null text counts as empty, with an empty
    fingerprint; two empty fingerprints have likeness 1, an empty and another 0;
    rows of one doc_id stand in the order of their texts' hashes; null doc_ids
    come last; a table of one row follows itself; an empty table gives an empty
    result. Other columns are ignored.

    One shuffle deals the texts, compressed, into ranges of doc_id that begin with
    a known one. A range is read in order as a stream, never held; the row that
    the next range begins with is sent to both. Only what follows the last id and
    the last null goes to every task, two texts.
    """
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = _cuts(docs, min(PARTS, max(16, -(-text_bytes(docs, "text") // PART_BYTES))))
    first = docs.where(F.col("doc_id") == F.lit(int(cuts[0]))).agg(F.min_by("text", "tie")).first()[0] if len(cuts) else None
    first_null = docs.where("doc_id is null").agg(F.min_by("text", "tie")).first()[0]
    if first is None:
        first = first_null
    # By part: what follows the last row of the last range, and the last null.
    shared = spark.sparkContext.broadcast((-cuts, {len(cuts) - 1: first if first_null is None else first_null, len(cuts): first}))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, (starts, _) = zstandard.ZstdCompressor(level=1), shared.value
        for batch in batches:
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            part = np.where(null, len(starts), np.searchsorted(starts, -ids, side="right") - 1)
            heads = np.flatnonzero(~null & np.isin(-ids, starts) & (part > 0))
            packed = pa.array([packer.compress(x.as_buffer()) for x in batch.column(1).cast(pa.large_binary())], pa.binary())
            columns = [pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), np.int32)), batch.column(0), batch.column(2), packed]
            yield pa.RecordBatch.from_arrays(columns, names=_PACKED)
            if len(heads):
                columns = [pa.array((part[heads] - 1).astype(np.int32)), pa.array(np.ones(len(heads), np.int32)), *(c.take(pa.array(heads)) for c in columns[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, (_, tails) = zstandard.ZstdDecompressor(), shared.value
        held: tuple[int, int | None, str, tuple] | None = None
        rows: list[tuple] = []

        def prints(text: str) -> tuple[np.ndarray, np.ndarray]:
            return anchors(np.frombuffer(text.encode(), np.uint8))

        def done(next_text: str, next_own: tuple) -> None:
            _, doc_id, text, own = held
            n, cut = len(text), len(text) // 3
            data = (text[: n - cut] + next_text[:cut]).encode()
            changed = anchors(np.frombuffer(data, np.uint8))
            rows.append((doc_id, n, hashlib.sha256(data).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), likeness(own, next_own)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)
            rows.clear()
            return out

        for batch in batches:
            for part, copied, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(4), strict=True):
                if copied and not held:
                    continue
                text = opener.decompress(packed.as_buffer()).decode()
                own = prints(text)
                if held and held[0] == part:
                    done(text, own)
                elif held:
                    done(tails[held[0]], prints(tails[held[0]]))
                held = None if copied else (part, doc_id, text, own)
                if len(rows) >= 512:
                    yield flush()
        if held:
            done(tails[held[0]], prints(tails[held[0]]))
        if rows:
            yield flush()

    packed = docs.select("doc_id", "text", "tie").mapInArrow(squeeze, "part int, copied int, doc_id long, tie long, packed binary")
    dealt = packed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "copied", F.desc("doc_id"), "tie")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_PACKED = ["part", "copied", "doc_id", "tie", "packed"]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
