"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts texts into chunks at places that depend on
the bytes near them only, so documents that share a passage share chunks. Each
task encodes a chunk once and keeps its tokens. Tokens next to a cut may differ
from those of the whole text: a chunk therefore keeps tokens only between its
first and last seam, a seam being a space behind a visible ASCII character, where
the pre-tokenizer always starts a new piece whatever else the text holds. What
lies around a cut, from the last seam before it to the first behind it, is
encoded again as one stretch, over several chunks where these have no seam. The
result is the encoding of the whole text.

The vocabulary file is a parameter. Whether a character beyond ASCII is a letter,
a number, white space or none of these is asked of both libraries when it first
comes up. Texts with a special token, or with a character on which they disagree,
are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.textbytes import buffer_of, eased, mix

#: Rolling-hash bits that must be 0 at a cut (about 1 cut in 512 bytes), and bytes of text whose tokens a task keeps.
CUT_BITS, KEPT_BYTES = 9, 24 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Positions before which the rolling hash of the 16 bytes ahead of them cuts, never inside a character."""
    if len(raw) < 32:
        return np.zeros(0, np.int64)
    h, span = _GEAR[raw], 1
    with np.errstate(over="ignore"):
        while span < 16:
            longer = h.copy()
            longer[span:] += h[:-span] << np.uint32(span)
            h, span = longer, span * 2
    at = np.flatnonzero((h[15:-1] >> np.uint32(32 - CUT_BITS)) == 0) + 16
    return at[(raw[at] & 0xC0) != 0x80]


class Coder:
    """Encodes as the tokenizers library does with the given file, specials not added, and decodes."""

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if self.library.normalizer is not None or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the file is none of a plain byte-level BPE")
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *specials.values()]))
        for token, i in [*vocab.items(), *((k.encode(), v) for k, v in specials.items())]:
            self.bytes_of[i] = token
        pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        merges = [bytes(back[c] for c in a + b) for a, b in pairs]
        self.specials = [x.encode() for x in specials]
        self.fast = tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks=_ranks(vocab, merges), special_tokens={})
        ranked = self.fast._mergeable_ranks
        self.same_ids = np.zeros(len(ranked), np.uint32)
        for token, rank in ranked.items():
            self.same_ids[rank] = vocab[token]
        self.kept: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.held = self.seen = self.reused = 0  # bytes kept, met in chunks, and of these met before
        self.agreed, self.differ = {chr(i) for i in range(128)}, set()

    def _known(self, text: str) -> bool:
        """Whether the libraries split all characters of the text alike."""
        chars = set(text)
        new = sorted(chars - self.agreed - self.differ)
        if new:
            import tiktoken

            # One piece is one token of this vocabulary: a letter joins an a, a number a 1, another sign an !.
            pieces = [h + c for c in new for h in "a1!"]
            ranks = {bytes([i]): i for i in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pieces)}
            probe, split = tiktoken.Encoding("probe", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}), self.library.pre_tokenizer.pre_tokenize_str
            for c in new:
                same = all((len(split(h + c)) == 1) == (len(probe.encode_ordinary(h + c)) == 1) for h in "a1!")
                (self.agreed if same else self.differ).add(c)
        return not chars & self.differ

    def _tokens(self, data: bytes) -> np.ndarray:
        return self.same_ids[self.fast.encode_to_numpy(data.decode(), disallowed_special=())]

    def _chunk(self, data: bytes, seams: np.ndarray) -> tuple[int, int, np.ndarray]:
        """(first, last, tokens between): the chunk's first and last seam; -1 without two seams."""
        found = self.kept.get(data)
        if found is None:
            found = (int(seams[0]), int(seams[-1]), self._tokens(data[seams[0] : seams[-1]])) if len(seams) > 1 else (-1, -1, _NONE)
            if self.held > KEPT_BYTES:
                self.kept.clear()
                self.held = 0
            self.kept[data] = found
            self.held += len(data) + 4 * len(found[2])
        else:
            self.reused += len(data)
        self.seen += len(data)
        return found

    def encode(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one text's bytes."""
        data = raw.tobytes()
        if any(x in data for x in self.specials) or (len(raw) and int(raw.max()) > 127 and not self._known(data.decode())):
            return np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, np.uint32)
        if len(raw) < 64:
            return self._tokens(data)
        seams = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
        edges = np.concatenate([[0], cuts_of(raw), [len(raw)]])
        inside = np.searchsorted(seams, edges)
        out, open_ = [], 0  # what stands before open_ is encoded
        for i in range(len(edges) - 1):
            a, b = int(edges[i]), int(edges[i + 1])
            # A seam at the cut itself needs the byte before it, which another document may not share.
            own = seams[inside[i] + (inside[i] < len(seams) and seams[min(inside[i], len(seams) - 1)] == a) : inside[i + 1]] - a
            first, last, tokens = self._chunk(data[a:b], own)
            if first >= 0:
                if a + first > open_:
                    out.append(self._tokens(data[open_ : a + first]))
                out.append(tokens)
                open_ = a + last
        if open_ < len(data):
            out.append(self._tokens(data[open_:]))
        return np.concatenate(out) if out else _NONE

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, specials kept; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_NONE = np.zeros(0, np.uint32)
#: Fixed value: the byte-level pre-tokenizer's pattern.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(vocab: dict[bytes, int], merges: list[bytes]) -> dict[bytes, int]:
    """Single bytes first, then what each merge makes, in the order of merges."""
    ranks = {t: r for r, t in enumerate(sorted(t for t in vocab if len(t) == 1))}
    for made in merges:
        ranks.setdefault(made, len(ranks))
    if set(ranks) != set(vocab):
        raise ValueError("the file's merges and vocabulary don't agree")
    return ranks


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``keep_ids`` also ids.

    ids are little-endian unsigned 32-bit integers; the decoded text is that of
    the ids. ``path`` names a byte-level BPE file of the tokenizers library that
    every executor can open. Defined cases: null text counts as empty and has no
    ids; texts of any length are encoded whole; a null doc_id stays null; repeated
    rows each have their row; an empty table gives an empty result. Other columns
    are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(path or default_vocabulary())
            raw, offsets = buffer_of(batch.column(1))
            for lo in range(0, len(offsets) - 1, 1024):
                hi, rows = min(lo + 1024, len(offsets) - 1), []
                for i in range(lo, hi):
                    ids = coder.encode(raw[offsets[i] : offsets[i + 1]])
                    packed = ids.astype("<u4").tobytes()
                    text = coder.decode(ids)
                    rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), packed))
                columns = [batch.column(0)[lo:hi], *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.binary())[: 3 + keep_ids]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(eased(run), schema)
