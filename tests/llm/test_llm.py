import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chroma, context_tree, licenses, line_dedup, mixing, near_dedup, quality, syncmers, textbytes, url_filter
from quillon.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, near string, score string"
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ti") for b in ("ra", "so", "ne", "vi", "pu", "da")]


def made(n=40, seed=3):
    rng = random.Random(seed)
    return [(i, "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(4, 14))) for _ in range(rng.randint(1, 5)))) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, ties and a long text, beside columns with clashing names."""
    base = made()
    rows = [*base, (100, base[0][1]), (101, base[0][1] + " extra"), (102, ""), (103, None), (104, " \n\t "), (105, "é" * 50), (106, "word " * 30000), (None, base[1][1]), (1, base[1][1]), (107, "naïve  text <|endoftext|> 日本 🙂 don't")]
    return spark.createDataFrame([(i, t, "en", None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words():
    texts = ["Hello  World\x0bfoo", "", None, "a", "  x y ", "é ü W\x85x"]
    raw, offsets = textbytes.buffer_of(pa.array(texts))
    low = textbytes.LOWER[raw]
    s, e, bounds = textbytes.spans(low, offsets)
    assert [[bytes(low[s[i] : e[i]]).decode() for i in range(bounds[k], bounds[k + 1])] for k in range(len(texts))] == [words(t) for t in texts]


def test_near_dedup(spark, odd, empty):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd, w=3, percent=85).collect()}
    sets = {}
    for r in odd.where("doc_id is not null").collect():
        w = words(r["text"])
        sets[r["doc_id"]] = frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items() if i is not None} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_context_tree(spark, odd, empty):
    rows = context_tree.score(odd, nodes=500).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (102, 103, 104)} == {1}
    assert context_tree.score(empty).count() == 0


def test_context_tree_keeps_every_context(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst ", k=600)) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts * 2), (90, None), (91, "unseen é")], "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in context_tree.score(df, nodes=1 << 20).collect()}  # more than there are
    assert {r["doc_id"]: r["score"] for r in context_tree.score(df).collect()} == pytest.approx(whole, rel=1e-4)


def test_weights_sum_to_one():
    rng = np.random.default_rng(1)
    counts = np.zeros((3, 256), np.int64)
    counts[1:] = rng.integers(0, 3, (2, 256))
    counts[0] = counts[1:].sum(axis=0) + rng.integers(0, 2, 256)
    table = context_tree.weigh(counts, np.array([0, 0, 0]), np.array([0, 1, 1]), 1)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?y", "http://www.example.com/en/1", "https://x.net/es/#t", "http://casino.org", "http://a.org/bet-free", "http://a.org/casinos", "http://b.org?u=1/poker"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, URL_RULES).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3:] == [("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("casino.org", "", None, "block"), ("a.org", "/bet-free", None, "block"), ("a.org", "/casinos", None, "allow"), ("b.org", "", None, "allow")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    rng, rows = random.Random(edits), []
    for _ in range(150):
        a = "".join(rng.choices("abé ", k=rng.randint(8, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        a, b = sorted((a, "".join(b)), key=len)
        if len(a) > 2:
            rows.append((a, b, list(a), list(b)))
    df = spark.createDataFrame(rows, "a string, b string, sa array<string>, sb array<string>")
    assert sorted((r["a"], r["b"]) for r in line_dedup.verified(df, str(edits), 2).collect()) == sorted((a, b) for a, b, *_ in rows if distance(a, b) <= edits)


def repeated_places(rows, most, per_word=10, per_char=24):
    """(doc, place) of the lines that an earlier line equals or is near to, by comparing all with all."""
    lines = [(d, p, line.strip(" \t\r")) for d, t in rows for p, line in enumerate(t.split("\n"))]
    lines = [(d, p, line, len(line.split(" ")) >= per_word) for d, p, line in lines if line]
    gone = set()
    for d, p, line, by_word in lines:
        for d2, p2, other, kind in lines:
            if (d2, p2) < (d, p) and kind == by_word:
                a, b = (x.split(" ") if by_word else list(x) for x in (line, other))
                most_here = min(most, min(len(a), len(b)) // (per_word if by_word else per_char))
                if line == other or (most_here and abs(len(a) - len(b)) <= most_here and distance(a, b) <= most_here):
                    gone.add((d, p))
                    break
    return gone


@pytest.mark.parametrize("most,many", [(1, 32), (2, 32), (2, 3)])
def test_lines_near_earlier_ones(spark, monkeypatch, most, many):
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "MANY_MASKED", many)
    rng = random.Random(10 * most + many)

    def edited(symbols):
        out = list(symbols)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out))
            out[at : at + rng.randint(0, 1)] = rng.choices(WORDS, k=rng.randint(0, 1))
            out = out or ["x"]
        return out

    base = [rng.choices(WORDS, k=rng.choice([5, 8, 9, 10, 12, 19, 20, 21, 25, 40])) for _ in range(20)]
    rows = [(d, "\n".join(" ".join(edited(rng.choice(base))) if rng.random() < 0.7 else "".join(edited("short line of text, number 1")) for _ in range(4))) for d in range(40)]
    letter = "dear customer number {} your order {} was sent on day {} of this month and will come to you by the {} post in {} days as ever"
    rows += [(d, letter.format(rng.randint(0, 99999), rng.randint(0, 30), rng.randint(1, 28), rng.choice(WORDS), rng.randint(1, 9))) for d in range(40, 110)]
    rows += [(d, f"order {rng.randint(0, 10**6)} for {rng.choice(WORDS)} was {rng.choice(WORDS)} sent today {rng.randint(0, 50)} by us all") for d in range(110, 180)]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("own", F.xxhash64("text"))
    assert {(r["doc"], p) for r in line_dedup.repeated(df, most).collect() for p in r["gone"]} == repeated_places(rows, most)


def test_form_letters_make_few_candidates(spark, monkeypatch):
    made_pairs, near = [], line_dedup._Join.near
    monkeypatch.setattr(line_dedup._Join, "near", lambda self, pairs: made_pairs.append(pairs.distinct().count()) or near(self, pairs))
    for text, gone in (("this is letter number {0} which we send to all of our dear friends in town", 999), ("this is letter number {0} from {1} which we send to all of our dear friends in town", 0)):
        rows = [(i, text.format(i, i * 7919 % 100003)) for i in range(1000)]
        df = spark.createDataFrame(rows, "doc long, text string").withColumn("own", F.xxhash64("text"))
        made_pairs.clear()
        assert line_dedup.repeated(df, 1).count() == gone and sum(made_pairs) <= 1000


def test_lines_are_verified_without_their_documents(spark, monkeypatch):
    made, stored = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: made.append(name) or stored(df, name))
    line = "one two three four five six seven eight nine {} eleven twelve"
    df = spark.createDataFrame([(1, 0, f"{line.format('ten')}\nshort"), (2, 0, f"{line.format('TEN')}\nshort")], "doc long, own long, text string")
    join = line_dedup._Join(df.select(F.struct("doc", "own", F.lit(0).alias("pos")).alias("place"), F.explode(F.split("text", "\n")).alias("line")), 2, 10, 24)
    assert {(r["n"], r["line"] is None, r["h"] is None) for r in join.table.collect()} == {(12, False, False), (5, True, True)}
    assert join.found().count() == 1 and made.count("symbols") == made.count("met") == 1 and "like" not in made


@pytest.mark.parametrize("specs,names", [(line_dedup.segment_specs(2), "edits less segment shift"), (line_dedup.mask_specs(2), "edits less j k shift")])
def test_specs_are_folded(spark, specs, names):
    df = spark.range(1).withColumn("s", F.explode(line_dedup._specs(specs, names)))
    assert [tuple(r) for r in df.select("s.*").collect()] == specs
    assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_line_dedup(spark, odd, empty):
    lines = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilom", "alpha beta gamma delta epsilon zeta eta", "short"]
    df = spark.createDataFrame([(1, f"{lines[0]}\n\n{lines[3]}"), (2, f"{lines[1]}\n{lines[2]}\n{lines[3]}"), (3, f"  {lines[0]}\n\n{lines[2]}\n{lines[2]}"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_near"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (df.first()["text"], 3, 0, 0), 2: (lines[2], 3, 2, 1), 3: ("", 4, 3, 0), 4: (None, 0, 0, 0)}
    clash = odd.withColumns({"gone": F.lit("a"), "bits": F.lit("b"), "own": F.lit("c")})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "n_lines", "n_removed", "n_near"] and out.count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def test_quality(spark, odd, empty):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(WORDS, k=30)) if i % 3 else " ".join(w + "***" for w in rng.choices(WORDS, k=30)) for i in range(600)]
    model = quality.fit(pa.array(texts[:450]), np.array([int(i % 3 > 0) for i in range(450)]))
    scores = model.scores(pa.array([*texts[450:], None]))
    assert ((scores[:-1] >= 0.3) == [i % 3 > 0 for i in range(450, 600)]).mean() > 0.97 and 0 <= scores[-1] <= 1
    assert quality.classify(odd, model).count() == odd.count() and quality.classify(empty, model).count() == 0


def test_mixing(spark, odd, empty):
    assert mixing.targets([("a", 100), ("b", 1), ("c", 50), (None, 0)]) == pytest.approx({"b": 3.0, None: 0.0, "a": 148 * 5 / 6, "c": 148 / 6})
    shares = mixing.split_slots([10, 0, 37], 8, 1)
    assert shares.sum(axis=0).tolist() == [10, 0, 37] and (shares >= 0).all()
    first, again = (sorted(map(str, mixing.mix(odd.repartition(n)).collect())) for n in (1, 3))
    assert first == again and len(first) == odd.count()
    df = spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in made(800)], "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("copies")).alias("c")).collect():
        assert abs(r["t"] - r["g"]) < 0.02 * r["g"] and r["c"] <= 3
    assert mixing.mix(empty).count() == 0


def test_syncmers(spark, odd, empty):
    rows = syncmers.fingerprints(odd).collect()
    assert len(rows) == odd.count() and syncmers.fingerprints(empty).count() == 0
    df = spark.createDataFrame(made(30), "doc_id long, text string")
    texts = dict(made(30))
    for r in syncmers.fingerprints(df).collect():
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 30]
        cut = len(t) // 3
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
    raw = np.frombuffer(texts[3].encode(), np.uint8)
    hashes, at = syncmers.anchors(raw)
    moved, _ = syncmers.anchors(np.concatenate([raw[:0], np.frombuffer(b"zz", np.uint8), raw]))
    assert set(hashes.tolist()) <= set(moved.tolist()) and len(at)


def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    coder = bpe.Coder(bpe.default_vocabulary())
    rng = random.Random(5)
    texts = [r["text"] or "" for r in odd.collect()] + ["".join(rng.choices("ab  \n\t'sé.,1 \u0085-", k=rng.randint(0, 3000))) for _ in range(200)]
    texts += ["".join(rng.choices(["a", " ", "\n", "’", "—", "“x”", "Ж", "д ", "日本", "٣", "½", "\u2003", "\u200b", "🙂", "ï", "ᚠ", "𝔘", "²"], k=rng.randint(0, 900))) for _ in range(100)]
    shared = " ".join(rng.choices(WORDS, k=3000))
    for t in [*texts, shared, "x" + shared, shared + " tail"]:
        ids = coder.encode(np.frombuffer(t.encode(), np.uint8))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and coder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert not coder.differ and coder.reused > 0
    assert bpe.encode(odd).count() == odd.count() and bpe.encode(empty).count() == 0


def test_chroma(spark):
    rng = np.random.default_rng(2)
    notes = rng.normal(0, 0.25, (60, 64))
    rate, rows = 4000, []
    for i, v in enumerate(notes):
        pitch = 110 * 2 ** (np.clip(np.round(24 + 48 * v), 0, 48) / 12)
        rows.append((i * 50, 12000 * np.sin(np.cumsum(np.repeat(2 * np.pi * pitch / rate, 250)))))
    pairs = [(i, x + rng.normal(0, 150, len(x))) for i, x in rows]
    late = [(i + 2, x[512:]) for i, x in rows]
    table = [(i, x.astype("<i2").tobytes()) for i, x in [*rows, *((i + 1, x) for i, x in pairs), *late]] + [(7, None), (8, b""), (None, b"x")]
    df = spark.createDataFrame(table, "id long, audio binary")
    prints = chroma.fingerprints(df, "id", "audio").cache()
    got = {(r["query_id"], r["match_id"]): r for r in chroma.search(prints).collect()}
    assert all((i, i) in got for i, _ in rows)
    held = {r["id"]: np.frombuffer(r["print"], "<u4") for r in prints.where("id is not null").collect()}
    true = [(q, m) for q, _ in rows for m in held if len(held[m]) >= 16 and any(e <= 0.125 and n >= 16 for e, n in (chroma.bit_errors(held[q], held[m], o) for o in range(-4, 5)))]
    rep = {m: min(x for x in held if np.array_equal(held[x], held[m])) for m in held}  # equal prints are one class
    print("recall", sum((rep[q], rep[m]) in got for q, m in true) / len(true))
    assert sum((rep[q], rep[m]) in got for q, m in true) >= 0.9 * len(true) and any(r["frame_offset"] == 2 for r in got.values())


def test_chroma_noisy_bytes(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 32, (20, 40), dtype=np.uint32)
    # One byte of each frame is wrong in 4 bits: a bit error of exactly 0.125 without one whole integer in common.
    wrong = values ^ (np.uint32(0x55) << (8 * rng.integers(0, 4, values.shape)).astype(np.uint32))
    rows = [(50 * i, values[i].tobytes()) for i in range(20)] + [(50 * i + 1, wrong[i].tobytes()) for i in range(20)]
    got = {(r["query_id"], r["match_id"]): (r["hits"], r["bit_error"]) for r in chroma.search(spark.createDataFrame(rows, "id long, print binary")).collect()}
    assert all(got.get((50 * i, 50 * i + 1)) == (32, 0.125) and got.get((50 * i, 50 * i)) == (32, 0.0) for i in range(20))


def test_chroma_spread_errors(spark):
    rng = np.random.default_rng(9)
    values = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (16, 17, 23, 40, 57, 90)]
    # A bit of each byte is wrong: a bit error of exactly 0.125 without one byte in common, at an offset and in prints of several lengths.
    wrong = [np.concatenate([rng.integers(0, 1 << 32, i, dtype=np.uint32), v ^ np.uint32(0x01204002)]) for i, v in enumerate(values)]
    past = [v ^ np.uint32(0x01204003) for v in values]
    rows = [(50 * i + k, x.tobytes()) for k, some in enumerate((values, wrong, past)) for i, x in enumerate(some)]
    got = {(r["query_id"], r["match_id"]): (r["frame_offset"], r["hits"], r["bit_error"]) for r in chroma.search(spark.createDataFrame(rows, "id long, print binary")).collect()}
    assert all(got.get((50 * i, 50 * i + 1)) == (-i, 0, 0.125) and (50 * i, 50 * i + 2) not in got for i in range(6))


def test_chroma_second_refrain(spark):
    rng = np.random.default_rng(7)
    verse, refrain, last = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (30, 80, 60))
    song = np.concatenate([verse, refrain, rng.integers(0, 1 << 32, 90, dtype=np.uint32), refrain, last])
    clip = np.concatenate([refrain, last])
    df = spark.createDataFrame([(0, clip.tobytes()), (1, song.tobytes())], "id long, print binary")
    got = {r["match_id"]: (r["frame_offset"], r["hits"]) for r in chroma.search(df).collect()}
    assert got == {0: (0, 132), 1: (-200, 132)}


