import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chroma, components, context_tree, licenses, line_dedup, mixing, near_dedup, quality, shared, syncmers, textbytes
from quillon.llm.queries import op8_source_mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ti") for b in ("ra", "so", "ne", "vi", "pu", "da")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with copies, near copies, nulls, blanks, repeats and a column whose name an operator might use."""
    rng = random.Random(8)
    texts = ["\n".join(prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    texts += texts[:10] + [t + " extra" for t in texts[10:20]] + [None, "", " \n ", "word " * 5000]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[3], "en", "s1", 1), rows[4]], SCHEMA)


# License scans


@pytest.mark.parametrize(
    "text,names",
    [
        ("Not released under the MIT License.", []),
        ("It is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
        ("Creative Commons Attribution-NonCommercial 4.0 International", ["CC-BY-NC-4.0"]),
        ("Copyright (c) 2020 Jane Doe\nReleased under the MIT License.", ["MIT"]),
        ("Copyright 2020 Foo. Licensed under the Apache License, version 2.0.", ["Apache-2.0"]),
        ("The text that we print here, released under the MIT License, was written by many people " * 3, ["MIT"]),
        ("a license to dream of warm seas", []),
        ("Licensed under CC BY-SA 4.0, the code is released under the MIT License", ["CC-BY-SA-4.0", "MIT"]),
        ("Released under the BSD License.", []),
        (None, []),
        ("", []),
    ],
)
def test_license_sentences(spark, text, names):
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, licenses string")
    assert licenses.scan(df).first()["licenses"] == names


def wrapped(text, width):
    out, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*out, line])


def test_every_template_wrapped_and_surrounded():
    rng, cue = random.Random(1), re.compile(licenses.CUES)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.2, 0.2)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for shape in (text, wrapped(text, 60), wrapped(text, 80), wrapped(text.lower(), 72)):
                whole = f"{prose(rng, 40)}\n{prose(rng, 12)}\n{shape}\n{prose(rng, 20)}"
                found = {row[0] for _, _, block in licenses.blocks(whole, cue) for row in scanner.judge(block) if row[4]}
                assert found == {name}, (name, shape, found)


def test_alignment_against_all_windows():
    rng = np.random.default_rng(3)
    for _ in range(60):
        template, block = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 14))

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, last = [i, *row[1:]], row
                for j, y in enumerate(b, 1):
                    row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            return row[-1]

        best = min(distance(template, block[i:j]) for i in range(len(block) + 1) for j in range(i, len(block) + 1))
        got = list(licenses.aligned(template, block, len(template) - 1))
        if best < len(template):
            start, end, missing, added = got[0]
            assert distance(template, block[start:end]) == best == max(len(missing), len(added)) or best <= len(missing) + len(added)
        assert all(not (a[0] < b[1] and b[0] < a[1]) for i, a in enumerate(got) for b in got[:i])


# Context trees


def plain_tree(texts, learnt, depth):
    """log10 probability of each text under a recursive context tree, decision by decision."""
    counts = {}

    def bits(text):
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b"\0"
        for i, byte in enumerate(data):
            context = (bytes(depth) + data[:i])[::-1][:depth]
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield node, context, bit
                node = node * 2 + bit

    for text, learns in zip(texts, learnt, strict=True):
        for node, context, bit in bits(text) if learns else ():
            for d in range(depth + 1):
                counts.setdefault((node, context[:d]), [0, 0])[bit] += 1
    children = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[:-1]), []).append((node, context))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def weighed(key):
        if key not in known:
            own = kt(*counts.get(key, (0, 0)))
            if len(key[1]) == depth:
                known[key] = own, 1.0
            else:
                below = sum(weighed(c)[0] for c in children.get(key, ()))
                whole = np.logaddexp(own, below) - math.log(2)
                known[key] = whole, math.exp(own - math.log(2) - whole)
        return known[key]

    def chance(node, context, d):
        a, b = counts.get((node, context[:d]), (0, 0))
        own, stop = (b + 0.5) / (a + b + 1), weighed((node, context[:d]))[1]
        return own if d == depth else stop * own + (1 - stop) * chance(node, context, d + 1)

    out = []
    for text in texts:
        total = 0.0
        for node, context, bit in bits(text):
            p = chance(node, context, 0)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("fan", [64, 2])
def test_context_tree_against_recursion(spark, monkeypatch, fan):
    monkeypatch.setattr(context_tree, "FAN", fan)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcAB é\n", k=rng.randint(0, 60))) for _ in range(40)]
    learnt = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.score(df, depth=3).collect()}
    assert [got[i]["score"] for i in range(40)] == pytest.approx(plain_tree(texts, learnt, 3), rel=1e-4)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for t in texts]
    counts = {}
    for own, learns in zip(tokens, learnt, strict=True):
        for w in own if learns else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, own in enumerate(tokens):
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(w in counts for w in own), n)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_runs_are_found_block_by_block(monkeypatch, block):
    monkeypatch.setattr(context_tree, "BLOCK", block)
    texts = ["abcabcab", "", "B\xe9 abcabc", "zz"]
    for depth in (2, 5):
        own = []
        for t in texts:
            line = bytes(depth) + t.lower().encode() + b"\0"
            own.append([int.from_bytes(line[i - depth : i][::-1] + line[i : i + 1], "big") for i in range(depth, len(line))])
        runs = context_tree.distinct_runs(pa.array(texts), depth)
        assert runs.tolist() == sorted({r for o in own for r in o})
        costs = {r: -1 / (2 + i) for i, r in enumerate(runs.tolist())}
        got = context_tree.run_scores(pa.array(texts), runs, np.array(list(costs.values())), depth)
        assert got.tolist() == pytest.approx([sum(costs[r] for r in o) for o in own])


# Quality classifier


def test_train(spark, corpus):
    rng = random.Random(4)
    good = [(i, prose(rng, 40)) for i in range(300)]
    bad = [(i, " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=40))) for i in range(300, 500)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (None, "x"), (0, "again")], "doc_id long, text string")
    marks = spark.createDataFrame([*((i, int(i < 300)) for i in range(500)), (None, 1), (3, None), (500, 0)], "doc_id long, quality int")
    out = quality.classify(docs.withColumns({"score": F.lit("x"), "bias": F.lit(1)}), quality.train(docs, marks))
    rows = [r for r in out.collect() if r["doc_id"] is not None and r["doc_id"] < 500 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] < 300) for r in rows]) > 0.95 and out.columns[-2:] == ["held_out", "predicted"] or "predicted" in out.columns
    # A text too long for the sample's bound is left out, the others stay.
    model = quality.train(docs, marks, sample_chars=40_000)
    assert np.isfinite(model.scores(pa.array(["a", None]))).all()
    for some in (marks.where("false"), marks.where("quality = 7")):
        assert {r["score"] for r in quality.classify(docs, quality.train(docs, some)).collect()} == {0.5}
    none = spark.createDataFrame([], docs.schema)
    assert quality.classify(none, quality.train(none, marks)).count() == 0
    one = {r["score"] for r in quality.classify(docs, quality.train(docs, marks.where("quality = 1"))).collect()}
    assert len(one) == 1 and next(iter(one)) > 0.9


def test_corpus_context_is_that_of_all_texts(spark):
    texts = [prose(random.Random(i), 30) for i in range(50)]
    whole = quality._gathered([pa.array(texts)], 5)
    spread = quality.corpus_context(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    for (a, n), (b, m) in zip(whole, spread, strict=True):
        assert (a == b).all() and (n == m).all()


# Near-dedup


def plain_components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("w,percent,k", [(3, 85, 64), (5, 80, 64), (3, 85, 8), (2, 60, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, w, percent, k):
    monkeypatch.setattr(shared, "LEAST", 5)  # every key with more than five rows is dealt to several tasks
    rng = random.Random(w * percent + k)
    base = [rng.choices(WORDS, k=rng.choice([2, 6, 20, 60, 200])) for _ in range(12)]

    def edited(words):
        out = list(words)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            at = rng.randrange(len(out))
            out[at : at + rng.randint(0, 1)] = rng.choices(WORDS, k=rng.randint(0, 1))
            out = out or ["x"]
        return " ".join(out)

    texts = [edited(rng.choice(base)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sketch string")
    sets = {}
    for i, t in enumerate(texts):
        words = t.split()
        sets[i] = frozenset(tuple(words[j : j + w]) for j in range(len(words) - w + 1)) if len(words) >= w else frozenset([tuple(words)] if words else [])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, w=w, percent=percent, k=k).collect()}
    want = plain_components(sets, percent)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(6)
    a, b = prose(rng, 30), prose(rng, 30)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, None), (None, a)], "doc_id long, text string")
    first, again = (sorted(map(str, near_dedup.near_duplicates(df.repartition(n), w=3, percent=85).collect())) for n in (1, 4))
    assert first == again and len(first) == 6


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for x in links for i in x}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: c for i, c in got.items()} == {i: c for i, c in root.items() if i in got} and all(i in got or root[i] == i for i in root)


# Mixing


def test_shards_follow_from_the_tree(spark, corpus):
    plan = mixing.Mix(corpus, (5, 2, 1), 8, 11)
    rows = mixing.mix(corpus, shards=8).collect()
    held = {}
    for r in rows:
        assert r["copies"] <= 3 and len(r["shards"]) == r["copies"] and all(0 <= s < 8 for s in r["shards"])
    for r in plan.ends.collect():
        held[r["__key"]] = r["__ends"]
    blocks = {}
    for r in plan.decide(plan.sizes).collect():
        for copy, s in enumerate(r["__shards"]):
            blocks.setdefault((r["source"], s), set()).add((copy, r["__block"]))
    for source, ends in held.items():
        for s in range(8):
            assert len(blocks.get((source, s), ())) <= ends[s] - (ends[s - 1] if s else 0)
    assert sum(r["taken"] for r in rows) > 0


def test_mixed_is_what_mix_decides(spark, corpus):
    named = corpus.withColumns({"blocks": F.lit("a"), "key": F.lit(2), "copies": F.lit(None).cast("string")})
    out = mixing.mixed(named)
    assert out.columns == named.columns
    taken = {}
    for r in out.collect():
        taken[r["doc_id"], r["source"]] = taken.get((r["doc_id"], r["source"]), 0) + 1
    want = {}
    for r in mixing.mix(corpus).collect():
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["copies"]
    assert taken == {k: v for k, v in want.items() if v}
    assert mixing.mixed(corpus.limit(0)).count() == 0


def test_op8_gives_the_shards(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_source_mixing(spark, str(tmp_path)).collect()
    assert all(len(r["shards"].split(",")) == r["copies"] if r["copies"] else r["shards"] == "" for r in rows) and len(rows) == corpus.count()


# Fingerprints


def plain_anchors(data):
    """(anchor bytes, place): windows whose least inner hash stands at an edge, one by one."""
    inner = syncmers.mix(np.array([int.from_bytes(data[i : i + syncmers.S], "little") for i in range(len(data) - syncmers.S + 1)], np.uint64))
    width = syncmers.K - syncmers.S + 1
    return [(bytes(data[i : i + syncmers.K]), i) for i in range(len(data) - syncmers.K + 1) if inner[i : i + width].min() in (inner[i], inner[i + width - 1])]


def test_anchors_one_by_one():
    rng = random.Random(9)
    for text in [prose(rng, 80), "a" * 100, "naïve 日本 " * 20, prose(rng, 7)]:
        data = text.encode()
        hashes, at = syncmers.anchors(np.frombuffer(data, np.uint8))
        want = plain_anchors(data)
        assert at.tolist() == [i for _, i in want] and max(np.diff(at, prepend=0), default=0) < 256
        by_bytes = {}
        for (window, _), h in zip(want, hashes.tolist(), strict=True):
            assert by_bytes.setdefault(window, h) == h
    assert syncmers.likeness(syncmers.anchors(np.frombuffer(b"abc", np.uint8)), syncmers.anchors(np.frombuffer(b"abc", np.uint8))) == 1.0


def test_shared_passage_leaves_common_anchors():
    rng = random.Random(3)
    passage = prose(rng, 50)
    a, b = (syncmers.anchors(np.frombuffer(f"{prose(rng, n)} {passage} {prose(rng, n)}".encode(), np.uint8)) for n in (2000, 300))
    assert len(set(a[0].tolist()) & set(b[0].tolist())) >= 8


def test_likeness_counts_all_places():
    rng = random.Random(4)
    one, two = prose(rng, 60), prose(rng, 60)
    a = syncmers.anchors(np.frombuffer(f"{one} {two} {one}".encode(), np.uint8))
    assert syncmers.likeness(a, a) == 1.0
    cut = syncmers.anchors(np.frombuffer(f"{one} {two}".encode(), np.uint8))
    assert 0.5 < syncmers.likeness(a, cut) < 0.8


@pytest.mark.parametrize("part_bytes", [1 << 26, 300])
def test_fingerprints_in_order(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(syncmers, "PART_BYTES", part_bytes)
    rng = random.Random(7)
    rows = [(rng.randrange(30), prose(rng, rng.randint(0, 30))) for _ in range(60)] + [(None, "nobody's text"), (None, "another one"), (5, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    ordered = [r["text"] or "" for r in df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    want = []
    for text, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, follow = (syncmers.anchors(np.frombuffer(x.encode(), np.uint8)) for x in (text, edited, after))
        want.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.text_of(own), syncmers.text_of(changed), syncmers.likeness(own, changed), syncmers.likeness(own, follow)))
    got = [tuple(r)[1:] for r in syncmers.fingerprints(df).collect()]
    assert sorted(got) == sorted(want)
    assert syncmers.fingerprints(df.where("doc_id is null")).count() == 2 and syncmers.fingerprints(df.limit(1)).count() == 1


# Audio


def test_silence_makes_no_key(spark):
    rng = np.random.default_rng(5)
    sound = (9000 * np.sin(np.cumsum(np.repeat(2 * np.pi * 110 * 2 ** (rng.integers(0, 40, 40) / 12) / 4000, 250)))).astype("<i2")
    quiet = np.zeros(20000, "<i2")
    rows = [(0, quiet.tobytes()), (1, quiet[:15000].tobytes()), (50, np.concatenate([quiet, sound]).tobytes()), (51, np.concatenate([quiet[:4096], sound]).tobytes()), (2, b""), (3, None), (None, sound.tobytes()), (51, np.concatenate([quiet[:4096], sound]).tobytes())]
    prints = chroma.fingerprints(spark.createDataFrame([(i, x, 1) for i, x in rows], "id long, audio binary, hits int"), "id", "audio")
    values = {r["id"]: np.frombuffer(r["print"], "<u4") for r in prints.where("id is not null").collect()}
    assert set(values[0].tolist()) == {chroma.silent()}
    got = {(r["query_id"], r["match_id"]): r["match_copies"] for r in chroma.search(prints).collect()}
    assert got[50, 50] == 1 and (50, 51) in got and got[50, 51] == 2 and (0, 1) not in got
    assert chroma.search(prints.limit(0)).count() == 0


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)


def test_driver_gives_memory_back(spark, monkeypatch):
    done = []
    monkeypatch.setattr(shared, "collect", lambda s: done.append(s))
    for _ in range(2 * shared.COLLECT):
        shared.release(shared.stored(spark.range(1), "small"))
    assert done == [spark, spark]
    monkeypatch.undo()
    shared.collect(spark)


def test_workers_give_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(textbytes, "give_back", lambda: done.append(True))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    for i, _ in enumerate(textbytes.eased(lambda held: held)(iter(batches))):
        assert i < 3 and not done
    assert done == [True]
    monkeypatch.undo()
    textbytes.give_back()


def test_bitmaps_name_without_sorting(spark):
    ids = spark.createDataFrame([(i * 977 - 40000,) for i in range(300)], "id long")
    bits = shared.named(ids, "id")
    assert "SortAggregate" not in bits._jdf.queryExecution().executedPlan().toString()
    rows = shared.marked(spark.range(-50000, 250000, 7).unionByName(ids), "id", bits).groupBy("__named").agg(F.collect_set("id").alias("ids")).collect()
    seen = {r["__named"]: set(r["ids"]) for r in rows}
    assert {r["id"] for r in ids.collect()} <= seen[True] and len(seen[True]) < 400 and len(seen[False]) > 40000


def test_lines_go_before_the_texts_are_made(spark):
    docs = spark.createDataFrame([(1, "one two\nthree four"), (2, "one two\n\nfive"), (3, None), (4, "")], "doc_id long, text string")
    before = set(shared._made)
    out = line_dedup.dedup_lines(docs)
    assert [x.rsplit("/", 1)[1].split("-")[1] for x in set(shared._made) - before if "-lines-" in x or "-info-" in x] == []
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got == {1: ("one two\nthree four", 2, 0), 2: ("\nfive", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0)}


# Pipeline


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    corpus.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages(spark, corpus, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, corpus, folder).collect()
    held = {}
    for r in corpus.collect():
        held.setdefault(r["doc_id"], r)
    if at < 4:
        assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for r in out)
    if at == 0:
        scores = quality.classify(corpus, quality.train(corpus, spark.read.parquet(f"{folder}/labels.parquet")))
        assert sorted(str(tuple(r)) for r in out) == sorted(str(tuple(r)) for r in scores.where("predicted = 1").select(*corpus_pipeline.COLUMNS).collect())
    if at == 1:
        lines = {}
        for r in sorted((r for r in corpus.collect() if r["text"]), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
            for line in r["text"].split("\n"):
                if line.strip():
                    lines.setdefault(line.strip(" \t\r"), r["doc_id"])
        kept = {r["doc_id"]: r for r in out}
        assert all(r["n_chars"] == len(r["text"] or "") for r in out) and not set(range(120, 130)) & set(kept)
        assert all(lines[line.strip(" \t\r")] == r["doc_id"] for r in out if r["text"] for line in r["text"].split("\n") if line.strip())
    if at == 2:
        sets = {}
        for i, r in held.items():
            words = (r["text"] or "").split()
            if i is not None:
                sets[i] = frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])
        roots = plain_components(sets, 80)
        assert {r["doc_id"] for r in out} == {i for i, root in roots.items() if i == root} | {None}
    if at == 3:
        taken = sum(r["copies"] for r in mixing.mix(corpus).collect())
        assert len(out) == taken
    if at == 4:
        assert all(r["decoded_sha256"] == hashlib.sha256((held[r["doc_id"]]["text"] or "").encode()).hexdigest() for r in out if r["doc_id"] is not None) and len(out) == corpus.count()
    assert stage(spark, corpus.limit(0), folder).count() == 0, name


def test_pipeline_runs(spark, corpus, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(out.columns)
