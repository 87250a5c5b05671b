"""Line deduplication with a segment-partition edit join, in DataFrame operations only.

A line is a sequence of symbols: its words (what single spaces part) if it has
``words_per_edit`` of them, else its characters. The threshold grows with the
shorter line, one edit for each ``words_per_edit`` words or ``chars_per_edit``
characters, up to ``most_edits``; an edit inserts, drops or replaces a symbol. Two
lines of one kind within the threshold t share one of t + 1 even segments of the
shorter one, at nearly the same place. Every distinct line puts its own segments
into an index, under (length, segment number, hash of the segment); it probes the
index of each length from its own down to t less with the few of its stretches
that can match there. Lines that meet are verified once, with a banded bit-parallel
edit distance on their symbols; the table of the lines has the text of those that
allow an edit, so that no document is read again for it.

A line goes if any earlier line is near, so a key that many lines share (a form
letter's half, say) need not bring all pairs together: all its lines meet the
earliest of them, and only those that this leaves without an earlier near line are
dealt again, by all of the line but as many small stretches as there may be edits.
There the same is done once more; lines of up to STRETCHES symbols that agree so
far differ in no more symbols than allowed. What is left then (more than
MANY_MASKED longer lines that agree in all but those stretches, and aren't near the
earliest of them) is compared in pairs. Texts move only for lines and documents
that a bitmap of fixed size names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import marked, named, release, salted_join, stored

#: Lines under one key, of segments and of masks, beyond which only the earliest meets them all, and stretches of a line by edits.
MANY, MANY_MASKED, STRETCHES = 8, 32, {1: 32, 2: 16}
_TRIMMED = "if(startswith(trim(x), '\t') or startswith(trim(x), '\r') or endswith(trim(x), '\t') or endswith(trim(x), '\r'), trim(BOTH ' \t\r' FROM x), trim(x))"


def _ids() -> list[F.Column]:
    """A line's identity: two 64-bit hashes."""
    return [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("check")]


def _even(length: str, i: str, parts: str) -> str:
    """SQL for where the i-th of so many even parts of ``length`` symbols starts, from 0."""
    return f"int(bigint({length}) * ({i}) div ({parts}))"


def _allowed(length: str, most: int, per_word: int, per_char: int) -> str:
    """SQL for the edits that a line of ``length`` symbols allows."""
    return f"least({most}, int(({length}) div if(by_word, {per_word}, {per_char})))"


def _specs(rows: list[tuple], names: str) -> F.Column:
    """An array of structs of integers: one string for the analyzer, a literal after folding."""
    fields = ", ".join(f"{n}: int" for n in names.split())
    return F.from_json(F.lit(json.dumps([dict(zip(names.split(), row, strict=True)) for row in rows])), f"array<struct<{fields}>>")


def segment_specs(most: int) -> list[tuple[int, int, int, int]]:
    """(edits, less, segment, shift): the stretches of a line that can be a segment of a line shorter by ``less``.

    What that line has as segment i may start up to i places (edits spent before
    it) around the segment's start here, and up to edits - i places around it as
    counted from the end. less = shift = 0 are the line's own segments.
    """
    return [(t, less, i, shift) for t in range(1, most + 1) for less in range(t + 1) for i in range(t + 1) for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1)]


def mask_specs(most: int) -> list[tuple[int, int, int, int, int]]:
    """(edits, less, j, k, shift): a line but its stretches j and k, as a line shorter by ``less`` has them.

    With two edits in different stretches the part between these moves by
    ``shift``; edits in one stretch are found where the two are neighbours.
    """
    out = [(1, less, j, j, 0) for less in (0, 1) for j in range(STRETCHES[1])]
    if most > 1:
        two = [(j, k) for j in range(STRETCHES[2]) for k in range(j + 1, STRETCHES[2])]
        out += [(2, less, j, k, shift) for less in (0, 1, 2) for j, k in two for shift in ((0,) if k == j + 1 else (-1, 0, 1)) if k == j + 1 or -1 <= less - shift <= 1]
    return out


def _keyed(lines: DataFrame, specs: F.Column, key: str, allowed) -> DataFrame:
    """(id, key, own): the keys of lines (id, n, by_word and what ``key`` reads) under the specs whose edits the shorter length allows."""
    rows = lines.withColumn("s", F.explode(specs)).where(F.expr(f"s.less < n and s.edits = {allowed('n - s.less')}"))
    return rows.select("id", F.expr(key).alias("key"), F.expr("s.less = 0 and s.shift = 0").alias("own"))


def _segment_key() -> str:
    start, end = (_even("n - s.less", i, "s.edits + 1") for i in ("s.segment", "s.segment + 1"))
    return f"xxhash64(by_word, n - s.less, s.segment, slice(h, {start} + 1 + s.shift, {end} - {start}))"


def _mask_key() -> str:
    parts = f"if(s.edits = 1, {STRETCHES[1]}, {STRETCHES[2]})"
    at = lambda i: _even("n - s.less", i, parts)
    middle = f"slice(h, {at('s.j + 1')} + 1 + s.shift, greatest(0, {at('s.k')} - {at('s.j + 1')}))"
    return f"xxhash64(by_word, n - s.less, s.edits, s.j, s.k, slice(h, 1, {at('s.j')}), {middle}, slice(h, {at('s.k + 1')} + s.less + 1, n - s.less - {at('s.k + 1')}))"


def _banded(a: str, b: str, edits: int) -> str:
    """SQL: edit distance of arrays, exact up to ``edits``; ``a`` has at least ``edits`` symbols and no more than ``b``.

    One word holds the band of 2 * edits + 1 diagonals: at column i, bit k stands
    for row i - edits + k. The cost runs down the band's lower edge to the last
    row, then along that row, whose bit moves down the word column by column.
    """
    width = 2 * edits + 1
    all_, top = (1 << width) - 1, 1 << (width - 1)
    meets = " | ".join(f"if(i - {edits} + {k} >= 0 and get({a}, i - {edits} + {k}) = get({b}, i), {1 << k}L, 0L)" for k in range(width))
    zero = f"named_struct('vp', {all_ & ~((1 << edits) - 1)}L, 'vn', 0L, 'cost', {edits})"
    d0 = f"transform(array({meets}), pm -> ((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {all_}L)[0]"
    h = f"transform(array({d0}), d -> named_struct('d0', d, 'hp', (s.vn | ~(d | s.vp)) & {all_}L, 'hn', d & s.vp))[0]"
    bit = f"shiftleft(1L, {width - 2} - (i - (size({a}) - {edits})))"
    cost = f"s.cost + if(i < size({a}) - {edits}, if((h.d0 & {top}L) = 0, 1, 0), if((h.hp & {bit}) != 0, 1, 0) - if((h.hn & {bit}) != 0, 1, 0))"
    step = f"transform(array({h}), h -> named_struct('vp', (h.hn | ~(shiftright(h.d0, 1) | h.hp)) & {all_}L, 'vn', shiftright(h.d0, 1) & h.hp, 'cost', {cost}))[0]"
    return f"aggregate(sequence(0, size({b}) - 1), {zero}, (s, i) -> {step}, s -> s.cost)"


def verified(pairs: DataFrame, edits: str, most: int) -> DataFrame:
    """The pairs whose symbols sa and sb, sa no longer and of more than ``most``, are within ``edits`` (SQL, 1 to most)."""
    # What one side alone has takes an edit each: a check by sets leaves few pairs to the distance.
    sets = "size(array_except(sa, sb)) <= {0} and size(array_except(sb, sa)) <= {0}"
    near = " ".join(f"when {t} then size(sb) - size(sa) <= {t} and {sets.format(t)} and {_banded('sa', 'sb', t)} <= {t}" for t in range(1, most + 1))
    return pairs.where(F.expr(f"case {edits} {near} else false end"))


class _Join:
    """The near join over ``lines(place, line)`` of one call.

    ``table`` has (place, id, check, by_word, n, line, h), n symbols and their
    hashes h; line and h are null where n allows no edit.
    """

    def __init__(self, lines: DataFrame, most: int, per_word: int, per_char: int) -> None:
        self.most, self.per_word = most, per_word
        self.allowed = lambda n: _allowed(n, most, per_word, per_char)
        # A generator makes a column of what is read more than once, which the optimizer would else compute anew each time.
        rows = lines.select("place", *_ids(), "line", F.expr("inline(array(named_struct('words', transform(split(line, ' '), x -> hash(x)))))"))
        rows = rows.withColumn("by_word", F.expr(f"size(words) >= {per_word}")).withColumn("n", F.expr("if(by_word, size(words), length(line))"))
        some = F.expr(self.allowed("n")) > 0
        h = F.expr("if(by_word, words, transform(split(line, ''), x -> hash(x)))")
        self.table = stored(rows.select("place", "id", "check", "by_word", "n", F.when(some, F.col("line")).alias("line"), F.when(some, h).alias("h")), "lines", "zstd")

    def near(self, pairs: DataFrame) -> DataFrame:
        """(id) of the later line of each pair (ia, ib) that is within the edits; ia is no longer than ib."""
        met = stored(pairs.distinct(), "met")
        ids = met.select("ia").distinct().union(met.select("ib").distinct()).toDF("id")
        own = marked(self.table.select("id", "place", "by_word", "line"), "id", named(ids, "id")).where("__named")
        own = own.groupBy("id").agg(F.min("place").alias("place"), F.first("by_word").alias("by_word"), F.first("line").alias("line"))
        own = stored(own.select("id", "place", "by_word", F.expr("if(by_word, split(line, ' '), split(line, ''))").alias("s")), "symbols")
        a, b = (own.select(F.col("id").alias(f"i{x}"), F.col("place").alias(f"p{x}"), F.col("s").alias(f"s{x}"), F.col("by_word").alias(f"w{x}")) for x in "ab")
        both = salted_join(salted_join(met, a, "ia", "ib"), b, "ib", "ia", met).where("wa = wb").withColumnRenamed("wa", "by_word")
        later = F.when(F.struct("pa", "ia") > F.struct("pb", "ib"), F.col("ia")).otherwise(F.col("ib"))
        out = stored(verified(both, self.allowed("size(sa)"), self.most).select(later.alias("id")).distinct(), "near")
        release(met, own)
        return out

    def meet(self, keyed: DataFrame, many_from: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(pairs, heavy) of a stored table (id, key, own): all pairs under keys of up to ``many_from`` lines, each line with the earliest under heavy ones.

        heavy has the rows of heavy keys but the earliest, which has met all. With
        ``wanted`` (id), only pairs under light keys that hold one of these ids are made.
        """
        own = keyed.where("own").select("id", "key")
        many = stored(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many_from).select("key"), "many")
        heavy = keyed.join(many, "key", "left_semi")
        light = own.join(many, "key", "left_anti").withColumnRenamed("id", "ia").join(keyed.select(F.col("id").alias("ib"), "key", "own"), "key")
        light = light.where("if(own, ia < ib, ia <> ib)").select("ia", "ib")
        if wanted is not None:
            some = wanted.select("id").distinct().withColumn("w", F.lit(True))
            light = light.join(some.withColumnsRenamed({"id": "ia", "w": "wa"}), "ia", "left").join(some.withColumnsRenamed({"id": "ib", "w": "wb"}), "ib", "left").where("wa or wb").select("ia", "ib")
        if many.isEmpty():
            return light, heavy
        heavy = stored(heavy, "heavy")
        places = marked(self.table.select("id", "place"), "id", named(heavy, "id")).where("__named").groupBy("id").agg(F.min("place").alias("place"))
        first = heavy.where("own").join(places, "id").groupBy("key").agg(F.min(F.struct("place", "id")).alias("f")).select("key", F.col("f.id").alias("ia"))
        stars = stored(salted_join(heavy, first, "key", "id").where("ia <> id"), "stars")
        release(heavy)
        return light.unionByName(stars.select("ia", F.col("id").alias("ib"))), stars.select("id", "key", "own")

    def found(self) -> DataFrame:
        """(id) of lines with an earlier near line."""
        specs = segment_specs(self.most)
        names = "edits less segment shift"
        sized, key = self.table.select("id", "by_word", "n", "h").where(F.expr(self.allowed("n")) > 0), _segment_key()
        own = _keyed(sized, _specs([s for s in specs if s[1] == s[3] == 0], names), key, self.allowed)
        own = stored(own.distinct(), "own")
        probes = _keyed(sized, _specs([s for s in specs if s[1] or s[3]], names), key, self.allowed)
        probes = marked(probes, "key", named(own, "key")).where("__named").drop("__named").distinct()
        keyed = stored(own.unionByName(probes), "keys")
        pairs, heavy = self.meet(keyed, MANY)
        near = self.near(pairs)
        parts = [near]
        rest = stored(heavy.join(near, "id", "left_anti"), "rest")
        if not rest.isEmpty():
            around = stored(heavy.join(rest.select("key").distinct(), "key", "left_semi").select("id").distinct(), "around")
            hashed = marked(sized, "id", named(around, "id")).where("__named").drop("__named").dropDuplicates(["id"]).join(around, "id", "left_semi")
            masks = stored(_keyed(hashed, _specs(mask_specs(self.most), "edits less j k shift"), _mask_key(), self.allowed), "masks")
            pairs, heavy = self.meet(masks, MANY_MASKED, rest)
            parts.append(self.near(pairs))
            left = stored(heavy.join(rest.select("id").distinct(), "id", "left_semi").join(parts[1], "id", "left_anti"), "left")
            if not left.isEmpty():
                pairs = heavy.where("own").select(F.col("id").alias("ia"), "key").join(left.select(F.col("id").alias("ib"), "key"), "key").select("ia", "ib")
                pairs = pairs.unionByName(left.where("own").select(F.col("id").alias("ia"), "key").join(heavy.select(F.col("id").alias("ib"), "key"), "key").select("ia", "ib"))
                parts.append(self.near(pairs.where("ia <> ib")))
            release(masks, around, left)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = stored(out.distinct(), "near")
        release(own, keyed, rest, *parts)
        return out


def repeated(docs: DataFrame, most_edits: int = 2, words_per_edit: int = 10, chars_per_edit: int = 24) -> DataFrame:
    """(doc, own, gone, near) for ``docs(doc, own, text)``: places (from 0) of each document's lines that repeat an earlier line.

    A line is its text without spaces, tabs and carriage returns around it; equal
    lines are known by two 64-bit hashes. Blank lines take no part. near counts
    the places whose line repeats no equal one, but a near one.
    """
    trimmed = F.expr(f"transform(split(text, '\n'), x -> {_TRIMMED})")
    lines = docs.select("doc", "own", F.posexplode(trimmed).alias("pos", "line")).select(F.struct("doc", "own", "pos").alias("place"), "line")
    join = _Join(lines.where("line <> ''"), most_edits, words_per_edit, chars_per_edit)
    near = join.found().withColumn("near", F.lit(True))
    known = join.table.groupBy("id", "check").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    info = stored(known.join(near, "id", "left").where("n > 1 or near").select("id", "check", "first", F.coalesce("near", F.lit(False)).alias("near")), "info")
    some = marked(join.table.select("place", "id", "check"), "id", named(info, "id")).where("__named").drop("__named")
    gone = some.join(info, ["id", "check"]).where("near or place > first")
    gone = gone.groupBy("place.doc", "place.own").agg(F.array_sort(F.collect_list("place.pos")).alias("gone"), F.count_if(F.col("place") == F.col("first")).alias("near"))
    gone = stored(gone, "gone")
    release(join.table, info)
    return gone


def dedup_lines(docs: DataFrame, most_edits: int = 2, words_per_edit: int = 10, chars_per_edit: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` freed of lines that repeat, exactly or within the edits that their length allows, an earlier line.

    Adds n_lines, n_removed and n_near (removed lines that are near copies only;
    replaces columns of these names). Lines end at \\n; earlier is by doc_id, then
    by a hash of the text, then by place; a line goes if any earlier line is
    near, whether that stays or not. Defined cases: null text stays null, with 0
    lines; lines too short for an edit go as exact repeats only; rows with equal
    doc_id and text are one document and are treated alike; null doc_ids come
    last; blank lines and line ends of what stays are kept; an empty table gives
    an empty result; texts and lines of any length are treated whole.
    """
    added = ("n_lines", "n_removed", "n_near")
    columns = [c for c in docs.columns if c not in added]
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(*[docs[f"`{c}`"] for c in columns], F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit((1 << 63) - 1)).alias("__doc"))
    base = base.withColumn("__own", F.xxhash64(text))
    gone = repeated(base.select(F.col("__doc").alias("doc"), F.col("__own").alias("own"), text.alias("text")), most_edits, words_per_edit, chars_per_edit)
    split = marked(base, "__doc", named(gone, "doc"))
    hit = split.where("__named").join(gone.withColumnsRenamed({"doc": "__doc", "own": "__own", "gone": "__at", "near": "__near"}), ["__doc", "__own"], "left")
    rest = split.where("not __named").withColumns({"__at": F.lit(None).cast("array<int>"), "__near": F.lit(0).cast("long")})
    out = hit.unionByName(rest).withColumns({"__raw": F.when(F.col("__at").isNotNull(), F.split(text, "\n")), "__gone": F.coalesce("__at", F.expr("cast(array() as array<int>)"))})
    # What stands between the places that go, slice by slice.
    pieces = "transform(sequence(0, size(__gone)), i -> slice(__raw, if(i = 0, 0, __gone[greatest(i - 1, 0)] + 1) + 1, if(i = size(__gone), size(__raw), __gone[least(i, size(__gone) - 1)]) - if(i = 0, 0, __gone[greatest(i - 1, 0)] + 1)))"
    kept = F.when(F.size("__gone") == 0, text).otherwise(F.array_join(F.expr(f"flatten({pieces})"), "\n"))
    size = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    kept = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]
    return out.select(*kept, size.alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"), F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"))
