"""URL filtering by host and path rules and a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of the default vocabulary and their weights: one strict hit rejects, soft ones count together.
STRICT = {"adult": 1.0, "casino": 1.0, "escort": 1.0, "hentai": 1.0, "porn": 1.0, "sex": 1.0, "viagra": 1.0, "xxx": 1.0}
SOFT = {"bet": 0.5, "betting": 0.5, "bonus": 0.3, "cheap": 0.3, "dating": 0.5, "free": 0.2, "jackpot": 0.5, "loan": 0.4, "nude": 0.6, "pills": 0.5, "poker": 0.5, "slots": 0.5, "torrent": 0.4, "win": 0.3}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_OUT = "host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_distinct long, weight double"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/?#``, then up to ``?#``; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, x in enumerate(rest) if x in "/?#"), len(rest))
    stop = next((i for i in range(end, len(rest)) if rest[i] in "?#"), len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


class Rules:
    """Longest-match lookup of (rule, verdict) pairs, a rule being ``host/path``: a host's suffixes index the rules."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        at = 0
        while host:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], strict: Mapping[str, float] = STRICT, soft: Mapping[str, float] = SOFT, min_soft: int = 2, url_col: str = "url") -> DataFrame:
    """``pages`` without other columns of the names added here, plus host, path, rule, verdict and vocabulary counts.

    One Aho-Corasick automaton counts all terms in one pass over the A-Z
    lower-cased url; a hit counts if no letter a-z or digit touches it. A url is
    blocked on one strict hit or ``min_soft`` different soft terms, unless a rule
    fits, which decides alone (the longest one). weight sums the weights of the
    different terms hit. Defined cases: a null or empty url has empty host and
    path, no hits, and verdict allow; repeated rows are judged alike; an empty
    table gives an empty result.
    """
    strict, soft, listed = dict(strict), dict(soft), list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        lookup, machine = Rules(listed), ahocorasick.Automaton()
        for term in {**soft, **strict}:
            machine.add_word(term, term)
        machine.make_automaton()
        for batch in batches:
            rows = []
            for url in batch.column(batch.num_columns - 1).to_pylist():
                host, path = split_url(url)
                text, hits = (url or "").translate(_LOWER), []
                for last, term in machine.iter(text):
                    first = last - len(term) + 1
                    if (first == 0 or text[first - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                        hits.append(term)
                hard, mild = sum(x in strict for x in hits), [x for x in hits if x not in strict]
                rule = lookup.match(host, path)
                own = "block" if hard or len(set(mild)) >= min_soft else "allow"
                rows.append((host, path, rule and rule[0], rule[1] if rule else own, hard, len(mild), len(set(mild)), float(sum({**soft, **strict}[x] for x in sorted(set(hits))))))
            kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.float64()]
            added = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *names])

    names = [x.split()[0] for x in _OUT.split(", ")]
    kept = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c not in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.withColumn("__url", F.col(url_col).cast("string")).mapInArrow(run, f"{schema}, {_OUT}")


def oracle(rules: Sequence[tuple[str, str]], strict: Mapping[str, float] = STRICT, soft: Mapping[str, float] = SOFT, min_soft: int = 2) -> str:
    """The same as DuckDB SQL over ``pages``: page_id, host, path, rule, verdict, soft_distinct."""

    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}'))"

    longest = sorted(rules, key=lambda r: -len(r[0]))
    picked = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in longest)
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH cut AS (SELECT page_id, {lower} AS u, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages),
    parts AS (SELECT page_id, u, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM cut),
    ruled AS (SELECT *, CASE {picked} END AS rule, {" + ".join(f"CAST({hit(t)} AS BIGINT)" for t in soft if t not in strict)} AS soft_distinct,
      {" OR ".join(hit(t) for t in strict)} AS hard FROM parts)
    SELECT page_id, host, path, rule, CASE {verdicts} WHEN hard OR soft_distinct >= {min_soft} THEN 'block' ELSE 'allow' END AS verdict, soft_distinct FROM ruled
    """
