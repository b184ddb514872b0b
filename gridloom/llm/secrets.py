"""Secret scans by one combined deterministic automaton.

All rules are compiled by subset construction and minimised into one table of transitions; each text's bytes are read once, and the
automaton tells at each byte which rules have a match that ends there. Every rule ends in a run of characters of one class, or in one place,
so a match's end is the end of a run of such bytes, and the run's length the number of those characters. The match's beginning is found
backwards from there, by the automaton of its rule reversed. A key word may stand inside an earlier match and begin a run that the next
match only ends, so the value of an assignment is measured from the match that is reported, by the automaton of the rule's head. Spans are leftmost and not overlapping within a kind, in code points.

Nulls: a null text is empty and has no span; a null doc_id is kept. Very long texts are scanned whole, in pieces abreast. Repeated rows each
get their result. An empty table gives an empty result. Other columns pass by unread in `find`, and are kept by `redact`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.automaton import Anchored, Automaton, compile_rules, scan
from gridloom.llm.shared import map_rows, map_texts

#: The kinds, in order; the rule of each, on bytes; the characters that the last run of a match must have; whether a match
#: with fewer still takes its place, so that no other of the kind begins in it. (A run of hex begins at the match's sixth character: 24 in all.)
ASSIGNED = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
KINDS = ("assign", "access", "hex", "pem", "github", "slack", "jwt", "live_key")
BASE = 3
RULES = (
    ASSIGNED + r"[A-Za-z0-9+/_.=\-]+",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]{6,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9]+",
    r"xox[abprs]-[A-Za-z0-9\-]+",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"[sr]k_live_[A-Za-z0-9]+",
)
LEAST = (6, 16, 19, 1, 36, 10, 1, 16)
TAKES = (True, False, False, False, False, False, False, False)
#: By kind: what comes before the last run in the rule, where the run must be measured from the match.
HEADS = {0: ASSIGNED}


@lru_cache(1)
def automaton() -> Automaton:
    return compile_rules(list(RULES))


@lru_cache(1)
def _backwards() -> list[Anchored]:
    return [Anchored(rule, backwards=True) for rule in RULES]


@lru_cache(1)
def _heads() -> dict[int, Anchored]:
    return {k: Anchored(head) for k, head in HEADS.items()}


def spans_of(auto: Automaton, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's spans, sorted."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    hits = scan(auto, data)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, back in enumerate(_backwards()):
        head = _heads().get(k)
        first, end = hits.runs(k)
        if not TAKES[k]:
            long = end - first >= LEAST[k]
            first, end = first[long], end[long]
        owner = np.searchsorted(hits.edge, first, side="right") - 1
        last, floor = -1, 0
        for i, a, b in zip(owner.tolist(), (first - hits.edge[owner]).tolist(), (end - hits.edge[owner]).tolist()):
            floor = floor if i == last else 0
            last = i
            start = back.first(data[i], b, floor)
            if start >= 0:
                floor = b
                if b - (head.last(data[i], start, b) if head else a) >= LEAST[k]:
                    out[i].append((start, k, b))
    for i, own in enumerate(out):
        if own and len(data[i]) != len(texts[i]):  # bytes to code points
            points = np.cumsum((np.frombuffer(data[i], np.uint8) & 0xC0) != 0x80)
            own = [(int(points[s]) - 1, k, int(points[e - 1])) for s, k, e in own]
        out[i] = sorted(own)
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of structs (kind, start, end) by start, then kind."""
    auto = automaton()

    def run(rows: dict[str, list]) -> dict[str, object]:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in spans_of(auto, rows["text"])]
        return {"doc_id": rows["doc_id"], "spans": found}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, spans array<struct<kind:string,start:long,end:long>>", run)


def digest(docs: DataFrame) -> DataFrame:
    """find() as one row per document of counts, the sha256 of the base kinds' spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = [number(k) for k in KINDS[:BASE]]
    return find(docs).select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span of a text replaced by the mark; overlapping spans are one. A null text stays null; all columns and rows stay."""
    auto = automaton()

    def run(texts: list[str | None]) -> list[str | None]:
        out = list(texts)
        for i, own in enumerate(spans_of(auto, texts)):
            if not own:
                continue
            text, parts, at = texts[i], [], 0
            for s, _, e in own:
                if e <= at:
                    continue
                if s >= at and (s > at or not parts):
                    parts += [text[at:s], mark]
                elif not parts or s > at:
                    parts.append(mark)
                at = e
            out[i] = "".join([*parts, text[at:]])
        return out

    return map_texts(docs, run, replace=True)
