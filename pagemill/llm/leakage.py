"""Evaluation passages inside training documents, by a generalised suffix automaton.

The test items are normalised to words (unbroken runs of letters and digits, lower case)
and put into one suffix automaton over word numbers. A document's words are streamed
through it once, which gives at every word the longest run that ends there and occurs in
some item. Runs of at least ``least`` words are leaks; each maximal run is resolved to the
items that share ``least`` words with it. Text with no word, null or empty has no leak.

Every state that stands for runs of ``least`` words holds the items with such a run: each run
of that length belongs to one state only, so all sets together are no larger than the items.

The automaton holds at most 2 states a word of the test set, about BYTES_A_WORD bytes. The test set is a
fixed table, streamed to the driver; a part of it holds at most ``max_bytes`` of automaton (one item at least),
and a larger set is worked off in parts, one pass over the corpus each, whose spans are put
together by document, so that what is covered is the same for any number of parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread

#: Fixed value of the problem: words a leak has at least.
LEAST = 12
#: Bytes of automaton a word of the test set, as measured, and bytes of it in one part.
BYTES_A_WORD, MAX_BYTES = 450, 256 << 20

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of every long run."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST):
        self.least = least
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        numbered = []
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number)) for x in words(text)]
            if len(w) < least:
                continue
            numbered.append((item, w))
            last = 0
            for c in w:
                last = self._extend(last, c)
        # anchor: the state up the suffix links whose runs include those of ``least`` words
        self.anchor = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.length[up] >= least else s if self.length[s] >= least else -1
        self.items: dict[int, set[int]] = {}
        for item, w in numbered:
            for _, _, anchors in self._runs(w):
                for s in anchors:
                    self.items.setdefault(s, set()).add(item)

    def _copy(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, p: int, c: int, q: int, to: int) -> None:
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = to
            p = self.link[p]

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the run is known from another item
            if self.length[q] == self.length[last] + 1:
                return q
            new = self._copy(q, self.length[last] + 1)
            self.link[q] = new
            self._redirect(last, c, q, new)
            return new
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        cur = len(self.next) - 1
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                new = self._copy(q, self.length[p] + 1)
                self.link[q] = self.link[cur] = new
                self._redirect(p, c, q, new)
        return cur

    def _runs(self, c: Iterable[int | None]) -> Iterator[tuple[int, int, list[int]]]:
        """Maximal runs (start, end) of at least ``least`` known words, with the anchors passed."""
        nxt, link, length, least, anchor = self.next, self.link, self.length, self.least, self.anchor
        state = run = i = 0
        passed: list[int] = []
        for i, x in enumerate((*c, None)):
            to = nxt[state].get(x) if x is not None else None
            if to is None:
                if run >= least:
                    yield i - run, i, passed
                    passed = []
                if x is None:
                    state = run = 0
                    continue
                while state >= 0 and x not in nxt[state]:
                    state = link[state]
                if state < 0:
                    state = run = 0
                    continue
                run, to = length[state], nxt[state][x]
            state = to
            run += 1
            if run >= least:
                passed.append(anchor[state])

    def found(self, w: list[str]) -> list[tuple[int, int, set[int]]]:
        """Maximal runs (start, end) of at least ``least`` words that occur in an item, with the items that share ``least`` words with them."""
        get = self.number.get
        return [(a, b, set().union(*(self.items.get(s, ()) for s in passed))) for a, b, passed in self._runs(map(get, w))]

    def spans(self, w: list[str]) -> list[tuple[int, int]]:
        return [(a, b) for a, b, _ in self.found(w)]

    def items_of(self, w: list[str], span: tuple[int, int]) -> set[int]:
        """Items that share a run of ``least`` words with the span."""
        return set().union(*(i for _, _, i in self.found(w[span[0] : span[1]])))


def _parts(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in parts of at most ``max_bytes`` of automaton, one item at least; one empty part where there is none."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    part: list[tuple[int, str | None]] = []
    held = sent = 0
    for item, text in items.toLocalIterator():
        n = BYTES_A_WORD * len(words(text))
        if part and held + n > max_bytes:
            yield part
            sent, part, held = sent + 1, [], 0
        part.append((item, text))
        held += n
    if part or not sent:
        yield part


def _covered(spans: Iterable[tuple[int, int]]) -> int:
    return len(set().union(*(range(a, b) for a, b in spans)))


def _match(least: int, items: list[tuple[int, str | None]]):
    held: list[SuffixAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(SuffixAutomaton(items, least))
        sam = held[0]
        for b in batches:
            out: list[tuple] = []
            for doc, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist()):
                w = words(text)
                found = sam.found(w) if len(w) >= least else []
                per: dict[int, int] = {}
                for start, end, leaked in found:
                    for item in leaked:
                        per[item] = max(per.get(item, 0), end - start)
                spans = [x << 32 | y for x, y, _ in found]
                share = _covered((x, y) for x, y, _ in found) / len(w) if per else 0.0
                out.extend((doc, h, item, per[item], share, spans, len(w)) for item in sorted(per))
            columns = zip(*out) if out else ((),) * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _FOUND.values())], list(_FOUND))

    return run


_FOUND = {"doc_id": pa.int64(), "h": pa.int64(), "item_id": pa.int64(), "longest": pa.int64(), "covered": pa.float64(), "spans": pa.list_(pa.int64()), "words": pa.int64()}
_SCHEMA = "doc_id long, h long, item_id long, longest long, covered double, spans array<long>, words long"


def _found(documents: DataFrame, parts: list[list[tuple[int, str | None]]], least: int) -> DataFrame:
    docs = spread(documents.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull()))
    each = [docs.mapInArrow(_match(least, part), _SCHEMA) for part in parts]
    return reduce(DataFrame.unionByName, each)


def _united(found: DataFrame) -> DataFrame:
    """(h, united): all spans of a text over the parts, in order."""
    return found.groupBy("h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("united"))


def leaks(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id, longest, covered): every document with every test item it leaks.

    longest is the longest leaked run that shares ``least`` words with the item, covered the share of the
    document's words inside leaked runs of any item. A document given twice comes out twice. An item
    id given twice counts once; a null id is kept out.
    """
    parts = list(_parts(benchmark, max_bytes))
    found = _found(documents.where(F.col("doc_id").isNotNull()), parts, least)
    if len(parts) > 1:
        found = checkpoint(found)  # leaking documents only
        # An item has its longest run in its own part; runs of other parts can only be of other items.
        upto = F.aggregate(
            "united",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda x, s: F.struct(
                (x["n"] + F.greatest(F.lit(0).cast("long"), s.bitwiseAND(F.lit(0xFFFFFFFF)) - F.greatest(x["end"], F.shiftright(s, 32)))).alias("n"),
                F.greatest(x["end"], s.bitwiseAND(F.lit(0xFFFFFFFF))).alias("end"),
            ),
        )
        found = found.join(_united(found), "h").withColumn("covered", upto["n"] / F.col("words"))
    return found.select("doc_id", "item_id", "longest", "covered")


def cut(text: str, at: list[tuple[int, int]], spans: list[tuple[int, int]], max_covered: float) -> str | None:
    """The text without the words of the spans and what stands between them; null where they cover more than ``max_covered`` of its words."""
    if _covered(spans) > max_covered * len(at):
        return None
    out, pos = [], 0
    for s, e in spans:
        out.append(text[pos : max(pos, at[s][0])])
        pos = max(pos, at[e - 1][1])
    return "".join(out) + text[pos:]


def _clean(least: int, items: list[tuple[int, str | None]] | None, max_covered: float):
    """Spans from the automaton of the only part, or else from the column ``united``."""
    held: list[SuffixAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if items is not None and not held:
            held.append(SuffixAutomaton(items, least))
        for b in batches:
            texts: list[str | None] = []
            united = b.column("united").to_pylist() if items is None else None
            for k, text in enumerate(b.column("text").to_pylist()):
                spans: list[tuple[int, int]] = []
                at: list[tuple[int, int]] = []
                if text and (united is None or united[k]):
                    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    spans = held[0].spans([text[i:j].lower() for i, j in at]) if united is None else [(s >> 32, s & 0xFFFFFFFF) for s in united[k]]
                texts.append(cut(text, at, spans, max_covered) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, max_covered: float = 0.5, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text): leaked runs cut out; a document covered beyond ``max_covered`` gets null text.

    With several parts the spans of all of them, kept under checkpoint, are joined to the documents by text.
    """
    parts = list(_parts(benchmark, max_bytes))
    if len(parts) == 1:
        return spread(documents.select("doc_id", "text")).mapInArrow(_clean(least, parts[0], max_covered), "doc_id long, text string")
    united = _united(checkpoint(_found(documents, parts, least)))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).join(united, "h", "left")
    return docs.mapInArrow(_clean(least, None, max_covered), "doc_id long, text string")
