"""Sentence boundaries in any language and script, by a maximum-entropy classifier.

A line break always ends a sentence. Within a line every run of end marks, and in
scripts written without end marks every space before a letter of the script, is a
candidate. A candidate is classified by a maximum-entropy model over its neighbouring
tokens, their case, length, digits and script. How the tokens of a corpus stand at line
ends and line starts, where boundaries are certain, gives both the training labels and
two features (how often a token ends, how often it starts a line); those counts are taken over all
documents, the model is fitted on about ``sample`` of them, chosen by hash among those of at most
LONGEST_SAMPLE characters.

The model's weights are drawn towards a prior, by which a mark ends a sentence unless a small letter
follows; the fewer examples a corpus has, the more the prior counts. Tokens seen fewer than FEW times
tell nothing and are not kept; of all others a digest and a class of two bits are kept in sorted arrays, 9 bytes a
token, sent to every task once. Where a side has more than MOST_TOKENS (36 MB) the most frequent are sent, and the classes of all others
are joined to the documents that have them: the result is the same. Empty, blank and null texts have no sentence; a document given twice is split twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from .sampling import sample as sampled

#: Occurrences below which a token tells nothing, and tokens of a side that are sent to every task.
FEW, MOST_TOKENS = 4, 4_000_000
#: Examples that the prior weighs as much as.
PRIOR = 8.0
#: Characters of a document that the model is fitted on; longer ones are split like all others.
LONGEST_SAMPLE = 20_000
#: Marks that can end a sentence, and what may close after them.
END = ".!?…。！？｡।॥؟۔։።"
CLOSE = "\"'”’»›)]}」』）】》〉］｝"
OPEN = "\"'“‘„«‹([{「『（【《〈［｛¿¡"
_SPACELESS = "฀-໿ក-៿"
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"

_LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_LIST = re.compile(r"\s*(?:[-*+•·‣–—]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
_MARKS = re.escape(END)
# A single full stop before a small ASCII letter or digit stands inside a name or number.
_CANDIDATE = re.compile(rf"(?:\.\.|\.(?![a-z0-9_])|[{re.escape(END[1:])}])[{_MARKS}]*|(?<=\S)[^\S\n\r]+(?=[{_SPACELESS}])")
_NEXT = re.compile(rf"[{_CJK}]{{1,2}}|[{_SPACELESS}]{{1,5}}|\d+|[^\W\d]+(?:[._-]\w+)*|\S")
_STRIP = "\"'“‘„«‹([{「『（【《〈［｛¿¡”’»›)]}」』）】》〉］｝"


class Candidate:
    """A possible end within a line: where the sentence would end and the next one begin."""

    __slots__ = ("end", "start", "prev", "next", "mark", "closer")

    def __init__(self, end: int, start: int, prev: str, nxt: str, mark: str, closer: str):
        self.end, self.start, self.prev, self.next, self.mark, self.closer = end, start, prev, nxt, mark, closer


def _kind(token: str) -> str:
    """A token type; numbers only by their length."""
    if token.isdigit():
        return f"#{min(len(token), 5)}"
    return token


def _close(line: str, i: int, begun: int) -> int:
    """End of the closing quotes and brackets that follow position i."""
    n = len(line)
    if i + 1 < n and line[i] == " " and line[i + 1] not in "»›":
        return i
    while i < n:
        c = line[i]
        if c in CLOSE:
            i += 1
        elif c == "“" and line.rfind("„", begun, i) > line.rfind("“", begun, i):
            i += 1  # low opening quotes close with this one
        elif c.isspace() and i + 1 < n and line[i + 1] in "»›" and "«" in line[begun:i]:
            i += 2
        else:
            break
    return i


def _next_token(line: str, i: int) -> str:
    n = len(line)
    while i < n and (line[i].isspace() or line[i] in OPEN):
        i += 1
    m = _NEXT.match(line, i)
    return m[0] if m else ""


_IS_CJK, _IS_SPACELESS = re.compile(f"[{_CJK}]"), re.compile(f"[{_SPACELESS}]")


def _script(c: str) -> int:
    """0 white space, 1 and 2 the scripts written without spaces, 3 any other."""
    return 0 if c.isspace() else 1 if _IS_CJK.match(c) else 2 if _IS_SPACELESS.match(c) else 3


def _prev_token(line: str, i: int) -> str:
    """The word before position i, or in scripts written without spaces its last 2 or 5 characters."""
    begin = line.rfind(" ", 0, i) + 1
    token = line[begin:i]
    if token and not token.isascii():
        kind = _script(line[i - 1])
        j, most = i, (0, 2, 5, i)[kind]
        while j > begin and i - j < most and _script(line[j - 1]) == kind:
            j -= 1
        token = line[j:i]
    return token.strip(_STRIP).rstrip(END)


def candidates(line: str) -> tuple[list[Candidate], Candidate | None]:
    """Candidates within a stripped line, and the certain boundary at its end."""
    listed = _LIST.match(line)
    first = listed.end() if listed else 0
    found: list[Candidate] = []
    last = None
    begun = 0
    n = len(line)
    for m in _CANDIDATE.finditer(line, first):
        i, j = m.span()
        if line[i].isspace():
            found.append(Candidate(i, j, _prev_token(line, i), _next_token(line, j), " ", ""))
            continue
        end = _close(line, j, begun)
        while end < n and line[end] in END:  # a mark after the closing quote
            end = _close(line, end + 1, begun)
        mark = line[i] if j - i == 1 or line[i] != "." else ".."
        closer = "" if end == j else ("b" if line[end - 1] in ")]}）】" else "q")
        if end >= n:
            last = Candidate(n, n, _prev_token(line, i), "", mark, closer)
            break
        nxt = line[end]
        start = end
        while start < n and line[start].isspace():
            start += 1
        if mark in ".…" or mark in "..!?":
            if start == end and not (nxt.isupper() or nxt in "“‘„«‹([¿¡「（" or _is_caseless(nxt)):
                continue
            if mark == "." and start == end and end == j and i > 0 and line[i - 1].isdigit() and nxt.isdigit():
                continue
        if nxt in ",;:-–" or (start < n and line[start] in ",;:"):
            continue
        found.append(Candidate(end, start, _prev_token(line, i), _next_token(line, end), mark, closer))
    return found, last


def _is_caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


def _case(token: str) -> str:
    if not token:
        return "-"
    c = token[0]
    if c.isdigit():
        return "d"
    if c.isalpha():
        return "U" if c.isupper() else "l" if c.islower() else "o"
    return "x"


def _digest(token: str) -> int:
    """What Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Tokens:
    """How tokens stand at a side: their digests in order and the class of each; unknown ones are '?'. ``more`` has those of the document at hand that were not sent.

    0 and ~: never at a line's end (or start), in 12 occurrences or more and in fewer; 1, 2 and 3: in less than 1 %, 8 % and in more of them.
    """

    def __init__(self, found: pa.Table):
        digests, classes = (found.column(c).to_numpy() for c in ("digest", "class"))
        order = np.argsort(digests)
        self.digests, self.classes = digests[order], classes[order].astype(np.uint8)
        self.more: dict[int, int] = {}
        self.cache: dict[str, str] = {}

    def held(self, digest: int) -> int | None:
        i = int(np.searchsorted(self.digests, digest))
        return int(self.classes[i]) if i < len(self.digests) and self.digests[i] == digest else None

    def __call__(self, token: str) -> str:
        got = self.cache.get(token)
        if got is None:
            d = _digest(token)
            found = self.held(d)
            if found is None:
                found = self.more.get(d)  # the same in every document that has the token
            got = "?" if found is None else chr(found)
            if len(self.cache) < 200_000:
                self.cache[token] = got
        return got


def features(c: Candidate, ends: Tokens, starts: Tokens) -> tuple[str, ...]:
    e, s = ends(_kind(c.prev)), starts(_kind(c.next))
    case = _case(c.next)
    if c.closer == "q" and case == "U":
        s = "?"  # a capital after a closed quotation stands for itself
    p = c.prev
    shape = ("1" if len(p) == 1 else "s" if len(p) <= 3 else "w") + ("d" if p.isdigit() else "U" if p[:1].isupper() else "l") + ("." if "." in p else "")
    ident = "i" if "_" in c.next or "." in c.next else ""
    return (c.mark, c.mark + case, c.mark + c.closer, "c" + c.closer + case, "e" + e, "s" + s, "es" + e + s, "p" + shape, "pe" + shape + e, "n" + case + ident + s, "m" + c.mark + e, "M" + c.mark + s)


class MaxEnt:
    """Binary maximum-entropy model over indicator features with a Gaussian prior, fitted by batch gradient."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights
        self.cache: dict[tuple[str, ...], bool] = {}

    @classmethod
    def fit(cls, rows: list[tuple[tuple[str, ...], int]], rounds: int = 200, l2: float = 1e-3, rate: float = 0.5) -> MaxEnt:
        grouped: dict[tuple[str, ...], list[int]] = {}
        for f, y in rows:
            grouped.setdefault(f, [0, 0])[y] += 1
        keys = sorted(grouped)
        prior = {"": 0.5, **{f"c{q}l": -2.0 for q in ("", "q", "b")}}
        index: dict[str, int] = {x: i for i, x in enumerate(prior)}
        for f in keys:
            for x in f:
                index.setdefault(x, len(index))
        if not keys:
            return cls(index, np.array(list(prior.values())))
        ids = np.array([[0] + [index[x] for x in f] for f in keys], dtype=np.int64).reshape(len(keys), -1)
        pos = np.array([grouped[f][1] for f in keys], dtype=float)
        n = pos + np.array([grouped[f][0] for f in keys], dtype=float)
        balance = np.where(pos > 0, pos * (0.5 * n.sum() / max(1.0, pos.sum())), 0), np.where(n > pos, (n - pos) * (0.5 * n.sum() / max(1.0, (n - pos).sum())), 0)
        start = np.zeros(len(index))
        start[: len(prior)] = list(prior.values())
        w = start.copy()
        pull = l2 + PRIOR / max(1.0, n.sum())
        g2 = np.full(len(index), 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-w[ids].sum(1)))
            err = (balance[0] * (1 - p) - balance[1] * p) / max(1.0, n.sum())
            grad = np.zeros(len(index))
            np.add.at(grad, ids, err[:, None])
            grad -= pull * (w - start)
            g2 += grad * grad
            w += rate * grad / np.sqrt(g2)
        return cls(index, w)

    def probability(self, f: tuple[str, ...]) -> float:
        z = self.weights[0] + sum(self.weights[i] for x in f if (i := self.index.get(x)) is not None)
        return float(1 / (1 + np.exp(-z)))

    def is_end(self, c: Candidate, ends: Tokens, starts: Tokens) -> bool:
        """The decision; it depends on these four values only, so frequent ones are remembered."""
        k = (c.mark, c.closer, c.prev, c.next)
        yes = self.cache.get(k)
        if yes is None:
            yes = self.probability(features(c, ends, starts)) >= 0.5
            if len(self.cache) < 500_000:
                self.cache[k] = yes
        return yes


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for m in _LINE.finditer(text):
        raw = m[0]
        line = raw.strip()
        if line:
            yield m.start() + len(raw) - len(raw.lstrip()), line


def _count(text: str, stats: dict[tuple[str, str], list[int]]) -> None:
    """Adds (hits, occurrences) of the tokens at ends ('e') and starts ('s')."""
    for _, line in _lines(text):
        found, last = candidates(line)
        if not _LIST.match(line):
            t = _next_token(line, 0)
            if t:
                x = stats.setdefault(("s", _kind(t)), [0, 0])
                x[0] += 1
                x[1] += 1
        if last or (line and _SPACELESS_RE.match(line[-1])):
            x = stats.setdefault(("e", _kind(last.prev if last else _prev_token(line, len(line)))), [0, 0])
            x[0] += 1
            x[1] += 1
        for c in found:
            stats.setdefault(("e", _kind(c.prev)), [0, 0])[1] += 1
            stats.setdefault(("s", _kind(c.next)), [0, 0])[1] += 1


_SPACELESS_RE = re.compile(f"[{_SPACELESS}]")


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stats: dict[tuple[str, str], list[int]] = {}
        for text in b.column("text").to_pylist():
            if text:
                _count(text, stats)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in stats], pa.string()), pa.array([k[1] for k in stats], pa.string()), pa.array([v[0] for v in stats.values()], pa.int64()), pa.array([v[1] for v in stats.values()], pa.int64())],
            ["side", "token", "hits", "n"],
        )


def token_counts(documents: DataFrame) -> DataFrame:
    """(side, token, hits, n) over all documents: side e: n before an end mark, hits at a line's end; side s: likewise at starts."""
    per = spread(documents.select("text").where(F.col("text").isNotNull())).mapInArrow(_stats, "side string, token string, hits long, n long")
    return per.groupBy("side", "token").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def training_rows(texts: list[str], ends: Tokens, starts: Tokens) -> list[tuple[tuple[str, ...], int]]:
    """Reliable boundaries: line ends before a line that begins with a letter. Reliable
    non-boundaries: a token that never ends, or is followed by one that never starts, a line."""
    rows: list[tuple[tuple[str, ...], int]] = []
    for text in texts:
        before: Candidate | None = None
        for _, line in _lines(text):
            found, last = candidates(line)
            if before is not None and not _LIST.match(line):
                before.next = _next_token(line, 0)
                rows.append((features(before, ends, starts), 1))
            before = last
            if before is None and _SPACELESS_RE.match(line[-1]):
                before = Candidate(0, 0, _prev_token(line, len(line)), "", " ", "")
            for c in found:
                if c.closer == "q" and _case(c.next) == "U":
                    continue
                e, s = ends(_kind(c.prev)), starts(_kind(c.next))
                if e == "0" or s == "0":
                    rows.append((features(c, ends, starts), 0))
    return rows


def token_classes(documents: DataFrame, most: int = MOST_TOKENS) -> tuple[Tokens, Tokens, DataFrame | None]:
    """Classes of the tokens at ends and at starts, and (side, digest, class) of those that are over ``most`` of a side, if there are any.

    The tokens of a side that occur most often are sent, as many as ``most`` allows; all with the same number of occurrences go one way.
    """
    counts = token_counts(documents).where(F.col("n") >= FEW).persist()
    rate = F.col("hits") / F.col("n")
    kind = F.when(F.col("hits") == 0, F.when(F.col("n") >= 12, "0").otherwise("~")).when(rate < 0.01, "1").when(rate < 0.08, "2").otherwise("3")
    classed = [F.xxhash64("token").alias("digest"), F.ascii(kind).cast("byte").alias("class")]
    sides, far = [], None
    for side in ("e", "s"):
        own = counts.where(F.col("side") == side)
        if own.count() > most:
            bound = kept = 0
            for n, tokens in own.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
                kept += tokens
                if kept > most:
                    bound = n
                    break
            rest = own.where(F.col("n") <= bound).select("side", *classed)
            far = rest if far is None else far.unionByName(rest)
            own = own.where(F.col("n") > bound)
        sides.append(Tokens(own.select(*classed).toArrow()))
    far = None if far is None else checkpoint(far)
    counts.unpersist()
    return sides[0], sides[1], far


def _needed(sent):
    """(key, side, digest) of the tokens of every text that were not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = dict(zip("es", sent.value))
        for b in batches:
            out: list[tuple[str, str, int]] = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                stats: dict[tuple[str, str], list[int]] = {}
                _count(text, stats)
                digests = ((side, _digest(token)) for side, token in stats)
                out.extend((key, side, d) for side, d in digests if sides[side].held(d) is None)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["key", "side", "digest"])

    return run


def with_far(documents: DataFrame, ends: Tokens, starts: Tokens, far: DataFrame | None) -> DataFrame:
    """(doc_id, text, far) of the documents that have a text; far: classes of their tokens that were not sent.

    Each of these tokens is rarer than all that were sent, so no key of the join is frequent. Equal texts have equal tokens, so a text's digest is its key.
    """
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    kind = "array<struct<side:string,digest:bigint,class:tinyint>>"
    if far is None:
        return rows.withColumn("far", F.lit(None).cast(kind))
    sent = documents.sparkSession.sparkContext.broadcast((ends, starts))
    rows = rows.withColumn("key", F.sha2("text", 256))
    needed = spread(rows.select("key", "text")).mapInArrow(_needed(sent), "key string, side string, digest long")
    found = needed.join(far, ["side", "digest"]).groupBy("key").agg(F.collect_set(F.struct("side", "digest", "class")).cast(kind).alias("far"))
    return rows.join(found, "key", "left").select("doc_id", "text", "far")


def _meet(far: list | None, ends: Tokens, starts: Tokens) -> None:
    """Makes the tokens of the next document known."""
    for side, tokens in (("e", ends), ("s", starts)):
        tokens.more = {x["digest"]: x["class"] for x in far or () if x["side"] == side}


def train(documents: DataFrame, ends: Tokens, starts: Tokens, far: DataFrame | None, sample: int) -> MaxEnt:
    chosen = sampled(documents, documents.select("doc_id", "text").where(F.length("text").between(1, LONGEST_SAMPLE)), sample, "doc_id")
    rows: list[tuple[tuple[str, ...], int]] = []
    for text, more in with_far(chosen, ends, starts, far).select("text", "far").collect():
        _meet(more, ends, starts)
        rows.extend(training_rows([text], ends, starts))
    _meet(None, ends, starts)
    return MaxEnt.fit(rows)


def fit(documents: DataFrame, sample: int = 4000, most: int = MOST_TOKENS) -> tuple[MaxEnt, Tokens, Tokens]:
    """Model and token classes; those over ``most`` of a side have part in the model only."""
    ends, starts, far = token_classes(documents, most)
    return train(documents, ends, starts, far, sample), ends, starts


def split(text: str | None, model: MaxEnt, ends: Tokens, starts: Tokens) -> list[tuple[int, int]]:
    """(start, end) of every sentence as code points, end exclusive."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for at, line in _lines(text):
        begin = 0
        for c in candidates(line)[0]:
            if model.is_end(c, ends, starts):
                if c.end > begin:
                    out.append((at + begin, at + c.end))
                begin = c.start
        if len(line) > begin:
            out.append((at + begin, at + len(line)))
    return out


def _splitter(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            s: list[int] = []
            e: list[int] = []
            model, ends, starts = fitted.value
            for doc, text, far in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "far"))):
                if far or ends.more or starts.more:
                    _meet(far, ends, starts)
                for x, y in split(text, model, ends, starts):
                    ids.append(doc)
                    s.append(x)
                    e.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "start_char", "end_char"])

    return run


def sentences(documents: DataFrame, sample: int = 4000, most: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence of every document; ``most`` bounds the tokens of a side that are sent to every task."""
    ends, starts, far = token_classes(documents, most)
    fitted = documents.sparkSession.sparkContext.broadcast((train(documents, ends, starts, far, sample), ends, starts))
    return spread(with_far(documents, ends, starts, far)).mapInArrow(_splitter(fitted), "doc_id long, start_char long, end_char long")
