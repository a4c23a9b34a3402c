"""Files whose main body is template residue, filler, an error message or a script notice.

Three character n-gram models are fitted: filler (unfilled placeholders and dummy text),
notices (error messages, scripts required) and natural prose. Every window of a main-body
block gets the logarithm of the likelihood ratio of the better of the first two to prose;
windows above zero localise the residue, and a file is excluded when they cover at least LEAST of its main
text (headings aside, where they only name the page). Windows miss the characters at the ends of blocks and words that prose
has too, so a body that is residue for the larger part is covered by less than half: LEAST is set
between what was measured for bodies of either kind. A page that quotes or explains such text has prose around it
and stays. The http status is no evidence, since it doesn't say what was stored. Where a page has no main text at all, what it shows to readers without scripts
stands in its place.

Filler and notices start from the seeds below. The prose starts from ``prose`` (documents of
the domain) and all three are then refitted on the main bodies of the pages, as the models
themselves label their blocks. Every document and every page is counted, whatever its length: texts stay where they are, n-gram counts are summed.
Pages are parsed for their main text once; it is kept beside the checkpoints for the rounds of the fit and for the result. Code of several lines never counts as residue. Null or
empty html, and pages without any text, are no cases. The tables have a fixed size.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from . import template
from .htmlblocks import Block, Node, parse

#: Seed texts of the filler model.
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae, donec velit neque auctor.
Text goes here. Your text here. Insert text here. Add your content here. Sample text. Placeholder text. Dummy text.
This section is left blank. This page is intentionally left blank. To be written. To be determined. Coming soon. Under construction.
Replace this paragraph before launch. Sample paragraph. Example heading. Title goes here. Description goes here.
TBD TODO FIXME TBA n/a null undefined undefined NaN None [object Object] xxx XXX asdf asdf qwer qwerty foo bar
{{ title }} {{content}} {{ page.title }} {{#each items}} {{this}} {{/each}} {{name}} {{{body}}} {{> footer}}
${title} ${name} ${section} #{item.name} #{title} %TITLE% %NAME% %s %d {0} {1} __TITLE__ __NAME__ @@NAME@@ @TITLE@
[[TITLE]] [[NAME]] [Insert title here] [Your name] [Company name] [TITLE] <your name> <insert text> <%= title %> <% end %> <?php echo ?>
{% block content %}{% endblock %} {% include header %} {% if x %} {% endif %} {title} {name} $title$ $name$ ::title::
Blindtext Blindtext, bitte ersetzen. Hier steht Ihr Text. Platzhalter. Inhalt folgt. Texte à venir. Texte ici. Contenu à venir.
Texto de ejemplo. Escriba aquí su texto. Próximamente. 此处填写内容。占位文字。敬请期待。内容待补充。示例文本。
Use {0} to manage your {name} in three steps. Learn how {{ title }} works with ${name}. %NAME% was last tested with [Insert name]."""

#: Seed texts of the notice model.
NOTICES = """404 Not Found. Page not found. The page you requested could not be found. We could not find that page. This page does not exist.
The requested URL was not found on this server. Check the address or go back to the home page. Go back to the start page. Reload the page.
403 Forbidden. Access denied. You do not have permission to view this page. Sign in to continue. Your session has expired.
500 Internal Server Error. Something went wrong. An internal error occurred. Internal fault, reference 12345. Please try again later. Try again in a moment.
{"error": "not found", "code": 404} {"status": 500, "message": "internal error"} If this keeps happening, contact the site administrator and quote this number.
If the problem persists, tell the support team and quote the reference 12345. Your session has ended, please sign in again.
502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. The service is temporarily unavailable. The server did not respond in time. Connection refused.
Too many requests from your network. Rate limit exceeded. Slow down. upstream request timeout. upstream connect error or disconnect, reset before headers, request dropped.
Certificate problem. Your connection is not private. Connection stopped. The connection was reset. Error 503. Error code 1020. Request ID 12345.
Fatal error: uncaught exception in line 12. Fault in template line 12: no such block. Traceback (most recent call last). Database error: no connection. Stack trace.
Please enable JavaScript to continue. Please switch on JavaScript to view this page. You need to enable JavaScript to run this app. This app does not work without scripts.
Scripting is required. Enable it and reload. Your browser blocks scripts; the page cannot load. JavaScript is disabled in your browser. Scripts are required.
Seite nicht gefunden. Die Seite wurde nicht gefunden. Zugriff verweigert. Interner Fehler. Der Dienst antwortet nicht. Bitte später erneut versuchen. Zu viele Anfragen.
Bitte aktivieren Sie JavaScript, um fortzufahren. Diese Seite braucht Skripte. Bitte prüfen Sie die Adresse, Code 12345. Der Server ist nicht erreichbar.
Page introuvable. Cette page n'existe pas. Accès refusé. Erreur interne du serveur. Le service ne répond pas. Réessayez plus tard. Trop de requêtes. Vérifiez l'adresse, code 12345.
Activez JavaScript pour lire cette page. Veuillez activer JavaScript pour continuer. Cette application exige des scripts.
Página no encontrada. Esta página no existe. Acceso denegado. Error interno. El servicio no responde. Inténtelo más tarde. Demasiadas solicitudes. Revise la dirección, código 12345.
Active JavaScript para ver esta página. Esta aplicación necesita scripts. Habilite JavaScript para continuar.
页面不存在。找不到该页面。拒绝访问。内部错误。服务暂时不可用，请稍后再试。请求过多。请检查地址，编号 12345。连接超时。
请启用 JavaScript 后再浏览。本应用需要启用脚本。您的浏览器已禁用脚本。"""

ORDER, BITS, WINDOW = 4, 18, 32
#: Covered share of the main text from which a file is a case, and from which its blocks are examples of residue.
LEAST, EXAMPLE = 0.3, 0.5
#: Characters that are counted or scored together.
TOGETHER = 1 << 19
#: Positions of them that one step of numpy works on, so that what it holds stays in the processor's cache; results don't depend on it.
NEAR = 1 << 13
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)", re.S | re.I)
_TAGS = re.compile(r"<[^>]*>")


def _parts(rows: Iterable, size: Callable[..., int]) -> Iterator[list]:
    """The rows in order, in lists of about TOGETHER characters."""
    part: list = []
    held = 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= TOGETHER:
            yield part
            part, held = [], 0
    if part:
        yield part


def _plain(text: str) -> str:
    """As the models see a text: small letters, single blanks."""
    return " ".join(text.lower().split())


def _codes(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all blocks, which are plain, each with ORDER - 1 line feeds before it, and block starts."""
    pad = "\n" * (ORDER - 1)
    codes = np.frombuffer("".join([pad + b for b in blocks]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[codes - np.uint32(48) < 10] = 48
    starts = np.cumsum([0] + [len(pad) + len(b) for b in blocks])
    return codes, starts


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """For every order k the table slot of the k characters that end at each position."""
    mask, n = np.uint64((1 << BITS) - 1), len(codes)
    padded = np.concatenate([np.zeros(ORDER - 1, dtype=codes.dtype), codes])
    out = [np.empty(n, dtype=np.int64) for _ in range(ORDER)]
    for i in range(0, n, NEAR):
        j = min(i + NEAR, n)
        near = padded[i : j + ORDER - 1].astype(np.uint64)
        near += np.uint64(1)
        h = np.zeros(j - i, dtype=np.uint64)
        for k in range(ORDER):
            h += near[ORDER - 1 - k : ORDER - 1 - k + j - i] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            out[k][i:j] = h & mask
    return out


class CharModel:
    """Interpolated character n-gram model over hashed counts of fixed size."""

    def __init__(self, kind: type = np.float32):
        """``kind``: of the tables; what counts many texts takes float64, which holds their sums exactly."""
        self.counts = [np.zeros(1 << BITS, dtype=kind) for _ in range(ORDER)]
        self.total = 0.0

    def add(self, blocks: Iterable[str], weight: float = 1.0) -> CharModel:
        for part in _parts(map(_plain, blocks), len):
            codes, _ = _codes(part)
            for i in range(0, len(codes), TOGETHER):  # a long block in pieces, each behind the characters that its first n-grams begin with
                before = min(i, ORDER - 1)
                self.count([s[before:] for s in _slots(codes[i - before : i + TOGETHER])], weight)
        return self

    def count(self, slots: list[np.ndarray], weight: float = 1.0) -> CharModel:
        for table, s in zip(self.counts, slots):
            n = np.bincount(s, minlength=1 << BITS)
            table += n if weight == 1 else n * weight
        self.total += len(slots[0]) * weight
        return self

    def plus(self, other: CharModel) -> CharModel:
        for a, b in zip(self.counts, other.counts):
            a += b
        self.total += other.total
        return self


class Beside:
    """Filler, notice and prose models side by side, one such three or more: a look-up gives the counts of all."""

    def __init__(self, *threes: tuple[CharModel, CharModel, CharModel], strength: float = 4.0):
        models = [m for three in threes for m in three]
        self.threes, self.width = len(threes), 1 << (len(models) - 1).bit_length()  # rows of a power of two are copied fastest
        self.strength = strength
        self.tables = [np.zeros((1 << BITS, self.width), dtype=np.float32) for _ in range(ORDER)]
        for k, table in enumerate(self.tables):
            for i, m in enumerate(models):
                table[:, i] = m.counts[k]
        self.totals = np.array([m.total + 20 * strength for m in models] + [1.0] * (self.width - len(models)), dtype=np.float32)

    def ratios(self, slots: list[np.ndarray]) -> np.ndarray:
        """For every three, sums up to every position of the logarithms of the likelihood ratios of its first two models to the third."""
        n = len(slots[0])
        out = np.zeros((self.threes, 2, n + 1))
        totals = np.tile(self.totals, (min(n, NEAR), 1))
        found = [np.empty((min(n, NEAR) + 1, self.width), dtype=np.float32) for _ in range(ORDER)]  # behind the row of the position before
        for table, rows in zip(self.tables, found):
            rows[-1:] = table[:1]
        for i in range(0, n, NEAR):
            m = min(NEAR, n - i)
            for table, rows, s in zip(self.tables, found, slots):
                rows[0] = rows[-1]
                np.take(table, s[i : i + m], axis=0, out=rows[1 : m + 1], mode="clip")
            p = found[0][1 : m + 1] + 0.02 * self.strength
            p /= totals[:m]
            for k in range(1, ORDER):
                # the context of order k ends one position earlier
                p *= self.strength
                p += found[k][1 : m + 1]
                p /= found[k - 1][:m] + self.strength
            np.log(np.maximum(p, 1e-12, out=p), out=p)
            for t in range(self.threes):
                for x in (0, 1):
                    np.subtract(p[:, 3 * t + x], p[:, 3 * t + 2], out=out[t, x, i + 1 : i + m + 1])
        return np.cumsum(out, axis=2, out=out)


def block_ratios(ratios: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Filler and notice ratio a character of every block, from the sums of a three."""
    a, b = starts[:-1] + ORDER - 1, starts[1:]
    return [(x[b] - x[a]) / np.maximum(b - a, 1) for x in ratios]


def block_scores(ratios: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(residue characters, characters, filler ratio, notice ratio) of every block, from the sums of a three."""
    a, b = starts[:-1] + ORDER - 1, starts[1:]
    fill, note = ratios
    size = np.diff(starts)
    first, last = np.repeat(a, size), np.repeat(b, size)  # of every position the ends of its block
    half, n = WINDOW // 2, len(first)
    hits = np.zeros(n + 1, dtype=np.int64)
    for i in range(0, n, NEAR):
        at = np.arange(i, min(i + NEAR, n))
        lo, hi = np.maximum(at - half, first[i : i + NEAR]), np.minimum(at + half, last[i : i + NEAR])
        hits[i + 1 : i + 1 + len(at)] = (fill.take(hi) > fill.take(lo)) | (note.take(hi) > note.take(lo))
    np.cumsum(hits, out=hits)
    columns = hits[b] - hits[a], b - a, *block_ratios(ratios, starts)
    return list(zip(*(c.tolist() for c in columns)))


def _main_text(nodes: list[Node], blocks: list[Block], site: dict, rescue: bool) -> tuple[list[str], list[str], list[str]]:
    heads, text, code = [], [], []
    for b, chrome in zip(blocks, template.is_chrome(nodes, blocks, site, rescue)):
        if not chrome:
            tag = nodes[b.node].tag
            (code if tag == "pre" else heads if tag in _HEADINGS else text).append(b.text)
    if code and sum(map(len, text)) < sum(map(len, code)) and not any("\n" in c.strip() for c in code):
        text, code = text + code, []  # single lines set as code with little beside them are messages rather than code
    return heads, text, code


def main_text(html: str | None, site: dict) -> tuple[list[str], list[str], list[str], list[str]]:
    """Main-body headings, other blocks that can be residue, code, and where there is nothing but headings what the site repeats.

    What is shown to readers without scripts stands for the text of a page that has none; what its site repeats in
    the main container comes apart, as it can be residue or optional parts of the template. Single lines set as code are text where they are most of the page.
    """
    nodes, blocks = parse(html)
    heads, text, code = _main_text(nodes, blocks, site, False)
    repeated: list[str] = []
    if not text and not code and html:
        shown = () if heads else (" ".join(_html.unescape(_TAGS.sub(" ", x)).split()) for x in _NOSCRIPT.findall(html))
        text = [x for x in dict.fromkeys(shown) if x]
        if not text:
            own, again, more = _main_text(nodes, blocks, site, True)
            repeated = [x for x in (*own, *again, *more) if x not in heads]
    return heads, text, code, repeated


def page_coverage(heads: list[tuple], text: list[tuple], code: int) -> float:
    """Share of the main text that is residue, from the scores of its blocks."""

    def share(rows: list[tuple], more: int) -> float:
        size = sum(r[1] for r in rows) + more
        return sum(r[0] for r in rows) / size if size else 0.0

    return max(share(heads + text, code), share(text, code))


_STRINGS = pa.list_(pa.string())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        rows = [main_text(h, s) for h, s in zip(b.column("html").to_pylist(), template.Sites(b, held))]
        heads, blocks, repeated = (pa.array([list(map(_plain, r[k])) for r in rows], _STRINGS) for k in (0, 1, 3))
        yield pa.RecordBatch.from_arrays([b.column("path"), heads, blocks, pa.array([sum(map(len, r[2])) for r in rows], pa.int64()), repeated], ["path", "heads", "blocks", "code", "repeated"])


def main_texts(pages: DataFrame, valid: DataFrame) -> DataFrame:
    """(path, heads, blocks, code, repeated): the main text of every page in plain blocks, code as its number of characters; kept."""
    return checkpoint(spread(template.attach(pages, valid)).mapInArrow(_texts, "path string, heads array<string>, blocks array<string>, code long, repeated array<string>"))


def _read(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(heads, blocks, code, repeated) of a batch's pages, in lists of pages that are scored together."""
    rows = zip(*(b.column(c).to_pylist() for c in ("heads", "blocks", "code", "repeated")))
    return _parts(rows, lambda row: sum(len(x) for k in (0, 1, 3) for x in row[k]))


def _counting(add: Callable[[pa.RecordBatch, tuple[CharModel, CharModel, CharModel]], None]):
    """A stage that adds batches to three empty models and gives their counts: (model, order, slot, n), order -1 for the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tuple(CharModel(np.float64) for _ in range(3))
        for b in batches:
            add(b, models)
        for m, model in enumerate(models):
            for k in range(-1, ORDER if model.total else 0):
                table = model.counts[k] if k >= 0 else np.array([model.total])
                at = np.flatnonzero(table)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m), pa.int32()), pa.array(np.full(n, k), pa.int32()), pa.array(at, pa.int64()), pa.array(table[at], pa.float64())], ["model", "order", "slot", "n"])

    return run


def _counted(rows: DataFrame, add: Callable) -> tuple[CharModel, CharModel, CharModel]:
    """Models counted over all rows; what reaches the driver has the fixed size of the tables."""
    sums = rows.mapInArrow(_counting(add), "model int, order int, slot long, n double").groupBy("model", "order", "slot").agg(F.sum("n").alias("n")).toArrow()
    models = (CharModel(), CharModel(), CharModel())
    m, k, slot, n = (sums.column(c).to_numpy() for c in ("model", "order", "slot", "n"))
    for i, model in enumerate(models):
        for order in range(ORDER):
            own = (m == i) & (k == order)
            model.counts[order][slot[own]] = n[own]
        model.total = float(n[(m == i) & (k == -1)].sum())
    return models


def _add_lines(b: pa.RecordBatch, models: tuple) -> None:
    models[2].add(x for t in b.column("text").to_pylist() for x in re.split(r"[\r\n]+", t or "") if x.strip())


def _add_all(b: pa.RecordBatch, models: tuple) -> None:
    models[2].add(x for c in ("heads", "blocks") for row in b.column(c).to_pylist() for x in row)


def _add_labelled(sent):
    """Blocks of pages that the models call residue to the first two models; those beside real content to the third. ``sent``: the models of now and, where they are others, those of the seeds."""

    def add(b: pa.RecordBatch, models: tuple) -> None:
        beside = sent.value
        for pages in _read(b):
            codes, starts = _codes([x for heads, text, _, _ in pages for x in (*heads, *text)])
            slots = _slots(codes)
            ratios = beside.ratios(slots)
            scores = block_scores(ratios[0], starts)
            fills, notes = block_ratios(ratios[-1], starts)
            known = np.maximum(fills, notes) >= 1.0  # well, by the seeds
            labels = np.full(len(scores), -1)
            at = 0
            for heads, text, code, _ in pages:
                k = len(heads) + len(text)
                own = scores[at : at + k]
                covered = page_coverage(own[: len(heads)], own[len(heads) :], code)
                for i in range(at, at + k):
                    hit, size, fill, note = scores[i]
                    if covered >= EXAMPLE and size and hit >= 0.8 * size:
                        labels[i] = 0 if fill >= note else 1
                    elif covered < 0.3 and not known[i]:
                        labels[i] = 2  # beside real content
                at += k
            of = np.repeat(labels, np.diff(starts))
            for m, model in enumerate(models):
                chosen = np.flatnonzero(of == m)
                if len(chosen):
                    model.count([s[chosen] for s in slots])

    return add


def fit(texts: DataFrame, prose: DataFrame | None, rounds: int = 3) -> tuple[CharModel, CharModel, CharModel]:
    """Models fitted on the seeds, all prose documents and the main texts of all pages, counted where the texts are."""
    context = texts.sparkSession.sparkContext
    lines = _counted(spread(prose.select("text")), _add_lines)[2] if prose is not None else None

    def seeded(more: tuple[CharModel, CharModel, CharModel], extra: CharModel | None) -> tuple[CharModel, CharModel, CharModel]:
        f = CharModel().add(FILLER.split("\n"), 3).plus(more[0])
        n = CharModel().add(NOTICES.split("\n"), 3).plus(more[1])
        return f, n, more[2].plus(extra) if extra else more[2]

    empty = (CharModel(), CharModel(), CharModel())
    # without documents most blocks of the pages stand for prose
    seeds = fitted = seeded(empty if lines and lines.total else _counted(texts, _add_all), lines)
    for _ in range(rounds):
        sent = context.broadcast(Beside(fitted) if fitted is seeds else Beside(fitted, seeds))  # 4 tables of 4 or 8 MB
        fitted = seeded(_counted(texts, _add_labelled(sent)), lines)
        sent.unpersist()
    return fitted


def _scorer(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered = []
            for part in _read(b):
                codes, starts = _codes([t for heads, text, _, repeated in part for t in (*heads, *text, *repeated)])
                scores = block_scores(fitted.value.ratios(_slots(codes))[0], starts)
                at = 0
                for heads, text, code, repeated in part:
                    m, n = at + len(heads), at + len(heads) + len(text) + len(repeated)  # text or repeated is empty
                    found = page_coverage(scores[at:m], scores[m:n], code)
                    covered.append(max(found, page_coverage(scores[at:m], [], 0)) if repeated else found)
                    at = n
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(covered, pa.float64())], ["raw_html_path", "covered"])

    return run


def coverage(pages: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """(raw_html_path, covered): share of residue in the main text of every file."""
    texts = main_texts(pages, checkpoint(template.template(pages)))
    fitted = pages.sparkSession.sparkContext.broadcast(Beside(fit(texts, prose)))  # 4 tables of 4 MB
    return texts.mapInArrow(_scorer(fitted), "raw_html_path string, covered double")


def residue_files(pages: DataFrame, prose: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(raw_html_path): files to exclude."""
    return coverage(pages, prose).where(F.col("covered") >= least).select("raw_html_path")
