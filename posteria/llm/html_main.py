"""Main text of web pages: the maximum-scoring run of a page's words and tags.

Every word scores above zero and every kind of tag below, by weights learned
from labelled pages; one linear scan finds the contiguous run of the largest
sum. A word counts less the more the elements around it speak against it: their
names and the words of their class, id and role have weights too, learned from
how many words under them belong to an article. Parts of the run that speak
against themselves are left out of its text if the rest is worth more.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.llm.tables import lean, pick, quoted, slices
from posteria.session import stage

MUTE = "script|style|noscript|template|title|textarea|iframe|svg|object|canvas"
#: Comments, elements whose content is not text, tags (with quoted attributes), declarations. A tag of such an element
#: that ends in "/>" is empty; where one other than svg has an end tag before the next of its name, it is not, as in browsers.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?:\s++(?:[^\s=>\"'/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)?+)*+/>"
    rf"|<({MUTE})(?=[\s>/])(?:[^>]*+(?<!/)>|[^>]*+(?<=/)>(?=(?>.*?<(?=/?\1[\s>/]))/)).*?(?:</\1\s*>|\Z)"
    rf"|<(?:{MUTE})(?=[\s>/])[^>]*+(?<=/)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: What speaks against a part where no labelled page has it: elements, and words in a class, id or role.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion "
    "related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget alert".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAMPLE = 400  # labelled pages that the weights are fitted on, at most
FLOOR = -0.05  # no tag scores above this
WORD_FLOOR = 0.05  # no word scores below this
CEILING = -6.0  # and none costs more, so that an advert does not split a long article
UNSEEN = -2.0  # a kind of tag that no labelled page has, unless articles are made of it
PRIOR = -3.0  # log odds of a part that only its name speaks against
AGAINST = -8.0  # log odds count no further than this
FOR = 1.0  # a part with odds above this makes its words count in full again
EDGE = -1.0  # a tag at the edge of a part that something speaks against; the tags in it tell nothing of articles
CONTENT_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot caption tr td th figure figcaption "
    "picture video audio hr section details summary address main article".split()
)


#: Elements whose own name says nothing: articles and all else are made of them.
PLAIN = (CONTENT_TAGS - {"main", "article"}) | frozenset("div body html center font".split()) | INLINE


@dataclass
class Token:
    kind: str  # "" for text
    words: int = 0
    text: str = ""
    block: bool = False
    odds: float = 0.0  # what the elements around it say, 0 or less
    trusted: bool = False  # inside an article
    end: int = -1  # of an opening tag: the token that ends its element


@dataclass
class Weights:
    """Score of a word, of each kind of tag, and log odds of the names of parts (``nav``, ``.ad``)."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    parts: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token) -> float:
        if not token.kind:
            return self.word * token.words * math.exp(token.odds) if token.words else 0.0
        if token.odds:
            return EDGE if token.end >= 0 or token.kind[1] == "/" and token.text == "|" else 0.0
        if token.kind in self.tags:
            return self.tags[token.kind]
        return FLOOR if not token.block or token.trusted or token.kind.strip("</>") in CONTENT_TAGS else UNSEEN

    def against(self, names: tuple[str, ...], trusted: bool) -> float:
        """Log odds of a part by its names: what speaks against it, summed, or else the most that speaks for it."""
        known = []
        for name in names:
            value = self.parts.get(name)
            if value is None:
                aside = name[1:] in ASIDE_NAMES if name[0] == "." else name in ASIDE_TAGS or name == ".hidden"
                # the header inside an article holds its heading
                value = PRIOR if aside and not (trusted and name == "header") else 0.0
            known.append(value)
        bad = sum(v for v in known if v < 0)
        return max(bad, AGAINST) if bad else max(known, default=0.0)


def names_of(name: str, attributes: str) -> tuple[str, ...]:
    """The names of a part: of its element, if that says something, and the words of its class, id and role."""
    words: set[str] = set()
    if attributes:
        for value in NAMES.findall(attributes):
            words.update(w for w in SPLIT.split(value.strip("\"'")) if w)
    out = [f".{w.lower()}" for w in sorted(words)]
    if attributes and HIDDEN.search(attributes):
        out.append(".hidden")
    return (*out, name) if name not in PLAIN else tuple(out)


def tokens(page: str, weights: Weights | None = None, seen: list[tuple[str, ...]] | None = None) -> list[Token]:
    """Text runs and tags in page order, with the odds of the parts they are in.

    ``seen`` receives for each token the names of all parts around it. An
    element ends at its end tag, or where an element around it ends.
    """
    known = weights or Weights()
    out: list[Token] = []
    at, odds, trusted = 0, 0.0, False
    stack: list[tuple[str, int, float, bool, int]] = []  # element, its token, odds and trust outside, number of names inside
    opened: Counter = Counter()
    names: tuple[str, ...] = ()

    def add(token: Token) -> None:
        token.odds, token.trusted = odds, trusted
        out.append(token)
        if seen is not None:
            seen.append(names)

    def text(piece: str) -> None:
        if not piece.strip():
            if piece:
                add(Token("", 0, " "))
            return
        plain = html.unescape(piece) if "&" in piece else piece
        add(Token("", len(plain.split()), plain))

    for found in TOKEN.finditer(page):
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        name = (found[3] or found[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[2] or found[5]), found[4] or found[7] or ""
        block = name not in INLINE
        if closing:
            add(Token(f"</{name}>", block=block))
            if opened[name]:
                while True:
                    element, start, odds, trusted, held = stack.pop()
                    opened[element] -= 1
                    if out[start].end == 0:
                        out[start].end = len(out) - 1
                    names = names[:held]
                    if element == name:
                        break
                if out[start].end > 0 and out[start].odds:
                    out[-1].odds, out[-1].text = out[start].odds, "|"  # the edge of such a part
                else:
                    out[-1].odds = odds
            continue
        token = Token(f"<{name}>", block=block, text=" " if name == "br" else "")
        if name in VOID or attributes.endswith("/"):
            add(token)
            continue
        own = names_of(name, attributes)
        before = odds, trusted, len(names)
        if own:
            value = known.against(own, trusted)
            if value < 0:
                odds = max(odds + value, AGAINST)
                token.end = 0
            elif value > FOR or name in ("article", "main") and name not in known.parts:
                odds, trusted = 0.0, True
            if seen is not None:
                names = (*names, *own)
        add(token)
        stack.append((name, len(out) - 1, *before))
        opened[name] += 1
    if at < len(page):
        text(page[at:])
    for token in out:
        if token.end == 0:
            token.end = len(out) - 1
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the largest sum above zero; the first among equals; (0, 0) if none."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def left_out(found: list[Token], scores: list[float], start: int, end: int) -> list[tuple[int, int]]:
    """Parts of the run that something speaks against and that the rest of the run outweighs, outermost first."""
    words = [0.0]
    for token, score in zip(found[start:end], scores[start:end]):
        words.append(words[-1] + (0.0 if token.kind else score))
    out: list[tuple[int, int]] = []
    edges = [(start, end)]  # the parts around that stay: what is inside is weighed against the innermost
    i = start
    while i < end:
        while len(edges) > 1 and i >= edges[-1][1]:
            edges.pop()
        last = found[i].end
        if last > 0:
            last = min(last, end - 1)
            low, high = edges[-1]
            inside = words[last + 1 - start] - words[i - start]
            if 2 * inside < words[high - start] - words[low - start]:
                out.append((i, last + 1))
                i = last + 1
                continue
            edges.append((i, last + 1))
        i += 1
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best run, white space inside a block made one blank, joined by line ends."""
    if not page:
        return ""
    found = tokens(page, weights)
    scores = [weights.of(t) for t in found]
    start, end = best_run(scores)
    if sum(scores[start:end]) < weights.word / 2:  # not worth half a word: menus and the like
        return ""
    gone = iter([*left_out(found, scores, start, end), (end, end)])
    skip = next(gone)
    blocks, piece = [], []
    for i in range(start, end):
        if i >= skip[1] and skip[1] > skip[0]:
            skip = next(gone)
        token = found[i]
        if token.block:
            blocks.append(" ".join("".join(piece).split()))
            piece = []
        elif not skip[0] <= i < skip[1]:
            piece.append(token.text if not token.kind or token.kind == "<br>" else "")
    blocks.append(" ".join("".join(piece).split()))
    return "\n".join(b for b in blocks if b)


def main_span(found: list[Token], main: str) -> tuple[int, int] | None:
    """First and last token of the known main text; None if it is not on the page as one run of words.

    A heading right before it that repeats its beginning belongs to it.
    """
    words, owner = [], []
    for i, token in enumerate(found):
        if not token.kind:
            here = token.text.split()
            words += here
            owner += [i] * len(here)
    wanted = main.split()
    if not wanted or len(wanted) > len(words):
        return None
    whole, part = " " + " ".join(words) + " ", " " + " ".join(wanted) + " "
    at = whole.rfind(part)
    if at < 0:
        return None
    first = whole.count(" ", 0, at + 1) - 1
    start, last, back = owner[first], owner[first + len(wanted) - 1], first
    while back and owner[first] - owner[back - 1] <= 8:
        back -= 1
    for skip in range(back, first):
        if " ".join(wanted).startswith(" ".join(words[skip:first])):
            start = owner[skip]
            break
    return start - bool(start and found[start - 1].kind), last  # with the tag that opens the first block


def label_counts(page: str, main: str, weights: Weights | None = None) -> Counter:
    """Counts of (name, inside) on a page whose main text is known; empty if it is not found.

    Without weights, words under each name of a part; with them, words (``""``)
    and tags outside the parts that the weights speak against.
    """
    around: list[tuple[str, ...]] = []
    found = tokens(page, weights, around)
    span = main_span(found, main)
    counts: Counter = Counter()
    if span is None:
        return counts
    for i, (token, names) in enumerate(zip(found, around)):
        inside = span[0] <= i <= span[1]
        if weights is None:
            if token.words:
                for name in {"", *names}:
                    counts[name, inside] += token.words
        elif not token.kind:
            counts["", inside] += token.words
        elif not token.odds:
            counts[token.kind, inside] += 1
    return counts


def _counted(rows: DataFrame, weights: Weights | None) -> dict[tuple[str, bool], int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "html"):
            for page, main in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page and main:
                    total.update(label_counts(page, main, weights))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(total.values(), pa.int64())],
            names=["kind", "inside", "n"],
        )

    found = rows.mapInArrow(lean(count), "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return {(r["kind"], r["inside"]): r["n"] for r in found.collect()}  # names in the sample


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text") -> Weights:
    """Weights from pages with known main text.

    The name of a part scores the log odds of the words under it, against those
    of the page. Outside the parts that this speaks against, a word scores the
    log ratio of its shares inside and outside the main text, a kind of tag its
    log odds, kept below zero: tags of the article itself cost next to nothing.
    The caller bounds the number of labelled pages. No usable page gives the
    default weights.
    """
    rows = stage(pick(labelled, html=html_col, text=text_col), "labelled")
    counts = _counted(rows, None)
    if not any(inside for _, inside in counts):
        return Weights()
    ratio = lambda k: math.log((counts.get((k, True), 0) + 0.5) / (counts.get((k, False), 0) + 0.5))
    parts = {k: ratio(k) - (ratio("") if counts.get((k, True), 0) else 0.0) for k, _ in counts if k}
    parts = {k: max(AGAINST, min(-AGAINST, v)) for k, v in parts.items()}
    counts = _counted(rows, Weights(parts=parts))
    words = [counts.get(("", side), 0) + 0.5 for side in (True, False)]
    tags = [sum(n for (k, i), n in counts.items() if k and i == side) + 0.5 for side in (True, False)]
    word = math.log(words[0] / (words[0] + tags[0])) - math.log(words[1] / (words[1] + tags[1]))
    scores = {k: max(CEILING, min(FLOOR, ratio(k))) for k, _ in counts if k}
    return Weights(max(WORD_FLOOR, word), scores, parts)


def extract(
    pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, url, text and n_chars (code points) of every page, from its whole html.

    Null or empty html, and a page without a word worth its tags, give an empty
    text. Of runs of equal sum the first is taken. Whole pages are read,
    however long; rows stay where they are; repeated ids give repeated rows; no
    rows give no rows; extra columns are left out.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    out = rows.mapInArrow(lean(extracted), f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def labelled_sample(pages: DataFrame, documents: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Html and known main text of the pages whose url number is the id of a document.

    At most ``most`` pages, one for a number, those of the smallest numbers, so
    that only the files that hold these documents are read. Of pages with one
    number that of the least html is taken, of documents that of the least text.
    """
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint)")
    numbered = pages.select(number.alias("number"), "html").filter("number is not null")
    first = numbered.select("number").distinct().orderBy("number").limit(most).agg(F.max("number")).collect()[0][0]
    if first is None:
        return numbered.select("html", F.lit(None).cast("string").alias("text")).limit(0)
    chosen = numbered.filter(F.col("number") <= first).groupBy("number").agg(F.min("html").alias("html"))
    texts = documents.select(quoted("doc_id").alias("number"), "text").filter(F.col("number") <= first)
    texts = texts.groupBy("number").agg(F.min("text").alias("text"))
    return chosen.join(texts, "number").select("html", "text")
