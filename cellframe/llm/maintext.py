"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. A word scores one; a tag scores minus its
weight, which grows with how often tags of its name and side (opening or closing) lie outside
the main element of labelled pages: pages that have exactly one ``article`` or ``main`` element
label themselves, and every such page is counted. One factor for all weights is chosen on a
bounded sample of these pages (``SAMPLE``, those of smallest id hash) so that regions agree best with
the labels. A linear scan then finds the contiguous region of largest score. What stands in menus, adverts,
forms and the like scores nothing, but for their own tags, and is left out of the text.

Paragraphs, list items, terms, table cells and rows, and options without an end tag end where HTML implies
it. The page, its body, main elements and headings are never put aside for their class, id or role; an id puts
aside only as a whole word. Where the first main element opens inside of a form or of something put aside by name,
that was a wrapper and is kept; so is what is put aside by name and holds the larger part of a page without a main element. A footer inside a
quotation names its source and stays. Tags beyond the ``TAGS`` most frequent ones of labelled pages weigh like unseen ones.

Scripts, styles, comments and the head are never text. Character references are decoded, white
space inside a block becomes one space, and blocks are joined by one space. A null or empty
page, or one without a region of positive score, has the text "". Pages stay in their tasks.
"""

from __future__ import annotations

import html
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: labelled pages on which the factor is chosen, and tags that get a weight of their own
SAMPLE, TAGS = 400, 2000
FACTORS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: least weight of a tag, and weight of a tag that no labelled page has, as a share of the factor
LEAST_WEIGHT, UNSEEN = 0.01, 0.5

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
ASIDE = frozenset("nav aside form footer header menu dialog button select".split())
MAIN = frozenset(("article", "main"))
WHOLE = MAIN | {"html", "body"}
# Elements whose end tag may be left out, and the opening tags before which they end.
_BLOCKS = frozenset("""address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre search section table ul""".split())
_ROWS = frozenset("tbody thead tfoot".split())
ENDS = {"p": _BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": _ROWS | {"tr"},
        "td": _ROWS | {"td", "th", "tr"}, "th": _ROWS | {"td", "th", "tr"}, "option": frozenset(("option", "optgroup", "hr")),
        **dict.fromkeys(_ROWS, _ROWS)}
STARTS = frozenset().union(*ENDS.values())
#: an open element is not ended from inside of these
WALLS = {"p": frozenset("button object table td th caption marquee".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
         "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select", "datalist")),
         **dict.fromkeys(_ROWS, frozenset(("table",)))}
NAMED = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|notice|banner|"
                   r"alert|popup|modal|newsletter|subscribe|share|social|related|comments?|respond|disqus\w*)(?:[-_].*)?", re.IGNORECASE)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _put_aside(name: str, attributes: str, in_main: bool, quoted: bool) -> str:
    """Why an element is put aside: for its "tag" or its "name" (a form counts as one, too); empty if it is not."""
    if name in ASIDE and not (in_main and name == "header") and not (quoted and name == "footer"):
        return "name" if name == "form" else "tag"
    if name in WHOLE or name in HEADINGS or "=" not in attributes:
        return ""
    for kind, *values in NAMES.findall(attributes):
        for word in "".join(values).split():
            m = NAMED.fullmatch(word)
            if m and (kind.lower() != "id" or not re.search("[-_]", word)):
                return "name"
    return ""


def _implied(open_: list[tuple[str, int, str]], name: str, loose: int) -> int:
    """Place of the outermost open element that this opening tag ends; the number of open ones if there is none.

    ``loose`` is the number of open elements whose end tag may be left out.
    """
    at, walls = len(open_), set()
    for i in range(len(open_) - 1, -1, -1):
        last = open_[i][0]
        if not loose:
            break
        loose -= last in ENDS
        if last in ENDS and last not in walls and name in ENDS[last]:
            at = i
        walls.update(k for k, v in WALLS.items() if last in v)
        if len(walls) == len(WALLS) or last in WHOLE:
            break
    return at


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag or "", text, inside the main element, in something put aside) of the body's tags and texts.

    A tag is its name, closing ones with a slash before it. Contents of scripts and the like are left out.
    """
    out: list[tuple[str, str, bool]] = []
    #: open elements with the place of their first token and why they are put aside, and what was put aside
    open_: list[tuple[str, int, str]] = []
    spans: list[tuple[int, int, bool]] = []
    main, mains, at, head, quotes, loose = 0, 0, 0, False, 0, 0
    known: dict[str, int] = {}

    def close(first: int, after: int) -> None:
        """End the open elements from ``first`` on, the last ones first."""
        nonlocal main, quotes, loose
        for last, start, why in reversed(open_[first:]):
            if why:
                spans.append((start, after, why == "name"))
            main -= last in MAIN
            quotes -= last == "blockquote"
            loose -= last in ENDS
            known[last] -= 1
        del open_[first:]

    while m := TOKEN.match(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                if not head:
                    out.append(("", m[0], main > 0))
            continue
        if name == "head" or name == "body":
            head = name == "head" and not m[1]
            continue
        if m[1]:
            if known.get(name):
                close(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), len(out))
            out.append(("/" + name, "", main > 0))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in STARTS:
            close(_implied(open_, name, loose), len(out))
        out.append((name, "", main > 0))
        if name not in VOID and not m[3].rstrip().endswith("/"):
            if name in MAIN and not mains:
                # what the first main element stands in by name was no more than a wrapper
                open_ = [(x, start, "" if why == "name" else why) for x, start, why in open_]
            open_.append((name, len(out), _put_aside(name, m[3], main > 0, quotes > 0)))
            main += name in MAIN
            mains += name in MAIN
            quotes += name == "blockquote"
            loose += name in ENDS
            known[name] = known.get(name, 0) + 1
    close(0, len(out))
    return _marked(out, spans, mains > 0)


def _marked(parts: list[tuple[str, str, bool]], spans: list[tuple[int, int, bool]], marked: bool) -> list[tuple[str, str, bool, bool]]:
    """Tokens with what is put aside; where no main element marks the text, what is aside by name and holds the larger part of the words stays."""
    if not spans:
        return [(*part, False) for part in parts]
    upto = list(itertools.accumulate((0 if tag else len(text.split()) for tag, text, _ in parts), initial=0))
    depth = [0] * (len(parts) + 1)
    for start, end, named in spans:
        if marked or not named or 2 * (upto[end] - upto[start]) <= upto[-1]:
            depth[start] += 1
            depth[end] -= 1
    return [(*part, d > 0) for part, d in zip(parts, itertools.accumulate(depth))]


def scores(parts: list[tuple[str, str, bool, bool]], weights: dict[str, float], factor: float) -> list[float]:
    """Scores of the sequence; what is put aside counts for nothing but its first and last tag."""
    return [0.0 if aside else -factor * weights.get(tag, UNSEEN) if tag else float(len(text.split())) for tag, text, _, aside in parts]


def best_region(values: list[float]) -> tuple[int, int]:
    """First and last place, end exclusive, of the contiguous run of largest sum; the earliest and shortest of equals, (0, 0) if none is positive."""
    best, at, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, at, end = total, start, i + 1
    return at, end


def region_text(parts: list[tuple[str, str, bool, bool]]) -> str:
    """Blocks of a region without what is put aside, each with single spaces, joined by one space."""
    blocks, block = [], []
    for tag, text, _, aside in parts:
        if not tag:
            if not aside:
                block.append(text)
        elif tag.lstrip("/") not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def labelled(parts: list[tuple[str, str, bool, bool]]) -> bool:
    return sum(t[0] in MAIN for t in parts) == 1


def agreement(parts: list[tuple[str, str, bool, bool]], weights: dict[str, float], factor: float) -> float:
    """F1 of the words of the best region against those of the main element."""
    at, end = best_region(scores(parts, weights, factor))
    words = [0 if t[0] or t[3] else len(t[1].split()) for t in parts]
    inside = sum(n for n, t in zip(words, parts) if t[2])
    chosen = sum(words[at:end])
    both = sum(n for n, t in zip(words[at:end], parts[at:end]) if t[2])
    return 2 * both / max(inside + chosen, 1)


def fit(pages: DataFrame, *, key: str = "page_id", text: str = "html", sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Weights of tags, counted over all labelled pages, and their common factor."""
    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                parts = tokens(page) if page else []
                if labelled(parts):
                    for tag, _, inside, aside in parts:
                        if tag:
                            seen.setdefault(tag, [0, 0])[not inside or aside or tag.lstrip("/") in MAIN] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                              pa.array([v[1] for v in seen.values()], pa.int64())], names=["tag", "inside", "outside"])

    counts = pages.select(text).mapInArrow(count, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    weights = {r.tag: max(LEAST_WEIGHT, (r.o + 0.5) / (r.i + r.o + 1)) for r in counts.orderBy(F.desc(F.col("i") + F.col("o")), "tag").limit(TAGS).collect()}
    chosen = pages.where(F.col(text).rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"))

    def judge(batches):
        for batch in batches:
            sums = [0.0] * len(FACTORS)
            for page in batch.column("t").to_pylist():
                parts = tokens(page)
                if labelled(parts):
                    sums = [s + agreement(parts, weights, f) for s, f in zip(sums, FACTORS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(FACTORS)), pa.int32()), pa.array(sums, pa.float64())], names=["i", "s"])

    first = chosen.select("h", "k").orderBy("h", "k").limit(sample)
    judged = chosen.join(F.broadcast(first.distinct()), ["h", "k"]).mapInArrow(judge, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    best = max((r.s for r in judged), default=0.0)
    good = sorted(FACTORS[r.i] for r in judged if r.s > 0 and r.s >= best - 1e-6)
    return weights, good[len(good) // 2] if good else 8.0  # the middle one of equals


def extract(pages: DataFrame, weights: dict[str, float], factor: float, *, text: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text as ``out``, and ``out``_score, the region's score; columns of these names are replaced."""
    kept = [f.name for f in pages.schema.fields if f.name not in (out, f"{out}_score")]
    schema = T.StructType([pages.schema[k] for k in kept] + [T.StructField(out, T.StringType(), False), T.StructField(f"{out}_score", T.DoubleType(), False)])

    def run(batches):
        for batch in batches:
            texts, totals = [], []
            for page in batch.column(text).to_pylist():
                parts = tokens(page) if page else []
                values = scores(parts, weights, factor)
                at, end = best_region(values)
                texts.append(region_text(parts[at:end]))
                totals.append(math.fsum(values[at:end]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string()), pa.array(totals, pa.float64())],
                                             names=[*kept, out, f"{out}_score"])

    return pages.mapInArrow(run, schema)
