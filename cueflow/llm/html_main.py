"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and of text runs. A word scores by where it stands, a tag costs by its
name; the weights are log odds of standing in the content, counted over all labelled pages: those
that mark their content with an article or main element. One linear scan finds the contiguous region
of the highest sum. The region is then rounded to the element it lies in, and parts of it that are
menus, adverts, notices, comments and the like by their tags or names are left out.

Text is cut into blocks at block-level tags; a line break counts as white space. White space is
what Unicode says it is, so a no-break space is one.

Defined results: a null, empty or textless page has an empty text; unclosed and stray tags are
tolerated; repeated rows give repeated results; an empty table gives no rows; without labelled
pages the weights are the priors; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.registry import query

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?", re.S)
NAMES = re.compile(r"""(?:\s|^)(?:class|id|role|aria-label|data-[\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE_TAGS = set("nav header footer aside form button select dialog menu head search fieldset label input datalist audio video".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar side aside rail footer header masthead topbar cookie cookies consent gdpr notice notices alert banner banners disclaimer comment comments commentlist respond reply"
    " replies disqus discussion feedback share sharing social related recommended recommendations newsletter subscribe subscription signup signin login register"
    " modal popup overlay widget widgets pagination pager toolbar search complementary contentinfo skip tags toc".split()
)
CONTENT = {"article", "main"}
PRIOR_WORD, PRIOR_TAG, LEAST = 1.0, 0.5, 0.1


def aside(tag: str, attributes: str) -> bool:
    """Does the element hold no content, by its tag or its names?"""
    if tag in ASIDE_TAGS:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in NAMES.finditer(attributes):
        for word in re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()):
            if word in ASIDE_NAMES:
                return True
    return False


class Page:
    """Steps of a page: tags with their cost's name, text runs with their words and place."""

    def __init__(self, source: str):
        self.steps: list[tuple[str, int, int]] = []  # name, words, run (-1 for a tag)
        self.runs: list[tuple[str, int, tuple[int, ...], bool, bool]] = []  # text, block, path, aside, in labelled content
        self.labelled = False
        self.tags = [""]  # by element id
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, id, aside, content
        self.block = self.last_id = 0
        at = 0
        raw = ""
        for m in TAG.finditer(source):
            if raw:
                name = (m[2] or m[5] or "").lower()
                if name != raw or not (m[1] or m[4]):
                    continue
            elif m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            self.steps.append((f"/{name}" if raw or m[1] or m[4] else name, 0, -1))
            if raw:
                raw = ""
            elif m[1] or m[4]:
                self.close(name)
            elif name in RAW:
                # Its content is no text; without an end tag it ends the page, as in a browser.
                raw = name if not (m[3] or m[6] or "").rstrip().endswith("/") else ""
            else:
                self.open(name, m[3] or m[6] or "")
        if at < len(source) and not raw:
            rest = source[at:]
            # A tag that never ends is no text.
            cut = re.search(r"<[a-zA-Z/!]", rest)
            self.text(rest[: cut.start()] if cut else rest)

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        if tag in BLOCK:
            self.block += 1
            if any(t == "p" for t, *_ in self.stack):
                self.pop({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self.pop(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        up = self.stack[-1] if self.stack else ("", 0, False, False)
        self.last_id += 1
        self.tags.append(tag)
        self.labelled |= tag in CONTENT
        self.stack.append((tag, self.last_id, up[2] or aside(tag, attributes), up[3] or tag in CONTENT))

    def pop(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost of ``tags`` that isn't beyond an element of ``stop``."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        if any(t == tag for t, *_ in self.stack):
            self.pop({tag}, BLOCK - {tag} if tag not in BLOCK else set())

    def text(self, raw: str) -> None:
        words = len(raw.split())
        if not words and not raw:
            return
        tag = next((t for t, *_ in reversed(self.stack) if t in BLOCK), "body")
        out = bool(self.stack) and self.stack[-1][2]
        link = any(t == "a" for t, *_ in self.stack)
        name = "word:" + ("aside" if out else tag) + (":a" if link else "")
        self.steps.append((name, words, len(self.runs)))
        self.runs.append((raw, self.block, tuple(i for _, i, *_ in self.stack), out, bool(self.stack) and self.stack[-1][3]))


def counts(source: str) -> Counter:
    """How often words and tags of each name stand in and out of the content of a labelled page."""
    page, out, inside = Page(source), Counter(), False
    if not page.labelled:
        return out
    depth = 0
    for name, words, run in page.steps:
        if run >= 0:
            out[name, page.runs[run][4] and not page.runs[run][3]] += words
        elif name in CONTENT or name[1:] in CONTENT:
            depth = max(0, depth + (-1 if name[0] == "/" else 1))
            inside = depth > 0
        else:
            out[name, inside] += 1
    return out


def weigh(rows: list[tuple[str, bool, int]]) -> dict[str, float]:
    """Log odds per name; words outside asides are positive, all else negative."""
    total = Counter()
    for name, inside, n in rows:
        total[name.startswith("word:"), inside] += n
    by = Counter()
    for name, inside, n in rows:
        by[name, inside] += n
    out = {}
    for name in {name for name, _, _ in rows}:
        word = name.startswith("word:")
        odds = math.log((by[name, True] + 1) / (total[word, True] + 2)) - math.log((by[name, False] + 1) / (total[word, False] + 2))
        if word:
            out[name] = min(-LEAST, odds) if name.startswith("word:aside") else max(LEAST, odds)
        else:
            out[name] = -min(5.0, max(LEAST, PRIOR_TAG - odds))
    return out


def best_region(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """First and last text run of the contiguous steps of the highest sum (1, 0 if there is none)."""
    best, total, begin, found = 0.0, 0.0, 0, (1, 0)
    for k, (name, words, run) in enumerate(page.steps):
        if total <= 0:
            total, begin = 0.0, k
        if run < 0:
            total += weights.get(name, -PRIOR_TAG)
        else:
            total += words * weights.get(name, -PRIOR_WORD if name.startswith("word:aside") else PRIOR_WORD)
            if total > best:
                best, found = total, (begin, k)
    runs = [run for _, _, run in page.steps[found[0] : found[1] + 1] if run >= 0]
    return (runs[0], runs[-1]) if runs else (1, 0)


def main_text(source: str, weights: dict[str, float]) -> str:
    page = Page(source)
    a, b = best_region(page, weights)
    chosen = [r for r in page.runs[a : b + 1] if not r[3] and r[0].strip()]
    if not chosen:
        return ""
    path = chosen[0][2]
    for r in chosen:
        n = 0
        while n < min(len(path), len(r[2])) and path[n] == r[2][n]:
            n += 1
        path = path[:n]
    # Rounded to the innermost element around the region below the body: it holds all of the content.
    if path and page.tags[path[-1]] not in ("html", "body"):
        chosen = [r for r in page.runs if r[2][: len(path)] == path and not r[3]]
    else:
        chosen = [r for r in page.runs[a : b + 1] if not r[3]]
    blocks: dict[int, list[str]] = {}
    for text, block, *_ in chosen:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages. Names are few: a tag's, or a block tag's for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for (name, inside), n in counts(source or "").items():
                    base = name.lstrip("/").split(":")[0]
                    known = base == "word" or base in BLOCK or base in RAW or base in VOID or base in ("a", "b", "i", "em", "strong", "span", "u", "small", "code")
                    total[name if known else "other", inside] += n
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([bool(k[1]) for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["name", "inside", "n"])

    got = pages.select(column).mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    return weigh([(r["name"], r["inside"], r["n"]) for r in got.collect()])


def extract(pages: DataFrame, weights: dict[str, float], column: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with their main text in place of the markup; no shuffle."""
    keep = [c for c in pages.columns if c not in (column, text)]
    schema = pages.select(*keep, F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = [main_text(x or "", weights) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(got, pa.string())], names=[*keep, text])

    return pages.select(*keep, column).mapInArrow(run, schema)


@query("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
