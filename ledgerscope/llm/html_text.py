"""Main text of web pages by a maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import rows, steps, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article, and words in class, id or role that say so.
ASIDE = frozenset("aside button dialog footer form head header label menu nav option select title".split())
STRONG = "ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|footer|footnav|masthead|menu|modal|nav|navbar|navigation|newsletter|pager|pagination|popup|promo|promoted|promotion|sidebar|signup|sponsor|sponsored|subscribe|toolbar|topbar"
#: Words that say so only by themselves or before one of the words for a part of a page: related-posts, but not related-work.
SOFT = "dialog|form|header|notice|notification|related|replies|reply|respond|search|share|sharing|skip|social|tags|widget"
PARTS = "area|articles?|bar|block|box|buttons?|container|content|icons?|inner|items?|links?|list|media|nav|panel|posts?|section|stories|to|widget|wrap|wrapper"
MARKED = re.compile(rf"(?:^|[\s_-])(?:(?:{STRONG})(?:$|[\s_-])|(?:{SOFT})(?:$|\s|[_-](?:{PARTS})(?:$|[\s_-])))", re.I)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Words that tell what an element goes with, not what it is; and those of the marks that tell readers' comments.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-][^\s]*", re.I)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
#: Blocks that go with the run they touch: of text, and of rows or items.
PROSE = frozenset("blockquote figure h1 h2 h3 h4 h5 h6 p pre".split())
DATA = frozenset("details dl ol table ul".split())
#: What ends an open element of the first kind if it is open inside the innermost of the last.
ENDS = {"li": ({"li"}, {"ol", "ul", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def parse(page: str) -> list[tuple[str, str, bool]]:
    """Tokens (tag name or "" for text, text or "/" for a closing tag, whether inside an excluded element).

    Elements that a class, id or role marks, and forms, are not excluded where they hold
    more words outside links than all that is left otherwise: then they wrap the page's
    content. Comments are so only where nothing is left, hidden elements never. An
    article ends what was left open before it, save a block of comments.
    """
    out: list[tuple[str, str, tuple[int, ...]]] = []
    stack: list[tuple[str, int]] = []
    kinds: list[str] = []
    barred: tuple[int, ...] = ()
    words: dict[tuple[int, ...], int] = {}
    link = False
    for m in TOKEN.finditer(page):
        tag = m["tag"]
        if not tag:
            s = m.group()
            if m["raw"] or s.startswith(("<!", "<?")):
                continue
            out.append(("", s, barred))
            if not link:
                words[barred] = words.get(barred, 0) + len(s.split())
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["close"]
        if m["close"]:
            if any(t == tag for t, _ in stack):
                while True:
                    t, bar = stack.pop()
                    if bar >= 0:
                        barred = tuple(x for x in barred if x != bar)
                    if t == tag:
                        break
            out.append((tag, "/", barred))
            continue
        if tag in ("article", "main", "body"):  # these end whatever was left open before
            stay = {x for x in barred if tag == "article" and kinds[x] == "comment"}
            stack, barred = [x for x in stack if x[1] < 0 or x[1] in stay], tuple(x for x in barred if x in stay)
        if tag not in VOID and not m["rest"].endswith("/"):
            names = MODIFIER.sub(" ", " ".join(x for g in NAMED.findall(m["rest"]) for x in g if x))
            head_of_article = tag == "header" and any(t in ("article", "main") for t, _ in stack)
            kind = "fixed" if tag in ASIDE and tag != "form" and not head_of_article else "wrap" if tag == "form" else ""
            if tag == "article":
                kind = "comment" if COMMENT.search(names) else ""
            elif not kind and tag not in ("html", "body", "main"):
                kind = "fixed" if HIDDEN.search(m["rest"]) else "comment" if COMMENT.search(names) else "wrap" if MARKED.search(names) else ""
            elif kind == "wrap":
                kind = "fixed" if HIDDEN.search(m["rest"]) else "comment" if COMMENT.search(names) else kind
            stack.append((tag, len(kinds) if kind else -1))
            if kind:
                barred += (len(kinds),)
                kinds.append(kind)
        out.append((tag, "", barred))
    free: set[int] = set()
    for kind in ("wrap", "comment"):
        while True:
            left: dict[tuple[int, ...], int] = {}
            for bars, n in words.items():
                rest = tuple(x for x in bars if x not in free)
                left[rest] = left.get(rest, 0) + n
            kept = left.pop((), 0)
            may = [(n, bars) for bars, n in left.items() if n > kept and all(kinds[x] in ("wrap", kind) for x in bars)]
            if not may or kind == "comment" and kept:
                break
            free.update(max(may, key=lambda x: x[0])[1])
    return [(tag, s, not free.issuperset(bars)) for tag, s, bars in out]


def features(tokens: list[tuple[str, str, bool]]) -> list[tuple[str, int]]:
    """Feature name and count of each token: words by their nearest block, tags by name; nothing in excluded elements."""
    out, block = [], "body"
    for tag, s, barred in tokens:
        if tag and tag in BLOCKS:
            block = tag if s != "/" else "after"
        if barred:
            out.append(("", 0))
        else:
            out.append((f"tag:{tag}", 1) if tag else (f"word:{block}", len(s.split())))
    return out


def label_counts(page: str) -> dict[str, list[int]] | None:
    """Counts of each feature [outside, inside] the labelled content; None for a page without such a label."""
    tokens = parse(page)
    if not any(t in ("article", "main") for t, _, _ in tokens):
        return None
    counts: dict[str, list[int]] = {}
    depth = 0
    for (tag, s, _), (name, n) in zip(tokens, features(tokens), strict=True):
        if tag in ("article", "main"):
            depth = max(0, depth + (1 if s != "/" else -1))
        counts.setdefault(name, [0, 0])[depth > 0] += n
    return counts


def fit_weights(pages: DataFrame, sample_rows: int = 2000, most: float = 4.0, names: int = 500) -> dict[str, float]:
    """Weights from labelled pages: those that mark their content with article or main.

    About sample_rows pages, drawn from all partitions, are read, and weights are fitted for the
    names features that occur most in them; both bound the fit and not results.
    A feature's weight is its smoothed log odds; words weigh at least 0.2 and tags at
    most -0.02. What lies in excluded elements counts nothing. Without labelled pages
    the defaults of score_of() hold.
    """

    def run(batches):
        for batch, raw in steps(batches, "html"):
            sums: dict[str, list[int]] = {}
            for t in raw:
                for k, (a, b) in (label_counts(t.decode("utf-8", "replace")) or {}).items():
                    x = sums.setdefault(k, [0, 0])
                    x[0] += a
                    x[1] += b
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["name", "outside", "inside"])

    n = pages.count()
    drawn = pages.sample(min(1.0, sample_rows / max(n, 1)), seed=5) if n > sample_rows else pages
    labelled = drawn.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("html")
    counts = labelled.mapInArrow(run, "name string, outside bigint, inside bigint").groupBy("name").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i"))
    found = counts.orderBy(F.desc(F.col("o") + F.col("i")), "name").limit(names).collect()
    out = {}
    for kind in ("word:", "tag:"):
        own = [r for r in found if r["name"].startswith(kind)]
        o, i = sum(r["o"] for r in own) + len(own), sum(r["i"] for r in own) + len(own)
        for r in own:
            w = max(-most, min(most, math.log((r["i"] + 1) / i) - math.log((r["o"] + 1) / o)))
            out[r["name"]] = max(w, 0.2) if kind == "word:" else min(w, -0.02)
    return out


def score_of(name: str, weights: dict[str, float]) -> float:
    if name in weights:
        return weights[name]
    return 0.0 if not name else 0.5 if name.startswith("word:") else -0.02 if name[4:] in ("p", "b", "br", "i", "em", "strong", "span", "h1", "h2", "h3") else -0.3


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum, the first of equals; (0, 0) if none."""
    best, start, end, total, since = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, since = 0.0, k
        total += s
        if total > best:
            best, start, end = total, since, k + 1
    return start, end


class Part:
    """An element's place among the tokens, its parts, and its words outside excluded elements, all and those in links."""

    __slots__ = ("barred", "cells", "end", "linked", "parts", "start", "tag", "words")

    def __init__(self, tag: str, start: int, barred: bool) -> None:
        self.tag, self.start, self.end, self.barred = tag, start, start + 1, barred
        self.parts: list[Part] = []
        self.words = self.linked = 0
        self.cells = True  # no division or table lies inside

    def goes_along(self) -> bool:
        """Whether the run takes the block in whole: prose, or rows or items that hold no divisions, and mostly not links."""
        return not self.barred and self.words > 2 * self.linked and (self.tag in PROSE or self.tag in DATA and self.cells)


def parts_of(tokens: list[tuple[str, str, bool]]) -> Part:
    """The page as a tree of its blocks; text and other tags count for the block they lie in."""
    page = Part("", 0, False)
    page.end = len(tokens)
    stack, link = [page], False

    def shut(at: int) -> None:
        done = stack.pop()
        done.end = at
        up = stack[-1]
        up.words += done.words
        up.linked += done.linked
        up.cells &= done.cells and done.tag not in ("article", "div", "form", "main", "section", "table")

    for k, (tag, s, barred) in enumerate(tokens):
        if not tag:
            if not barred:
                n = len(s.split())
                stack[-1].words += n
                stack[-1].linked += n * link
        elif tag == "a":
            link = s != "/"
        elif tag in BLOCKS and tag not in VOID:
            if s == "/":
                if any(x.tag == tag for x in stack[1:]):
                    while stack[-1].tag != tag:
                        shut(k)
                    shut(k + 1)
                continue
            if stack[-1].tag == "p":
                shut(k)
            if tag in ENDS:
                ended, inside = ENDS[tag]
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag in ended or stack[d].tag in inside), 0)
                while depth and len(stack) > depth and stack[depth].tag in ended:
                    shut(k)
            new = Part(tag, k, barred)
            stack[-1].parts.append(new)
            stack.append(new)
    while len(stack) > 1:
        shut(len(tokens))
    return page


def with_neighbours(tokens: list[tuple[str, str, bool]], start: int, end: int) -> tuple[int, int]:
    """The run with the blocks that it cuts or touches: text, tables and lists whose short cells and items end the run of largest sum.

    A block that goes along is taken whole, also beyond excluded elements and blocks
    without words between it and the run. A run that holds all words of the element
    around it goes on at that element's neighbours.
    """
    if start >= end:
        return start, end
    page = parts_of(tokens)
    path = [page]
    while inner := next((x for x in path[-1].parts if x.start <= start and x.end >= end), None):
        path.append(inner)
    along = next((k for k, x in enumerate(path) if x.goes_along()), len(path))
    if along < len(path):
        start, end = path[along].start, path[along].end
    said = [k for k, (tag, text, barred) in enumerate(tokens) if not tag and not barred and text.strip()]
    silent = lambda a, b: bisect_left(said, a) == bisect_left(said, b)  # noqa: E731  no word from a to b
    for own in reversed(path[:along]):
        todo = [x for x in own.parts if x.end > start and x.start < end]
        while todo:  # blocks that the run begins or ends in
            x = todo.pop()
            if x.end <= start or x.start >= end or x.start >= start and x.end <= end:
                continue
            if x.goes_along():
                start, end = min(start, x.start), max(end, x.end)
            else:
                todo += x.parts
        for x in own.parts:
            if x.start >= end and x.goes_along():
                if not silent(end, x.start):
                    break
                end = x.end
        for x in reversed(own.parts):
            if x.end <= start and x.goes_along():
                if not silent(x.end, start):
                    break
                start = x.start
        if own.tag in ("td", "th") or not silent(own.start, start) or not silent(end, own.end):
            break
        start, end = own.start, own.end
    return start, end


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best run and of what goes along with it, outside excluded elements, joined by two line feeds."""
    tokens = parse(page)
    scores = [n * score_of(name, weights) for name, n in features(tokens)]
    start, end = with_neighbours(tokens, *best_run(scores))
    blocks, now = [], []
    for tag, s, barred in tokens[start:end]:
        if not tag:
            if not barred:
                now.append(s)
        elif tag in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif tag in ("br", "img"):
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Rows (page_id, url, text, n_chars) with the main text of every whole page.

    A null, empty or contentless html gives an empty text. Broken markup is read as far
    as it goes. Repeated rows are extracted each; other columns are ignored; an empty
    table gives no rows.
    """
    weights = fit_weights(pages, sample_rows) if weights is None else weights

    def run(batches):
        for batch, raw in steps(batches, "html"):
            found = [main_text(t.decode("utf-8", "replace"), weights) for t in raw]
            yield rows(batch, ["page_id", "url"], text=pa.array(found, pa.string()), n_chars=pa.array([len(x) for x in found], pa.int64()))

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
