"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import table

# Frequent function words of six languages. Another list can be given.
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with on be by this are from at or not which an have but they has were you"
    " der die und das ist nicht ein eine zu den von mit sich auf für dem des im auch als es sie er wir werden bei war"
    " le la les de des du et un une est que qui dans pour pas sur au avec il elle ce par ne en se sont plus cette ou"
    " el los las y que en un una es por con para del se no al lo su como más pero sus ha fue este"
    " il di che e la per un una non sono del con si come da più dei gli della nel alla"
    " o os e do da em um uma para com não se por mais dos na no ao foi".split()
)
# A block of fewer characters is short; a block of more is long.
SHORT, LONG = 70, 200
# Stop words per word from which a block reads as prose, and below which a block reads as something else.
PROSE, LISTS = 0.2, 0.1
# Characters in links per character above which a block is navigation: anywhere, and inside an article.
LINKED, LINKED_INSIDE = 0.33, 0.5
# Text outside of articles must be so many times longer than theirs to count when a page has articles.
OUTWEIGH = 3

# Elements whose content is raw text and is dropped, dropped elements, void elements, and those that end a line.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form noscript template svg math object canvas audio video select button dialog menu datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends these open ones, if they are nearer than the stop.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "body": ({"head"}, set()),
}
# Words of class, id and role attributes that name a part that is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscri\w*"
    r"|signup|login|sidebar|complementary|menu|nav|navbar|navigation|breadcrumbs?|toolbar|footer|contentinfo|comments?|commentlist|disqus|respond|repl(?:y|ies)"
    r"|shar(?:e|ing)|social|related|recommend\w*|trending|widget|pagination|pager|search|copyright|skip|visually-hidden|sr-only)(?:$|[^a-z])"
)
HEADER = re.compile(r"(?:^|[^a-z])(?:header|masthead)(?:$|[^a-z])")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none)""", re.I)

MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?=/?[a-zA-Z]))""", re.S
)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text between block boundaries, with what the rules ask about it."""

    text: str
    heading: bool
    article: int  # number of the article or main element it lies in, 0 outside
    n: int = field(init=False)
    linked: float = 0.0
    stops: float = 0.0  # asked of blocks that are not short

    def __post_init__(self):
        self.n = len(self.text)


def _dropped(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element and all it holds are no part of the article, by its tag and attributes alone."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if HIDDEN.search(attrs):
        return True
    words = " ".join(m.strip("\"'") for m in NAMES.findall(attrs))
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", words).lower()
    return bool(NOT_ARTICLE.search(words)) or (not inside and bool(HEADER.search(words)))


def blocks(page: str, stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """Text blocks of a page in order, without what tags and attributes mark as no article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, dropped, article
    parts: list[str] = []
    # link: open elements around an open link; dropped: whether the open paragraph is dropped; within: whether the link began in it
    state = {"linked": 0, "heading": False, "link": None, "within": False, "breaks": 0, "paragraph": False, "dropped": False, "articles": 0}

    def here() -> tuple[bool, int]:
        return (stack[-1][1] or state["dropped"], stack[-1][2]) if stack else (state["dropped"], 0)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                b = Block(text, state["heading"], here()[1])
                b.linked = min(state["linked"] / b.n, 1.0)
                words = LETTERS.findall(text.lower()) if b.n >= SHORT else ()
                b.stops = sum(map(stop_words.__contains__, words)) / len(words) if words else 0.0
                out.append(b)
            parts.clear()
        state["linked"] = state["breaks"] = 0

    def add(raw: str) -> None:
        if raw and not here()[0]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                state["breaks"] = 0
                if state["link"] is not None:
                    state["linked"] += len(" ".join(text.split()))

    def close(to: int) -> None:
        del stack[to:]
        if state["link"] is not None and state["link"] > to:
            state["link"] = None

    at, careful, size = 0, True, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name, attrs = m.group(1), m.group(2)
        ending = page.startswith("</", m.start())
        if m.end() == m.start() + 1:  # a tag whose quotes do not close: it ends at the next >
            stop = page.find(">", at)
            if stop < 0:
                break
            tag = re.match(r"/?([a-zA-Z][^\s/>]*)", page[at : min(stop, at + 80)])
            name, attrs, at = tag.group(1), page[at + tag.end() : stop], stop + 1
            careful = False
        elif not name:
            continue
        if not careful and m.group(1) and "<" in attrs:  # after one such tag quotes are not trusted
            at = page.find(">", m.start()) + 1
            attrs = page[m.start(2) : at - 1]
        name = name.lower()
        if name in RAW and not ending:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 if end else 0) or size
            continue
        if name == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                flush()
            else:
                parts.append("\n")
            continue
        if name == "hr":
            flush()
            state["paragraph"] = state["dropped"] = False
            continue
        if name == "a":
            state["link"], state["within"] = None if ending else len(stack), state["paragraph"]
            continue
        if name not in BLOCKS and name not in DROPPED:
            continue
        flush()
        if state["within"] and state["link"] is not None:  # a link does not outlive its paragraph
            state["link"] = None
        state["paragraph"] = state["dropped"] = state["heading"] = False
        if name == "p":
            if not ending:
                state["paragraph"] = True
                state["dropped"] = bool(attrs) and _dropped(name, attrs, here()[1] > 0)
            continue
        if ending:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is not None:
                close(i)
            continue
        if name in IMPLIED:
            ended, stops = IMPLIED[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ended:
                    close(i)
                    break
        if attrs.rstrip().endswith("/") and name in ("svg", "math", "object", "canvas"):
            continue
        gone, article = stack[-1][1:] if stack else (False, 0)
        if name == "main" and gone and not any(n in DROPPED for n, *_ in stack):
            gone = False
        gone = gone or _dropped(name, attrs, article > 0)
        if name in ("article", "main") and not gone and not article:
            state["articles"] += 1
            article = state["articles"]
        stack.append((name, gone, article))
        state["heading"] = name in HEADINGS
    flush()
    return out


def decide(found: list[Block]) -> list[bool | None]:
    """First pass: True for article text, False for other text, None for blocks that do not say.

    The stop-word rule holds only on pages where a long block reads as prose: other pages are in a language without list.
    Inside an article element, text that is not mostly links is article text when it is long or reads as prose.
    """
    known = any(b.n >= SHORT and b.stops >= PROSE and b.linked <= LINKED for b in found)
    prose, lists = (PROSE, LISTS) if known else (0.0, 0.0)
    out: list[bool | None] = []
    for b in found:
        if b.article:
            if b.linked > LINKED_INSIDE and b.n < LONG:
                out.append(False)
            else:
                out.append(True if not b.heading and b.n >= SHORT and (b.n >= LONG or b.stops >= lists) else None)
        elif b.linked > LINKED:
            out.append(False)
        elif b.heading or b.n < SHORT:
            out.append(None)
        elif b.stops >= prose or (b.stops >= lists and b.n >= LONG):
            out.append(True)
        else:
            out.append(None if b.stops >= lists else False)
    return out


def inherit(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Second pass: blocks without label take that of the nearest block that has one, in the same article or outside of all.

    In an article they stay unless both nearest ones are other text. Outside, of two at the same distance a heading
    takes the later and any other block the earlier; where none is decided they stay.
    """
    n = len(found)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            side[i] = last.get(found[i].article)
            if labels[i] is not None:
                last[found[i].article] = i
    out = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        x, y = before[i], after[i]
        if label is not None:
            out.append(label)
        elif b.article:
            out.append(x is None or y is None or labels[x] or labels[y])
        elif x is None or y is None:
            out.append(labels[y if x is None else x] if (x, y) != (None, None) else True)
        else:
            later = y - i < i - x or (y - i == i - x and b.heading)
            out.append(labels[y if later else x])
    return out


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The article of a page: its blocks in order, one per line. Null and empty pages give an empty text."""
    found = blocks(page or "", stop_words)
    kept = [b for b, k in zip(found, inherit(found, decide(found)), strict=True) if k]
    inside = [b for b in kept if b.article]
    outside = sum(b.n for b in kept) - sum(b.n for b in inside)
    if inside and outside < OUTWEIGH * sum(b.n for b in inside):
        kept = inside
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "text", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``pages`` with the column ``out``: the main text of each page.

    One row per row, other columns as they are, so repeated rows and null ids stay; a column that has the name of ``out`` is
    replaced. Null and empty pages give an empty text, an empty table gives no rows. Rows are independent: nothing is shuffled.
    """
    names = [c for c in pages.columns if c != out]
    keep = [f"`{c}`" for c in names]
    at = names.index(html_col) if html_col in names else len(names)
    source = pages.select(*keep, *([] if html_col in names else [F.col(f"`{html_col}`")]))
    schema = pages.select(*keep).schema.add(out, "string")

    def run(batches):
        for b in batches:
            # a slice holds some megabytes, however long pages are
            texts, size, start = [], 0, 0
            for i, page in enumerate(b.column(at)):
                page = page.as_py()
                texts.append(main_text(page, stop_words))
                size += len(page or "")
                if size > 8_000_000 or i + 1 == b.num_rows:
                    part = b.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, out])
                    texts, size, start = [], 0, i + 1

    return source.mapInArrow(run, schema)


def op11_html_text(spark, sf: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
