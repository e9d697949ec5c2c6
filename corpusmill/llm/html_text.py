"""Main text of web pages by tree scoring.

A tolerant tokeniser builds the page's tree. Subtrees that are never article text (navigation, headers and footers of
the page, scripts, hidden parts) are cut off, and so are forms and blocks whose class, id or role names them as such,
unless they hold most of the page's unlinked text (of that in article and main elements, if there is some). Every
paragraph-like block then scores by its length and its commas; the score goes to its parent in full, to its
grandparent by half and on upwards by less, and each container's score is discounted by the share of its text that
stands in links. The best container is kept, and those of its siblings that score well or read like prose.

Defined results: null, empty and text-free pages give an empty string. Unclosed and misnested tags are mended as
browsers do for paragraphs, list items, rows and cells; a tag cut off by the end of the page is dropped. `<br>` is
white space. A page of which nothing is left is read again without cuts by name. Nothing is capped. Repeated pages each
get a row; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
CUT = frozenset(
    "nav footer aside button select option menu dialog object applet canvas audio video figcaption label fieldset".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = BLOCKS - frozenset("html body".split())
CONTAINERS = frozenset("article main section div td body html blockquote center".split())
LEAVES = frozenset(
    "p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 td th caption summary div section article main body center".split()
)
SELF_CLOSING = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))
}
# Words in class, id, role and aria-label that name what is no article text.
UNLIKELY = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|advertorial|banner|sponsor(?:ed)?|promo(?:tion|ted)?|nav(?:bar|igation)?|menu|topbar|toolbar|breadcrumbs?|sidebar|side-bar|widget|rail|footer|masthead|header|site-header|page-header|"
    r"cookies?|consent|gdpr|notice|notices|alert|popup|pop-up|modal|overlay|subscribe|subscription|newsletter|signup|login|paywall|comments?|comment-list|disqus|replies|reply|respond|discussion|"
    r"share|sharing|social|related|recommend(?:ed|ations)?|also-read|read-more|more-stories|outbrain|taboola|trending|popular|tags|tagcloud|pagination|pager|skip-link|copyright|legal|disclaimer|search|form|hidden|complementary|contentinfo|search|dialog)(?=$|[\s_-])"
)
# Words of UNLIKELY that a word of LIKELY beside them outweighs (entry-header); those that name long texts of their own.
WEAK = frozenset("banner masthead header page-header notice notices legal search form hidden tags rail widget".split())
APART = re.compile(r"(?i)comment|disqus|repl(?:y|ies)|respond|discussion|cookie|consent|gdpr|related|recommend|stories")
MODIFIER = re.compile(r"(?i)(?:^|(?<=[\s_-]))(?:no|not|non|has|have|with|without|category|tag)[_-]\S*")
LIKELY = re.compile(r"(?i)(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text|hentry)(?:$|[\s_-])")
#: An attribute as browsers read it: only a value that begins with a quote is quoted, and holds anything but that quote.
#: No part is ever tried again (possessive), so a tag takes time in proportion to its length.
_ATTRIBUTE_TEXT = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
#: A comment, a tag (the last group is empty where the page's end cuts it off), or a declaration.
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE_TEXT})*+)(>?)|<[!?/][^>]*+>?", re.S
)
MOST_DEEP = 250  # elements opened below this depth stand beside each other, so that recursion stays bounded
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+""")
_RAW_END = {x: re.compile(rf"(?i)</{x}(?=[\s/>])") for x in RAW}
# References to numbers of so many digits are no characters; leading zeros say nothing.
_LONG_REFERENCE = re.compile(r"&#0*+[1-9][0-9]{7,}+;?|&#[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+;?")
_LEADING_ZEROS = re.compile(r"(?<=&#)0{2,}+(?=[0-9])|(?<=&#[xX])0{2,}+(?=[0-9a-fA-F])")
_NAMES = frozenset("class id role aria-label itemprop".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("below", "core", "cut", "links", "named", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.below = tag, parent, []
        self.score, self.size, self.links, self.core, self.cut, self.named = 0.0, 0, 0, 0, False, ""


def _attributes(raw: str) -> tuple[str, bool]:
    """(names it goes by, whether it is hidden)."""
    if "=" not in raw and "hidden" not in raw.lower():
        return "", False
    names, hidden = [], False
    seen = set()
    for key, value in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value[1:-1] if value[:1] in ("'", '"') else value
        if key in seen:  # the first of a name counts
            continue
        seen.add(key)
        if key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif key == "hidden":
            hidden |= True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key in _NAMES:
            names.append(value)
    return " ".join(names), hidden


def parse(page: str) -> Node:
    """The page's tree; text is held as strings among a node's children."""
    root = Node("#", None)
    top, at, find = root, 0, _TOKEN.search
    open_tags = ["#"]
    while m := find(page, at):
        if m.start() > at:
            top.below.append(page[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in open_tags:
                while top.tag != name:
                    top = top.parent
                    open_tags.pop()
                top = top.parent
                open_tags.pop()
            elif name in BLOCKS:
                top.below.append(Node("p", top))  # a stray end of a block parts what is around it
            continue
        if name in CLOSED_BY_BLOCK and "p" in open_tags:
            last = len(open_tags) - 1 - open_tags[::-1].index("p")
            if not any(t in ("td", "th", "button", "object") for t in open_tags[last:]):
                while len(open_tags) > last:
                    top = top.parent
                    open_tags.pop()
        if name in SELF_CLOSING:
            same, within = SELF_CLOSING[name]
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k] in within:
                    break
                if open_tags[k] in same.split():
                    while len(open_tags) > k:
                        top = top.parent
                        open_tags.pop()
                    break
        node = Node(name, top)
        names, hidden = _attributes(m[3])
        node.named, node.cut = names, hidden or name in RAW
        top.below.append(node)
        closed = m[3].endswith("/")
        if name in ("svg", "math") and closed:
            continue
        if name in RAW:
            at = _after_raw(page, name, at)
        elif name not in VOID and not closed and len(open_tags) < MOST_DEEP:
            top = node
            open_tags.append(name)
    if at < len(page):
        top.below.append(page[at:])
    return root


def _after_raw(page: str, name: str, at: int) -> int:
    """The place behind the end tag of an element whose content is no markup, or the page's end."""
    m = _RAW_END[name].search(page, at)
    end = page.find(">", m.end()) if m else -1
    return len(page) if end < 0 else end + 1


def _plain(s: str) -> str:
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", _LEADING_ZEROS.sub("", s))) if "&" in s else s


def _prune(node: Node, inside_article: bool) -> None:
    """Marks what is never article text, whatever its name."""
    for x in node.below:
        if isinstance(x, str) or x.cut:
            continue
        if x.tag in CUT or x.tag == "header" and not inside_article:
            x.cut = True
        else:
            _prune(x, inside_article or x.tag in ("article", "main"))


def _unlikely(node: Node) -> list[str]:
    """Words of its names, modifiers (has-sidebar) apart, for which a node is no article text."""
    if not node.named or node.tag in ("html", "body", "article", "main") or not UNLIKELY.search(node.named):
        return []
    words = [m[0].strip("-_ \t\r\n\f").lower() for m in UNLIKELY.finditer(MODIFIER.sub("", node.named))]
    if LIKELY.search(node.named):
        words = [] if node.tag in ("h1", "h2", "h3", "p") else [w for w in words if w not in WEAK]
    return words


def _prune_named(node: Node, root: Node) -> None:
    """Marks forms, and what is named as no article text, but for what holds most of the page's prose."""
    for x in node.below:
        if isinstance(x, str) or x.cut:
            continue
        words = _unlikely(x)
        if words or x.tag == "form":
            own, whole = (x.core, root.core) if root.core else (x.size - x.links, root.size - root.links)
            least = 0.9 if any(APART.search(w) for w in words) else 0.5
            x.cut = not own > least * whole or x.links > 0.5 * x.size
        if not x.cut:
            _prune_named(x, root)


def _measure(node: Node, in_link: bool, in_article: bool = False) -> None:
    """Sizes of text, of linked text and of prose in articles of every node, bottom up."""
    node.size = node.links = node.core = 0
    for x in node.below:
        if isinstance(x, str):
            n = len(x.strip())
            node.size += n
            node.links += n * in_link
            node.core += n * (in_article and not in_link)
        elif not x.cut:
            _measure(
                x, in_link or x.tag == "a",
                in_article or x.tag in ("article", "main") and not UNLIKELY.search(MODIFIER.sub("", x.named))
            )
            node.size += x.size
            node.links += x.links
            node.core += x.core


def _own_blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node in page order, white space joined."""
    run: list[str] = []

    def walk(n: Node) -> Iterator[str]:
        for x in n.below:
            if isinstance(x, str):
                run.append(x)
            elif x.cut:
                continue
            elif x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCKS:
                yield from flush()
                yield from walk(x)
                yield from flush()
            else:
                yield from walk(x)

    def flush() -> Iterator[str]:
        if run:
            text = _SPACE.sub(" ", _plain("".join(run))).strip()
            run.clear()
            if text:
                yield text

    yield from walk(node)
    yield from flush()


def _score(node: Node, found: list[Node]) -> None:
    """Each paragraph passes points for length and commas to its ancestors."""
    own = 0
    commas = 0
    for x in node.below:
        if isinstance(x, str):
            s = x.strip()
            own += len(s)
            commas += s.count(",") + s.count("、") + s.count("，") + s.count("،")
        elif not x.cut:
            if x.tag not in BLOCKS:
                own += x.size
                commas += _commas(x)
            _score(x, found)
    if node.tag in LEAVES and own >= 2:
        points = min(1.0, own / 25) + commas + min(3.0, own / 100)
        holder, share = (node if node.tag in CONTAINERS else node.parent), 1.0
        while holder is not None and share > 0.05:
            if holder.tag in BLOCKS or holder.parent is None:
                if not holder.score:
                    found.append(holder)
                holder.score += points * share
                share = 0.5 if share == 1.0 else share / 2
            holder = holder.parent


def _commas(node: Node) -> int:
    return sum(x.count(",") if isinstance(x, str) else 0 if x.cut or x.tag in BLOCKS else _commas(x) for x in node.below)


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, one a line."""
    return (_article(page, True) or _article(page, False)) if page else ""


def _article(page: str, by_name: bool) -> str:
    """The article, with or without cuts by name."""
    root = parse(page)
    _prune(root, False)
    _measure(root, False)
    if by_name:
        _prune_named(root, root)
        _measure(root, False)
    found: list[Node] = []
    _score(root, found)
    if not found:
        return "\n".join(_own_blocks(root))

    def final(n: Node) -> float:
        bonus = 1.25 if n.tag in ("article", "main") or n.named and LIKELY.search(n.named) else 1.0
        return n.score * bonus * (1 - n.links / max(1, n.size))

    best = max(found, key=final)
    for up in iter(lambda: best.parent, None):  # an article around the best part is the article
        if up.tag in ("article", "main"):
            best = up
            break
        if up.parent is None or up.tag in ("body", "html"):
            break
        if len([x for x in up.below if not isinstance(x, str) and not x.cut and x.size]) > 1 and final(up) < 0.75 * final(best):
            break
        best = up
    if best.tag in ("article", "main") or best.parent is None:
        kept: list[Node] = [best]
        if best.parent is not None:
            kept = [
                x for x in best.parent.below if not isinstance(x, str) and not x.cut and (
                    x is best or x.tag == best.tag and final(x) >= max(10.0, 0.2 * final(best))
                )
            ]
    else:
        least = max(10.0, 0.2 * final(best))
        kept = []
        for x in best.parent.below:
            if isinstance(x, str) or x.cut:
                continue
            prose = x.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and x.size and (x.links / x.size < 0.25)
            if x is best or final(x) >= least or prose:
                kept.append(x)
    return "\n".join(t for x in kept for t in _own_blocks(x))


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
