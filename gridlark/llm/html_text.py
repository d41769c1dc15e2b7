"""Main text of web pages by tree scoring.

A page becomes a tree of elements. What can't be the article (menus, forms, scripts, comments of readers and the like) is
cut off by its tag, role or class. Every paragraph gives points for its length and its commas to the elements above it,
fewer the higher they are; an element's sum is discounted by the share of its text that stands in links. The best
element is taken with those of its siblings that look like parts of the same article. If the page itself marks an
article around the best element, that one is the container.

Each page is read on its own, where Spark has put it: there is no shuffle. Trees are walked without recursion, in time
that grows with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.support import slices

# Elements without an end tag, elements that are never text of an article, inline elements, elements that
# end an open paragraph's scope, and which open elements a start tag ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set(
    "script style noscript template head title nav footer aside form button input select option textarea label fieldset "
    "iframe object embed applet canvas svg math audio video map menu dialog".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Names in classes and ids that tell what an element is. The first always tell, the second only where
# none of the third stands beside them.
OUTSIDE = set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion banner "
    "comment comments commentlist disqus discussion replies reply respond responses nav navbar navigation navi menu menus "
    "sidebar sidebars cookie cookies consent gdpr notice notices notification notifications alert popup popups modal overlay "
    "newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager footer foot copyright disclaimer skip toolbar widget widgets masthead paywall "
    "outbrain taboola".split()
)
PERHAPS = set("header top bottom side aside extra meta tags tools links community feedback rating secondary search topbar hidden".split())
INSIDE = set("article body column content main post entry story text".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
COMMAS = re.compile("[,،﹐，、﹑]")
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--|[!?/]))")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|(?!["'])[^\s>]+)|(?!\s*=\s*["']))""")
SPACE = re.compile(r"[\s/]*")
COMMENT_END = re.compile("--!?>")
RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in "script style textarea title xmp iframe noembed noframes".split()}
READ = {"class", "id", "role", "hidden", "aria-hidden", "style"}
P_SCOPE = ("td", "th", "button", "object", "caption")
NAMES = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PARAGRAPHS = set("p pre li td th dd dt blockquote figcaption".split())
#: Points are passed on from blocks of so many characters, with one more for each hundred, up to three, and to so many levels.
SCORED, PER_POINT, MOST_POINTS, LEVELS = 25, 100, 3, 6
#: A sibling joins from this share of the best score, or as a paragraph with few links.
SIBLING_SHARE, LEAST_SCORE, FEW_LINKS = 0.2, 10.0, 0.25


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "score", "length", "linked")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.score = 0.0
        self.length = self.linked = 0


class Tree:
    """Elements and texts of a page in one pass; end tags that are left out are put where HTML has them.

    The depths at which each tag is open tell at once whether an end tag has a start tag in its scope.
    """

    def __init__(self):
        self.stack = [Element("#page", {}, None)]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    def text(self, data: str) -> None:
        self.stack[-1].children.append(unescape(data) if "&" in data else data)

    def _innermost(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag not in INLINE:
            if self.depths.get("p") and self._innermost(P_SCOPE) < self.depths["p"][-1]:
                self._close(self.depths["p"][-1])
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._close(len(self.stack) - 1)
            if ended := ENDED_BY.get(tag):
                # all of them that are open in the element that holds them
                held = self._innermost(HOLDS[tag])
                outermost = [next((d for d in self.depths[t] if d > held), None) for t in ended if self.depths.get(t) and self.depths[t][-1] > held]
                if outermost:
                    self._close(min(outermost))
            if tag in ("body", "article", "main") and self.depths.get("head"):
                self._close(self.depths["head"][-1])
        element = Element(tag, attributes, self.stack[-1])
        self.stack[-1].children.append(element)
        if tag not in VOID:
            depth = len(self.stack)
            self.depths.setdefault(tag, []).append(depth)
            if tag not in INLINE:
                self.blocks.append(depth)
            self.stack.append(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif open_at := self.depths.get(tag):
            if tag not in INLINE or open_at[-1] > self.blocks[-1]:  # an inline end tag never closes a block
                self._close(open_at[-1])


def parse(html: str) -> Element:
    """The root of a page's tree. What HTML leaves open at the end of a page (a comment, a tag, a script) goes."""
    tree, at = Tree(), 0
    while found := MARKUP.search(html, at):
        if found.start() > at:
            tree.text(html[at : found.start()])
        at, (slash, tag, mark) = found.end(), found.groups()
        if tag is None:  # comments and declarations
            if mark == "!--":
                close = COMMENT_END.search(html, at - 2) if html.startswith((">", "->"), at) else COMMENT_END.search(html, at)
                at = close.end() if close else len(html)
            else:
                at = html.find(">", at) + 1 or len(html)
            continue
        tag, attributes = tag.lower(), {}
        if not html.startswith(">", at):
            while attribute := ATTRIBUTE.match(html, at):
                at = attribute.end()
                name, value = attribute.groups()
                if (name := name.lower()) in READ:
                    attributes.setdefault(name, unescape((value or "").strip("\"'")))
            at = SPACE.match(html, at).end()
            if not html.startswith(">", at):  # a value without its closing quote runs to the end
                return tree.stack[0]
        at += 1
        if slash:
            tree.end(tag)
            continue
        tree.start(tag, attributes)
        if tag in RAW:
            close = RAW[tag].search(html, at)
            at = close.start() if close else len(html)
    if at < len(html):
        tree.text(html[at:])
    return tree.stack[0]


def _names(element: Element) -> set[str]:
    told = f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}"
    return {n.lower() for n in NAMES.findall(told)} if told != " " else set()


def _outside(element: Element, marked: set[Element], inside: bool) -> bool:
    """Whether the element can't be part of an article; one that holds a marked article always can."""
    tag, attributes = element.tag, element.attributes
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main", "article", "#page") and not (tag == "article" and _names(element) & OUTSIDE):
        return False
    if tag == "header":  # an article's own one has its title
        return not inside
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if element in marked:
        return False
    if attributes.get("role", "").lower() in ROLES:
        return True
    names = _names(element)
    return bool(names & OUTSIDE) or bool(names & PERHAPS) and not names & INSIDE


def _around_articles(root: Element) -> set[Element]:
    """Elements that hold an article or main element which is not itself outside."""
    held = set()
    for element in _articles(root):
        above = element.parent if not _names(element) & OUTSIDE else None
        while above is not None and above not in held:
            held.add(above)
            above = above.parent
    return held


def _prune(root: Element) -> None:
    marked, stack = _around_articles(root), [(root, False)]
    while stack:
        element, inside = stack.pop()
        inside = inside or element.tag in ("article", "main")
        element.children = [c for c in element.children if isinstance(c, str) or not _outside(c, marked, inside)]
        stack += [(c, inside) for c in element.children if isinstance(c, Element)]


def _blocks(root: Element) -> Iterator[tuple[Element, str, int]]:
    """Runs of inline text in page order, white space folded: (block element, text, characters in links).

    A line break, and every element that isn't inline, ends a run.
    """
    stack: list[tuple] = [(root, root, 0, False)]
    run: list[str] = []
    owner, linked = root, 0

    def ended():
        text = " ".join("".join(run).split())
        run.clear()
        return text

    while stack:
        item, block, in_link, leaving = stack.pop()
        if isinstance(item, str):
            owner = block
            run.append(item)
            linked += len(item) if in_link else 0
        elif leaving or item.tag in ("br", "hr"):
            if text := ended():
                yield owner, text, min(linked, len(text))
            linked = 0
        else:
            inline = item.tag in INLINE
            if not inline:
                if text := ended():
                    yield owner, text, min(linked, len(text))
                linked, block = 0, item
                stack.append((item, block, 0, True))
            in_link = in_link or item.tag == "a"
            stack += [(c, block, in_link, False) for c in reversed(item.children)]
    if text := ended():
        yield owner, text, min(linked, len(text))


def _score(root: Element) -> list[Element]:
    """Points of every block passed on to the elements above it; the elements that got some. Also sums up text lengths."""
    scored = {}
    for block, text, linked in _blocks(root):
        block.length += len(text)
        block.linked += linked
        if len(text) < SCORED:
            continue
        points = 1 + len(COMMAS.findall(text)) + min(len(text) // PER_POINT, MOST_POINTS)
        own = block.tag in PARAGRAPHS or block.tag in HEADINGS
        above, level = (block.parent if own else block), 0
        while above is not None and level < LEVELS:
            above.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[above] = None
            above, level = above.parent, level + 1
    order = [root]
    for element in order:
        order += [c for c in element.children if isinstance(c, Element)]
    for element in reversed(order[1:]):
        element.parent.length += element.length
        element.parent.linked += element.linked
    return list(scored)


def _density(element: Element) -> float:
    return element.linked / element.length if element.length else 0.0


def _has_heading(element: Element) -> bool:
    stack = [element]
    while stack:
        one = stack.pop()
        if one.tag in HEADINGS:
            return True
        stack += [c for c in one.children if isinstance(c, Element)]
    return False


def _parts(root: Element) -> list[Element | str]:
    """The best container and the siblings that belong to it, in page order."""
    candidates = [e for e in _score(root) if e.tag not in ("#page", "html")]
    marked = [e for e in _articles(root) if e.length]
    if not candidates:
        return marked[:1] or [root]
    value = {e: e.score * (1 - _density(e)) for e in candidates}
    best = max(candidates, key=value.__getitem__)  # the first of equals
    above, container = best, None
    while above is not None and (container is None or container.tag == "main"):
        if above.tag == "article" or above.tag == "main" and container is None:
            container = above
        above = above.parent
    if container is not None:  # the innermost article, or else main element, around the best one
        return [container]
    while best.parent is not None and (value.get(best.parent, 0) > value[best] or best.parent.length == best.length):
        best = best.parent
        value.setdefault(best, 0.0)
    if best.parent is None or best.tag in ("body", "html", "#page"):
        return [best]
    limit = max(LEAST_SCORE, SIBLING_SHARE * value[best])
    parts, before = [], True
    for sibling in best.parent.children:
        if sibling is best:
            before = False
            parts.append(sibling)
        elif isinstance(sibling, Element) and sibling.length and _density(sibling) < FEW_LINKS:
            if value.get(sibling, 0) >= limit or sibling.tag == "p" or before and _has_heading(sibling):
                parts.append(sibling)
    return parts


def _articles(root: Element) -> list[Element]:
    """Article and main elements in page order."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.tag in ("article", "main"):
            found.append(element)
        stack += [c for c in reversed(element.children) if isinstance(c, Element)]
    return found


def main_text(html: str | None) -> str:
    """The text of the article of one page; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    return " ".join(text for part in _parts(root) for _, text, _ in _blocks(part))


def extract(df: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """The rows with the main text of their page in ``output``, and no markup.

    A null or empty page, or one without text outside its menus and the like, has an empty text. Lone surrogates that a
    character reference could make are U+FFFD, as HTML has it. Repeated rows stay; other columns pass through, but for
    one named like the output.
    """
    rows = df.drop(output) if output != html else df
    hidden = "_".join([*df.columns, "html"])
    rows = rows.withColumn(hidden, F.col(html)).drop(*([html] if html == output else []))
    schema = T.StructType([f for f in rows.schema.fields if f.name != hidden] + [T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, hidden):
            texts = pa.array([main_text(page) for page in batch.column(hidden).to_pylist()], pa.string())
            yield batch.drop_columns([hidden]).append_column(output, texts)

    return rows.mapInArrow(run, schema)
