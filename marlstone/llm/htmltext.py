"""Main text of web pages by tree scoring.

Pages are read in time linear in their length, however they are nested or broken.

A page becomes a tree of its block elements. Paragraphs pass points for their length and commas
to their ancestors, less with each level; a container's points are discounted by the share of its
text that stands in links. The best container and those of its siblings that look alike are kept, as
are all other articles of the page that aren't full of links. Notices, adverts and comments go by their class
names, at any length; names such as ``share`` or ``related`` make an element go only if it is short, full of
links or outside the article; form controls, buttons among them, and what is not shown go.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.texts import map_rows

# Element and class names as pages use them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup, or not shown as text; of these, title is shown inside an article.
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg canvas audio video object select button".split())
DROPPED = set("nav footer aside form menu dialog head fieldset".split())
#: Words of classes and ids that name what is no article.
UNWANTED = set(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar sidebars footer cookie cookies consent gdpr popup modal newsletter subscribe subscription login masthead "
    "comment comments commentlist disqus respond pagination pager notice notices notification notifications alert overlay signup "
    "reply replies discussion discussions".split()
)
#: Words that name such things or anything else: what has them goes if it is short, full of links or outside the article.
DOUBTFUL = set(
    "aside rail foot share sharing social related recommended recommendations widget toolbar skip copyright topbar".split()
)
UNWANTED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: These belong to the article if they stand in it, and to the page if they don't.
HEADS = {"header", "masthead", "banner"}
#: Elements that hold text rather than parts of a page: only a class that is an unwanted word makes them go.
TEXTS = set("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary article".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = BLOCKS - {"body", "html"}
#: A start tag of the key ends an open element of the values, up to the nearest of its containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
PARAGRAPHS = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main".split())

_TAG_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A doubtful element goes if it has fewer code points, or as large a share of its text in links.
SHORT, LINKED = 200, 0.3
#: A section beside the best stays if it is worth this share of it.
ALIKE = 0.2


class Node:
    __slots__ = ("tag", "parent", "dropped", "doubt", "holds_article", "in_article", "score", "chars", "linked", "blocks", "children")

    def __init__(self, tag, parent, dropped, doubt, in_article):
        self.tag, self.parent, self.dropped, self.doubt, self.in_article = tag, parent, dropped, doubt, in_article
        self.score = self.chars = self.linked = 0
        self.holds_article = False
        self.blocks, self.children = [], []
        if parent is not None:
            parent.children.append(self)


def tokens(page: str):
    """(text before, name, is an end tag, attributes) of each tag; the last has no name. Linear in the page.

    A tag ends at the first > outside of quotes, or with quotes that are never closed at the first >;
    what never ends is text. Comments and declarations are left out.
    """
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    text = []
    while at < size:
        start = page.find("<", at)
        if start < 0 or last[">"] < start:
            break
        name = _TAG_NAME.match(page, start)
        if name is None:
            if page.startswith(("<!", "<?"), start):
                text.append(page[at:start])
                if page.startswith("<!--", start):
                    quick = 5 if page.startswith("<!-->", start) else 6 if page.startswith("<!--->", start) else 0
                    end = None if quick else _COMMENT_END.search(page, start + 4)
                    at = start + quick if quick else end.end() if end else size
                else:
                    at = page.find(">", start) + 1
            else:
                text.append(page[at : start + 1])
                at = start + 1
            continue
        end = name.end()
        while True:
            close = page.find(">", end)
            if close < 0:
                break
            quotes = [k for c in "\"'" if last[c] > close and (k := page.find(c, end, close)) >= 0]
            if not quotes:
                break
            after = page.find(page[min(quotes)], min(quotes) + 1)
            if after < 0:
                break
            end = after + 1
        if close < 0:
            close = page.find(">", name.end())
        text.append(page[at:start])
        ending = page[start + 1] == "/"
        yield "".join(text), name[0].lstrip("</").lower(), ending, page[name.end() : close]
        text = []
        at = close + 1
        tag = name[0][1:].lower()
        if tag in RAW and not page[name.end() : close].endswith("/"):
            found = _RAW_END[tag].search(page, at)
            if tag == "title" and found:
                yield page[at : found.start()], "/title", True, ""
            at = found.end() if found else size
    yield "".join(text) + page[at:], None, False, ""


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element goes by its kind, and how its class and id speak of it: unwanted, doubtful or nothing."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, ""
    doubt = ""
    if not attributes:
        return False, doubt
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, ""
        if key == "style" and _HIDDEN.search(value):
            return True, ""
        if key == "role" and value.lower() in UNWANTED_ROLES and not (in_article and value.lower() == "banner"):
            return True, ""
        if key in ("class", "id") and tag not in ("main", "body", "html"):
            heads = HEADS if in_article else set()
            if tag in TEXTS:
                if {x.lower() for x in value.split()} & UNWANTED - heads:
                    doubt = "unwanted"
                continue
            names = {x.lower() for x in _WORD.findall(value)}
            if names & UNWANTED - heads or (not in_article and "header" in names):
                doubt = "unwanted"
            elif names & DOUBTFUL and not doubt:
                doubt = "doubtful"
    return False, doubt


def parse(page: str) -> tuple[Node, list, list]:
    """The tree of block elements, its nodes from the root on and, in page order, its text blocks as [node, text, chars, linked]."""
    root = Node("html", None, False, "", False)
    open_, nodes, blocks = [root], [root], []
    count: dict[str, int] = {}  # open elements by name, so that none is looked for in vain
    buffer: list[str] = []
    links = linked = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            node = open_[-1]
            block = [node, text, len(text), min(linked, len(text))]
            node.blocks.append(block)
            blocks.append(block)
        linked = 0

    def feed(piece: str):
        nonlocal linked
        if piece and not open_[-1].dropped:
            piece = html.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if links:
                linked += len(piece.strip())

    def close(k: int):
        flush()
        for node in open_[k:]:
            count[node.tag] -= 1
        del open_[k:]

    for text, tag, ending, attributes in tokens(page):
        if tag == "/title":
            if open_[-1].in_article:
                feed(text)
            continue
        feed(text)
        if tag is None:
            break
        if tag == "a":
            links = max(0, links + (-1 if ending else 1))
        elif tag == "br":
            buffer.append(" ")
        elif tag in BLOCKS or tag == "head":
            if ending:
                if count.get(tag):
                    close(max(k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag) if open_[-1].tag != tag else len(open_) - 1)
                else:
                    flush()
                links = 0
                continue
            if tag in CLOSES_PARAGRAPH and open_[-1].tag == "p":
                close(len(open_) - 1)
            if tag == "body" and count.get("head"):
                close(next(k for k in range(1, len(open_)) if open_[k].tag == "head"))
            if tag in ENDS and any(count.get(x) for x in ENDS[tag][0]):
                over, within = ENDS[tag]
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag in within:
                        break
                    if open_[k].tag in over:
                        close(k)
                        if tag != "tr":
                            break
            flush()
            if tag in VOID:
                continue
            links = 0
            parent = open_[-1]
            inside = parent.in_article or tag in ("article", "main")
            goes, doubt = (False, "") if parent.dropped else _judged(tag, attributes, parent.in_article)
            node = Node(tag, parent, parent.dropped or goes, doubt, inside)
            open_.append(node)
            nodes.append(node)
            count[tag] = count.get(tag, 0) + 1
            if tag in ("article", "main", "h1") and not node.dropped:
                up = parent
                while up is not None and not up.holds_article:
                    up.holds_article, up = True, up.parent
    flush()
    return root, nodes, blocks


def _add_up(nodes: list[Node]) -> None:
    """Code points, those in links, of each node with all below; children stand after their parents."""
    for node in nodes:
        node.chars = node.linked = 0
        if not node.dropped:
            node.chars, node.linked = sum(b[2] for b in node.blocks), sum(b[3] for b in node.blocks)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _drop_doubtful(nodes: list[Node]) -> None:
    """What its class or id speaks against goes, unless it holds the article or, if in doubt, a good deal of plain text in it."""
    _add_up(nodes)
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.doubt == "unwanted":
            node.dropped = not node.holds_article
        elif node.doubt == "doubtful" and not node.holds_article:
            node.dropped = not node.in_article or node.chars < SHORT or node.linked >= LINKED * node.chars
    _add_up(nodes)


def _below(node: Node) -> list:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out += x.blocks
        todo += x.children
    return out


def main_text(page: str | None) -> str:
    """Blocks of the best container and its like siblings, in page order, one line each."""
    if not page:
        return ""
    root, nodes, blocks = parse(page)
    _drop_doubtful(nodes)
    blocks = [b for b in blocks if not b[0].dropped]
    scored: dict[int, Node] = {}
    for node, text, chars, linked in blocks:
        points = (1 + text.count(",") + text.count("，") + min(chars / 100, 3)) * (1 - linked / chars) if node.tag in PARAGRAPHS else 0
        up = (node.parent or node) if node.tag not in ("div", "section", "article", "main", "html", "body") else node
        for level in range(5):
            if up is not None:
                up.score += points / (2 * level or 1)
                scored[id(up)] = up
                up = up.parent
    if not scored:
        return "\n".join(b[1] for b in blocks)

    def worth(x: Node) -> float:
        return x.score * (1 - x.linked / x.chars if x.chars else 0)

    best = max(scored.values(), key=worth)
    marked = max((n for n in scored.values() if n.tag in ("article", "main")), key=worth, default=best)
    if 2 * worth(marked) >= worth(best):  # stray paragraphs about it don't make the whole page the article
        best = marked
    x = best
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    if x is not None and not (x.tag == "main" and best.tag == "article"):
        best = x  # what the page itself marks as the article
    kept = _below(best)
    least = ALIKE * worth(best)
    for other in nodes:  # other parts of the article that the page marks as such
        if other.tag == "article" and best.tag == "article" and other is not best and other.linked < LINKED * other.chars:
            kept += _below(other)
    beside = best.parent.children if best.parent is not None and (best.tag not in ("article", "main") or best.parent.in_article) else ()
    for other in beside:
        if other is best or not other.chars:
            continue
        density = other.linked / other.chars
        plain = other.tag in PARAGRAPHS - {"div", "section", "li", "td"} and density < LINKED
        if worth(other) >= least > 0 or plain:
            kept += _below(other)
    chosen = set(map(id, kept))
    return "\n".join(b[1] for b in blocks if id(b) in chosen)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row.

    Null and empty pages, and pages without text, give the empty text. Null ids and urls stay
    null; repeated rows get equal texts; an empty table gives an empty result; other columns are not
    read. Of containers worth the same the first counts. Pages are read whole.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

        return step

    kind = dict(rows.dtypes)
    return map_rows(rows, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long", make)
