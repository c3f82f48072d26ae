"""Main-text extraction by consensus host paths.

Each page's containers are scored by the text of the blocks they hold, less what is linked. A container's path, made of
tags and classes with digits generalised, gets the page's vote in proportion to its score; votes are added per host and path
in Spark. Then every page is read again: its text comes from the elements on the host's best path that the page has
and scores at least half its own best, else from its own best container; from there it climbs to the article or main around
them and takes titles, leads and further text beside them along (``text_under``).

Menus, headers and footers of the page, sidebars, notices, adverts, forms, comments, scripts and styles are left out
wherever they stand, by tag, role and class. A form and a class word are only a sign: the element stays when it holds the
page's article or main, or so much of the unlinked text that it must be a wrapper. Character references are decoded, white space becomes one space and blocks
are joined by one space. A page without a container that holds text gives what its body holds outside the parts left out.

Null and empty pages give an empty text; a null url is a host of its own, without votes shared between pages; rows are
kept, repeated ones too.
"""
from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.session import materialise, small_side

# Comments, declarations and tags; quoted attribute values may hold '>'. A tag cut off at the end of the page counts as one.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|</[^>]*>|<[a-zA-Z][^>]*>""", re.S)
#: A tag whose quote never closes ends at the next '>'.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Tags that never carry main text.
OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas video audio dialog menu title label input".split())
BLOCK = frozenset("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | OUT_TAGS
CONTAINERS = frozenset("article main section div td body".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that mark a part as not main text.
OUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail
footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register paywall
comment comments commentlist discussion disqus reply replies respond responses share sharing social related recommended recommendations widget widgets pagination pager search searchbox form toc skip tags
disclaimer copyright""".split())
#: Words of readers' talk and of other pages: no amount of text makes such a part the main text.
OTHERS_WORDS = frozenset("comment comments commentlist discussion disqus reply replies respond responses related recommended recommendations".split())
#: What stands after one of these tells what an element has, not what it is.
MODIFIERS = frozenset("has with no without".split())
#: A class of these words alone names a wrapper.
WRAPPER_WORDS = frozenset("content article post entry story body main page text layout container wrap wrapper site".split())
#: How many times the text of the rest of the page an element must hold to stay in spite of its mark. Talk never does
#: without an article or main in it.
OF_WRAPPER, OF_OTHERS, NEVER = 1.0, 10.0, float("inf")
#: An open element of this kind ends when the next one of the kind, or for p any block, begins.
CLOSED_BY = {"p": BLOCK - {"br", "button", "select", "option", "label", "input"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
LEAST_SHARE = 0.05


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


class Paths:
    """Tag-class paths of one page as numbers of (path above, name); their texts are made only where they are voted for."""

    def __init__(self):
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.number: dict[tuple[int, str], int] = {}
        self.texts: dict[str, int] = {}

    def below(self, path: int, name: str) -> int:
        n = self.number.setdefault((path, name), len(self.steps))
        if n == len(self.steps):
            self.steps.append((path, name))
        return n

    def text(self, path: int) -> str:
        names, at = [], path
        while at > 0:
            at, name = self.steps[at]
            names.append(name)
        text = "".join(f">{n}" for n in reversed(names))
        self.texts[text] = path
        return text

    def find(self, text: str) -> int | None:
        """Number of a path; those that were made into text are known."""
        if text not in self.texts:
            return next((p for p in range(1, len(self.steps)) if self.text(p) == text), None)
        return self.texts[text]


class Node:
    """An element. ``block``, ``box``, ``lead``: the nearest block, container, and article or main, itself included, so that no search has to
    pass the elements between; ``depth``: elements around it."""
    __slots__ = ("tag", "paths", "number", "out", "parent", "in_link", "main", "mark", "times", "block", "box", "lead", "depth")

    def __init__(self, tag: str, paths: Paths, number: int, out: bool, parent: Node | None, in_link: bool, main: bool, times: float = 0.0):
        self.tag, self.paths, self.number, self.out, self.parent, self.in_link, self.main = tag, paths, number, out, parent, in_link, main
        self.times = times                                      # above 0: marked, but may stay
        self.mark: Node | None = self if times else parent.mark if parent else None
        self.block: Node = self if tag in BLOCK or parent is None else parent.block
        self.box: Node | None = self if tag in CONTAINERS else parent.box if parent else None
        self.lead: Node | None = self if tag in ("article", "main") else parent.lead if parent else None
        self.depth: int = parent.depth + 1 if parent else 0

    @property
    def path(self) -> str:
        return self.paths.text(self.number)


def _words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def _marked(tag: str, a: dict[str, str], parent: Node) -> float:
    """0, or how many times the rest's text an element must hold that a form or a class word marks."""
    if tag == "form" or a.get("role", "").lower() == "form":
        return OF_WRAPPER
    if tag in ("html", "body", "main", "article"):
        return 0.0
    names = [_words(x) for x in (*a.get("class", "").split(), a.get("id", "")) if x]
    signs = set()
    for words in names:
        end = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        signs.update(w for w in words[:end] if w in OUT_WORDS or w == "header" and not parent.main and tag not in ("h1", "h2", "h3"))
    if not signs:
        return 0.0
    if signs & OTHERS_WORDS:
        return NEVER
    return OF_WRAPPER if any(words and WRAPPER_WORDS.issuperset(words) for words in names) else OF_OTHERS


def _left_out(tag: str, a: dict[str, str], parent: Node) -> bool:
    if tag in OUT_TAGS and tag != "form" or a.get("role", "").lower() in OUT_ROLES - {"form"} or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return tag == "header" and not parent.main                  # a header within the article is part of it


def _unmarked(parts: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The parts without those of marked elements, except the elements that turn out to be wrappers.

    The rest of the page, for an element, is what stands outside of all marked elements but those around it."""
    if not any(node.mark for node, _ in parts):
        return parts
    text: dict[Node | None, int] = {None: 0}
    leads: dict[Node | None, bool] = {}
    up: dict[Node, Node | None] = {}
    for node, piece in parts:
        mark = node.mark
        m = mark
        while m is not None and m not in up:
            up[m] = m.parent.mark
            text.setdefault(m, 0)
            m = up[m]
        n = len(piece.strip())
        if n and not node.in_link:
            leads[mark] = leads.get(mark, False) or node.main and _within_lead(node, mark)
            if node.block is not mark or mark.tag == "form" or mark.times == OF_WRAPPER:
                text[mark] += n
    stays: dict[Node, Node | None] = {}                         # a wrapper, and the marked element around it

    def around(m: Node) -> list[Node | None]:
        out: list[Node | None] = []
        while m is not None:
            m = up[m]
            if m not in stays:
                out.append(m)
        return out

    found = True
    while found:
        found = False
        for m in sorted((m for m in up if m not in stays), key=lambda m: -text[m]):
            outer = around(m)
            rest = sum(text[o] for o in outer)
            lead = leads.get(m, False) and not any(leads.get(o, False) for o in outer)
            times = m.times
            if lead:
                times = OF_OTHERS if times == NEVER else OF_WRAPPER
            if times < NEVER and text[m] > times * rest:
                stays[m] = outer[0]
                text[outer[0]] += text[m]
                leads[outer[0]] = leads.get(outer[0], False) or leads.get(m, False)
                found = True
                break

    def kept(m: Node | None) -> bool:
        while m is not None and m in stays:
            m = up[m]
        return m is None

    return [(node, piece) for node, piece in parts if kept(node.mark)]


def _within_lead(node: Node, mark: Node | None) -> bool:
    """Is there an article or main around the node, below the mark? Readers' talk comes in articles too, so below its mark only a main counts."""
    lead = node.lead
    if mark is None:
        return lead is not None
    if mark.times == NEVER:
        while lead is not None and lead.depth > mark.depth and lead.tag != "main":
            lead = lead.parent.lead
    return lead is not None and lead.depth > mark.depth


def parse(page: str) -> list[tuple[Node, str]]:
    """(element, text) in page order; the empty text stands for a break between blocks. Parts left out have no text."""
    paths = Paths()
    root = Node("", paths, 0, False, None, False, False)
    now, out = root, []
    opened: dict[str, int] = {}                                 # open elements of each tag

    def leave(to: Node) -> Node:
        """End the open elements below ``to``."""
        node = now
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    def put(text: str) -> None:
        if text and not now.out:
            out.append((now, text))

    position = 0
    while position < len(page):
        m = TOKEN.search(page, position)
        if m is None:
            put(page[position:])
            break
        if m.start() > position:
            put(page[position:m.start()])
        position = m.end()
        if m[2] is None:
            m = LOOSE.match(page, m.start())
            if m is None:
                continue
        tag = m[2].lower()
        if tag in BLOCK:
            out.append((now, ""))
        if m[1]:
            node = now if opened.get(tag) else root
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table", "article", "body") and tag not in ("table", "article", "body", "html", "main", "section", "div", "tr", "tbody", "thead"):
                    node = root                                 # a stray end tag inside
                    break
                node = node.parent
            if node is not root:
                now = leave(node.parent)
            continue
        while now is not root and tag in CLOSED_BY.get(now.tag, ()):
            now = leave(now.parent)
        if tag in CLOSED_BY and tag != "p":                     # an open li, td... further up ends too
            node = now.block
            while node is not root and node.tag not in ("ul", "ol", "dl", "table", "div", "body", "article", "section"):
                if tag in CLOSED_BY.get(node.tag, ()):
                    now = leave(node.parent)
                    break
                node = node.parent.block
        elif tag in BLOCK and tag != "br":                      # an open p ends under unclosed inline tags as well
            node = now.block
            if node.tag == "p" and tag in CLOSED_BY["p"]:
                now = leave(node.parent)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        a = _attributes(m[3]) if m[3] else {}
        name = tag + "".join("." + DIGITS.sub("#", c) for c in a.get("class", "").split())
        node = Node(tag, paths, paths.below(now.number, name) if tag in BLOCK else now.number, now.out or _left_out(tag, a, now), now, now.in_link or tag == "a", now.main or tag in ("article", "main"), _marked(tag, a, now) if a or tag == "form" else 0.0)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, position)
            position = end.end() if end else len(page)
            continue
        now = node
        opened[tag] = opened.get(tag, 0) + 1
    return _unmarked(out)


def scores(parts: list[tuple[Node, str]]) -> dict[str, tuple[float, int]]:
    """Score of each container path of a page, and where it first stands; paths under a twentieth of the best have no say and are left out.

    A block's text counts in full for its nearest container, by half for the next one up, and so on while that is
    more than a millionth of a character."""
    found: dict[int, list[float]] = {}
    paths = parts[0][0].paths if parts else None
    for i, (node, text) in enumerate(parts):
        n = len(text.strip())
        if not n:
            continue
        weight = -1.0 * n if node.in_link else float(n)
        box = node.box
        while box is not None and abs(weight) > 1e-6:
            s = found.setdefault(box.number, [0.0, i])
            s[0] += weight * (1.5 if box.tag in ("article", "main") else 1.0)
            weight /= 2
            box = box.parent.box
    top = max((s for s, _ in found.values()), default=0.0)
    return {paths.text(p): (s, int(i)) for p, (s, i) in found.items() if s > 0 and s >= LEAST_SHARE * top}


def text_under(parts: list[tuple[Node, str]], path: str | None, common: frozenset[str] | None = None) -> str:
    """Text around the elements on a path (None: of the page), blocks joined by one space.

    An element within an article or main stands for all of it. Then, up to the outermost main or article around it, else up to
    the page, everything beside it stays that holds more unlinked than linked text: titles, leads, further containers.
    Beside an article other articles do not belong to it, and further up only a title does where it has none. On the page
    itself, loose blocks stay, and containers of a fifth of the text if their path is in ``common`` (None: any)."""
    if path is None:
        return _joined(text for _, text in parts)
    whole: dict[Node, bool] = {}                                # elements that stay with all they hold
    levels: set[Node] = set()                                   # what is around them, no further than the search goes
    page: set[Node] = set()                                     # the page: body and above
    beyond: set[Node] = set()                                   # around the outermost article or main
    seen: set[Node] = set()
    lead = False
    number = parts[0][0].paths.find(path) if parts else None
    for node, _ in parts:
        while node is not None and node not in seen:
            seen.add(node)
            if node.number == number and node.tag in CONTAINERS:
                up = [node]
                while up[-1].parent is not None:
                    up.append(up[-1].parent)
                leads = [i for i, x in enumerate(up) if x.tag in ("article", "main")]
                first, last = (leads[0], leads[-1]) if leads else (0, len(up))
                lead = lead or bool(leads)
                whole[up[first]] = True
                for i, x in enumerate(up[first + 1:], first + 1):
                    (beyond if i > last else page if x.tag in ("body", "html", "") else levels).add(x)
            node = node.parent
    top_of: dict[Node, tuple[Node, Node | None]] = {}           # the branch a node is on, and what it branches from

    def branch(node: Node) -> tuple[Node, Node | None]:
        climbed = []
        while node not in top_of:
            climbed.append(node)
            if node in whole or node in levels or node in page or node in beyond or node.parent is None:
                top_of[node] = (node, None)
                break
            node = node.parent
        known = top_of[node]
        for node in reversed(climbed):
            if node not in top_of:
                top, level = known
                if level is None and top not in whole:
                    # inline elements and the loose text around them are one block
                    known = (node, top) if node.tag in BLOCK else (top, top)
                top_of[node] = known
        return known

    total: dict[Node, int] = {}
    boxes: dict[Node, bool] = {}
    others: dict[Node, bool] = {}
    titled = False
    noted: set[Node] = set()
    for node, text in parts:
        n = len(text.strip())
        if n:
            top, level = branch(node)
            total[top] = total.get(top, 0) + (-n if node.in_link else n)
            while node not in noted:
                noted.add(node)
                boxes[top] = boxes.get(top, False) or node.tag in CONTAINERS
                others[top] = others.get(top, False) or node.tag in ("article", "main")
                titled = titled or node.tag == "h1" and (top in whole or level in levels)
                if node is top or node.parent is None:
                    break
                node = node.parent
    most = max((total.get(w, 0) for w in whole), default=0)
    keep: dict[Node, bool] = {}
    for top, n in total.items():
        level = top if top in levels or top in page or top in beyond else top_of[top][1]
        if top in whole:
            keep[top] = True
        elif level in levels:
            keep[top] = n > 0 and not (lead and top is not level and others[top])
        elif level in page and (top is level or not boxes[top]):
            keep[top] = n > 0
        elif level in page:
            keep[top] = 5 * n >= most and (common is None or top.path in common)
        else:
            keep[top] = n > 0 and top.tag == "h1" and not titled
    return _joined(text for node, text in parts if not text or keep.get(branch(node)[0], False))


def _joined(pieces: Iterable[str]) -> str:
    return " ".join("".join([(text and _html.unescape(text)) or " " for text in pieces]).split())


def best_text(page: str, winners: list[str], common: list[str] | None = None) -> str:
    """``common``: the paths with a fifth of the votes of the host's best."""
    parts = parse(page)
    own = scores(parts)
    if not own:
        return text_under(parts, None)
    also = None if common is None else frozenset(common)
    top = max(s for s, _ in own.values())
    for path in winners:
        if path in own and own[path][0] >= top / 2:
            return text_under(parts, path, also)
    return text_under(parts, min((p for p in own if own[p][0] == top), key=lambda p: own[p][1]), also)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of (host, html) rows: shares of each page's best score, added per host."""
    out = pa.schema([("host", pa.string()), ("path", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = scores(parse(page.as_py()))
                top = max((s for s, _ in own.values()), default=0)
                for path, (s, _) in own.items():
                    if s >= LEAST_SHARE * top:
                        total[host, path] = total.get((host, path), 0.0) + s / top
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.float64())], schema=out)

    # a round number makes the sum independent of its order
    given = pages.where("host is not null").select("host", "html").mapInArrow(run, "host string, path string, share double")
    return given.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("votes"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.when(host != "", host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    counted = materialise(votes(rows), "votes")
    # paths with a twentieth of all votes of a host, best first: twenty at most, however many its pages and class names are
    top = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    good = counted.join(small_side(top, C.BROADCAST_BYTES), "host").where(F.col("votes") >= F.col("all") * LEAST_SHARE)
    ranked = good.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("w")).select("host", F.col("w.path").alias("winners"), F.expr("filter(w, x -> 5 * x.v <= w[0].v).path").alias("common"))
    ranked = materialise(ranked, "winners")
    joined = rows.join(small_side(ranked, C.BROADCAST_BYTES), "host", "left").select("page_id", "url", "html", "winners", "common")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [best_text(p.as_py(), w or [], c) for p, w, c in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], schema=out)

    read = joined.mapInArrow(run, "page_id long, url string, text string")
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
