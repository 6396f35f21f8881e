"""Main text of web pages by wrapper induction: pages of a host are aligned with one of them by simple tree matching;
aligned nodes whose text never changes are the host's template, those whose text varies are content."""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keidai.llm.common import ship, small, written

#: A node is template if its text is the same in so many pages of a host with as many different texts.
TEMPLATE_PAGES = 5
#: Weights of pairs of siblings that are held at once, at most; of longer lists some rows are held, and those between them are found again.
PAIRS = 1 << 20
#: From so many siblings on, a row of weights is an array.
WIDE = 64
#: Characters of exemplars, and nodes of mappings, that a task remembers; then it starts anew.
HELD_CHARS, HELD_NODES = 4_000_000, 500_000

# Elements by how HTML treats them, and names that say what a part of a page is for.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object option script select style svg template textarea title".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words of a name that say how a part is laid out, not what it is; and those that say what isn't there.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons cell col column container content form group holder icon icons inner item items left link links list main outer panel right row section slot top unit "
    "wrap wrapper zone".split()
)
NEGATIONS = frozenset("has hide is no not show with without".split())
COMMENTS = frozenset("comment comments disqus replies reply".split())  # of these names, those of what readers say
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOPICS = frozenset("h1 h2 h3 h4 h5 h6 p section".split())  # their ids are anchors
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

RAW = frozenset("iframe script style textarea title".split())  # what they hold is no markup

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
LESS = re.compile("(?P<text><)")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
WORD = re.compile(r"[^\W_]")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NOT_NAME = re.compile(r"[^a-z0-9]+")
BLANKS = re.compile(r"\s+")


class TagEnds:
    """Where a tag that begins at a place ends, for pages that have tags without an end: found for all places in one pass from the right, so that none is searched twice."""

    def __init__(self, page: str):
        self.places = [m.start() for m in re.finditer("[\"'>]", page)]
        free, double, single = -1, -1, -1  # where a tag ends, seen from outside of quotes, from within double and from within single ones
        self.ends = [0] * len(self.places)
        for i in range(len(self.places) - 1, -1, -1):
            mark = page[self.places[i]]
            if mark == ">":
                free = self.places[i]
            elif mark == '"':
                free, double = double, free
            else:
                free, single = single, free
            self.ends[i] = free

    def __call__(self, at: int) -> bool:
        i = bisect_left(self.places, at)
        return i < len(self.places) and self.ends[i] >= 0


class Node:
    """An element of the tree, and the text blocks that are directly in it. rank: 2 in an article, 1 in a main part; named: 1 if its name speaks against it, 2 if it is of readers' comments."""

    __slots__ = ("key", "children", "parent", "number", "texts", "mark", "sig", "full", "rank", "named")

    def __init__(self, key: str, parent: Node | None, rank: int = 0, named: int = 0):
        self.key, self.parent, self.rank, self.named = key, parent, rank, named
        self.children, self.texts, self.number, self.mark, self.sig, self.full = [], [], -1, "", 0, 0


def speaks_against(value: str, in_article: bool) -> int:
    """Whether a class or id names a menu, an advert or the like, by its last word that isn't about layout; 2 for readers' comments."""
    words = [w for w in NOT_NAME.split(value) if w and not any(c.isdigit() for c in w)]
    if not words or words[0] in NEGATIONS:
        return 0
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return 2 if words[-1] in COMMENTS else int(words[-1] in NAMES or (words[-1] == "header" and not in_article))


def described(tag: str, attrs: str, in_article: bool) -> tuple[bool, int, str]:
    """Whether an element is left out by what it is, whether what it is called speaks against it, and its key in the tree."""
    if tag in NEVER and tag != "form" or tag == "header" and not in_article:
        return True, 0, tag
    names, against = "", int(tag == "form")
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value.strip() in ROLES:
                return True, 0, tag
            continue
        if tag not in ("body", "html", "article", "main") and not (name == "id" and tag in TOPICS):  # the ids of headings are anchors
            against = max([against, *(speaks_against(x, in_article) for x in value.split())])
        if name == "class":
            names = ".".join(sorted(t for t in NOT_NAME.split(value) if t and not t.isdigit()))
    return False, against, f"{tag}.{names}" if names else tag


def blocks_of(page: str) -> tuple[Node, list[tuple[Node, str, int, int, bool]]]:
    """The page's tree, and its text blocks in page order: node, text, links, characters outside of links, and whether a letter or digit is among these."""
    root = Node("", None)
    open_: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, node, left out
    count: Counter = Counter()  # of open tags
    out: list[tuple[Node, str, int, int, bool]] = []
    parts: list[str] = []
    here, links, free, wordy, in_link, new_link = root, 0, 0, False, False, False
    unclosed: set[str] = set()

    def flush():
        nonlocal links, free, wordy
        if parts:
            text = BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                out.append((here, text, links, free, wordy))
                here.texts.append(text)
            parts.clear()
        links, free, wordy = 0, 0, False

    def close(until: str):
        """Ends open elements up to the innermost of this tag; only blocks end the text before, and not within what is left out."""
        tag = None
        while tag != until:
            tag = open_.pop()[0]
            count[tag] -= 1
            if tag in BLOCKS and not open_[-1][2]:
                flush()

    at, last, ends = 0, page.rfind(">"), None
    while at < len(page):
        if page[at] == "<" and (at > last or ends and page[at + 1 : at + 2].isalpha() and not ends(at)) and not page.startswith("<!--", at):
            m = LESS.match(page, at)  # a tag without an end is text; to look for one again at each would be quadratic
        else:
            m = TOKEN.match(page, at)
        at = m.end()
        text = m.group("text")
        if text == "<" and ends is None:
            ends = TagEnds(page)
        if text is not None:
            if not open_[-1][2]:
                if not parts:
                    here = open_[-1][1]
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    links += new_link and bool(text.strip())
                    new_link = new_link and not text.strip()
                else:
                    free += len(text.strip())
                    wordy = wordy or WORD.search(text) is not None
            continue
        if m.group("tag") is None:
            continue
        tag, attrs = m.group("tag").lower(), m.group("attrs") or ""
        if m.group("end"):
            if tag == "a":
                in_link = False
            if count[tag]:
                close(tag)
            elif tag in BLOCKS and not open_[-1][2]:
                flush()
            continue
        if tag == "br":
            if not open_[-1][2]:
                parts.append("\n")
            continue
        if tag in RAW:
            if not attrs.endswith("/") and tag not in unclosed:
                end = RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag in BLOCKS and count["svg"] and not count["foreignobject"]:  # no drawing has one: its end is missing
            close("svg")
        gone, rank = open_[-1][2], open_[-1][1].rank
        drop, named, key = (True, 0, tag) if gone else described(tag, attrs, rank == 2)
        if tag not in BLOCKS and not drop:  # an inline element
            if tag == "a":
                in_link = new_link = True
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            if tag == "hr" and not gone:
                flush()
            continue
        if tag in BLOCKS:
            if not gone:
                flush()
            # What a new element closes: a paragraph by any block, an item by the next.
            if open_[-1][0] == "p":
                close("p")
            if tag in CLOSES and open_[-1][0] in CLOSES[tag]:
                close(open_[-1][0])
                if tag == "tr" and open_[-1][0] == "tr":
                    close("tr")
        _, node, gone = open_[-1]
        if not (drop or gone):
            node = Node(key, node, 2 if tag == "article" else max(node.rank, 1) if tag == "main" else node.rank, named)
            node.parent.children.append(node)
        open_.append((tag, node, drop or gone))
        count[tag] += 1
    flush()
    return root, out


def numbered(root: Node) -> list[Node]:
    """Nodes in tree order, each with its number."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


#: What a matched pair of nodes weighs against a pair of equal texts, which only break ties.
PAIR = 1 << 32


def texts_of(root: Node) -> set[str]:
    return {"\n".join(x.texts) for x in numbered(root)}


def marked(root: Node, known: set[str]) -> int:
    """Marks the nodes whose text is one of the exemplar's, and gives each subtree a signature of its keys and marks, and what it weighs against itself."""
    for node in reversed(numbered(root)):
        text = "\n".join(node.texts)
        node.mark = text if text in known else ""
        node.sig = hash((node.key, node.mark, tuple([c.sig for c in node.children])))
        node.full = PAIR + (node.mark != "") + sum([c.full for c in node.children])
    return root.sig


class Matching:
    """Simple tree matching: of all mappings of two trees that keep order and parents the one with the most pairs of equal keys, and of these one with the most equal texts."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def sides(self, a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
        """Children that the best mapping pairs in any case, as equal subtrees begin or end both lists, and the others."""
        xs, ys = a.children, b.children
        low, n = 0, min(len(xs), len(ys))
        while low < n and xs[low].sig == ys[low].sig:
            low += 1
        high = 0
        while high < n - low and xs[-1 - high].sig == ys[-1 - high].sig:
            high += 1
        pairs = [*zip(xs[:low], ys[:low]), *zip(xs[len(xs) - high :], ys[len(ys) - high :])]
        return pairs, xs[low : len(xs) - high], ys[low : len(ys) - high]

    def weight(self, x: Node, y: Node) -> int:
        if x.sig == y.sig:
            return x.full
        own = PAIR + (x.mark != "" and x.mark == y.mark)
        return own if not x.children or not y.children else self.known[x.sig, y.sig]

    def rows(self, xs: list[Node], ys: list[Node], above: list[int] | np.ndarray) -> Iterator[list[int] | np.ndarray]:
        """Weights of the best order-preserving mappings of the first nodes of two lists: a row for each of the first list, below the row above them."""
        if len(ys) < WIDE:
            above = [int(n) for n in above]
            for x in xs:
                row = [0]
                for j, y in enumerate(ys):
                    w = above[j] + self.weight(x, y) if x.key == y.key else 0
                    row.append(max(w, above[j + 1], row[j]))
                yield row
                above = row
            return
        different = {y.sig: y for y in ys}
        number = {sig: i for i, sig in enumerate(different)}
        at = np.fromiter((number[y.sig] for y in ys), np.int64, len(ys))
        above, known = np.asarray(above, np.int64), {}
        for x in xs:
            if x.sig not in known:
                if len(known) * len(ys) > PAIRS:
                    known.clear()
                known[x.sig] = np.fromiter((self.weight(x, y) if x.key == y.key else 0 for y in different.values()), np.int64, len(different))
            w = known[x.sig][at]
            row = np.zeros(len(ys) + 1, np.int64)
            np.maximum.accumulate(np.maximum(above[1:], np.where(w > 0, above[:-1] + w, 0)), out=row[1:])
            yield row
            above = row

    def walk(self, xs: list[Node], ys: list[Node], above: list[int] | np.ndarray, out: list[tuple[Node, Node]]) -> int:
        """Adds the pairs of the best mapping of two lists, the last first; returns how many of ys come before all that xs are paired with. `above` is the row above xs."""
        if len(xs) * len(ys) <= PAIRS or len(xs) == 1:
            best = [above, *self.rows(xs, ys, above)]
            i, j = len(xs), len(ys)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[i], ys[j]))
            return j
        step = -(-len(xs) // 16)
        starts = [(0, above), *((i, row) for i, row in enumerate(self.rows(xs[:-1], ys, above), 1) if i % step == 0)]
        j = len(ys)
        for i, row in reversed(starts):
            if j:
                j = self.walk(xs[i : i + step], ys[:j], row[: j + 1], out)
        return j

    def weigh(self, a: Node, b: Node) -> None:
        """Weights of all pairs of subtrees that the mapping of a and b needs, the deepest first."""
        waiting = [(a, b)]
        while waiting:
            x, y = waiting[-1]
            if (x.sig, y.sig) in self.known or x.sig == y.sig or not x.children or not y.children:
                waiting.pop()
                continue
            pairs, xs, ys = self.sides(x, y)
            cs, ds = ({c.sig: c for c in nodes if c.children}.values() for nodes in (xs, ys))
            lacking = ((c, d) for c in cs for d in ds if c.key == d.key and c.sig != d.sig and (c.sig, d.sig) not in self.known)
            if some := list(itertools.islice(lacking, PAIRS)):
                waiting += some
                continue
            row = [0]
            for row in self.rows(xs, ys, [0] * (len(ys) + 1)):
                pass
            self.known[x.sig, y.sig] = PAIR + (x.mark != "" and x.mark == y.mark) + sum(c.full for c, _ in pairs) + int(row[-1])
            waiting.pop()

    def __call__(self, a: Node, b: Node) -> list[tuple[int, int]]:
        """Pairs of node numbers; none if the roots differ."""
        if a.key != b.key:
            return []
        self.weigh(a, b)
        out, waiting = [], [(a, b)]
        while waiting:
            x, y = waiting.pop()
            out.append((x.number, y.number))
            if x.sig == y.sig:
                waiting += zip(x.children, y.children)
                continue
            pairs, xs, ys = self.sides(x, y)
            waiting += pairs
            if xs and ys:
                self.walk(xs, ys, [0] * (len(ys) + 1), waiting)
        return out


def matched(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """How many nodes simple tree matching pairs in two numbered trees, and these pairs of numbers."""
    known = texts_of(b)
    marked(a, known), marked(b, known)
    pairs = Matching()(a, b)
    return len(pairs), pairs


class Aligner:
    """Maps the nodes of a page to those of its host's exemplar. Pages of one shape, with the same of the exemplar's texts, are aligned once."""

    def __init__(self):
        self.exemplars: dict[str, tuple[Node, set[str]]] = {}
        self.pairs: dict[tuple[str, int], dict[int, int]] = {}
        self.chars = self.nodes = 0

    def __call__(self, exemplar: str, root: Node) -> dict[int, int]:
        if self.chars > HELD_CHARS or self.nodes > HELD_NODES:
            self.__init__()
        if exemplar not in self.exemplars:
            tree, _ = blocks_of(exemplar)
            known = texts_of(tree)
            marked(tree, known)
            self.exemplars[exemplar] = tree, known
            self.chars += len(exemplar)
        tree, known = self.exemplars[exemplar]
        key = (exemplar, marked(root, known))
        if key not in self.pairs:
            self.pairs[key] = dict(Matching()(root, tree))
            self.nodes += len(self.pairs[key])
        return self.pairs[key]


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def main_text(page: str | None, template: set[int], align, exemplar: str | None) -> str:
    """The varying blocks of a page: those of its articles that have a main heading, else those of its main part, else of its articles if no paragraph or heading is beside them, else all.

    Left out are blocks of template nodes; readers' comments; other containers that a name speaks against, unless an article,
    a main part or a main heading is in them, or all of the page's text is; and, outside of articles and main parts,
    lists of two or more links and no word beside them that don't follow a heading or a paragraph. How long a text is decides nothing.
    """
    if not page:
        return ""
    root, found = blocks_of(page)
    nodes = numbered(root)
    if template and exemplar:
        to = align(exemplar, root)
        found = [b for b in found if to.get(b[0].number) not in template]
    links, count, wordy, core, headed = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    tags = [node.key.partition(".")[0] for node in nodes]
    for node, _, n, _, words in found:
        i = node.number
        links[i], count[i], wordy[i], headed[i] = links[i] + n, count[i] + 1, wordy[i] or words, headed[i] or tags[i] == "h1"
    for node in reversed(nodes[1:]):
        i, j = node.number, node.parent.number
        core[i] = core[i] or headed[i] or tags[i] in ("article", "main")
        links[j], count[j], wordy[j], core[j], headed[j] = links[j] + links[i], count[j] + count[i], wordy[j] or wordy[i], core[j] or core[i], headed[j] or headed[i]
    comments, against, menu, article = ([False] * len(nodes) for _ in range(4))
    before: dict[int, str] = {}  # of each parent the tag of the child before
    for node in nodes[1:]:
        i, j, tag = node.number, node.parent.number, tags[node.number]
        comments[i] = comments[j] or node.named == 2
        against[i] = against[j] or (node.named == 1 and not core[i] and count[i] < count[0])
        follows = before.get(j, "") in HEADINGS or before.get(j) == "p"
        menu[i] = menu[j] or (not node.rank and tag not in ("html", "body", "p") and links[i] > 1 and not wordy[i] and not follows)
        article[i] = article[j] or (tag == "article" and headed[i])
        before[j] = tag
    found = [b for b in found if not comments[b[0].number]]
    for gone in (against, menu):  # what is all of a page is its text
        found = [b for b in found if not gone[b[0].number]] or found
    headed_ones, in_main = [b for b in found if article[b[0].number]], [b for b in found if b[0].rank and _in_main(b[0])]
    in_articles = [b for b in found if b[0].rank == 2]
    prose_beside = any(b[0].rank != 2 and (tags[b[0].number] == "p" or tags[b[0].number] in HEADINGS) for b in found)
    return "\n\n".join(b[1] for b in headed_ones or in_main or (not prose_beside and in_articles) or found)


def _in_main(node: Node | None) -> bool:
    while node is not None and node.key.partition(".")[0] != "main":
        node = node.parent
    return node is not None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    A host's exemplar is the page of least hash; every page of the host is aligned with it. An exemplar's node is
    template if pages of five or more different texts have it and all texts at it are equal. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are known by their elements, roles and class names too, as their texts may
    vary from page to page; see main_text(). Of equally good alignments the one that matches later siblings is taken. Markup of any depth and length is read whole.

    Null and empty html give an empty text; a null or odd url belongs to the host ''. Repeated rows each give a row, and
    count as one text; a null id is kept. Pages of a small or single host have no template. Other columns are left out.
    """
    spark = pages.sparkSession
    ship(spark)
    named = pages.select(F.col(id_col).alias("hx_id"), F.col(url_col).alias("hx_url"), F.col(html_col).alias("hx_html"), host_of(F.col(url_col)).alias("hx_host"))
    # One page a host: grouping combines before the shuffle, so a host of a third of all pages is a row a task.
    exemplars = named.where(F.coalesce(F.length("hx_html"), F.lit(0)) > 0).groupBy(F.col("hx_host").alias("host")).agg(F.min_by("hx_html", F.struct(F.xxhash64("hx_html"), "hx_html")).alias("exemplar"))
    exemplars = written(exemplars, "exemplars")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        align = Aligner()
        for batch in batches:
            votes: dict[tuple[str, int], list] = {}
            for host, page, exemplar in zip(*(batch.column(c).to_pylist() for c in ("hx_host", "hx_html", "exemplar"))):
                root, found = blocks_of(page)
                numbered(root)
                to = align(exemplar, root)
                at: dict[int, list[str]] = {}
                for node, text, *_ in found:
                    if node.number in to:
                        at.setdefault(to[node.number], []).append(text)
                whole = xxhash.xxh3_64_intdigest("\n".join(b[1] for b in found).encode("utf-8", "replace")) >> 1
                for node, parts in at.items():
                    h = xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "replace")) >> 1
                    v = votes.setdefault((host, node), [set(), h, h])
                    v[1], v[2] = min(v[1], h), max(v[2], h)
                    if len(v[0]) < TEMPLATE_PAGES:  # more don't matter
                        v[0].add(whole)
            rows = [(*k, x, low, high) for k, (texts, low, high) in votes.items() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "node", "page", "low", "high"])

    paired = named.where(F.coalesce(F.length("hx_html"), F.lit(0)) > 0).join(small(exemplars), F.col("hx_host") == F.col("host"))
    votes = written(
        paired.select("hx_host", "hx_html", "exemplar")
        .mapInArrow(vote, "host string, node int, page long, low long, high long")
        .groupBy("host", "node", "page")  # the different texts of pages that have the node
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .groupBy("host", "node")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("low"), F.max("high").alias("high")),
        "host-votes",
    )
    constant = votes.where((F.col("texts") >= TEMPLATE_PAGES) & (F.col("low") == F.col("high")))
    templates = constant.groupBy("host").agg(F.collect_set("node").alias("template"))  # nodes of one exemplar
    wrappers = written(exemplars.join(templates, "host"), "wrappers")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for batch in batches:
            texts = [main_text(page, set(template or ()), align, exemplar) for page, exemplar, template in zip(*(batch.column(c).to_pylist() for c in ("hx_html", "exemplar", "template")))]
            yield pa.RecordBatch.from_arrays([batch.column("hx_id"), batch.column("hx_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    fields = [T.StructField(c, pages.schema[c].dataType) for c in (id_col, url_col)]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return named.join(small(wrappers), F.col("hx_host") == F.col("host"), "left").select("hx_id", "hx_url", "hx_html", "exemplar", "template").mapInArrow(pick, schema)
