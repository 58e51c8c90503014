"""Main text of web pages by inferring a wrapper for each host.

A wrapper is a union-free regular expression over a page's tree: elements in
sequence, some repeated, some optional, with text that is either a constant of
the host's template or a slot. It is inferred by aligning the token streams of
all pages of a host one after the other: matching elements are aligned inside,
neighbours with the same sign fold into a repeated group, elements that one side
lacks become optional, and texts that differ become slots. Each text adds up its
characters, those in links, and the pages it was found equal on.

From a host's wrapper follow its places of main text, articles and main parts, and
its constants. Each page has its own choice of them: its articles if it has any
with text, else its main part, else the element under which most of its text that
is no constant stands as paragraphs outside links, with the elements like it whose
ids differ. So no page is empty because another one of its host is built otherwise.

Parts that by name are no text of the article (menus, headers, footers, sidebars,
adverts, forms, comments) are left out: elements of such kinds, and containers with
such a word as a whole class or id, or beside words like "list" in it. Everyday
words (related, notice, discussion), and ids of sections, need the host's wrapper
to show a part that stands on half of the pages, three at least, and is links or
the same text. Left out, too, are blocks equal to a constant of the template,
headings excepted. A text is a constant if it was equal on nine of ten pages of its
host and on three at least, at a path where no text differs; fewer pages show none.

Wrappers are merged per task before they are shuffled, so a host with a third of
all pages sends one wrapper per task. A page never leaves its task whole: it is
parsed once for the wrapper and once for its text.

Defined cases: null or empty html, and pages without a text, give the empty
string; a null url, or one without a host, is of the host ""; markup that is cut
off or never closed is read as far as it goes; repeated rows are each extracted;
extra columns are kept by ``extracted``.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import small
from corpusmill.llm.tokens import chunks
from corpusmill.session import cut_lineage

# Names of HTML elements, and words that name parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre li ul ol".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: What an opening tag closes, if it is open and nothing of STOPS lies between.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"button", "option", "optgroup", "select"}, ("p",)),
    "li": ("p", "li"),
    "dd": ("p", "dd", "dt"),
    "dt": ("p", "dd", "dt"),
    "tr": ("p", "tr", "td", "th"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "option": ("option",),
}
STOPS = frozenset("ul ol table div article section main aside nav body form td th blockquote dl menu".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset head hr search option".split())
#: Parts that may be known by name; headings, paragraphs and cells are not.
CONTAINERS = frozenset("div section ul ol dl table center details".split())
#: Words that name no article text, as a whole class, id or role or in one made of such words.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor promo promotion cookie cookies consent gdpr popup modal comments commentlist respond "
    "disqus sidebar nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar newsletter subscribe subscription signup "
    "pagination pager byline".split()
)
#: Everyday words: they name such a part only if the host's wrapper shows it as one.
EVERYDAY_WORDS = frozenset(
    "sponsored banner notice alert overlay comment discussion reply replies rail aside widget menu share sharing social related recommended login "
    "search copyright disclaimer toc".split()
)
ROLES = frozenset("navigation banner search complementary contentinfo menu menubar dialog".split())
#: What may stand beside such a word in a name.
FILLERS = frozenset(
    "area bar block body bottom box button buttons container content entry group icon icons inner item items left link links list main outer page "
    "posts post article primary right secondary section site text top wrap wrapper".split()
)
#: The same for an element that by its name holds the text.
ASIDE_ARTICLES = frozenset("ad ads advert advertisement sponsored comment comments reply teaser related".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+|[^>]*)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


#: Elements inside one another that are told apart.
DEPTH = 200


class Element:
    __slots__ = ("sign", "children")

    def __init__(self, sign: str):
        self.sign = sign
        self.children: list[Element | Block] = []


class Block:
    """Text between the edges of blocks, and how much of it is in links."""

    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def parse(page: str) -> Element:
    """A page's tree of block elements and texts."""
    root = Element("")
    stack, parts = [(root, "")], []
    link = linked = at = too_deep = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            stack[-1][0].children.append(Block(text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(names: tuple[str, ...], stops: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth][1]
            if name in names:
                del stack[depth:]
                return
            if name in stops:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = entities.unescape(page[at : m.start() if m else len(page)])
        if text:
            parts.append(text)
            linked += len(text.strip()) if link else 0
        if not m:
            break
        at = max(m.end(), at + 1)
        shut, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not shut and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
        elif name == "a":
            link = 0 if shut else 1
        elif name in ("br", "img", "input"):
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if len(stack) > DEPTH and not shut:
                too_deep += 1  # its text counts for the element around it
            elif shut and too_deep:
                too_deep -= 1
            elif shut:
                close((name,), frozenset() if name not in ("p", "li") else STOPS - {name})
            else:
                for _ in range(2):
                    close(CLOSES.get(name, ()), STOPS)
                link = 0
                made = Element(sign(name, m[3] if name != "body" else ""))  # its class is often the page's own
                stack[-1][0].children.append(made)
                if name != "hr":
                    stack.append((made, name))
    flush()
    return root


def sign(name: str, attributes: str) -> str:
    """An element's name with its class, id and role; digits count as one."""
    found = sorted(f"{k.lower()}={v.strip(chr(34) + chr(39)).lower()}" for k, v in _NAMED.findall(attributes)) if attributes else []
    return " ".join([name, *(re.sub(r"\d+", "0", x) for x in found)])


def names(s: str, kinds: tuple[str, ...] = ("class", "id", "role")) -> Iterator[list[str]]:
    """The words of each class, id and role of a sign."""
    for named in re.split(r" (?=(?:class|id|role)=)", s)[1:]:
        kind, _, value = named.partition("=")
        if kind in kinds:
            yield from ([w for w in _WORD.findall(token) if w != "0"] for token in value.split())


def named_by(s: str, words: frozenset[str], kinds: tuple[str, ...] = ("class", "id", "role")) -> bool:
    """Whether a class, id or role consists of one of the words, or of it and fillers."""
    return any(not words.isdisjoint(t) and words.union(FILLERS).issuperset(t) for t in names(s, kinds))


@lru_cache(1 << 14)
def kind_of(s: str) -> int:
    """Whether an element's sign names a part that is no article text (2), or
    one that is none if the wrapper confirms it (1)."""
    name, _, rest = s.partition(" ")
    if name in ASIDE_TAGS or name == "header":
        return 2
    if not rest or name in ("body", "html"):
        return 0
    if name in ("article", "main") or "role=main" in rest:
        return 2 if named_by(s, ASIDE_ARTICLES) else 0
    if any(t and t[0] in ROLES for t in names(s, ("role",))):
        return 2
    if name not in CONTAINERS:
        return 0
    # ids of sections are often made from their heading
    if named_by(s, ASIDE_WORDS, ("class",) if name == "section" else ("class", "id")):
        return 2
    return 1 if named_by(s, ASIDE_WORDS | EVERYDAY_WORDS, ("class", "id")) else 0


def is_header(s: str) -> bool:
    return s.partition(" ")[0] == "header" or (kind_of(s) == 2 and named_by(s, frozenset(["header"])))


# A wrapper is a list: ["e", sign, repeated, optional, children, pages] or
# ["t", constant or None for a slot, repeated, optional, characters, linked, pages].

#: Pages that have to agree on a constant, and their least share in percent.
AGREED, AGREED_PERCENT = 3, 90


def wrap(node: Element) -> list:
    """The wrapper of one page, neighbours with the same sign folded."""
    children: list = []
    for child in node.children:
        made = wrap(child) if isinstance(child, Element) else ["t", child.text if len(child.text) <= 200 else None, False, False, len(child.text), child.linked, 1]
        if children and _key(children[-1]) == _key(made):
            children[-1] = merge(children[-1], made, apart=False)
            children[-1][2] = True
        else:
            children.append(made)
    return ["e", node.sign, False, False, children, 1]


def _key(item: list) -> str:
    return item[1] if item[0] == "e" else "#"


def merge(a: list, b: list, apart: bool = True) -> list:
    """Aligns two wrappers of the same key, from pages ``apart`` or from parts of
    the same pages; of those, the larger number of pages is certain."""
    pages = a[-1] + b[-1] if apart else max(a[-1], b[-1])
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] or b[2], a[3] or b[3], a[4] + b[4], a[5] + b[5], pages]
    left, right = [_key(x) for x in a[4]], [_key(x) for x in b[4]]
    if left == right:
        children = [merge(x, y, apart) for x, y in zip(a[4], b[4], strict=True)]
    else:
        children, i, j = [], 0, 0
        for x, y, n in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks():
            for lone in (*a[4][i:x], *b[4][j:y]):
                children.append([*lone[:3], True, *lone[4:]])
            children += [merge(p, q, apart) for p, q in zip(a[4][x : x + n], b[4][y : y + n], strict=True)]
            i, j = x + n, y + n
        children = _folded(children)
    return ["e", a[1], a[2] or b[2], a[3] or b[3], children, pages]


def _folded(children: list) -> list:
    """Neighbours with the same key, left by the alignment, as one repeated group."""
    out: list = []
    for c in children:
        if out and _key(out[-1]) == _key(c):
            out[-1] = merge(out[-1], c, apart=False)
            out[-1][2] = True
        else:
            out.append(c)
    return out


def is_article(s: str) -> bool:
    return s.partition(" ")[0] == "article" or "role=article" in s


def places(wrapper: list, pages: int) -> tuple[list[str], list[tuple[str, str]], list[str]]:
    """Paths of the host's articles and main parts, constants (path, text), and
    paths of parts with an everyday name that repeat over pages and hold links or
    the same text on all of them."""
    chosen: set[str] = set()
    constants: set[tuple[str, str]] = set()
    differing: set[str] = set()
    parts: dict[str, list[int]] = {}

    def look(item: list, path: str) -> None:
        """Adds up each part's pages, its characters, and those outside links that differ."""
        at = f"{path}/{item[1]}"
        if kind_of(item[1]) == 1:
            known = parts.setdefault(at, [0, 0, 0])
            known[0] = max(known[0], item[5])
            for text in _texts(item):
                known[1] += text[4]
                known[2] += text[4] - text[5] if text[1] is None or text[6] < AGREED else 0
        for child in item[4]:
            if child[0] == "e":
                look(child, at)

    def walk(item: list, path: str, apart: bool) -> None:
        at = f"{path}/{item[1]}"
        name = item[1].split(" ")[0]
        apart = apart or kind_of(item[1]) == 2 or at in confirmed
        if not apart and (is_article(item[1]) or name == "main" or "role=main" in item[1]):
            chosen.add(at)
        for child in item[4]:
            if child[0] == "e":
                walk(child, at, apart)
            elif child[1] is None:
                differing.add(at)
            elif child[6] >= AGREED and 100 * child[6] >= AGREED_PERCENT * pages and name not in HEADINGS and not apart:
                constants.add((at, child[1]))

    def inside(path: str) -> bool:
        return any(path == c or path.startswith(f"{c}/") for c in chosen)

    look(wrapper, "")
    confirmed = {at for at, (n, size, free) in parts.items() if n >= AGREED and 2 * n >= pages and 4 * free <= size}
    walk(wrapper, "", False)
    if constants:  # where no text differs at all, pages are copies, not a template
        slotted = {inside(d) for d in differing}
        constants = {c for c in constants if c[0] not in differing and inside(c[0]) in slotted}
    return sorted(chosen), sorted(constants), sorted(confirmed)


def _texts(item: list) -> Iterator[list]:
    for child in item[4]:
        if child[0] == "e":
            yield from _texts(child)
        else:
            yield child


def rules_of(found: list) -> tuple[set[str], set[tuple[str, str]], set[str]]:
    """``places`` read back from JSON."""
    chosen, constants, parts = found
    return set(chosen), {(at, text) for at, text in constants}, set(parts)


def plain(s: str) -> str:
    """A sign without its id."""
    return " ".join(x for x in re.split(r" (?=(?:class|id|role)=)", s) if not x.startswith("id="))


def heaviest(root: Element, constants: set[tuple[str, str]], parts: set[str]) -> tuple[set[int], set[int]]:
    """The element of a page with most text that is no constant in paragraphs
    outside links, with those of the same path, ids apart; and the elements
    around several of them, whose headings belong to them. Elements are named by
    their ``id()``."""
    mass: dict[str, int] = {}
    found: dict[str, list[Element]] = {}
    around: dict[int, Element] = {}
    said: dict[int, int] = {}  # characters of paragraphs, headings left out

    def walk(node: Element, at: str, path: str) -> int:
        at, path, own = f"{at}/{node.sign}", f"{path}/{plain(node.sign)}", 0
        if kind_of(node.sign) == 2 or at in parts:
            return 0
        found.setdefault(path, []).append(node)
        headings = 0
        for child in node.children:
            if isinstance(child, Block):
                own += max(0, len(child.text) - 2 * child.linked) if (at, child.text) not in constants else 0
            else:
                around[id(child)] = node
                below = walk(child, at, path)
                # paragraphs count for the element they stand in
                own += below if child.sign.split(" ")[0] in PARAGRAPHS else 0
                headings += below if child.sign.split(" ")[0] in HEADINGS else 0
        mass[path] = mass.get(path, 0) + own
        said[id(node)] = own - headings
        return own

    walk(root, "", "")
    best = max(found, key=lambda k: mass[k], default="")
    if not mass.get(best):
        return set(), set()
    group, size = found[best], mass[best]
    while outer := {id(a): a for a in (around.get(id(x)) for x in group) if a}:
        # out of nested sections, and where much text stands around them too
        nested = all(plain(a.sign) == plain(group[0].sign) != "div" for a in outer.values())
        more = sum(said[a] for a in outer)
        if not nested and 4 * more < size:
            break
        group, size = list(outer.values()), size + more
    parents = [id(around[id(x)]) for x in group if id(x) in around]
    return {id(x) for x in group}, {p for p in parents if parents.count(p) > 1}


def main_text(page: str, chosen: set[str], constants: set[tuple[str, str]], parts: set[str] = frozenset()) -> str:
    """The blocks of a page at its places: its articles among the host's chosen
    paths, else its main parts, else its heaviest elements; confirmed parts left out."""
    root = parse(page)
    out: list[str] = []

    def walk(node: Element, path: str, inside: bool, header: bool, fixed: set, starts: Callable[[Element, str], bool], titled: set[int]) -> None:
        at = f"{path}/{node.sign}"
        name = node.sign.split(" ")[0]
        if starts(node, at):
            inside = True
        elif kind_of(node.sign) == 2 or at in parts:
            if not (inside and is_header(node.sign)):
                return
            header = True  # of the article itself: its headings stay
        for child in node.children:
            if isinstance(child, Element):
                taken = inside or (id(node) in titled and child.sign.split(" ")[0] in HEADINGS)
                walk(child, at, taken, header, fixed, starts, titled)
            elif inside and (at, child.text) not in fixed and (not header or name in HEADINGS):
                out.append(child.text)

    for fixed in (constants, set()) if constants else (constants,):
        for kind in (True, False):
            walk(root, "", False, False, fixed, lambda node, at, kind=kind: at in chosen and is_article(node.sign) == kind, set())
            if out:
                return "\n\n".join(out)
        best, titled = heaviest(root, fixed, parts)
        walk(root, "", False, False, fixed, lambda node, at, best=best: id(node) in best, titled)
        if out:
            break
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Hosts whose wrappers a task holds before it sends them on.
HELD = 2000


def wrappers(pages: DataFrame) -> DataFrame:
    """From (host, html): one row per host with its wrapper (JSON) and places."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list]] = {}

        def sent() -> pa.RecordBatch:
            rows = [(h, n, json.dumps(w)) for h, (n, w) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "n", "wrapper"])

        for batch, parts in chunks(batches, "html"):
            for host, page in zip(batch.column(0).to_pylist(), parts, strict=True):
                made = wrap(parse(page.decode()))
                n, old = held.get(host, (0, made))
                held[host] = n + 1, merge(old, made) if n else made
            if len(held) >= HELD:
                yield sent()
        if held:
            yield sent()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, int, list] | None = None

        def row(host: str, n: int, wrapper: list) -> pa.RecordBatch:
            values = (host, n, json.dumps(wrapper), json.dumps(places(wrapper, n)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["host", "n_pages", "wrapper", "places"])

        for batch in batches:
            for host, n, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = json.loads(wrapper)
                if last and last[0] == host:
                    last = host, last[1] + n, merge(last[2], made)
                else:
                    if last:
                        yield row(*last)
                    last = host, n, made
        if last:
            yield row(*last)

    sent = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(infer, "host string, n long, wrapper string")
    dealt = sent.repartition("host").sortWithinPartitions("host", "wrapper")
    return dealt.mapInArrow(join, "host string, n_pages long, wrapper string, places string")


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``row`` (all columns of ``pages``), host, and ``text``."""
    named = pages.select(F.struct(*pages.columns).alias("row"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return _extracted(named)


def _extracted(named: DataFrame) -> DataFrame:
    found = cut_lineage(wrappers(named.select("host", "html")).select("host", "places"))
    both = named.join(small(found), "host", "left").select("row", "host", "html", "places")
    shape = named.select("row", "host", F.col("html").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[str], set[tuple[str, str]], set[str]]] = {}

        def rules(text: str) -> tuple[set[str], set[tuple[str, str]], set[str]]:
            if text not in known:
                if len(known) >= HELD:
                    known.clear()
                known[text] = rules_of(json.loads(text))
            return known[text]

        for batch, parts in chunks(batches, "html"):
            made = [main_text(p.decode(), *rules(r)) for p, r in zip(parts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["row", "host", "text"])

    return both.mapInArrow(run, shape)


def report(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars."""
    slim = F.struct(F.col(key).alias("key"), F.col(url).alias("url")).alias("row")
    named = pages.select(slim, host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return _extracted(named).select(F.col("row.key").alias(key), F.col("row.url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
