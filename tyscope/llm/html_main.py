"""HTML extraction with site template removal.

Pass 1 parses every page and hashes its element subtrees (name, class, text and child
hashes). Spark counts, per host, the different main texts that each subtree's pages
have; copies of one article count once. A subtree that ``MIN_PAGES`` or more and at
least ``MIN_SHARE`` of a host's pages repeat is template; inside an article or main element,
where articles may share a list or a table, more than ``ROOT_SHARE`` of them must. Pass 2 joins each host's template hashes
(at most elements per page / ``MIN_SHARE`` of them) to its pages and deletes those
subtrees, next to what names itself menu, header, footer, sidebar, notice, advert, form,
script, style or comments. Names are whole class words and ids; inside an article fewer
of them count, and ids of headings and paragraphs nowhere (they are link targets). An element
around ``main`` is never dropped for its name, nor one around an ``article``, unless the
articles and main elements outside of it have as much text (a comment list, teasers).

Only containers are template candidates (divisions, lists, tables and the like); the
paragraphs and headings of an article are its text even where many articles share them.

Menus and adverts whose text changes recur by their place: a slot is a container's chain of
names and classes from the root on, without any text. A container outside of articles that
has half of its text in links, or any container with one word of a class from the lists, is
template where more than ``ROOT_SHARE`` of its host's pages have such a container in that
slot and it has less than half of the page's unlinked text.

A class whose words all are such names or say nothing ("comment-list", "ad-container") is a
name like a whole one. A form, a dialog or what is named by class, id or role stays where it
has the larger part of the text around it, and the unnamed text beside it is less than
``BESIDE`` of its own: a page inside a form is not a form. Menus, footers, asides, comments
and hidden elements never stay for their size.
The main text is that of ``main`` where that has text, and at least as much as the articles
outside of it, else that of the whole body; and of this only what ``article`` elements hold,
where they hold the larger part (a teaser card or an empty article does not). Where they do
not, articles stay that stand in the flow of the text (a quote between paragraphs of one
container), and those beside it go (teaser cards).

A block is the text between two block element tags: character references decoded, white
space made one space, trimmed. Blocks are joined by a line feed.

Cases: a null html is empty and gives an empty text; a null url belongs to the host ""; markup
that is cut off or not nested is closed as far as it came; a subtree repeated inside one
page counts once; an empty table gives an empty result; only page_id, url and html are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tyscope.llm.url_rules import host_path
from tyscope.session import materialize, ship_package

MIN_PAGES = 8
MIN_SHARE = 0.01
ROOT_SHARE = 0.5
BESIDE = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is passed over; ``annotation`` is a formula's source beside the formula
RAW = frozenset("""script style textarea title noscript iframe template xmp noembed noframes select svg annotation
    annotation-xml""".split())
#: those that hold the rest of a page where they are not closed; the others' tag is passed over alone
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr br img object math semantics maction merror mfenced mfrac mi
    mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable
    mtd mtext mtr munder munderover""".split())
CONTAINERS = frozenset("""div section ul ol dl table aside nav header footer form details menu fieldset center
    dialog hgroup address""".split())
ROOTS = {"main": 1, "article": 2}
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar sidebars
    nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices
    popup modal overlay newsletter subscribe comment comments disqus respond share sharing social related
    recommended widget widgets toolbar topbar pagination pager alert gdpr signup login search skip""".split())
NAMES |= {f"{whole}-{name}" for whole in ("site", "page") for name in NAMES}
#: what a class, an id or a role inside an article still says; its sections may be on search or hold alerts
ARTICLE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo sidebar sidebars
    nav navbar navigation breadcrumb breadcrumbs cookie cookies consent newsletter subscribe comments disqus respond
    share sharing related recommended pagination pager gdpr""".split())
ARTICLE_IDS = frozenset("comments disqus_thread respond".split())
#: parts of a class that say nothing about what it holds
PLAIN_PARTS = frozenset("""area bar bottom box container fixed form inner item items left link links list main mobile outer
    page panel right site slot sticky top unit wrap wrapper zone""".split())
COMMENT_NAMES = frozenset("comment comments disqus respond disqus_thread".split())
#: one of them among other words is a hint; a header may be that of the text
HINTS = NAMES - {"header"}
ARTICLE_HINTS = ARTICLE_NAMES | COMMENT_NAMES
#: never the main text, however long
NEVER = DROPPED - {"form", "dialog"} | {"header"}
ARTICLE_ROLES = ROLES - {"alert", "banner"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORS = HEADINGS | {"p"}
#: elements in whose flow text and articles stand
FLOWS = CONTAINERS - {"ul", "ol", "dl", "table"} | {"body", "main", "article", "td", "th", "li", "blockquote"}
#: an element that opens ends an open one of the listed kinds, unless one of the bounds is between
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
P_BOUND = frozenset("article section div main body html td th li aside nav header footer form blockquote table button".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>][^\s>]*)))?")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order."""
    at, n = 0, len(html)
    unclosed = set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        after = html[lt + 1:lt + 2]
        if after in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (after.isalpha() or after == "/" and html[lt + 2:lt + 3].isalpha()):
            if lt + 1 >= n:
                return
            yield "text", "<", ""
            at = lt + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if m is None:
            return  # a tag that is cut off
        at = m.end()
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and name not in unclosed and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            if end is not None:
                at = end.start()
            elif name in TO_THE_END:
                return
            else:
                unclosed.add(name)


class _Open:
    """An open element. ``slot`` is its chain of names and classes, ``flow`` the number of the innermost
    flow element at or around it, ``card`` that of the flow an article around it stands in, ``text`` and
    ``linked`` what the page had in letters before it."""

    __slots__ = ("name", "kind", "held", "root", "parts", "blocks", "slot", "hint", "flow", "card", "text", "linked")

    def __init__(self, name, kind, held, root, blocks, slot=b"", hint=False, flow=0, card=-1, text=0, linked=0):
        self.name, self.kind, self.held, self.root, self.parts, self.blocks = name, kind, held, root, [], blocks
        self.slot, self.hint, self.flow, self.card, self.text, self.linked = slot, hint, flow, card, text, linked


def attributes_of(source: str) -> Iterator[tuple[str, str]]:
    """(name, value) pairs, in small letters; the value of a bare name is empty."""
    for m in ATTRIBUTE.finditer(source):
        yield m[1].lower(), (m[2] or m[3] or m[4] or "").lower()


def class_parts(value: str) -> Iterator[list[str]]:
    """The words of each class: "comment-list" has two."""
    for one in value.split():
        yield [w for w in re.split(r"[-_]+", one) if w]


def names_itself(name: str, attributes: str, in_article: bool) -> str:
    """What an element calls itself other than main text: "never" where its size does not
    matter, "named" where the larger part of a page may stay, "hint" for a class with one
    such word, else ""."""
    if name in NEVER and not (name == "header" and in_article):
        return "never"
    said = "named" if name in DROPPED else ""
    if not attributes or name in ("html", "body", "article", "main"):
        return said
    names, roles = (ARTICLE_NAMES, ARTICLE_ROLES) if in_article else (NAMES, ROLES)
    for key, value in attributes_of(attributes):
        if key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "never"
        if key == "hidden" and value != "until-found":
            return "never"
        if key == "role" and value in roles:
            said = "named"
        elif key == "id" and name not in ANCHORS and value.strip() in (ARTICLE_IDS if in_article else NAMES):
            if value.strip() in COMMENT_NAMES:
                return "never"
            said = "named"
        elif key == "class":
            block = name not in INLINE  # code has spans of the class comment
            for one in value.split():
                if one in names or one == "comment" and block:
                    if block and one in COMMENT_NAMES:
                        return "never"
                    said = "named"
            for parts in class_parts(value):
                if len(parts) < 2:
                    continue
                some = not (ARTICLE_HINTS if in_article else NAMES).isdisjoint(parts)
                if some and all(w in NAMES or w in PLAIN_PARTS for w in parts):
                    if block and not COMMENT_NAMES.isdisjoint(parts):
                        return "never"
                    said = "named"
                elif some and not said and not HINTS.isdisjoint(parts):
                    said = "hint"
    return said


class _Named:
    """An element that names itself: the next one around it, the roots inside it, and whether
    its size cannot save it."""

    __slots__ = ("up", "roots", "never")

    def __init__(self, up, never):
        self.up, self.roots, self.never = up, set(), never


class _Block(NamedTuple):
    text: str
    held: int               # the innermost named element around it, -1 for none
    root: int               # 1 in main, 2 in an article, 3 in both, 0 elsewhere
    flow: int               # the flow element it stands in, -1 for a heading
    card: int               # the flow element that the article around it stands in, -1 for none
    linked: int             # letters of it in links
    pieces: Sequence = ()   # where parts of it lie in named elements: text, innermost named element


def _words(pieces: Iterable[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


def _summed(named: list[_Named], own: list[int]) -> list[int]:
    """Per named element its own text and that of the named ones inside it."""
    whole = own[:]
    for k in range(len(named) - 1, -1, -1):
        whole[named[k].up] += whole[k]
    return whole


def _kept(named: list[_Named], blocks: list[_Block]) -> list[bool]:
    """Per named element, whether its text stays; the last entry is for none (-1)."""
    in_roots = [0] * (len(named) + 1)   # text of roots that lies in it and in no named element inside it
    unlinked = in_roots[:]              # the same of all text but links
    for o in blocks:
        if o.root:
            in_roots[o.held] += len(o.text)
        unlinked[o.held] += max(0, len(o.text) - o.linked)
    whole, prose = _summed(named, in_roots), _summed(named, unlinked)
    kept = [True] * len(in_roots)
    for k, o in enumerate(named):
        rooted = ("main" in o.roots or "article" in o.roots) and whole[k] > in_roots[o.up]
        larger = not (o.never or o.roots or whole[-1]) and 2 * prose[k] > prose[o.up] and BESIDE * prose[k] > unlinked[o.up]
        kept[k] = kept[o.up] and (rooted or larger)
    return kept


def _main_part(found: list[tuple[str, _Block]]) -> list[str]:
    """Of the blocks with their texts the main text's."""
    size = [0] * 4
    for text, o in found:
        size[o.root] += len(text)
    whole = size[1] + size[3]
    if not whole or size[2] > whole:
        whole, base = sum(size), (0, 1, 2, 3)
    else:
        base = (1, 3)
    if 2 * sum(size[r] for r in base if r > 1) > whole:
        return [text for text, o in found if o.root > 1 and o.root in base]
    flows = {o.flow for _, o in found if o.root in base and o.root < 2}
    return [text for text, o in found if o.root in base and (o.root < 2 or o.card in flows)]


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"\x00".join(parts), digest_size=8).digest()


def extract(html: str, templates: frozenset = frozenset(), hashes: dict | None = None) -> str:
    """The main text of a page without the subtrees and slots in ``templates``; ``hashes`` gets the
    candidates' hashes as keys, odd ones for slots and for subtrees inside an article or main element."""
    blocks: list[_Block] = []
    stack = [_Open("", "block", -1, 0, 0)]
    now: list[tuple[str, int, bool]] = []   # the running block's pieces: text, innermost named element, in a link
    named: list[_Named] = []                # the elements that name themselves, outer ones first
    slots: list[tuple[int, int, int]] = []  # blocks from, to, and unlinked letters of the containers in template slots
    text = linked = links = flows = 0       # letters so far, those in links, links now open, flow elements so far

    def flush():
        nonlocal text, linked
        top = next(o for o in reversed(stack) if o.kind != "inline")
        words = _words(p for p, _, _ in now)
        if words:
            in_links = min(len(words), len(_words(p for p, _, link in now if link)))
            text, linked = text + len(words), linked + in_links
            mixed = len({held for _, held, _ in now}) > 1
            blocks.append(_Block(words, top.held if mixed else now[0][1], top.root, -1 if top.name in HEADINGS else top.flow,
                                 top.card, in_links, now[:] if mixed else ()))
            top.parts.append(words)
        now.clear()

    def close():
        nonlocal links
        o = stack[-1]
        if o.kind == "inline":
            stack.pop()
            links -= o.name == "a"
            return
        flush()
        stack.pop()
        h = _hash("\x00".join([o.name, o.kind, *o.parts]).encode("utf-8", "replace"))
        stack[-1 - next(k for k, p in enumerate(reversed(stack)) if p.kind != "inline")].parts.append(h.hex())
        if o.name not in CONTAINERS or not o.parts:
            return
        h = int.from_bytes(h, "big", signed=True) & ~1 | (o.root > 0)
        if hashes is not None:
            hashes[h] = True
        if h in templates:
            del blocks[o.blocks:]
            while slots and slots[-1][0] >= o.blocks:
                slots.pop()
            return
        letters, in_links = text - o.text, linked - o.linked
        if letters and (o.hint or not o.root and 2 * in_links >= letters):
            h = int.from_bytes(o.slot, "big", signed=True) | 1
            if hashes is not None:
                hashes[h] = True
            if h in templates:
                slots.append((o.blocks, len(blocks), letters - in_links))

    def end(names, bounds):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    close()
                return
            if stack[k].name in bounds:
                return

    for what, name, attributes in tokens(html):
        if what == "text":
            now.append((name, stack[-1].held, links > 0))
        elif what == "close":
            if name in ("br", "hr"):
                now.append((" ", stack[-1].held, links > 0))
            elif name not in VOID:
                end({name}, () if name not in INLINE else P_BOUND)
        elif name in ("br", "img", "wbr", "param"):
            now.append((" " if name == "br" else "", stack[-1].held, links > 0))
        elif name in VOID:
            flush()
        elif name not in RAW:  # whose text is not among the tokens
            inline = name in INLINE
            if not inline:
                end({"p"}, P_BOUND)
                if name in IMPLIED:
                    end(*IMPLIED[name])
            up = stack[-1]
            held = up.held
            said = names_itself(name, attributes, up.root > 1)
            if said and said != "hint":
                named.append(_Named(held, said == "never"))
                held = len(named) - 1
            root = up.root | ROOTS.get(name, 0)
            if name in ROOTS:
                k = held
                while k >= 0 and name not in named[k].roots:
                    named[k].roots.add(name)
                    k = named[k].up
            card = up.flow if name == "article" and up.card < 0 else up.card
            if inline:
                links += name == "a"
                stack.append(_Open(name, "inline", held, root, 0, up.slot, False, up.flow, card))
            else:
                flush()
                cls = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "")
                flows += 1
                stack.append(_Open(name, "block " + cls, held, root, len(blocks),
                                   _hash(up.slot, name.encode("utf-8", "replace"), cls.encode("utf-8", "replace")),
                                   said == "hint", flows if name in FLOWS else up.flow, card, text, linked))
    while len(stack) > 1:
        close()
    flush()
    gone = bytearray(len(blocks))
    for first, last, letters in reversed(slots):  # outer ones before those inside them
        if first < last <= len(blocks) and not gone[first] and 2 * letters < text - linked:
            gone[first:last] = b"\x01" * (last - first)
    blocks = [o for o, x in zip(blocks, gone) if not x]
    kept = _kept(named, blocks)
    found = []
    for o in blocks:
        words = _words(p for p, held, _ in o.pieces if kept[held]) if o.pieces else o.text if kept[o.held] else ""
        if words:
            found.append((words, o))
    return "\n".join(_main_part(found))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, subtree, article): once per batch."""
    for b in batches:
        found = {}
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            hashes: dict[int, bool] = {}
            text = extract(html or "", hashes=hashes)
            article = int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
            for h in hashes:
                found[host, h, article] = True
        cols = list(zip(*found)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
                                         ["host", "subtree", "article"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtrees) of the hosts with template subtrees; ``pages`` has host and html."""
    ship_package(pages.sparkSession)
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    counted = (pages.select("host", "html").mapInArrow(_hash_batches, "host string, subtree long, article long")
               .distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
               .where(F.col("pages") >= min_pages))
    enough = (F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, F.col("pages") > ROOT_SHARE * F.col("n"))
              .otherwise(F.col("pages") >= min_share * F.col("n")))
    return (counted.join(sizes, "host").where(enough)
            .groupBy("host").agg(F.collect_set("subtree").alias("subtrees")))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", host_path("url")[0].alias("host"), "html")
    templates = materialize(site_templates(rows, min_pages, min_share), "site-templates")

    def run(batches):
        sets: dict[str, frozenset] = {}
        for b in batches:
            texts = []
            for host, subtrees, html in zip(*(b.column(c).to_pylist() for c in ("host", "subtrees", "html"))):
                if host not in sets:
                    sets.clear()  # one host's set at a time is all a run of its pages needs
                    sets[host] = frozenset(subtrees or ())
                texts.append(extract(html or "", sets[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return (rows.join(templates, "host", "left").select("page_id", "url", "host", "subtrees", "html")
            .mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint"))
