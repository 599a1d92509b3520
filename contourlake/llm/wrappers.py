"""HTML extraction by union-free regular-expression inference.

A page is a tree of block elements and texts. Equal siblings become one repeated
item; the trees of one host are then aligned one after the other, element by
element: an item that only one side has becomes optional, items whose order
differs become a repeated group of optional ones, a text that differs becomes a
slot. What results is a wrapper, a regular expression without alternatives. It
knows of each place how much text the pages put there, how much of it in links,
and whether pages that differ elsewhere have the same text there: that is the
template's. A page's article is then the element in which the host's pages say
something of their own; names of elements and words of classes decide between
places of which the wrapper leaves both open. Items that the wrapper found repeated,
signed by a reader and without a headline are comments, whatever they are called.

Wrappers are folded in each partition first, so a host that holds a third of all
pages costs one small wrapper a partition.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Elements that do not end a block, elements whose content is no text, and empty elements (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom".split())
RAW = frozenset("script style noscript template textarea svg annotation annotation-xml iframe object select title canvas audio video".split())
VOID = frozenset("area base col embed hr input link meta param source track br img wbr".split())
#: Elements that are a block of text or a part of one, not a place of its own.
PARTS = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 hr pre blockquote figcaption caption ul ol dl table thead tbody tfoot figure details".split())
#: Elements that end when one of these begins right inside of them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: Elements, and words in class, id or role, that say that a text is not the article's.
AROUND = frozenset("nav footer aside form menu dialog button head".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended comment comments respond disqus pagination pager widget toolbar search copyright legal disclaimer skip".split()
)
MAIN = frozenset(("article", "main"))
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role of an element that names who wrote a text (fixed values).
SIGNED_WORDS = frozenset("author user username nick nickname avatar byline poster writer who".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^\"'>]*)([\"'>]?)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in RAW}
_OPEN = {n: re.compile(rf"<{n}(?=[\s/>])", re.I) for n in RAW}
_BLANK = re.compile(r"\s+")

#: How the words of an element speak against it.
PLAIN, PARTLY, PLAINLY = 0, 1, 2
#: A place is forgotten by a host's wrapper if less than one of so many pages has it; so much of a page's own text the innermost element must hold to be the article's.
SELDOM, MOST = 1000, 0.9
#: What a wrapper says of a place: one text on pages that differ; mostly links; most pages have text there only; texts that differ; items of readers.
FIXED, LINKED, ALONE, DIFFERS, READERS = 1, 2, 4, 8, 16


def _tag_end(page: str, m: re.Match, state: dict) -> tuple[int, str]:
    """Where the tag ends and its attributes; quotes count after '=' and where they are closed, and once a tag never ends no longer."""
    at = m.end() - (1 if m[4] else 0)
    while not state["broken"]:
        s = _STOP.search(page, at)
        if s is None:
            state["broken"] = True
            break
        if s[0] == ">":
            return s.end(), page[m.start(3) : s.start()]
        at, before = s.end(), s.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and at <= state[s[0]]:
            at = page.index(s[0], at) + 1
    end = page.find(">", m.end(2))
    return (end + 1, page[m.start(3) : end]) if end >= 0 else (len(page), page[m.start(3) :])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page, kind being "open", "close" or "text", in time linear in its length; contents of RAW elements are left out."""
    at, n = 0, len(page)
    state = {"broken": False, '"': page.rfind('"'), "'": page.rfind("'")}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", html.unescape(page[at:])
            return
        if lt > at:
            yield "text", "", html.unescape(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                yield "text", "", page[lt + 9 : end if end >= 0 else n]
                at = end + 3 if end >= 0 else n
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        name = m[2].lower()
        if m[4] == ">":
            at, rest = m.end(), m[3]
        else:
            at, rest = _tag_end(page, m, state)
        if name in RAW:
            if not m[1] and not rest.endswith("/"):
                at = _raw_end(page, name, at, state)
            continue
        yield "close" if m[1] else "open", name, rest


def _raw_end(page: str, name: str, at: int, state: dict) -> int:
    """Where a RAW element's content ends; without an end tag scripts and styles last to the end of the page, others hold nothing."""
    if name in state:
        return state[name] or at
    depth, start = 1, at
    while depth:
        end = _CLOSE[name].search(page, at)
        if end is None:
            state[name] = len(page) if name in ("script", "style") else 0
            return state[name] or start
        if name not in ("script", "style", "textarea", "title"):
            depth += len(_OPEN[name].findall(page, at, end.start()))
        depth -= 1
        at = end.end()
    return at


def _words(attrs: str) -> tuple[int, str]:
    """How the words of class, id and role speak against an element, and those of letters alone, in order."""
    strength, found = PLAIN, set()
    for value in _ATTR.findall(attrs):
        for token in value.lower().strip("\"'").split():
            words = [w for w in re.split(r"[^a-z0-9]+", token) if w.isalpha()]
            found.update(words)
            hits = sum(w in AROUND_WORDS for w in words)
            if hits:
                strength = max(strength, PLAINLY if hits == len(words) else PARTLY)
    return strength, " ".join(sorted(found))


class Slot:
    """A place of a wrapper: an element by the elements around it. Texts right inside of it are its item '#'."""

    __slots__ = ("alone", "chars", "high", "key", "kids", "links", "low", "order", "pages", "parent", "signed", "text", "times")

    def __init__(self, parent: int, key: str):
        self.parent, self.key = parent, key
        #: Pages and elements seen, items with how many elements have them and whether any has several in a row, and groups of items in order.
        self.pages, self.times, self.kids, self.order = 1, 0, {}, []
        #: Characters of text, of these in links, the text's digest ("" once it differs), and least and largest digest of the pages.
        self.chars, self.links, self.text, self.low, self.high = 0, 0, None, None, None
        #: Pages that have all their text in such elements, and whether right inside of one stands who wrote it.
        self.alone, self.signed = 0, False

    def saw(self, items: list[str]) -> None:
        """One element with these items in order."""
        self.times += 1
        runs = [k for i, k in enumerate(items) if i == 0 or items[i - 1] != k]
        several = {k for i, k in enumerate(items) if i and items[i - 1] == k}
        for k in dict.fromkeys(runs):
            known = self.kids.setdefault(k, [0, False])
            known[0] += 1
            known[1] |= k in several
        self.order = merged_order(self.order, grouped(runs))

    def absorb(self, other: Slot) -> None:
        self.pages += other.pages
        self.times += other.times
        for k, (n, several) in other.kids.items():
            known = self.kids.setdefault(k, [0, False])
            known[0] += n
            known[1] |= several
        if self.order != other.order:
            self.order = merged_order(self.order, other.order)
        self.chars += other.chars
        self.links += other.links
        self.alone += other.alone
        self.signed |= other.signed
        if other.text is not None:
            self.low, self.high = (other.low, other.high) if self.low is None else (min(self.low, other.low), max(self.high, other.high))
            self.text = other.text if self.text in (None, other.text) else ""

    def constant(self) -> bool:
        """Whether pages that differ in other places have one text here."""
        return bool(self.text) and self.low != self.high

    def row(self) -> list:
        return [self.parent, self.key, self.pages, self.times, self.kids, self.order, self.chars, self.links, self.text, self.low, self.high, self.alone, self.signed]

    @classmethod
    def of(cls, row: list) -> Slot:
        out = cls(row[0], row[1])
        _, _, out.pages, out.times, out.kids, out.order, out.chars, out.links, out.text, out.low, out.high, out.alone, out.signed = row
        return out


def grouped(runs: list[str]) -> list[list[str]]:
    """Items in order, each once: what stands between the first and the last of an item is one group with it."""
    last = {k: i for i, k in enumerate(runs)}
    out: list[list[str]] = []
    reach = -1
    for i, k in enumerate(runs):
        if i > reach:
            out.append([])
        out[-1].append(k)
        reach = max(reach, last[k])
    return [sorted(set(g)) for g in out]


def merged_order(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    """Two orders as one that both follow: groups that either order crosses become one group."""
    if not a or not b or a == b:
        return a or b
    where = {k: i for i, g in enumerate(a) for k in g}
    out: list[tuple[int, list[str]]] = []  # the first group of a in each, and its items
    done = 0  # groups of a that are in `out`
    for g in b:
        at = [where[k] for k in g if k in where]
        keys = [k for k in g if k not in where]
        if at:
            low, high = min(at), max(at)
            while done < low:
                out.append((done, a[done]))
                done += 1
            first = done
            while out and first > low:
                first, held = out.pop()
                keys += held
            while done <= high:
                keys += a[done]
                done += 1
            out.append((min(first, low), sorted(set(keys))))
        else:
            out.append((done, keys))
    return [g for _, g in out] + a[done:]


_PLACES: dict[tuple[int, str], int] = {}


def _place(parent: int, key: str) -> int:
    """A number for an element by the elements around it, the same on all machines."""
    found = _PLACES.get((parent, key))
    if found is None:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        found = _PLACES[parent, key] = int.from_bytes(hashlib.blake2b(f"{parent} {key}".encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1
    return found


class Page:
    """A page's slots, outer ones before inner ones, and its blocks: the slot's number, the text, and how much of it is in links."""

    def __init__(self, page: str):
        self.slots: dict[int, Slot] = {0: Slot(-1, "")}
        self.names: dict[int, str] = {0: ""}
        self.strength: dict[int, int] = {0: PLAIN}
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int, list[str]]] = [("", 0, [])]
        open_names: Counter = Counter()
        parts: list[str] = []
        links, in_link = 0, False

        def flush() -> None:
            nonlocal links
            text = _BLANK.sub(" ", "".join(parts)).strip()
            if text:
                stack[-1][2].append("#")
                self.blocks.append((stack[-1][1], text, links))
            parts.clear()
            links = 0

        def pop() -> str:
            name, place, items = stack.pop()
            open_names[name] -= 1
            self.slots[place].saw(items)
            return name

        for kind, name, rest in tokens(page):
            if kind == "text":
                parts.append(rest)
                if in_link:
                    links += len(rest.strip())
                continue
            if name in INLINE:
                if name == "a":
                    in_link = kind == "open"
                elif name == "br":
                    parts.append(" ")
                if kind == "open" and "=" in rest and not SIGNED_WORDS.isdisjoint(_words(rest)[1].split()):
                    self.slots[stack[-1][1]].signed = True
                continue
            flush()
            if kind == "close":
                if open_names[name]:
                    while pop() != name:
                        pass
                in_link = False
                continue
            if name in VOID:
                continue
            while stack[-1][0] == "p" or stack[-1][0] in ENDS.get(name, ()) or (name[0] == "h" and name[1:].isdigit() and stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit()):
                pop()
            strength, words = _words(rest) if "=" in rest else (PLAIN, "")
            key = f"{name}.{words}" if words else name
            stack[-1][2].append(key)
            if rest.endswith("/") and name not in PARTS:
                continue
            place = _place(stack[-1][1], key)
            if place not in self.slots:
                self.slots[place], self.names[place] = Slot(stack[-1][1], key), name
            if words and not SIGNED_WORDS.isdisjoint(words.split()):
                self.slots[stack[-1][1]].signed = True
            self.strength[place] = max(strength, self.strength.get(place, PLAIN))
            stack.append((name, place, []))
            open_names[name] += 1
        flush()
        while stack:
            pop()
        self._measure()

    def _measure(self) -> None:
        texts: dict[int, list[str]] = {}
        for place, text, links in self.blocks:
            slot = self.slots[place]
            slot.chars += len(text)
            slot.links += links
            texts.setdefault(place, []).append(text)
        #: Characters of text of each slot, and these in links; how the slot's own name and words speak against it.
        self.own = {p: (s.chars, s.links) for p, s in self.slots.items() if s.chars}
        self.marks = self._marks()
        spoken = self.spoken_against(frozenset(p for p, m in self.marks.items() if m == PARTLY))
        said = [t for p, own in texts.items() if not spoken[p] for t in own]
        whole = _digest(said or [t for _, t, _ in self.blocks])
        if not any(c > 2 * n and not spoken[p] and self.names[p] not in HEADS for p, (c, n) in self.own.items()):
            held = self.inside({p: c - min(c, 2 * n) for p, (c, n) in self.own.items()})
            for p, mark in self.marks.items():
                self.slots[p].alone = int(mark > PLAIN and held[p] > 0)
        for place, own in texts.items():
            slot = self.slots[place]
            slot.text, slot.low, slot.high = _digest(own), whole, whole

    def inside(self, weight: dict[int, float]) -> dict[int, float]:
        """For each slot the weight of it and of all slots in it."""
        out = {p: weight.get(p, 0) for p in self.slots}
        for p in reversed(self.slots):
            parent = self.slots[p].parent
            if parent >= 0:
                out[parent] += out[p]
        return out

    def _marks(self) -> dict[int, int]:
        """PLAIN, PARTLY or PLAINLY for each slot; an element that holds the page's main element, or a form its navigation, is layout."""
        names = self.names
        texts = {p: c for p, (c, _) in self.own.items()}
        filled = self.inside(texts)
        main = self.inside({p: 1 for p, n in names.items() if n in MAIN and filled[p]})
        layout = self.inside({p: 1 for p, n in names.items() if n in ("nav", "footer", "aside") or n in MAIN})
        in_main: dict[int, bool] = {}
        out = {}
        for p, s in self.slots.items():
            name = names[p]
            in_main[p] = name in MAIN or in_main.get(s.parent, False)
            if name in MAIN or name in ("html", "body", ""):
                out[p] = PLAIN
            elif name in AROUND:
                out[p] = PLAIN if name == "form" and layout[p] else PLAINLY
            elif name == "header" and not in_main[p] and not main[p]:
                out[p] = PLAINLY
            else:
                out[p] = PLAIN if main[p] and not in_main.get(s.parent, False) else self.strength[p]
        return out

    def spoken_against(self, lifted: frozenset[int] = frozenset()) -> dict[int, bool]:
        """Whether the slot or an element around it is marked, and not lifted."""
        marks, out = self.marks, {}
        for p, s in self.slots.items():
            out[p] = out.get(s.parent, False) or (marks[p] > PLAIN and p not in lifted)
        return out

    def article(self, known: dict[int, tuple[float, int]]) -> set[int]:
        """The slots whose texts are the article's. known: of each slot of the host's wrapper, its own text a page, and what the wrapper says of it."""
        marks = self.marks
        own = {p: known[p][0] if p in known else max(0, c - 2 * n) for p, (c, n) in self.own.items()}
        readers = self._readers(own, known)
        for p in readers:
            own[p] = 0
        outside = self.spoken_against()
        # a place that is only partly spoken against counts after all if it holds more than all that is not
        free = sum(w for p, w in own.items() if not outside[p])
        lifted: frozenset[int] = frozenset()
        weak = [p for p in self.slots if marks[p] == PARTLY and outside[p] and not outside.get(self.slots[p].parent, False)]
        if weak:
            held = self.inside({p: w for p, w in own.items() if not self._strongly(p)})
            lifted = frozenset(p for p in weak if held[p] > free)
            if lifted:
                outside = self.spoken_against(lifted)
        outside = self._nothing_else(own, known, outside, lifted)
        for p in readers:
            outside[p] = True
        mains, outer = self._mains(own, outside), set()
        if mains:
            roots = mains
        else:
            weight = {p: w for p, w in own.items() if not outside[p]}
            if not sum(weight.values()):
                weight = {p: max(0, c - 2 * n) for p, (c, n) in self.own.items() if not outside[p]}
            if not sum(weight.values()):
                weight = {p: c for p, (c, _) in self.own.items() if not outside[p]}
            roots, outer = self._narrowest(weight)
            # paragraphs elsewhere in which the host's pages differ
            outer |= {p for p, w in weight.items() if w > 0 and self.names[p] in PARTS and _says(known, p) & DIFFERS}
        within: dict[int, bool] = {}
        home: dict[int, int] = {}
        for p, s in self.slots.items():
            within[p] = p in roots or within.get(s.parent, False)
            home[p] = home[s.parent] if self.names[p] in PARTS and s.parent >= 0 else p
        use = {p for p in self.own if (within[p] or p in outer) and not outside[p]}
        if not mains:
            # lists of links right inside of the article's own element are its references
            kept = {p for p in roots if self.names[p] not in ("html", "body", "")}
            use -= {p for p in use if home[p] not in kept and _says(known, p) & LINKED and 2 * self.own[p][1] > self.own[p][0]}
        return use - self._template(use, known)

    def _readers(self, own: dict[int, float], known: dict[int, tuple[float, int]]) -> set[int]:
        """Texts in items of readers, and headlines of elements that hold nothing else; none if a page has no other text of its own."""
        inside: dict[int, bool] = {}
        for p, s in self.slots.items():
            inside[p] = inside.get(s.parent, False) or bool(_says(known, p) & READERS)
        found = {p for p in own if inside[p]}
        if not found or not any(w > 0 and p not in found and self.names[p] not in HEADS for p, w in own.items()):
            return set()
        texts = self.inside({p: 1 for p in own if p not in found and self.names[p] not in HEADS})
        items = self.inside({p: 1 for p in found})
        whole: dict[int, bool] = {}
        for p, s in self.slots.items():
            whole[p] = whole.get(s.parent, False) or (items[p] > 0 and not texts[p])
        return found | {p for p in own if whole[p]}

    def _nothing_else(self, own: dict[int, float], known: dict[int, tuple[float, int]], outside: dict[int, bool], lifted: frozenset[int]) -> dict[int, bool]:
        """`outside` without the form, or the element with words against it, that holds all that the page says of its own, if most of the host's pages that have it say nothing elsewhere."""
        while not any(w > 0 and not outside[p] and self.names[p] not in HEADS for p, w in own.items()):
            held = self.inside(own)
            open_ = [p for p, s in self.slots.items() if outside[p] and not outside.get(s.parent, False) and held[p] > 0 and (p not in known or _says(known, p) & ALONE) and (self.names[p] == "form" or self.names[p] not in AROUND and self.names[p] != "header")]
            if not open_:
                break
            lifted |= {max(open_, key=held.__getitem__)}
            outside = self.spoken_against(lifted)
        return outside

    def _strongly(self, p: int) -> bool:
        while p > 0:
            if self.marks[p] == PLAINLY:
                return True
            p = self.slots[p].parent
        return False

    def _mains(self, own: dict[int, float], outside: dict[int, bool]) -> set[int]:
        """The outermost main elements with text; those in elements that are spoken against only where they hold more than the others."""
        chars = self.inside({p: c for p, (c, _) in self.own.items() if not outside[p]})
        held = self.inside({p: w for p, w in own.items() if not outside[p]})
        state: dict[int, tuple[bool, bool]] = {}  # in a main element, in one with words against it
        found: dict[bool, list[int]] = {False: [], True: []}
        for p, s in self.slots.items():
            inside, framed = state.get(s.parent, (False, False))
            if self.names[p] in MAIN and not inside and chars[p]:
                found[framed].append(p)
            state[p] = (inside or self.names[p] in MAIN, framed or (self.strength[p] > PLAIN and self.names[p] not in ("html", "body")))
        weight = {k: sum(held[p] or chars[p] for p in x) for k, x in found.items()}
        return set(found[False] + found[True]) if weight[True] > weight[False] else set(found[False])

    def _narrowest(self, weight: dict[int, float]) -> tuple[set[int], set[int]]:
        """The innermost element, no part of a text, that still holds most of the weight; the texts of weight right inside of the elements around it."""
        held = self.inside(weight)
        need, around = MOST * held[0], [0]
        for p, s in self.slots.items():
            if s.parent == around[-1] and held[p] >= need and held[p] and self.names[p] not in PARTS:
                around.append(p)
        outer, home = set(around[:-1]), {}
        for p, s in self.slots.items():
            home[p] = home[s.parent] if self.names[p] in PARTS else p
        return {around[-1]}, {p for p, w in weight.items() if w > 0 and home[p] in outer}

    def _template(self, use: set[int], known: dict[int, tuple[float, int]]) -> set[int]:
        """Of these slots those in elements whose whole text is the template's, unless that is the larger part of all."""
        said = {p: self.own[p][0] for p in use}
        fixed = {p: n for p, n in said.items() if _says(known, p) & FIXED}
        if not fixed or 2 * sum(fixed.values()) > sum(said.values()):
            return set()
        whole, constant = self.inside(said), self.inside(fixed)
        gone: dict[int, bool] = {}
        for p, s in self.slots.items():
            gone[p] = gone.get(s.parent, False) or (whole[p] > 0 and whole[p] == constant[p] and self.names[p] not in PARTS)
        return {p for p in use if gone[p]}


def _says(known: dict[int, tuple[float, int]], p: int) -> int:
    return known[p][1] if p in known else 0


def _digest(texts: list[str]) -> str:
    return hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=12).hexdigest()


class Wrapper:
    """The slots of a host's pages, and how many pages these are."""

    def __init__(self, slots: dict[int, Slot] | None = None, pages: int = 0):
        self.slots, self.pages = slots or {}, pages

    def absorb(self, slots: dict[int, Slot], pages: int) -> None:
        """Align with a page, or with another wrapper, element by element."""
        self.pages += pages
        for place, slot in slots.items():
            known = self.slots.get(place)
            if known is None:
                self.slots[place] = slot
            else:
                known.absorb(slot)

    def pruned(self) -> Wrapper:
        """Without places that less than one of SELDOM pages has: what is left is at most SELDOM times an average page's."""
        kept: dict[int, Slot] = {}
        for place, slot in sorted(self.slots.items(), key=lambda x: x[1].pages, reverse=True):
            if slot.pages * SELDOM >= self.pages:
                kept[place] = slot
        return Wrapper(kept, self.pages)

    def expression(self, place: int = 0) -> str:
        """The regular expression of what is in an element: '#' for a text, ? for optional, + for repeated and * for both."""
        slot, out = self.slots[place], []
        for group in slot.order:
            items = []
            for k in group:
                n, several = slot.kids[k]
                inner = "#" if k == "#" else f"{k}<{self.expression(_place(place, k))}>" if _place(place, k) in self.slots else f"{k}<>"
                maybe = n < slot.times or len(group) > 1
                items.append(f"({inner})" + ("*" if maybe and several else "+" if several else "?") if maybe or several else inner)
            out.append(f"({' '.join(items)})+" if len(group) > 1 else items[0])
        return " ".join(out)

    def readers(self) -> set[int]:
        """The innermost items around what somebody signs that repeat, alone or in a group, and have no headline: what readers write."""

        def repeats(p: int) -> bool:
            s = self.slots[p]
            around, name = self.slots.get(s.parent), s.key.partition(".")[0]
            if around is None or s.key not in around.kids or name in MAIN or (name in PARTS and name != "li"):
                return False
            return around.kids[s.key][1] or any(len(g) > 1 and s.key in g for g in around.order)

        headed: set[int] = set()
        for p, s in self.slots.items():
            if s.key.partition(".")[0] in HEADS:
                while p in self.slots and p not in headed:
                    headed.add(p)
                    p = self.slots[p].parent
        found = set()
        for p, s in self.slots.items():
            if s.signed:
                while p in self.slots and not repeats(p):
                    p = self.slots[p].parent
                if p in self.slots and p not in headed:
                    found.add(p)
        return found

    def roles(self) -> bytes:
        """Of each slot of which there is something to say: its number, its own text a page, and what the wrapper says of it."""
        readers, rows = self.readers(), []
        for p, s in sorted(self.slots.items()):
            kind = FIXED * s.constant() + LINKED * (2 * s.links > s.chars) + ALONE * (2 * s.alone > s.pages) + DIFFERS * (s.text == "") + READERS * (p in readers)
            if s.chars or s.alone or kind & READERS:
                rows.append((p, 0.0 if s.constant() else max(0, s.chars - 2 * s.links) / s.pages, kind))
        return np.array(rows, ROLE).tobytes()

    def dump(self) -> str:
        return json.dumps([self.pages, {str(p): s.row() for p, s in self.slots.items()}], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        pages, slots = json.loads(text)
        return cls({int(p): Slot.of(r) for p, r in slots.items()}, pages)


ROLE = np.dtype([("place", "<i8"), ("weight", "<f4"), ("kind", "u1")])


def _known(roles: bytes) -> dict[int, tuple[float, int]]:
    return {p: (w, k) for p, w, k in np.frombuffer(roles, ROLE).tolist()}


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, roles): the wrapper of each host, folded over all of its pages, and what it says of its slots.

    Pages without a url are one host of the empty name. Pages are folded
    partition by partition, then the partial wrappers in two rounds; a partial
    wrapper is bounded, as places that few pages have are left out of it.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Wrapper] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(host, Wrapper()).absorb(Page(page.as_py() or "").slots, 1)
        salt = TaskContext.get().partitionId() % 64
        hosts = list(found)
        for i in range(0, len(hosts), 64):
            some = hosts[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([salt] * len(some), pa.int32()), pa.array([found[h].pruned().dump() for h in some], pa.string())], names=["host", "salt", "wrapper"])

    def total(texts) -> Wrapper:
        out = Wrapper()
        for w in map(Wrapper.load, sorted(texts)):
            out.absorb(w.slots, w.pages)
        return out.pruned()

    def fold(pdf):
        return pdf.iloc[:1].assign(wrapper=total(pdf["wrapper"]).dump())

    def close(pdf):
        w = total(pdf["wrapper"])
        return pdf.iloc[:1][["host"]].assign(wrapper=w.dump(), roles=[w.roles()])

    partial = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(local, "host string, salt int, wrapper string")
    return partial.groupBy("host", "salt").applyInPandas(fold, partial.schema).groupBy("host").applyInPandas(close, "host string, wrapper string, roles binary")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with the html replaced by `text`, the article's blocks, one a line.

    On pages with text in main elements (article, main) the article is these;
    those in an element that is spoken against count only where they hold more
    than the others. On other pages it is the innermost element that holds most
    of the text that is neither in links nor the template's, with such texts right
    inside of the elements around it, as a headline, and paragraphs elsewhere that
    differ from page to page. In it, elements whose names or words speak against
    them are left out, items of readers, and elements whose whole text the template
    has; a form, or an element with such words, that holds all that its host's pages
    say stays; words that are part of a compound, as in
    "comment-free", do so only where the element holds no more than the rest.

    Null and empty html give the empty text. Repeated rows are extracted alike;
    other columns pass through; a column named text is replaced; an empty table
    gives an empty table.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    wrappers = written(infer_wrappers(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("roles").alias("__roles")))
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _host(F.col(url_col)).alias("h"), F.col(html_col).alias("page"))
    joined = source.join(wrappers, F.col("h") == F.col("__host"), "left").select("row.*", F.col("__roles"), F.col("page").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[bytes, dict] = {}
        for batch in batches:
            texts = []
            for roles, html_ in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                known = loaded.get(roles)
                if known is None:
                    if len(loaded) > 500:
                        loaded.clear()
                    known = loaded[roles] = _known(roles)
                page = Page(html_.as_py() or "")
                use = page.article(known) if page.blocks else set()
                texts.append("\n".join(t for p, t, _ in page.blocks if p in use))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*kept, "text"])

    return joined.mapInArrow(run, pages.select(*[F.col(f"`{c}`") for c in kept]).schema.add("text", "string"))


def op6_wrappers(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
