"""Main text of web pages by rules on blocks, in two passes.

A page is cut into blocks at its block elements.  The first pass decides what it can: blocks in
menus, headers, footers, sidebars, notices, adverts, forms and comments are out, as are those
that consist of links; blocks of an article or main element are in; elsewhere a block is in
or out by its length and its share of stop words, or by its length alone where the page has hardly a stop
word that is known here.  Short blocks that this leaves open
get the label of the nearest decided block in the second pass; between two that are as near, the
one that is in wins.  Where no block is in, those left open are.

An element is a menu and so on by its name, or by a class, id or role that names the thing itself
(``site-footer``, ``sidebar-left``), not a state or a lack of it (``has-sidebar``, ``nav-open``).  Forms, and what
such names mark, count for nothing around an article or main element that is not so
marked, or, without such an element, around most of the page's text.

Defined cases: a null or empty page has an empty text; unclosed elements end with what holds
them, items, terms and cells at the next one as well; repeated rows come out alike; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements, and words of class, id and role that say what an element is.
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
OUT = frozenset("nav footer aside menu dialog".split())
OUT_UNLESS_AROUND = frozenset(["form"])
IN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion "
    "related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget contentinfo "
    "complementary navigation alert".split()
)
# Words of a name that say a part or a place of the thing named, that it is lacking or elsewhere, and its state.
TAILS = frozenset(
    "area aside block body bottom box button buttons col column container content count form group icon icons inner item items left link "
    "links list main outer overlay panel primary right row secondary section slot strip text title top unit wrap wrapper".split()
)
NEGATIONS = frozenset("has hide is no not show shows with without".split())
STATES = frozenset("active closed collapsed disabled enabled expanded fixed off on open opened sticky visible".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he her his i in is it its not of on or she that the their they this to was we were which will "
    "with you der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de du des un une et en que qui dans pour pas sur ce il elle est au aux avec son se ne par plus "
    "el los las del y que en un una por con para es se no lo al su como más o".split()
)

# What the start of an element closes, and the elements that it does not reach beyond.
_CELLS = ("tr", "td", "th")
_SECTIONS = ("thead", "tbody", "tfoot", *_CELLS)
_CLOSES = {
    "li": ("li",),
    **dict.fromkeys(("dt", "dd"), ("dt", "dd")),
    **dict.fromkeys(("td", "th"), ("td", "th")),
    "tr": _CELLS,
    **dict.fromkeys(("thead", "tbody", "tfoot"), _SECTIONS),
}
_HOLDERS = {
    **{k: (BLOCK | SKIPPED) - {"address", "div", "p", "option", "legend", "dialog", *_CLOSES[k]} for k in ("li", "dt", "dd")},
    **dict.fromkeys(("td", "th"), frozenset(["table", "tr"])),
    **dict.fromkeys(("tr", "thead", "tbody", "tfoot"), frozenset(["table"])),
}

SHORT, LONG = 70, 200
LINKS, FEW_STOPS, MANY_STOPS = 0.5, 0.15, 0.3
# Share of stop words below which a page's language is taken to be another.
KNOWN = 0.05

_TAG = re.compile(r"""<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<comment>!--)|[!?/][^>]*+>)""")
_LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*+)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    out: bool
    inside: bool
    links: int
    mark: int = -1  # the nearest marked element around it
    label: bool | None = None


@lru_cache(maxsize=4096)
def _names_a_part(value: str, inside: bool) -> bool:
    """Whether a class, id or role names something that is no main text."""
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if not words or words[0] in NEGATIONS or words[-1] in STATES:
            continue
        while len(words) > 1 and words[-1] in TAILS:
            words.pop()
        # An article's header is part of it.
        if words[-1] in OUT_WORDS and not (inside and words[-1] == "header"):
            return True
    return False


@dataclass
class _Cutter:
    """Collects the text of the open elements and closes a block at each block element."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, bool, bool, bool, int]] = field(default_factory=list)  # name, skipped, out, inside, nearest mark
    marks: list[int] = field(default_factory=list)  # of each marked element the marked one around it
    holds: list[bool] = field(default_factory=list)  # whether an article is in it
    has_article: bool = False
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    in_link: int = 0
    places: dict[str, list[int]] = field(default_factory=dict)  # of the open elements, by name

    def state(self) -> tuple[bool, bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, False, -1)

    def text(self, value: str) -> None:
        if value and not self.state()[0]:
            self.parts.append(value)
            if self.in_link:
                self.links.append(value)

    def close_block(self) -> None:
        text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
        if text:
            _, out, inside, mark = self.state()
            links = len(_SPACE.sub(" ", unescape("".join(self.links))).strip())
            self.blocks.append(Block(text, out, inside, links, mark))
        self.parts, self.links = [], []

    def start(self, name: str, rest: str) -> None:
        if name == "a":
            self.in_link += 1
            return
        if name in BLOCK or name in SKIPPED:
            self.close_block()
        elif name == "br":
            self.text(" ")
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            return
        self.end_implied(name)
        skipped, out, inside, mark = self.state()
        named = [m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(rest)] if rest and name not in ("body", "html") else []
        # A page's header goes, an article's heading is part of it.
        gone = name in OUT or (name == "header" and not inside) or bool(rest and _HIDDEN.search(rest))
        marked = name in OUT_UNLESS_AROUND or any(_names_a_part(value, inside) for value in named)
        if marked:
            self.marks.append(mark)
            self.holds.append(False)
            mark = len(self.marks) - 1
        elif name in IN and not (gone or out or skipped):
            self.has_article = True
            if mark >= 0:
                self.holds[mark] = True
        if name in BLOCK or name in SKIPPED or gone or marked:
            self.places.setdefault(name, []).append(len(self.open))
            self.open.append((name, skipped or name in SKIPPED, out or gone, inside or name in IN, mark))

    def settle(self) -> list[Block]:
        """The blocks, out where a mark around them counts."""
        sizes = [0] * len(self.marks)
        for block in self.blocks:
            if block.mark >= 0:
                sizes[block.mark] += len(block.text)
        # Marked elements come after those around them.
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k] >= 0:
                sizes[self.marks[k]] += sizes[k]
                self.holds[self.marks[k]] |= self.holds[k]
        total = sum(len(b.text) for b in self.blocks if not b.out)
        counts: list[bool] = []
        for k, around in enumerate(self.marks):
            void = self.holds[k] or (not self.has_article and 2 * sizes[k] > total)
            counts.append(not void or (around >= 0 and counts[around]))
        for block in self.blocks:
            block.out = block.out or (block.mark >= 0 and counts[block.mark])
        return self.blocks

    def end_from(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.places[name].pop()
        del self.open[k:]

    def end_implied(self, name: str) -> None:
        if name == "p" or name == "option":
            if self.open and self.open[-1][0] == name:
                self.end_from(len(self.open) - 1)
        elif name in _CLOSES:
            holder = max((at[-1] for n, at in self.places.items() if at and n in _HOLDERS[name]), default=-1)
            closed = [at[-1] for n in _CLOSES[name] if (at := self.places.get(n)) and at[-1] > holder]
            if closed:
                self.end_from(min(closed))

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
            return
        if name in BLOCK or name in SKIPPED:
            self.close_block()
        if self.places.get(name):
            self.close_block()
            self.end_from(self.places[name][-1])


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    cutter, at, lower = _Cutter(), 0, None
    while True:
        opens = html.find("<", at)
        if opens < 0:
            cutter.text(html[at:])
            break
        cutter.text(html[at:opens])
        tag = _TAG.match(html, opens) or _LOOSE_TAG.match(html, opens)
        if tag is None:
            # A lone angle bracket is text.
            cutter.text("<")
            at = opens + 1
            continue
        at = tag.end()
        groups = tag.groupdict()
        if groups.get("comment"):
            ends = html.find("-->", at)
            at = len(html) if ends < 0 else ends + 3
        elif groups["name"]:
            name = groups["name"].lower()
            if groups["end"]:
                cutter.end(name)
                continue
            cutter.start(name, groups["rest"])
            if name in RAW:
                lower = html.lower() if lower is None else lower
                ends = lower.find(f"</{name}", at) if len(lower) == len(html) else html.find(f"</{name}", at)
                ends = len(html) if ends < 0 else ends
                if name == "title":
                    cutter.text("" if cutter.state()[0] else html[at:ends])
                at = ends
    cutter.close_block()
    return cutter.settle()


def _stop_words(block: Block) -> tuple[int, int]:
    """(stop words, words)."""
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _decided(block: Block, known: bool) -> bool | None:
    """In, out, or open."""
    length = len(block.text)
    if block.out or block.links > LINKS * length:
        return False
    if block.inside:
        return True
    if length < SHORT:
        return False if block.links or "©" in block.text else None
    if not known:
        return True if length > LONG else None
    stops, words = _stop_words(block)
    stops /= words
    if stops >= MANY_STOPS or (stops >= FEW_STOPS and length > LONG):
        return True
    return None if stops >= FEW_STOPS else False


def classify(blocks: list[Block]) -> list[Block]:
    """The blocks, each with its label."""
    running = [_stop_words(b) for b in blocks if not (b.out or b.inside) and len(b.text) >= SHORT]
    known = sum(s for s, _ in running) >= KNOWN * sum(n for _, n in running)
    labels = [_decided(b, known) for b in blocks]
    if True not in labels:
        # Nothing to inherit from: a page of short blocks keeps them.
        labels = [label is None for label in labels]
    nearest: list[list[tuple[int, bool]]] = [[] for _ in blocks]
    for places in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last = None
        for k in places:
            if labels[k] is not None:
                last = k
            elif last is not None:
                nearest[k].append((abs(k - last), not labels[last]))
    for block, label, near in zip(blocks, labels, nearest):
        block.label = label if label is not None else not min(near)[1]
    return blocks


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(html or "")) if b.label)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """(*keep, text, n_chars) per row of ``pages``.  No shuffle."""
    schema = T.StructType([*[pages.schema[k] for k in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v) for v in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*keep, html).mapInArrow(extract, schema)
