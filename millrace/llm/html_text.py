"""Main text of web pages by rules over their blocks, in two passes.

A page falls into blocks of text between block-level tags. In the first pass a block is
good if it is long and rich in stop words; bad if it mostly consists of links or stands in
a menu, header, footer, sidebar, notice, advert, form or comment; else it is undecided. Stop
words are those of four languages. Where a page has no main element and most of its long text
has few of them, long blocks with few links are good whatever their words. In
the second pass an undecided block takes the label of the nearest decided neighbour; on a
tie a heading follows the later one, other blocks the earlier. Neighbours inside an article or main element are looked for there
first; what such an element holds is good if nothing in it is decided.

Menus and the like are known by element, role, hidden attribute or style, and class or id;
names that tell a state (has-sidebar) do not count. A class or id is sure if the whole name
or each of its parts says so (comment-list), else it is a guess (elementor-widget-container):
a guess does not hold for long blocks with few links in a main element, nor on pages that
have no other long block that is good. If all article and main elements of a page stand in
parts that only a class or id sets aside, they count nevertheless. A form or fieldset, or a
dialog in a main element, is a wrapper and no form if it has much text for its controls. Long
preformatted text follows its neighbours.

Character references are decoded, white space in a block becomes one space, and good
blocks are joined by line breaks in page order. Null pages and pages without text give an
empty text. Unclosed tags and comments end with the page. Repeated rows get equal texts.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_columns, texts

#: Characters from which a block counts as long, and the least share of stop words in a
#: good block; the least share of link text in a bad block.
LONG, STOP_SHARE, LINK_SHARE = 70, 0.25, 0.5
#: The most link text in a long block that is good by its length, in text of other languages.
FEW_LINKS = 0.2

# Common words of four languages, and names of HTML.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in is it its may more no not of on "
    "one or our out she so than that the their them then there they this to up was we were what when which who will "
    "with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos "
    "notre nous on ou par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous à "
    "als am auch auf aus bei bin bis bist da das dass dem den der des die doch ein eine einem einen einer er es für "
    "hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wie wir "
    "zu zum zur "
    "al algo como con cuando de del desde donde el ella ellos en entre era es esta está este esto ha hay la las le lo "
    "los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te todo un una uno y ya".split()
)
RAW = frozenset("script style noscript template textarea iframe noframes xmp svg canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul button".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside menu select button search head".split())
#: Set aside unless they hold much text for their controls.
FORMS = frozenset("form fieldset dialog".split())
CONTROLS = frozenset("input select textarea button".split())
#: Characters of long blocks for each control, from which on a form is a wrapper.
WRAPPED = 150
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager popup promo promotion related replies respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Parts of class names that say nothing about what an element is.
PLAIN = frozenset(
    "site page main box list item items left right top bottom section area block bar slot unit primary secondary global "
    "form thread js link links".split()
)
#: Parts of class names that tell a state of a page rather than what an element is.
STATES = frozenset("has have with without no not is open opened closed close enabled disabled active on off layout".split())
#: Elements that end where one of their own kind begins.
SAME_ENDS = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
    "option": {"select"}, "p": BLOCKS - {"p"},
}

_TAG = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",  # a quote that never ends
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Characters of scripts in which one says about as much as two letters.
_WIDE = re.compile("[\u2E80-\uD7FF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_PARTS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("text", "links", "aside", "main", "inner", "heading", "form", "code", "good")

    def __init__(self, text: str, links: int, aside: int, main: int, inner: int, heading: bool, form: int, code: bool):
        self.text, self.links, self.aside, self.main, self.inner, self.heading = text, links, aside, main, inner, heading
        self.form, self.code = form, code
        self.good: bool | None = None

    def long(self) -> bool:
        """A long block with few links."""
        return len(self.text) >= LONG and self.links < FEW_LINKS * len(self.text)


#: How an element is set aside: by a name that may mean something else, by its name, surely.
GUESSED, NAMED, SURE = 1, 2, 3


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _named_aside(found: dict[str, str]) -> int:
    """Does a class or the id name such a part? Tokens that tell a state do not."""
    kind = 0
    for token in found.get("class", "").split() + found.get("id", "").split():
        parts = _PARTS.findall(token)
        if STATES.isdisjoint(parts) and not ASIDE_NAMES.isdisjoint(parts):
            if all(p in ASIDE_NAMES or p in PLAIN for p in parts):
                return NAMED
            kind = GUESSED
    return kind


def _hidden(found: dict[str, str]) -> bool:
    style = "".join(found.get("style", "").split())
    return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _aside(name: str, found: dict[str, str], in_main: bool) -> int:
    """Does this element hold something beside the main text, and how is that known?"""
    if name in ASIDE or (name == "header" and not in_main):
        return SURE
    if _hidden(found) or not ASIDE_ROLES.isdisjoint(found.get("role", "").split()):
        return SURE
    return 0 if name in ("body", "html", "article", "main") else _named_aside(found)


def blocks(page: str) -> list[Block]:
    """Blocks of a page that hold text, with what is known of their place."""
    out: list[Block] = []
    # Name, aside, number of the main element, of one inside a part that only its name sets
    # aside, and of the innermost form.
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    opened: Counter[str] = Counter()
    # Of each form: the form around it, its controls, its long text, and whether it is set aside at once.
    forms: list[list[int]] = [[0, 0, 0, 0]]
    held: list[str] = []
    linked = depth = mains = inners = at = 0

    def end_block() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                heading = any(x[0] in HEADINGS for x in stack[-3:])
                _, aside, main, inner, form = stack[-1]
                out.append(Block(text, linked, aside, main, inner, heading, form, opened["pre"] > 0))
                if out[-1].long():
                    forms[form][2] += len(text)
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if depth:
                linked += len(" ".join(piece.split()))

    def pop_to(k: int) -> None:
        nonlocal depth
        for name, *_ in stack[k:]:
            depth -= name == "a"
            opened[name] -= 1
        del stack[k:]

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not name:
            continue
        if closing:
            # Only an element that is open is looked for.
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name) if opened[name] else 0
            if name in BLOCKS:
                end_block()
            if k:
                if any(x[0] in BLOCKS for x in stack[k:]):
                    end_block()
                pop_to(k)
            continue
        if name in CONTROLS and "hidden" not in attributes.lower():
            forms[stack[-1][4]][1] += 1
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCKS:
            end_block()
            if stack[-1][0] == "p":
                pop_to(len(stack) - 1)
        elif name == "br":
            held.append(" ")
        if name in SAME_ENDS and opened[name]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in SAME_ENDS[name]:
                    break
        if name in VOID or attributes.endswith("/"):
            continue
        _, aside, main, inner, form = stack[-1]
        found = _attributes(attributes) if attributes else {}
        if name in MAIN and not aside:
            mains += 1
            main = main or mains
        elif name in MAIN and aside < SURE and not inner and not main and not _named_aside(found):
            inners += 1
            inner = inners
        kind = _aside(name, found, bool(main or inner))
        if name in FORMS:
            at_once = name == "dialog" and not (main or inner)
            forms.append([form, 0, 0, at_once])
            form = len(forms) - 1
        aside = SURE if kind > GUESSED and inner else max(aside, kind)
        depth += name == "a"
        opened[name] += 1
        stack.append((name, aside, main, 0 if aside == SURE else inner, form))
    add(page[at:])
    end_block()
    _close_forms(out, forms)
    if not mains:  # the main elements of the page stand in wrappers with such a name
        for block in out:
            if block.inner and block.aside < SURE:
                block.aside, block.main = 0, block.inner
    _weigh_guesses(out)
    return out


def _close_forms(found: list[Block], forms: list[list[int]]) -> None:
    """Set aside what stands in a form that is no wrapper; what a form holds counts for those around it."""
    for around, controls, text, _ in reversed(forms[1:]):
        forms[around][1] += controls
        forms[around][2] += text
    # Where a page has a main element, a wrapper stands in it or around it.
    with_main = {b.form for b in found if b.main and b.aside < SURE}
    for form in range(len(forms) - 1, 0, -1):
        if form in with_main:
            with_main.add(forms[form][0])
    real = [False]
    for form, (around, controls, text, at_once) in enumerate(forms[1:], 1):
        beside = bool(with_main) and form not in with_main
        real.append(real[around] or bool(at_once) or beside or text < LONG or text <= WRAPPED * controls)
    for block in found:
        if real[block.form]:
            block.aside = SURE


def _weigh_guesses(found: list[Block]) -> None:
    """Drop guesses for long blocks in main elements, and where no other block would be good."""
    others = any(not b.aside and b.long() and (b.main or _rich(b.text)) for b in found)
    for block in found:
        if block.aside == GUESSED and (not others or (block.main and block.long())):
            block.aside = 0


def _rich(text: str) -> bool:
    words = _WORD.findall(text.lower())
    return bool(words) and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words)


def _decide(found: list[Block]) -> None:
    """First pass: good, bad or undecided.

    Long blocks with few stop words are bad outside main elements, unless they hold most of
    the long text of a page without main elements: its language is not one of the list then,
    and those with few links are good.
    """
    rich = few = 0
    poor: list[tuple[Block, int]] = []
    mains = False
    for block in found:
        n = len(block.text)
        mains = mains or (block.main > 0 and not block.aside)
        if block.aside or block.links >= LINK_SHARE * n:
            block.good = False
            continue
        size = n if block.text.isascii() else n + len(_WIDE.findall(block.text))
        if size < LONG:
            continue
        if n >= LONG and _rich(block.text):
            block.good = True
            rich += size
            continue
        if block.links < FEW_LINKS * n:
            few += size
        poor.append((block, n))
    other = not mains and few > rich
    for block, n in poor:
        if other:
            block.good = True if block.links < FEW_LINKS * n else None
        elif n >= LONG and not block.main and not block.code:
            block.good = False


def _inherit(found: list[Block]) -> None:
    """Second pass: undecided blocks follow the nearest decided neighbour."""
    n = len(found)

    def nearest(same_main: bool, free: list[int]) -> None:
        before, after = [None] * n, [None] * n
        last: dict[int, int] = {}
        for i in range(n):
            key = found[i].main if same_main else 0
            before[i] = last.get(key)
            if found[i].good is not None and not (same_main and found[i].aside):
                last[key] = i
        last = {}
        for i in range(n - 1, -1, -1):
            key = found[i].main if same_main else 0
            after[i] = last.get(key)
            if found[i].good is not None and not (same_main and found[i].aside):
                last[key] = i
        taken = {}
        for i in free:
            b, a = before[i], after[i]
            if b is not None or a is not None:
                later = b is None or (a is not None and a - i < i - b + found[i].heading)
                taken[i] = found[a if later else b].good
        for i, good in taken.items():
            found[i].good = good

    undecided = lambda: [i for i in range(n) if found[i].good is None]
    nearest(True, [i for i in undecided() if found[i].main])
    for i in undecided():
        if found[i].main:
            found[i].good = True
    nearest(False, undecided())
    for i in undecided():
        found[i].good = True


def main_text(page: str) -> str:
    found = blocks(page)
    _decide(found)
    _inherit(found)
    return "\n".join(b.text for b in found if b.good)


def with_main_text(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each."""

    def compute():
        def made(column: pa.Array) -> list:
            return [[main_text(p) for p in texts(column)]]

        return made

    return add_columns(pages, [source], [T.StructField(text, T.StringType())], compute)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: the main text and its length."""
    found = with_main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
