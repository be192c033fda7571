"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Parts that their element, role, class or id marks as menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment are left out from the start.

First pass, a block by itself: one of much linked text is bad, a long one with enough stop words is good, all others
stay open. Stop words are those of four languages and those that the pages themselves show to be such: words that a
given share of all long, little linked blocks hold (``learnt_words``).

Second pass, open blocks: a long one (of a language without known stop words, or of lists, names and figures) is
good if a decided neighbour on either side of it is, or if its container has no good block to compare it with. A short one takes the
label of the nearest decided neighbour of its container (both, if equally near, must be good), a heading that of what
follows it; without any, it is good inside <article> or <main> and bad elsewhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, tidy, work_dir

#: Shorter blocks are left open; longer ones need this share of stop words, and at most this share of linked text.
SHORT, STOP_SHARE, LINK_SHARE = 70, 0.25, 0.4
#: A word is a stop word if this share of all long, little linked blocks hold it, and so many of them at least.
LEARNT_SHARE, LEARNT_BLOCKS = 0.02, 200
#: Words that a task counts before it hands its counts on.
COUNTED = 200_000

# Element names and the words by which pages name their parts.
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_OUT = set("nav footer aside form menu select button dialog template svg canvas audio video object head search".split())
_WHOLE = {"main", "article"}
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NAMES = set(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright".split()
)
_COMMENTS = set("comment comments commentlist disqus reply replies respond discussion".split())
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTENT = set("content main article post entry body page wrapper wrap container layout story text".split())
_STOP = frozenset("""a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their they this to was we were which will with you
der die das den dem des ein eine einer und ist von zu mit auf für nicht sich auch als an aus bei nach im wird sind es er sie ich wir
de la le les un une des du et est en que qui dans pour pas sur au par avec il elle ce se ne plus son sont nous vous
el los las una y por con para del se lo como más su al es no sus este esta pero o ha si sobre""".split())
_TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FOREIGN = ("svg", "math")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""", re.S
)
_REST = re.compile(r".+", re.S)  # no tag ends after the last ">"
_ATTR = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-z0-9]+")


class _Block:
    __slots__ = ("home", "linked", "parts", "title")

    def __init__(self, home: int, title: bool):
        self.parts: list[str] = []
        self.linked, self.home, self.title = 0, home, title


def _attributes(attrs: str) -> dict[str, str]:
    """Names and values in lower case, the first of each name."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _left_out(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element and all in it is no main text. inside: it stands in an article."""
    if name in _OUT or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if name in _WHOLE:
        return False
    if attrs.get("role") in _ROLES:
        return True
    names = set(_PARTS.split(attrs.get("class", "") + " " + attrs.get("id", "")))
    if names & _COMMENTS:
        return True
    return bool(names & _NAMES) and not names & _CONTENT or "header" in names and not inside and not names & _CONTENT


class _Stack:
    """Open elements. Each name knows where it is open, so a tag of any kind costs no walk over the others."""

    def __init__(self):
        self.items: list[tuple[str, bool, int, bool]] = []  # name, left out, home, in a link
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []  # places of blocks other than paragraphs

    def push(self, name: str, shut: bool, home: int, link: bool) -> None:
        self.at[name].append(len(self.items))
        if name in _BLOCK and name != "p":
            self.walls.append(len(self.items))
        self.items.append((name, shut, home, link))

    def cut(self, place: int) -> None:
        """Closes all from place on."""
        while len(self.items) > place:
            name = self.items.pop()[0]
            self.at[name].pop()
            if self.walls and self.walls[-1] == len(self.items):
                self.walls.pop()

    def wall(self) -> int:
        return self.walls[-1] if self.walls else -1

    def top(self) -> tuple[bool, int, bool]:
        return self.items[-1][1:] if self.items else (False, 0, False)

    def in_title(self) -> bool:
        """Whether the innermost block is a heading."""
        return bool(self.walls) and self.items[self.walls[-1]][0] in _TITLES and not (self.at["p"] and self.at["p"][-1] > self.wall())

    def close(self, name: str) -> None:
        """An end tag: paragraphs and inline elements do not close the blocks around them."""
        places = self.at[name]
        if places and (name in _BLOCK and name != "p" or places[-1] > self.wall()):
            self.cut(places[-1])

    def open_block(self, name: str) -> None:
        """What the start of a block ends: an open paragraph, and an item of the same list."""
        if self.at["p"] and self.at["p"][-1] > self.wall():
            self.cut(self.at["p"][-1])
        while self.walls and self.items[self.walls[-1]][0] in _ITEMS.get(name, ()):
            self.cut(self.walls[-1])


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, without those that are left out from the start; home is 0 outside articles."""
    out: list[_Block] = []
    stack, homes, now, i = _Stack(), 0, None, 0
    shut, home, link, title = False, 0, False, False
    last = page.rfind(">")
    while i < len(page):
        m = (_TOKEN if i <= last else _REST).match(page, i)
        i = m.end()
        name = (m[2] or m[5]) if m.re is _TOKEN else None
        if name is None:
            text = m[0]
            if shut or text[0] == "<" and len(text) > 1 and m.re is _TOKEN:
                continue
            if now is None:
                now = _Block(home, title)
                out.append(now)
            text = html.unescape(text)
            now.parts.append(text)
            if link:
                now.linked += len("".join(text.split()))
            continue
        name, attrs = name.lower(), (m[3] if m[2] else m[6]) or ""
        if name in _BLOCK:
            now = None
        elif name == "br" and now is not None:
            now.parts.append("\n")
        if m[1] if m[2] else m[4]:
            stack.close(name)
        elif name in _RAW:
            end = _RAW_END[name].search(page, i)
            i = end.end() if end else len(page)
            continue
        elif name not in _VOID:
            if name in _BLOCK:
                stack.open_block(name)
            # outside svg and math HTML ignores a slash at the end
            if not (attrs.endswith("/") and (name in _FOREIGN or any(stack.at[f] for f in _FOREIGN))):
                shut, home, link = stack.top()
                found = _attributes(attrs) if attrs else {}
                if name in ("article", "main") or found.get("role") == "main":
                    homes += not home
                    home = home or homes
                stack.push(name, shut or _left_out(name, found, bool(home)), home, link or name == "a")
        shut, home, link = stack.top()
        title = stack.in_title()
    return out


def _texts(page: str) -> list[tuple[str, _Block]]:
    """Blocks that are not empty, with their texts."""
    found = [(" ".join("".join(b.parts).split()), b) for b in blocks(page)]
    return [(t, b) for t, b in found if t]


def _linked(text: str, block: _Block) -> bool:
    return block.linked > LINK_SHARE * max(1, len(text) - text.count(" "))


def _first_label(text: str, block: _Block, stop: frozenset[str]) -> bool | None:
    """Good, bad, or None for a block that the second pass decides."""
    if _linked(text, block):
        return False
    if len(text) < SHORT or block.title:
        return None
    words = _WORDS.findall(text.lower())
    return True if len([w for w in words if w in stop]) >= STOP_SHARE * max(1, len(words)) else None


_Near = list[tuple[int, bool] | None]


def _neighbours(labels: list[bool | None], homes: list[int]) -> tuple[_Near, _Near]:
    """Distance and label of the nearest decided block before and after each, in its container."""
    out = []
    for step in (1, -1):
        row: _Near = [None] * len(labels)
        last = None
        for i in range(len(labels))[::step]:
            if last is not None and homes[last[0]] != homes[i]:
                last = None
            row[i] = (abs(last[0] - i), last[1]) if last else None
            if labels[i] is not None:
                last = (i, labels[i])
        out.append(row)
    return out[0], out[1]


def main_text(page: str | None, stop: frozenset[str] = frozenset()) -> str:
    """The main text of a page: its good blocks, white space in each turned into one space, joined by two \\n.

    stop: stop words besides those of the four languages.
    """
    if not page:
        return ""
    found = _texts(page)
    homes = [b.home for _, b in found]
    labels = [_first_label(t, b, stop or _STOP) for t, b in found]
    some = {h for h, x in zip(homes, labels, strict=True) if x}
    before, after = _neighbours(labels, homes)
    for i, (text, b) in enumerate(found):  # long open blocks
        if labels[i] is None and len(text) >= SHORT and not b.title:
            labels[i] = b.home not in some or any(x[1] for x in (before[i], after[i]) if x)
    before, after = _neighbours(labels, homes)
    good = []
    for i, (text, b) in enumerate(found):
        label = labels[i]
        if label is None:
            sides = sorted(x for x in (before[i], after[i]) if x)
            if b.title and after[i]:
                label = after[i][1]  # a heading goes with what follows it
            elif not sides:
                label = bool(b.home)
            else:
                label = all(x[1] for x in sides if x[0] == sides[0][0])
        if label:
            good.append(text)
    return "\n\n".join(good)


def learnt_words(pages: DataFrame, html_col: str = "html") -> frozenset[str]:
    """The stop words of the four languages and those of these pages: a word has to be in LEARNT_SHARE of all long, little
    linked blocks, so the list is bounded by their mean number of words over that share. Nothing is learnt of a
    word in fewer than LEARNT_BLOCKS blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for page in batch.column(0):
                for text, block in _texts(page.as_py() or ""):
                    if len(text) >= SHORT and not block.title and not _linked(text, block):
                        held.update({"", *_WORDS.findall(text.lower())})  # "" counts the blocks
                if len(held) > COUNTED:
                    yield counts()
        yield counts()

    counted = pages.select(pages[html_col].alias("html")).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = kept(counted.where(F.col("n") >= LEARNT_BLOCKS), f"{work_dir(pages.sparkSession)}/words")
    total = counted.where("word = ''").first()
    often = counted.where(F.col("n") >= LEARNT_SHARE * (total["n"] if total else 0)).collect()
    return _STOP | {r["word"] for r in often if r["word"]}


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", stop: frozenset[str] | None = None) -> DataFrame:
    """Per row of pages: id, url, text ('' if none) and n_chars (code points). Null pages count as empty.

    Pages are read whole where they lie, once to learn stop words (unless stop gives them) and once to extract; only
    words and their counts are shuffled. Time follows the length of a page, whatever its tags. Repeated rows repeat; a
    null url stays null; an empty table gives no rows; other columns, whatever their names, are left out.
    """
    sent = pages.sparkSession.sparkContext.broadcast(learnt_words(pages, html_col) if stop is None else stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sent.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"]
            )

    rows = pages.select(pages[id_col].alias("id"), pages["url"], pages[html_col].alias("html"))
    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
