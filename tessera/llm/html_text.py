"""Main text of web pages as the maximum-scoring subsequence of words and tags (operator 1).

A page is a sequence of tags and runs of words. Words score by where they stand, tags negative by
name, with weights that are log odds counted over the labelled pages: those that mark their own
content with <article> (or, without one, <main>). On such pages the marks themselves speak for what they hold. One linear scan finds the contiguous region with
the best sum. A zone that is never content (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is told by its element, its role or a class or id of which
every word names one; it counts as one negative tag, learned by name, so that the region can go on
after it, and its words are left out. Inside marked content a name that may as well be one of the
article's own parts (related work, a notice, what is shared) only makes a zone of what scores like
one: whose words outside links, less twice those in links, are fewer than OWN. Nothing else inside
the region is left out.

A null page is empty. Pages without words give an empty text. Repeated rows are read each for itself.
Of several marked contents with text between them the region that scores best counts.
Unclosed elements end where an enclosing one does; a zone that is never closed ends at <article>,
<main> or a heading of the first level, and a form around one of these is no zone. Of equally good
regions the one that ends first counts, and of those the shortest. Pages are read in one pass, in
time and memory of their length: nothing open, unclosed or unmatched is looked for twice. Columns
named text or n_chars in the table are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select object canvas audio video".split())
ZONES = frozenset("nav footer aside form head button menu dialog".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover".split())
CONTENT = frozenset("article main".split())
#: Elements whose start ends an open paragraph, and the open elements that each of some ends.
BLOCKS = frozenset("p li td th tr option dt dd h1 h2 h3 h4 h5 h6 div ul ol dl table section footer header nav aside article main blockquote pre figure form hr".split())
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
# Words of class and id that name a zone, words that may stand beside them, and roles.
ZONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup nav navbar navigation menu menubar breadcrumb breadcrumbs toc sidebar aside widget widgets related recommended recommendations share sharing social footer "
    "comment comments commentlist respond disqus replies reply pager pagination login search toolbar skip".split()
)
BESIDE = frozenset("site page main top bottom left right list box block section area wrapper wrap container bar links link posts articles stories buttons button form item items slot unit inner thread text message primary secondary global bottom fixed sticky js".split())
#: Words that name zones wherever they stand; the others may name parts of an article.
STRICT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "breadcrumb breadcrumbs pager pagination login comment comments commentlist respond disqus replies reply".split()
)
#: So many words make a part of an article of what its name alone would make a zone.
OWN = 12
HEADER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies reply".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Tags and places of words that have weights of their own.
_TAGS = frozenset("a p div li ul ol h1 h2 h3 h4 b strong em i span br table tr td th section figure figcaption img blockquote pre code dl dt dd hr label header body".split())
_PLACES = frozenset("p li td div h1 h2 h3 blockquote pre section article main".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)")
_WORDS = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


def _named(value: str, words: frozenset[str]) -> str:
    """The first of the words in a class or id of which every word is one of them or may stand beside them, else ''."""
    for token in value.split():
        parts = _WORDS.findall(token)
        if parts and all(w in words or w in BESIDE for w in parts) and (found := next((w for w in parts if w in words), "")):
            return found
    return ""


def zone_name(tag: str, attributes: str, inside: bool) -> str:
    """What names an element a zone, else ''; inside: whether it lies in the content that the page marks."""
    if tag in ZONES or (tag == "header" and not inside):
        return tag
    if tag in ("main", "body", "html") or not attributes or attributes == "/":
        return ""
    if _HIDDEN.search(_ATTRIBUTE.sub("", attributes)):
        return "hidden"
    words = COMMENT_WORDS if tag == "article" else ZONE_WORDS if inside else ZONE_WORDS | HEADER_WORDS
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "hidden"
        if name == "hidden":
            return "hidden"
        if name == "role" and value.strip() in ROLES:
            return f"role-{value.strip()}"
        if name in ("class", "id") and tag not in INLINE and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            # inside the content an id is as likely the slug of a heading
            if found := _named(value, COMMENT_WORDS if name == "id" and inside else words):
                return found
    return ""


def _events(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("text", "", text, at), ("open", tag, attributes, at) and ("close", tag, "", at); comments and the insides of raw elements are left out."""
    at, n = 0, len(page)
    last = page.rfind(">")
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:], at
            return
        if lt > at:
            yield "text", "", page[at:lt], at
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not page[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
            yield "text", "", "<", lt
            at = lt + 1
        elif lt > last or not (m := _TAG.match(page, lt)):  # a tag that never ends, or has no name of a tag
            if lt > last:
                return
            yield "text", "", "<", lt
            at = lt + 1
        else:
            tag = m[2].lower()
            at = m.end()
            yield "close" if m[1] else "open", tag, m[3].strip(), lt
            if tag in RAW and not m[1] and not m[3].endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    yield "close", tag, "", at
                elif tag in ("script", "style", "template"):
                    at = n
                else:
                    unclosed.add(tag)


@dataclass(slots=True)
class _Open:
    """An open element: what names it a zone, whether it lies in a link, its nearest block (tag and place in the stack)."""

    tag: str
    zone: str
    link: bool
    where: str
    block: int


def tokens(page: str) -> list[tuple[str, int, int, str]]:
    """(type, words, block, text) in page order.

    Types are word:place and link:place for words, tag:name and tag:/name for tags, zone:name for
    zones; those of words in zones start with ~, those of all that lies in marked content with +.
    block is -1 for tags and zones. tag:+article and tag:-article tell where marked content starts and ends.
    """
    out: list[tuple[str, int, int, str]] = []
    mark = "article" if re.search("<article", page, re.I) else "main"
    closed = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z][a-zA-Z0-9:-]*)", page)}  # the last end tag of each element
    bottom = _Open("", "", False, "", -1)
    stack: list[_Open] = []
    zoned: list[int] = []  # the places of open zones in the stack
    part: list[int] = []  # of an open part of marked content that its name makes a zone unless its words don't: places in the stack and in out, words, words in links
    there: Counter = Counter()  # open elements by tag
    inside = block = 0

    def judge() -> None:
        at = part[1]
        if part[2] - 2 * part[3] >= OWN:
            out[at] = ("+tag:section", 0, -1, "")
        else:
            out[at + 1 :] = [(t if t[0] == "~" else f"~{t.lstrip('+')}", n, -1, "") for t, n, _, _ in out[at + 1 :]]
        part.clear()

    def pop(k: int) -> None:
        nonlocal inside
        while len(stack) > k:
            e = stack.pop()
            there[e.tag] -= 1
            if part and part[0] == len(stack):
                judge()
            if zoned and zoned[-1] == len(stack):
                zoned.pop()
            elif e.tag == mark and not zoned:
                inside -= 1
                out.append(("tag:-article", 0, -1, ""))

    for kind, tag, text, at in _events(page):
        if kind == "text":
            top = stack[-1] if stack else bottom
            decoded = entities.unescape(text)
            n = len(decoded.split())
            t = ("link:" if top.link else "word:") + (top.where if top.where in _PLACES else "other")
            out.append((f"~{t}", n, -1, "") if zoned else (f"+{t}" if inside else t, n, block, decoded))
            if part and not zoned:
                part[3 if top.link else 2] += n
            continue
        if tag not in INLINE and tag not in RAW:  # what is left out inside a line doesn't end it
            block += 1
        if kind == "close":
            before = bool(zoned)
            if there[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            if not before and tag != mark:
                out.append(("+" * (inside > 0) + (f"tag:/{tag}" if tag in _TAGS else "tag:/other"), 0, -1, ""))
            continue
        if zoned and (tag in CONTENT or tag == "h1"):
            outer = stack[zoned[0]]
            if outer.tag == "form" and tag in CONTENT and len(zoned) == 1:  # a form around the whole page
                outer.zone = ""
                zoned.clear()
            elif outer.tag == "head" or (outer.tag != "footer" and closed.get(outer.tag, -1) < at):  # never closed
                pop(zoned[0])
        if tag == "body" and zoned:
            pop(zoned[0])
        if tag in BLOCKS:
            while stack and (k := stack[-1].block) >= 0 and (stack[k].tag == "p" or stack[k].tag in ENDS.get(tag, ())):
                pop(k)
        name = zone_name(tag, text, bool(inside))
        if name and inside and not zoned and tag not in ZONES and name in ZONE_WORDS and name not in STRICT and tag not in VOID and not text.endswith("/"):
            if not part:
                part += [len(stack), len(out), 0, 0]
                out.append((f"zone:{name}", 0, -1, ""))
                stack.append(_Open(tag, "", bool(stack) and stack[-1].link, tag, len(stack)))
                there[tag] += 1
                continue
            name = ""
        if not zoned:
            t = f"zone:{name}" if name else f"tag:{tag}" if tag in _TAGS else "tag:other"
            out.append(("tag:+article" if tag == mark and not name else f"+{t}" if inside else t, 0, -1, ""))
            if tag == "br":
                out.append(("+space" if inside else "space", 0, block, " "))
        if tag in VOID or text.endswith("/") and tag not in CONTENT:
            if tag == mark and not name and not zoned:
                out.append(("tag:-article", 0, -1, ""))
            continue
        top = stack[-1] if stack else bottom
        here = top if tag in INLINE else _Open(tag, "", False, tag, len(stack))
        stack.append(_Open(tag, name, top.link or tag == "a", here.where, here.block))
        there[tag] += 1
        if name:
            zoned.append(len(stack) - 1)
        elif tag == mark and not zoned:
            inside += 1
    if part:
        judge()
    return out


def _counts(t: str) -> bool:
    """Whether a type counts words."""
    return t.lstrip("+~")[:5] in ("word:", "link:")


def label(page: str) -> Counter:
    """Words, tags and zones by type and by whether they are content, of a page that marks its content; else nothing."""
    found: Counter = Counter()
    seq = tokens(page)
    if not any(t == "tag:+article" for t, *_ in seq):
        return found
    depth = 0
    for t, n, _, _ in seq:
        depth += (t == "tag:+article") - (t == "tag:-article")
        if t.startswith("~word") or t.lstrip("+") == "space":  # words left out wherever they stand say nothing about such words elsewhere
            continue
        found[t.lstrip("+~"), depth > 0 and t[0] != "~"] += n if _counts(t) else 1
    return found


def weights(pages: DataFrame) -> dict[str, int]:
    """The score, in thousandths, of a word or tag of each type: log odds of being content, counted over all labelled pages, within bounds by kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(label(page.as_py() or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in total], pa.string()), pa.array([c for _, c in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
            ["type", "content", "n"],
        )

    rows = pages.select("html").mapInArrow(count, "type string, content boolean, n long").groupBy("type", "content").agg(F.sum("n").alias("n")).collect()
    return scores({(r["type"], r["content"]): r["n"] for r in rows})


def scores(counts: dict[tuple[str, bool], int]) -> dict[str, int]:
    out = {"tag:+article": -500, "tag:-article": -500, "space": 0}
    for t in {t for t, _ in counts} - set(out):
        odds = math.log((counts.get((t, True), 0) + 1.0) / (counts.get((t, False), 0) + 1.0))
        # words may speak for or against content; tags only against, the more so the fewer of them are in content
        out[t] = round(1000 * (max(-2.0, min(1.0, odds)) if _counts(t) else max(-1.0, min(-0.3, odds / 2 - 0.3))))
    return out


def weighed(seq: list[tuple[str, int, int, str]], of: dict[str, int]) -> list[int]:
    """The scores of a page's words and tags. What the page marks as content speaks for itself, and where that holds most of the words, words beside it speak against."""
    words = Counter()
    for t, n, _, _ in seq:
        words[t[:5] if t[0] != "+" else "+"] += n
    beside = words["+"] >= max(words["word:"], 1)

    def one(t: str) -> int:
        if t[0] == "~":
            return 0
        if t[0] == "+":
            return 1000 if _counts(t) else -10
        if beside and _counts(t):
            return min(of.get(t, -1000), -1000)
        return of.get(t, 1000 if t.startswith("word:") else -500 if t.startswith(("link:", "zone:")) else -300)

    return [one(t) * (n if _counts(t) else 1) for t, n, _, _ in seq]


def best_region(scores: list[int]) -> tuple[int, int]:
    """The contiguous region (from, to) with the greatest sum above 0: of equal ones the first to end, then the shortest."""
    best, region, total, start = 0, (0, 0), 0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str | None, of: dict[str, int]) -> str:
    """The main text of a page, by the weights `of`."""
    seq = tokens(page or "")
    lo, hi = best_region(weighed(seq, of))
    blocks: dict[int, list[str]] = {}
    for _, _, block, text in seq[lo:hi]:
        if block >= 0:
            blocks.setdefault(block, []).append(text)
    made = (_SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(x for x in made if x)


def main_text(pages: DataFrame, of: dict[str, int] | None = None) -> DataFrame:
    """pages' columns but html, with text and n_chars (code points). Columns of these names in pages are replaced."""
    of = of if of is not None else weights(pages)
    pages = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars")))
    kept = [f for f in pages.schema if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])
    at = pages.columns.index("html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), of) for p in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(f.name for f in kept), "text", "n_chars"],
            )

    return pages.mapInArrow(read, schema)
