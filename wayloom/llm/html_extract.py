"""Operator 4, HTML extraction: site template removal.

One pass parses every page, in time that grows with its length alone: its text
becomes blocks, and every element that holds blocks a node with two hashes of
its subtree, one with the text (tag, attributes, the text below) and one
without (tag, class and id, the distinct subtrees below).  Parsed pages are
written, Spark counts on how many pages of a host each hash occurs, and what
recurs on at least MIN_PAGES pages and SHARE of the host's pages decides first:

- a subtree whose text recurs is site template and goes;
- a subtree whose shape recurs goes where the shape says enough: outside the
  article, or where a mark (below) agrees.

What recurrence leaves open, as on hosts of few pages, marks decide: tags,
roles, class and id words that name navigation, headers, sidebars, adverts,
forms, comments and the like, and elements that are hidden.  Where a page has
an article or main element, only that is kept at last.

Neither touches the article's frame: article and main elements that stand
under the fewest marks, their ancestors, and elements around others that hold
more than half of the text (comments and hidden parts excepted) stay.  Inside
an article headings, paragraphs, quotations, lists and tables are never
template; nor is a copy: if more than half of an article's text recurs, block
by block, on c pages at least, subtrees that recur on c * SLACK pages at most
recur with the copy and stay.

Counting is by (host, hash) with partial sums, and a host's template is one row
that joins its pages, so a host with a third of all pages is no hot spot.

Defined results: null html is empty; null or odd urls have no host and no
template; an unclosed tag, comment or script at the end of a page is markup;
`br` is white space; each row gives a row, repeated ones too; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .store import settled

MIN_PAGES, SHARE = 5, 0.2
#: Copies differ a little: a heading may stand in a few more of them than most of the text.
SLACK = 1.25
#: Set hashes of blocks and of shapes apart from those of texts.
_BLOCK, _SHAPE = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D

# Tags and marks by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = {"article", "main"}
IN_HEAD = set("title meta link base style script noscript template".split())
#: Never text.
DROPPED = set("script style noscript iframe template svg canvas object audio video button select textarea head".split())
#: What stands inside an article belongs to it, however often it recurs.
CONTENT = set("h1 h2 h3 h4 h5 h6 hgroup p blockquote q pre ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption details summary".split())
MARKED_TAGS = set("nav aside dialog menu footer".split())
MARKED_ROLES = set("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
COMMENTS = set("comment comments disqus respond reply replies".split())
MARKED_WORDS = COMMENTS | set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended share sharing social subscribe newsletter signup login "
    "footer masthead topbar toolbar pager pagination".split()
)
#: A name with one of these tells what state a page is in, not what an element is.
STATES = set("has with without no is open closed enabled disabled".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Bits of a node.  HARD: its tag or role is a mark; SOFT: class, id or form; GONE: comments or hidden, a mark however large;
# FRAME: part of the article's frame; CUTS: its text may be template; WRAPS: holds other elements with text; INSIDE: in the article.
HARD, SOFT, GONE, FRAME, CUTS, WRAPS, INSIDE = (1 << i for i in range(7))

_TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|\Z))|[!?][^>]*(?:>|\Z)|/?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
#: One attribute after the other: name, then its whole value; whatever else stands between is skipped.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?|["'][^"']*["']?""")
_MARK = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _marks(tag: str, attributes: str, in_main: bool) -> tuple[int, str]:
    """HARD, SOFT and GONE of an element, and its class and id."""
    bits = HARD if tag in MARKED_TAGS or (tag == "header" and not in_main) else SOFT if tag == "form" else 0
    names = ""
    if not attributes:
        return bits, names
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            bits |= SOFT | GONE
        elif name == "role" and value.lower() in MARKED_ROLES:
            bits |= SOFT if value.lower() == "form" else HARD
        elif name in ("class", "id"):
            names += f" {name}={value}"
            if tag in ("html", "body"):
                continue
            for one in value.split():
                words = set(_MARK.findall(_CAMEL.sub(" ", one).lower()))
                if words & STATES:
                    continue
                if words & MARKED_WORDS or (not in_main and "header" in words):
                    bits |= SOFT
                if words & COMMENTS:
                    bits |= GONE
    return bits, names


class Page:
    """All blocks of a page's text, the nodes over them, and which blocks stand in its article."""

    def __init__(self, source: str) -> None:
        self.all_blocks: list[str] = []
        #: text hash, shape hash, first block, block after the last, bits
        self.nodes: list[tuple[int, int, int, int, int]] = []
        self.hashes: list[int] = []
        # Rolling sums of block hashes give the hash of any run of blocks at once, however deep elements nest.
        self._sums = [0]
        # Open elements: tag, first block, attributes, names, bits, shapes below, soft marks around it and on it, whether a hard mark is.
        self._open: list[tuple] = []
        self._at: dict[str, list[int]] = {}
        self._buffer: list[str] = []
        self._dropped = -1
        self._main_at: list[tuple[int, int]] = []
        self._read(source)
        self._text_break()
        while self._open:
            self._pop()
        self.inside = self._frame()

    def _frame(self) -> list[bool]:
        """Marks the article's frame and says which blocks stand inside."""
        inside = [False] * len(self.all_blocks)
        least = min((level for level, _ in self._main_at), default=0)
        own = {at for level, at in self._main_at if level == least}
        mains = [self.nodes[at][2:4] for at in sorted(own)]
        if not mains:
            return inside
        change = [0] * (len(inside) + 1)
        for lo, hi in mains:
            change[lo] += 1
            change[hi] -= 1
        depth = 0
        for i in range(len(inside)):
            depth += change[i]
            inside[i] = depth > 0
        # For each block, the least end of an article that starts there or later: a node that reaches it is around that article.
        ends = [len(inside) + 1] * (len(inside) + 1)
        for lo, hi in mains:
            ends[lo] = min(ends[lo], hi)
        for i in range(len(inside) - 1, -1, -1):
            ends[i] = min(ends[i], ends[i + 1])
        # Nodes stand in the order in which elements end: of those over the same blocks, the inner come first.
        innermost: dict[tuple[int, int], int] = {}
        for at in sorted(own):
            innermost.setdefault(self.nodes[at][2:4], at)
        held = [0]
        for x in inside:
            held.append(held[-1] + x)
        for at, (text, shape, lo, hi, bits) in enumerate(self.nodes):
            if at in own or (ends[lo] <= hi and at > innermost.get((lo, hi), -1)):
                bits |= FRAME
            if held[hi] - held[lo] == hi - lo:
                bits |= INSIDE
            self.nodes[at] = (text, shape, lo, hi, bits)
        return inside

    def _text_break(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                self.all_blocks.append(text)
                self.hashes.append(_hash(text))
                self._sums.append((self._sums[-1] * _BASE + self.hashes[-1]) % _PRIME)

    def _pop(self) -> None:
        tag, first, attributes, names, bits, shapes, level, hard = self._open.pop()
        self._at[tag].pop()
        if tag not in INLINE and self._dropped < 0:
            self._text_break()
        if len(self._open) == self._dropped:
            self._dropped = -1
            return
        if self._dropped >= 0 or len(self.all_blocks) <= first or tag in ("html", "body") or (tag in INLINE and not bits):
            return
        last = len(self.all_blocks)
        below = (self._sums[-1] - self._sums[first] * pow(_BASE, last - first, _PRIME)) % _PRIME
        shape = _hash(f"{tag}{names} {sorted(shapes)}")
        if self._open:
            self._open[-1][5].add(shape)
        if tag in MAIN and (tag == "main" or not hard):
            self._main_at.append((level, len(self.nodes)))
        elif tag not in INLINE and tag not in CONTENT:
            bits |= CUTS
        if shapes:
            bits |= WRAPS
        self.nodes.append((_hash(f"{tag} {attributes} {below}"), shape ^ _SHAPE, first, last, bits))

    def _close(self, tag: str) -> None:
        if self._at.get(tag):
            depth = self._at[tag][-1]
            while len(self._open) > depth:
                self._pop()

    def _last(self, tags: set[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if self._at.get("head") and tag not in IN_HEAD:
            self._close("head")
        if self._dropped < 0:
            if tag not in INLINE:
                self._text_break()
                # A block ends an open paragraph.
                if self._at.get("p") and self._at["p"][-1] >= len(self._open) - 6:
                    self._close("p")
            elif tag == "br":
                self._buffer.append(" ")
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            at = self._last(closed)
            if at > self._last(until):
                while len(self._open) > at:
                    self._pop()
        if tag in VOID or attributes.endswith("/"):
            return
        bits, names, level, hard = 0, "", 0, False
        if self._dropped < 0:
            if tag in DROPPED:
                self._dropped = len(self._open)
            else:
                in_main = bool(self._at.get("article") or self._at.get("main"))
                bits, names = _marks(tag, attributes, in_main)
                above = self._open[-1] if self._open else (0,) * 8
                level, hard = above[6] + bool(bits & SOFT), above[7] or bool(bits & HARD)
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, len(self.all_blocks), attributes, names, bits, set(), level, hard))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        for m in iter(lambda: _TOKEN.search(source, at), None):
            start, end = m.span()
            if start > at and self._dropped < 0:
                self._buffer.append(source[at:start])
            at = end
            tag = m[1]
            if not tag:
                continue
            tag, attributes = tag.lower(), m[2]
            # A quoted value may hold what looked like the tag's end.
            if attributes.count('"') % 2:
                odd = True
                while odd and end < n and (more := source.find('"', end)) >= 0:
                    stop = source.find(">", more)
                    stop = n if stop < 0 else stop + 1
                    odd = source.count('"', end, stop) % 2 == 0
                    end = stop
                attributes = source[m.start(2) : end - 1]
                at = end
            if source[start + 1 : start + 2] == "/":
                self._close(tag)
                continue
            if end == n and source[-1:] != ">":
                continue
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                stop = close.start() if close else n
                if self._dropped < 0 and tag == "xmp":
                    self._buffer.append(source[at:stop])
                at = stop
                if not close:
                    self._close(tag)
        if at < n and self._dropped < 0:
            self._buffer.append(source[at:])

    @property
    def blocks(self) -> list[str]:
        """What is kept where no host says what recurs."""
        return decide(self.all_blocks, self.open_nodes(), self.inside, {})[0]

    def open_nodes(self) -> list[tuple[int, int, int, int, int]]:
        """The nodes that may go: neither frame nor unmarked content of an article."""
        return [n for n in self.nodes if not n[4] & FRAME and (n[4] & (CUTS | HARD | SOFT) or not n[4] & INSIDE)]

    def counted(self) -> list[int]:
        """The distinct hashes that are counted by host."""
        found = {h ^ _BLOCK for h, x in zip(self.hashes, self.inside, strict=True) if x}
        for text, shape, _, _, bits in self.open_nodes():
            if bits & CUTS:
                found.add(text)
            if bits & (HARD | SOFT) or not bits & INSIDE:
                found.add(shape)
        return sorted(found)


def copied_on(blocks: list[str], inside: list[bool], recurring: dict[int, int]) -> int:
    """The most pages on which more than half of the article's text recurs, block by block; 0 if it does not."""
    sizes = sorted(((recurring.get(_hash(b) ^ _BLOCK, 0), len(b)) for b, x in zip(blocks, inside, strict=True) if x), reverse=True)
    held, total = 0, sum(n for _, n in sizes)
    for pages, n in sizes:
        held += n
        if 2 * held > total:
            return pages
    return 0


def decide(blocks: list[str], nodes: list[tuple], inside: list[bool], recurring: dict[int, int]) -> tuple[list[str], int, int]:
    """The blocks that stay, how many went as site template, and how many for other reasons.

    recurring: on how many pages of the host each hash stands that may be template.
    """
    article = any(inside)
    copies = copied_on(blocks, inside, recurring) if article and recurring else 0
    # Sizes of the article's text, or of all where there is none, and of the whole page.
    held, whole = [0], [0]
    for b, x in zip(blocks, inside, strict=True):
        held.append(held[-1] + (len(b) if x or not article else 0))
        whole.append(whole[-1] + len(b))
    template, marked = [0] * (len(blocks) + 1), [0] * (len(blocks) + 1)
    for text, shape, lo, hi, bits in nodes:
        within = bits & INSIDE
        most = 2 * (held[hi] - held[lo]) > held[-1]
        mark = bits & HARD or (bits & SOFT and (bits & GONE or not bits & WRAPS or not most))
        again = recurring.get(text, 0) if bits & CUTS else 0
        if again and (again > SLACK * copies if within else True) and not most:
            change = template
        elif recurring.get(shape) and (mark or (article and held[hi] == held[lo])):
            change = template
        elif mark:
            change = marked
        else:
            continue
        change[lo] += 1
        change[hi] -= 1
    kept, n_template, n_other, t, m = [], 0, 0, 0, 0
    for i, b in enumerate(blocks):
        t += template[i]
        m += marked[i]
        if t:
            n_template += 1
        elif m or (article and not inside[i]):
            n_other += 1
        else:
            kept.append(b)
    return kept, n_template, n_other


_NODE = [("text", pa.int64()), ("shape", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bits", pa.int16())]
_PARSED = "page_id long, url string, host string, blocks array<string>, nodes array<struct<text:long,shape:long,lo:int,hi:int,bits:short>>, inside array<boolean>, counted array<long>"
_ROW = "page_id long, url string, text string, n_chars long, n_template long, n_other long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = grams.as_text(b.column(3))
        for lo, hi in grams.slices(text):
            pages = [Page(t) for t in text[lo:hi].to_pylist()]
            columns = [
                *(b.column(i)[lo:hi] for i in range(3)),
                pa.array([p.all_blocks for p in pages], pa.list_(pa.string())),
                pa.array([[dict(zip(("text", "shape", "lo", "hi", "bits"), n, strict=True)) for n in p.open_nodes()] for p in pages], pa.list_(pa.struct(_NODE))),
                pa.array([p.inside for p in pages], pa.list_(pa.bool_())),
                pa.array([p.counted() for p in pages], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "blocks", "nodes", "inside", "counted"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each parsed page without template and marked parts."""
    for b in batches:
        blocks, nodes, inside, templates = (b.column(i).to_pylist() for i in range(2, 6))
        out = [decide(t, [tuple(n.values()) for n in ns], x, dict(again or ())) for t, ns, x, again in zip(blocks, nodes, inside, templates, strict=True)]
        text = ["\n".join(kept) for kept, _, _ in out]
        columns = [b.column(0), b.column(1), pa.array(text, pa.string()), *(pa.array(c, pa.int64()) for c in ([len(t) for t in text], [n for _, n, _ in out], [n for _, _, n in out]))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_template", "n_other"])


def host_of(url: str = "url"):
    """Lower-case host of a url, empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def template_counts(found: DataFrame, sites: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, hash, n: the hashes on at least min_pages pages and share of the host's pages.

    found: host, hash, one row for each page a hash is on; sites: host, pages.
    """
    counts = found.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(sites, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "hash", "n")


def html_extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Main text of every page.

    pages: page_id, url, html.  Returns page_id, url, text, n_chars (code
    points), n_template (blocks that went because they recur on the host) and
    n_other (blocks that went for other reasons).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), F.col("html").cast("string").alias("html"))
    parsed = settled(rows.select("page_id", "url", "host", "html").mapInArrow(_parse, _PARSED), "zstd")
    known = parsed.filter("host <> ''")
    template = template_counts(known.select("host", F.explode("counted").alias("hash")), known.groupBy("host").agg(F.count("*").alias("pages")), min_pages, share)
    # One row a host, of at most hashes-a-page / share entries; written, so that its size is known when the join with the pages is planned.
    by_host = settled(template.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("hash", "n"))).alias("template")))
    return parsed.select("page_id", "url", "host", "blocks", "nodes", "inside").join(by_host, "host", "left").select("page_id", "url", "blocks", "nodes", "inside", "template").mapInArrow(_cut, _ROW)
