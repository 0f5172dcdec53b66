"""Operator 3: main text of web pages by composite text density.

A page becomes a tree.  Parts that are boilerplate by element, role or name go first.  Of
what is left every node has C characters and T tags below it, LC and LT of them in links,
and the link-adjusted density

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e)),

with 1 for a zero divisor; b is the body.  A node's sum is that of its children's
densities.  The block with the largest sum is the core, and all of it stays; the least
density on the path from the core up to the body is the threshold.  Beside that path stay
blocks that aren't mostly links and whose density reaches the threshold, as well as two
kinds that are too short to reach it: paragraphs, headings and lists that stand where the
path's own parts stand, and repetitions of a part of the path (same element, same class).

A name tells of boilerplate in two ways.  Remarks, advertisements and whole names go
wherever they stand; other names, as they also tell of the layout, only where the part
doesn't hold the core that densities find before any name is used.  Inside article and main
only names of advertisements and remarks drop a part, and names of bars where at least half
of the part is links.  Nothing depends on the share that a part has of the page.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, ready

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)(>|\Z|(?=["']))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption hr".split())
#: What a start tag closes if it is open, up to the elements that hide it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "thead"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
DROPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "nav", "aside", "footer", "form", "button", "select", "option", "textarea", "input", "dialog", "menu", "title", "xmp", "noembed", "noframes", "canvas", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}
#: Names of boilerplate, as a word of a class or id; behind has-, with- and the like they tell of the layout, not of the part.
_WORD = (
    r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe\w*|subscription|signup|login|popup|modal|overlay|paywall|share|sharing|social|side-?bar|rail|widgets?|related|recommend\w*|outbrain|taboola|comments?|commentlist|disqus|respond|replies|reply|nav|navbar|navigation|menus?|breadcrumbs?|foot|footer|header|masthead|topbar|toolbar|pagination|pager|skip-link|site-header|site-footer|search|hidden)"
)
_NAME = re.compile(rf"(?:^|[\s_-])(?<!\bhas[-_])(?<!\bwith[-_])(?<!\bno[-_])(?<!\bwithout[-_]){_WORD}(?!-(?:open|closed|off|on)\b)(?:$|[\s_-])", re.I)
_WHOLE = re.compile(rf"(?:^|\s){_WORD}(?:$|\s)", re.I)
#: Names of readers' remarks: these words alone, at the end of a name, or before a word for their place; an id made from a title goes on otherwise.
_REMARKS = re.compile(
    r"(?:^|\s)(?:[\w-]+[_-])?(?<!\bhas[-_])(?<!\bwith[-_])(?<!\bno[-_])(?<!\bwithout[-_])"
    r"(?:comments?|commentlist|replies|disqus\w*|respond|(?:readers?|users?|visitors?)[_-](?:responses|remarks))(?:[_-](?:area|sections?|list|wrap|wrapper|container|block|box|threads?|feed|form|template|body|content|items?|\d+))*(?:$|\s)",
    re.I,
)
#: Names that drop a part inside an article: as they are, and only with at least half of the part in links.
_SURE = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisements?|adsense|adsbygoogle|ad-?(?:slot|unit|container|banner)|sponsored|comments?|comment-?list|comments-(?:area|section)|disqus(?:_thread)?|respond)(?:$|\s)", re.I)
_BAR = re.compile(r"(?:^|\s)(?:share|sharing|share-?(?:bar|buttons?|links?)|social-?(?:share|sharing|links?|buttons?|icons?|bar)|related-(?:posts?|articles?|stories)|outbrain|taboola|nav|navbar|menu|breadcrumbs?|pagination|pager|side-?bar|widget-area|toolbar)(?:$|\s)", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Parts of a running text.
TEXTUAL = HEADINGS | set("p blockquote pre ul ol dl li dt dd table thead tbody tfoot tr td th figure figcaption caption details summary hgroup address center".split())


class Page:
    """A page's nodes in page order: a parent stands before its children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["html"], [-1], [""]
        #: (node, text) and (node, None) where a block begins or ends, in page order
        self.flow: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        stack, open_, at = [0], {"html": 1}, 0
        tag, parent, attrs, flow = self.tag, self.parent, self.attrs, self.flow

        def pop() -> None:
            n = stack.pop()
            open_[tag[n]] -= 1
            if tag[n] in BLOCKS:
                flow.append((stack[-1] if stack else 0, None))

        def close(names: tuple[str, ...], limits) -> None:
            if any(open_.get(x) for x in names):
                for i in range(len(stack) - 1, 0, -1):
                    t = tag[stack[i]]
                    if t in names:
                        while len(stack) > i:
                            pop()
                    elif t in limits:
                        break

        end = len(s)
        while at < end:
            m = _TOKEN.search(s, at)
            if m is None:
                flow.append((stack[-1], s[at:]))
                break
            if m.start() > at:
                flow.append((stack[-1], s[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    flow.append((stack[-1], html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
                continue
            if m[4] != ">":
                if m[4] == "" and at >= end:
                    break  # a tag that the page's end cuts
                stop = s.find(">", at)  # an odd quote in a tag
                if stop < 0:
                    break
                at = stop + 1
            name = name.lower()
            if m[1]:
                if name == "p" and not open_.get("p"):
                    flow.append((stack[-1], None))
                elif name not in ("html", "body") and open_.get(name):
                    while tag[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if name in ("html", "body") and (name == "html" or open_.get("body")):
                continue
            if name in BLOCKS and open_.get("p"):
                close(("p",), ("button", "table", "td", "th", "caption", "object"))
            if name == "a" and open_.get("a"):
                close(("a",), BLOCKS | {"td", "th"})
            if name in HEADINGS and tag[stack[-1]] in HEADINGS:
                pop()
            if name in ENDS:
                close(ENDS[name], LIMITS[name])
            if name == "body" and open_.get("head"):
                close(("head",), ())
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            attrs.append(m[3])
            if name in BLOCKS:
                flow.append((stack[-1], None))
            elif name in ("br", "td", "th", "img", "wbr"):
                flow.append((stack[-1], "" if name == "wbr" else " "))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(s, at)
                at = end if stop is None else stop.end()
                continue
            if name == "plaintext":
                at = end
                continue
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1

    def measured(self, out: list[bool]) -> tuple[list[int], list[int], list[float], list[float]]:
        """Characters, those in links, density, and sum of the children's densities of each node, without what is out."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        chars, tags, links, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for i, t in self.flow:
            if t and not out[i]:
                k = len("".join(t.split()))
                chars[i] += k
                if in_link[i]:
                    links[i] += k
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        body = self.body()
        ratio = links[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t = chars[i], max(1, tags[i])
            if c and not out[i]:
                lc, lt = links[i], max(1, link_tags[i])
                base = math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e))
                top = math.log(max(1.0 + 1e-9, c / max(1, lc) * t / lt))
                density[i] = c / t * (top / base if base > 1e-9 else top)
        for i in range(n - 1, 0, -1):
            total[parent[i]] += density[i]
        return chars, links, density, total

    def body(self) -> int:
        return next((i for i, t in enumerate(self.tag) if t == "body"), 0)

    def up(self, i: int) -> list[int]:
        """A node and all above it."""
        path = []
        while i >= 0:
            path.append(i)
            i = self.parent[i]
        return path

    def core(self, out: list[bool], chars: list[int], density: list[float], total: list[float]) -> int:
        """The block with the largest sum; without any sum the smallest one with the most characters."""
        some = [i for i in range(len(out)) if not out[i]]
        core = max(some, key=lambda i: (total[i], density[i], -i), default=0)
        if not total[core]:
            core = max(some, key=lambda i: (chars[i], i), default=0)
        while core and self.tag[core] not in BLOCKS and self.tag[core] != "body":
            core = self.parent[core]
        return core

    def dropped(self, holding: set[int] | None = None) -> list[bool]:
        """Which nodes are boilerplate, or below it; by elements and roles alone, or by names too, given what holds the core."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        solid, links, in_link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for i, t in self.flow:
            if t:
                k = len("".join(t.split()))
                solid[i] += k
                links[i] += k * in_link[i]
        for i in range(n - 1, 0, -1):
            solid[parent[i]] += solid[i]
            links[parent[i]] += links[i]
        holds = [t in ("article", "main", "body") for t in tag]  # or stands above one
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i]
        out, inside = [False] * n, [False] * n
        for i in range(1, n):
            p = parent[i]
            inside[i] = inside[p] or tag[p] in ("article", "main")
            out[i] = out[p] or tag[i] in DROPPED or (tag[i] == "header" and not inside[i] and not holds[i])
            if out[i] or not self.attrs[i] or tag[i] in ("body", "main"):
                continue
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attrs[i])}
            named = f"{a.get('class', '')} {a.get('id', '')}"
            remark = tag[i] not in HEADINGS and bool(_REMARKS.search(named))
            odd = a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
            if inside[i]:
                odd = odd or tag[i] not in HEADINGS and bool(_SURE.search(named) or 2 * links[i] >= solid[i] and _BAR.search(named))
            elif holding is not None and _NAME.search(named):
                odd = odd or i not in holding or bool(_WHOLE.search(named))
            out[i] = remark or odd and not holds[i]
        return out

    def text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        out = self.dropped()
        chars, _, density, total = self.measured(out)
        out = self.dropped(set(self.up(self.core(out, chars, density, total))))
        chars, links, density, total = self.measured(out)
        core, body = self.core(out, chars, density, total), self.body()
        path = self.up(core)
        least = min((density[i] for i in path if density[i] and i != 0), default=0.0)
        keep = [False] * n
        keep[core] = True
        below = {parent[i]: i for i in path if i}  # of each node above the core, the part of the path in it
        for i in range(1, n):
            p = below.get(parent[i])
            if parent[i] == core:
                p = None
                keep[i] = core not in (0, body) or tag[i] not in BLOCKS or tag[i] in ("p", *HEADINGS) or 2 * links[i] < chars[i]
                if not keep[i]:
                    out[i] = True  # lists of links beside the text of a page without any frame
            if p is None or i == p or out[i] or tag[i] not in BLOCKS or not chars[i] or 2 * links[i] >= chars[i]:
                continue
            running = tag[i] in TEXTUAL and (parent[i] not in (0, body) or tag[p] in TEXTUAL or tag[i] in HEADINGS)
            again = tag[i] == tag[p] and self.attrs[i].split() == self.attrs[p].split()
            keep[i] = density[i] >= least or running or again
        for i in range(1, n):
            keep[i] = keep[i] or keep[parent[i]]
            out[i] = out[i] or out[parent[i]]
        blocks, part = [], []

        def close() -> None:
            s = " ".join(html.unescape("".join(part)).split())
            if s:
                blocks.append(s)
            part.clear()

        for i, t in self.flow:
            if t is None:
                close()
            elif keep[i] and not out[i]:
                part.append(t)
        close()
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    """A page's main text; empty for null, an empty page and one without text.

    Any string is a page: tags may be unclosed, crossed or cut off by the end.  Time grows with the page's length.
    """
    return Page(source).text() if source else ""


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of page_id, url, html.

    A null html is empty, and an empty page has an empty text.  Rows are independent: null
    ids and urls pass through, repeated rows stay, other columns are not read.
    """
    ready(pages.sparkSession)

    def run(rows):
        for b in rows:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                text = [main_text(x) for x in c.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column("page_id"), c.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], schema=OUT)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(freed(run), "page_id long, url string, text string, n_chars long")
