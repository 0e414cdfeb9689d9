"""Main text of HTML pages by consensus host paths.

First pass: each page's containers are scored by their clean text, and the page votes for the generalised tag-class path
(ids dropped, digits taken out) of the deepest container with nearly all of it (``SHARE``) and with the page's h1 headings; an article or
main element around it is taken instead. What comes after the article in that container, in lists or in several elements of one shape (reader comments, further stories), is left out: the vote
goes to the container inside that has the headings and most of the text. Spark counts the votes by host and path and picks each host's winner. Second pass: pages are read
again and the blocks below their host's winning path are taken where they hold nearly all of the page's clean text and its h1 headings. They are also taken, against the page's own best, where they
hold the headings and most of the text, and all that they leave out comes after them in containers of its own: other pages of the host have shown that such containers are no part of its articles.
Other pages fall back to their own best container, or to all their clean text if no container has nearly all.

An element whose class, id or role holds a mark of boilerplate is dropped unless it has most of the page's text (nearly all of it, where the mark
is a whole name and not a part of one; so too for forms). Other elements of dropped kinds and hidden ones always go.

Defined results: a null html is empty and has empty text; a null url votes with host ''; pages cut off in the middle of a tag
or element are read as far as they go. Ties in votes go to more text, then to the smaller path. Rows that repeat vote, and are extracted, each. A very long page is one task's work and is
read whole. Clashing and other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of elements and the words of class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title math object canvas audio video".split())
DROPPED = frozenset("head nav header footer aside form button select dialog menu label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LISTS = frozenset("ul ol".split())  # containers that no page's article is made of
CONTAINER = frozenset("html body main article section div td center blockquote details figure".split()) | LISTS
CLOSES_P = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot caption".split()) | frozenset(["p"])
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist respond disqus reply replies related recommended recommendations share sharing social "
    "toolbar widget widgets login pagination pager skip hidden complementary contentinfo search alert dialog".split()
)
KEEP_TAGS = frozenset(["html", "body", "main"])

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.DOTALL)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")
SHARE, MOST, SERIAL, BROADCAST_HOSTS = 0.95, 0.5, 0.8, 20_000


@dataclass
class Page:
    paths: list[str] = field(default_factory=list)  # of containers
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # container, text
    heads: set[int] = field(default_factory=set)  # containers of h1 headings
    items: dict[int, int] = field(default_factory=dict)  # of lists

    def _tag(self, k: int) -> str:
        return self.paths[k].rsplit("/", 1)[-1].split(".")[0]

    def best(self) -> tuple[int, int]:
        """The deepest container with nearly all of the clean text and the headings, or the article or main around it, and its length; -1 if there is none."""
        size, heads = [0] * len(self.paths), [0] * len(self.paths)
        for at, text in self.blocks:
            while at >= 0:
                size[at] += len(text)
                at = self.parents[at]
        for at in self.heads:
            while at >= 0:
                heads[at] += 1
                at = self.parents[at]
        total, best = sum(len(t) for _, t in self.blocks), -1
        for k, n in enumerate(size):  # a container comes after those around it
            if total and n >= SHARE * total and heads[k] == len(self.heads) and self._tag(k) not in LISTS:
                best = k
        up = best
        while up >= 0:
            if self._tag(up) in ("article", "main"):
                best = up
            up = self.parents[up]
        best = self.without_tail(best)
        return best, size[best] if best >= 0 else 0

    def without_tail(self, k: int) -> int:
        """The container, or the one inside it that has the headings and most of its text and is followed there by nothing but ``serial`` containers."""
        n = len(self.paths)
        size, count, heads = [0] * n, [0] * n, [0] * n
        kids: list[list[int]] = [[] for _ in range(n)]
        for at, text in self.blocks:
            if at >= 0:
                size[at] += len(text)
                count[at] += 1
        for at in self.heads:
            if at >= 0:
                heads[at] += 1
        for at in range(n - 1, -1, -1):  # a container comes after those around it
            if (up := self.parents[at]) >= 0:
                size[up], count[up], heads[up] = size[up] + size[at], count[up] + count[at], heads[up] + heads[at]
                kids[up].append(at)
        out = k
        while k >= 0 and kids[k]:
            main = max(kids[k], key=lambda c: (size[c], -c))
            if self._tag(main) in LISTS or size[main] <= MOST * size[k] or heads[main] != heads[k]:
                break
            if count[main] < count[k]:
                own = self._inside({k})
                child = [self._child(k, at) for at, _ in self.blocks if own[at]]
                if any(c != main for c in child[: count[main]]) or not all(c >= 0 and self.serial(c) for c in set(child[count[main] :])):
                    break
                out = main
            k = main
        return out

    def _child(self, k: int, at: int) -> int:
        """The child of container k in which ``at`` is; -1 for k itself."""
        if at == k:
            return -1
        while self.parents[at] != k:
            at = self.parents[at]
        return at

    def serial(self, k: int) -> bool:
        """Whether most of a container's text is in two items or more of a list, or in two containers or more of one path."""
        own = self._inside({k})
        size, count, total = {}, {}, 0
        for at, text in self.blocks:
            if own[at]:
                total += len(text)
                while at >= 0 and own[at]:
                    size[at] = size.get(at, 0) + len(text)
                    at = self.parents[at]
        shapes: dict[str, int] = {}
        for c, n in size.items():
            if self._tag(c) in LISTS and self.items.get(c, 0) > 1 and n >= SERIAL * total:
                return True
            if c != k and self._tag(c) not in LISTS:
                shapes[self.paths[c]] = shapes.get(self.paths[c], 0) + n
                count[self.paths[c]] = count.get(self.paths[c], 0) + 1
        return any(count[p] > 1 and n >= SERIAL * total for p, n in shapes.items())

    def overrules(self, wanted: set[int]) -> bool:
        """Whether the containers have the headings and most of the text, and what they leave out comes after them, in containers that they are not in."""
        inside = self._inside(wanted)
        flags = [inside[at] for at, _ in self.blocks]
        if not any(flags) or not all(inside[at] for at in self.heads):
            return False
        last = len(flags) - 1 - flags[::-1].index(True)
        around = set()
        for k in wanted:
            while k >= 0:
                around.add(k)
                k = self.parents[k]
        n = sum(len(text) for (_, text), f in zip(self.blocks, flags, strict=True) if f)
        return all(flags[: last + 1]) and n > MOST * sum(len(text) for _, text in self.blocks) and not any(at in around or at < 0 for at, _ in self.blocks[last + 1 :])

    def _inside(self, wanted: set[int]) -> dict[int, bool]:
        inside: dict[int, bool] = {-1: False}
        for k, up in enumerate(self.parents):
            inside[k] = k in wanted or inside[up]
        return inside

    def holds(self, wanted: set[int]) -> bool:
        """Whether the containers have nearly all of the clean text, and the headings."""
        inside = self._inside(wanted)
        n = sum(len(text) for at, text in self.blocks if inside[at])
        return n > 0 and n >= SHARE * sum(len(t) for _, t in self.blocks) and all(inside[at] for at in self.heads)

    def under(self, wanted: set[int]) -> str:
        inside = self._inside(wanted)
        return "\n".join(text for at, text in self.blocks if inside[at])


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)} if text.strip() else {}


def _boilerplate(tag: str, a: dict[str, str]) -> float | None:
    """The share of the page's text from which the element is no boilerplate: 0 for any, None for no share."""
    if tag in DROPPED and tag != "form":
        return None
    if tag in KEEP_TAGS or not a and tag != "form":
        return 0
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return None
    names = set(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower().split())
    marks = {"comment", "comments", "reply"} if tag == "article" else MARKS
    if tag == "form" or names & marks:
        return SHARE
    return MOST if {w for x in names for w in re.split(r"[^a-z0-9]+", x)} & marks else 0


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int, bool, int]] = [("", -1, False, -1)]  # tag, container, dropped, doubt
    stream: list[tuple[int, int, str | None]] = []  # doubt, container, text or the end of a block
    doubts: list[tuple[int, float]] = []  # elements that may be boilerplate: the one around, least share
    of: list[int] = []  # doubt of each container
    heads: set[int] = set()  # places in stream
    at, n = 0, len(html)

    def flush(doubt: int) -> None:
        if stream and (stream[-1][2] is not None or stream[-1][0] not in (-1, doubt)):
            if any(x[0] == "h1" for x in stack):
                heads.add(len(stream))
            stream.append((doubt, stack[-1][1], None))

    def close(k: int) -> None:
        """Pops the stack down to k elements."""
        while len(stack) > k:
            if stack[-1][0] in BLOCK:
                flush(-1)
            stack.pop()

    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at and not stack[-1][2]:
            stream.append((stack[-1][3], -1, html[at:start]))
        if start == n:
            break
        m = TAG.match(html, start) or LOOSE.match(html, start)
        if not m:
            if not stack[-1][2]:
                stream.append((stack[-1][3], -1, "<"))
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK and not stack[-1][2]:
                flush(stack[-1][3])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at) if not m[3].rstrip().endswith("/") else None
            at = end.end() if end else at if m[3].rstrip().endswith("/") else n
            continue
        if tag == "br" and not stack[-1][2]:
            stream.append((stack[-1][3], -1, " "))
        if tag in BLOCK and not stack[-1][2]:
            flush(stack[-1][3])
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in CONTAINER:
                    break
        if tag in CLOSES_SELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES_SELF[tag]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table") or stack[k][0] in CONTAINER - {"td"}:
                    break
        if tag in VOID:
            continue
        _, container, dropped, doubt = stack[-1]
        a = _attrs(m[3])
        if not dropped and (least := _boilerplate(tag, a)) != 0:
            if least is None:
                dropped = True
            else:
                doubts.append((doubt, least))
                doubt = len(doubts) - 1
        if tag in CONTAINER and not dropped:
            name = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in a.get("class", "").lower().split()} - {""})])
            page.paths.append(f"{page.paths[container]}/{name}" if container >= 0 else name)
            page.parents.append(container)
            of.append(doubt)
            container = len(page.paths) - 1
        if tag == "li" and container >= 0:
            page.items[container] = page.items.get(container, 0) + 1
        stack.append((tag, container, dropped, doubt))
    flush(-1)
    _settle(page, stream, doubts, of, heads)
    return page


def _settle(page: Page, stream: list[tuple[int, int, str | None]], doubts: list[tuple[int, float]], of: list[int], heads: set[int]) -> None:
    """Decides on the doubtful elements by their share of the text, and makes the blocks of the others."""
    kept = [True] * (len(doubts) + 1)  # the last for -1
    if doubts:
        size, total = [0] * len(doubts), 0
        for doubt, _, text in stream:
            if text is not None:
                total += (k := len("".join(text.split())))
                while doubt >= 0:
                    size[doubt] += k
                    doubt = doubts[doubt][0]
        for k, (up, least) in enumerate(doubts):
            kept[k] = kept[up] and size[k] > 0 and (size[k] > MOST * total if least == MOST else size[k] >= least * total)
    buffer: list[str] = []
    for k, (doubt, container, text) in enumerate(stream):
        if not kept[doubt]:
            continue
        if text is not None:
            buffer.append(text)
        elif buffer:
            whole = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            while container >= 0 and not kept[of[container]]:
                container = page.parents[container]
            if whole:
                page.blocks.append((container, whole))
                if k in heads:
                    page.heads.add(container)


def host(url: str | None) -> str:
    return m[1].lower() if url and (m := HOST.match(url)) else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for url, text in zip(b.column(0), b.column(1), strict=True):
            page = parse(text.as_py() or "")
            k, size = page.best()
            if k >= 0:
                rows.append((host(url.as_py()), page.paths[k], size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: one row per host with a vote."""
    v = pages.select("url", "html").mapInArrow(_votes, "host string, path string, score bigint")
    v = v.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return v.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, path in zip(b.column(2), b.column(3), strict=True):
            page, want = parse(html.as_py() or ""), path.as_py()
            wanted = {k for k, p in enumerate(page.paths) if p == want}
            if wanted and page.holds(wanted):
                text = page.under({page.without_tail(k) for k in wanted} if len(wanted) == 1 else wanted)
            elif wanted and page.overrules(wanted):
                text = page.under(wanted)
            else:
                best, _ = page.best()
                text = page.under({best}) if best >= 0 else "\n".join(t for _, t in page.blocks)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    from meshlark.llm.common import materialize

    winners = materialize(winning_paths(pages), "paths")
    if winners.count() <= BROADCAST_HOSTS:  # short rows: a few MB at most
        winners = F.broadcast(winners)
    p = pages.select("page_id", "url", "html")
    p = p.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))))
    p = p.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return p.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
