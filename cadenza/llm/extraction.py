"""HTML extraction with inferred wrappers.

Method: union-free regular-expression inference.  A page is a stream of block
tags and texts.  Tandem repeats in a stream fold into repeated groups; streams of
pages of the same host are then aligned one after the other: texts that differ
become text slots, texts that agree stay template text, and what only some pages
have becomes an optional group.  The result is the host's wrapper, an expression
whose nodes have roles: template (the same on every sampled page with its path,
three at least, and not within the article), article slot or other slot.  A page is read by aligning its
stream with the expression: texts of article slots come out, template texts and
other slots do not; blocks without a node are judged by where they stand.

What every article of a host says (a heading, a licence line) is article text: constant
texts below an article's root are slots like others, but not in marked holders (an advert), and not where a list
has the same short labels on every sampled page (Share, Print): that is a menu.  Only where no holder but the page itself
is the root does constant text there count as template.

Article slots follow from the wrapper: the holders of the article element, or else
the smallest holder with most of the varying prose of the sampled pages (linked
text is no prose), without navigation, footers, asides and forms.  Class names only
break ties: a name marks a holder when other prose is left without it, never html,
body, what holds an article, or (but for reader comments) most of the text.  A page
without any text in the article slots of its host is read by its own layout, found
by the same rules.

Plan: wrappers are inferred from at most ``SAMPLE_PAGES`` pages per host (picked
by hash in two steps, so that a host with a third of all pages is no single
task), one group per host, a few pages each.  Where the wrappers together have at
most ``BROADCAST_BYTES`` they go to the tasks as a broadcast, and pages are read in
one map without a shuffle; beyond that pages meet wrappers by a join on the host,
where hosts with many pages are dealt to several tasks.

Edge cases: null html counts as empty and gives an empty text.  Null or odd urls
share the host ''.  A host with one or two pages has a wrapper without template text.
A page all of whose admitted text is template text keeps it.  A page_id that repeats is
learned from once.  Elements that are
never closed hide nothing but their own tag, scripts and styles excepted.
Repeated rows keep their rows.  Empty tables give empty results.  Extra columns
are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialise

SAMPLE_PAGES = 8
BROADCAST_BYTES = 16 << 20
HOT_PAGES = 10_000  # pages of a host that one task reads where wrappers are joined
HIDDEN = frozenset("script style noscript template svg iframe textarea select button title object canvas".split())
RAW = frozenset(("script", "style"))  # hide the rest of the page where they are not closed
#: Comments, tags and declarations.  A quote counts after an equals sign only, and outside quotes a tag gives up at the
#: next "<" (the second form then takes what stands before the first ">"), so that no scan goes over many tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>"
    r"|<(?P<cut>/?)(?P<name>[a-z][a-z0-9-]*)[^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
CLOSERS = re.compile(rf"</({'|'.join(sorted(HIDDEN))})\b[^>]*>", re.I)
#: Elements that hold other blocks and are closed by their end tags.
HOLDERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure blockquote details dialog fieldset menu".split())
#: Elements that begin a block of text.
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre hr address caption figcaption summary option label legend".split())
HEADINGS = frozenset(("h1", "h2"))
ARTICLES = ("article", "main")
UNMARKED = frozenset(("html", "body"))
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
READERS = frozenset("comment comments disqus replies reply".split())  # marks that hold however much text there is
TITLES = frozenset("header masthead".split())  # no marks inside an article, whose head line they hold
LISTS = frozenset(("ul", "ol"))
LABEL = 24  # most characters of a menu's entry
STATES = frozenset("has with no".split())  # "has-sidebar" names a state of the page
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MOST = 0.75  # share of the prose that leads into a holder


@dataclass
class Block:
    path: str  # open holders and the block's own tag, as "body>article|p"
    text: str
    linked: int = 0  # characters within links


def holder(tag: str, attrs: str) -> str:
    names = set()
    for m in NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[_>|.-]+|\d{3,}", name) if w and not w.isdigit()]
            names.update(words if not STATES.intersection(words[:1]) else ["-".join(words)])
    return ".".join([tag, *sorted(names)])


def blocks(page: str) -> list[Block]:
    """Texts of a page in order, with white space folded and references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: Counter[str] = Counter()  # how often each tag is open
    own, parts, at, anchors, linked = "", [], 0, 0, 0
    closers: dict[str, list[tuple[int, int]]] | None = None

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append(Block(">".join(name for _, name in stack) + "|" + own, text, min(linked, len(text))))
        linked = 0

    whole = page.rfind(">") + 1  # nothing after this can be a tag; a comment may begin there
    comment = page.find("<!--", whole)
    for m in TOKEN.finditer(page, 0, whole):
        if m.start() < at:  # inside a hidden element
            continue
        parts.append(page[at : m.start()])
        linked += (m.start() - at) * (anchors > 0)
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # never closed
            at = comment = len(page)
        tag, end = (m["tag"] or m["name"] or "").lower(), m["end"] or m["cut"]
        if tag in HIDDEN and not end:
            if closers is None:
                closers = defaultdict(list)
                for c in CLOSERS.finditer(page, 0, whole):
                    closers[c[1].lower()].append(c.span())
            k = bisect_left(closers[tag], (at, 0))
            if k < len(closers[tag]):
                at = closers[tag][k][1]
            elif tag in RAW:
                at = len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            anchors = 0 if end else 1
        if tag not in BLOCKS:
            continue
        close()
        anchors = 0
        if tag not in HOLDERS:
            own = "" if end else tag
        elif not end:
            stack.append((tag, holder(tag, m["attrs"] or "")))
            held[tag] += 1
            own = ""
        elif held[tag]:
            gone = ""
            while gone != tag:
                gone = stack.pop()[0]
                held[gone] -= 1
            own = ""
    rest = page[at : comment if comment >= 0 else len(page)]
    parts.append(rest)
    linked += len(rest) * (anchors > 0)
    close()
    return found


# --- where the article is ---------------------------------------------------------


@lru_cache(maxsize=1 << 14)
def place(path: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[frozenset[str], ...], str]:
    """Of a path: its holders as growing prefixes, their tags and marks, and its own tag."""
    holders, own = path.rsplit("|", 1)
    names = holders.split(">") if holders else []
    split = [n.split(".") for n in names]
    marks = tuple(frozenset() if w[0] in UNMARKED else MARKS.intersection(w[1:]) for w in split)
    return tuple(accumulate(names, lambda a, b: f"{a}>{b}")), tuple(w[0] for w in split), marks, own


def prose(block: Block) -> int:
    """Characters of a block outside links; none where most of it is linked."""
    return len(block.text) - block.linked if 2 * block.linked <= len(block.text) else 0


@dataclass
class Layout:
    """Which paths belong to the article: those below the roots, but for the holders left out."""

    roots: frozenset[str]
    out: frozenset[str]  # prefixes of marked holders
    article: bool  # whether the roots are article elements

    def holds(self, path: str) -> bool:
        prefixes, tags, _, own = place(path)
        at = next((k for k, p in enumerate(prefixes) if p in self.roots), None)
        if at is None and "" not in self.roots:
            return own in HEADINGS and not self.article and self.free(prefixes, tags, 0) and any(r.startswith((prefixes[-1] if prefixes else "") + ">") for r in self.roots)
        return self.free(prefixes, tags, 0 if at is None else at)

    def inside(self, path: str) -> bool:
        """Whether the path is of the article and below a root that is more than the page itself."""
        prefixes, tags, _, _ = place(path)
        return self.holds(path) and any(p in self.roots and t not in UNMARKED for p, t in zip(prefixes, tags, strict=True))

    def listed(self, path: str) -> bool:
        """Whether the path is within a list below a root."""
        prefixes, tags, _, _ = place(path)
        at = next((k for k, p in enumerate(prefixes) if p in self.roots), len(tags))
        return any(t in LISTS for t in tags[at + 1 :])

    def free(self, prefixes: tuple[str, ...], tags: tuple[str, ...], at: int) -> bool:
        """Nothing from the root down is outside an article."""
        heads = () if self.article or any(t not in UNMARKED for t in tags[:at]) else ("header",)
        return not any(t in OUTSIDE or t in heads for t in tags[at:]) and not any(p in self.out for p in prefixes[at:])


def layout(found: list[Block], every: list[Block] | None = None) -> Layout:
    """Where the article of these blocks (of one page, or of all sampled pages of a host) is.

    Marked holders are read from ``every`` block, with those that are template text.
    """
    mass: Counter[str] = Counter()  # prose by prefix
    marked: dict[str, frozenset[str]] = {}
    articles: dict[str, tuple[int, bool]] = {}  # prefix of an article element: rank of its tag and whether marked holders are above it
    around: set[str] = set()  # holders of an article element
    for b in every or found:
        prefixes, _, marks, _ = place(b.path)
        marked.update((p, m) for p, m in zip(prefixes, marks, strict=True) if m)
    for b in found:
        prefixes, tags, marks, _ = place(b.path)
        for p in prefixes:
            mass[p] += prose(b)
        for rank, kind in enumerate(ARTICLES):
            if kind in tags:
                k = tags.index(kind)
                if not any(t in OUTSIDE for t in tags[:k]):
                    articles[prefixes[k]] = (rank, any(marks[: k + 1]))
                    around.update(prefixes[: k + 1])
                    break
    if articles:
        best = min(articles.values())
        roots = frozenset(p for p, kind in articles.items() if kind == best)
        whole = sum(mass[r] for r in roots)
        names = {p: m - TITLES for p, m in marked.items() if p not in around}
        out = frozenset(p for p, m in names.items() if m and (m & READERS or 2 * mass[p] < whole or not whole))
        kept = Layout(roots, out, True)
        return kept if any(kept.holds(b.path) for b in found) else Layout(roots, frozenset(), True)
    inside = [b for b in found if prose(b) and not any(t in OUTSIDE or t == "header" for t in place(b.path)[1])]
    whole = sum(map(prose, inside))
    out = frozenset(p for p, m in marked.items() if m & READERS or 2 * mass[p] < whole)
    free = [b for b in inside if not any(p in out for p in place(b.path)[0])]
    if not free:
        free, out = inside or found, frozenset()
    count: Counter[str] = Counter()
    for b in free:
        for p in place(b.path)[0]:
            count[p] += prose(b)
    most = [p for p, n in count.items() if n >= MOST * sum(map(prose, free))]
    return Layout(frozenset((max(most, key=lambda p: p.count(">"), default=""),)), out, False)


def labels(texts: list[str]) -> bool:
    """Whether these are the entries of a menu: several, short, and no sentences."""
    return len(texts) > 1 and all(len(t) <= LABEL and t[-1] not in ".!?…。！？" for t in texts)


# --- inference ------------------------------------------------------------------


@dataclass
class Item:
    """A node of a wrapper: a path with its (path, text) pairs on each page, or a group of nodes."""

    key: str
    texts: list[tuple[tuple[str, str], ...]] = field(default_factory=list)
    inner: list[Item] = field(default_factory=list)
    repeated: bool = False
    optional: bool = False

    def __str__(self) -> str:
        body = "(" + " ".join(map(str, self.inner)) + ")" if self.inner else self.key
        return body + "+" * self.repeated + "?" * self.optional


def join_flags(left: Item, right: Item) -> None:
    """What repeats or may be absent in a like item does so in ``left`` as well."""
    left.repeated |= right.repeated
    left.optional |= right.optional
    for a, b in zip(left.inner, right.inner, strict=True):
        join_flags(a, b)


def fold_repeats(items: list[Item], longest: int = 4) -> list[Item]:
    """Tandem repeats of up to ``longest`` items become one repeated group each."""
    for size in range(1, longest + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            unit = items[i : i + size]
            keys = [x.key for x in unit]
            n = 1
            while len(unit) == size and [x.key for x in items[i + n * size : i + (n + 1) * size]] == keys:
                n += 1
            if n > 1:
                key = "(" + " ".join(keys) + ")+" if size > 1 else unit[0].key
                texts = [tuple(t for x in items[i : i + n * size] for page in x.texts for t in page)]
                if size > 1:
                    for k in range(i + size, i + n * size):
                        join_flags(unit[(k - i) % size], items[k])
                out.append(Item(key, texts, unit if size > 1 else [], repeated=True))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def matched(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Positions of like keys, rising on both sides: the longest run in which the n-th
    of a key meets the n-th of that key.  O(n log n)."""

    def numbered(keys: list[str]) -> list[tuple[str, int]]:
        count: Counter[str] = Counter()
        out = []
        for key in keys:
            out.append((key, count[key]))
            count[key] += 1
        return out

    seen = {key: i for i, key in enumerate(numbered(left))}
    pairs = [(seen[key], j) for j, key in enumerate(numbered(right)) if key in seen]
    ends: list[int] = []  # the least last position of a run, by its length
    last: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(ends, i)
        back.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(i)
            last.append(n)
        else:
            ends[k], last[k] = i, n
    run, n = [], last[-1] if last else -1
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def align(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """The wrapper that reads both: common items merge, others become optional."""
    out: list[Item] = []
    i = j = 0
    for a, b in [*matched([x.key for x in wrapper], [x.key for x in page]), (len(wrapper), len(page))]:
        for item in (*wrapper[i:a], *page[j:b]):
            item.optional = True
            out.append(item)
        if a < len(wrapper):
            join_flags(wrapper[a], page[b])
            wrapper[a].texts += page[b].texts
            out.append(wrapper[a])
        i, j = a + 1, b + 1
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of same-host pages: its expression, its nodes with their roles, and where the article is."""
    streams = [blocks(p) for p in pages]
    wrapper: list[Item] | None = None
    read: list[tuple] = []
    varying: list[Block] = []
    for stream in streams:
        texts = tuple((b.path, b.text) for b in stream)
        if texts in read:  # a copy tells nothing about what varies
            continue
        read.append(texts)
        varying += stream
        items = fold_repeats([Item(path, [((path, text),)]) for path, text in texts])
        wrapper = items if wrapper is None else align(wrapper, items)
    with_path = Counter(path for texts in read for path in {path for path, _ in texts})
    nodes: list[tuple[str, list[str]]] = []  # path and template texts
    for item in wrapper or []:
        same = len(item.texts) > 2 and len(set(item.texts)) == 1 and all(with_path[path] == len(item.texts) for path, _ in item.texts[0])
        by_path: dict[str, list[str]] = {path: [] for page in item.texts for path, _ in page}
        for path, text in item.texts[0] if same else ():
            by_path[path].append(text)
        nodes += by_path.items()
    template = {(path, text) for path, texts in nodes for text in texts}
    at = layout([b for b in varying if (b.path, b.text) not in template], varying)
    nodes = [(path, [] if at.inside(path) and not (at.listed(path) and labels(texts)) else texts) for path, texts in nodes]  # what every article says is part of it
    roles = [[path, "template" if texts else "article" if at.holds(path) else "other", texts] for path, texts in nodes]
    return {"expression": " ".join(map(str, wrapper or [])), "nodes": roles, "roots": sorted(at.roots), "out": sorted(at.out), "article": at.article}


class Reader:
    """Reads pages by a wrapper."""

    def __init__(self, wrapper: dict | None = None):
        wrapper = wrapper or {"nodes": [], "roots": [], "out": [], "article": False}
        self.nodes = wrapper["nodes"]
        self.layout = Layout(frozenset(wrapper["roots"]), frozenset(wrapper["out"]), wrapper["article"])
        self.constant = {(path, text) for path, _, texts in self.nodes for text in texts}
        self.keys = [path for path, _, _ in self.nodes]

    def roles(self, found: list[Block]) -> list[str]:
        """Role of each block: that of the node that the alignment gives it, or of where it stands."""
        runs: list[list[int]] = []  # blocks in a row with one path are one item
        for k, b in enumerate(found):
            if runs and found[runs[-1][0]].path == b.path:
                runs[-1].append(k)
            else:
                runs.append([k])
        node = {j: i for i, j in matched(self.keys, [found[r[0]].path for r in runs])}
        out = []
        for j, run in enumerate(runs):
            path = found[run[0]].path
            role = self.nodes[node[j]][1] if j in node else "article" if self.layout.holds(path) else "other"
            if role == "template":  # this page has more here than the sampled ones
                role = "article" if self.layout.holds(path) else "other"
            same = [(path, found[k].text) in self.constant for k in run]
            if self.layout.listed(path) and not all(same):  # a list of the article may have a menu's word as an entry
                same = [False] * len(run)
            out += ["template" if x else role for x in same]
        return out

    def extract(self, page: str | None) -> str:
        """The main text of a page."""
        found = blocks(page or "")
        roles = self.roles(found)
        kept = [b for b, role in zip(found, roles, strict=True) if role == "article"]
        if not kept:  # another layout than the sampled pages have
            for some in ([b for b, role in zip(found, roles, strict=True) if role != "template"], found):
                own = layout(some)
                if kept := [b for b in some if own.holds(b.path)]:
                    break
        return "\n\n".join(b.text for b in kept)


def extract(page: str | None, wrapper: dict | None = None) -> str:
    return Reader(wrapper).extract(page)


# --- on the cluster --------------------------------------------------------------


def with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def small(df: DataFrame, name: str, limit: int) -> bool:
    """Whether the column ``name`` of a written table has at most ``limit`` bytes in all."""
    return (df.agg(F.sum(F.octet_length(name) + 16)).first()[0] or 0) <= limit


def wrappers(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host and wrapper (JSON), inferred from at most ``sample_pages`` pages per host."""
    hosted = with_host(pages)
    light = hosted.select("host", "page_id", F.xxhash64("page_id", "url").alias("order"))
    for part in (F.pmod(F.col("order"), F.lit(64)), F.lit(0).cast("long")):  # first within parts of a host, then within the host
        rank = F.row_number().over(Window.partitionBy("host", "part").orderBy("order", "page_id"))
        light = light.withColumn("part", part).withColumn("rank", rank).filter(F.col("rank") <= sample_pages).drop("part", "rank")
    chosen = materialise(light.select(F.col("page_id").alias("_id"), F.col("host").alias("_host")).distinct(), "sampled-pages")
    if small(chosen, "_host", broadcast_bytes):
        chosen = F.broadcast(chosen)
    sample = hosted.join(chosen, hosted["page_id"].eqNullSafe(chosen["_id"]) & (hosted["host"] == chosen["_host"]), "left_semi")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page_id").head(sample_pages)
        found = infer([h or "" for h in rows["html"]])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(found, ensure_ascii=False)]})

    once = sample.groupBy("host", "page_id").agg(F.min("html").alias("html"))  # an id may repeat without bound
    return once.groupBy("host").applyInPandas(run, "host string, wrapper string")


def main_texts(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, broadcast_bytes: int = BROADCAST_BYTES, hot_pages: int = HOT_PAGES) -> DataFrame:
    """page_id, url, text and n_chars per page."""
    learned = materialise(wrappers(pages, sample_pages, broadcast_bytes), "wrappers")
    hosted = with_host(pages)
    if small(learned, "wrapper", broadcast_bytes):
        every = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in learned.collect()})
        rows = hosted.select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("wrapper"))
    else:
        every = None
        hot = hosted.groupBy("host").agg(F.ceil(F.count("*") / F.lit(hot_pages)).cast("int").alias("parts"))
        dealt = learned.join(hot, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        hot = materialise(hot.filter("parts > 1"), "hot-hosts")
        if small(hot, "host", broadcast_bytes):
            hot = F.broadcast(hot)
        salted = hosted.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        rows = salted.join(dealt.drop("parts").hint("shuffle_hash"), ["host", "part"], "left").select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            texts = []
            for page, host, given in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if host not in readers:
                    if len(readers) >= 256:
                        readers.clear()
                    found = every.value.get(host) if every else given
                    readers[host] = Reader(json.loads(found) if found else None)
                texts.append(readers[host].extract(page))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
