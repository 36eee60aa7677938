"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree whose nodes are paths of tags with their classes, articles included. A
node's importance joins two entropies over the host's pages: of the child layouts that it shows (presentation), and of the
texts that it holds - a text on many of the pages says little (content). A text that stays the same on most pages of its
node is a branch with an importance of its own. Names lean: an element whose class, id or role calls it a menu, advert or
the like multiplies the importance of what it holds by little, and by more the larger its share of the page's text outside
links; an article raises it. Names that entropies can't speak for (navigation, heads, footers, adverts, readers' comments), and
those beside a page's article, get no such share. Names of html, body and of what the page's article stands in don't
count; a class counts if all its parts are such names or words for places and boxes. Branches of low weighted importance go
from each page; the texts of the blocks left are joined in page order.

Only counts for (host, node, text) are shuffled to build the trees. Decided branches go back to the pages broadcast if they
are few; else a page's own branches are looked up by a join on host, branch and a salt, so that neither a host's pages nor
its branches ever meet in one place.

Defined cases: a null html or url is empty, and the text of an empty page is empty. Nodes on fewer than four pages have no
entropy to speak of and count as half important; of a page of which nothing would be left stays its article, and of that
first what names don't lower. Open tags at the end of a page and stray end tags do no harm, and no depth is too deep. Time
and memory for a page grow with its length, whatever it holds: nodes are known by hashes of their paths.
Repeated rows stay; other columns are kept, but for html, text and n_chars.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise

LEAST_IMPORTANCE, PRESENTATION_SHARE, LEAST_PAGES, UNKNOWN = 0.2, 0.1, 4, 0.5
#: What an element's names multiply importance by, what a share of the page's text adds to that, and what an article multiplies it by.
NAMED_WEIGHT, SHARE_WEIGHT, ARTICLE_WEIGHT = 0.15, 0.6, 1.5
#: Decided branches of all hosts up to which they are broadcast, some hundred bytes each; beyond, pages are joined with theirs.
BROADCAST_NODES, SALTS = 200_000, 16
# Elements of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head script style noscript template iframe object svg math canvas audio video select option textarea button form nav footer header aside menu dialog".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
UNIMPORTANT = set(
    "nav navbar navigation menu header masthead footer sidebar side aside notice notices cookie cookies consent gdpr banner ad ads adv advert adverts advertisement promo sponsor sponsored form search login signup subscribe newsletter "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal toolbar widget skip copyright contentinfo complementary".split()
)
#: Of those, names of what can be long and different on every page, and still isn't main text; elements that always are such.
NEVER_MAIN = set("nav navbar navigation menu header masthead banner breadcrumb breadcrumbs pagination pager skip copyright ad ads adv advert adverts advertisement footer side sidebar aside comment comments commentlist reply replies respond discussion disqus related recommended contentinfo complementary".split())
NEVER_MAIN_TAGS = DROPPED - {"form", "header"}
#: Parts of a class that say where, how large or for whom, and nothing about what.
NEUTRAL = set(
    "main site page global primary secondary top bottom left right inner outer upper lower first last bar box boxes list lists item items area section sections wrapper wrap container block inline row col column panel slot unit link links button buttons icon icons "
    "group tag tags body content text title author user users reader readers visitor post posts article articles entry story stories thread count message messages the js is has small large mobile desktop sticky fixed row wide full home web region zone policy up in out bg overlay".split()
)
IMPORTANT = re.compile(r"(?<![a-z])(articlebody|main)(?![a-z])")
RAW = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in "script style noscript template textarea iframe svg title".split()}
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,99})")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_COMMENT_END = re.compile(r"--!?>")
#: Characters after a tag's name that are tried in one go; longer tags are found by way of all quotes of the page.
TAG_CHARS = 512
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


_PARTS = re.compile(r"[a-z]+")


def _called(names: str) -> tuple[bool, bool]:
    """Whether names call an element unimportant, and such that it never is main text: by single classes, all parts of which are telling or neutral."""
    lowered = never = False
    for name in names.split():
        parts = set(_PARTS.findall(name))
        if parts & UNIMPORTANT and parts <= UNIMPORTANT | NEUTRAL:
            lowered = True
            never |= bool(parts & NEVER_MAIN)
    return lowered, never


def _describe(tag: str, rest: str) -> tuple[int, bool, bool, bool, bool]:
    names = " ".join(sorted({(a or b or c) for _, a, b, c in _NAMES.findall(rest)})) if "=" in rest else ""
    words = re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()
    lowered, never = _called(words)
    article = tag in ("article", "main") or bool(names and not lowered and IMPORTANT.search(words))
    lowered = lowered and not article and tag not in ("html", "body")
    return _code(f"{tag}.{names.lower()}" if names else tag), lowered, tag in DROPPED, article, (lowered and never) or tag in NEVER_MAIN_TAGS


_kept_descriptions = functools.lru_cache(maxsize=20_000)(_describe)


def _described(tag: str, rest: str) -> tuple[int, bool, bool, bool, bool]:
    """Code of an element in the tree; whether its names, or its tag, call it unimportant, an article, and never main text."""
    return (_kept_descriptions if len(rest) < 500 else _describe)(tag, rest)


class _TagEnds:
    """Where tags end: at the next ``>`` outside quotes, by chains over all quotes of the page that are followed once."""

    def __init__(self, page: str):
        self.page, self.places, self.ends = page, None, {}

    def __call__(self, at: int) -> int:
        if m := _REST.match(self.page, at, at + TAG_CHARS):
            return m.end() - 1
        if self.places is None:
            self.places = [m.start() for m in re.finditer("[>\"']", self.page)]
            after, self.partner = {}, [-1] * len(self.places)
            for k in range(len(self.places) - 1, -1, -1):
                mark = self.page[self.places[k]]
                self.partner[k] = after.get(mark, -1)
                after[mark] = k
        k, way, end = bisect.bisect_left(self.places, at), [], -1
        while k < len(self.places):
            if k in self.ends:
                end = self.ends[k]
                break
            way.append(k)
            if self.page[self.places[k]] == ">":
                end = self.places[k]
                break
            if self.partner[k] < 0:
                break
            k = self.partner[k] + 1
        self.ends.update(dict.fromkeys(way, end))
        return end


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Marks of a page: (start, end, tag, whether it closes, rest of the tag); no tag for what has no element and no text."""
    at, last, ends = 0, page.rfind(">"), _TagEnds(page)
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            m = _COMMENT_END.search(page, start + 4)
            at = m.end() if m else len(page)
            yield start, at, None, False, ""
        elif start > last:
            break
        elif m := _OPEN.match(page, start):
            end = ends(m.end())
            if end < 0:
                continue
            tag, at = m[2].lower(), end + 1
            if tag in RAW and not m[1]:
                close = RAW[tag].search(page, at)
                at = close.end() if close else len(page)
                yield start, at, None, False, ""
            else:
                yield start, at, tag, bool(m[1]), page[m.end() : end]
        elif page[at : at + 1] in ("!", "?", "/") and page[at : at + 1]:
            at = page.find(">", at) + 1
            yield start, at, None, False, ""


class _Open:
    """Open elements of a page, with the places of each tag and of the kinds that close others, so that no end tag is searched for."""

    __slots__ = ("kinds", "stack", "tags")

    def __init__(self):
        # tag, node, innermost element around that names call unimportant, whether one never is main text, outermost article; elements by number
        self.stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
        self.tags: dict[str, list[int]] = {}
        self.kinds: dict[str, list[int]] = {"block": [], "closer": [], "list": []}

    def push(self, tag: str, *rest) -> None:
        at = len(self.stack)
        self.stack.append((tag, *rest))
        self.tags.setdefault(tag, []).append(at)
        for kind in _kinds_of(tag):
            self.kinds[kind].append(at)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        for tag, *_ in reversed(self.stack[depth:]):
            self.tags[tag].pop()
            for kind in _kinds_of(tag):
                self.kinds[kind].pop()
        del self.stack[depth:]

    def last(self, kind: str) -> int:
        return self.kinds[kind][-1] if self.kinds[kind] else 0


@functools.lru_cache(maxsize=1000)
def _kinds_of(tag: str) -> tuple[str, ...]:
    block = ("block",) if tag in BLOCKS or tag in DROPPED else ()
    return (*block, *(("closer",) if tag in CLOSES_P else ()), *(("list",) if tag in ("li", "dd", "dt", "ul", "ol", "dl") else ()))


def parse(page: str) -> tuple[list[tuple[int, str, bool, bool, float]], dict[int, int]]:
    """Blocks of a page (node, text, unimportant by name, within an article, weight of its importance), and a code of each node's child layout."""
    blocks: list[tuple[int, str, int, bool, int]] = []
    layouts: dict[int, tuple[int, int]] = {}  # last child and code so far
    around = _Open()
    tagged: set[int] = set()  # articles by their tag
    held: dict[int, int] = {}  # articles, and the innermost unimportant element that each stands in
    up: list[int] = [0]  # unimportant elements in order, each with the one that it stands in
    sizes, linked = [0], [0]
    text: list[str] = []
    where, anchors, links = around.stack[-1], 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                blocks.append((where[1], joined, where[2], where[3], where[4]))
                sizes[where[2]] += len(joined)
                linked[where[2]] += min(links, len(joined))
        links = 0

    at = number = 0
    for start, end, tag, closes, rest in tokens(page):
        if start > at:
            if not text:
                where = around.stack[-1]
            text.append(page[at:start])
            links += (start - at) * (anchors > 0)
        at = end
        if tag is None:
            continue
        block = tag in BLOCKS or tag in DROPPED
        if closes:
            if block:
                flush()
            anchors -= tag == "a" and anchors > 0
            own = around.tags.get(tag)
            # an inline end tag doesn't close the block that it stands in
            if own and (block or around.last("block") < own[-1]):
                around.cut(own[-1])
            continue
        if tag == "br":
            text.append(" ")
            continue
        if block:
            flush()
            anchors = 0
            depth = around.last("closer")
            if tag in CLOSES_P and depth and around.stack[depth][0] == "p":
                around.cut(depth)
            depth = around.last("list")
            if tag in ("li", "dd", "dt") and depth and around.stack[depth][0] in ("li", "dd", "dt"):
                around.cut(depth)
        if tag in VOID or rest.rstrip().endswith("/"):
            continue
        anchors += tag == "a"
        name, lowered, by_tag, article, never = _described(tag, rest)
        _, node, low, lost, inside = around.stack[-1]
        number += 1
        unimportant = lowered or (by_tag and not (tag == "header" and inside))  # an article's own header has its title
        if block or unimportant:
            last, code = layouts.get(node, (0, 0))
            if last != name:
                layouts[node] = (name, _step(code, name))
            node = _step(node, name)
        if article and not inside:
            held[number] = low
            if tag in ("article", "main"):
                tagged.add(number)
        if unimportant:
            up.append(low)
            sizes.append(0), linked.append(0)
            low = len(up) - 1
        around.push(tag, node, low, lost or never, inside or (number if article else 0))
    if at < len(page):
        if not text:
            where = around.stack[-1]
        text.append(page[at:])
        links += (len(page) - at) * (anchors > 0)
    flush()
    own: Counter = Counter()
    for _, joined, _, _, inside in blocks:
        if inside:
            own[inside] += len(joined)
    for k in range(len(up) - 1, 0, -1):  # an element holds what elements in it hold
        sizes[up[k]] += sizes[k]
        linked[up[k]] += linked[k]
    without = {0}  # unimportant elements that the longest article stands in, whose names don't count
    low = held[max(own, key=own.get)] if own else 0
    while low:
        without.add(low)
        low = up[low]
    out = []
    for node, joined, low, lost, inside in blocks:
        if low in without:
            out.append((node, joined, False, bool(inside), ARTICLE_WEIGHT if inside else 1.0))
        else:  # what stands beside an article has no share to speak for it
            share = 0.0 if lost or (not inside and not tagged.isdisjoint(own)) else (sizes[low] - linked[low]) / sizes[0]
            out.append((node, joined, True, bool(inside), NAMED_WEIGHT + SHARE_WEIGHT * share))
    return out, {node: code for node, (_, code) in layouts.items()}


def _step(node: int, name: int) -> int:
    """Code of a child with the code ``name`` of the node ``node``: multiplied and mixed 64-bit numbers, as Python's integers."""
    x = (node * 0x9E3779B97F4A7C15 + name) & _ALL
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _ALL
    x ^= x >> 29
    return x - (x >> 63 << 64)


_ALL = (1 << 64) - 1


def main_text(page: str | None, low: set[int] | dict[int, float]) -> str:
    """Text of the important blocks of a page. ``low`` has the importance of branches of the host's tree (a set: 0)."""
    blocks, _ = parse(page or "")
    known = low if isinstance(low, dict) else dict.fromkeys(low, 0.0)

    def stays(node: int, text: str, named: bool, inside: bool, weight: float) -> bool:
        values = [known[c] for c in (node, _branch(node, _code(text))) if c in known] if known else []
        return (min(values) if values else UNKNOWN) * weight >= LEAST_IMPORTANCE

    kept = [b[1] for b in blocks if stays(*b)]
    article = [b for b in blocks if b[3]]
    return "\n".join(kept or [b[1] for b in article if not b[2]] or [b[1] for b in article])


def _branch(node: int, text: int) -> int:
    """The number of a text of a node, as SQL's node ^ (text << 1)."""
    value = (node ^ (text << 1)) & (1 << 64) - 1
    return value - (value >> 63 << 64)


def _code(text: str | int) -> int:
    """The number of a text; a number stands for itself."""
    return text if isinstance(text, int) else int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host(column: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(column).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _count_batches(batches):
    for batch in batches:
        found: Counter = Counter()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            blocks, layouts = parse(page or "")
            own = {(node, _code(text)) for node, text, *_ in blocks}
            found.update((host, node, "n", 0) for node in {b[0] for b in blocks if b[2]})
            nodes = {node for node, _ in own}
            found.update((host, node, "t", text) for node, text in own)
            found.update((host, node, "p", 0) for node in nodes)
            found.update((host, node, "l", layouts.get(node, 0)) for node in nodes)
        if found:
            columns = [*zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array([*found.values()], pa.int64())], ["host", "node", "kind", "feature", "n"])


def style_tree(pages: DataFrame) -> DataFrame:
    """Branches of all hosts' trees: host, node, pages, named, presentation, content, importance.

    With m pages, content importance is 1 less the mean of ln(n) / ln(m) over a node's texts, n the pages with the text;
    presentation importance is the entropy of its layouts to the base m. A text on many pages has a row besides its node.
    """
    return _importance(_site_counts(pages))


def _site_counts(pages: DataFrame) -> DataFrame:
    counts = pages.select(_host("url").alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_count_batches, "host string, node long, kind string, feature long, n long")
    return materialise(counts.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")), "site-counts")


def _importance(counts: DataFrame) -> DataFrame:
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    n = F.col("n").cast("double")
    nodes = counts.groupBy("host", "node").agg(of("p", n).alias("pages"), of("n", n).isNotNull().alias("named"), of("t", F.log(n)).alias("logs"), of("t", F.lit(1.0)).alias("texts"), of("l", n * F.log(n)).alias("layout_logs"))
    base = F.log("pages")
    nodes = nodes.where(F.col("pages") >= LEAST_PAGES).select("host", "node", "pages", "named", ((base - F.col("layout_logs") / F.col("pages")) / base).alias("presentation"), (1 - F.col("logs") / F.col("texts") / base).alias("content"))
    repeated = counts.where((F.col("kind") == "t") & (F.col("n") > 2)).select("host", "node", "feature", n.alias("n"))
    # 2 pages of 4 are content of 1/2, so that texts on fewer than 3 pages are never low
    # a node may have very many repeated texts, so they meet their node by a salt
    salted, dealt = nodes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), repeated.withColumn("_s", F.pmod("feature", F.lit(SALTS)).cast("int"))
    texts = salted.join(dealt, ["host", "node", "_s"]).select("host", F.col("node").bitwiseXOR(F.shiftleft("feature", 1)).alias("node"), "pages", F.lit(False).alias("named"), "presentation", (1 - F.log("n") / base).alias("content"))
    return nodes.union(texts).withColumn("importance", PRESENTATION_SHARE * F.col("presentation") + (1 - PRESENTATION_SHARE) * F.col("content"))


def _texts(batch: pa.RecordBatch, texts: list[str], dropped: tuple[str, ...]) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in ("html", "text", "n_chars", *dropped)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])


def _extract_batches(shared):
    """Texts with the decided branches of all hosts at hand, a dict of importance by code for each."""

    def run(batches):
        hosts, none = shared.value, {}
        for batch in batches:
            yield _texts(batch, [main_text(page, hosts.get(host, none)) for page, host in zip(batch.column("html").to_pylist(), batch.column("_of").to_pylist())], ("_of",))

    return run


def _extract_joined(batches):
    """Texts with each page's own decided branches beside it."""
    for batch in batches:
        known = [{x["code"]: x["importance"] for x in own or ()} for own in batch.column("_known").to_pylist()]
        yield _texts(batch, [main_text(page, own) for page, own in zip(batch.column("html").to_pylist(), known)], ("_known",))


def _branch_batches(batches):
    """The codes of a page's branches: its nodes, and the texts of each."""
    for batch in batches:
        key = [batch.column(c) for c in ("_of", "_a", "_b")]
        at, codes = [], []
        for i, page in enumerate(batch.column("html").to_pylist()):
            own = set()
            for node, text, *_ in parse(page or "")[0]:
                own |= {node, _branch(node, _code(text))}
            at += [i] * len(own)
            codes += own
        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(at, pa.int64())) for k in key), pa.array(codes, pa.int64())], ["_of", "_a", "_b", "code"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with text and n_chars instead of html."""
    counts = _site_counts(pages)
    low = _importance(counts).where((F.col("importance") < LEAST_IMPORTANCE) | F.col("named"))
    low = materialise(low.groupBy(F.col("host").alias("_of"), F.col("node").alias("code")).agg(F.min("importance").alias("importance")), "site-trees")
    discard(counts)
    rows = pages.drop("text", "n_chars", "_of", "_a", "_b", "_known").withColumn("html", F.col("html").cast("string")).withColumn("_of", _host("url"))
    schema = rows.drop("html", "_of").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    if low.count() <= BROADCAST_NODES:
        hosts: dict[str, dict[int, float]] = {}
        for r in low.toLocalIterator():
            hosts.setdefault(r["_of"], {})[r["code"]] = r["importance"]
        return rows.mapInArrow(_extract_batches(pages.sparkSession.sparkContext.broadcast(hosts)), schema)
    page = ["_of", "_a", "_b"]  # equal pages of a host have equal texts
    keyed = rows.withColumns({"_a": F.coalesce(F.xxhash64("html"), F.lit(0).cast("long")), "_b": F.hash("html", F.char_length("html"))})
    salted = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    codes = keyed.select(*page, "html").mapInArrow(_branch_batches, "_of string, _a long, _b int, code long").withColumn("_salt", F.pmod("_a", F.lit(SALTS)).cast("int"))
    known = codes.join(salted, ["_of", "code", "_salt"]).groupBy(*page).agg(F.collect_set(F.struct("code", "importance")).alias("_known"))
    joined = keyed.join(materialise(known, "page-branches"), page, "left").drop(*page)
    return joined.mapInArrow(_extract_joined, schema)
