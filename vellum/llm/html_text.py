"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: block elements, known by their path of tag and class names, and text nodes, known by path and
content. The tokens of a host's pages that share an occurrence vector (how often in which page) form an equivalence class;
vectors meet as the sum of one hash for each page and count, so classes form under partial aggregation and no host is
gathered anywhere. Classes of several tokens that hold nine pages of ten or more, in one order, are valid. They nest: a class lies in
that of the nearest element above its topmost one. Their elements are the host's template and their texts its fixed parts; the
text that remains lies in slots, each in the template element nearest above it. The element deepest down that stands once a page in
the template and covers nine tenths of the slots' text bounds the main slots (its article or main element, if it lies in one);
a page's text is the blocks of the slots there, without blocks of fixed texts alone.

Menus, footers, sidebars, forms, page headers and hidden parts are told by tag, role and attribute. An element whose class or id is made
of furniture words only (adverts, comments, shares) counts as furniture if it holds less than half of the host's remaining text, or on
a page by itself of the page's; names like "has-sidebar" or "related-work" say nothing. Hosts of under three different pages,
and pages without their host's main element, fall back to the page's own article or main element, else the body. Where fixed texts
are over half of a page's main text (copies of one article at several places), they stay.

Defined results: a null, empty or textless page has the empty text; unclosed and crossed tags are closed as browsers do; a tag
that the page's end cuts off is dropped; repeated pages each come back; a null url is a host of its own; elements nested over 256
deep count as part of the 256th, but for an article or main element that lies in no other. A page takes time in proportion to its length.
Texts are never cut.
"""

from __future__ import annotations

import html as entities
import re
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from vellum.llm.common import bounded, cut, small_batches

MIN_PAGES, SUPPORT, COVER, DEPTH, FURNITURE = 3, 0.9, 0.9, 256, 0.5
#: Most fixed texts and furniture paths, 64 bits each, that are broadcast; beyond it pages meet their hosts' by a shuffle.
BOUND = 200_000

# Names of HTML elements by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu head".split())
LEAVES = "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption".split()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
# Words that name furniture of a page, and words that may stand beside them.
_NAMES = re.compile(
    r"nav\w*|menus?|side-?bars?|ads?|advert\w*|banners?|promos?|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletters?|subscri\w*|comments?|discussion|replies|reply|"
    r"respond|disqus|shar(?:e|es|ing)|social|related|recommend\w*|breadcrumbs?|footer|masthead|login|signin|signup|search|widgets?|toolbar|skip|copyright|pagination|pager",
    re.IGNORECASE,
)
_BESIDE = re.compile(r"[0-9x]*|box|block|list|bar|links?|posts?|articles?|items?|area|top|bottom|left|right|wrap|wrapper|inner|outer|container|slot|unit|form|buttons?|icons?|section|site|page|to|content|the|media", re.IGNORECASE)
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An open element: tag, path, whether it is skipped, its outermost element named as furniture, whether it lies in the main element,
    and the place on the stack of the block element nearest to it, itself included."""

    __slots__ = ("block", "inside", "named", "path", "skip", "tag")

    def __init__(self, tag: str, path: str, skip: bool, named: str | None, inside: bool, block: int):
        self.tag, self.path, self.skip, self.named, self.inside, self.block = tag, path, skip, named, inside, block


class Stack(list):
    """Open elements, with how many there are of each tag, of inline ones and of those that hold an article; nothing is looked for by going through it."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.tags: dict[str, int] = {}
        self.inline = self.articles = 0

    def push(self, node: Node) -> None:
        self.append(node)
        self._count(node.tag, 1)

    def drop(self, down_to: int) -> None:
        """Close elements until so many are left."""
        while len(self) > down_to:
            self._count(self.pop().tag, -1)

    def close(self, tag: str) -> bool:
        """Close the elements through the last one of the tag; False if there is none."""
        if not self.tags.get(tag):
            return False
        while self[-1].tag != tag:
            self.drop(len(self) - 1)
        self.drop(len(self) - 1)
        return True

    def _count(self, tag: str, by: int) -> None:
        self.tags[tag] = self.tags.get(tag, 0) + by
        if tag in INLINE:
            self.inline += by
        elif tag in ("article", "main"):
            self.articles += by


def _furniture(names: str) -> bool:
    """Whether any of some class or id names consists of furniture words, others beside them allowed."""
    for name in names.split():
        words = [w for w in re.split("[-_]+", name) if w]
        hits = sum(bool(_NAMES.fullmatch(w)) for w in words)
        if hits and hits + sum(bool(_BESIDE.fullmatch(w)) for w in words if not _NAMES.fullmatch(w)) == len(words):
            return True
    return False


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """The name parts of class and id for the path, whether the element is hidden or boilerplate by role, and by name."""
    name, skip, named = "", False, False
    for m in _ATTR.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            name += ("." if key == "class" else "#") + ".".join(sorted(_DIGITS.sub("0", value).split())).replace("/", "|")
            named = named or _furniture(value)
        elif key == "role":
            skip = skip or value.lower() in _BOILER_ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            skip = True
    return name if len(name) <= 80 else f"{name[:40]}~{xxhash.xxh64_hexdigest(name)}", skip, named


def walk(page: str, main: str | None = None):
    """Events of a page in order: ("open", path), ("text", node, text) outside boilerplate, ("break",) between blocks.

    Nodes know whether they lie in an element of the path ``main`` ("": anywhere).
    """
    stack = Stack(Node("", "", False, None, main == "", 0))
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not stack[-1].skip:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if stack.close(tag) and tag not in INLINE:
                yield ("break",)
            continue
        name, skip, named = _attributes(m[4]) if m[4] and not m[4].isspace() else ("", False, False)
        above = stack[-1]
        if tag in VOID:
            if tag == "hr":
                yield ("break",)
            elif not above.skip:
                yield "text", above, " "
            continue
        if tag in INLINE:
            # kept on the stack where it matters which closing tag is whose: in and below inline elements that are set apart
            if skip or named or stack.inline:
                path = f"{above.path}/{tag}{name}" if named and len(stack) <= DEPTH else above.path
                stack.push(Node(tag, path, above.skip or skip, above.named or (path if named else None), above.inside, above.block))
            continue
        if stack[above.block].tag == "p":
            stack.drop(above.block)
        closes = CLOSES.get(tag)
        if closes and stack[-1].tag in closes:
            stack.drop(len(stack) - 1)
            if tag == "tr" and stack[-1].tag == "tr":
                stack.drop(len(stack) - 1)
        yield ("break",)
        above = stack[-1]
        whole = tag in ("html", "body", "article", "main")
        skip = above.skip or not whole and (skip or tag in BOILER_TAGS or tag == "header" and not stack.articles)
        # below DEPTH only the first article or main element has a path of its own
        deep = len(stack) > DEPTH and (stack.articles or tag not in ("article", "main"))
        path = above.path if deep else f"{above.path}/{tag}{name}"
        outer = None if whole else above.named or (path if named else None)  # what holds the article is no furniture
        stack.push(Node(tag, path, skip, outer, above.inside or path == main, len(stack)))
        if not deep:
            yield "open", path
    if at < len(page) and not stack[-1].skip:
        yield "text", stack[-1], page[at:]


def key_of(path: str, text: str = "") -> int:
    """A positive 64-bit number for a text node, or for an element's path alone."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def blocks(page: str, main: str | None, fixed: frozenset = frozenset(), furniture: frozenset | None = None) -> list[str]:
    """Texts of the blocks in the element ``main``, without fixed texts and furniture.

    furniture: keys of paths of the host's furniture; None: what is named so and has less than half of the page's text.
    """
    parts: list[tuple[str | None, str | None, bool]] = []  # text (None: break), element named as furniture, whether fixed
    size: dict[str | None, int] = {}
    for event in walk(page, main):
        if event[0] == "break":
            parts.append((None, None, False))
        elif event[0] == "text" and event[1].inside:
            node, text = event[1], event[2]
            bare = text.strip()
            size[node.named] = size.get(node.named, 0) + len(bare)
            parts.append((text, node.named, bool(fixed) and bare != "" and key_of(node.path, bare) | 1 in fixed))
    total = sum(size.values())
    if furniture is None:
        gone = {p for p, n in size.items() if p is not None and n < FURNITURE * total}
    else:
        gone = {p for p in size if p is not None and key_of(p) in furniture}
    found: list[tuple[str, bool]] = []  # blocks and whether all their text is fixed
    part, only_fixed = [], True
    for text, named, is_fixed in [*parts, (None, None, False)]:
        if text is not None:
            if named not in gone:
                part.append(text)
                only_fixed = only_fixed and (is_fixed or not text.strip())
        elif part:
            if joined := _SPACE.sub(" ", entities.unescape("".join(part))).strip():
                found.append((joined, only_fixed))
            part, only_fixed = [], True
    drop = 2 * sum(len(t) for t, f in found if f) <= sum(len(t) for t, _ in found)
    return [t for t, f in found if not (drop and f)]


def own_main(page: str) -> str:
    """Path of a page's first article, else main, else body element, else the whole page."""
    first: dict[str, str] = {}
    for event in walk(page):
        if event[0] == "open":
            tag = re.match(r"[^.#]*", event[1].rpartition("/")[2])[0]
            first.setdefault(tag, event[1])
    return first.get("article") or first.get("main") or first.get("body") or ""


def main_text(page: str | None, main: str | None, fixed: frozenset = frozenset(), furniture: frozenset | None = None) -> str:
    if not page:
        return ""
    found = blocks(page, main, fixed, furniture) if main else []
    return "\n".join(found or blocks(page, own_main(page)))


def _token_rows(batches):
    """Tokens of pages: host, path, text (key; 0 for elements), named (key of the furniture path or 0), vector (sum of page and
    count hashes), pages, chars, first places and times."""
    for b in batches:
        seen: dict[tuple, list[int]] = {}
        for host, key, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            count: dict[tuple, list[int]] = {("", 0, 0): [1, 0, 0]}
            for k, event in enumerate(walk(page or "")):
                if event[0] == "open":
                    token, chars = (event[1], 0, 0), 0
                elif event[0] == "text" and (text := event[2].strip()):
                    node = event[1]
                    token, chars = (node.path, key_of(node.path, text) | 1, key_of(node.named) if node.named else 0), len(text)
                else:
                    continue
                c = count.setdefault(token, [0, 0, k])
                c[0] += 1
                c[1] += chars
            for token, (n, chars, place) in count.items():
                h = xxhash.xxh64_intdigest(b"%d:%d" % (key, n)) >> 1
                got = seen.get(full := (host, *token))
                if got is None:
                    seen[full] = [h, 1, chars, place, place, place, n]
                else:
                    got[0] += h
                    got[1] += 1
                    got[2] += chars
                    got[3] += place
                    got[4] = min(got[4], place)
                    got[5] = max(got[5], place)
                    got[6] += n
        if seen:
            host, path, text, named = zip(*seen, strict=True)
            vector, *rest = zip(*seen.values(), strict=True)
            cols = [pa.array(host), pa.array(path), pa.array(text, pa.int64()), pa.array(named, pa.int64()), pa.array(map(Decimal, vector), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int64()) for x in rest]], ["host", "path", "text", "named", "vector", "pages", "chars", "place", "low", "high", "times"])


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select(host.alias("host"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("key"), F.col(html_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))


_TOKEN_SCHEMA = "host string, path string, text long, named long, vector decimal(38,0), pages long, chars long, place long, low long, high long, times long"


def _spread(d: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of a row a host, which is broadcast while it is small, so that no host's tokens meet in one task."""
    return d.join(bounded(small, BOUND), on, how)


def templates(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The hosts' templates and main slots.

    Templates: host, path, text (0 for elements), once (whether it stands once a page), class and parent: the number of its
    equivalence class and of the class that it lies in (null at the top). Main slots: host, main (the element path), fixed (keys of
    the template's texts in it), furniture (keys of paths).
    """
    small_batches(pages.sparkSession)
    keyed = _keyed(pages, id_col, url_col, html_col)
    tokens = cut(
        keyed.select("host", "key", "page")
        .mapInArrow(_token_rows, _TOKEN_SCHEMA)
        .groupBy("host", "path", "text", "named")
        .agg(*[f(c).cast(t).alias(c) for c, f, t in (("vector", F.sum, "decimal(38,0)"), *((c, f, "bigint") for c, f in (("pages", F.sum), ("chars", F.sum), ("place", F.sum), ("low", F.min), ("high", F.max), ("times", F.sum))))])
    )
    different = keyed.groupBy("host").agg(F.count_distinct(F.xxhash64("page")).alias("n")).where(F.col("n") >= MIN_PAGES).select("host")
    hosts = cut(tokens.where("path = '' and text = 0").select("host", F.col("pages").alias("of")).join(different, "host"))
    mine = _spread(tokens, hosts, ["host"])
    frequent = mine.where((F.col("pages") >= SUPPORT * F.col("of")) & (F.col("path") != "")).withColumn("mean", F.col("place") / F.col("pages"))
    line = W.partitionBy("host", "vector", "pages").orderBy("mean", "path", "text")
    ordered = frequent.withColumn("fits", (F.col("low") >= F.coalesce(F.lag("low").over(line), F.col("low"))) & (F.col("high") >= F.coalesce(F.lag("high").over(line), F.col("high"))))
    valid = ordered.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("size"), F.min("fits").alias("fits")).where("size > 1 and fits")
    steps = F.split("path", "/")
    above = lambda size: F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    parts = cut(
        frequent.join(valid, ["host", "vector", "pages"], "left_semi")
        .select("host", "path", "text", "named", (F.col("times") == F.col("pages")).alias("once"), F.xxhash64("vector", "pages").alias("class"))
    )
    elements = parts.where("text = 0").select("host", "path", "class")
    tops = parts.groupBy("host", "class").agg(F.min(F.struct(F.size(steps).alias("depth"), "path")).alias("top")).select("host", "class", "top.path", "top.depth").where("depth > 1")
    over = tops.select("host", F.col("class").alias("lower"), F.explode(above(F.size(steps) - 1)).alias("path")).where("path != ''")
    parents = over.join(elements, ["host", "path"]).where(F.col("class") != F.col("lower")).groupBy("host", F.col("lower").alias("class")).agg(F.max_by("class", F.length("path")).alias("parent"))
    template = parts.join(parents, ["host", "class"], "left")

    remains = mine.where("text != 0").join(parts, ["host", "path", "text", "named"], "left_anti").groupBy("host", "path", "named").agg(F.sum("chars").alias("chars"))
    remains = cut(remains)
    all_ = remains.groupBy("host").agg(F.sum("chars").alias("all"))
    furniture = cut(_spread(remains.where("named != 0").groupBy("host", "named").agg(F.sum("chars").alias("chars")), all_, ["host"]).where(F.col("chars") < FURNITURE * F.col("all")).select("host", "named"))
    slots = remains.join(furniture, ["host", "named"], "left_anti")
    covered = slots.select("host", F.explode(above(F.size(steps))).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    total = covered.where("path = ''").select("host", F.col("chars").alias("total"))
    main = (
        _spread(covered, total, ["host"])
        .where(F.col("chars") >= COVER * F.col("total"))
        .join(parts.where("text = 0 and once").select("host", "path"), ["host", "path"], "left_semi")
        .where(~F.regexp_extract("path", "/([^/.#]*)[^/]*$", 1).isin(LEAVES))
        .groupBy("host")
        .agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), "chars", "path")).alias("main"))
        .select("host", F.coalesce(F.nullif(F.regexp_extract("main", "^(.*?/(?:article|main)(?:[.#][^/]*)?)(?:/|$)", 1), F.lit("")), F.col("main")).alias("main"))
        .where("main != ''")
    )
    texts = _spread(parts.where("text != 0"), main, ["host"]).where((F.col("path") == F.col("main")) | F.col("path").startswith(F.concat("main", F.lit("/"))))
    fixed = texts.groupBy("host").agg(F.collect_set("text").alias("fixed"))
    named = furniture.groupBy("host").agg(F.collect_set("named").alias("furniture"))
    none = F.array().cast("array<bigint>")
    main = main.join(fixed, "host", "left").join(named, "host", "left").select("host", "main", F.coalesce("fixed", none).alias("fixed"), F.coalesce("furniture", none).alias("furniture"))
    return template, main


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text (blocks joined by a line feed), n_chars long, main (the element path used) for every page."""
    _, main = templates(pages, id_col=id_col, url_col=url_col, html_col=html_col)
    main = cut(main)
    held = main.agg(F.coalesce(F.sum(F.size("fixed") + F.size("furniture") + 1), F.lit(0))).first()[0]
    keyed = _keyed(pages, id_col, url_col, html_col).join(F.broadcast(main) if held <= BOUND else main, "host", "left").select("id", "url", "main", "page", "fixed", "furniture")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = zip(*(part.column(i).to_pylist() for i in (3, 2, 4, 5)), strict=True)
                texts = [main_text(page, path, frozenset(fixed or ()), None if furniture is None else frozenset(furniture)) for page, path, fixed, furniture in rows]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), part.column(2)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars", "main"])

    kind = {f.name: f.dataType.simpleString() for f in keyed.schema}
    out = keyed.mapInArrow(run, f"id {kind['id']}, url {kind['url']}, text string, n_chars long, main string")
    return out.toDF(id_col, url_col, "text", "n_chars", "main")
