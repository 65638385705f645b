"""Main text of web pages by deducing each host's template.

Pages of a host come from a template filled with content. Each token, an element told apart by its
path of open elements or a text at such a path, has an occurrence vector: how often each page of the
host holds it. Tokens with the same vector form an equivalence class. A class is valid when it covers
most pages of its host, its tokens stand once on each of them and always in the same order, and it
nests: all tokens of another class that meet its own lie in one gap between neighbouring tokens.

The gaps of the valid classes, nested in each other, are the slots of the template. A slot tells
by what the host's pages hold in it whether it is content: whether its texts vary from page to page
and are prose rather than links. Names of elements and words in class, id and role are a prior that
settles only what the slots leave open.

Vectors are never gathered: a sum of hashes of (page, count) stands for a vector, so one
combining aggregate per (host, token) finds the classes of a host of any size; order, nesting and
slots are combining aggregates as well. The pages are read four times, and no step but a join with
the templates, salted for hot hosts, moves them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import staged
from polderlake.operators.joins import skew_safe_join

MIN_SUPPORT = 0.8  # share of a host's pages that a template token is on
MIN_PAGES = 3  # a host of fewer pages has no template of its own
MIN_CLASS = 2  # tokens of a class; an element counts as its start and its end
MIN_VARIED = 0.1  # share of a slot's texts, less one, that differ, in a slot that varies
MAX_LINKED = 0.5  # share of a slot's characters in links, in a slot of prose
OUTSIDE = 0.25  # varying prose outside the article counts from this share of the host's largest slot
MAX_DEPTH = 64  # deeper paths are told apart by their last elements
KEPT = 400  # tags, so long in all, whose elements are kept from page to page for a template
KEPT_CHARS = 1 << 16
MENU = 3  # so many neighbouring blocks of links only are a menu, where no template says more

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no prose.
RAW = frozenset("script style noscript template iframe object svg canvas select option "
                "textarea button title head".split())
#: Raw elements that only their own end tag ends.
CLOSED_BY_NAME = frozenset("script style textarea title noscript iframe".split())
#: Elements that frame a page or serve it.
FRAME = frozenset("nav header footer aside form menu dialog".split())
CONTENT = frozenset("article main".split())
#: Elements that are never judged by their class words.
UNJUDGED = frozenset("html body main h1".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
                  "li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening block of the keyed kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: Words of class, id and role for what is never the article's text.
APART = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie "
    "cookies consent gdpr menu nav navbar navigation breadcrumb breadcrumbs sidebar widget comment comments "
    "commentlist replies reply respond discussion disqus share sharing related recommended recommendations "
    "newsletter subscribe signup login search popup modal pagination pager masthead complementary "
    "contentinfo hidden".split())
#: A class of an article that begins so marks a reader's.
COMMENT = frozenset("comment comments reply replies".split())
#: Words that also name parts of articles: what stands in such an element decides.
DOUBTFUL = frozenset(
    "banner notice alert side header footer social toolbar overlay copyright legal disclaimer skip tag "
    "tags toc dialog".split())
#: A class that begins so says what is not there.
ABSENT = frozenset("no not has with without".split())

# Quotes count after an equals sign only, and no part is scanned again after a failure.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(
    r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)"""
    r"""(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
NO_MARK = re.compile(r"[\d#>/]+")  # digits, and what sets off paths, texts and ends
WORD = re.compile(r"[a-z]+")

class Node:
    """An element at a path, with what its ancestors and it say about the texts in it.

    ``judge`` is the innermost of them with a class, id or role that stands in an article and is a
    template token. Equal elements of a page are one node, so that a deep page makes few.
    """

    __slots__ = ("name", "path", "depth", "raw", "apart", "doubtful", "inside", "framed", "linked",
                 "marked", "judge", "block", "counts", "begin", "end", "kids")

    def __init__(self, name: str, path: str, mark: int, named: bool, parent: Node | None, known):
        self.name, self.path, self.kids = name, path, {}
        self.depth = (parent.depth + 1) % MAX_DEPTH if parent else 0
        self.raw = name in RAW or parent is not None and parent.raw
        self.apart = mark == 2 or parent is not None and parent.apart
        self.doubtful = mark == 1 or parent is not None and parent.doubtful
        within = parent is not None and parent.inside
        self.inside = name in CONTENT or within
        self.linked = name == "a" or parent is not None and parent.linked
        # A frame around the article does not frame it, and an article's header is its own.
        self.framed = name not in CONTENT and (
            parent is not None and parent.framed or name in FRAME and not (name == "header" and within))
        self.marked = within and (named or parent.marked)
        self.judge = path if within and named and path in known else parent.judge if within else ""
        self.block = name in BLOCK
        # Of an article only texts in marked elements can be tokens, others are its own.
        self.counts = not self.raw and (not self.inside or self.marked)
        # The template tokens that its start and its end are.
        self.begin, self.end = (path, path + ">") if path in known else ("", "")

    def state(self) -> tuple:
        return (self.path, self.depth, self.raw, self.apart, self.doubtful, self.inside, self.framed,
                self.linked, self.marked, self.judge)


def _label(name: str, attributes: str) -> tuple[str, int, bool]:
    """Name with class and id, digits left out; 2 if they mark other than content, 1 if they may; if any."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return name, 0, False
    marks, mark = [], 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for part in value.split():
                words = WORD.findall(part)
                if not words or words[0] in ABSENT or name in UNJUDGED:
                    continue
                if name == "article":
                    mark = 2 if words[0] in COMMENT else mark
                else:
                    mark = max(mark, 2 if not APART.isdisjoint(words) else
                               1 if not DOUBTFUL.isdisjoint(words) else 0)
            marks.append(SPACE.sub(" ", NO_MARK.sub("", value)).strip())
        elif (key == "hidden" or key == "aria-hidden" and value == "true"
              or key == "style" and UNSEEN.search(value)):
            mark = 2
    named = any(marks)
    return (name + "." + ".".join(marks) if named else name), mark, named


class Tag(NamedTuple):
    """What a tag says wherever it stands."""

    ending: bool
    name: str
    label: str
    mark: int
    named: bool
    closes: set
    closes_p: bool
    single: bool
    closer: re.Pattern | None  # of a raw element

    @classmethod
    def read(cls, ending: str, name: str, attributes: str) -> Tag:
        name = name.lower()
        if ending:
            return cls(True, name, "", 0, False, set(), False, False, None)
        closer = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) if name in CLOSED_BY_NAME else None
        return cls(False, name, *_label(name, attributes), CLOSES.get(name, set()), name in CLOSES_P,
                   name in VOID or attributes.endswith("/") and name not in BLOCK, closer)


class Elements:
    """The elements that pages of a template hold, kept from page to page while they are few.

    ``known`` are the paths of template tokens.
    """

    def __init__(self, known=frozenset()):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.top = Node("", "", 0, False, None, self.known)
        self.nodes: dict[tuple, Node] = {}
        self.tags: dict[str, Tag] = {}
        self.kids = self.chars = 0

    def start(self) -> Node:
        if self.kids > KEPT or self.chars > KEPT_CHARS:
            self.clear()
        return self.top

    def kid(self, parent: Node, whole: str, tag: Tag) -> Node:
        path = ("" if parent.depth == MAX_DEPTH - 1 else parent.path) + "/" + tag.label
        node = Node(tag.name, path, tag.mark, tag.named, parent, self.known)
        node = parent.kids[whole] = self.nodes.setdefault(node.state(), node)
        self.kids += 1
        self.chars += len(whole)
        return node


def events(page: str, known=frozenset(), elements: Elements | None = None) -> Iterator[tuple[str, str, Node]]:
    """("open" | "close", path, element) and ("text", text, innermost open element) in page order.

    Every element that is opened is closed, at the end of the page at the latest; void elements
    and raw ones, whose text is passed over, are closed at once. ``known`` are the paths of template
    tokens; ``elements`` of earlier pages with the same tokens may be given. The time is in proportion
    to the page.
    """
    elements = elements or Elements(known)
    top = elements.start()
    tags = elements.tags
    stack = [top]
    held: dict[str, int] = {}  # open elements by name
    at, end = 0, len(page)
    while at < end:
        for m in TOKEN.finditer(page, at):
            begin, after = m.span()
            if begin > at:
                yield "text", page[at:begin], top
            at = after
            if m.lastindex is None:
                continue
            whole = m.group()
            tag = tags.get(whole)
            if tag is None:
                tag = tags[whole] = Tag.read(*m.groups())
                elements.kids += 1
                elements.chars += len(whole)
            ending, name, _, _, _, closes, closes_p, single, closer = tag
            if ending:
                if held.get(name):
                    while True:
                        node = stack.pop()
                        held[node.name] -= 1
                        yield "close", node.path, node
                        if node.name == name:
                            break
                    top = stack[-1]
                continue
            while top.name in closes or closes_p and top.name == "p":
                stack.pop()
                held[top.name] -= 1
                yield "close", top.path, top
                top = stack[-1]
            node = top.kids.get(whole) or elements.kid(top, whole, tag)
            yield "open", node.path, node
            if single:
                yield "close", node.path, node
            elif closer:
                close = closer.search(page, at)
                at = close.end() if close else end
                yield "close", node.path, node
                break
            else:
                stack.append(node)
                top = node
                held[name] = held.get(name, 0) + 1
        else:
            if at < end:
                yield "text", page[at:], top
            break
    while len(stack) > 1:
        node = stack.pop()
        yield "close", node.path, node


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", (url or "").strip(), re.I)
    return m.group(1).lower() if m else ""


def _host(column: str = "url"):
    """``host_of`` as an expression."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(column), F.lit(""))),
                                    r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def text_token(text: str, node: Node) -> str:
    """A text as a token, told apart by the path it stands at."""
    return f"{node.path}#{xxhash.xxh64_hexdigest(' '.join(text.split()))}"


def token_counts(page: str, elements: Elements | None = None) -> dict[str, int]:
    """How often the page holds each element and each text that can be a token."""
    counts: dict[str, int] = {}
    for kind, value, node in events(page, elements=elements):
        if kind == "open":
            counts[value] = counts.get(value, 0) + 1
        elif kind == "text" and node.counts and not value.isspace():
            token = text_token(value, node)
            counts[token] = counts.get(token, 0) + 1
    return counts


def template_tokens(page: str, template: Template) -> Iterator[tuple[str, str, str, Node]]:
    """The events of a page, each with the template token it is, "" if none; the end of an element is
    its path and ">"."""
    known = template.classes
    for kind, value, node in events(page, known, template.elements):
        if kind == "open":
            yield kind, value, node.begin, node
        elif kind == "close":
            yield kind, value, node.end, node
        else:
            token = text_token(value, node) if known and node.counts and not value.isspace() else ""
            yield kind, value, token if token in known else "", node


class Slots:
    """The slot a page is in, while its template tokens go by.

    A class is open from its first to its last token; a slot is named by the last token of the
    innermost open class. Of two classes that interleave the one on fewer pages is ``out`` for
    the rest of the page, of equal ones that of the smaller vector.
    """

    def __init__(self, template: Template):
        self.template, self.open, self.left, self.out = template, [], {}, set()

    @property
    def slot(self) -> str:
        return self.open[-1][1] if self.open else ""

    def meet(self, token: str) -> None:
        group = self.template.group(token)
        if group in self.out:
            return
        if group not in self.left:
            self.left[group] = self.template.sizes[group]
            self.open.append((group, token))
        else:
            at = next(i for i in reversed(range(len(self.open))) if self.open[i][0] == group)
            above = [g for g, _ in self.open[at + 1:]]
            lost = [group] if any(self._rank(g) > self._rank(group) for g in above) else above
            for g in lost:
                self.out.add(g)
                del self.left[g]
            self.open = [x for x in self.open if x[0] not in self.out] if lost else self.open
            if group in self.out:
                return
            self.open[-1] = (group, token)
        self.left[group] -= 1
        if not self.left[group]:
            self.open.pop()
            del self.left[group]

    def _rank(self, group: str) -> tuple[int, str]:
        return self.template.support[group], group


def _vectors(pages: DataFrame) -> DataFrame:
    """Per task and (host, token): pages with it, pages that hold it once, the vector's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements = Elements()
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                host = host_of(url)
                hashes: dict[int, int] = {}
                for token, n in token_counts(page or "", elements).items():
                    entry = seen.setdefault((host, token), [0, 0, 0])
                    if n not in hashes:
                        hashes[n] = xxhash.xxh64_intdigest(f"{page_id} {n}")
                    entry[0] += 1
                    entry[1] += n == 1
                    entry[2] = (entry[2] + hashes[n]) % 2 ** 61
            yield _batch(((h, t, *e) for (h, t), e in seen.items()), VECTORS)

    return pages.select("page_id", "url", "html").mapInArrow(run, VECTORS).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("once").alias("once"),
        F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"))


VECTORS = "host string, token string, pages long, once long, vector long"
CHECKS = "host string, class string, low long, high long, crossed long"
TEXTS = "host string, slot string, text long, chars long, linked long, pages long"


def _batch(rows, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    kinds = [pa.string() if k == "string" else pa.int64() for k in kinds]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


class Template(NamedTuple):
    """Class of each token (an element's start is its path), tokens of each class, and what slots say."""

    classes: dict[str, str]
    sizes: dict[str, int]
    support: dict[str, int]
    slots: dict[str, str]  # "prose", "links" or "same"; slots without text are left out
    elements: Elements | None = None  # of the pages read with it

    @classmethod
    def read(cls, tokens: str | None, slots: str | None = None) -> Template:
        classes, sizes, support = {}, Counter(), {}
        for line in (tokens or "").split("\n") if tokens else ():
            group, pages, token = line.split("\t")
            classes[token], support[group] = group, int(pages)
            sizes[group] += 1 if "#" in token else 2
        said = dict(reversed(line.split("\t")) for line in slots.split("\n")) if slots else {}
        return cls(classes, sizes, support, said, Elements(classes))

    def group(self, token: str) -> str:
        return self.classes[token.removesuffix(">")]


def _with(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with their host's columns of ``known``; hot hosts are salted where it is too large to broadcast."""
    return skew_safe_join(pages.select("page_id", "url", "html", _host().alias("host")), known, ["host"])


class _Templates:
    """Templates as read from their rows, kept for the pages that follow in a task."""

    def __init__(self):
        self.read: dict[tuple, Template] = {}

    def __call__(self, *key: str | None) -> Template:
        if key not in self.read:
            if len(self.read) > 1_000:
                self.read.clear()
            self.read[key] = Template.read(*key)
        return self.read[key]


def check_page(page: str, template: Template) -> list[tuple[str, int, int]]:
    """Per class on the page: a hash of the order of its tokens, and whether it gave way to another."""
    order: dict[str, xxhash.xxh64] = {}
    slots = Slots(template)
    for _, _, token, _ in template_tokens(page, template):
        if token:
            order.setdefault(template.group(token), xxhash.xxh64()).update(token + "\n")
            slots.meet(token)
    return [(g, h.intdigest() >> 1, int(g in slots.out)) for g, h in order.items()]


def _checks(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, class`` of classes whose tokens change their order, or that interleave with a larger one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates()
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, page, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                for group, order, crossed in check_page(page or "", templates(tokens)):
                    entry = seen.setdefault((host, group), [order, order, 0])
                    entry[:] = min(entry[0], order), max(entry[1], order), entry[2] + crossed
            yield _batch(((h, g, *e) for (h, g), e in seen.items()), CHECKS)

    checked = _with(pages, classes).where("tokens IS NOT NULL").select("host", "html", "tokens").mapInArrow(
        run, CHECKS)
    return checked.groupBy("host", "class").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("crossed").alias("crossed")).where(
        "low != high OR crossed > 0").select("host", "class")


def slot_texts(page: str, template: Template) -> dict[str, list]:
    """Per slot of a page that holds text: the text, its characters, and those of them in links.

    Raw elements do not count, nor do texts that are tokens themselves.
    """
    found: dict[str, list] = {}
    slots = Slots(template)
    for kind, value, token, node in template_tokens(page, template):
        if token:
            slots.meet(token)
        elif kind == "text" and not value.isspace() and not node.raw:
            entry = found.setdefault(slots.slot, [xxhash.xxh64(), 0, 0])
            text = " ".join(value.split())
            entry[0].update(text + "\n")
            entry[1] += len(text)
            entry[2] += len(text) if node.linked else 0
    return found


def _slots(spark: SparkSession, pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, slots``: what each host's slots say, one line for each slot with text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates()
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for host, page, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                for slot, (text, chars, linked) in slot_texts(page or "", templates(tokens)).items():
                    entry = seen.setdefault((host, slot, text.intdigest() >> 1), [0, 0, 0])
                    entry[:] = entry[0] + chars, entry[1] + linked, entry[2] + 1
            yield _batch(((*k, *e) for k, e in seen.items()), TEXTS)

    texts = _with(pages, classes).where("tokens IS NOT NULL").select("host", "html", "tokens").mapInArrow(
        run, TEXTS)
    sums = [F.sum(c).alias(c) for c in ("chars", "linked", "pages")]
    slots = staged(spark, texts.groupBy("host", "slot", "text").agg(*sums).groupBy("host", "slot").agg(
        *sums, F.count(F.lit(1)).alias("texts")), "slot-texts")
    prose = F.expr("chars - linked")
    largest = slots.groupBy("host").agg(F.max(F.struct(prose.alias("prose"), "slot")).alias("top"))
    varies = (F.col("slot") == F.col("top.slot")) | (
        (F.col("texts") > 1) & (F.col("texts") - 1 >= MIN_VARIED * (F.col("pages") - 1)))
    said = (F.when(F.col("linked") > MAX_LINKED * F.col("chars"), "links").when(~varies, "same")
            .when(prose >= OUTSIDE * F.col("top.prose"), "main").otherwise("prose"))
    return slots.join(largest, "host").groupBy("host").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(said, F.lit("\t"), "slot"))), "\n").alias("slots"))


def _classes(lines: DataFrame) -> DataFrame:
    """``host, tokens``: a line of class, pages and token for each template token of a host."""
    line = F.concat_ws("\t", "class", F.col("pages").cast("string"), "token")
    return lines.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("tokens"))


def deduce(spark: SparkSession, pages: DataFrame, min_support: float = MIN_SUPPORT,
           min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, tokens, slots``: each host's template, as ``Template.read`` takes it.

    Hosts of fewer than ``min_pages`` rows and those without a valid class have no row. Null and empty
    pages count as pages without tokens; repeated rows count each; an empty table gives no rows.
    Tokens are bounded by the markup of a page, as each is on most pages of its host.
    """
    size = pages.groupBy(_host().alias("host")).agg(F.count(F.lit(1)).alias("all_pages"))
    often = _vectors(pages).join(size, "host").where(
        (F.col("all_pages") >= min_pages) & (F.col("pages") >= min_support * F.col("all_pages"))
        & (F.col("once") == F.col("pages")))
    tokens = F.when(F.col("token").contains("#"), 1).otherwise(2)
    grown = often.withColumn("class", F.col("vector").cast("string"))
    valid = grown.groupBy("host", "class").agg(F.sum(tokens).alias("tokens")).where(
        F.col("tokens") >= MIN_CLASS).select("host", "class")
    lines = staged(spark, grown.join(valid, ["host", "class"]).select("host", "class", "pages", "token"),
                   "template-classes")
    bad = _checks(pages, staged(spark, _classes(lines), "template-candidates"))
    kept = staged(spark, _classes(lines.join(bad, ["host", "class"], "left_anti")), "template-tokens")
    return staged(spark, kept.join(_slots(spark, pages, kept), "host", "left"), "template-slots")


def templates(pages: DataFrame, min_support: float = MIN_SUPPORT,
              min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, tokens``: the tokens of each host's template in order of their names, as ``deduce`` finds them."""
    token = F.transform(F.split("tokens", "\n"), lambda x: F.element_at(F.split(x, "\t"), 3))
    return deduce(pages.sparkSession, pages, min_support, min_pages).select(
        "host", F.array_sort(token).alias("tokens"))


NOTHING = Template({}, {}, {}, {}, Elements())


def main_text(page: str | None, template: Template | frozenset = NOTHING) -> str:
    """The text of the content slots of a page; null and empty pages give an empty text.

    Dropped are raw and frame elements and those marked as apart from the article. Of the rest:

    - In an article or main element a text stays, unless the innermost marked element that is a template
      token holds no text of its own: all its texts are tokens, or stand in slots that do not vary.
    - Outside, a text goes that is a token itself, or stands in a slot of links or one that does not vary.
      On a page with an article, what is left outside stays only where its slot varies and holds a good
      share of the host's prose.
    - An element whose class may or may not mark content is judged by the slot: varying prose stays. Where
      the host has no template, it stays in an article only.

    Pages of hosts without a template and without an article lose runs of blocks that are links only.
    """
    if not page:
        return ""
    template = template or NOTHING
    blocks: list[tuple[list[tuple[str, str]], bool, bool, bool]] = []  # pieces, inside, main, links only
    pieces: list[tuple[str, str]] = []  # with the element that judges them, inside an article
    own: set[str] = set()  # such elements with texts of their own
    inside = main = False
    prose = 0
    slots = Slots(template)

    def flush():
        nonlocal pieces, prose
        if pieces:
            blocks.append((pieces, inside, main, prose == 0))
        pieces, prose = [], 0

    for kind, value, token, node in template_tokens(page, template):
        if token:
            slots.meet(token)
        if kind != "text":
            if node.block:
                flush()
            continue
        now = node.inside
        if node.raw or node.framed or node.apart:
            continue
        said = template.slots.get(slots.slot, "same" if template.classes else "")
        varying = not token and said in ("prose", "main")
        judge = ""
        if value.isspace():
            if not pieces:
                continue
        elif now:
            if node.doubtful and template.classes and not varying:
                continue
            judge = node.judge
            if judge and not token and said != "same":
                own.add(judge)
        elif token or said in ("links", "same") or node.doubtful and not varying:
            continue
        if now != inside or not now and (said == "main") != main:
            flush()
            inside, main = now, not now and said == "main"
        pieces.append((html.unescape(value), judge if now else ""))
        prose += 0 if node.linked else len(value.strip())
    flush()
    if any(b[1] for b in blocks):
        chosen = [b[0] for b in blocks if b[1] or b[2]]
    elif template.classes:
        chosen = [b[0] for b in blocks]
    else:
        chosen, run = [], []
        for b in [*blocks, ([], False, False, False)]:
            if b[3]:
                run.append(b[0])
                continue
            chosen += run if len(run) < MENU else []
            run = []
            chosen.append(b[0])
    lines = (" ".join("".join(t for t, judge in b if not judge or judge in own).split()) for b in chosen)
    return "\n".join(line for line in lines if line)


def extract(spark: SparkSession, pages: DataFrame, min_support: float = MIN_SUPPORT,
            min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages give an empty text. Character references are decoded, white space in
    a block becomes one space, blocks are joined by one line feed in page order. Pages without
    a host share the template of the empty host. Repeated rows give repeated rows; other
    columns are not read. A template has only tokens of most of a host's pages, so what a page
    task loads for a host is bounded by the markup of a page.
    """
    pages = pages.select("page_id", "url", "html")
    joined = _with(pages, deduce(spark, pages, min_support, min_pages)).select(
        "page_id", "url", "html", "tokens", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates()
        for batch in batches:
            texts = [main_text(page, known(tokens, slots))
                     for page, tokens, slots in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
