"""Main text of web pages by template deduction over the pages of a host.

A page is a row of tokens: start tags by the path of open elements, and blocks of words by path and
words. Tokens of a host with the same occurrence vector (how often on each page) are an equivalence
class. Vectors are compared by sums over pages of hashes of (page, count), so they are aggregated
like any sum, and a host of any size is no single task.

The tokens on at least nine tenths of the pages, tags once on each, are the root of the template;
pages without tokens do not count, so error pages and cut pages do not undo it. A class on at least
half of the pages is nested in it where a tag of the class stands around a block of the class: that
part comes and goes as a whole, as an advert or a notice does. Text that copies of a page share has
no tag of its own and is no template. What is left between template tokens are the slots.

On every page, blocks of the template are dropped (of an article of which nothing else would be
left, none). Tags, roles and names are further marks of what is no main text. The main slot is the
article, else the main element, else the root gap that holds most words on the pages of the host;
an article that holds less than a fourth of the words of one slot outside is a teaser, and a gap apart
from the article that holds more words goes before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.common import arrow, stored

LEAST_PAGES = 8  # pages of a host below which nothing is taken for a template
ROOT_SHARE = 0.9  # pages of the host on which a root token occurs
SHARE = 0.5  # pages of the host on which a nested class occurs
TEASER = 4  # how many times an article's words a slot outside must hold to go before it
TEMPLATE_BYTES = 16 << 20  # templates that go to every executor; larger ones are joined by host
SALTS = 64  # keys over which the rows of a host are dealt in a join
ROOM = 400_000  # tokens that a task holds

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
SLOTS = frozenset("article aside blockquote body center details div dl figure main ol section table td ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# What is no main text, by tag, role and name
OTHER_TAGS = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe object svg canvas dialog menu search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OTHER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments reply replies respond disqus discussion social share sharing related recommended recommendations widget copyright pagination pager skip cmt cmts".split())
# words that mark a part only where the rest of the name tells of layout; else its links decide ("related-work")
WEAK_NAMES = frozenset("related recommended recommendations social share sharing discussion notice notices alert promotion banner rail widget response".split())
LAYOUT = frozenset("area articles bar block blocks body bottom box button buttons card cards center col column container content count feed fixed footer form grid group head header heading hero icon icons inner item items large left link links list main media mobile module news outer pane panel page post posts primary right row secondary section side site slot small sticky stories strip text title tool tools top unit wrap wrapper zone".split())
GLUED = re.compile(r"(ads?|advert|promo|sponsor|cookies?|nav|comments?|cmts?|share|social|related)(area|bar|banner|block|box|buttons|container|links|list|posts|section|slot|space|unit|wrap|wrapper|zone)")
AROUND = frozenset("sidebar rail menu nav widget banner footer".split())  # names that may stand around a whole layout
HEADERS = frozenset(("header", "topbar"))
WHOLE_PAGE = frozenset(("html", "body", "main"))  # their names tell about the page, not about a part of it

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ABOUT = re.compile(r"(?<![^\s])(?:has|with|without|no|is|layout|theme|template)[-_][^\s]*")  # "has-sidebar" is no sidebar


@dataclass(slots=True)
class Element:
    name: str
    path: str
    other: bool  # no main text below
    soft: bool  # marked by a name that may stand around a whole layout
    around: bool  # an article or main element, or what is in it, below such a name
    weak: int  # the element above whose links decide, 0 for none
    link: bool
    main: int  # 0 none, 1 main element, 2 article


@dataclass(slots=True)
class Block:
    path: str
    main: int
    other: bool
    around: bool = False
    weak: int = 0
    linked: int = 0  # words in links
    parts: list[str] = field(default_factory=list)

    def words(self) -> list[str]:
        return "".join(self.parts).split()


@lru_cache(maxsize=4096)
def _named(names: str) -> tuple[bool, bool, bool, bool]:
    """What class and id say: (no main text, only by a name of layout, only with its links, page header)."""
    other = soft = weak = header = False
    for name in _ABOUT.sub(" ", _CAMEL.sub("-", names).lower()).split():
        parts = _NAME.findall(name)
        marks = {x for x in parts if x in OTHER_NAMES or GLUED.fullmatch(x)}
        header |= bool(HEADERS.intersection(parts))
        if not marks:
            continue
        if marks <= WEAK_NAMES and not all(x in marks or x in LAYOUT for x in parts):
            weak = True
            continue
        soft |= marks <= AROUND
        other |= not marks <= AROUND
    return other, soft and not other, weak and not other and not soft, header


def _element(name: str, attributes: str, parent: Element, number: int) -> Element:
    values = {}
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            values.setdefault(key.lower(), unescape(a or b or c))
    label = (values.get("class") or values.get("id") or "").lower()
    role = values.get("role", "").lower()
    main = 2 if name == "article" else 1 if name == "main" or role == "main" else 0
    other, soft, weak, header = (False,) * 4 if name in WHOLE_PAGE or not label else _named(f"{values.get('class', '')} {values.get('id', '')}")
    other |= (parent.other or name in OTHER_TAGS or role in OTHER_ROLES or "hidden" in values
              or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").lower().replace(" ", ""))
    inside = max(parent.main, main)
    if not inside and (name == "header" or header):
        other = True
    around = parent.around
    if parent.soft:
        if main > parent.main and not soft:
            around = True
        else:
            soft = True
    path = f"{parent.path}/{name}.{label}" if label else f"{parent.path}/{name}"
    return Element(name, path, other, soft, around, parent.weak or (number if weak else 0), parent.link or name == "a", inside)


def read(html: str | None) -> tuple[list[str], list[Block]]:
    """(paths of start tags, blocks of text in page order) of a page."""
    text = html or ""
    stack = [Element("", "", False, False, False, 0, False, 0)]
    tags: list[str] = []
    blocks: list[Block] = []
    block: Block | None = None

    def say(part: str) -> None:
        nonlocal block
        if not part:
            return
        top = stack[-1]
        other = top.other or top.soft
        if block is None or (block.other, block.main, block.around, block.weak) != (other, top.main, top.around, top.weak):
            block = Block(top.path, top.main, other, top.around, top.weak)
            blocks.append(block)
        block.parts.append(unescape(part) if "&" in part else part)
        if top.link:
            block.linked += len(part.split())

    at = 0
    while at < len(text):
        found = _TAG.search(text, at)
        if not found:
            say(text[at:])
            break
        say(text[at:found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        end = bool(found[1] or found[4])
        if name in BLOCKS:
            block = None
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        closes = CLOSES.get(name) or (("p",) if name in CLOSES_P else ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in closes:
                del stack[i:]
                break
            if stack[i].name in ("ul", "ol", "dl", "table", "article", "section", "div", "body"):
                break
        element = _element(name, found[3] or found[6] or "", stack[-1], len(tags) + 1)
        tags.append(element.path)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(text, at)
            at = close.start() if close else len(text)
            stack.append(element)
            continue
        stack.append(element)
    _settle(blocks)
    return tags, blocks


def _settle(blocks: list[Block]) -> None:
    """Marks parts of weak names that are mostly links, and articles in a sidebar unless the page holds no other text."""
    words, linked = Counter(), Counter()
    for b in blocks:
        if b.weak:
            words[b.weak] += len(b.words())
            linked[b.weak] += b.linked
    for b in blocks:
        b.other |= 2 * linked[b.weak] >= words[b.weak] > 0
    if any(b.around for b in blocks) and any(not b.other and not b.around and b.words() for b in blocks):
        for b in blocks:
            b.other |= b.around


def _code(path: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{value}".encode("utf-8", "surrogatepass")) - (1 << 63)


def block_code(path: str, words: list[str]) -> int:
    return _code(path, "\1" + " ".join(words))


def _vector(page: int, count: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(f"{page} {count}")
    return h & 0x7FFFFFFF, h >> 33


class _Host:
    """What a task has seen of a host: page sums, and the sums of tags and of blocks."""

    def __init__(self):
        self.pages = 0
        self.sums = [0, 0]
        self.tags: dict[str, list[int]] = {}
        self.blocks: dict[tuple[str, int], list[int]] = {}
        self.mass: Counter = Counter()

    def add(self, page: int, html: str | None) -> None:
        tags, blocks = read(html)
        said: list[tuple[str, int]] = []
        empty = not tags
        for b in blocks:
            words = b.words()
            if not words:
                continue
            empty = False
            if not b.other:
                self.mass[b.path] += len(words)
                said.append((b.path, block_code(b.path, words)))
        if empty:
            return
        one = _vector(page, 1)
        self.sums = [self.sums[0] + one[0], self.sums[1] + one[1]]
        for held, seen in ((self.tags, tags), (self.blocks, said)):
            for key, n in Counter(seen).items():
                a, b = _vector(page, n)
                sums = held.setdefault(key, [0, 0, 0, 0])
                for i, x in enumerate((a, b, 1, n)):
                    sums[i] += x
        self.pages += 1


_SUMS = "host string, token bigint, kind int, path string, a bigint, b bigint, pages bigint, n bigint"


def token_sums(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, token, kind, path, a, b, pages, n): occurrence sums of every start tag and of every block that may be main text.

    kind 0 is the host itself, 1 a start tag, 2 a block, 3 the words of a path.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, _Host] = {}

        def flush() -> pa.RecordBatch:
            rows = []
            for name, h in hosts.items():
                rows.append((name, 0, 0, "", *h.sums, h.pages, h.pages))
                rows += [(name, _code(p, "<"), 1, p, *v) for p, v in h.tags.items()]
                rows += [(name, t, 2, p, *v) for (p, t), v in h.blocks.items()]
                rows += [(name, _code(p, "\0"), 3, p, 0, 0, 0, n) for p, n in h.mass.items()]
            hosts.clear()
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            columns = list(zip(*rows)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "token", "kind", "path", "a", "b", "pages", "n"])

        for batch in batches:
            for i in range(len(batch)):
                hosts.setdefault(batch.column(0)[i].as_py() or "", _Host()).add(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if i % 500 == 499 and sum(len(h.tags) + len(h.blocks) for h in hosts.values()) > ROOM:
                    yield flush()
            if sum(len(h.tags) + len(h.blocks) for h in hosts.values()) > ROOM:
                yield flush()
        yield flush()

    # the page hash tells pages apart inside a vector; equal pages count as one kind of page
    sums = arrow(pages.select(host, F.xxhash64(html, "__url").alias("__page"), html), run, _SUMS)
    return sums.groupBy("host", "token", "kind", "path").agg(*[F.sum(c).alias(c) for c in ("a", "b", "pages", "n")])


def templates(sums: DataFrame) -> DataFrame:
    """(host, root, nested, gap) per host: blocks of the root, blocks of nested classes, path of the main gap.

    Only blocks in a valid class come here, so a row is as large as the template of its host.
    """
    host = sums.where("kind = 0").select(F.col("host").alias("h"), F.col("pages").alias("hp")).where(F.col("hp") >= LEAST_PAGES)
    rows = _by_host(sums.where("kind > 0"), host, F.col("token"))
    often = rows.where((F.col("kind") != 3) & (F.col("pages") >= SHARE * F.col("hp")))
    everywhere = F.col("pages") >= ROOT_SHARE * F.col("hp")
    tags = often.where("kind = 1").select("host", "path", "a", "b", "pages", "n", ((F.col("n") == F.col("pages")) & everywhere).alias("root"))
    blocks = often.where("kind = 2").select("host", "token", "path", "a", "b", "pages", "n", everywhere.alias("root"))
    # a class is nested where a tag of it stands around a block of it
    t = tags.where("not root").select("host", "a", "b", "pages", "n", F.col("path").alias("tag"))
    below = blocks.where("not root").withColumn("tag", F.explode(_prefixes("path")))
    nested = below.join(t, ["host", "a", "b", "pages", "n", "tag"]).select("host", "token", F.lit(False).alias("root")).distinct()
    made = blocks.where("root").select("host", "token", "root").union(nested).groupBy("host").agg(
        F.collect_set(F.when(F.col("root"), F.col("token"))).alias("root"), F.collect_set(F.when(~F.col("root"), F.col("token"))).alias("nested"))
    # a gap of the root is named by the path of the root element around it; it holds the words of all paths below
    mass = rows.where("kind = 3").select("host", "path", "n")
    above = mass.select("host", "n", F.explode(_prefixes("path")).alias("path"))
    held = above.join(tags.where("root").select("host", "path"), ["host", "path"]).groupBy("host", "path").agg(F.sum("n").alias("n"))
    total = held.groupBy("host").agg(F.max("n").alias("most"))
    deep = held.join(total, "host").where(F.col("n") >= 0.6 * F.col("most")).groupBy("host").agg(
        F.max_by("path", F.struct(F.size(F.split("path", "/")), F.col("n"), F.col("path"))).alias("gap"))
    none = F.array().cast("array<bigint>")
    return made.join(deep, "host", "full").select("host", F.coalesce("root", none).alias("root"), F.coalesce("nested", none).alias("nested"), "gap")


def _by_host(rows: DataFrame, hosts: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """Join of rows (`host`) with one row a host (`h`); the rows of a host are dealt over `SALTS` keys."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = hosts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, (F.col("host") == F.col("h")) & (F.col("__salt") == F.col("s")), how).drop("__salt", "s", "h")


def _prefixes(path: str):
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _slot(path: str) -> str:
    """Path of the element around a block that is no paragraph, heading or line of text."""
    parts = path.split("/")
    while len(parts) > 1 and parts[-1].partition(".")[0] not in SLOTS:
        parts.pop()
    return "/".join(parts)


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset(), gap: str | None = None) -> str:
    """Blocks of the main slot without those of the template, white space made one space, joined by one space."""
    read_blocks = [(b, b.words()) for b in read(html)[1] if not b.other]
    said = [(b, words) for b, words in read_blocks if words]
    left = [(b, words) for b, words in said if block_code(b.path, words) not in template] if template else said
    best = max((b.main for b, _ in said), default=0)
    if best and not any(b.main == best for b, _ in left):
        # nothing of the article would be left: it is a copy among copies, and stays whole
        keep = {id(b) for b, _ in left} | {id(b) for b, _ in said if b.main == best}
        left = [x for x in said if id(x[0]) in keep]
    if best == 2:
        slots = Counter()
        for b, words in left:
            if b.main < best:
                slots[_slot(b.path)] += len(words)
        if max(slots.values(), default=0) > TEASER * sum(len(words) for b, words in left if b.main == best):
            left = [x for x in left if x[0].main < best]
            best = max((b.main for b, _ in left), default=0)
    inside = [x for x in left if gap and (x[0].path == gap or x[0].path.startswith(f"{gap}/"))]
    out = [x for x in left if x[0].main == best] if best else inside or left  # a page without the gap is taken whole
    if best and inside and not any(b.main == best for b, _ in inside):
        out = max(out, inside, key=lambda slot: sum(len(words) for _, words in slot))
    return " ".join(" ".join(words) for _, words in out)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", template_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """(key, url, text, n_chars) of every page.

    Null or empty html gives an empty text; pages without a host share one group; repeated rows
    give repeated results. Templates of hosts with few pages are empty, and only tags, roles and
    names tell main text there.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key), F.col(url), F.col(html), host.alias("__host"))
    sums = stored(token_sums(rows.withColumn("__url", F.col(url)), "__host", html), "sums")  # read four times
    made = stored(templates(sums), "templates")
    size = made.agg(F.sum(F.size("root") * 8 + F.size("nested") * 8 + 64)).first()[0] or 0
    made = made.select(F.col("host").alias("h"), F.concat("root", "nested").alias("__template"), F.col("gap").alias("__gap"))
    # columns of the caller are named by place, so none clashes
    rows = rows.toDF("k", "u", "html", "host")
    joined = rows.join(F.broadcast(made), F.col("host") == F.col("h"), "left") if size <= template_bytes else _by_host(rows, made, F.col("html"), "left")
    fields = [T.StructField(key, pages.schema[key].dataType), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    key_type = to_arrow_type(fields[0].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, frozenset[int]] = {}
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, len(whole), 1000)):
                texts = []
                for i in range(len(batch)):
                    name, tokens = batch.column(3)[i].as_py(), batch.column(4)[i]
                    if len(known) > 1000:
                        known.clear()
                    if name not in known:
                        known[name] = frozenset(tokens.as_py() or ())
                    texts.append(main_text(batch.column(2)[i].as_py(), known[name], batch.column(5)[i].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in fields])

    return arrow(joined.select("k", "u", "html", "host", "__template", "__gap"), run, T.StructType(fields))
