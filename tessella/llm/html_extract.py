"""Main text of web pages by templates deduced from equivalence classes of tokens.

A page is a sequence of tokens: elements and blocks of text. The role of an
element is its place: the role of the element that holds it, its name, its class
and id, and its number among like ones there; the role of a text is its element
and the text itself. Tokens that occur on the same pages of a host (pages of one
text count once) form an equivalence class; classes that cover most pages are
valid, and are nested, each token below one that is in the template too. So the
template of a host is a tree of elements with fixed texts in it, and what is left
between them are its slots. Occurrence vectors are compared by a hash that is
combined page by page with XOR, so they aggregate before any shuffle, and a host
of a third of all pages is never in one place.

The article is the innermost slot holder of the template that has HELD of the
text outside links over the pages of the host (a heading h1 weighs more, since it
belongs to its article): menus, sidebars and notices beside it go, whatever they
say and however they are called. Texts of the template inside it go too, unless
they are most of its blocks: then pages are versions of one article. Boxes (lists, divisions) of which half or more is links go.

Names of elements, roles, classes and ids are hints on top of that: parts that
they mark as no main text never count as text, and where the holder is not inside
an article or main element but has one, it is narrowed to that. A page alone on
its host has no template and is extracted by these hints, or by its innermost
holder of HELD of its own text.

Each page is parsed once, and its blocks are written; everything is linear in the
page, however deep it is nested.

Cases: a null or empty page has no text; tags may be unclosed, and a page may
end anywhere; a page without a host is in a host of its own name; repeated rows
come out one by one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.stage import bounded_batches, save

#: Share of a host's different pages that a valid class covers.
SUPPORT = 0.9
#: Share of the text outside links that the chosen holder has, at least; weight of a heading.
HELD, HEADING = 0.75, 10

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that can be the one that holds the text; these and lists and tables are judged as lists of links.
HOLDERS = frozenset("html body main section div center fieldset details".split())
HOLDERS |= frozenset(["article", "td"])
BOXES = HOLDERS | frozenset("ul ol dl table dir".split())
DROPPED = frozenset("head title nav footer aside form button label dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of classes and ids that mark parts which are no main text, as whole words of the name.
NAMES = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies discussion disqus pagination pager form search skip".split())
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
DIGITS = re.compile(r"[0-9]+")
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
#: Marks of a block: no main text by its names; inside an article; a heading.
OUT, BODY, HEAD = 1, 2, 4


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else (url or "")


def marks(attrs: str) -> tuple[bool, bool, str]:
    """(no main text, article body, class and id without numbers) as the attributes of a tag say."""
    out = body = False
    role = []
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            out = out or not NAMES.isdisjoint(re.split(r"[^a-z]+", value))
            role.append(name + "=" + DIGITS.sub("", value))
        elif name == "role":
            out, body = out or value in ROLES, body or value in ("main", "article")
        elif name == "itemprop":
            body = body or value == "articlebody"
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out = out or value == "true"
    return out, body, " ".join(sorted(role))


def role_hash(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 1


class Page:
    """Elements by role and the one that holds them, and blocks of text by element; element 0 is the page."""

    __slots__ = ("boxes", "holder", "linked", "marks", "parent", "roles", "texts", "where")

    def __init__(self, source: str, hints: bool = True):
        self.roles, self.parent, self.holder = [0], [-1], [False]
        self.texts: list[str] = []
        #: Of each block: its element, its box, its characters in links, its marks.
        self.where: list[int] = []
        self.boxes: list[int] = []
        self.linked: list[int] = []
        self.marks: list[int] = []
        like: dict[tuple[int, str, str], int] = {}
        # name, element, marks, box; names that are open, and how often
        stack: list[tuple[str, int, int, int]] = []
        held: dict[str, int] = {}
        text: list[str] = []
        linked = at = 0
        n = len(source)

        def end_block() -> None:
            nonlocal text, linked
            if text:
                whole = SPACE.sub(" ", "".join(text)).strip(" ")
                if whole:
                    _, element, mark, box = stack[-1] if stack else ("", 0, 0, 0)
                    self.texts.append(whole)
                    self.where.append(element)
                    self.boxes.append(box)
                    self.linked.append(linked)
                    self.marks.append(mark)
                text, linked = [], 0

        def cut(k: int) -> None:
            for entry in stack[k:]:
                held[entry[0]] -= 1
            del stack[k:]

        while at < n:
            m = TOKEN.search(source, at)
            piece = source[at : m.start() if m else n]
            if piece:
                piece = html.unescape(piece)
                text.append(piece)
                if held.get("a"):
                    linked += len(piece.strip())
            if not m:
                break
            at = max(m.end(), at + 1)
            if not m[2]:
                continue
            name = m[2].lower()
            block = name in BLOCK or name in RAW
            if block:
                end_block()
            if m[1]:
                if held.get(name):
                    over = False
                    for k in range(len(stack) - 1, -1, -1):
                        over = over or stack[k][0] in BLOCK
                        if stack[k][0] == name:
                            if over and name not in BLOCK:  # an inline end tag does not close blocks
                                held[name] -= 1
                                del stack[k]
                            else:
                                cut(k)
                            break
                continue
            if block:
                for k in range(len(stack) - 1, -1, -1):
                    over = stack[k][0]
                    if over in CLOSES and name in CLOSES[over]:
                        cut(k)
                        break
                    if over in ("article", "main", "section", "div", "body", "ul", "ol", "table", "nav", "footer", "aside", "blockquote", "td"):
                        break
            _, element, mark, box = stack[-1] if stack else ("", 0, 0, 0)
            out, body, role = marks(m[3]) if m[3] else (False, False, "")
            inside = bool(mark & BODY) or name in ("article", "main") or body
            header = name == "header" and not mark & BODY
            drop = bool(mark & OUT) or name in DROPPED or header or (out and name not in ("html", "body", "article", "main"))
            if not hints:
                inside, drop = False, bool(mark & OUT) or name in RAW or name in ("head", "title")
            mark = OUT * drop | BODY * inside | HEAD * (bool(mark & HEAD) or name == "h1")
            if block:
                number = like.get((element, name, role), 0)
                like[element, name, role] = number + 1
                self.parent.append(element)
                self.roles.append(role_hash(self.roles[element], name, role, number))
                self.holder.append(name in HOLDERS)
                element = len(self.roles) - 1
            if name in RAW:
                close = re.compile("</" + re.escape(name) + r"\s*>?", re.I).search(source, at)
                at = close.end() if close else n
            elif name not in VOID and not m[3].endswith("/"):
                stack.append((name, element, mark, element if name in BOXES else box))
                held[name] = held.get(name, 0) + 1
        end_block()


    def fields(self) -> tuple:
        """Columns of parse() from ``roles`` on."""
        lists = [np.array(x, np.int32).tobytes() for x in (self.parent, self.where, self.boxes, self.linked)]
        return np.array(self.roles, np.int64).tobytes(), lists[0], bytes(self.holder), self.texts, *lists[1:], bytes(self.marks)


def text_roles(roles: list[int], where: list[int], texts: list[str]) -> list[int]:
    return [role_hash("text", roles[e], t) for e, t in zip(where, texts, strict=True)]


def weights(texts: list[str], linked: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Characters outside links of each block, more for headings, none for parts marked as no text."""
    size = np.array([len(t) for t in texts], np.int64) - linked
    return np.where(mark & OUT, 0, np.where(mark & HEAD, HEADING * size, np.maximum(size, 0)))


def below(parent: np.ndarray, where: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the blocks' sizes in and below each element, depth of each element)."""
    held = np.bincount(where, weights=size, minlength=len(parent)).astype(np.int64).tolist() if len(where) else [0] * len(parent)
    up, depth = parent.tolist(), [0] * len(parent)
    for i in range(len(up) - 1, 0, -1):
        held[up[i]] += held[i]
    for i in range(1, len(up)):
        depth[i] = depth[up[i]] + 1
    return np.array(held, np.int64), np.array(depth, np.int32)


PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("roles", pa.binary()), ("parent", pa.binary()), ("holder", pa.binary()), ("texts", pa.list_(pa.string())), ("where", pa.binary()), ("boxes", pa.binary()), ("linked", pa.binary()), ("marks", pa.binary())])
PARSED_TYPE = "page_id long, url string, host string, page long, roles binary, parent binary, holder binary, texts array<string>, where binary, boxes binary, linked binary, marks binary"


def parse(batches: Iterator[pa.RecordBatch], hints: bool) -> Iterator[pa.RecordBatch]:
    """Elements and blocks of each page; ``page`` tells different texts apart."""
    for batch in batches:
        rows = []
        for number, url, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p = Page(source, hints)
            same = role_hash(*(t for t, mark in zip(p.texts, p.marks, strict=True) if not mark & OUT))
            rows.append((number, url, host_of(url), same, *p.fields()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PARSED.types, strict=True)], schema=PARSED)


class Row:
    """One row of parse() as arrays."""

    def __init__(self, roles: bytes, parent: bytes, holder: bytes, texts: list, where: bytes, boxes: bytes, linked: bytes, mark: bytes):
        self.roles, self.parent, self.holder = np.frombuffer(roles, np.int64), np.frombuffer(parent, np.int32), np.frombuffer(holder, bool)
        self.texts, self.where, self.boxes = texts, np.frombuffer(where, np.int32), np.frombuffer(boxes, np.int32)
        self.linked, self.marks = np.frombuffer(linked, np.int32), np.frombuffer(mark, np.uint8)

    def text_roles(self) -> np.ndarray:
        return np.array(text_roles(self.roles.tolist(), self.where.tolist(), self.texts), np.int64)


VECTORS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("vector", pa.int64()), ("pages", pa.int64()), ("up", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64()), ("kind", pa.int32())])
VECTORS_TYPE = "host string, token long, vector long, pages long, up long, depth int, chars long, kind int"
#: Kinds of tokens: text, element, element that may hold the article; token 0, the page, is of the last.
TEXT, ELEMENT, HOLDER = range(3)
#: Tokens that a worker sums at a time.
HELD_TOKENS = 200_000


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors of (host, token), with the token's parent and the text below it."""
    part: dict[tuple[str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        hosts, tokens = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((hosts, tokens, *zip(*part.values(), strict=True)), VECTORS.types, strict=True)], schema=VECTORS)

    for batch in batches:
        for host, page, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            r = Row(*row)
            chars, depth = below(r.parent, r.where, weights(r.texts, r.linked, r.marks))
            sign = role_hash("page", page)
            of = np.r_[0, r.roles[r.parent[1:]]]
            kinds = np.where(r.holder, HOLDER, ELEMENT)
            kinds[0] = HOLDER
            size = np.array([len(t) for t in r.texts], np.int64)
            tokens = [*zip(r.roles.tolist(), of.tolist(), depth.tolist(), chars.tolist(), kinds.tolist(), strict=True)]
            tokens += [(t, u, d, c, TEXT) for t, (u, d, c) in dict(zip(r.text_roles().tolist(), zip(r.roles[r.where].tolist(), (depth[r.where] + 1).tolist(), size.tolist(), strict=True), strict=True)).items()]
            for token, up, deep, c, kind in tokens:
                v = part.get((host, token))
                if v is None:
                    part[host, token] = [sign, 1, up, deep, c, kind]
                else:
                    v[0] ^= sign
                    v[1] += 1
                    v[4] += c
            if len(part) > HELD_TOKENS:
                yield flush()
                part = {}
    if part:
        yield flush()


def nested(group: pa.Table) -> pa.Table:
    """The template of one host from its valid tokens (token, up, depth, chars, kind): those whose holders are valid too.

    A host's valid tokens are on nearly all of its pages, so they are no more
    than a page has.
    """
    host = group["host"][0].as_py()
    order = np.argsort(group["depth"].to_numpy(), kind="stable")
    token, up, depth, chars, kind = (group[c].to_numpy()[order].tolist() for c in ("token", "up", "depth", "chars", "kind"))
    tree, best, fixed = {0}, 0, []
    whole = next((c for t, c in zip(token, chars, strict=True) if t == 0), 0)
    for t, u, c, k in zip(token, up, chars, kind, strict=True):
        if u in tree and k != TEXT:
            tree.add(t)
            if k == HOLDER and c > 0 and c >= HELD * whole:
                best = t  # holders of so much are one in another, in order of depth
    fixed = [t for t, u, k in zip(token, up, kind, strict=True) if k == TEXT and u in tree]
    return pa.table({"host": [host], "best": pa.array([best], pa.int64()), "fixed": pa.array([sorted(fixed)], pa.list_(pa.int64()))})


def templates(parsed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, best, fixed): the role of the article's holder (0: the page) and the fixed texts of each host of several pages."""
    if "row" not in parsed.columns:
        parsed = parsed.withColumn("row", F.monotonically_increasing_id())
    # equal pages count once; only the classes of repeated ones are joined, so the pages' texts stay where they are
    again = parsed.groupBy("host", "page").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = parsed.join(save(again, "repeated"), ["host", "page"], "left").where("first is null or row = first").select("host", "page", *PARSED.names[4:])
    each = seen.mapInArrow(vectors, VECTORS_TYPE).groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("up").alias("up"), F.min("depth").alias("depth"), F.sum("chars").alias("chars"), F.max("kind").alias("kind"))
    each = save(each, "vectors")
    total = save(each.where("token = 0").select("host", F.col("pages").alias("total")).where("total > 1"), "hosts")
    frequent = each.join(total, "host").where(F.col("pages") >= support * F.col("total"))
    # a class of equal vectors is valid with its elements; a text needs one of them for company
    classes = frequent.groupBy("host", "vector", "pages").agg(F.max("kind").alias("most")).where(F.col("most") > TEXT)
    valid = frequent.join(classes, ["host", "vector", "pages"], "left_semi").select("host", "token", "up", "depth", "chars", "kind")
    return valid.groupBy("host").applyInArrow(nested, "host string, best long, fixed array<long>")


def article(row: Row, best: int, fixed: list | None) -> str:
    """The blocks of the article, in order, one on a line."""
    roles, parent, mark = row.roles.tolist(), row.parent.tolist(), row.marks
    kept = np.flatnonzero((mark & OUT) == 0)
    size = weights(row.texts, row.linked, mark)
    if best not in roles:
        best = 0
    if not best and not (mark[kept] & BODY).any():  # the page's own innermost holder
        held, depth = below(row.parent, row.where, size)
        most = np.flatnonzero(row.holder & (held > 0) & (held >= HELD * held[0]))
        chosen = int(most[depth[most].argmax()]) if len(most) else 0
    else:
        chosen = roles.index(best)
    inside = [False] * len(parent)
    inside[chosen] = True
    for i in range(chosen + 1, len(parent)):
        inside[i] = inside[parent[i]]
    kept = kept[np.array(inside)[row.where[kept]]]
    if (mark[kept] & BODY).any() and not (mark[kept] & BODY).all():
        kept = kept[(mark[kept] & BODY) > 0]
    chars = np.array([len(t) for t in row.texts], np.int64)
    if fixed:
        same = np.isin(row.text_roles()[kept], fixed)
        if 2 * same.sum() <= len(same):
            kept = kept[~same]
    plain = np.bincount(row.boxes[kept], weights=chars[kept] - 2 * row.linked[kept], minlength=len(parent)) if len(kept) else np.zeros(0)
    if not (mark[kept] & BODY).any():  # lists of links
        kept = kept[plain[row.boxes[kept]] > 0]
    return "\n".join(row.texts[i] for i in kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT, hints: bool = True) -> DataFrame:
    """page_id, url and text of each row of ``pages``.

    A ``support`` above 1 switches templates off; without ``hints``, names of
    elements, roles, classes and ids say nothing.
    """
    bounded_batches(pages.sparkSession, 200)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    parsed = save(own.mapInArrow(lambda it: parse(it, hints), PARSED_TYPE).withColumn("row", F.monotonically_increasing_id()), "parsed")
    joined = parsed.join(save(templates(parsed, support), "templates"), "host", "left").select("page_id", "url", "best", "fixed", *PARSED.names[4:])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(2, b.num_columns)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([article(Row(*row), best or 0, fixed) for best, fixed, *row in rows], pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(texts, "page_id long, url string, text string")
