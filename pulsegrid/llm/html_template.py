"""Main text of web pages by template deduction from equivalence classes of page tokens.

Tokens are block elements, told apart by their path from the root (names, classes and ids), and the texts of blocks, told
apart by path and content. The occurrence vector of a token over the pages of its host is kept as an aggregate: pages,
occurrences, and the exclusive or of one 64-bit number per (page, occurrences). Tokens of one host with equal vectors form
an equivalence class; a class is valid where its tokens share the slot of an enclosing class, else it is cut by slot.
Valid classes nest into the host's template. What a template leaves are slots, and those below its content element are the
main text. A text that is itself in a class of the template stands on all pages alike and is no content.

Only tokens that half of a host's pages hold reach its template, so a template is bounded by twice the tokens of a page.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Elements of a path; deeper ones count as part of the last.
DEPTH = 48
#: A text is template text on hosts of so many pages, and while it is at most this share of what the pages' content holds.
TEXT_PAGES, TEXT_SHARE = 5, 0.25
#: Rows that a task adds up before it hands them on.
HELD = 200_000

# fixed values of HTML: block elements, elements without end tag, and which open elements a start tag closes
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg object".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that are never content, by name, ARIA role, or a word of their class or id.
NAMES = frozenset("head nav footer aside form menu dialog select option button script style noscript template iframe svg object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
_LAYOUT = frozenset("has no with without".split())  # "with-sidebar" is said of what stands beside one
_CONTENT = frozenset("article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    path: str
    text: str
    linked: int  # characters inside links


def _signature(tag: str, attributes: str) -> str:
    """Name, classes and id of an element in one path segment, with a mark for what its attributes say of it."""
    if not attributes or attributes.isspace():
        return tag
    found = {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
    out = tag + "".join(sorted("." + re.sub(r"[0-9]+|/", "0", c) for c in found.get("class", "").split()))
    if found.get("id"):
        out += "#" + re.sub(r"[0-9]+|[/\s]", "0", found["id"])
    if found.get("role"):
        out += "@" + found["role"].strip().lower().replace("/", "0")
    if "articlebody" in found.get("itemprop", "").lower():
        out += "@main"
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        out += "!"
    return out


def _tag(segment: str) -> str:
    return re.match(r"[^.#@!]*", segment)[0]


def _named_out(segment: str, inside: bool) -> bool:
    """Not content by name, role or attribute; ``inside``: within an article or main element, whose own header is content."""
    tag, roles = _tag(segment), set(re.findall(r"@([^.#@!]+)", segment))
    return segment.endswith("!") or tag in NAMES or bool(roles & ROLES) or tag == "header" and not inside


def _worded_out(segment: str, inside: bool) -> bool:
    """Not content by a word of class or id. Of html, body and main no word counts, of articles those for comments do."""
    marks = re.sub(r"@[^.#@!]+", "", segment[len(_tag(segment)) :])
    words: set[str] = set()
    for mark in re.split(r"[.#]", marks):
        own = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", mark)}
        if not own & _LAYOUT:
            words |= own
    tag = _tag(segment)
    if tag in ("html", "body", "main"):
        return False
    return bool(words & (_COMMENT_WORDS if tag == "article" else WORDS - {"banner", "masthead"} if inside else WORDS | {"header"}))


def _holds_content(segment: str) -> bool:
    return _tag(segment) in _CONTENT or "@main" in segment


class _Rules:
    """Which paths are no content; remembers what it has been asked."""

    def __init__(self, allow=()):
        self.allow, self.known = frozenset(allow), {"": (False, False)}

    def state(self, path: str) -> tuple[bool, bool]:
        """(out, inside an article or main element) of a path."""
        if path not in self.known:
            above, _, segment = path.rpartition("/")
            out, inside = self.state(above)
            out = out or _named_out(segment, inside) or path not in self.allow and _worded_out(segment, inside)
            self.known[path] = out, inside or _holds_content(segment)
        return self.known[path]

    def out(self, path: str) -> bool:
        return self.state(path)[0]


def parse(page: str) -> tuple[Counter, list[Block]]:
    """(occurrences of each element path, blocks of text in page order) of a page, which may be broken or cut anywhere."""
    paths: Counter = Counter()
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []  # (name, path)
    opened: Counter = Counter()  # of each name, so that nothing is looked for in vain
    text, linked, link_at = [], 0, None  # link_at: depth of the stack at the open link

    def flush():
        nonlocal linked
        whole = " ".join(entities.unescape("".join(text)).split())
        if whole:
            blocks.append(Block(stack[-1][1] if stack else "", whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    def pop(to: int):
        nonlocal link_at
        flush()
        opened.subtract(name for name, _ in stack[to:])
        del stack[to:]
        if link_at is not None and link_at > len(stack):
            link_at = None

    def add(part: str):
        nonlocal linked
        if part:
            text.append(part)
            if link_at is not None:
                linked += len(part)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS:
                if opened[name] > 0:
                    pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                else:
                    flush()
            elif name == "a":
                link_at = None
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if stop or name in ("script", "style"):  # other elements without an end are read as markup
                at = stop.end() if stop else end
                text.append(" ")
                continue
        if name == "a":
            link_at = len(stack)
        if name == "br" or name == "img":
            text.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if name in _CLOSES and any(opened[x] > 0 for x in _CLOSES[name][0]):
            closed, scope = _CLOSES[name]
            place = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in closed:
                    place = i
            if place is not None:
                pop(place)
        if opened["p"] > 0:
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if name in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
            pop(len(stack) - 1)
        if name in _VOID:
            continue
        above = stack[-1][1] if stack else ""
        segment = _signature(name, attributes)
        deep = above.count("/") >= DEPTH and not (_named_out(segment, False) and not _named_out(above.rpartition("/")[2], False))
        path = above if deep or _named_out(above.rpartition("/")[2], True) else f"{above}/{segment}"
        stack.append((name, path))
        opened[name] += 1
        if path != above:
            paths[path] += 1
    flush()
    return paths, blocks


def key_of(*parts: str) -> int:
    """Signed 64-bit number of a token."""
    return struct.unpack("<q", xxhash.xxh64_digest("\0".join(parts)))[0]


class Role(NamedTuple):
    """A token of a host: ``path`` is its element path; ``is_text`` tells texts from elements; the vector is (pages, n, mark)."""

    role: int
    path: str
    is_text: bool
    pages: int
    n: int
    mark: int
    mass: int  # characters of its own text outside links


class Template(NamedTuple):
    content: str | None  # path of the content element
    allow: tuple[str, ...]  # elements that hold the content although a word speaks against them
    texts: frozenset[int]


def page_roles(page: str, key: int) -> list[Role]:
    """All tokens of one page; ``key`` is the page's number, from which the marks of its vectors come."""
    paths, blocks = parse(page)
    mass = Counter()
    texts: dict[tuple[str, str], int] = Counter()
    for b in blocks:
        mass[b.path] += len(b.text) - b.linked
        texts[b.path, b.text] += 1
    marks = {n: struct.unpack("<q", xxhash.xxh64_digest(struct.pack("<qq", key, n)))[0] for n in {*paths.values(), *texts.values(), 1}}
    out = [Role(key_of(p), p, False, 1, n, marks[n], mass[p]) for p, n in paths.items()]
    out.append(Role(key_of(""), "", False, 1, 1, marks[1], mass[""]))
    return out + [Role(key_of(p, t), p, True, 1, n, marks[n], n * len(t)) for (p, t), n in texts.items()]


def _within(path: str, above: str) -> bool:
    return path == above or path.startswith(above + "/")


def nested_classes(roles: list[Role], n_pages: int) -> list[tuple[str, list[Role]]]:
    """(slot, tokens) of each valid class: elements of equal vectors whose nearest element of another class, the slot, is the
    same, and the texts of that vector inside them. Elements count from half of the pages on, texts on all pages only."""
    elements = {r.path: r for r in roles if not r.is_text and 2 * r.pages >= n_pages}
    vector = lambda r: (r.pages, r.n, r.mark)

    def above(path: str, own: tuple, equal: bool) -> str | None:
        """The nearest element from ``path`` up whose vector is ``own``, or is not."""
        while path not in elements or (vector(elements[path]) == own) != equal:
            if not path:
                return None
            path = path.rpartition("/")[0]
        return path

    classes = defaultdict(list)
    for r in elements.values():
        classes[above(r.path, vector(r), False), vector(r)].append(r)
    for r in roles:
        if r.is_text and r.pages == n_pages:
            host = above(r.path, vector(r), True)
            slot = r.path if host is None else above(host, vector(r), False)
            classes[slot, vector(r)].append(r)
    return [(slot or "", members) for (slot, _), members in classes.items()]


def deduce(roles: list[Role], n_pages: int) -> Template:
    """The template of pages with these tokens, as far as extraction needs it."""
    classes = nested_classes(roles, n_pages)
    elements = {r.path: r for _, members in classes for r in members if not r.is_text}
    named, rules = _Rules(allow=elements), _Rules()
    # an element that holds articles or main elements is no sidebar, whatever its class says
    allow = {p for p in elements if rules.out(p) and not named.out(p) and any(q != p and _within(q, p) and _holds_content(q.rpartition("/")[2]) and not _worded_out(q.rpartition("/")[2], False) for q in elements)}
    rules = _Rules(allow)
    own = {p: 0 if rules.out(p) else r.mass for p, r in elements.items()}
    if not sum(own.values()):  # nothing remains: the rejected element that holds most was rejected for a word in vain
        best = (0, allow)
        for p in elements:
            if rules.out(p) and not named.out(p):
                opened = allow | {q for q in elements if _within(p, q)}
                r = _Rules(opened)
                best = max(best, (sum(x.mass for q, x in elements.items() if _within(q, p) and not r.out(q)), opened), key=lambda x: x[0])
        allow = best[1]
        rules = _Rules(allow)
        own = {p: 0 if rules.out(p) else r.mass for p, r in elements.items()}
    below: Counter = Counter()
    for p, n in own.items():
        while True:
            below[p] += n
            if not p:
                break
            p = p.rpartition("/")[0]
    whole = below[""]
    named_content = [p for p in elements if _holds_content(p.rpartition("/")[2]) and not rules.out(p) and below[p]]
    articles = [p for p in named_content if _tag(p.rpartition("/")[2]) == "article"] or named_content
    best = max(articles, key=lambda p: (below[p], -len(p), p), default=None)
    if best is None or 4 * below[best] < whole:
        best = max(named_content, key=lambda p: (below[p], -len(p), p), default=None)
    if best is None or 4 * below[best] < whole:
        best = ""
        while True:  # into the one child that holds nearly all text, while it is a container
            inner = [p for p in elements if p and p.rpartition("/")[0] == best and 5 * below[p] >= 4 * below[best] > 0 and below[p] > own[p]]
            if not inner:
                break
            best = inner[0]
    texts = frozenset()
    if n_pages >= TEXT_PAGES:
        # texts of a class that has elements as well: they come with the template, not with the page
        alike = [r for _, members in classes if any(not r.is_text for r in members) for r in members if r.is_text and _within(r.path, best)]
        if sum(r.mass for r in alike) <= TEXT_SHARE * below[best]:
            texts = frozenset(r.role for r in alike)
    return Template(best, tuple(sorted(allow)), texts)


def extract(page: str, template: Template | None) -> str:
    """Blocks of the page below the template's content element, without what is no content; by the page's own template where
    the host's does not fit."""
    blocks = parse(page)[1]
    for t in (template, None):
        t = t or deduce(page_roles(page, 0), 1)
        rules = _Rules(t.allow)
        here = [b for b in blocks if _within(b.path, t.content) and not rules.out(b.path)]
        if here:
            return "\n\n".join(b.text for b in here if not t.texts or key_of(b.path, b.text) not in t.texts)
    return ""


def host_of(url: str | None) -> str:
    """Host of an address in lower case, without port; empty if there is none."""
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


_ROLE_SQL = "host long, role long, path string, is_text boolean, pages long, n long, mark long, mass long"


def _role_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) -> tokens of each host, added up per task. A text that some page of its host lacks is no template
    text, so texts that are not on all pages of the host met so far are left out."""
    held: dict[int, dict] = defaultdict(dict)
    size = 0

    def out():
        rows = []
        for host, roles in held.items():
            n_pages = roles[key_of("")][3]
            rows += [(host, *r) for r in roles.values() if not r[2] or r[3] == n_pages]
        held.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _ROLE_SQL.split(", ")])

    for batch in batches:
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = key_of(host_of(url))
            roles = held[host]
            for r in page_roles(page or "", key_of(str(page_id), url or "", page or "")):
                if r.role in roles:
                    x = roles[r.role]
                    x[3], x[4], x[5], x[6] = x[3] + 1, x[4] + r.n, x[5] ^ r.mark, x[6] + r.mass
                else:
                    roles[r.role] = list(r)
                    size += 1
        if size >= HELD:
            yield out()
            size = 0
    if held:
        yield out()


def _template_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, n_pages, roles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = deduce([Role(**r) for r in roles], n_pages)
            columns = [pa.array([host]), pa.array([t.content]), pa.array([list(t.allow)], pa.list_(pa.string())), pa.array([sorted(t.texts)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "content", "allow", "texts"])


def deduce_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host key, content, allow, texts): the template of each host."""
    tokens = pages.select(id_col, url_col, html_col).mapInArrow(_role_batches, _ROLE_SQL)
    whole = tokens.groupBy("host", "role", "is_text").agg(F.min("path").alias("path"), *[F.sum(c).alias(c) for c in ("pages", "n")], F.bit_xor("mark").alias("mark"), F.sum("mass").alias("mass"))
    # the empty path is on every page, so the largest count of a host is that of its pages; texts of one page are none of the template's
    whole = stored(whole.where("not is_text or pages > 1"), "page-tokens")
    listed = F.collect_list(F.struct("role", "path", "is_text", "pages", "n", "mark", "mass"))
    sizes = whole.where("path = '' and not is_text").select("host", F.col("pages").alias("n_pages"))
    frequent = whole.join(sizes, "host").where("2 * pages >= n_pages and (not is_text or pages = n_pages)")
    hosts = frequent.groupBy("host").agg(F.first("n_pages").alias("n_pages"), listed.alias("roles"))
    return hosts.mapInArrow(_template_batches, "host long, content string, allow array<string>, texts array<long>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page, blocks in page order with an empty line between them.

    White space inside a block is one space; character references are decoded. Headings of the article belong to its text.
    Defined cases: null and empty pages, and pages without content, give an empty text; pages without a host share one
    template; repeated rows are extracted each; a page that lacks its host's content element is read by its own template;
    an empty table gives an empty table; other columns are not read. Elements nested deeper than ``DEPTH`` count as their
    parent. Texts on all pages of a host are left out as template text from ``TEXT_PAGES`` pages on, unless they are more
    than ``TEXT_SHARE`` of the content: then the pages are copies of each other and the texts stay.
    """
    templates = deduce_templates(pages, id_col, url_col, html_col)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(host_of(u)) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["page_id", "url", "html", "host"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            found = []
            for page, content, allow, alike in zip(x["html"], x["content"], x["allow"], x["alike"], strict=True):
                template = None if content is None else Template(content, tuple(allow), frozenset(alike))
                found.append(extract(page or "", template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    dealt = pages.select(id_col, url_col, html_col).mapInArrow(hosts, f"page_id {kinds[id_col]}, url string, html string, host long")
    met = dealt.join(templates.withColumnRenamed("texts", "alike"), "host", "left").select("page_id", "url", "html", "content", "allow", "alike")
    return met.mapInArrow(texts, f"page_id {kinds[id_col]}, url string, text string")


def op11_query(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
