"""Main text of web pages: what does not repeat over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from eoframe.llm.tables import materialize

#: A host with fewer pages takes the template of all pages.
PAGES_FOR_TEMPLATE = 3
#: Share of a host's pages that must hold what repeats, and share of the text that the main slot must hold.
SUPPORT, MAIN_SHARE = 0.5, 0.6

#: Elements whose content is never main text, by the meaning HTML gives them.
NEVER = frozenset(
    "aside canvas datalist dialog fieldset footer form head header iframe input label legend menu nav noframes noscript option "
    "script search select style svg template textarea title".split()
)
RAW = frozenset("script style title textarea noscript iframe noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can hold a slot of their own.
CONTAINERS = frozenset("article blockquote center div main section table tbody td tr".split())
#: Elements that do not end a run of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements that no class, id or role takes out; ``MAINS`` also keep what they stand in from being marked.
WHOLE, MAINS = frozenset("html body main article".split()), frozenset(["main", "article"])
#: Roles, and whole class and id names (without a number at the end), that mark what is not main text.
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</?([A-Za-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|</?([A-Za-z][^\s/<>]*+)([^<>]*+)>", re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_NUMBER = re.compile(r"[-_]?\d+$")
_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@dataclass
class Block:
    """Text between two boundaries: the path of containers it stands in and its characters."""

    path: str
    text: str


@dataclass
class _Open:
    tag: str
    path: str | None  # None: not a container
    hidden: bool
    mark: int | None  # number of a marked element
    main: int | None  # number of a main or an article


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    containers: dict[str, int] = field(default_factory=dict)


def parse(source: str | None) -> Page:
    """Blocks of text outside of what is never main text, and how often each container path opens.

    Tolerant: end tags without a start are ignored, elements left open end with their parent, a lone "<" is text. A marked
    element is left out with all it holds, unless the page's main element (the first main with text, or else the article with
    most text) stands in it, or the page has no text outside of marked elements.
    """
    text, page = source or "", Page()
    stack: list[_Open] = []
    hidden, path, run = 0, "", []
    blocks: list[tuple[Block, frozenset[int]]] = []
    opened: list[tuple[str, frozenset[int]]] = []
    mains: list[tuple[bool, frozenset[int]]] = []  # is it a main, and the marked elements that it stands in
    lengths: dict[int, int] = {}
    marks = numbers = frozenset()
    marked = 0

    def flush() -> None:
        words = " ".join(entities.unescape("".join(run)).split())
        if words:
            blocks.append((Block(path, words), marks))
            for n in numbers:
                lengths[n] = lengths.get(n, 0) + len(words)
        run.clear()

    at = 0
    while True:
        m = _PIECE.search(text, at)
        if not hidden and (m.start() if m else len(text)) > at:
            run.append(text[at : m.start() if m else len(text)])
        if not m:
            break
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            continue
        if text[m.start() + 1] == "/":
            if tag not in INLINE:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is not None:
                if tag in INLINE and any(o.path is not None or o.hidden or o.mark is not None for o in stack[depth + 1 :]):
                    continue
                flush_needed = any(o.path is not None or o.mark is not None for o in stack[depth:])
                if flush_needed:
                    flush()
                hidden -= sum(o.hidden for o in stack[depth:])
                del stack[depth:]
                marks = frozenset(o.mark for o in stack if o.mark is not None)
                numbers = frozenset(o.main for o in stack if o.main is not None)
                path = next((o.path for o in reversed(stack) if o.path is not None), "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        told = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[2] or m[4] or "")}
        names = {_NUMBER.sub("", n.lower()) for k in ("class", "id") for n in told.get(k, "").split()}
        hide = tag in NEVER or (tag not in WHOLE and told.get("role", "").lower() in ROLES)
        mark = main = None
        if not hidden and not hide:
            if tag in MAINS:
                main = len(mains)
                mains.append((tag == "main", marks))
                numbers |= {main}
            if tag not in WHOLE and not names.isdisjoint(MARKS):
                mark, marked = marked, marked + 1
        if hide or mark is not None:
            flush()
        if mark is not None:
            marks |= {mark}
        own = None
        if tag in CONTAINERS and not hidden and not hide:
            flush()
            label = ".".join([tag, *sorted(_DIGITS.sub("#", told.get("class", "")).split())])
            path = own = f"{path}/{label}"
            opened.append((path, marks))
        elif tag == "p":  # a paragraph ends the one before it
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p" or stack[i].path is not None), None)
            if last is not None and stack[last].tag == "p" and not any(o.hidden or o.mark is not None for o in stack[last:]):
                del stack[last:]
        stack.append(_Open(tag, own, hide, mark, main))
        hidden += hide
    flush()
    best = max(lengths, key=lambda n: (mains[n][0], -n if mains[n][0] else lengths[n], -n), default=None)
    free = mains[best][1] if best is not None else frozenset()
    if all(m - free for _, m in blocks):
        free = frozenset(range(marked))
    page.blocks = [b for b, m in blocks if m <= free]
    for p, m in opened:
        if m <= free:
            page.containers[p] = page.containers.get(p, 0) + 1
    return page


def within(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def _letters(text: str) -> str | None:
    """The text without its figures, if it has any beside letters."""
    plain = _DIGITS.sub("#", text)
    return plain if plain != text and any(c.isalpha() for c in plain) else None


def _token(text: str) -> int:
    x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - 2**64 if x >> 63 else x


@dataclass(frozen=True)
class Template:
    """The main slot and the tokens (hashes of path and text, and of path and text without figures) that repeat."""

    slot: str | None
    repeated: frozenset[int]


def main_text(page: Page, own: Template | None, general: Template | None) -> str:
    """The blocks whose text is not the template's: that of the host, or of all pages if the host has none. Outside of the main
    slot, a text that differs in figures only is the template's too."""
    told = own or general
    if told is None or not told.repeated:
        return " ".join(b.text for b in page.blocks)
    slot = next((t.slot for t in (own, general) if t and t.slot and t.slot in page.containers), "")
    kept = []
    for b in page.blocks:
        if _token(f"{b.path}\n{b.text}") in told.repeated:
            continue
        plain = None if within(b.path, slot) else _letters(b.text)
        if plain is None or _token(f"{b.path}\n#{plain}") not in told.repeated:
            kept.append(b.text)
    return " ".join(kept)


def templates(pages: DataFrame) -> DataFrame:
    """One row per host and one for all pages (host null): pages (different ones), slot and repeated.

    Tokens are the opened containers and the blocks of text. Pages of a host with the same blocks count once. A container or a
    text belongs to the template if it occurs equally often on each page that has it and those are at least ``SUPPORT`` of the
    host's pages and ``PAGES_FOR_TEMPLATE``; a host has fewer than 1 / ``SUPPORT`` times as many of them as a page has tokens.
    slot is the deepest container of the template, once on a page, that holds ``MAIN_SHARE`` of the text ("": the page). Counts
    are summed up before rows meet, so a host with many pages is no long task.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("token", pa.int64()), ("page", pa.int64()),
                        ("times", pa.int64()), ("chars", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page, host = parse(source), host_of(url)
                digest = _token("\n".join(b.text for b in page.blocks))
                chars: dict[str, int] = dict.fromkeys(page.containers, 0)
                chars[""] = 0
                found: dict[int, int] = {}
                for b in page.blocks:
                    plain = _letters(b.text)
                    for t in (b.text, None if plain is None else "#" + plain):
                        if t is not None:
                            token = _token(f"{b.path}\n{t}")
                            found[token] = found.get(token, 0) + 1
                    p = b.path
                    while True:
                        chars[p] += len(b.text)
                        if not p:
                            break
                        p = p.rpartition("/")[0]
                rows += [(host, p, 0, digest, page.containers.get(p, 1), n) for p, n in chars.items()]
                rows += [(host, None, t, digest, n, 0) for t, n in found.items()]
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    told = "host string, path string, token long, page long, times long, chars long"
    tokens = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(count, told)
    once = tokens.groupBy("host", "path", "token", "page").agg(F.max("times").alias("times"), F.max("chars").alias("chars"))
    hosts = once.groupBy("host", "path", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.min("times").alias("least"), F.max("times").alias("most"), F.sum("chars").alias("chars")
    )
    hosts = materialize(hosts, "page-tokens")
    every = hosts.groupBy("path", "token").agg(
        F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars")
    )
    both = hosts.unionByName(every.withColumn("host", F.lit(None).cast("string")))
    page = both.where(F.col("path") == "").select(F.col("host").alias("_h"), F.col("pages").alias("of"), F.col("chars").alias("text"))
    both = both.where((F.col("pages") >= PAGES_FOR_TEMPLATE) & (F.col("least") == F.col("most")))
    both = both.join(page, F.col("host").eqNullSafe(F.col("_h"))).where(F.col("pages") >= SUPPORT * F.col("of"))
    main = (F.col("most") == 1) & (F.col("chars") >= MAIN_SHARE * F.col("text"))
    depth = F.when(main, F.struct(F.size(F.split("path", "/")), F.col("chars"), F.col("path")))
    return both.groupBy("host").agg(
        F.max("of").alias("pages"), F.max(depth)["path"].alias("slot"),
        F.collect_list(F.when(F.col("path").isNull(), F.col("token"))).alias("repeated"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (the main text, empty if none) of every page.

    Null html is empty; a page without a host shares the template of pages without one; rows that repeat stay as they are. A host
    with fewer than ``PAGES_FOR_TEMPLATE`` different pages takes the template of all pages.
    """
    found = materialize(templates(pages), "page-templates")
    every = found.where(F.col("host").isNull()).first()
    general = Template(every["slot"], frozenset(every["repeated"])) if every else None
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())])

    def add_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.mapInArrow(add_host, "page_id long, url string, html string, host string")
    own = found.where(F.col("host").isNotNull()).select("host", "slot", "repeated")
    joined = rows.join(own, "host", "left").select("page_id", "url", "html", "slot", "repeated")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, slot, repeated in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                told = None if repeated is None else Template(slot, frozenset(repeated))
                texts.append(main_text(parse(source), told, general))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=out)

    return joined.mapInArrow(cut, "page_id long, url string, text string")
