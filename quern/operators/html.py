"""Extraction and cleaning of web pages: one Arrow-batched pass a page, whose results are then plain columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import FOOTER_PHRASES, content_hash, default, strip
from quern.operators.dom import Node, parse
from quern.operators.frames import in_slices

# Tags and attribute words that mark what isn't content.
NOISE_TAGS = frozenset("script style noscript template svg iframe canvas form button input select textarea img picture video audio source".split())
CHROME_TAGS = frozenset("nav footer aside".split())
CHROME_ROLES = frozenset("navigation contentinfo banner complementary".split())
CHROME_HINTS = ("nav", "menu", "navbar", "sidebar", "breadcrumb", "footer", "cookie", "banner", "masthead", "toolbar", "skiplink", "skip-link")
CHROME_CHARS = 800
LINE_WINDOW, LINE_CHARS, BLOCK_CHARS = 40, 120, 180
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_NESTED = ("p", "div", "ul", "ol", "table", *HEADINGS)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def tidy(text: str) -> str:
    """Stripped lines, at most one blank line between them."""
    text = re.sub(r"[ \t]+", " ", text.replace("\xa0", " "))
    lines = [x.strip() for x in text.splitlines()]
    return "\n".join(x for i, x in enumerate(lines) if x or (i and lines[i - 1])).strip()


def is_boilerplate(text: str) -> bool:
    low = text.lower().strip()
    return not low or (len(low) < 120 and any(p in low for p in FOOTER_PHRASES)) or bool(re.fullmatch(r"(?:©|\(c\)).*", low))


def normalize_reference(href: str, base: str) -> str | None:
    """The normal form of a reference found on a page; see functions.urls.normalize_url."""
    href = href.strip()
    if not href or href.startswith(("javascript:", "mailto:", "tel:", "data:")):
        return None
    try:
        parts = urlsplit(urljoin(base, href) if base else href)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    where, _, last = parts.path.rpartition("/")
    path = re.sub("/{2,}", "/", f"{where}/{last.partition(';')[0]}" if parts.path else "/")
    return f"{parts.scheme}://{host.lower()}{f':{port}' if port and port not in (80, 443) else ''}{path}{f'?{parts.query}' if parts.query else ''}"


def title_of(page: Node) -> str:
    node = page.first("title")
    return node.text() if node else ""


def headings(page: Node) -> list[dict]:
    """By level, then in document order."""
    return [{"level": h, "text": t} for h in HEADINGS for n in page.find_all(h) if (t := n.text())]


def links(page: Node, base: str, hosts: Iterable[str]) -> list[dict]:
    """Distinct link targets, the first anchor of each."""
    found: dict[str, dict] = {}
    for a in page.find_all("a"):
        url = normalize_reference(a.attrs["href"], base) if "href" in a.attrs else None
        if url and url not in found:
            found[url] = {"url": url, "text": a.text(), "internal": (urlsplit(url).hostname or "") in hosts}
    return list(found.values())


def navigation(page: Node, base: str) -> list[dict]:
    """Sections of links with a label; the same node counts once, and its items are not made distinct."""

    def marked(n: Node) -> bool:
        return n.attrs.get("role") == "navigation" or bool({"nav", "menu", "navbar", "navigation"} & set(n.classes)) or (n.tag == "nav" and any(a.tag == "header" for a in n.above()))

    nodes = dict.fromkeys([*page.find_all("nav"), *filter(marked, page.walk())])
    out = []
    for n in nodes:
        items = [{"url": u, "text": a.text()} for a in n.find_all("a") if "href" in a.attrs and (u := normalize_reference(a.attrs["href"], base))]
        if items:
            out.append({"label": n.attrs.get("aria-label") or n.attrs.get("id") or " ".join(n.classes[:3]) or n.tag, "items": items})
    return out


def visible_text(page: Node) -> str:
    """A line for each text node outside scripts and styles; comments and doctype are nodes too."""

    out, stack = [], list(reversed(page.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag not in ("script", "style", "noscript", "template", "svg"):
                stack.extend(reversed(x.children))
        elif line := squeeze(x):
            out.append(line)
    return "\n".join(out)


def content_root(page: Node) -> Node:
    tests = (lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content", lambda n: "content" in n.classes, lambda n: n.attrs.get("id") == "main", lambda n: n.tag == "body")
    for test in tests:
        if node := next(filter(test, page.walk()), None):
            return node
    return page


def is_chrome(n: Node) -> bool:
    """Tags and roles say so outright; words of attributes only where there is little text."""
    if n.tag in CHROME_TAGS or n.attrs.get("role", "").lower() in CHROME_ROLES:
        return True
    words = set(re.findall("[a-z0-9]+", " ".join(n.attrs.get(k, "") for k in ("id", "class", "role", "aria-label", "name")).lower()))
    if not any(set(h.split("-")) <= words for h in CHROME_HINTS):
        return False
    return len("".join(s.strip() for s in n.strings())) <= CHROME_CHARS


def strip_noise(root: Node) -> None:
    for n in list(root.walk()):
        attached = n.parent is not None and (n.parent is root or root in n.above())
        if attached and (n.tag in NOISE_TAGS or is_chrome(n)):
            n.remove()


def link_text(a: Node, base: str) -> str:
    label, href = a.text(), a.attrs.get("href", "").strip()
    if not label or not href or href.startswith(("javascript:", "mailto:", "tel:", "#")):
        return label
    try:
        target = urljoin(base, href)
    except ValueError:
        return label
    return f"[{label}]({target})" if target.startswith(("http://", "https://")) else label


def inline(n: Node, base: str, skip: tuple[str, ...] = (), lists: dict[int, str] | None = None) -> str:
    """The text of n's children on a line; links marked up; lists, whose texts are known, nested on lines of their own."""
    parts = []
    for c in n.children:
        if not isinstance(c, Node):
            part = squeeze(c)
        elif c.tag == "a":
            part = link_text(c, base)
        elif lists is not None and c.tag in ("ul", "ol"):
            part = lists[id(c)] and "\n" + lists[id(c)]
        else:
            part = "" if c.tag in skip else c.text()
        if part:
            parts.append(part)
    return " ".join(parts).strip()


def list_text(n: Node, base: str) -> str:
    """Items of a list, those inside first, so that any depth will do."""
    texts: dict[int, str] = {}
    for x in reversed([n, *n.find_all("ul", "ol")]):
        items = [t for c in x.children if isinstance(c, Node) and c.tag == "li" and (t := inline(c, base, lists=texts))]
        texts[id(x)] = "\n".join(f"{f'{i}. ' if x.tag == 'ol' else '- '}{t}" for i, t in enumerate(items, 1))
    return texts[id(n)]


def table_text(n: Node, base: str) -> str:
    rows = [[inline(c, base) for c in tr.children if isinstance(c, Node) and c.tag in ("th", "td")] for tr in n.find_all("tr")]
    return "\n".join(" | ".join(cells) for cells in rows if any(cells))


def content_blocks(root: Node, base: str) -> list[dict]:
    """Headings, paragraphs, lists and tables in document order, each with its heading and section path."""
    out: list[dict] = []
    path: list[str] = []

    def add(kind: str, text: str, level: int = 0) -> None:
        out.append({"kind": kind, "text": text, "heading": path[-1] if path else "", "section": " > ".join(path), "level": level})

    for n in root.walk():
        if n.tag in HEADINGS:
            if text := n.text():
                level = int(n.tag[1])
                path[level - 1 :] = [text]
                add("heading", f"{'#' * level} {text}", level)
            continue
        if n.tag in ("ul", "ol"):
            kind, text = "list", "" if any(a.tag in ("ul", "ol") for a in n.above()) else list_text(n, base)
        elif n.tag == "table":
            kind, text = "table", table_text(n, base)
        elif n.tag == "p" or (n.tag in ("div", "section", "article") and not n.first(*_NESTED)):
            kind, text = "paragraph", inline(n, base, skip=("ul", "ol", "table", *HEADINGS))
        else:
            continue
        text = tidy(text)
        if not is_boilerplate(text):
            add(kind, text)
    return out


def distinct_blocks(blocks: list[dict]) -> list[dict]:
    """Without short blocks that the page had before; headings stay."""
    out, seen = [], set()
    for b in blocks:
        key = b["text"].strip().lower()
        if b["kind"] != "heading":
            if key in seen and len(key) < BLOCK_CHARS:
                continue
            seen.add(key)
        out.append(b)
    return out


def distinct_lines(text: str) -> str:
    """Without short lines that are among the last LINE_WINDOW kept ones; blank and long lines stay."""
    out: list[str] = []
    recent: list[str] = []
    for line in text.splitlines():
        key = line.strip().lower()
        if key and len(key) < LINE_CHARS and key in recent:
            continue
        out.append(line)
        if key:
            recent = [*recent, key][-LINE_WINDOW:]
    return "\n".join(out)


def clean(html: str, url: str = "", title: str = "") -> dict:
    page = parse(html)
    title = title or title_of(page)
    root = content_root(page)
    strip_noise(root)
    blocks = distinct_blocks(content_blocks(root, url))
    text = tidy(distinct_lines(tidy("\n\n".join(b["text"] for b in blocks if b["text"]))))
    kept = [{"text": t, "url": u} for t, u in re.findall(r"\[([^\]]+)\]\((https?://[^)]+)\)", text)]
    return {"title": title, "cleaned_text": text, "blocks": blocks, "preserved_links": kept}


def clean_without_html(title: str, heads: list[dict], visible: str, found: list[dict]) -> dict:
    """The cleaned form of a record that kept no HTML: title, headings, text and internal links as one paragraph."""
    level = lambda h: max(1, min(6, int(x) if (x := str(h.get("level") or "h2").lstrip("h")).isdigit() else 2))
    parts = [f"# {title}"] if title else []
    parts += [f"{'#' * level(h)} {h['text']}" for h in heads or [] if h.get("text")]
    parts += [visible.strip()] if (visible or "").strip() else []
    parts += [f"[{x['text'].strip()}]({x['url'].strip()})" for x in found or [] if x.get("internal") and (x.get("text") or "").strip() and (x.get("url") or "").strip()]
    text = tidy("\n\n".join(parts))
    return {"title": title, "cleaned_text": text, "blocks": [{"kind": "paragraph", "text": text, "heading": title, "section": title, "level": 0}] if text else [], "preserved_links": []}


_PAIR = "array<struct<text:string,url:string>>"
BLOCKS = "array<struct<kind:string,text:string,heading:string,section:string,level:int>>"
PAGE_SCHEMA = (
    "page_key long, url string, title string, headings array<struct<level:string,text:string>>, visible_text string, "
    "links array<struct<url:string,text:string,internal:boolean>>, navigation array<struct<label:string,items:array<struct<url:string,text:string>>>>, "
    f"cleaned_text string, blocks {BLOCKS}, preserved_links {_PAIR}"
)


def extract_pages(pages: DataFrame, hosts: Iterable[str], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page with PAGE_SCHEMA and content_hash; null HTML is an empty page. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    hosts = frozenset(hosts)
    spark = pages.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], PAGE_SCHEMA).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
            u, h = u or "", h or ""
            page = parse(h)
            done = clean(h, u)
            out.append({"page_key": k, "url": u, "title": done["title"], "headings": headings(page), "visible_text": visible_text(page), "links": links(page, u, hosts), "navigation": navigation(page, u), **{c: done[c] for c in ("cleaned_text", "blocks", "preserved_links")}})
        return pa.RecordBatch.from_pylist(out, schema)

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(in_slices(run), PAGE_SCHEMA)
    return rows.withColumn("content_hash", content_hash(F.concat("title", F.lit("\n"), "visible_text")))


def dedupe_blocks(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """distinct_blocks over exploded blocks (doc, pos, kind, text), natively."""
    key = F.lower(strip("text"))
    order = Window.partitionBy(doc, F.col("kind") == "heading", key).orderBy("pos")
    rows = blocks.withColumn("nth", F.row_number().over(order))
    return rows.filter((F.col("kind") == "heading") | (F.col("nth") == 1) | (F.length(key) >= BLOCK_CHARS)).drop("nth")


def dedupe_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text after distinct_lines."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: distinct_lines(t or ""))

    return docs.withColumn(text, run(F.col(text)))


def page_documents(extracted: DataFrame, default_title: str) -> DataFrame:
    return extracted.withColumn("title", default("title", default_title))
