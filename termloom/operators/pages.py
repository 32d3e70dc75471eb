"""Links, thread ids and comment fields of crawled pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom import storage


def without_query(url: Column) -> Column:
    """A url up to its first question mark."""
    return F.regexp_replace(url, r"\?.*", "")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute url, by the page's scheme and host."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def links(pages: DataFrame, domain: str | None = None) -> DataFrame:
    """(page_id, link): what pages link to, as absolute urls; with ``domain`` only that domain and its subdomains."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("raw")).select("page_id", resolved(F.col("url"), F.col("raw")).alias("link"))
    if domain:
        found = found.where((host_of(F.col("link")) == domain) | host_of(F.col("link")).endswith("." + domain))
    return found


def thread_id(html: Column) -> Column:
    """The discussion thread id in a page, or null."""
    found = F.regexp_extract(html, r"disqus_identifier = '([0-9]+)", 1)
    return F.when(found != "", found)


def crawl(pages: DataFrame, seeds: DataFrame, domain: str, max_depth: int = 4) -> DataFrame:
    """(url, depth): breadth-first from ``seeds`` (url) over pages of a domain, each url once, up to a depth."""
    known = links(pages.join(pages.select("url").distinct(), "url", "left_semi"), domain).join(pages.select("page_id", "url"), "page_id").select(F.col("url").alias("source"), "link").distinct()
    edges = storage.stored(known)
    visited = frontier = storage.stored(seeds.select("url", F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        fresh = frontier.join(edges, frontier["url"] == edges["source"]).select(F.col("link").alias("url"), F.lit(depth).alias("depth")).distinct()
        frontier = storage.stored(fresh.join(visited.select("url"), "url", "left_anti"))
        if frontier.isEmpty():
            break
        visited = storage.stored(visited.unionByName(frontier))
    return visited


# The class names of the comment markup.
BLOCK = "comment"
NAME, BODY, DATE, ORIGIN, CONTAINER = "comment-meta__name", "comment__body", "comment-meta__date", "comment__origin", "comment__container"
RECOMMENDED, REACTIONS, JUMP = "js-comment-recommendations", "comment__reactions", "comment__origin js-jump-to-comment"
SECTION, NEXT, OTHER_NEXT = "comment-section__item", "pager__button pager__button--next", "zb-pager__btn-rel-next"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    """An element of a page: tag, attributes, and what it holds (elements and texts, in order)."""

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.inside = tag, attrs, []

    def all(self) -> Iterator[Element]:
        """The elements below, in document order."""
        for x in self.inside:
            if isinstance(x, Element):
                yield x
                yield from x.all()

    def texts(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, Element):
                yield from x.texts()
            else:
                yield x

    def children(self, tag: str) -> list[Element]:
        return [x for x in self.inside if isinstance(x, Element) and x.tag == tag]

    def holds(self, name: str) -> bool:
        """Whether the class attribute has the name somewhere in it."""
        return name in (self.attrs.get("class") or "")

    def named(self, name: str) -> bool:
        return self.attrs.get("class") == name


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = Element(tag, dict(attrs))
        self.open[-1].inside.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if depth:
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parsed_page(html: str | None) -> Element:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _first(found: Iterator, default: str | None = None) -> str | None:
    return next(iter(found), default)


def _after_cid(href: str | None) -> str | None:
    return href.rpartition("cid-")[2] if href is not None else None


def comment_of(block: Element) -> tuple:
    """(user_url, user_name, comment_text, recommendations, nth_comment_in_article, respond_to, cid, pid) of a comment block."""
    inside = [block, *block.all()]
    href = lambda elements: (e.attrs["href"] or "" for e in elements if "href" in e.attrs)
    user = _first(href(a for e in inside if e.tag == "div" and e.holds(NAME) for a in e.children("a")), "")
    body = [t.strip() for e in inside if e.tag == "div" and e.holds(BODY) and not any(e in o.inside for o in inside if o.holds(BODY)) for t in e.texts()]
    liked = _first((t for e in inside if e.named(RECOMMENDED) for t in e.texts()), "0").strip()
    ordinal = _first((t for e in inside if e.holds(DATE) for t in e.texts()), "")
    ordinal = "\n".join(line.partition("\xa0")[0] for line in ordinal.split("\n")).replace("#", "").strip()
    strong = (a.children("strong") for e in inside if e.tag == "div" and e.named(REACTIONS) for a in e.children("a") if a.named(JUMP))
    answered = _first(x.strip() for s in strong if len(s) > 1 for x in s[1].inside if isinstance(x, str))
    cid, pid = _after_cid(_first(href(e for e in inside if e.holds(DATE)))), _after_cid(_first(href(e for e in inside if e.tag == "a" and e.holds(ORIGIN))))
    return user, user.rpartition("/")[2], "\n".join(body).strip(), int(liked) if liked.isdecimal() else 0, ordinal, answered, cid, pid


def navigation_of(page: Element) -> tuple[str | None, list[str]]:
    """The link to the next page of comments (by the first markup, else the second), and the links to hidden replies."""
    every = list(page.all())
    sections = (a for e in every if e.tag == "div" and e.named(SECTION) for a in e.all() if a.tag == "a" and a.named(NEXT))
    others = (a for a in every if a.tag == "a" and a.holds(OTHER_NEXT))
    links = [a.attrs["href"] for group in (sections, others) for a in group if "href" in a.attrs]
    replies = [x.attrs["data-url"] for e in every if e.tag == "div" and e.holds(CONTAINER) for x in e.all() if x.attrs.get("data-url")]
    return (links[0] if links else None), list(dict.fromkeys(replies))


COMMENT_FIELDS = "url string, user_url string, user_name string, comment_text string, recommendations int, nth_comment_in_article string, respond_to string, cid string, pid string"


def comment_fields(pages: DataFrame) -> DataFrame:
    """One row for each comment block of pages (url, html): who, what, and in answer to what."""
    import pyarrow as pa

    names = [f.split()[0] for f in COMMENT_FIELDS.split(", ")]

    def parsed(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = [(url, *comment_of(e)) for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) for e in parsed_page(html).all() if e.tag == "article" and e.holds(BLOCK)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, pa.int32() if n == "recommendations" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return pages.select(without_query(F.col("url")).alias("url"), "html").mapInArrow(parsed, COMMENT_FIELDS)


def navigation(pages: DataFrame) -> DataFrame:
    """(url, next_page, replies) of pages (url, html)."""
    import pyarrow as pa

    def parsed(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [navigation_of(parsed_page(html)) for html in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("url"), pa.array([n for n, _ in found], pa.string()), pa.array([r for _, r in found], pa.list_(pa.string()))], names=["url", "next_page", "replies"])

    return pages.select(F.col("url").cast("string").alias("url"), "html").mapInArrow(parsed, "url string, next_page string, replies array<string>")
