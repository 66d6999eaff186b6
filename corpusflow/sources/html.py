"""HTML payloads to rows.  Parsing is a tree walk, so it runs in an Arrow function over payloads
(one page at a time, standard library parser); everything after it is DataFrame work."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, rx
from ..functions.udf import arrow

c = F.col
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack += [x for x in n.children[::-1] if x.__class__ is Node]

    def find(self, *tests: Callable[[Node], bool]) -> Node | None:
        """The first descendant in document order that passes any test."""
        return next((n for n in self.walk() if n is not self and any(t(n) for t in tests)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return " ".join("".join(out).split())

    def up(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n is not None:
            if n.tag == tag:
                self.at = n.parent or self.root
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def tag(*names: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in names


def cls(*names: str) -> Callable[[Node], bool]:
    return lambda n: any(x in n.classes for x in names)


def cls_part(*parts: str) -> Callable[[Node], bool]:
    return lambda n: any(p in (n.attrs.get("class") or "") for p in parts)


def resolved(href: str | None, base: str) -> str | None:
    """An absolute http(s) URL, or None."""
    href = (href or "").strip()
    if not href or href.startswith(("#", "javascript:")):
        return None
    try:
        u = urljoin(base, href)
        return u if urlsplit(u).scheme in ("http", "https") and urlsplit(u).hostname else None
    except ValueError:
        return None


def host(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


LINKS = "array<struct<title:string,url:string,context:string,datetime:string>>"


def links(html: str | None, base: str) -> list[dict]:
    """Links outside navigation, with the text of their container and its machine-readable time."""
    out = []
    for n in tree(html).walk():
        if n.tag != "a" or "href" not in n.attrs or any(x.tag in ("nav", "header", "footer") for x in n.up()):
            continue
        url = resolved(n.attrs["href"], base)
        if url is None:
            continue
        box = next((x for x in n.up() if x.tag in ("article", "li") or any(k in x.classes for k in rules.LINK_BOXES)), n.parent or n)
        time = box.find(lambda x: x.tag == "time" and "datetime" in x.attrs)
        out.append({"title": n.text(), "url": url, "context": box.text(), "datetime": time.attrs["datetime"] if time else None})
    return out


@arrow(LINKS)
def _links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links(h, b or "") for h, b in zip(html, base, strict=True)])


def link_list(pages: DataFrame, limit: int = 50, least_title: int = 8) -> DataFrame:
    """Articles of link lists; pages: (source_id, html) with the source's columns (s_url, s_allowed_hosts,
    s_keywords, s_exclude_keywords, s_category).

    Titles of 8 characters; hosts of the source or allowed; keyword gates over title and
    context; the first of each URL, at most ``limit`` a page, in page order.
    """
    from pyspark.sql import Window

    from ..functions import urls

    rows = pages.withColumn("__p", F.monotonically_increasing_id()).select("*", F.posexplode(_links(c("html"), c("s_url"))).alias("pos", "l")).drop("html")
    rows = rows.select("*", "l.*").drop("l")
    both = F.concat_ws("\n", c("title"), c("context"))
    hosts = F.array_union(F.array(urls.host(c("s_url"))), F.transform(F.coalesce(c("s_allowed_hosts"), F.array().cast("array<string>")), F.lower))
    keywords = F.coalesce(c("s_keywords"), F.array().cast("array<string>"))
    rows = rows.where((F.char_length("title") >= least_title) & (c("url") != c("s_url")) & F.array_contains(hosts, urls.host(c("url"))))
    rows = rows.where(((F.size(keywords) == 0) | rx.contains_any_of(both, keywords)) & ~rx.contains_any_of(both, F.coalesce(c("s_exclude_keywords"), F.array().cast("array<string>"))))
    first = F.row_number().over(Window.partitionBy("__p", "url").orderBy("pos"))
    rows = rows.withColumn("__n", first).where("__n = 1").withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy("pos"))).where(c("__k") <= limit)
    excerpt = F.substring(rx.trim(rx.replace(F.replace(c("context"), c("title"), F.lit("")), r"\s+", " ")), 1, 500)
    at = F.when(c("datetime").isNotNull(), F.coalesce(dates.from_text(c("datetime")), dates.parsed(c("datetime")))).otherwise(dates.from_text(c("context")))
    out = rows.select("source_id", "title", "url", F.nullif(excerpt, F.lit("")).alias("excerpt"), at.alias("published_at"), c("s_category").alias("category"), F.lit(None).cast("string").alias("meta"), F.lit(None).cast("string").alias("content_type"), "pos")
    return out.withColumn("content_type", rx.first_match(F.concat_ws("\n", "title", "excerpt"), rules.CONTENT_TYPES))


METADATA = "struct<json_date:string,meta_dates:array<string>,time:string,body:string,modified:boolean,excerpts:array<string>,types:array<string>>"


def _objects(value) -> Iterator[dict]:
    if isinstance(value, list):
        for v in value:
            yield from _objects(v)
    elif isinstance(value, dict):
        yield value
        yield from _objects(value.get("@graph"))


def _strings(values) -> list[str]:
    return [re.sub(r"\s+", " ", v).strip() for v in values if isinstance(v, str) and v.strip()]


def page_metadata(html: str | None) -> dict:
    """What a page says of itself, raw: structured data, meta tags, time tag, labelled text."""
    root = tree(html)
    data: list[dict] = []
    nodes, gone = list(root.walk()), []
    for n in nodes:
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                data += list(_objects(json.loads("".join(x for x in n.children if isinstance(x, str)))))
            except ValueError:
                pass
        own = n.attrs.get("class")
        if n.tag in rules.NO_CONTENT_TAGS or (own and any(p in own for p in rules.NO_CONTENT_CLASSES)):
            gone.append(n)
    for n in gone:
        if n.parent is not None:
            n.parent.children = [x for x in n.parent.children if x is not n]
    if gone:
        nodes = list(root.walk())
    # one walk finds what the page says in nodes; of most kinds the first in document order counts
    metas: list[dict] = []
    dated: list[Node] = []
    time = lead = main = label = None
    for n in nodes:
        if n.tag == "meta":
            metas.append(n.attrs)
        elif n.tag == "time" and time is None and "datetime" in n.attrs:
            time = n
        own = n.attrs.get("class")
        classes = own.split() if own else ()
        whole = n.tag in ("article", "main")
        if whole or (own and (rules.DATED_PART in own or any(x in classes for x in rules.DATED_CLASSES))):
            dated.append(n)
        if whole and main is None:
            main = n
        if own and lead is None and (any(x in classes for x in rules.EXCERPT_CLASSES) or any(p in own for p in rules.EXCERPT_PARTS)):
            lead = n
        if label is None and ((own and any(x in classes for x in rules.TYPE_CLASSES)) or n.attrs.get("rel") == "category tag"):
            label = n
    body = " ".join(n.text() for n in dated)

    def meta(key: str, *names: str) -> str | None:
        return next((m["content"].strip() for m in metas if m.get(key) in names and "content" in m), None)

    def said(n: Node | None) -> str | None:
        return None if n is None else n.text()

    return {
        "json_date": next(iter(_strings(d.get("datePublished") for d in data)), None),
        "meta_dates": _strings([meta(key, *names) for key, names in rules.META_DATES]),
        "time": time.attrs["datetime"] if time else None,
        "body": body,
        "modified": bool(_strings(d.get("dateModified") for d in data)),
        "excerpts": _strings([
            *(d.get("description") for d in data), *(meta(*x) for x in rules.META_EXCERPTS),
            said(lead), said(main),
        ]),
        "types": _strings([*(meta(*x) for x in rules.META_TYPES), *(d.get("articleSection") for d in data), said(label)]),
    }


@arrow(METADATA)
def _metadata(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_metadata(h) for h in html], columns=["json_date", "meta_dates", "time", "body", "modified", "excerpts", "types"])


def detail_metadata(pages: DataFrame, html: str = "html", structured_only: Column | None = None) -> DataFrame:
    """pages with published_at, excerpt, content_type, content_type_evidence and date_modified_found.

    The first date of: structured data, meta tags, time tag, labelled text; only the
    first and the last where ``structured_only`` holds.  An excerpt needs 30 characters
    and is cut at 1200.
    """
    out = pages.withColumn("__m", _metadata(c(html)))
    m = lambda k: c(f"__m.{k}")
    labelled = dates.made(rx.extract(m("body"), rules.LABELLED_DATE, 3), dates.month_number(rx.extract(m("body"), rules.LABELLED_DATE, 1)), rx.extract(m("body"), rules.LABELLED_DATE, 2))
    from_meta = F.get(F.filter(F.transform(m("meta_dates"), dates.parsed), lambda t: t.isNotNull()), F.lit(0))
    loose = F.coalesce(from_meta, dates.parsed(m("time")))
    middle = loose if structured_only is None else F.when(~structured_only, loose)
    kind = rx.replace(F.get(m("types"), F.lit(0)), rules.TYPE_DATE, "")
    first = F.get(m("excerpts"), F.lit(0))
    return out.select(
        *[x for x in pages.columns if x != html], F.coalesce(dates.parsed(m("json_date")), middle, labelled).alias("published_at"), F.when(F.char_length(first) >= 30, F.substring(first, 1, 1200)).alias("excerpt"),
        kind.alias("content_type"), F.when(kind.isNotNull(), "metadata").alias("content_type_evidence"), m("modified").alias("date_modified_found"),
    )


_FIELDS = ("title", "url", "date", "issue", "section", "excerpt", "doi", "authors")
ROWS = "array<struct<" + ",".join(f"{k}:string" for k in _FIELDS) + ">>"


def _rows(parse: Callable[[Node, str], list[dict]]):
    @arrow(ROWS)
    def run(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([[{k: r.get(k) for k in _FIELDS} for r in parse(tree(h), b or "")] for h, b in zip(html, base, strict=True)])

    return run


def _issue(root: Node, base: str) -> list[dict]:
    """Rows of a current issue: each DOI link's article is the nearest of seven ancestors with a title link."""
    label, when = re.search(rules.ISSUE_LABEL, root.text()), re.search(rules.ISSUE_DATE, root.text())
    out, seen = [], set()
    for n in root.walk():
        m = re.search(r"doi\.org/(.+)$", n.attrs.get("href", "").strip(), re.I) if n.tag == "a" else None
        if not m:
            continue
        for depth, box in enumerate(n.up()):
            if depth > 7:
                break
            link = box.find(lambda x: x.tag == "a" and "href" in x.attrs and "doi.org" not in x.attrs["href"] and len(x.text()) >= 5)
            if link is not None:
                url = resolved(link.attrs["href"], base)
                if url and host(url) == host(base) and url not in seen:
                    seen.add(url)
                    out.append({"title": link.text(), "url": url, "date": when[1] if when else None, "section": label[1] if label else None, "doi": unquote(m[1])})
                break
    return out


def _notices(root: Node, base: str) -> list[dict]:
    """List items with an information link, on the page's host."""
    out = []
    for n in root.walk():
        link = n.find(lambda x: x.tag == "a" and "/info/" in x.attrs.get("href", "")) if n.tag == "li" else None
        url = resolved(link.attrs["href"], base) if link else None
        if url is None or host(url) != host(base):
            continue
        own, time = n.find(tag("p", "time")), n.find(lambda x: x.tag == "time" and "datetime" in x.attrs)
        out.append({"title": link.text(), "url": url, "date": (own.text() if own else "") or (time.attrs["datetime"] if time else None)})
    return out


def _contents(root: Node, base: str) -> list[dict]:
    """A journal's table of contents: section, link, own or issue date, DOI, authors."""
    issue = root.find(cls(*rules.ISSUE_DATE_CLASSES), cls_part("issueDate"))
    text = lambda n, *tests: (lambda x: x.text() if x else "")(n.find(*tests))
    out = []
    for n in root.walk():
        in_list = n.tag == "li" and n.parent is not None and "article-list" in n.parent.classes
        if not (n.tag == "article" or cls(*rules.ARTICLE_CLASSES)(n) or in_list):
            continue
        link = n.find(lambda x: x.tag == "a" and ("title" in x.classes or (x.parent is not None and x.parent.tag in ("h2", "h3")) or "/CN/" in x.attrs.get("href", "")))
        url = resolved(link.attrs.get("href"), base) if link else None
        if url is None:
            continue
        time = n.find(lambda x: x.tag == "time" and "datetime" in x.attrs)
        own = time.attrs["datetime"] if time else text(n, tag("time"), cls_part("date"))
        doi = re.search(r"10\.\d{4,9}/\S+", text(n, cls_part("doi")))
        out.append({"title": link.text(), "url": url, "date": own, "issue": issue.text() if issue else None, "section": text(n, cls(*rules.SECTION_CLASSES), cls_part("section")), "excerpt": text(n, cls_part("abstract"), cls("summary")), "doi": doi[0] if doi else None, "authors": text(n, cls_part("author"))})
    return out


def _trending(root: Node, base: str) -> list[dict]:
    """Ranked repositories: name, description, and language, stars, forks, stars today in ``authors``."""
    out = []
    for n in root.walk():
        if n.tag != "article" or "Box-row" not in n.classes:
            continue
        head = n.find(tag("h2"))
        link = head.find(tag("a")) if head else None
        repo = (link.attrs.get("href", "").strip().lstrip("/")) if link else ""
        if not repo:
            continue
        foot, p = n.find(cls("f6")), n.find(tag("p"))
        text = lambda test: (lambda x: x.text() if x else "")(foot.find(test) if foot else None)
        parts = [("", text(lambda x: x.attrs.get("itemprop") == "programmingLanguage")), ("★ ", text(lambda x: x.tag == "a" and x.attrs.get("href", "").endswith("/stargazers"))), ("🍴 ", text(lambda x: x.tag == "a" and x.attrs.get("href", "").endswith("/forks"))), ("📈 ", text(lambda x: x.tag == "span" and re.search(r"stars?\s+today", x.text()) is not None))]
        out.append({"title": repo, "url": urljoin(base, "/" + repo), "excerpt": (p.text() if p else "")[:300], "authors": " · ".join(a + b for a, b in parts if b)})
    return out


PARSERS = {"current_issue": _rows(_issue), "notices": _rows(_notices), "contents": _rows(_contents), "trending": _rows(_trending)}


def page_rows(pages: DataFrame, parser: str) -> DataFrame:
    """(source_id, s_category, page, pos, title, url, date, issue, section, excerpt, doi, authors, published_at) of pages
    (source_id, html, s_url, s_category); the date is the row's own, else the issue's."""
    rows = pages.withColumn("page", F.monotonically_increasing_id()).select("source_id", "s_category", "page", F.posexplode(PARSERS[parser](c("html"), c("s_url"))).alias("pos", "r"))
    return rows.select("source_id", "s_category", "page", "pos", "r.*").withColumn("published_at", F.coalesce(dates.numeric(c("date")), dates.numeric(c("issue"))))


_ROUTE = ("category", "content_type", "document_type")


def _route(*values: str) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(_ROUTE, values, strict=True)])


def notice_route(title: Column, allowed: str = rules.NOTICE_ALLOWED, rejected: str = rules.NOTICE_REJECTED) -> Column:
    """struct(category, content_type, document_type) of a notice's title; null if it isn't one of ours."""
    hit = lambda p: rx.matches(title, p, ignore_case=False)
    out = F.when(hit("手术|并发症"), _route("finance", "complication_prevention", "education")).when(hit("指南解读"), _route("tech", "guideline_interpretation", "guideline"))
    out = out.when(hit("共识"), _route("tech", "consensus", "consensus")).when(hit("指南|规范"), _route("tech", "guideline", "guideline")).otherwise(_route("politics", "clinical_practice_recommendation", "news"))
    return F.when(hit(allowed) & ~hit(rejected), out)


def section_route(section: Column, title: Column, allowed: str = rules.SECTION_ALLOWED, rejected: str = rules.SECTION_REJECTED) -> Column:
    """The same for a journal's section; neither it nor the title may be of a rejected kind."""
    out = F.when(section == "述评", _route("politics", "expert_commentary", "news")).when(section.isin("专家共识", "共识解读"), _route("tech", "consensus", "consensus"))
    out = out.when(section.contains("解读"), _route("tech", "guideline_interpretation", "guideline")).otherwise(_route("tech", "guideline", "guideline"))
    return F.when(rx.matches(section, allowed, ignore_case=False) & ~rx.matches(F.concat_ws(" ", section, title), rejected, ignore_case=False), out)
