"""Article bodies and link lists from HTML: the stdlib parser in mapInPandas, right after the scan; cleaning is built-in."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Containers that hold an article, in order of preference.
CONTAINERS = (("tag", "article"), ("id", "UCAP-CONTENT"), ("class", "TRS_Editor"), ("class", "pages_content"), ("class", "article-content"), ("class", "content_area"), ("tag", "main"))
# List entries that a page's script holds, and days as addresses and lists write them.
LIST_SCRIPT = r"""var\s+curHref\s*=\s*['"]([^'"]+)['"][\s\S]{0,420}?var\s+curTitle\s*=\s*['"]([^'"]+)['"]"""
DAY_PATTERNS = (r"20[0-9]{6}", r"20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Page(HTMLParser):
    """Text of the containers and their paragraphs, structured data, meta fields and links of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[int]]] = []
        self.text: dict[int, list[str]] = {}
        self.paragraphs: dict[int, list[str]] = {}
        self.open_p: list[list] = []
        self.meta: dict[str, str] = {}
        self.ld: list[str] = []
        self.script: list[str] | None = None
        self.skip = 0
        self.links: list[list] = []  # address, text, pieces of the text of the element around it
        self.link: list | None = None
        self.words: list[list[str]] = [[]]  # text of the open elements, that of the page first

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            if key and a.get("content"):
                self.meta.setdefault(key, a["content"])
        if tag in VOID:
            return
        if tag in ("script", "style", "noscript"):
            self.skip += 1
            self.script = [] if tag == "script" and a.get("type") == "application/ld+json" else None
        if tag == "a":
            self.link = [a.get("href", ""), "", self.words[-1]]
            self.links.append(self.link)
        classes = a.get("class", "").split()
        found = [i for i, (k, v) in enumerate(CONTAINERS) if (k == "tag" and tag == v) or (k == "id" and a.get("id") == v) or (k == "class" and v in classes)]
        mine = []
        for i in found:
            if i not in self.text:  # the first of its kind counts
                self.text[i], self.paragraphs[i] = [], []
                mine.append(i)
        self.stack.append((tag, mine))
        self.words.append([])
        if tag == "p":
            inside = [i for _, m in self.stack for i in m]
            self.open_p.append([inside, []])

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            own = "".join(self.words.pop())
            self.words[-1].append(own)
            if t in ("script", "style", "noscript"):
                self.skip = max(0, self.skip - 1)
                if self.script is not None:
                    self.ld.append("".join(self.script))
                    self.script = None
            if t == "a":
                self.link = None
            if t == "p" and self.open_p:
                inside, words = self.open_p.pop()
                for i in inside:
                    self.paragraphs[i].append("".join(words))
            if t == tag:
                return

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        if self.skip:
            return
        self.words[-1].append(data)
        for _, mine in self.stack:
            for i in mine:
                self.text[i].append(data)
        for p in self.open_p:
            p[1].append(data)
        if self.link is not None:
            self.link[1] += data


def bodies(value, out: list[str]) -> list[str]:
    """Every articleBody in structured data."""
    if isinstance(value, list):
        for v in value:
            bodies(v, out)
    elif isinstance(value, dict):
        if isinstance(value.get("articleBody"), str):
            out.append(value["articleBody"])
        for v in value.values():
            bodies(v, out)
    return out


def squeeze(s: str) -> str:
    return " ".join(s.split())


def parse_page(html: str, url: str) -> tuple[str, str, str]:
    """(article text, meta description, meta image) of a page; text under 40 characters does not count."""
    page = Page()
    try:
        page.feed(html or "")
        page.close()
    except Exception:  # a broken page counts as far as it was read
        pass
    texts: list[str] = []
    for raw in page.ld:
        try:
            texts += [t for b in bodies(json.loads(raw), []) if len(t := squeeze(b)) >= 40]
        except ValueError:
            continue
    if not texts and page.text:
        i = min(page.text)
        texts = [t for p in page.paragraphs[i] if len(t := squeeze(p)) >= 40]
        whole = squeeze("".join(page.text[i]))
        texts = texts or ([whole] if len(whole) >= 40 else [])
    pick = lambda *names: next((page.meta[n] for n in names if n in page.meta), "")
    image = pick("og:image", "twitter:image", "twitter:image:src")
    return " ".join(texts), squeeze(pick("og:description", "twitter:description", "description")), urljoin(url or "", image) if image else ""


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, article, description, image) of each page (page_id, url, html). Html is wide, so it goes no further."""

    def run(batches):
        for pdf in batches:
            found = [parse_page(h, u) for h, u in zip(pdf["html"], pdf["url"], strict=True)]
            yield pdf[["page_id", "url"]].assign(article=[f[0] for f in found], description=[f[1] for f in found], image=[f[2] for f in found])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, article string, description string, image string")


def clean_excerpt(c):
    """An excerpt without leading commas and a trailing date; empty under 20 characters or if it is a date only."""
    t = T.trim_ws(F.regexp_replace(F.regexp_replace(T.clean_text(c), "^,+", ""), r",?\s*20\d{2}[-/]\d{1,2}[-/]\d{1,2}\s*$", ""))
    return F.when(F.length(t) >= 20, t).otherwise("")


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, canonical url, body_text (up to 8000 characters), content_excerpt (500), image_url and where they came from."""
    p = parse_pages(pages)
    full = T.first_filled(F.col("article"), F.col("description"), F.lit(""))
    p = p.withColumn("__full", full)
    excerpt = clean_excerpt(T.truncate_text(F.col("__full"), 500))
    p = p.withColumn("content_excerpt", excerpt)
    source = F.when(F.col("content_excerpt") == "", "none").when(F.col("article") != "", "article").otherwise("meta")
    image = T.https_image(F.col("image"))
    return p.select("page_id", T.canonical_url(F.col("url")).alias("url"), T.truncate_text(F.col("__full"), 8000).alias("body_text"), "content_excerpt", image.alias("image_url"), source.alias("excerpt_source"), F.when(image != "", "meta").otherwise("none").alias("image_source"))


def day_in(text: str) -> str:
    """The first day that a text writes, without separators if there is one such."""
    return next((m[0] for p in DAY_PATTERNS if (m := re.search(p, text))), "")


def extract_page_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, title, link, published_at) of a list page's anchors and then of the entries in its scripts, addresses being absolute; each
    title and link once. An anchor's day is the first one in its address or in the text of the element around it."""

    def run(batches):
        import pandas as pd

        script = re.compile(LIST_SCRIPT)
        for pdf in batches:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                page = Page()
                try:
                    page.feed(html or "")
                except Exception:  # a broken page gives the links read so far
                    pass
                while page.stack:  # elements left open end with the page
                    page.handle_endtag(page.stack[-1][0])
                around: dict[int, str] = {}  # day of each element's text, searched once
                found = []
                for href, words, near in page.links:
                    if id(near) not in around:
                        around[id(near)] = day_in("".join(near))
                    link = urljoin(url or "", href)
                    own = day_in(link)
                    found.append((squeeze(words), link, own if len(own) == 8 else next((d for d in (around[id(near)],) if len(d) == 8), own or around[id(near)])))
                for href, words in script.findall(html or ""):
                    link = urljoin(url or "", href)
                    found.append((squeeze(words), link, day_in(link)))
                seen = set()
                for i, (title, link, day) in enumerate(found):
                    if (title, link) not in seen:
                        seen.add((title, link))
                        rows.append((pid, i, title, link, day))
            yield pd.DataFrame(rows, columns=["page_id", "ord", "title", "link", "day"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, ord int, title string, link string, day string")
    return found.withColumn("published_at", T.date_in_text(F.col("day"))).drop("day")


def enrich_items(items: DataFrame, articles: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Items with the body of their page: success, failed where there is no page, disabled where the source says so. Feed excerpts and
    images stand in for missing ones."""
    a = articles.groupBy("url").agg(F.min_by(F.struct("body_text", "content_excerpt", "image_url"), "page_id").alias("__a")).where("url <> ''")
    df = items.withColumn("__u", T.canonical_url(F.col("url"))).join(a.withColumnRenamed("url", "__u"), "__u", "left").drop("__u")
    if sources is not None:
        df = df.join(sources.select("source_id", F.col("enrichment_enabled").alias("__on")), "source_id", "left")
    off = ~F.coalesce(F.col("__on"), F.lit(True)) if sources is not None else F.lit(False)
    got = F.col("__a").isNotNull() & ~off
    feed = lambda c: T.truncate_text(T.column_or(items, c, None, "string"), 500)
    own = T.first_filled(feed("content_excerpt"), feed("summary"), F.lit(""))
    fill = lambda c, other: F.when(got, T.first_filled(F.col(f"__a.{c}"), other)).otherwise(other)
    df = df.withColumns({"body_fetch_status": F.when(off, "disabled").when(got, "success").otherwise("failed"), "body_text": F.when(got, F.coalesce("__a.body_text", own)), "content_excerpt": fill("content_excerpt", own), "image_url": fill("image_url", T.https_image(T.column_or(items, "image_url", None, "string")))})
    return df.drop("__a", "__on")


def enrichment_candidates(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with an address whose source, found by id or else by name, allows bodies to be had."""
    by_id = sources.select("source_id", F.col("enrichment_enabled").alias("__a"))
    by_name = sources.groupBy(F.col("name").alias("source")).agg(F.min("enrichment_enabled").alias("__b"))
    df = items.join(by_id, "source_id", "left").join(by_name, "source", "left")
    return df.where((T.text_or_empty(F.col("url")) != "") & F.coalesce("__a", "__b", F.lit(True))).drop("__a", "__b")
