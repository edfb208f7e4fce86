"""Importing trees of Markdown and HTML files: text, links, and the page tree that the paths imply."""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Elements that end a line of text.
BLOCK_TAGS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "pre", "section"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.skip, self.heading = [], [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])
        if tag in ("title", "h1"):
            self.heading = not self.title
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("title", "h1"):
            self.heading = False
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.heading:
            self.title.append(data)
        self.parts.append(data)


def parse_html(source: str) -> tuple[str, str, list[str]]:
    """(title, text, links)"""
    p = _Text()
    p.feed(source)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    return " ".join("".join(p.title).split()), "\n".join(x for x in lines if x), p.links


def parse_markdown(source: str) -> tuple[str, str, list[str]]:
    """(title, text, links); the text is the Markdown itself, from which chunks are made."""
    first = re.search(r"(?m)^#\s+(.+?)\s*$", source)
    return (first[1] if first else ""), source, re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s]+)", source)


def resolve_link(path: str, href: str) -> str | None:
    """The imported path that a relative link of a file points at; None for links that leave the tree."""
    target = unquote(html.unescape(href)).split("#")[0].split("?")[0]
    if not target or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:|//", target):
        return None
    out = posixpath.normpath(posixpath.join("" if target.startswith("/") else posixpath.dirname(path), target.lstrip("/")))
    return None if out.startswith("..") else out


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source): all Markdown and HTML files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,html}").load(folder)
    root = folder.rstrip("/")
    return files.select(F.regexp_replace("path", f"^(file:)?/*{re.escape(root.lstrip('/'))}/", "").alias("path"), F.decode("content", "UTF-8").alias("source"))


def parse_files(files: DataFrame) -> DataFrame:
    """(path, title, text, links): parsed by extension; links are resolved paths. Null sources are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, source in zip(rows.path, rows.source):
                title, text, links = (parse_html if path.endswith(".html") else parse_markdown)(source or "")
                found = dict.fromkeys(x for x in (resolve_link(path, h) for h in links) if x)
                out.append((path, title or posixpath.splitext(posixpath.basename(path))[0], text, list(found)))
            yield pd.DataFrame(out, columns=["path", "title", "text", "links"]).astype(object)

    return files.select("path", "source").mapInPandas(run, "path string, title string, text string, links array<string>")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def folder_placeholders(files: DataFrame) -> DataFrame:
    """(folder): folders above the files for which no file of the same name stands."""
    n = F.size(_parts(F.col("path")))
    above = files.where(n > 1).select(F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(_parts(F.col("path")), F.lit(1), i), "/"))).alias("folder")).distinct()
    own = files.select(F.regexp_replace("path", r"\.(md|html)$", "").alias("folder")).distinct()
    return above.join(own, "folder", "left_anti")


def page_tree(files: DataFrame) -> DataFrame:
    """(page, parent, level, position): pages and placeholders; the parent is the longest path above that is a page.

    A page's path is its file's without the extension; of a .md and a .html of one path the .md is the page.
    Siblings are in the order of their names, by bytes.
    """
    pages = files.select(F.regexp_replace("path", r"\.(md|html)$", "").alias("page")).union(folder_placeholders(files)).distinct()
    n = F.size(_parts(F.col("page")))
    up = pages.where(n > 1).select("page", F.explode(F.sequence(F.lit(1), n - 1)).alias("k")).withColumn("parent", F.array_join(F.slice(_parts(F.col("page")), F.lit(1), F.col("k")), "/"))
    best = up.join(pages.select(F.col("page").alias("parent")), "parent").groupBy("page").agg(F.max_by("parent", "k").alias("parent"), F.count("*").alias("level"))
    rows = pages.join(best, "page", "left").select("page", "parent", F.coalesce("level", F.lit(0)).alias("level"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy("page")))


def page_links(parsed: DataFrame) -> DataFrame:
    """(from_path, to_path): links to imported files, each once; links to files that weren't imported are dropped."""
    links = parsed.select(F.col("path").alias("from_path"), F.explode("links").alias("to_path"))
    return links.join(parsed.select(F.col("path").alias("to_path")), "to_path", "left_semi").select("from_path", "to_path").distinct()


def write_tree(pages: DataFrame, folder: str) -> None:
    """Texts as files under the first part of their paths, one folder for each space."""
    pages.select("space", "text").write.mode("overwrite").partitionBy("space").text(folder)
