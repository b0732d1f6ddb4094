"""Parsers as table functions with a schema declared once.

For SQL's ``LATERAL`` one text in, its rows out; Spark 4.1 has no lateral join
with Arrow table functions, so those take a whole table as their argument.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

_ITEM = {"item": re.compile(r"(?s)<item\b.*?</item>"), "entry": re.compile(r"(?s)<entry\b.*?</entry>")}
_BODY = re.compile(r"(?is)<(h[1-6]|p|li|a|span|title)\b[^>]*>(.*?)</")
_MARKUP, _BLANK = re.compile(r"(?s)<[^>]*>"), re.compile("[ \\t\\n\\x0B\\f\\r]+")

FEED = "at timestamp, headline string, url string"
TEXTS = "place int, tag string, text string"


def _inner(block: str, *names: str) -> str | None:
    for name in names:
        m = re.search(rf"(?s)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", block)
        if m and m[1].strip():
            return html.unescape(m[1].strip())
    return None


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            at = read(text)
        except ValueError:
            continue
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    return None


def feed_rows(text: str | None) -> list[tuple[datetime | None, str, str | None]]:
    """RSS items, or Atom entries where there are none, that have a headline; what is no feed has no rows."""
    blocks = _ITEM["item"].findall(text or "") or _ITEM["entry"].findall(text or "")
    out = []
    for b in blocks:
        headline, href = _inner(b, "title"), re.search(r'<link[^>]*href="([^"]*)"', b)
        if headline:
            out.append((_time(_inner(b, "pubDate", "updated", "published")), headline, _inner(b, "link") or (html.unescape(href[1]) if href else None)))
    return out


def text_rows(page: str | None, least: int = 20, most: int = 500) -> list[tuple[int, str, str]]:
    """Headline-like texts of a page as ``files.html_texts`` has them, each once, with its place and element."""
    seen: dict[str, tuple[int, str]] = {}
    for k, m in enumerate(_BODY.finditer(page or "")):
        text = _BLANK.sub(" ", _MARKUP.sub(" ", m[2])).strip(" ")
        if least <= len(text) <= most:
            seen.setdefault(text, (k, m[1].lower()))
    return [(k, tag, text) for text, (k, tag) in seen.items()]


@udtf(returnType=FEED)
class FeedItems:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from feed_rows(text)


@udtf(returnType=TEXTS)
class PageTexts:
    def eval(self, page: str) -> Iterator[tuple]:
        yield from text_rows(page)


@arrow_udtf(returnType=f"key long, {TEXTS}")
class PageTextsOf:
    """Of a whole table of (key, page): batches in, batches out."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in text_rows(t)]
        kinds = {"key": pa.int64(), "place": pa.int32(), "tag": pa.string(), "text": pa.string()}
        yield pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def register(spark: SparkSession) -> None:
    """``feed_items(text)`` and ``page_texts(html)`` for ``LATERAL``, ``page_texts_of(TABLE(key, html))`` for whole tables."""
    spark.udtf.register("feed_items", FeedItems)
    spark.udtf.register("page_texts", PageTexts)
    spark.udtf.register("page_texts_of", PageTextsOf)
