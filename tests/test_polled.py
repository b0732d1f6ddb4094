"""Table functions against the column versions, and the polled source over fall-backs, unfinished cycles and restarts."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from tidalframe.sources import files, polled, tables
from tidalframe.streaming import feeds

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title><![CDATA[{0} &amp; more]]></title><link>http://x/{0}</link><pubDate>Mon, 27 Jul 2026 09:0{1}:00 +0000</pubDate></item>"
ATOM = '<feed><entry><title>{0}</title><link href="http://y/{0}"/><updated>2026-07-27T10:00:00Z</updated></entry></feed>'


def test_feed_rows():
    got = tables.feed_rows(RSS.format(ITEM.format("a", 1) + "<item><title></title></item>"))
    assert got == [(dt.datetime(2026, 7, 27, 9, 1, tzinfo=dt.UTC), "a & more", "http://x/a")]
    assert tables.feed_rows(ATOM.format("b")) == [(dt.datetime(2026, 7, 27, 10, tzinfo=dt.UTC), "b", "http://y/b")]
    assert tables.feed_rows(None) == tables.feed_rows("<html>no feed") == [] and tables.feed_rows("<item><title>t</title><pubDate>soon</pubDate></item>") == [(None, "t", None)]


def test_lateral_table_functions(spark):
    tables.register(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<p>one text that is long enough</p><h1>one text that is long enough</h1>")], "page_id long, html string"))
    pages.createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT p.page_id, t.place, t.tag, t.text FROM some_pages AS p, LATERAL page_texts(p.html) AS t").collect()
    want = files.html_texts(pages, "html").select("page_id", F.explode("texts").alias("text")).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((r.page_id, r.text) for r in want) and len(got) > 50
    assert [(r.place, r.tag) for r in got if r.page_id == -3] == [(0, "p")]
    arrow = spark.sql("SELECT * FROM page_texts_of(TABLE(SELECT page_id, html FROM some_pages))").collect()
    assert Counter(tuple(r) for r in arrow) == Counter(tuple(r) for r in got)
    spark.createDataFrame([(1, RSS.format(ITEM.format("a", 1) + ITEM.format("b", 2))), (2, "none"), (3, ATOM.format("c"))], "k int, body string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT b.k, f.headline, f.url, date_format(f.at, 'HH:mm') AS t FROM bodies AS b, LATERAL feed_items(b.body) AS f").collect()
    assert {tuple(r) for r in rows} == {(1, "a & more", "http://x/a", "09:01"), (1, "b & more", "http://x/b", "09:02"), (3, "c", "http://y/c", "10:00")}


def put(root: Path, source: str, cycle: int, done: bool = True, **answers: str) -> None:
    folder = root / source / f"{cycle:06d}"
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in answers.items():
        (folder / f"{name}.xml").write_text(text)
    if done:
        (folder / "_DONE").touch()


def test_polled_source(spark, tmp_path):
    polled.register(spark)
    root = tmp_path / "feeds"
    feed = lambda *names: RSS.format("".join(ITEM.format(n, 1) for n in names))
    stream = lambda: spark.readStream.format("polled_feeds").option("path", str(root)).option("endpoints", "main, spare").load()
    run = lambda: Counter((r.source, int(r.cycle), r.endpoint, r.headline[0]) for r in feeds.run_once(stream(), f"{tmp_path}/out", f"{tmp_path}/ck").collect())
    put(root, "wire", 1, main=feed("a", "b"), spare=feed("z"))
    put(root, "wire", 2, main="<html>moved", spare=feed("c"))
    put(root, "desk", 1, other=feed("d"))
    put(root, "wire", 3, done=False, main=feed("e"))
    first = run()
    assert first == Counter([("wire", 1, "main.xml", "a"), ("wire", 1, "main.xml", "b"), ("wire", 2, "spare.xml", "c"), ("desk", 1, "other.xml", "d")])
    # A restart from the checkpoint: nothing again, and what was finished since, once.
    put(root, "wire", 3)
    put(root, "wire", 4, main="", spare="")
    put(root, "wire", 5, main=feed("f"))
    put(root, "late", 1, main=feed("g"))
    second = run()
    assert second == first + Counter([("wire", 3, "main.xml", "e"), ("wire", 5, "main.xml", "f"), ("late", 1, "main.xml", "g")])
    assert run() == second
