"""Sources: files of the shapes that the feeds use, as typed long tables.

Adapters are a schema and a projection; files are read by Spark only, so any
store that Spark reads will do. Nothing here needs a network. A source that
is missing yields an empty table of the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = T.StructType([T.StructField("date", T.DateType()), T.StructField("series", T.StringType()), T.StructField("value", T.DoubleType())])


def empty(spark: SparkSession, schema: T.StructType = SERIES) -> DataFrame:
    return spark.createDataFrame([], schema)


def or_empty(read, spark: SparkSession, schema: T.StructType = SERIES) -> DataFrame:
    """The source, or an empty table if its path doesn't exist."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty(spark, schema)


def wide_csv(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """A CSV of one date and many series columns, melted; blanks, dots and words become null and drop out."""
    wide = spark.read.option("header", True).csv(path)
    series = [c for c in wide.columns if c != date]
    long = wide.select(F.col(date).try_cast("date").alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in series]).unpivot(["date"], series, "series", "value")
    return long.where(F.col("date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def preamble_csv(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """A text file whose table begins after a line with ``marker``; the next line names the columns.

    Each file's lines are numbered by a window over that one file.
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    begin = lines.where(F.col("value").contains(marker)).groupBy("file").agg(F.min("at").alias("begin"))
    body = lines.join(F.broadcast(begin), "file").where("at > begin and trim(value) != ''")
    header = body.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("first"))
    rows = body.join(F.broadcast(header), "file").where("at > first")
    names, cells = F.split("header", ","), F.split("value", ",")
    cleaned = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    long = rows.select(cleaned(cells[0]).try_cast("date").alias("date"), F.posexplode(F.zip_with(names, cells, lambda n, v: F.struct(cleaned(n).alias("series"), cleaned(v).alias("v")))).alias("k", "cell"))
    return long.where("k > 0").select("date", "cell.series", F.col("cell.v").try_cast("double").alias("value")).where("date is not null and value is not null")


def json_observations(spark: SparkSession, path: str, array: str, date: str, value: str, series: Column) -> DataFrame:
    """Documents with an array of {date, value} objects (strings or numbers), exploded."""
    schema = f"struct<{array}: array<struct<`{date}`: string, `{value}`: string>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"), F.col("_metadata.file_name").alias("file"))
    rows = docs.select(F.explode(f"d.{array}").alias("o"), "file")
    return rows.select(F.col(f"o.{date}").try_cast("date").alias("date"), series.alias("series"), F.col(f"o.{value}").try_cast("double").alias("value")).where("date is not null and value is not null")


def sdmx_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """Observations keyed by position, with the positions' dates in the structure: zipped by index."""
    schema = "struct<dataSets: array<struct<series: map<string, struct<observations: map<string, array<double>>>>>>, structure: struct<dimensions: struct<observation: array<struct<values: array<struct<id: string>>>>>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    one = d.select(F.explode("d.dataSets").alias("s"), F.col("d.structure.dimensions.observation")[0]["values"].alias("dates"))
    obs = one.select(F.explode("s.series").alias("k", "v"), "dates").select(F.explode("v.observations").alias("i", "o"), "dates")
    return obs.select(F.try_element_at("dates", F.col("i").cast("int") + 1)["id"].try_cast("date").alias("date"), F.lit(series).alias("series"), F.col("o")[0].alias("value")).where("date is not null and value is not null")


def sdmx_csv(spark: SparkSession, path: str) -> DataFrame:
    """TIME_PERIOD and OBS_VALUE by KEY."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("TIME_PERIOD").try_cast("date").alias("date"), F.col("KEY").alias("series"), F.col("OBS_VALUE").try_cast("double").alias("value")).where("date is not null and value is not null")


def first_of(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has a key, with its number as provenance."""
    all_ = None
    for k, s in enumerate(sources):
        s = s.withColumn("source", F.lit(k))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("source")
    return all_.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def nearest_tenor(df: DataFrame, keys: list[str], tenor: str, value: str, wanted: list[float], tolerance: float = 0.5) -> DataFrame:
    """For each key and wanted tenor the value of the nearest one within ``tolerance``; ties to the shorter."""
    j = df.select(*keys, tenor, value, F.explode(F.array(*[F.lit(w) for w in wanted])).alias("wanted")).where(F.abs(F.col(tenor) - F.col("wanted")) <= tolerance)
    return j.where(F.col(value).isNotNull()).groupBy(*keys, "wanted").agg(F.min_by(value, F.struct(F.abs(F.col(tenor) - F.col("wanted")), F.col(tenor))).alias(value))


#: The six futures contracts, their tenor, face value and yield series.
CONTRACTS = [("TU", 1.9, 200000.0, "DGS2"), ("FV", 4.3, 100000.0, "DGS5"), ("TY", 6.8, 100000.0, "DGS10"), ("TN", 9.2, 100000.0, "DGS10"), ("US", 15.5, 100000.0, "DGS30"), ("UB", 19.5, 100000.0, "DGS30")]


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, "instrument string, tenor_years double, face_value double, yield string")


def net_positions(raw: DataFrame, keys: list[str], categories: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide long/short columns to one row a category: ``category, net``."""
    parts = [F.struct(F.lit(c).alias("category"), (F.col(a).try_cast("double") - F.col(b).try_cast("double")).alias("net")) for c, (a, b) in categories.items()]
    return raw.select(*keys, F.inline(F.array(*parts)))


_FORMATS = ["dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyyMMdd'T'HHmmss'Z'"]


def any_time(text: Column) -> Column:
    """A time in one of four formats (a weekday name is dropped first), or null."""
    text = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS])


def feed_items(docs: DataFrame, text: str, source: Column) -> DataFrame:
    """RSS 2.0 items, or Atom entries where there are none: ``ts, source, headline, url``."""
    def tag(x: Column, name: str) -> Column:
        inner = F.regexp_extract(x, rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
        return F.when(inner != "", F.trim(inner))

    items = F.regexp_extract_all(text, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))
    entries = F.regexp_extract_all(text, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))
    rows = docs.select(source.alias("source"), F.explode(F.when(F.size(items) > 0, items).otherwise(entries)).alias("x"))
    href = F.regexp_extract("x", r'<link[^>]*href="([^"]*)"', 1)
    when = F.coalesce(tag(F.col("x"), "pubDate"), tag(F.col("x"), "updated"), tag(F.col("x"), "published"))
    return rows.select(any_time(when).alias("ts"), "source", tag(F.col("x"), "title").alias("headline"), F.coalesce(tag(F.col("x"), "link"), F.when(href != "", href)).alias("url")).where("headline is not null")


def news(sources: list[DataFrame]) -> DataFrame:
    """Union, complete rows, one a fingerprint of url or headline (the earliest)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    out = out.dropna(subset=["ts", "headline"]).withColumn("id", F.md5(F.coalesce("url", "headline")))
    return keep_one(out, ["id"], [F.col("ts"), F.col("source"), F.col("headline")])


def html_texts(pages: DataFrame, html: str, least: int = 20, most: int = 500) -> DataFrame:
    """Headline-like texts of pages: element bodies without tags, within length bounds, distinct a page."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<(?:h[1-6]|p|li|a|span|title)\b[^>]*>(.*?)</"), F.lit(1))
    clean = F.transform(bodies, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return pages.withColumn("texts", F.array_distinct(F.filter(clean, lambda t: F.length(t).between(least, most))))


def speaker_segments(docs: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """Paragraphs with the last speaker named before them: ``key, segment, speaker, text, words``."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n")).alias("segment", "t")).where("trim(t) != ''")
    named = F.regexp_extract("t", r"^([A-Z][\w .'-]{1,60}):\s", 1)
    w = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    s = parts.withColumn("speaker", F.last(F.when(named != "", named), ignorenulls=True).over(w)).withColumn("text", F.regexp_replace("t", r"^[A-Z][\w .'-]{1,60}:\s+", ""))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return s.withColumn("words", words).where(F.col("words") >= least).select(key, "segment", "speaker", "text", "words")


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cached(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """A table if it is there and ``force`` isn't set, else made, written and read."""
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
