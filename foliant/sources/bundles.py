"""Bundles: one JSON with a document's Markdown and manifest; and text files of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from ..operators.chapters import flattened

SCHEMA = "foliant/1"


def bundle(markdown: Column, manifest: Column) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit("bundle").alias("kind"), markdown.alias("markdown"), manifest.alias("manifest")))


def read_bundles(raw: DataFrame, text: str = "raw", least: int = 20) -> DataFrame:
    """`raw` with code (null for a good bundle) and its markdown and manifest."""
    get = lambda path: F.get_json_object(text, path)
    bad = F.when(F.try_parse_json(text).isNull(), "BUNDLE_INVALID").when(~get("$.schema").eqNullSafe(SCHEMA) | ~get("$.kind").eqNullSafe("bundle"), "BUNDLE_INVALID").when(F.coalesce(F.char_length(get("$.markdown")), F.lit(0)) < least, "BUNDLE_INVALID")
    return raw.withColumns({"code": bad, "markdown": get("$.markdown"), "manifest": get("$.manifest")})


def outline(rows: DataFrame, key: str, manifest: str = "manifest", least: int = 1) -> DataFrame:
    """key, n, depth, title, level, page_start, page_end: the nested outline in document order, however deep; documents
    with fewer than `least` headings have none."""
    own = rows.select(key, F.get_json_object(manifest, "$.outline").alias("_outline"))
    out = flattened(own, key, "_outline", {"title": "string", "level": "long", "page_start": "long", "page_end": "long"})
    return out.withColumn("_all", F.count("*").over(Window.partitionBy(key))).filter(F.col("_all") >= least).drop("_all")


class PageTextSource(DataSource):
    """Pages of a text file parted by form feeds: `format("page_text")` with `path`; filters on page are pushed down."""

    @classmethod
    def name(cls):
        return "page_text"

    def schema(self):
        return "page bigint, text string"

    def reader(self, schema):
        return PageTextReader(self.options["path"])


class PageTextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.first, self.last = path, 1, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("page",):
                if isinstance(f, EqualTo):
                    self.first, self.last = max(self.first, f.value), f.value if self.last is None else min(self.last, f.value)
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.first = max(self.first, f.value)
                    continue
                if isinstance(f, LessThanOrEqual):
                    self.last = f.value if self.last is None else min(self.last, f.value)
                    continue
            yield f

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open(self.path, encoding="utf-8") as f:
            page, held = 1, []
            for line in f:
                *full, rest = line.split("\f")
                for piece in full:
                    held.append(piece)
                    if page >= self.first:
                        yield page, "".join(held)
                    page, held = page + 1, []
                    if self.last is not None and page > self.last:
                        return
                held.append(rest)
            if page >= self.first and any(held):
                yield page, "".join(held)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageTextSource)


def page_range(value: Column) -> Column:
    """first and last (null for open) of "12", "3-40", "10-" and ""."""
    first = F.try_to_number(F.nullif(F.regexp_extract(value, r"^\s*([0-9]+)", 1), F.lit("")), F.lit("999999999")).cast("long")
    last = F.nullif(F.regexp_extract(value, r"-\s*([0-9]+)\s*$", 1), F.lit("")).cast("long")
    return F.struct(F.coalesce(first, F.lit(1)).alias("first"), F.when(value.contains("-"), last).otherwise(first).alias("last"))


def write_outputs(rows: DataFrame, folder: str) -> None:
    """Writes doc, markdown, manifest as Markdown, JSON and bundles below `folder`, by document."""
    by_doc = rows.withColumn("part", F.col("doc"))
    by_doc.select("part", F.col("markdown").alias("value")).write.partitionBy("part").text(f"{folder}/markdown", lineSep="\n")
    by_doc.select("part", F.col("manifest").alias("value")).write.partitionBy("part").text(f"{folder}/manifest")
    by_doc.select("part", bundle(F.col("markdown"), F.col("manifest")).alias("value")).write.partitionBy("part").text(f"{folder}/bundle")
