"""Readers of files and pages, with the checks a load makes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quoted line breaks and doubled quotes; an optional byte-order mark goes. A quoted empty string is a value, an unquoted one null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", nullValue="\u0000", emptyValue="", enforceSchema=True)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A database table in key ranges that are read at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


def manifest_violations(docs: DataFrame, key: str, kind: str, declared: Mapping[str, int]) -> DataFrame:
    """(kind, problem): kinds whose row count is not the declared one, and '' for ids that repeat."""
    spark = docs.sparkSession
    told = spark.createDataFrame(sorted(declared.items()), "kind string, declared long")
    have = docs.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("measured"))
    counts = told.join(have, "kind", "full_outer").where(~F.coalesce("declared", F.lit(0)).eqNullSafe(F.coalesce("measured", F.lit(0)))).select("kind", F.lit("count").alias("problem"))
    repeated = docs.groupBy(key).count().where("count > 1").limit(1).select(F.lit("").alias("kind"), F.lit("repeated id").alias("problem"))
    return counts.unionByName(repeated)


class _Page(HTMLParser):
    """Title, links and visible text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.parts, self.hidden, self.in_title = "", [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.in_title |= tag == "title"
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden and data.strip():
            self.parts.append(data.strip())


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, links, text of each row (page_id, html); a null page has none of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for html in pdf["html"]:
                p = _Page()
                p.feed(html or "")
                p.close()
                rows.append((p.title, p.links, " ".join(p.parts)))
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [r[0] for r in rows], "links": [r[1] for r in rows], "text": [r[2] for r in rows]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, links array<string>, text string")
