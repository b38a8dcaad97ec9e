"""Provider result pages to flat hit rows, and the global hit ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.ordered import running_sum

JSON_PAGE = """response struct<docs: array<struct<
  bibcode: string, id: string, title: array<string>, author: array<string>, date: string, pubdate: string,
  doi: array<string>, identifier: array<string>, pub: string, property: array<string>, doctype: string,
  alternate_bibcode: array<string>, metadata_mtime: string, abstract: string>>>"""

ATOM_PAGE = """entry array<struct<
  id: string, published: string, updated: string, title: string, summary: string,
  author: array<struct<name: string>>, doi: string, journal_ref: string>>"""


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files as ``(page_file, body)``, one row per file."""
    return (spark.read.option("wholetext", True).text(path)
            .select(F.col("_metadata.file_name").alias("page_file"), F.col("value").alias("body")))


def json_hits(pages: DataFrame) -> DataFrame:
    """Hits of JSON pages ``(query, page, body)``: one row per document with its position in the page."""
    docs = pages.select("query", "page", F.posexplode(F.from_json("body", JSON_PAGE)["response"]["docs"]).alias("pos", "d"))
    d = lambda f: F.col(f"d.{f}")
    abstract = F.coalesce(d("abstract"), F.lit(""))
    return docs.select(
        "query", "page", "pos", F.lit("ADS_SCIX").alias("source"),
        F.coalesce(d("bibcode"), d("id")).alias("record_id"),
        squeeze(F.try_element_at(d("title"), F.lit(1))).alias("title"),
        F.to_json(F.coalesce(d("author"), F.array().cast("array<string>"))).alias("authors"),
        F.coalesce(d("date"), d("pubdate"), F.lit("")).alias("source_date"),
        F.to_json(F.coalesce(d("doi"), F.array().cast("array<string>"))).alias("doi"),
        F.coalesce(d("pub"), F.lit("")).alias("pub"),
        (abstract != "").alias("abstract_available"),
        F.when(abstract != "", F.sha2(abstract, 256)).otherwise("").alias("abstract_sha256"),
        F.concat(F.lit("response.docs["), F.col("pos").cast("string"), F.lit("]")).alias("locator"))


def atom_hits(pages: DataFrame) -> DataFrame:
    """Hits of Atom pages ``(query, page, body)``; namespace prefixes are not part of the field names."""
    body = F.regexp_replace("body", r"<(/?)[a-z]+:", "<$1")
    rows = pages.select("query", "page", F.posexplode(F.from_xml(body, ATOM_PAGE)["entry"]).alias("pos", "e"))
    e = lambda f: F.coalesce(F.col(f"e.{f}"), F.lit(""))
    return rows.select(
        "query", "page", "pos", F.lit("ARXIV").alias("source"),
        F.element_at(F.split(e("id"), "/"), -1).alias("record_id"), squeeze(e("title")).alias("title"),
        F.to_json(F.transform(F.coalesce(F.col("e.author"), F.array().cast("array<struct<name:string>>")),
                              lambda a: F.coalesce(a["name"], F.lit("")))).alias("authors"),
        e("published").alias("source_date"), e("doi").alias("doi"), squeeze(e("journal_ref")).alias("pub"),
        (e("summary") != "").alias("abstract_available"),
        F.when(e("summary") != "", F.sha2(e("summary"), 256)).otherwise("").alias("abstract_sha256"),
        F.concat(F.lit("feed/entry["), (F.col("pos") + 1).cast("string"), F.lit("]")).alias("locator"))


def ledger(hits: DataFrame, prefix: str = "H", width: int = 6) -> DataFrame:
    """Rank per query over its pages in order, and a global id over all queries in order.

    Only the page table is ordered: page sizes give each page its offset, and a hit's rank is
    that offset plus its position, so no hit is sorted.
    """
    sizes = hits.groupBy("query", "page").agg(F.count(F.lit(1)).alias("_n"))
    sizes = running_sum(sizes, ["query"], [F.col("page")], {"_in_query": F.col("_n")})
    sizes = running_sum(sizes, [], [F.col("query"), F.col("page")], {"_in_all": F.col("_n")})
    out = hits.join(sizes, ["query", "page"])
    at = lambda c: F.col(c) - F.col("_n") + F.col("pos") + 1
    number = at("_in_all").cast("string")
    ident = F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(width), F.length(number)), "0"))
    return out.withColumns({"source_rank": at("_in_query"), "raw_hit_id": ident}).drop("_n", "_in_query", "_in_all")


def receipt_check(receipts: DataFrame, hits: DataFrame) -> DataFrame:
    """Reported against actual rows per query, first and last record, COMPLETE or PARTIAL."""
    got = hits.groupBy("query").agg(
        F.count(F.lit(1)).alias("actual"), F.min_by("record_id", "source_rank").alias("first_record"),
        F.max_by("record_id", "source_rank").alias("last_record"))
    out = receipts.join(got, "query", "left")
    actual = F.coalesce("actual", F.lit(0).cast("bigint"))
    return out.select("query", "reported", actual.alias("actual"), F.coalesce("first_record", F.lit("")).alias("first_record"),
                      F.coalesce("last_record", F.lit("")).alias("last_record"),
                      F.when(F.col("reported") == actual, "COMPLETE").otherwise("PARTIAL").alias("state"))
