"""Landed pages: replay of files, link classification and the two-step crawl (SRC1-SRC4, SRC14, SRC15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import provider_of
from .html import lateral

# Words that point to results and pages followed.
RESULT_WORDS = r"(?i)\b(results?|scores?|scoring|score ?sheets?|standings|placements)\b"
OTHER_RESULTS = r"(?i)(results?|scores?|scoring|score ?sheets?)"
MAX_PAGES, MAX_OTHER_LINKS = 3, 20


def replay(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: saved pages, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def land(spark: SparkSession, fetched: list[tuple[str, str, str, str]]) -> DataFrame:
    """Pages that someone else brought: (run_id, kind, url, html); kind tells full and second list apart.  ``fetch`` is the source for others."""
    return spark.createDataFrame(fetched, "run_id string, kind string, url string, html string")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def links(pages: DataFrame) -> DataFrame:
    """SRC14: url, ord, text, href of every link that leads to a page."""
    return lateral(pages, "html_links", "html", "url", keep=["url"])


def _home(starts: DataFrame, pages: DataFrame) -> DataFrame:
    return links(pages.join(starts.select("url").distinct(), "url", "left_semi")).withColumn("start", F.col("url"))


def followed(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """start, href, n: of each start page at most MAX_PAGES pages of the same host whose link or path speaks of results, in page order."""
    home = _home(starts, pages)
    same = (host(F.col("href")) == host(F.col("start"))) & ~F.lower("href").endswith(".pdf")
    speaks = F.col("text").rlike(RESULT_WORDS) | F.coalesce(F.try_parse_url("href", F.lit("PATH")), F.lit("")).rlike(RESULT_WORDS)
    once = home.where(same & speaks).groupBy("start", "href").agg(F.min("ord").alias("ord"))
    return once.withColumn("n", F.row_number().over(W.partitionBy("start").orderBy("ord"))).where(F.col("n") <= MAX_PAGES)


def crawl(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """SRC15: provider links and other result links found on sites.

    ``starts`` has the sites' addresses; ``pages`` are landed pages.  From a start page at most MAX_PAGES pages of
    the same host whose link or path speaks of results are followed, in page order.
    """
    home, chosen = _home(starts, pages), followed(pages, starts)
    inner = links(pages).join(chosen.select("start", F.col("href").alias("url"), "n").distinct(), "url")
    found = home.withColumn("n", F.lit(0)).unionByName(inner)
    scanned = chosen.select("start", "href").unionByName(starts.select(F.col("url").alias("start"), F.col("url").alias("href"))).distinct()
    kinds = found.withColumn("target", provider_of(F.col("href")))
    known = kinds.where("target IS NOT NULL").select("start", "target.provider", "target.key", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("href")).distinct()
    other = kinds.where(F.col("target").isNull() & (F.col("text").rlike(OTHER_RESULTS) | (F.lower("href").endswith(".pdf") & F.col("href").rlike(OTHER_RESULTS))))
    other = other.where(host(F.col("href")) != "").join(scanned, ["start", "href"], "left_anti")
    other = other.groupBy("start", "href").agg(F.min(F.struct("n", "ord", "text")).alias("at"))
    ranked = other.withColumn("k", F.row_number().over(W.partitionBy("start").orderBy("at.n", "at.ord"))).where(F.col("k") <= MAX_OTHER_LINKS)
    return known.unionByName(ranked.select("start", F.lit("other").alias("provider"), F.lit(None).cast("string").alias("key"), "at.text", "href"))


def is_sheet_link(url: Column, provider: Column) -> Column:
    """links that can be read; PDFs never, other endings only from provider 3."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return ~F.lower(path).endswith(".pdf") & ((provider == "wdr") | path.rlike(r"(?i)\.html?$"))
