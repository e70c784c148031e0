"""Substring search through postings of trigrams.

A text is known by its runs of three characters and where they stand.  A term lies in a text exactly if runs that cover the
term stand there at the same distances, so a search reads the postings of a few runs and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

SIZE = 3
#: Stands after a text, so that its last characters begin runs too.
END = "\x00"


def runs(text: Column) -> Column:
    """Array of (gram, pos) of a text; an empty or null one has none."""
    padded = F.concat(text, F.lit(END * (SIZE - 1)))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.substring(padded, i, F.lit(SIZE)).alias("gram"), i.alias("pos")))


def build(texts: DataFrame, path: str | None = None) -> DataFrame:
    """Postings (gram, kind, key, which, pos) of texts (kind, key, text), kept at ``path`` or in the shared folder.

    A key can have several texts, told apart by ``which``, a hash.
    They lie in ranges of grams and are sorted within them, so a search for given grams touches few files and, by their
    statistics, few row groups; a gram that very many texts have is cut by key.
    """
    path = path or new_folder(texts.sparkSession, "trigrams")
    order = ["gram", "kind", "key", "which", "pos"]
    once = texts.select("kind", F.col("key").cast("string").alias("key"), "text").distinct()
    each = once.select("kind", "key", F.xxhash64("text").alias("which"), F.inline(runs(F.col("text"))))
    each.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return opened(texts.sparkSession, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, kind string, key string, which long, pos int").parquet(path)


def cover(term: str) -> dict[str, list[int]]:
    """Runs that cover the term, each with its places: every third one and the last."""
    at = sorted({*range(0, len(term) - SIZE + 1, SIZE), len(term) - SIZE})
    found: dict[str, list[int]] = {}
    for i in at:
        found.setdefault(term[i : i + SIZE], []).append(i)
    return found


def find(postings: DataFrame, term: str) -> DataFrame:
    """kind, key of the texts that hold the term, which isn't empty."""
    if len(term) < SIZE:
        return postings.where(F.startswith("gram", F.lit(term))).select("kind", "key").distinct()
    wanted = cover(term)
    places = F.create_map(*(x for gram, at in wanted.items() for x in (F.lit(gram), F.array(*map(F.lit, at)))))
    met = postings.where(F.col("gram").isin(*wanted)).select("kind", "key", "which", "pos", F.explode(places[F.col("gram")]).alias("at"))
    # a text has one run at a place, so a beginning that all of them agree on is counted once by each
    whole = met.groupBy("kind", "key", "which", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count("*").alias("n")).where(F.col("n") == sum(map(len, wanted.values())))
    return whole.select("kind", "key").distinct()


def scan(texts: DataFrame, terms: dict[str, str]) -> DataFrame:
    """``texts`` (with a column text) that hold any of the terms, with a flag for each: by name, the term.

    For long texts that are searched once: postings have a row for every character of a text, so writing them costs far more than reading each text
    once, as this does.
    """
    flagged = texts.withColumns({name: F.coalesce(F.contains("text", F.lit(term)), F.lit(False)) for name, term in terms.items()})
    return flagged.where(F.greatest(*terms) if len(terms) > 1 else F.col(*terms))


def event_texts(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """F8: what is searched: names of events, names and aliases of series."""
    text = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(name).alias("text")).distinct()
    return text(events, "event", "id", "normalized_name").unionByName(text(events, "series", "series_id", "series_norm")).unionByName(text(aliases, "alias", "series_id", "normalized_alias"))


def search(events: DataFrame, postings: DataFrame, words: str, kinds: tuple[str, ...] = ("event", "series", "alias")) -> DataFrame:
    """The rows of ``filters.search`` for a normalised term, by postings of ``event_texts``."""
    if not words:
        return events
    found = find(postings.where(F.col("kind").isin(*kinds)), words)
    own = found.where("kind = 'event'").select(F.col("key").alias("_id"), F.lit(True).alias("_own"))
    series = found.where("kind <> 'event'").select(F.col("key").alias("_series")).distinct().withColumn("_of_series", F.lit(True))
    met = events.join(own, F.col("id").cast("string") == F.col("_id"), "left").join(series, F.col("series_id").cast("string") == F.col("_series"), "left")
    return met.where("_own OR _of_series").select(*events.columns)
