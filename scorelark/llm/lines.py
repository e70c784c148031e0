"""Cross-site line deduplication by distinct-site spread (operator 5), in DataFrame functions only.

A line that stands on many sites (values of ``source``) is boilerplate.  How many sites a line has is estimated by
a HyperLogLog sketch per line hash; sketches are built where the lines are read and merged by the aggregation,
so a line that a third of all rows share costs one small sketch per task.  Estimates far from the threshold
decide; lines near it, within BAND standard errors, get an exact distinct count.  Of a boilerplate line the first
occurrence (smallest doc_id, then line number) stays and all others are removed.

Lines are compared without surrounding blanks, and all count that aren't blank, however short.  A text of any length is split in
one row's array.  Of occurrences that tie in doc_id the smaller hashes of the row, then the line number decide.

A line is known by two 64-bit hashes (xxhash64 with two seeds), a row too.  The HOT most frequent boilerplate lines, a
proven bound, are broadcast; of any other boilerplate line there is at most one in HOT of all.  A frequent line that isn't boilerplate
only stands on the left of semi-joins, whose large partitions adaptive execution splits.

Defined results: a null text stays null and has no lines; a null source is one site of its own; rows equal in
doc_id, source and text are the same document and keep the same lines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import written

MIN_SITES, LG_K, BAND, HOT = 10, 10, 3, 1000
_LINE, _ROW = ["h", "g"], ["row", "row2"]
_SEEN = r"[^\x20\x09-\x0D]"


def _split(text: str | Column) -> Column:
    return F.split(text, "\n")


def _row() -> dict[str, Column]:
    """Tells documents apart even where doc_id is null or repeated."""
    return {"row": F.xxhash64("doc_id", "source", "text"), "row2": F.xxhash64(F.lit(7), "doc_id", "source", "text")}


def site_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, row2, site, pos and the line's hashes h, g of each line that isn't blank."""
    each = docs.select("doc_id", *(c.alias(k) for k, c in _row().items()), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(_split("text")).alias("pos", "line"))
    line = F.trim("line")
    return each.where(F.col("line").rlike(_SEEN)).select("doc_id", *_ROW, "site", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"))


def _of(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose line is ``known`` (h, g, n): the most frequent ones by a broadcast, the others by a shuffle."""
    hot = F.broadcast(known.orderBy(F.desc("n"), *_LINE).limit(HOT).select(*_LINE))
    rest = lines.join(hot, _LINE, "left_anti").join(known.select(*_LINE), _LINE, "left_semi")
    return lines.join(hot, _LINE, "left_semi").unionByName(rest)


def boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes h, g of the lines on ``min_sites`` sites or more, and how often each stands there (n)."""
    lines = site_lines(docs)
    error = BAND * 1.04 / 2 ** (LG_K / 2)
    sketched = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n")).select(*_LINE, "n", F.hll_sketch_estimate("sketch").alias("sites"))
    near = written(spark, sketched.where(F.col("sites") >= min_sites * (1 - error) - 1), "lines")
    sure = F.col("sites") > min_sites * (1 + error) + 1
    unsure = near.where(~sure)
    pairs = _of(lines.select(*_LINE, "site"), unsure).distinct()
    exact = pairs.groupBy(*_LINE).count().where(F.col("count") >= min_sites)
    return near.where(sure).select(*_LINE, "n").unionByName(unsure.join(exact, _LINE, "left_semi").select(*_LINE, "n"))


def removals(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row, row2 and the sorted numbers of its removed lines, for documents that lose any."""
    known = written(spark, boilerplate(spark, docs, min_sites), "boilerplate")
    lines = site_lines(docs).select(*_LINE, F.struct("doc_id", *_ROW, "pos").alias("at"))
    found = written(spark, _of(lines, known), "occurrences")
    first = found.groupBy(*_LINE).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    hot = F.broadcast(known.orderBy(F.desc("n"), *_LINE).limit(HOT).select(*_LINE))
    some = F.broadcast(first.join(hot, _LINE, "left_semi").select(*_LINE, "first"))
    rest = found.join(hot, _LINE, "left_anti").join(first.select(*_LINE, "first"), _LINE)
    gone = found.join(some, _LINE).unionByName(rest).where(~F.col("at").eqNullSafe(F.col("first")))
    return gone.groupBy(*(F.col(f"at.{c}").alias(c) for c in _ROW)).agg(F.array_sort(F.collect_set("at.pos")).alias("gone"))


def dedup(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, source, text (and ``_doc``, if there) of all documents with ``kept`` (the remaining text), ``n_lines`` and ``n_removed``."""
    docs = docs.select(*(c for c in ("_doc", "doc_id", "source", "text") if c in docs.columns))
    marked = docs.withColumns({"_" + k: c for k, c in _row().items()})
    gone = removals(spark, docs, min_sites).withColumnsRenamed({"row": "_row", "row2": "_row2", "gone": "_gone"})
    joined = marked.join(gone, ["_row", "_row2"], "left")
    split = _split("text")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split))
    return joined.withColumns({"kept": kept, "n_lines": lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}).drop("_row", "_row2", "_gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup(spark, docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boilerplate lines are gone; a document that consisted of nothing else goes too."""
    out = dedup(spark, tk.whole(docs)).where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    lost = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.when(lost, F.length("kept").cast("long")).otherwise(F.col("_doc.n_chars") if "n_chars" in docs.columns else None)}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns))


#: ``kept``: doc_id, n_lines, n_removed, text that remains, for a table ``docs``.
KEPT_SQL = f"""
l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM docs WHERE text IS NOT NULL)),
b AS (SELECT trim(line, ' ') AS k FROM l WHERE regexp_matches(line, '{_SEEN}') GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, pos) > 1 AS gone FROM l WHERE trim(line, ' ') IN (SELECT k FROM b)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '') AS kept
         FROM l LEFT JOIN o USING (doc_id, pos) GROUP BY doc_id)"""
SQL = f"""
WITH docs AS (SELECT * FROM documents), {KEPT_SQL}
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""
