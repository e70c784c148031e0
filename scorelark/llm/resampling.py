"""Importance resampling towards a target distribution (operator 13).

Documents are bags of hashed n-grams.  A bucket's gain is the logarithm of how much more frequent it is in the target
than in the corpus; a document's weight is the mean gain of its features, and documents are drawn by weight plus Gumbel
noise, which samples without replacement.

1. ``dictionary``: the distinct words of corpus and target get integer ids, with their counts in both; a word is spelled out
   here only.
2. ``hashed``: n-grams are tuples of ids.  Each distinct tuple's bytes are put together from the dictionary and hashed
   once; the table holds the tuple's bucket beside its counts in corpus and target.  A tuple of one id is its dictionary row.
3. ``encoded``, for runs of two words and more: documents become arrays of ids.  The HOT most frequent words (a fixed number of
   24-byte rows) are broadcast; a place that holds another word carries the word's hashes and is filled by a join.
4. ``weighted``: per-document counts of tuples meet the gains: the HOT most frequent tuples by a broadcast, the others by
   a join.  Tuples are counted per document before anything is shuffled.
5. ``ranked``: one range sort by score; a row's rank is its place in its range and the sizes of the ranges before.

Words and tuples are known by two 64-bit hashes; a tuple of one word can't collide.

Defined results: a null text has no words; a document without features has weight 0; a null doc_id counts as the
empty string in the draw and comes last among ties; rows that repeat a document are documents of their own, with equal
scores; an empty target or corpus has only the smoothing counts; an empty table gives an empty result; a text of any
length is one row; other columns are ignored, and doc_id keeps its type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textkit as tk
from .storage import discard, written
from .token_counts import grouped, keys, most_frequent

HOT, BUCKETS, WORDS = 1 << 18, 10_000, 1
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
_KEY = ["h", "g"]


def _spelled(batches):
    """Distinct words of each piece: hashes, bytes, frequency."""
    for batch in tk.steady(batches):
        for _, _, u8, offsets in tk.pieces(batch.column(0), 4 * tk.PIECE):
            words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
            key, check = keys(words.u8, words.starts, words.ends)
            order, first, n = grouped(key, check)
            at = order[first]
            start, size = words.starts[at], words.ends[at] - words.starts[at]
            off = np.concatenate([[0], np.cumsum(size)])
            data = words.u8[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
            spelled = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(check[at]), spelled, pa.array(n)], names=["h", "g", "word", "n"])


def dictionary(spark: SparkSession, corpus: DataFrame, target: DataFrame) -> DataFrame:
    """id, h, g, word, freq (in the corpus) and wanted (in the target) of each distinct word, written in the shared folder."""
    spelled = lambda df: df.select("text").mapInArrow(_spelled, "h long, g long, word binary, n long")
    none = F.lit(0).cast("long")
    both = spelled(corpus).select(*_KEY, "word", F.col("n").alias("freq"), none.alias("wanted")).unionByName(spelled(target).select(*_KEY, "word", none.alias("freq"), F.col("n").alias("wanted")))
    once = both.groupBy(*_KEY).agg(F.first("word").alias("word"), F.sum("freq").alias("freq"), F.sum("wanted").alias("wanted"))
    return written(spark, once.select(F.monotonically_increasing_id().alias("id"), *_KEY, "word", "freq", "wanted"), "words")


class Known:
    """A bounded table by two hashes, sorted for look-up in tasks."""

    def __init__(self, rows: DataFrame, value: str, most: int):
        top = most_frequent(rows, most).select(*_KEY, value).toArrow()  # at most ``most`` rows of 24 bytes
        order = np.argsort(top["h"].to_numpy(), kind="stable")
        self.h, self.g, self.value = (top[c].to_numpy()[order] for c in (*_KEY, value))

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value); of rows that share ``h`` only the first is found, the others by the join."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (self.h[at] == h) & (self.g[at] == g), self.value[at]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _encode(known):
    """Ids of the words in order; unknown words are -1, their places and hashes stand beside."""

    def run(batches):
        for batch in tk.steady(batches):
            for lo, hi, u8, offsets in tk.pieces(batch.column(2)):
                words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
                key, check = keys(words.u8, words.starts, words.ends)
                hit, ids = known.value.find(key, check)
                rare = np.flatnonzero(~hit)
                owner = words.owner[rare]
                per = np.bincount(owner, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _lists(np.where(hit, ids, -1), words.counts), _lists(rare - words.doc[owner], per), _lists(key[rare], per), _lists(check[rare], per)],
                    names=["row", "doc_id", "ids", "at", "h", "g"],
                )

    return run


def _fill(batches):
    """Puts the joined ids into their places."""
    for batch in batches:
        ids, places = batch.column(2), batch.column(3)
        flat, begin = ids.flatten().to_numpy(zero_copy_only=False).copy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        found = places.flatten()
        row = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
        flat[begin[row] + found.field(0).to_numpy(zero_copy_only=False)] = found.field(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(flat, np.diff(begin))], names=["row", "doc_id", "ids"])


def encoded(spark: SparkSession, docs: DataFrame, words: DataFrame, hot: int = HOT, name: str = "encoded") -> DataFrame:
    """row (a number of its own), doc_id and the ids of its words in order, written in the shared folder."""
    known = spark.sparkContext.broadcast(Known(words.withColumn("freq", F.col("freq") + F.col("wanted")), "id", hot))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    longs = ArrayType(LongType())
    head = StructType([StructField("row", LongType()), rows.schema["doc_id"], StructField("ids", longs)])
    first = written(spark, rows.mapInArrow(_encode(known), StructType([*head.fields, *(StructField(c, longs) for c in ("at", *_KEY))])), name)
    rare = first.where(F.size("at") > 0)
    if rare.isEmpty():
        return first.select(*head.names)
    places = rare.select("row", F.inline(F.arrays_zip("at", *_KEY))).join(words.select("id", *_KEY), _KEY)
    found = places.groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("found"))  # one document's own words
    filled = rare.select(*head.names).join(found, "row").mapInArrow(_fill, head)
    out = written(spark, first.where(F.size("at") == 0).select(*head.names).unionByName(filled), name)
    discard(first)
    return out


def _runs(ids: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, h, g) of every run of 1 to ``n`` ids inside a document."""
    doc = np.concatenate([[0], np.cumsum(counts)])
    parts = []
    one, two = tk.mix(ids.astype(tk.U)), tk.mix(ids.astype(tk.U) ^ tk.U(0x5851F42D4C957F2D))
    h, g = one.copy(), two.copy()
    for k in range(1, n + 1):
        at = tk.run_starts(doc, k)
        if k > 1:
            h, g = (tk.mix(x[: max(len(ids) - k + 1, 0)] * tk.U(0xD1342543DE82EF95) + y[k - 1 :] + tk.U(k)) for x, y in ((h, one), (g, two)))
        parts.append((at, np.full(len(at), k), h[at], g[at]))
    at, size, h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    return at, size, h.view(np.int64), g.view(np.int64)


def _pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 18):
    """(first row, end row, ids, counts) of runs of whole documents of about ``most`` ids."""
    lists = batch.column(column)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, doc, row = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]), 0
    while row < len(counts):
        end = max(row + 1, int(np.searchsorted(doc, doc[row] + most, "right")) - 1)
        yield row, end, flat[doc[row] : doc[end]], counts[row:end]
        row = end


def tuples(rows: DataFrame, n: int = WORDS) -> DataFrame:
    """h, g, tuple (array of ids) and freq of the distinct runs of 1 to ``n`` ids."""

    def run(batches):
        for batch in tk.steady(batches):
            for _, _, ids, counts in _pieces(batch, 0):
                start, size, h, g = _runs(ids, counts, n)
                order, first, freq = grouped(h, g)
                at = order[first]
                total = np.cumsum(size[at]) - size[at]
                flat = ids[np.repeat(start[at] - total, size[at]) + np.arange(int(size[at].sum()))]
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[at]), _lists(flat, size[at]), pa.array(freq)], names=["h", "g", "tuple", "freq"])

    found = rows.select("ids").mapInArrow(run, "h long, g long, tuple array<long>, freq long")
    return found.groupBy(*_KEY).agg(F.first("tuple").alias("tuple"), F.sum("freq").alias("freq"))


def hashed(spark: SparkSession, words: DataFrame, corpus: DataFrame | None = None, target: DataFrame | None = None, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """h, g, bucket, freq (in the corpus), wanted (in the target) of each distinct tuple.

    A tuple's bytes are put together and hashed here and nowhere else.  Tuples of two ids and more come from ``encoded`` texts.
    """
    bucket = lambda text: F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    if n == 1:
        return words.select(*_KEY, bucket(F.col("word")), "freq", "wanted")
    both = tuples(corpus, n).withColumn("wanted", F.lit(0).cast("long")).unionByName(tuples(target, n).withColumnsRenamed({"freq": "wanted"}).withColumn("freq", F.lit(0).cast("long")))
    once = both.groupBy(*_KEY).agg(F.first("tuple").alias("tuple"), F.sum("freq").alias("freq"), F.sum("wanted").alias("wanted"))
    parts = once.select(*_KEY, "freq", "wanted", F.posexplode("tuple").alias("pos", "id")).join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    whole = parts.groupBy(*_KEY).agg(F.first("freq").alias("freq"), F.first("wanted").alias("wanted"), spelled.alias("word"))
    return written(spark, whole.select(*_KEY, bucket(F.col("word")), "freq", "wanted"), "tuples")


def gains(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths; ``buckets`` rows come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in found.groupBy("bucket").agg(F.sum("freq").alias("s"), F.sum("wanted").alias("t")).collect():
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _of_texts(batch: pa.RecordBatch):
    """(first row, end row, words per document, document, h, g) of the single words of each piece."""
    for lo, hi, u8, offsets in tk.pieces(batch.column(2)):
        words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
        yield lo, hi, words.counts, words.owner, *keys(words.u8, words.starts, words.ends)


def _of_ids(n: int):
    def each(batch: pa.RecordBatch):
        """The same of the runs of 1 to ``n`` ids."""
        for lo, hi, ids, counts in _pieces(batch, 2):
            start, _, h, g = _runs(ids, counts, n)
            yield lo, hi, counts, np.searchsorted(np.cumsum(counts), start, "right"), h, g

    return each


def weighted(spark: SparkSession, rows: DataFrame, runs, found: DataFrame, gain: np.ndarray, hot: int = HOT) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every document; ``runs`` cuts batches of ``rows`` (row, doc_id, text or ids) into keys of tuples."""
    each = F.broadcast(spark.createDataFrame(pa.table({"bucket": pa.array(np.arange(len(gain)), pa.int32()), "gain": gain})))  # ``buckets`` rows
    valued = written(spark, found.where("freq > 0").join(each, "bucket").select(*_KEY, "freq", "gain"), "gains")
    known = spark.sparkContext.broadcast(Known(valued, "gain", hot))

    def run(batches):
        for batch in tk.steady(batches):
            for lo, hi, counts, doc, h, g in runs(batch):
                m = hi - lo
                hit, value = known.value.find(h, g)
                base = np.bincount(doc[hit], weights=value[hit], minlength=m).astype(np.int64)
                own, none = batch.column(0).slice(lo, m), pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([own, batch.column(1).slice(lo, m), pa.array(counts, pa.int64()), pa.array(np.bincount(doc, minlength=m)), pa.array(base), none, none, none], names=_ROW)
                rare = np.flatnonzero(~hit)
                if len(rare):
                    by, first, freq = grouped(doc[rare], h[rare], g[rare])
                    at = rare[by[first]]
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(doc[at])), pa.nulls(len(at), batch.column(1).type), none, none, none, pa.array(h[at]), pa.array(g[at]), pa.array(freq)], names=_ROW)

    longs = [StructField(c, LongType()) for c in _ROW]
    mapped = rows.mapInArrow(run, StructType([longs[0], rows.schema["doc_id"], *longs[2:]]))
    # a document's own row meets no tuple, and gets a key of its own so that such rows spread
    keyed = mapped.withColumn("own", F.col("base").isNotNull()).withColumns({"h": F.coalesce("h", F.xxhash64("row")), "g": F.coalesce("g", "row")})
    met = keyed.join(valued.select(*_KEY, "gain"), _KEY, "left")
    value = F.when(F.col("own"), F.col("base")).otherwise(F.col("freq") * F.col("gain"))
    per = met.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")), F.sum(value).alias("gain"))
    # whole numbers throughout: the remainder is never negative, so the quotient is the floor
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    return per.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


_ROW = ["row", "doc_id", "n_words", "n_features", "base", "h", "g", "freq"]


def ranked(spark: SparkSession, rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``rows`` with score and rank (null: not drawn)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(spark, rows.withColumns({"score": (F.col("weight") + noise).cast("long"), "out": F.col("n_words") < least_words}), "scores")
    order = ["out", F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(spark, scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": place}), "ranks")
    discard(scored)
    # a row for each range
    sizes = sorted((r.part, r.n, r.fit) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("out")).alias("fit")).collect())
    before = np.cumsum([0, *(n for _, n, _ in sizes)]).tolist()
    most = percent * sum(fit for *_, fit in sizes) // 100
    offsets = spark.createDataFrame([(part, off) for (part, *_), off in zip(sizes, before, strict=False)], "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(offsets), "part").select(*rows.columns, "score", F.when(~F.col("out") & (rank <= most), rank).alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; those with a rank are drawn."""
    words = dictionary(spark, docs, target)
    if n == 1:
        corpus, runs, found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), _of_texts, hashed(spark, words, buckets=buckets)
    else:
        corpus, runs = encoded(spark, docs, words, hot), _of_ids(n)
        found = hashed(spark, words, corpus, encoded(spark, target.select(F.lit(None).cast("long").alias("doc_id"), "text"), words, hot, "target"), n, buckets)
    return ranked(spark, weighted(spark, corpus, runs, found, gains(found, buckets), hot), percent, least_words, seed).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(spark, read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_FOUND = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH k AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT doc_id, {_FOUND} AS w FROM documents),
o AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
q AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_FOUND}) AS w FROM benchmark) GROUP BY 1),
v AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(strlen(w) AS BIGINT) + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
                              lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket
      FROM (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM o UNION ALL SELECT w FROM q)), k),
s AS (SELECT bucket, sum(n) AS s FROM o JOIN v USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM q JOIN v USING (w) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM o) + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM q) + {BUCKETS})))) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, floor(sum(n * gain) / sum(n)) AS weight FROM o JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
c AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN k END AS rank FROM c LEFT JOIN r USING (doc_id)"""
