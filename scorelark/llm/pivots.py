"""Embedding near-duplicates through a pivot-permutation index (operator 12).

Two vectors are linked if they have the same label (not null) and a cosine of PERCENT hundredths or more.  Equal vectors
of a label are one class, so copies cost nothing.

1. ``references``: the pivots, about sqrt(classes) of them, at most PIVOT_BYTES: the classes whose hash is below a rate, a
   bounded sample, without those whose cosine with a former one is APART or more: inside a large group of near
   vectors the order of pivots from that group would be chance.  They are numbered by how rarely they are among the nearest
   ones of the sample itself, and lengths of vectors that the sample lacks get random directions.
2. ``described``: a class is described by its NEAREST closest pivots in order.  Linked classes share most of them; a pair is
   a candidate if it shares SHARED or more.
3. ``placed``: inverted lists, one for each label, length and pivot.  Of a description only the NEAREST - SHARED + 1 rarest pivots
   are listed: of SHARED common pivots at least one is among these on both sides, so no candidate is lost.  Long lists
   are dealt out as pairs of blocks of about BLOCK classes; small ones share calls, whose number follows the rows dealt.
4. ``linked``: within a list the postings of all its pivots give the shared-pivot counts of a tile of rows at a time.  A pair is
   looked at in the list of its rarest common pivot alone, and its cosine decides, in double precision.  A task returns per class the number of
   its links, and (member, root) rows; no pair leaves it.

Components are found by alternating star steps, each written to the shared folder.  Recall against brute force is
measured in ``tests/llm`` and stated in the README; a link that is found is never wrong.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and rows without a label, are
linked to nothing; vectors of different lengths aren't linked; rows that repeat a vector are linked to each other, also under
one vec_id; 0.0 and -0.0 are equal; a null vec_id is never the smallest one of a component unless all are null; an empty table gives an
empty result; other columns are ignored, and vec_id keeps its type.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import textkit as tk
from .near import components
from .storage import written

PERCENT, NEAREST, SHARED, APART = 98, 10, 3, 0.9
FEWEST, PIVOT_BYTES, BLOCK, CALL_BYTES, CELLS = 64, 1 << 21, 4096, 1 << 24, 1 << 18
_LIST = ["label", "d", "pivot"]


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(valid, values as doubles, first value, length) of each vector."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(pc.cast(column.flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False) + 0.0
    begin = np.concatenate([[0], np.cumsum(size)])
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[begin])
    return (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0), values, begin[:-1], size


def keyed(df: DataFrame, key: str, vector: str, label: str, with_vector: bool) -> DataFrame:
    """key, label, d (length), h, g (hashes of the vector; null if it can be linked to nothing), and the vector's bytes if asked for."""

    def run(batches):
        for batch in tk.steady(batches):
            valid, values, begin, size = _valid(batch.column(2))
            valid &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            h, g, raw = np.zeros(len(valid), np.int64), np.zeros(len(valid), np.int64), [None] * len(valid)
            for i in np.flatnonzero(valid).tolist():
                bytes_ = values[begin[i] : begin[i] + size[i]].tobytes()
                two = np.frombuffer(hashlib.blake2b(bytes_, digest_size=16).digest(), np.int64)
                h[i], g[i] = two
                if with_vector:
                    raw[i] = narrow(bytes_)
            arrays = [batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(h, mask=~valid), pa.array(g, mask=~valid)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.binary())] if with_vector else arrays, names=names)

    rows = df.select(key, label, vector)
    single = rows.schema[vector].dataType.elementType.simpleString() == "float"
    narrow = (lambda b: np.frombuffer(b).astype(np.float32).tobytes()) if single else (lambda b: b)
    fields = [rows.schema[key], rows.schema[label], StructField("d", IntegerType()), StructField("h", LongType()), StructField("g", LongType())]
    fields += [StructField("vec", BinaryType())] if with_vector else []
    names = [f.name for f in fields]
    return rows.mapInArrow(run, StructType(fields)).withColumnsRenamed({key: "key", label: "label"})


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors, as doubles.  They are scaled by their largest entry first, so no square overflows or vanishes."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(column) else np.float64).reshape(len(column), d).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k pivots of largest cosine of each row, the nearest first."""
    k, out = min(k, len(pivots)), []
    step = max(1, (1 << 21) // len(pivots))
    for lo in range(0, len(x), step):
        cos = x[lo : lo + step] @ pivots.T
        some = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(cos), 1))
        out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(cos, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, k), np.int32)


def spread(x: np.ndarray, most: float = APART) -> np.ndarray:
    """Rows of ``x`` in order, without those that have a cosine of ``most`` or more with a row kept before."""
    kept = x[:0]
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        part = part[(part @ kept.T).max(1, initial=-1.0) < most]
        close, stays = np.triu(part @ part.T >= most, 1), np.ones(len(part), bool)
        for i in range(len(part)):
            stays &= ~(close[i] & stays[i])
        kept = np.concatenate([kept, part[stays]])
    return kept


class References:
    """Pivots by length of the vectors, the rarest first."""

    def __init__(self, sample: dict[int, np.ndarray], k: int = NEAREST):
        self.k, self.held = k, {}
        for d, x in sample.items():
            apart = spread(x)
            seen = np.bincount(nearest(x, apart, k).ravel(), minlength=len(apart))
            self.held[d] = self._filled(apart[np.argsort(seen, kind="stable")], d)

    def _filled(self, x: np.ndarray, d: int) -> np.ndarray:
        if len(x) >= FEWEST // 2:
            return x
        more = np.random.default_rng(d).standard_normal((FEWEST // 2 - len(x), d))
        return np.concatenate([x, more / np.linalg.norm(more, axis=1, keepdims=True)])

    def of(self, d: int) -> np.ndarray:
        if d not in self.held:
            self.held[d] = self._filled(np.zeros((0, d)), d)
        return self.held[d]


def references(classes: DataFrame, k: int = NEAREST, pivot_bytes: int = PIVOT_BYTES) -> References:
    n, d = classes.agg(F.count("*"), F.max("d")).first()
    most = max(FEWEST, min(int(np.ceil(np.sqrt(n))), pivot_bytes // (8 * (d or 1))))
    # as many as wanted on average, chosen by the vectors' own hashes
    chosen = classes.where(F.pmod(F.xxhash64("h", "label"), F.lit(1 << 40)) < int(min(1.0, most / max(n, 1)) * (1 << 40))).select("d", "h", "g", "vec").toArrow()
    order = np.lexsort((chosen["g"].to_numpy(), chosen["h"].to_numpy()))
    chosen = chosen.take(pa.array(order))
    by = chosen["d"].to_numpy()
    return References({int(x): matrix(chosen["vec"].filter(pa.array(by == x)).combine_chunks(), int(x)) for x in np.unique(by)}, k)


def described(spark: SparkSession, classes: DataFrame, refs: References) -> DataFrame:
    """class, label, d, size, vec and ``near``, the ordered numbers of the nearest pivots."""
    held = spark.sparkContext.broadcast(refs)  # at most PIVOT_BYTES or so

    def run(batches):
        for batch in tk.steady(batches):
            d = batch.column(2).to_numpy()
            for own in np.unique(d).tolist():
                part = batch.filter(pa.array(d == own))
                near = nearest(matrix(part.column(4), own), held.value.of(own), held.value.k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["class", "label", "d", "size", "vec", "near"])

    rows = classes.select("class", "label", "d", "size", "vec")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *spark.createDataFrame([], "near array<int>").schema.fields]))


def placed(spark: SparkSession, rows: DataFrame, shared: int = SHARED, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(rows of the inverted lists: list key, i, j (a pair of blocks), b (own block), class, size, vec, near; how many calls they make)."""
    some = F.slice(F.array_sort("near"), 1, F.greatest(F.size("near") - (shared - 1), F.lit(1)))
    each = rows.withColumn("pivot", F.explode(some))
    # (n members, k blocks) of each list with two members or more; the lists' rows are dealt to every block of theirs
    sizes = written(spark, each.groupBy(*_LIST).agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.ceil(F.col("n") / block).cast("int")), "lists")
    dealt, long_ = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("k") * (4 * F.col("d") + 64)), F.lit(0)), F.max("k")).first()
    met = each.join(sizes.select(*_LIST, "k"), _LIST).withColumn("b", F.pmod(F.xxhash64("class", F.lit(3)), F.col("k")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))) if (long_ or 1) > 1 else met.withColumn("o", F.lit(0))
    return met.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "k"), max(1, -(-dealt // CALL_BYTES))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component) after rows a and b were joined."""
    a, b = label[a], label[b]
    two = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
    while len(two):
        np.minimum.at(label, two[:, 0], two[:, 1])
        while not np.array_equal(label, up := label[label]):
            label = up
        two = label[two]
        two = np.unique(np.sort(two[two[:, 0] != two[:, 1]], axis=1)[:, ::-1], axis=0)
    return label


def linked(near: np.ndarray, x: np.ndarray, size: np.ndarray, part: np.ndarray | None, pivot: int, shared: int = SHARED, threshold: float = PERCENT / 100) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row counted in vectors, label of its component) within one list; with ``part`` only across its two parts."""
    m, k = near.shape
    names, code = np.unique(near, return_inverse=True)
    code = code.reshape(m, k)
    order = np.argsort(code.ravel(), kind="stable")
    posting, length = order // k, np.bincount(code.ravel(), minlength=len(names))
    begin = np.cumsum(length) - length
    links, label = np.zeros(m, np.int64), np.arange(m)
    tile = max(1, CELLS // m)
    for lo in range(0, m, tile):
        rows = np.arange(lo, min(m, lo + tile))
        slot = code[rows].ravel()
        n = length[slot]
        at = np.repeat(begin[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(np.repeat(np.arange(len(rows)), k), n) * m + posting[at]
        candidate = np.bincount(cell, minlength=len(rows) * m) >= shared
        candidate[cell[np.repeat(names[slot] < pivot, n)]] = False  # met in the list of a rarer pivot
        candidate = candidate.reshape(len(rows), m)
        candidate &= np.arange(m) > rows[:, None]
        if part is not None:
            candidate &= part != part[rows][:, None]
        some = np.flatnonzero(candidate.any(0))
        if not len(some):
            continue
        r, c = np.nonzero(candidate[:, some] & (x[rows] @ x[some].T >= threshold))
        r, c = rows[r], some[c]
        links += np.bincount(r, weights=size[c], minlength=m).astype(np.int64) + np.bincount(c, weights=size[r], minlength=m).astype(np.int64)
        label = merge(label, c, r)
    return links, label


def links(lists: DataFrame, calls: int, shared: int = SHARED, percent: int = PERCENT) -> DataFrame:
    """class, links, root: of each list the classes with links, and the smallest class that they meet there."""
    threshold = percent / 100

    def split(key, table):
        group, ids, size, pivot = (table[c].to_numpy() for c in ("group", "class", "size", "pivot"))
        own, i, j, d = (table[c].to_numpy() for c in ("b", "i", "j", "d"))
        vec, near = table["vec"].combine_chunks(), table["near"].combine_chunks()
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        order = np.lexsort((ids, group))
        cut = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]]))
        for at in map(slice, cut[:-1].tolist(), cut[1:].tolist()):
            rows = order[at]
            if len(rows) < 2:
                continue
            pick, first = pa.array(rows), rows[0]
            perm = near.take(pick).flatten().to_numpy().reshape(len(rows), -1)
            found, label = linked(perm, matrix(vec.take(pick), int(d[first])), size[rows], None if i[first] == j[first] else own[rows] == j[first], int(pivot[first]), shared, threshold)
            some = np.flatnonzero(found)
            out.append((ids[rows[some]], found[some], ids[rows[label[some]]]))
        return pa.table(dict(zip(("class", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    rows = lists.select(F.xxhash64(*_LIST, "i", "j").alias("group"), "class", "size", "pivot", "b", "i", "j", "d", "vec", "near")
    return rows.withColumn("call", F.pmod("group", F.lit(calls))).groupBy("call").applyInArrow(split, "class long, links long, root long")


def near_duplicates(spark: SparkSession, df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", percent: int = PERCENT, nearest_: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    rows = keyed(df, key, vector, label, True).where("h IS NOT NULL")
    same = ["label", "d", "h", "g"]
    once = rows.groupBy(*same).agg(F.count("*").alias("size"), F.min("key").alias("first"), F.first("vec").alias("vec"))
    classes = written(spark, once.select(F.monotonically_increasing_id().alias("class"), *same, "size", "first", "vec"), "classes")
    lists, calls = placed(spark, described(spark, classes, references(classes, nearest_)), shared, block)
    found = written(spark, links(lists, calls, shared, percent), "links")
    per = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(spark, found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    # everything is decided per class; vectors, of which one class may hold a third, only look their class up
    each = classes.select("class", *same, "size", "first").join(per, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = each.groupBy("root").agg(F.min("first").alias("component_id"))
    each = each.join(least, "root").select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    vectors = keyed(df, key, vector, label, False)
    alone = vectors.where("h IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    met = vectors.where("h IS NOT NULL").join(each, same).select("key", "n_links", "component_id")
    return met.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {PERCENT / 100}),
r AS (SELECT vec_id, vec_id AS low FROM embeddings UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.vec_id),
c AS (SELECT vec_id, min(low) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
