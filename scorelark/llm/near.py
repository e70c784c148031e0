"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

Documents are sets of WORDS-word shingles (a shorter document is one shingle).  Two are linked if the Jaccard
similarity of their sets is 0.8 or more.  Documents with equal sets form one class; everything below works on
classes, so copies cost nothing.

1. ``classes``: MinHash signatures of HASHES values, kept to 8 bits each.
2. ``candidates``: BANDS x ROWS banding (a linked pair is missed by all bands with probability below 1e-7).  Inside a
   bucket signatures are compared STEP values at a time; a pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold falls below TOLERANCE.  Survivors are only joined into families: a bucket
   returns one (member, root) row per member, never its pairs.
3. ``links``: within a family all pairs of classes are verified exactly, as bit sets over the shingles that two or
   more members share.  A task returns per class the number of its links, and (member, root) rows of what is truly
   linked.

Large buckets and families are dealt out as pairs of blocks of about BLOCK classes, so no task holds more than
two blocks, of BLOCK classes on average, whatever the size of a group; nothing is capped.  Connected components are found by alternating large-
and small-star steps, each written to the shared folder.

Defined results: a null text, or one without a word, is linked to nothing; equal rows are copies of each other; of
documents that tie the smallest id speaks for a component; a text of any length is one task's, as some sixty bytes per
byte; an empty table gives an empty result; other columns are ignored, and doc_id keeps its type.  The number of links counts documents, copies included.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import discard, written

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
HASHES, STEP, TOLERANCE = BANDS * ROWS, 32, 1e-7
BLOCK, BLOCK_SHINGLES, PER_CALL, HUBS = 4096, 1 << 20, 1 << 15, 500
_MULTIPLY = tk.mix(np.arange(1, HASHES + 1, dtype=tk.U)) | tk.U(1)
_ADD = tk.mix(np.arange(1001, HASHES + 1001, dtype=tk.U))


def shingles(u8: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, per-document offsets into them)."""
    words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
    hashes = words.hashes()
    at = tk.run_starts(words.doc, n)
    long_ = tk.runs_hash(hashes, n)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    few = [tk.runs_hash(hashes[words.doc[d] : words.doc[d + 1]], int(words.counts[d])) for d in short]
    owner = np.concatenate([words.owner[at], short])
    values = np.concatenate([long_, *few]) if few else long_
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(offsets)))


def signatures(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """documents x HASHES smallest values under each hash function; documents without shingles get zeros."""
    some = np.flatnonzero(np.diff(cut))
    out = np.zeros((len(cut) - 1, HASHES), tk.U)
    if len(some):
        for k in range(HASHES):
            x = values * _MULTIPLY[k] + _ADD[k]
            out[some, k] = np.minimum.reduceat(x ^ (x >> tk.U(32)), cut[some])
    return out


def least_matches(step: int = STEP, hashes: int = HASHES, threshold: float = PERCENT / 100, tolerance: float = TOLERANCE) -> list[int]:
    """Per number of compared 8-bit values (step, 2 step ...): the fewest matches at which a pair may stay.

    The prior of the similarity is uniform.  A value matches with probability j + (1 - j) / 256.
    """
    j = (np.arange(2000) + 0.5) / 2000
    match = j + (1 - j) / 256
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            weight = np.exp(log - log.max())
            if weight[j >= threshold].sum() / weight.sum() >= tolerance:
                out.append(m)
                break
    return out


_LEAST = least_matches()


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows of ``others`` that are not dropped when compared with ``one``, STEP values at a time."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, least in enumerate(_LEAST):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (others[alive, part] == one[part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def families(sig: np.ndarray) -> np.ndarray:
    """Component number of each row in the graph of surviving pairs.  Members already joined aren't compared again."""
    label, left, n = np.full(len(sig), -1), np.arange(len(sig)), 0
    while len(left):
        queue, left = [left[0]], left[1:]
        label[queue[0]] = n
        while queue and len(left):
            near = survivors(sig[queue.pop()], sig[left])
            label[left[near]] = n
            queue.extend(left[near].tolist())
            left = np.delete(left, near)
        label[queue] = n
        n += 1
    return label


def classes(docs: DataFrame) -> DataFrame:
    """class (a hash of the shingle set), n shingles, sig, doc_id and text hashes of each document; class is null without words."""

    def run(batches):
        for batch in tk.steady(batches):
            for lo, hi, u8, offsets in tk.pieces(batch.column(3)):
                values, cut = shingles(u8, offsets)
                sig, n = signatures(values, cut), np.diff(cut)
                total = np.concatenate([np.zeros(1, tk.U), np.cumsum(tk.mix(values))])
                whole = tk.mix(total[cut[1:]] - total[cut[:-1]] + n.astype(tk.U)).view(np.int64)
                bands = tk.mix((sig.reshape(-1, BANDS, ROWS) * _MULTIPLY[:ROWS]).sum(2) + _ADD[:BANDS]).view(np.int64)
                bytes_ = (sig >> tk.U(11)).astype(np.uint8)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(whole, mask=empty), pa.array(n), pa.array([x.tobytes() for x in bytes_], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))],
                    names=["doc_id", "t1", "t2", "class", "n", "sig", "bands"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, class long, n long, sig binary, bands array<long>")


def dealt(df: DataFrame, key: str, cost: str | None = None) -> DataFrame:
    """Deal the rows of each ``key`` out to pairs of blocks: columns b (own block), i, j (the pair, i <= j).

    A row of a key with k blocks appears k times, once with every block.
    """
    weight = F.sum(cost) if cost else F.lit(0)
    size = df.groupBy(key).agg(F.count("*").alias("_n"), weight.alias("_w")).where("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_w") / BLOCK_SHINGLES)).cast("int")
    placed = df.join(size.select(key, blocks.alias("_k")), key).withColumn("b", F.pmod(F.xxhash64("class", F.lit(3)), F.col("_k")).cast("int"))
    each = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return each.withColumns({"i": F.least("b", "_o"), "j": F.greatest("b", "_o")}).drop("_o", "_k")


def _roots(label: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component."""
    order = np.lexsort((ids, label))
    first = np.ones(len(order), bool)
    first[1:] = label[order][1:] != label[order][:-1]
    root = np.empty(len(ids), ids.dtype)
    root[order] = ids[order][first][np.cumsum(first) - 1]
    return root


def bucket_edges(bucket: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) within each bucket; rows are grouped by ``bucket``."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    two = first[size == 2]  # most buckets; all at once
    alive = np.ones(len(two), bool)
    matches = np.zeros(len(two), np.int64)
    for k, least in enumerate(_LEAST):
        part = slice(k * STEP, (k + 1) * STEP)
        at = two[alive]
        matches[alive] += (sig[at, part] == sig[at + 1, part]).sum(1)
        alive &= matches >= least
    pair = np.stack([ids[two[alive]], ids[two[alive] + 1]])
    a, b = [pair.max(0)], [pair.min(0)]
    for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = ids[lo : lo + n]
        root = _roots(families(sig[lo : lo + n]), own)
        a.append(own[root != own])
        b.append(root[root != own])
    return np.concatenate(a), np.concatenate(b)


def candidates(spark: SparkSession, once: DataFrame) -> DataFrame:
    """(a, b) rows that join classes into families."""
    # buckets are dealt out by their keys alone; signatures are attached only where a bucket has two classes
    placed = dealt(once.select("class", F.explode("bands").alias("band")).distinct(), "band")
    rows = placed.join(once.select("class", "sig"), "class").select("class", "sig", F.xxhash64("band", "i", "j").alias("bucket"))

    def split(key, table):
        bucket, ids = table["bucket"].to_numpy(), table["class"].to_numpy()
        order = np.lexsort((ids, bucket))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        a, b = bucket_edges(bucket[order], ids[order], sig[order])
        return pa.table({"a": a, "b": b})

    # many small buckets share a call; the number of calls follows the number of rows
    calls = max(1, -(-once.count() * BANDS // (8 * PER_CALL)))
    return rows.withColumn("call", F.pmod("bucket", F.lit(calls))).groupBy("call").applyInArrow(split, "a long, b long").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b), by large-star and small-star steps.

    The HUBS nodes with most edges, a proven bound, are broadcast; any other node has at most one in HUBS of all edges.
    """
    edges = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        hubs = F.broadcast(least.orderBy(F.desc("n"), "a").limit(HUBS).select("a", "m"))
        rest = both.join(hubs.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
        met = both.join(hubs, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))
        large = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        new = written(spark, small.select("a", F.col("m").alias("b")).unionByName(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        same = [f.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() for f in (edges, new)]
        discard(least)
        edges = new
        if same[0] == same[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def verify(ids: np.ndarray, sets: list[np.ndarray], size: np.ndarray, part: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row counted in documents, component number), over all pairs of rows, exactly.

    With ``part`` (0 or 1 for each row) only pairs across the two parts count.
    """
    m, n = len(ids), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1
    shared = seen[code] > 1
    owner, code = owner[shared], number[code[shared]]
    width = -(-(int(number[-1]) + 1) // 64) or 1
    bits = np.zeros((m, width), tk.U)
    np.bitwise_or.at(bits, (owner, code >> 6), tk.U(1) << (code & 63).astype(tk.U))
    links, parent = np.zeros(m, np.int64), np.arange(m)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(m):
        rest = np.arange(i + 1, m)
        if part is not None:
            rest = rest[part[rest] != part[i]]
        least = np.minimum(n[i], n[rest])  # the smaller set can't be below the threshold of the larger
        rest = rest[100 * least >= percent * np.maximum(n[i], n[rest])]
        if not len(rest):
            continue
        own = np.flatnonzero(bits[i])
        common = np.bitwise_count(bits[np.ix_(rest, own)] & bits[i, own]).sum(1, dtype=np.int64)
        near = rest[100 * common >= percent * (n[i] + n[rest] - common)]
        links[i] += size[near].sum()
        links[near] += size[i]
        top = find(i)
        for y in np.unique(parent[near]).tolist():
            y = find(y)
            if y != top:
                parent[max(y, top)] = min(y, top)
                top = min(y, top)
    return links, np.array([find(x) for x in range(m)])


def join(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, t1, t2 (hashes of its text), class_id (smallest doc_id of its component), n_links, n_copies."""
    rows = written(spark, classes(docs), "signatures")
    once = rows.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("size"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("bands").alias("bands"), F.min(F.struct("t1", "t2", "doc_id")).alias("at"), F.min("doc_id").alias("first"))
    once = written(spark, once, "classes")
    family = components(spark, candidates(spark, once))
    members = once.join(family.withColumnRenamed("node", "class"), "class").select("class", "size", "n", "root", "at.t1", "at.t2", F.col("at.doc_id").alias("rep"))
    placed = dealt(members, "root", "n")
    texts = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), F.col("doc_id").alias("rep0"), "text")
    wanted = members.select("class", "t1", "t2", F.col("rep").alias("rep1"))
    chosen = texts.join(wanted, ["t1", "t2"]).where(F.col("rep0").eqNullSafe(F.col("rep1"))).select("class", "text")

    def to_sets(u8, offsets):
        values, cut = shingles(u8, offsets)
        return {"set": [values[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]}

    sets = tk.map_text(chosen, ["class"], "text", to_sets, "set binary").dropDuplicates(["class"])

    def check(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        ids, size = pdf["class"].to_numpy(), pdf["size"].to_numpy()
        sets = [np.frombuffer(x, tk.U) for x in pdf["set"]]
        _, i, j = key
        links, label = verify(ids, sets, size, None if i == j else (pdf["b"].to_numpy() == j).astype(int), percent)
        return pd.DataFrame({"class": ids, "links": links, "link_root": _roots(label, ids)})

    found = placed.join(sets, "class").select("root", "i", "j", "b", "class", "size", "set").groupBy("root", "i", "j").applyInPandas(check, "class long, links long, link_root long")
    found = written(spark, found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    true = components(spark, found.select(F.col("class").alias("a"), F.col("link_root").alias("b")))
    # everything is decided per class; documents, of which one class may hold a third, only look their class up
    per = once.select("class", "size", "first").join(links, "class", "left").join(true.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = per.groupBy("root").agg(F.min("first").alias("class_id"))
    per = per.join(least, "root").select("class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("size").alias("n_copies"))
    documents = rows.select("doc_id", "t1", "t2", "class")
    alone = documents.where("class IS NULL").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    found = documents.where("class IS NOT NULL").join(per, "class").select("doc_id", "t1", "t2", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links", "n_copies")
    return found.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of linked documents the one with the smallest doc_id stays.

    Rows that repeat a document, id and text, are that document, and stay or go together.
    """
    found = join(spark, docs)
    stay = found.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("doc_id").alias("_stay")).distinct()
    marked = tk.whole(docs).withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(7), "text"), "_stay": F.col("doc_id")})
    same = [marked[c].eqNullSafe(stay[c]) for c in ("_t1", "_t2", "_stay")]
    return marked.join(stay, same, "left_semi").select("_doc.*")
