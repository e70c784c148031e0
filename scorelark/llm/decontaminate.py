"""Benchmark decontamination by a prefix-filtered set join (operator 3).

Every benchmark item is cut into windows of WINDOW consecutive words (an item with fewer is one window).  A
document contains a window only if it contains each of the window's shingles, so a single one, the necessary
prefix in an order of shingles by rarity, is enough to find all candidates.  Rarity is the document frequency
over the whole corpus.  A candidate is a place of the prefix in a document; its offset in the window bounds
the place of the window (it must begin and end inside the document), and the window's words are then compared
exactly.

Items are the stated query set.  They are dealt to blocks of about BLOCK bytes, and tasks turn each block into an index,
a flat file in the shared folder that workers memory-map.  The documents are read twice, once to count the items'
shingles and once to look all blocks up, whatever the benchmark's size; nothing of the items passes through the
driver, and nothing is shuffled but the items and the counts of their shingles.

Defined results: null texts have no words; items without words match nothing; an item without an id still marks
words but is not listed; repeated item ids are listed once; repeated documents are judged each on their own; of shingles
that are equally rare the one with the smaller hash, then the earlier one leads, which changes no result; a text of any
length is one task's, as some sixty bytes per byte; an empty benchmark hits nothing, an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .eliasfano import load, save
from .storage import new_folder

WINDOW, SHINGLE, BLOCK = 10, 3, 2 << 20
SIZES = tuple(range(1, SHINGLE + 1))


class Lookup:
    """A sorted array of hashes behind a bit table that turns most misses away."""

    def __init__(self, hashes: np.ndarray, bits: np.ndarray | None = None):
        self.sorted, self.bits = (np.unique(np.asarray(hashes, tk.U)), None) if bits is None else (hashes, bits)
        if bits is None:
            self.bits = np.zeros(1 << max(20, (8 * len(self.sorted)).bit_length()), bool)
            self.bits[self._slot(self.sorted)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> tk.U(65 - len(self.bits).bit_length())).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, index in ``sorted``) of those that are present."""
        at = np.flatnonzero(self.bits[self._slot(hashes)])
        where = np.minimum(np.searchsorted(self.sorted, hashes[at]), max(len(self.sorted) - 1, 0))
        hit = self.sorted[where] == hashes[at] if len(self.sorted) else np.zeros(0, bool)
        return at[hit], where[hit]


def _column(texts) -> tuple[tk.Words, np.ndarray]:
    raw = [(x or "").encode() for x in texts]
    u8 = tk.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    words = tk.Words(u8, np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]), tk.ALNUM)
    return words, words.hashes()


def windows(words: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of each window of the texts."""
    long_ = tk.run_starts(words.doc, window)
    short = np.flatnonzero((words.counts > 0) & (words.counts < window))
    return np.concatenate([long_, words.doc[short]]), np.concatenate([np.full(len(long_), window), words.counts[short]])


def _by_length(length: np.ndarray):
    """(words, shingle size, windows) for each length of windows."""
    for n in np.unique(length).tolist():
        yield n, min(SHINGLE, n), np.flatnonzero(length == n)


def item_shingles(texts, window: int) -> dict[int, np.ndarray]:
    """The distinct shingles of all windows by size."""
    words, hashes = _column(texts)
    start, length = windows(words, window)
    found: dict[int, list] = {}
    for n, size, at in _by_length(length):
        places = np.unique(start[at][:, None] + np.arange(n - size + 1))
        found.setdefault(size, []).append(tk.runs_hash(hashes, size)[places])
    return {size: np.unique(np.concatenate(x)) for size, x in found.items()}


def build(ids, texts, counts: dict[int, tuple[np.ndarray, np.ndarray]], window: int) -> dict[str, np.ndarray]:
    """The index of a block as arrays: distinct windows behind their rarest shingle, with their words and items.

    ``counts`` has sorted hashes and document frequencies per shingle size.
    """
    words, hashes = _column(texts)
    start, length = windows(words, window)
    owner = np.searchsorted(words.doc, start, "right") - 1
    # equal windows of any items are one: two independent hashes of the words tell
    one, two = np.zeros(len(start), tk.U), np.zeros(len(start), tk.U)
    other = tk.spans_hash(words.u8, words.starts, words.ends, 1)
    for n, _, at in _by_length(length):
        one[at], two[at] = (tk.runs_hash(h, n)[start[at]] + tk.U(n) for h in (hashes, other))
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    start, length = start[order][fresh], length[order][fresh]
    text_ids = [None if x is None else str(x).encode() for x in ids]
    named = sorted({x for x in text_ids if x is not None})
    number = {x: i for i, x in enumerate(named)}
    of_item = np.array([number.get(x, -1) for x in text_ids], np.int64)[owner]
    pair = np.unique((group * max(len(named), 1) + of_item)[of_item >= 0])
    pair = np.stack([pair // max(len(named), 1), pair % max(len(named), 1)])
    out = {"start": start, "length": length, "hash": hashes, "raw": words.u8, "from": words.starts, "to": words.ends, "items": pair[1], "items.first": np.searchsorted(pair[0], np.arange(len(start) + 1))}
    out |= {"ids": np.frombuffer(b"".join(named), np.uint8), "ids.first": np.cumsum([0, *map(len, named)])}
    postings: dict[int, list] = {size: [] for size in SIZES}
    for n, size, at in _by_length(length):
        runs = tk.runs_hash(hashes, size)
        known, seen = counts.get(size, (np.zeros(0, tk.U), np.zeros(0, np.int64)))
        near = np.minimum(np.searchsorted(known, runs), max(len(known) - 1, 0))
        frequency = np.where(known[near] == runs, seen[near], 0) if len(known) else np.zeros(len(runs), np.int64)
        by = np.lexsort((runs, frequency))
        rank = np.empty(len(runs), np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], (runs[by][1:] != runs[by][:-1]).astype(np.int64)]))
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            offset = rank[start[part][:, None] + np.arange(n - size + 1)].argmin(1)
            postings[size].append((runs[start[part] + offset], part, offset))
    for size, parts in postings.items():
        key, window_no, offset = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, tk.U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        by = np.lexsort((window_no, key))
        look = Lookup(key)
        out |= {f"keys{size}": look.sorted, f"bits{size}": look.bits, f"first{size}": np.searchsorted(key[by], look.sorted), f"window{size}": window_no[by], f"offset{size}": offset[by]}
        out[f"first{size}"] = np.append(out[f"first{size}"], len(key))
    return out


class Index:
    """A block's arrays, looked up."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.looks = {size: Lookup(arrays[f"keys{size}"], arrays[f"bits{size}"]) for size in SIZES if len(arrays[f"keys{size}"])}

    def places(self, words: tk.Words, hashes: np.ndarray, runs: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the piece, window) of every occurrence of a window.  ``runs``: places and shingles by size."""
        a, begins, which = self.a, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, look in self.looks.items():
            at, shingle = runs[size]
            place, key = look.find(shingle)
            if not len(place):
                continue
            first = a[f"first{size}"]
            many = first[key + 1] - first[key]
            row = np.repeat(first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window, position = a[f"window{size}"][row], np.repeat(at[place], many)
            doc, begin = np.searchsorted(words.doc, position, "right") - 1, position - a[f"offset{size}"][row]
            length = a["length"][window]
            good = np.flatnonzero((begin >= words.doc[doc]) & (begin + length <= words.doc[doc + 1]))
            for k in range(int(length.max())):  # words by their hashes first, then by their bytes
                w = good[length[good] > k]
                differ = hashes[begin[w] + k] != a["hash"][a["start"][window[w]] + k]
                good = np.setdiff1d(good, w[differ], assume_unique=True)
            same = [i for i in good.tolist() if self._equal(words, int(begin[i]), int(a["start"][window[i]]), int(length[i]))]
            begins.append(begin[same])
            which.append(window[same])
        return np.concatenate(begins).astype(np.int64), np.concatenate(which).astype(np.int64)

    def _equal(self, words: tk.Words, begin: int, start: int, n: int) -> bool:
        a = self.a
        return all(words.u8[words.starts[begin + k] : words.ends[begin + k]].tobytes() == a["raw"][a["from"][start + k] : a["to"][start + k]].tobytes() for k in range(n))

    def items(self, window: np.ndarray) -> list[str]:
        """Ids of the items with any of the windows."""
        first, of, at = self.a["items.first"], self.a["items"], self.a["ids.first"]
        found = np.unique(np.concatenate([of[first[w] : first[w + 1]] for w in window.tolist()]))
        return [self.a["ids"][at[i] : at[i + 1]].tobytes().decode() for i in found.tolist()]


def _runs(words: tk.Words, hashes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found = {}
    for size in SIZES:
        at = tk.run_starts(words.doc, size)
        found[size] = at, tk.runs_hash(hashes, size)[at]
    return found


def _scan(load_all):
    indexes: list[Index] = []

    def scan(u8, offsets):
        if not indexes:
            indexes.extend(Index(x) for x in load_all())
        words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
        hashes = words.hashes()
        runs, n = _runs(words, hashes), len(words.counts)
        hits = [(index, *index.places(words, hashes, runs)) for index in indexes]
        begin, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([b for _, b, _ in hits], [i.a["length"][w] for i, _, w in hits]))
        spans, items, n_hit = [[] for _ in range(n)], [set() for _ in range(n)], np.zeros(n, np.int64)
        if len(begin):
            hit = np.concatenate([[False], tk.cover(len(words.starts), begin, length), [False]])
            for d in np.unique(np.searchsorted(words.doc, begin, "right") - 1).tolist():
                lo, hi = words.doc[d], words.doc[d + 1]
                own = np.concatenate([[0], hit[lo + 1 : hi + 1].astype(np.int8), [0]])
                spans[d] = np.stack([np.flatnonzero(np.diff(own) == 1), np.flatnonzero(np.diff(own) == -1)], axis=1).ravel().tolist()
                n_hit[d] = own.sum()
                for index, b, w in hits:
                    mine = np.unique(w[(b >= lo) & (b < hi)])
                    items[d].update(index.items(mine) if len(mine) else [])
        return {"n_words": words.counts, "spans": spans, "items": [sorted(x) for x in items], "n_hit": n_hit}

    return scan


def _count(docs: DataFrame, path: str, blocks: list[int]) -> DataFrame:
    """block, size, hash, n: in how many documents, of all, each shingle of the items stands."""

    def run(batches):
        looks = [(b, size, Lookup(x[f"keys{size}"], x[f"bits{size}"])) for b in blocks for x in [load(f"{path}/shingles-{b}.bin")] for size in SIZES if len(x[f"keys{size}"])]
        for batch in tk.steady(batches):
            for _, _, u8, offsets in tk.pieces(batch.column(0)):
                words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
                runs = _runs(words, words.hashes())
                for b, size, look in looks:
                    at, shingle = runs[size]
                    place, which = look.find(shingle)
                    doc = np.searchsorted(words.doc, at[place], "right") - 1
                    pair = np.unique(doc * len(look.sorted) + which)
                    found, n = np.unique(pair % len(look.sorted), return_counts=True)
                    m = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, b)), pa.array(np.full(m, size)), pa.array(look.sorted[found].view(np.int64)), pa.array(n)], names=["block", "size", "hash", "n"])

    return docs.select("text").mapInArrow(run, "block long, size long, hash long, n long").groupBy("block", "size", "hash").agg(F.sum("n").alias("n"))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK) -> DataFrame:
    """The ``keep`` columns of each document with n_words, spans (begin, end, begin, end ... in words), items (ids), n_hit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many, path = max(1, -(-total // block_bytes)), new_folder(spark, "items")
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)))

    def shingles(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = item_shingles(pdf["text"], window)
        looks = {size: Lookup(found.get(size, np.zeros(0, tk.U))) for size in SIZES}
        save(f"{path}/shingles-{key[0]}.bin", {f"keys{size}": x.sorted for size, x in looks.items()} | {f"bits{size}": x.bits for size, x in looks.items()})
        return pd.DataFrame({"block": [key[0]]})

    def index(key, pdf: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        counts = {}
        for size, part in counted.groupby("size"):
            hashes = part["hash"].to_numpy().view(tk.U)
            by = np.argsort(hashes)
            counts[int(size)] = hashes[by], part["n"].to_numpy()[by]
        if len(pdf):
            save(f"{path}/index-{key[0]}.bin", build(pdf["item_id"], pdf["text"], counts, window))
        return pd.DataFrame({"block": [key[0]]})

    blocks = sorted(r["block"] for r in items.groupBy("block").applyInPandas(shingles, "block long").collect())  # a number per block
    if blocks:
        counts = _count(docs, path, blocks)
        items.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(index, "block long").collect()
    scan = _scan(lambda: [load(f"{path}/index-{b}.bin") for b in blocks])
    return tk.map_text(docs, keep, "text", scan, "n_words long, spans array<long>, items array<string>, n_hit long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark window, columns unchanged."""
    found = find(spark, tk.whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["_doc"])
    return found.where("n_hit = 0").select("_doc.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: ``hits``: document, first word (from 1), length and item of every occurrence of a window, for a table ``docs``.
HITS_SQL = f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM docs),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, win))"""
SQL = f"""
WITH docs AS (SELECT * FROM documents), {HITS_SQL},
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)"""
