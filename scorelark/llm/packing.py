"""Best-fit packing with bounded space (operator 6).

Documents become token ids with the end id appended; longer ones are cut into full pieces of LENGTH, the first
piece taking the odd rest.  Full pieces are sequences of their own.  All others go to the open bin that they fill
best.  At most OPEN bins are open at a time: a bitset over free space has one bit per number of free tokens, so
the best bin for a piece is the lowest set bit from its length on, and when a new bin is needed the fullest one,
the lowest set bit of all, is closed.  It looks AHEAD bytes of text ahead:
of these the longest pieces are placed first, which saves most of the room that strict arrival order leaves.

Ids are those of the tokenizers library.  A byte-level tokenizer splits each pre-token on its own, so a task sends
every distinct pre-token through the library once and puts the ids of texts together from those.

Every task packs the documents it reads: nothing is shuffled, memory is the open bins, CACHE pre-tokens and a piece of
a batch, and a lost task is simply run again with the same result.  Sequence numbers begin with the task's partition number.

Defined results: null is empty text and gives one piece with the end id; repeated rows are packed each; of bins with the
same free space the one that got it last is taken; a text of any length is encoded by one task, as some fifty bytes per
byte; an empty table gives an empty result; other columns are ignored and doc_id keeps its type.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import textkit as tk
from .token_counts import SPECIAL, TOKENIZER, _tokenizer, class_runs, grouped, keys, pretokens

LENGTH, OPEN, END, CACHE, AHEAD = 1024, 4096, 2, 1 << 20, 2 << 20
NEW = StructType([StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


class Bins:
    """Open bins behind a bitset of their free space; ``place`` gives (bin, offset)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most, self.bits, self.open, self.made = length, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _put(self, free: int, bin_: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.length, self.made
            self.made += 1
        self._put(free - size, bin_)
        return bin_, self.length - free


class Encoder:
    """Ids of the library of the .json file; each distinct pre-token goes through it once, until CACHE of them are held."""

    def __init__(self, path: str, table: np.ndarray):
        self.tokenizer, self.table = _tokenizer(path), table
        self.special = self.tokenizer.token_to_id(SPECIAL.decode())
        self._reset()

    def _reset(self) -> None:
        self.key, self.check, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, u8: np.ndarray, key: np.ndarray, check: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of distinct pre-tokens, sorted by key, among the known ones, which stand sorted by key too."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        out = np.empty(len(key), np.int64)
        out[hit] = self.place[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            words = [u8[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            found = [e.ids for i in range(0, len(words), 2000) for e in self.tokenizer.encode_batch_fast(words[i : i + 2000], add_special_tokens=False)]
            out[new] = len(self.first) - 1 + np.arange(len(new))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            into = np.searchsorted(self.key, key[new])
            self.key, self.check, self.place = (np.insert(old, into, more) for old, more in ((self.key, key[new]), (self.check, check[new]), (self.place, out[new])))
        return out

    def encode(self, u8: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with ``end`` after each, offsets of the documents into them)."""
        starts, ends, special = pretokens(u8, offsets, self.table)
        key, check = keys(u8, starts, ends)
        order, first, n = grouped(key, check)
        if len(self.key) + len(first) > CACHE:
            self._reset()
        one = order[first]
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(self._numbers(u8, key[one], check[one], starts[one], ends[one]), n)
        # special tokens and ends take part as if they were pre-tokens of one id, in the order of the text
        documents = len(offsets) - 1
        at = np.concatenate([starts, special, offsets[1:]])
        kind = np.repeat([1, 1, 0], [len(starts), len(special), documents])  # an end comes before what begins where it stands
        begin = np.concatenate([self.first[which], np.full(len(special), len(self.ids)), np.full(documents, len(self.ids) + 1)])
        size = np.concatenate([self.first[which + 1] - self.first[which], np.ones(len(special) + documents, np.int64)])
        by = np.lexsort((kind, at))
        begin, size, kind = begin[by], size[by], kind[by]
        out = np.cumsum(size)
        flat = np.append(self.ids, np.array([self.special, end], np.uint32))[np.repeat(begin - out + size, size) + np.arange(out[-1] if len(out) else 0)]
        return flat, np.concatenate([[0], out[kind == 0]])


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, most: int = OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids as little-endian 32-bit numbers."""
    runs = class_runs(path)

    def run(batches):
        if path not in _encoders:
            _encoders[path] = Encoder(path, np.repeat(runs[1], runs[0]))
        base, bins = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, Bins(length, most)
        for batch in tk.steady(batches):
            for lo, hi, u8, offsets in tk.pieces(batch.column(1), AHEAD):
                ids, cut = _encoders[path].encode(u8, offsets, end)
                total = np.diff(cut)
                many = -(-total // length)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                odd = (total - 1) % length + 1  # the first piece takes the rest
                start = np.where(piece > 0, odd[row] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, odd[row])
                raw = [ids[a : a + n].astype("<u4", copy=False).data for a, n in zip((cut[row] + start).tolist(), size.tolist(), strict=True)]
                placed = np.empty((len(size), 2), np.int64)
                for k in np.argsort(-size, kind="stable").tolist():
                    placed[k] = bins.place(int(size[k]))
                columns = [batch.column(0).take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(base + placed[:, 0]), pa.array(placed[:, 1])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([r.tobytes() for r in raw], pa.binary())] if with_ids else []), names=["doc_id", *NEW.names, *(["ids"] if with_ids else [])])

    frame = docs.select("doc_id", "text")
    return frame.mapInArrow(run, StructType([frame.schema["doc_id"], *NEW.fields, *([StructField("ids", BinaryType())] if with_ids else [])]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces with their ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)
