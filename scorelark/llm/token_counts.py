"""Token counts (operator 4): pieces are counted once per distinct pre-token, never per document.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then splits each on its own, so the number of
tokens of a document is the sum over its pre-tokens of frequency times pieces, and no ids are needed.

1. ``vocabulary``: the distinct pre-tokens of all documents with their frequencies (one aggregation), each sent
   through the tokenizer once, written as a table.
2. The HOT most frequent of them (a fixed number of 64-bit keys, a few MB at any corpus size) are broadcast and
   resolved where the documents are read.
3. The rest, rare by construction, are shuffled as (row, key, frequency), joined to the table, and summed.

A pre-token is known by its key and its check, two independent 64-bit hashes of its bytes that are grouped, joined
and looked up together; up to eight bytes they can't collide, and of longer ones 10^12 would have to meet for a
chance of 1e-14.  Which characters are letters, numbers or white space is asked of the tokenizer itself, since
its Unicode version may differ from other libraries'.

Defined results: null is empty (0 bytes, 0 tokens); a special token's string inside a text is one token, as the
library takes it by default; repeated rows are counted each; frequencies that tie are broadcast together or not at
all, which changes no result; a text is cut into pre-tokens as a whole, so one task holds the longest text some
twenty times; an empty table gives an empty result; other columns are ignored and doc_id keeps its type.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textkit as tk
from .storage import written

HOT, LIMIT = 1 << 18, 1024
TOKENIZER = "byte_bpe_50k.json"
SPECIAL = b"<|endoftext|>"
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_classes: dict[str | None, np.ndarray] = {}
_tokenizers: dict[str, object] = {}


def classes(path: str | None = None) -> np.ndarray:
    """Class of each code point: letter, number, white space or other; as the tokenizer of ``path`` has it, if given."""
    if path not in _classes:
        _classes[path] = _asked(path) if path else _by_pattern()
    return _classes[path]


def _points() -> list[int]:
    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def _by_pattern() -> np.ndarray:
    import regex

    points = _points()
    text, found = "".join(map(chr, points)), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            found[points[m.start()] : points[m.end() - 1] + 1] = kind
    return found


def _asked(path: str) -> np.ndarray:
    """All code points in a row are cut by the tokenizer into runs of one class; one point of each run is then tried
    next to a letter, a digit and a mark, which it joins if it is of their class.  ASCII is tried point by point."""
    cut = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    points = _points()
    high = points[128:]
    runs = [(high[a], high[b - 1]) for _, (a, b) in cut("".join(map(chr, high)))]
    runs += [(c, c) for c in points[:128]]
    found = np.full(0x110000, _SPACE, np.uint8)
    for kind, friend in ((_LETTER, "b"), (_NUMBER, "1"), (_OTHER, "!")):
        text = "".join(f"{friend}{chr(a)}\n" for a, _ in runs)
        begins = {a for _, (a, _) in cut(text)}
        for k, (a, b) in enumerate(runs):
            if 3 * k + 1 not in begins:
                found[a : b + 1] = kind
    return found


def class_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``classes`` as (lengths, kinds) of runs: a small thing that the driver finds once and tasks expand."""
    table = classes(path)
    first = np.flatnonzero(np.diff(table, prepend=0))
    return np.diff(np.append(first, len(table))), table[first]


def _tokenizer(path: str):
    """One a process, and no threads of its own."""
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True  # special strings are cut out before
    return _tokenizers[path]


def byte_classes(u8: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character each byte belongs to, whether the byte begins a character)."""
    table = classes() if table is None else table
    head = u8 & 0xC0 != 0x80
    cls = table[np.where(u8 < 0x80, u8, 0)]
    at = np.flatnonzero(u8 >= 0xC0)
    if len(at):
        b = [u8[np.minimum(at + k, len(u8) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        lead = u8[at].astype(np.int64)
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | b[0], np.where(lead < 0xF0, (lead & 0x0F) << 12 | b[0] << 6 | b[1], (lead & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2]))
        kind, size = table[np.minimum(point, 0x10FFFF)], 2 + (lead >= 0xE0) + (lead >= 0xF0)
        for k in range(4):
            put = size > k
            cls[np.minimum(at[put] + k, len(u8) - 1)] = kind[put]
    return cls, head


def specials(u8: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the special token's string inside documents."""
    if not len(np.flatnonzero(u8 == SPECIAL[0])):
        return np.zeros(0, np.int64)
    raw, found, at = u8.tobytes(), [], 0
    while (at := raw.find(SPECIAL, at)) >= 0:
        if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(SPECIAL) - 1, "right"):
            found.append(at)
            at += len(SPECIAL)
        else:
            at += 1
    return np.array(found, np.int64)


def pretokens(u8: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, starts of special tokens); every byte outside special tokens is in exactly one pre-token."""
    n = len(u8)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    special = specials(u8, offsets)
    edge = np.unique(np.concatenate([offsets[offsets < n], special, special + len(SPECIAL), [0]]))
    edge = edge[edge < n]
    cls, head = byte_classes(u8, table)
    segment = np.zeros(n, bool)
    segment[edge] = True
    begin = segment.copy()
    begin[1:] |= cls[1:] != cls[:-1]
    runs = np.flatnonzero(begin)
    kind, first = cls[runs], segment[runs]
    last = np.append(runs[1:], n)
    follows = np.append(~first[1:], False)  # another run of the same segment comes next
    # the last character of white space before something else leaves its run; a blank joins what follows
    space = np.flatnonzero((kind == _SPACE) & follows)
    back = last[space] - 1
    while len(move := np.flatnonzero(~head[back])):
        back[move] -= 1
    begin[back] = True
    blank = u8[back] == 0x20
    begin[last[space][blank]] = False
    # contractions: an apostrophe that begins a pre-token, with the letters after it
    quote = np.flatnonzero(u8 == 0x27)
    quote = quote[begin[quote]]
    if len(quote):
        limit = np.append(edge, n)[np.searchsorted(edge, quote, "right")]
        a, b = (np.where(quote + k < limit, u8[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size, limit = quote[size > 0], size[size > 0], limit[size > 0]
        begin[quote + 1] = False
        end = quote + size
        begin[end[end < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    if len(special):
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, special, 1)
        np.add.at(inside, special + len(SPECIAL), -1)
        plain = np.cumsum(inside)[starts] == 0
        starts, ends = starts[plain], ends[plain]
    return starts, ends, special


def keys(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of spans."""
    return tk.spans_hash(u8, starts, ends).view(np.int64), tk.spans_hash(u8, starts, ends, 1).view(np.int64)


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each run of equal rows in that order, length of the runs), sorted by the first columns but the last.

    Rows that differ in the last column alone may make several runs each, which a later aggregation joins.
    """
    order = np.argsort(columns[0]) if len(columns) == 2 else np.lexsort(columns[-2::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(fresh)
    return order, first, np.diff(np.append(first, len(order)))


def _distinct(path: str):
    """Distinct pre-tokens of each piece with their bytes and frequency."""

    runs = class_runs(path)

    def run(batches):
        table = np.repeat(runs[1], runs[0])
        for batch in tk.steady(batches):
            for _, _, u8, offsets in tk.pieces(batch.column(0)):
                starts, ends, _ = pretokens(u8, offsets, table)
                key, check = keys(u8, starts, ends)
                order, first, n = grouped(key, check)
                at = order[first]
                s, size = starts[at], ends[at] - starts[at]
                off = np.concatenate([[0], np.cumsum(size)])
                data = u8[np.repeat(s - off[:-1], size) + np.arange(off[-1])] if len(s) else np.zeros(0, np.uint8)
                words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(check[at]), words, pa.array(n)], names=["key", "check", "word", "freq"])

    return run


def _pieces(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in tk.steady(batches):
            words = batch.column(2)
            n = [len(e.ids) for i in range(0, len(words), 500) for e in tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 500].to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3)], names=["key", "check", "pieces", "freq"])

    return run


def vocabulary(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """key, check, pieces, freq of each distinct pre-token of all documents, written in the shared folder."""
    found = docs.select("text").mapInArrow(_distinct(path), "key long, check long, word binary, freq long")
    once = found.groupBy("key", "check").agg(F.first("word").alias("word"), F.sum("freq").alias("freq"))
    return written(spark, once.mapInArrow(_pieces(path), "key long, check long, pieces long, freq long"), "pretokens")


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The most frequent rows, at most ``most`` of them, without a sort: a histogram of the logarithm of ``freq`` (under 1,100 rows) tells from where on they are few enough."""
    step = F.floor(F.log2("freq") * 16).cast("int")
    least, total = 1 << 20, 0
    for r in vocab.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return vocab.where(step >= least)


def counts(spark: SparkSession, docs: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    vocab = vocabulary(spark, docs, path)
    top = most_frequent(vocab, hot).select("key", "check", "pieces").toArrow()  # at most ``hot`` rows of 24 bytes
    order = np.argsort(top["key"].to_numpy(), kind="stable")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("key", "check", "pieces")))
    runs = class_runs(path)

    def run(batches):
        hot_key, hot_check, pieces = known.value
        table = np.repeat(runs[1], runs[0])
        for batch in tk.steady(batches):
            for lo, hi, u8, offsets in tk.pieces(batch.column(2)):
                starts, ends, special = pretokens(u8, offsets, table)
                key, check = keys(u8, starts, ends)
                doc = np.searchsorted(offsets, starts, "right") - 1
                at = np.minimum(np.searchsorted(hot_key, key), max(len(hot_key) - 1, 0))
                # of hot pre-tokens that share a key only the first is found here, the others by the join
                hit = (hot_key[at] == key) & (hot_check[at] == check) if len(hot_key) else np.zeros(len(key), bool)
                n = hi - lo
                base = np.bincount(doc[hit], weights=pieces[at[hit]], minlength=n).astype(np.int64) if len(hot_key) else np.zeros(n, np.int64)
                base += np.bincount(np.searchsorted(offsets, special, "right") - 1, minlength=n)
                row = batch.column(0).slice(lo, n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([row, batch.column(1).slice(lo, n), pa.array(np.diff(offsets)), pa.array(base), none, none, none], names=_ROW)
                rare = np.flatnonzero(~hit)
                if len(rare):
                    by, first, freq = grouped(doc[rare], key[rare], check[rare])
                    at = rare[by[first]]
                    m = len(at)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(doc[at])), pa.nulls(m, batch.column(1).type), none, none, pa.array(key[at]), pa.array(check[at]), pa.array(freq)], names=_ROW)

    longs = [StructField(c, LongType()) for c in _ROW]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = rows.mapInArrow(run, StructType([longs[0], rows.schema["doc_id"], *longs[2:]]))
    # a document's own row meets no vocabulary key, and gets one of its own so that such rows spread
    keyed = rows.withColumn("own", F.col("base").isNotNull()).withColumns({"key": F.coalesce("key", F.xxhash64("row")), "check": F.coalesce("check", "row")})
    joined = keyed.join(vocab.select("key", "check", "pieces"), ["key", "check"], "left")
    total = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.when(F.col("own"), F.col("base")).otherwise(F.col("freq") * F.col("pieces"))).alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens")


_ROW = ["row", "doc_id", "n_bytes", "base", "key", "check", "freq"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
