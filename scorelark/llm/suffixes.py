"""Suffix-array deduplication (operator 8): bytes covered by a LENGTH-byte string that also starts elsewhere go.

Sorting a suffix for every byte of the corpus would ship each byte LENGTH times.  Only suffixes that begin with a
leading token are sorted: the leading token of a LENGTH-byte window is its smallest TOKEN-byte string in a fixed
hash order (the leftmost one, if there are several).  Equal windows have equal leading tokens at equal places, so
no repeat is lost.  Neighbouring windows mostly share theirs, and make one suffix record: the token's place, the
run of window starts, and the bytes that these windows cover, about one record per 150 bytes.

1. Leading tokens are counted over the whole corpus; those that occur once can't belong to a repeat, and their
   records are dropped.  The rest lies in memory-mapped Elias-Fano files.
2. The records are range-partitioned by the first KEY bytes from the leading token on, with splitters that Spark samples;
   the record's own text hash breaks ties, so a token that a third of all rows share is split over many buckets.
3. Each bucket sorts its suffixes (the text from the token on) by multikey quicksort: on one 8-byte key at a time, only
   runs that are equal so far go on.  The common prefix of each suffix with its neighbour then tells, for every
   length, which suffixes agree that far: a run of neighbours.  The texts before the tokens are sorted and compared
   backwards in the same way.  A window is ``back`` bytes before its token and LENGTH - ``back`` bytes from there on, so
   two windows are equal if and only if both lie in one run of either order.  Nothing but bytes is compared.
4. A window may go on in another bucket only if its bytes from the token on agree with the bucket's first or last suffix
   as far as the splitters look (KEY bytes).  Such windows are sent on as 128-bit BLAKE2b digests, packed by ranges
   of the digest, and those found in two buckets repeat.

Memory: a bucket of BUCKET_BYTES has some ten thousand suffixes; windows are looked at for STEP values of ``back`` at a time.

Defined results: null is empty; texts shorter than LENGTH keep all; equal rows repeat each other; a string that
overlaps itself counts; which of several equal texts is met first doesn't matter, as all go; a text is cut into records
in one task, which holds about a hundred bytes for each of its bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .eliasfano import EliasFano, load, save
from .lm import SHARD_BYTES, blobs, by_hash, merged, shard_of
from .storage import new_folder, written

LENGTH, TOKEN, KEY, STEP, BUCKET_BYTES = 400, 32, 96, 32, 8 << 20
U = tk.U


def records(u8: np.ndarray, offsets: np.ndarray, length: int = LENGTH, token: int = TOKEN):
    """(token place, first and last window start, token hash) of each suffix record of a piece."""
    none = np.zeros(0, np.int64)
    prefix = tk.prefix_hash(u8)
    n, wide = len(u8), length - token + 1
    at = tk.run_starts(offsets, length)
    if not len(at):
        return none, none, none, np.zeros(0, U)
    q = np.arange(n - token + 1)
    hashes = tk.rolling_hash(prefix, q, q + token)
    bits = U(max(20, n.bit_length()))
    ranked = (hashes >> bits << bits) | q.astype(U)
    padded = np.full(-(-len(ranked) // wide) * wide, ~U(0))
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, wide)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[at], forth[at + wide - 1]) & U((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return place[first], at[first], at[last], hashes[place[first]]


def repeated_tokens(spark: SparkSession, docs: DataFrame) -> tuple[str, list[int]]:
    """(folder, tokens per shard) of the leading tokens with two or more records."""
    path = new_folder(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // (2 * SHARD_BYTES)))

    def encode(batch):
        for _, _, u8, offsets in tk.pieces(batch.column(0)):
            yield records(u8, offsets)[3], None

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, code, count = merged(pdf)
        code = code[count > 1]
        save(f"{path}/{key[0]}.bin", EliasFano.encode(code))
        return pd.DataFrame({"shard": [key[0]], "n": [len(code)]})

    sizes = [0] * shards
    for r in blobs(docs.select("text"), encode, by_hash(shards), shards, size).groupBy("unit").applyInPandas(write, "shard long, n long").collect():  # a row per shard
        sizes[r["shard"]] = r["n"]
    return path, sizes


class Tokens:
    def __init__(self, path: str, sizes: list[int]):
        self.path, self.sizes, self.files = path, sizes, {}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        shard, out = shard_of(hashes, len(self.sizes)), np.zeros(len(hashes), bool)
        for s in np.unique(shard).tolist():
            if self.sizes[s]:
                if s not in self.files:
                    self.files[s] = EliasFano(load(f"{self.path}/{s}.bin"))
                at = np.flatnonzero(shard == s)
                out[at] = self.files[s].find(hashes[at]) >= 0
        return out


RECORD = "t1 long, t2 long, a int, lo long, hi long, many boolean, bytes binary"
FOUND = "t1 long, t2 long, lo long, hi long, shard int, windows binary"


def _cut(docs: DataFrame, tokens: tuple[str, list[int]]) -> DataFrame:
    """Records of repeated tokens.  Equal records of a piece are sent once (``many``); the others have no bytes."""

    def run(batches):
        known = Tokens(*tokens)
        for batch in tk.steady(batches):
            for row, _, u8, offsets in tk.pieces(batch.column(2)):
                place, lo, hi, token = records(u8, offsets)
                keep = known.has(token)
                place, lo, hi = place[keep], lo[keep], hi[keep]
                if not len(lo):
                    continue
                doc = np.searchsorted(offsets, lo, "right") - 1
                seen: dict[tuple[int, bytes], int] = {}
                raw: list[bytes | None] = []
                many = np.zeros(len(lo), bool)
                for i, (p, x, y) in enumerate(zip((place - lo).tolist(), lo.tolist(), (hi + LENGTH).tolist(), strict=True)):
                    first = seen.setdefault((p, body := u8[x:y].tobytes()), i)
                    raw.append(body if first == i else None)
                    if first != i:
                        many[[first, i]] = True
                take = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((place - lo).astype(np.int32)), pa.array(lo - offsets[doc]), pa.array(hi - offsets[doc]), pa.array(many), pa.array(raw, pa.binary())], names=[c.split()[0] for c in RECORD.split(", ")])

    keyed = docs.where(F.octet_length("text") >= LENGTH).select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")
    return keyed.mapInArrow(run, RECORD)


def multikey_sort(keys: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``keys`` by run and then by columns, and whether each row equals its predecessor.

    One column at a time; only rows whose neighbours are still equal take part in the next.
    """
    order = np.argsort(run, kind="stable")
    same = np.concatenate([[False], run[order][1:] == run[order][:-1]]) if len(order) else np.zeros(0, bool)
    for d in range(keys.shape[1]):
        open_ = np.flatnonzero(same | np.append(same[1:], False))
        if not len(open_):
            break
        group = np.cumsum(~same[open_])
        column = keys[order[open_], d]
        by = np.lexsort((column, group))
        order[open_] = order[open_][by]
        column, fresh = column[by], np.append(True, group[1:] != group[:-1])  # lexsort keeps groups in place
        same[open_] = ~fresh & np.append(False, column[1:] == column[:-1])
    return order, same


def _keys(flat: np.ndarray, start: np.ndarray, a: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per record its suffix from the token on, and what stands before the token backwards, as big-endian 8-byte keys."""
    right, left = LENGTH, -(-(LENGTH - TOKEN) // 8) * 8
    pad = np.concatenate([np.zeros(left, np.uint8), flat, np.zeros(right, np.uint8)])
    token = start + a + left
    out = np.empty((len(start), right // 8), U), np.empty((len(start), left // 8), U)
    for i in range(0, len(start), 1024):  # a few rows at a time, since places take eight times the bytes
        part = slice(i, i + 1024)
        after = pad[token[part, None] + np.arange(right)]
        after[np.arange(right) >= (end - start - a)[part, None]] = 0
        before = pad[token[part, None] - 1 - np.arange(left)]
        before[np.arange(left) >= a[part, None]] = 0
        out[0][part], out[1][part] = after.view(">u8"), before.view(">u8")
    return out


def common(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before it, 0 for the first."""
    out = np.zeros(len(keys), np.int32)
    for i in range(1, len(keys), 4096):
        differ = keys[i : i + 4096] ^ keys[i - 1 : -1][: len(keys[i : i + 4096])]
        first = (differ != 0).argmax(1)
        word = differ[np.arange(len(differ)), first]
        zeros = (word[:, None] >> (U(8) * np.arange(7, -1, -1, dtype=U)) & U(255) != 0).argmax(1)
        out[i : i + 4096] = np.where(word == 0, 8 * keys.shape[1], 8 * first + zeros)
    return out


def _runs(t1, t2, starts):
    """(t1, t2, first, last) of runs of consecutive window starts; input is grouped by record and ascending in it."""
    if not len(starts):
        return t1, t2, starts, starts
    first = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
    return t1[first], t2[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]


def compare(t1, t2, a, lo, hi, many, raw: list[bytes]):
    """Repeats of a bucket: (intervals of repeated window starts, windows that may go on in other buckets).

    Both as tuples of arrays (t1, t2, lo, hi) and (t1, t2, start, two halves of the digest); of windows that are known
    to repeat only one is passed on, as a witness, with start -1.
    """
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size)
    start, flat = end - size, np.frombuffer(b"".join(raw), np.uint8)
    right, left = _keys(flat, start, a, end)
    whole_key = np.concatenate([right, left, np.stack([a, size], axis=1).astype(U)], axis=1)
    order, same = multikey_sort(whole_key, np.zeros(len(raw), np.int64))
    del whole_key
    equal = same | np.append(same[1:], False)
    whole = np.zeros(len(order), bool)
    whole[order] = equal
    # one of each set of equal records speaks for it; its windows are known to repeat if any record of the set's is
    head = np.flatnonzero(~same)
    rec = order[head]
    known = np.logical_or.reduceat((equal | many[order]), head)
    whole |= many
    right, left = right[rec], left[rec]
    m = len(rec)
    forth = common(right)
    edge = np.maximum(np.minimum.accumulate(np.append(right.shape[1] * 8, forth[1:])), np.minimum.accumulate(np.append(right.shape[1] * 8, forth[:0:-1]))[::-1])
    by_left, _ = multikey_sort(left, np.zeros(m, np.int64))
    back = common(left[by_left])
    place = np.empty(m, np.int64)
    place[by_left] = np.arange(m)
    near_right = np.maximum(forth, np.append(forth[1:], 0))
    near_left = np.maximum(back, np.append(back[1:], 0))[place]
    del right, left
    far, least = a[rec], (a - (hi - lo))[rec]  # a record's windows begin ``least`` to ``far`` bytes before its token
    row = np.arange(m, dtype=np.int32)
    inside, across = [], []
    for d0 in range(0, LENGTH - TOKEN + 1, STEP):
        d = np.arange(d0, min(d0 + STEP, LENGTH - TOKEN + 1))
        rest = LENGTH - d
        valid = (d >= least[:, None]) & (d <= far[:, None])
        touching = valid & (edge[:, None] >= np.minimum(rest, KEY))
        asked = valid & (touching | ((near_right[:, None] >= rest) & (near_left[:, None] >= d)))
        i, k = np.nonzero(asked)
        if not len(i):
            continue
        # the first row of the run of rows that agree with a row in the first ``rest`` (or last ``d``) bytes
        right_run = np.maximum.accumulate(np.where(forth[:, None] < rest, row[:, None], 0), axis=0)[i, k]
        left_run = np.maximum.accumulate(np.where(back[:, None] < d, row[:, None], 0), axis=0)[place[i], k]
        code = (k * m + right_run) * m + left_run
        by = np.argsort(code, kind="stable")
        fresh = np.flatnonzero(np.diff(code[by], prepend=-1))
        times = np.diff(np.append(fresh, len(by)))
        known_run = (times > 1) | np.logical_or.reduceat(known[i[by]], fresh)
        repeated = np.empty(len(by), bool)
        repeated[by] = np.repeat(known_run, times)
        part = repeated & ~known[i]
        inside.append((rec[i[part]], (far[i] - d[k])[part]))
        witness = by[fresh[known_run & touching[i[by[fresh]], k[by[fresh]]]]]
        free = np.flatnonzero(~repeated & touching[i, k])
        for some, found in ((free, False), (witness, True)):
            across.append((rec[i[some]], (far[i] - d[k])[some], np.full(len(some), found)))
    owner, step = (np.concatenate(x) for x in zip(*inside, strict=True)) if inside else (np.zeros(0, np.int64),) * 2
    by = np.lexsort((step, owner))
    owner, step = owner[by], step[by]
    # the windows of a set of equal records that speaks through one are all known already
    found = _runs(t1[owner], t2[owner], lo[owner] + step)
    out = [np.concatenate(x) for x in zip(found, (t1[whole], t2[whole], lo[whole], hi[whole]), strict=True)]
    owner, step, witness = (np.concatenate(x) for x in zip(*across, strict=True)) if across else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    at = start[owner] + step
    digest = np.frombuffer(b"".join(hashlib.blake2b(flat[x : x + LENGTH], digest_size=16).digest() for x in at.tolist()), np.int64).reshape(-1, 2)
    return out, [np.where(witness, 0, t1[owner]), np.where(witness, 0, t2[owner]), np.where(witness, -1, lo[owner] + step), digest[:, 0], digest[:, 1]]


def _bucket(shards: int):
    """Sorts a bucket.  Rows are repeats, or (with ``shard``) packed windows to compare across boundaries."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = lambda k: table[k].to_numpy()
        inside, across = compare(col("t1"), col("t2"), col("a").astype(np.int64), col("lo"), col("hi"), col("many"), table["bytes"].to_pylist())
        names = [c.split()[0] for c in FOUND.split(", ")]
        if n := len(inside[0]):
            yield pa.RecordBatch.from_arrays([*map(pa.array, inside), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if len(across[0]):
            shard = shard_of(across[3].view(U), shards)
            by = np.argsort(shard, kind="stable")
            packed, cut = np.stack(across)[:, by], np.flatnonzero(np.diff(shard[by], prepend=-1, append=-1))
            size = {int(shard[by[x]]): int(y - x) for x, y in zip(cut, cut[1:], strict=False)}
            packs = {k: pa.compress(np.ascontiguousarray(packed[:, x : x + size[k]]).tobytes(), codec="zstd", asbytes=True) for k, x in zip(size, cut, strict=False)}
            none = pa.nulls(len(packs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([size[k] for k in packs], pa.int64()), pa.array(list(packs), pa.int32()), pa.array(list(packs.values()), pa.binary())], names=names)

    return run


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of a shard that stand in two buckets or more."""
    parts = [np.frombuffer(pa.decompress(w, n * 40, codec="zstd", asbytes=True), np.int64).reshape(5, n) for w, n in zip(pdf["windows"], pdf["hi"].astype(int), strict=True)]
    t1, t2, start, one, two = np.concatenate(parts, axis=1)
    by = np.lexsort((two, one))
    fresh = np.flatnonzero(np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])]))
    times = np.diff(np.append(fresh, len(by)))
    at = by[np.repeat(times > 1, times)]
    at = at[start[at] >= 0]
    at = at[np.lexsort((start[at], t2[at], t1[at]))]
    return pd.DataFrame(dict(zip(("t1", "t2", "lo", "hi"), _runs(t1[at], t2[at], start[at]), strict=True)))


def repeats(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """t1, t2 (hashes of the text), lo, hi: runs of starts of windows that also start elsewhere."""
    found = written(spark, _cut(docs, repeated_tokens(spark, docs)), "suffixes")
    sent = found.where("bytes IS NOT NULL")
    size = sent.agg(F.sum(F.col("hi") - F.col("lo") + LENGTH)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    suffix = F.col("bytes").substr(F.col("a") + 1, F.lit(KEY))
    dealt = sent.repartitionByRange(buckets, suffix, F.xxhash64("t1", "lo"))
    # what crosses boundaries is packed: a bucket sends one row per shard of window hashes
    sorted_ = written(spark, dealt.mapInArrow(_bucket(max(64, -(-buckets // 4))), FOUND), "repeats")
    run = ["t1", "t2", "lo", "hi"]
    crossing = sorted_.where("shard IS NOT NULL").select("shard", "hi", "windows").groupBy("shard").applyInPandas(_across, "t1 long, t2 long, lo long, hi long")
    return sorted_.where("shard IS NULL").select(run).unionByName(crossing).unionByName(found.where("bytes IS NULL").select(run))


def remove(spark: SparkSession, docs: DataFrame, keep: list[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``keep`` columns of each document with kept (bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    runs = repeats(spark, docs, bucket_bytes).distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    flat = runs.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("runs.lo").alias("_lo"), F.col("runs.hi").alias("_hi"))
    text = docs.select(*keep, F.col("text").alias("_text"), F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(7), "text").alias("_t2"))
    joined = text.join(flat, ["_t1", "_t2"], "left").select(*keep, "_text", "_lo", "_hi")

    def run(batches):
        for batch in tk.steady(batches):
            k = len(keep)
            raw, los, his = batch.column(k).cast(pa.binary()), batch.column(k + 1), batch.column(k + 2)
            out = []
            for i in range(len(batch)):
                body = raw[i].as_py() or b""
                n, gone, spans, kept = len(body), 0, 0, body
                if los[i].is_valid:
                    lo, hi = los[i].values.to_numpy(), his[i].values.to_numpy() + LENGTH
                    reach = np.maximum.accumulate(hi)
                    first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                    a, b = lo[first], reach[np.append(first[1:], len(lo)) - 1]
                    gone, spans = int((b - a).sum()), len(a)
                    kept = b"".join(body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True))
                out.append((kept, n, gone, spans, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[*keep, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if out else batch.slice(0, 0).select(list(range(k)))

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return joined.mapInArrow(run, f"{head}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).drop("kept")
