"""Vectorised text primitives shared by the operators of this subpackage.

An Arrow string column already is one byte buffer plus offsets.  The helpers below work on that buffer
with numpy, so a batch of documents costs a fixed number of array passes instead of Python work per
word.  Batches are cut into pieces of about PIECE bytes (a longer document is a piece of its own), which
bounds the temporary arrays by the longest document.

Hashes of strings mix eight bytes at a time (``spans_hash``), long ones are BLAKE2b.  They are the same on every
executor and in every run.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

PIECE, LONG = 1 << 20, 64
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


_libc = None


def steady(batches: Iterator) -> Iterator:
    """The batches; between them memory that is free goes back to the system, since workers live long and share a machine."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library
            _libc = int
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _libc(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow, _inv = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (_BASE, _INVERSE))
    return _pow, _inv


def table(pattern_bytes: Callable[[int], bool]) -> np.ndarray:
    return np.array([bool(pattern_bytes(b)) for b in range(256)])


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text whose A-Z are already lower case.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about ``limit`` bytes."""
    data, offsets = _buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of one piece: starts, ends (bytes), per-document offsets into them, and lazily their hashes."""

    def __init__(self, u8: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.u8, self.offsets = u8, offsets
        inside = is_word[u8]
        n = len(u8)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = offsets[:-1][offsets[:-1] < n]
            before[cut] = False
            after[cut[cut > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.starts, offsets)  # document d has words doc[d] .. doc[d + 1]
        self.counts = np.diff(self.doc)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.u8, self.starts, self.ends)

    def strings(self, i: int, j: int) -> list[bytes]:
        return [self.u8[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)]


def prefix_hash(u8: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, for ``rolling_hash``."""
    power, _ = _powers(len(u8) + 1)
    out = np.zeros(len(u8) + 1, U)
    np.cumsum(_BYTE[u8] * power[: len(u8)], out=out[1:])
    return out


def rolling_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap hash of spans at every place.  Chosen bytes can collide, so it only orders or filters; it never decides that spans are equal."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def spans_hash(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes.

    Up to LONG bytes: eight bytes at a time are mixed into the state, so spans of eight bytes or less and one length
    can't collide.  Longer ones: BLAKE2b.  Other ``seed``s give independent hashes.
    """
    padded = np.concatenate([u8, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(u8) + 1,), "<u8", padded.data, 0, (1,))
    size = ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U) * U(_BASE) + U(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        out[at] = mix(out[at] * U(0xD1342543DE82EF95) + ((eight[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)]) ^ U(k)))
        k += 8
        at = at[size[at] > k]
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].data, digest_size=8, salt=salt).digest(), "little")
    return out


def text_hash(text: str | bytes) -> int:
    """What spans_hash gives for a span with these bytes."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(spans_hash(raw, np.array([0]), np.array([len(raw)]))[0])


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes; entry i covers i .. i + n - 1."""
    if len(h) < n:
        return np.zeros(0, U)
    power, _ = _powers(n + 1)
    total = np.zeros(len(h) - n + 1, U)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * power[i + 1]
    return mix(total)


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true bytes each document has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def run_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions at which ``n`` consecutive words lie in one document."""
    counts = np.diff(doc)
    fits = np.maximum(counts - n + 1, 0)
    base = np.repeat(doc[:-1], fits)
    return base + np.arange(len(base)) - np.repeat(np.cumsum(fits) - fits, fits)


def cover(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the runs that begin at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def map_text(df: DataFrame, keep: list[str], text: str, fn: Callable, schema: str, piece: int = PIECE) -> DataFrame:
    """Apply ``fn(bytes, offsets) -> {column: array}`` to every document, in Arrow batches without a shuffle.

    Only ``keep`` and ``text`` are read, so other columns and their names don't matter.  ``schema`` lists
    the new columns; rows and their order stay.
    """
    new = [part.strip().split()[0] for part in schema.split(", ")]
    types = {name: kind for name, kind in (part.strip().split(None, 1) for part in schema.split(", "))}

    def run(batches):
        for batch in steady(batches):
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi, u8, offsets in pieces(column, piece):
                out = fn(u8, offsets)
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(arrays + [_arrow(out[c], types[c]) for c in new], names=[*keep, *new])

    selected = df.select(*keep, *([text] if text not in keep else []))
    return selected.mapInArrow(run, StructType(selected.select(*keep).schema.fields + [StructField(c, _KINDS[types[c]]) for c in new]))


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType()), "array<string>": T.ArrayType(T.StringType())}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _arrow(values, kind: str) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=_ARROW[kind])


def whole(docs: DataFrame) -> DataFrame:
    """``text`` (and doc_id, source, if there) beside ``_doc``, a struct of all columns, so that no name can clash with new columns."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_doc"), *(c for c in ("doc_id", "source", "text") if c in docs.columns))
