"""Elias-Fano sequences over numpy arrays, and flat files of arrays that are memory-mapped.

A strictly increasing sequence of n values below u keeps the low log2(u / n) bits of each value packed, and the
high parts as a bit vector with a one per value and a zero per step: about 2 + log2(u / n) bits a value.
All queries take arrays.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np

U = np.uint64
_ONE = U(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, U)
    if n and width:
        bit = np.arange(n, dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(U)
        low = values << shift
        spill = np.where(shift > 0, values >> ((U(64) - shift) & U(63)), U(0))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(low, first)
        out[word[first] + 1] += np.add.reduceat(spill, first)
    return out


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(U)
    raw = words[word] >> shift
    raw |= np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return raw & U((1 << width) - 1)


_BYTE_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8).ravel()
_H55, _H33, _H0F, _H01, _H80 = (U(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one in each 64-bit word, by counting ones in all bytes of a word at once."""
    k = k.astype(U)
    s = word - ((word >> U(1)) & _H55)
    s = (s & _H33) + ((s >> U(2)) & _H33)
    s = ((s + (s >> U(4))) & _H0F) * _H01  # byte i: ones in bytes 0 .. i
    byte = np.bitwise_count(((k * _H01 | _H80) - s) & _H80).astype(U) << U(3)
    before = ((s << U(8)) >> byte) & U(255)
    here = (word >> byte) & U(255)
    return byte.astype(np.int64) + _BYTE_SELECT[((here << U(3)) + k - before).astype(np.int64)]


def _ones_below_first_zero(x: np.ndarray) -> np.ndarray:
    """How many ones each word ends with."""
    flipped = ~x
    return np.bitwise_count((flipped & (~flipped + _ONE)) - _ONE).astype(np.int64)


class EliasFano:
    """Values are strictly increasing unsigned 64-bit numbers."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        get = lambda k: arrays[prefix + k]
        self.n, self.width = (int(x) for x in get("meta"))
        self.low, self.high, self.ones = get("low"), get("high"), get("ones")
        self._zeros: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
        values = np.asarray(values, U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max((top // max(n, 1)).bit_length() - 1, 0)
        place = (values >> U(width)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) + 2 if n else 1) + 63 >> 6
        high = np.zeros(size, U)
        if n:
            first = np.flatnonzero(np.diff(place >> 6, prepend=-1))
            high[(place >> 6)[first]] = np.add.reduceat(_ONE << (place & 63).astype(U), first)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {prefix + "meta": np.array([n, width], np.int64), prefix + "low": _pack(values & U((1 << width) - 1), width), prefix + "high": high, prefix + "ones": ones}

    def all(self) -> np.ndarray:
        """All values, in one pass."""
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        place = np.flatnonzero(bits)
        i = np.arange(self.n)
        return (place - i).astype(U) << U(self.width) | _unpack(self.low, i, self.width)

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Where the i-th one stands among the high bits."""
        word = np.searchsorted(self.ones, i, "right") - 1
        return (word << 6) + _select_in_word(np.ascontiguousarray(self.high[word]), i - self.ones[word])

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (place - i).astype(U) << U(self.width) | _unpack(self.low, i, self.width)

    def get(self, i: np.ndarray) -> np.ndarray:
        return self._value(i, self._place(i))

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those after them; the next one is nearly always within 64 bits."""
        place = self._place(i)
        window = self._window(place + 1)
        after = place + 1 + _ones_below_first_zero(~window)
        far = np.flatnonzero(window == 0)
        if len(far):
            after[far] = self._place(i[far] + 1)
        return self._value(i, place), self._value(i + 1, after)

    def _window(self, bit: np.ndarray) -> np.ndarray:
        """64 high bits from a place on."""
        word, shift = bit >> 6, (bit & 63).astype(U)
        last = len(self.high) - 1
        out = np.where(word <= last, self.high[np.minimum(word, last)], U(0)) >> shift
        more = (shift > 0) & (word < last)
        return out | np.where(more, self.high[np.minimum(word + 1, last)] << ((U(64) - shift) & U(63)), U(0))

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """Where the values with this high part begin among the high bits; beyond the end if there can't be any."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        zeros = self._zeros
        want = high - 1  # the zero after which values with this high part begin
        word = np.minimum(np.searchsorted(zeros, want, "right") - 1, len(self.high) - 1)
        inside = np.maximum(want - zeros[word], 0)
        ok = (want >= 0) & (inside < zeros[word + 1] - zeros[word])
        flipped = ~np.ascontiguousarray(self.high[word])
        flipped[~ok] = ~U(0)
        place = (word << 6) + _select_in_word(flipped, np.where(ok, inside, 0)) + 1
        return np.where(want < 0, 0, np.where(ok, place, len(self.high) << 6))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        most = (int(self.high.size) << 6) - self.n + 1
        high = np.minimum(values >> U(self.width), U(most)).astype(np.int64)
        begin = self._begin(high)
        size = _ones_below_first_zero(self._window(begin))
        at = begin - high
        long = np.flatnonzero(size == 64)
        if len(long):
            size[long] = self._begin(high[long] + 1) - 1 - begin[long]
        asked = np.flatnonzero((size > 0) & (at < self.n))
        low = values[asked] & U((1 << self.width) - 1)
        at, end = at[asked], np.minimum((at + size)[asked], self.n) - 1
        while len(asked):  # binary search among equal high parts; what is decided leaves
            middle = (at + end) >> 1
            seen = _unpack(self.low, middle, self.width)
            hit = seen == low
            out[asked[hit]] = middle[hit]
            less = seen < low
            at, end = np.where(less, middle + 1, at), np.where(less, end, middle - 1)
            go = np.flatnonzero(~hit & (at <= end))
            asked, low, at, end = asked[go], low[go], at[go], end[go]
        return out


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one flat file; it appears under its name only when it is complete.  ``uri`` has a scheme."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    path_dir = path.rpartition("/")[0]
    system.create_dir(path_dir, recursive=True)
    index, at = {}, 0
    for k, v in arrays.items():
        index[k] = (str(v.dtype), at, len(v))
        at += -(-v.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes() + b"\0" * (-v.nbytes % 8))
    system.move(temporary, path)


def _mapped(uri: str) -> np.ndarray:
    """The bytes of a file, mapped.  Of a remote one a copy is mapped that has no name any more, so it goes with the process."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile() as out, system.open_input_stream(path) as src:
        while block := src.read(1 << 20):
            out.write(block)
        out.flush()
        return np.memmap(out, np.uint8, "r")


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = _mapped(uri)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = 8 + size
    out = {}
    for k, (kind, at, n) in json.loads(raw[8:base].tobytes()).items():
        kind = np.dtype(kind)
        out[k] = raw[base + at : base + at + n * kind.itemsize].view(np.ndarray).view(kind)
    return out
