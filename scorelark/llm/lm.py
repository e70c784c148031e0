"""Language-model scoring with an Elias-Fano n-gram trie (operator 9).

Tokens are words (A-Z lower-cased) and one end per text.  The model interpolates orders 1 to ORDER with absolute
discounting over an add-ADD unigram model.  It has every n-gram of the training rows (``cut`` can leave out those of
order k with fewer than cut[k - 1] occurrences; the query does not).

The trie has a level per order:

* level 1: word hashes as an Elias-Fano sequence, so a word's place is its id; exact counts;
* level k > 1: monotone pointers from each node of level k - 1 to its successors, an Elias-Fano sequence of the
  successors, and probabilities quantised to 8 bits.  From level 3 on a successor is not stored as a word id but
  relative to its context: its rank among the successors of the shorter context, a small number.

A level is cut into shards: level 1 by ranges of the word hash, the others by ranges of the contexts, chosen by the
counts of the level before so that each shard has about the same number of occurrences.  So the n-grams of a
frequent word are dealt to many shards; only those of one and the same context stay together, which are no more than there are
words.  Each shard is a flat file in the shared folder that workers memory-map: the model takes page cache, not heap,
and grows with the input.  The driver holds three numbers for each shard.

Texts are turned into word ids once, which are written as a table; from it the levels are counted and the texts are
scored.

Counting: each task reduces its n-grams to sorted distinct codes with counts and ships them as compressed blobs.  A
blob goes to one of at most FAN groups of shards; where there are more shards than that the groups are merged and
dealt out again, so the number of blobs follows the input and not its square.  A frequent n-gram is one entry per task.

Defined results: a null text is empty and has one token, its end; repeated rows count each; words that tie in anything
are told apart by their hashes; a text is held by one task as some forty bytes per byte; without training rows every
token has the probability of the unigram formula, and an empty table gives an empty result; other columns are ignored
and doc_id keeps its type.  Words are known by 64-bit hashes (``textkit``): of 10^9 distinct ones longer than eight
bytes two share one with a chance of 3 %, and count as one word then.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import textkit as tk
from .eliasfano import EliasFano, load, save
from .storage import new_folder, written

ORDER, ADD, DISCOUNT = 3, 0.1, 0.75
SHARD_BYTES, FLUSH, PIECE, ID_PIECE, FAN, MERGE = 16 << 20, 3 << 19, 3 << 20, 3 << 19, 2048, 1 << 21
#: Bits of a successor in a code; the rest is for the context within its shard.
WORD_BITS = 40
END = tk.text_hash(" end ")  # no word has blanks
U = tk.U


def tokens(u8: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, ends included; per-document offsets into them)."""
    words = tk.Words(tk.LOWER[u8], offsets, tk.NONSPACE)
    n = len(words.counts)
    out = np.full(len(words.starts) + n, END, U)
    out[np.arange(len(words.starts)) + words.owner] = words.hashes()
    return out, words.doc + np.arange(n + 1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, index of each value among them)."""
    order = np.argsort(x)
    ranked = x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return ranked[fresh], back


def counted(context: np.ndarray, word: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sorted distinct (context, word) pairs and how often each occurs; without words, of the contexts alone."""
    bits = int(word.max()).bit_length() if word is not None and len(word) else 0
    if word is None or int(context.max(initial=0)).bit_length() + bits <= 64:
        code = np.sort(context if word is None else context << U(bits) | word)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        code, count = code[first], np.diff(np.append(first, len(code)))
        return (code, None, count) if word is None else (code >> U(bits), code & U((1 << bits) - 1), count)
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    return context[first], word[first], np.diff(np.append(first, len(context)))


# ---------------------------------------------------------------- blobs of sorted codes with counts
BLOB = "unit long, n long, shards binary, steps binary, codes binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    """The same byte of all values side by side, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).reshape(-1).view(kind)


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes as steps of their upper part, and of their lower part among those with one upper part: small numbers.

    Where a blob has several shards codes begin anew, which arithmetic modulo 2^64 undoes.
    """
    high, low = codes >> U(WORD_BITS), codes & U((1 << WORD_BITS) - 1)
    step = np.diff(high, prepend=U(0))
    same = step == 0
    same[:1] = False
    low[1:] -= np.where(same[1:], low[:-1] + U(1), U(0))
    return step, low


def _joined(step: np.ndarray, low: np.ndarray) -> np.ndarray:
    high = np.cumsum(step, dtype=U)
    same = step == 0
    same[:1] = False
    total = np.cumsum(low + same)
    first = np.flatnonzero(~same)
    return high << U(WORD_BITS) | total - np.repeat((total - low)[first], np.diff(np.append(first, len(low))))


def _emit(shard: np.ndarray, code: np.ndarray, count: np.ndarray, unit: int):
    """A blob for every ``unit`` shards; entries are sorted by shard, then code."""
    cut = np.flatnonzero(np.diff(shard // unit, prepend=-1, append=-1))
    rows = [(int(shard[a]) // unit, int(b - a), _packed(np.diff(shard[a:b], prepend=0)), *map(_packed, _split(code[a:b])), _packed(count[a:b].astype(np.uint32))) for a, b in zip(cut, cut[1:], strict=False)]
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in BLOB.split(", ")])


def merged(blobs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, code, count) of all entries of some blobs, sorted, each code once; one shard for all if there is only one."""
    get = lambda *names: zip(blobs["n"], *(blobs[x] for x in names), strict=True)
    code = np.concatenate([_joined(_unpacked(d, n, U), _unpacked(c, n, U)) for n, d, c in get("steps", "codes")])
    count = np.concatenate([_unpacked(k, n, np.uint32) for n, k in get("counts")])
    shard = [np.cumsum(_unpacked(s, n, np.int64)) for n, s in get("shards")]
    first, last = min(s[0] for s in shard), max(s[-1] for s in shard)
    shard = np.concatenate(shard) if first < last else None
    order = np.argsort(code) if shard is None else np.lexsort((code, shard))
    code, count = code[order], count[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    if shard is not None:
        shard = shard[order]
        fresh[1:] |= shard[1:] != shard[:-1]
    del order
    at = np.flatnonzero(fresh)
    return np.full(1, first) if shard is None else shard[at], code[at], np.add.reduceat(count, at, dtype=np.int64)


def _again(unit: int):
    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, code, count = merged(pdf)
        return pd.concat([b.to_pandas() for b in _emit(np.broadcast_to(shard, len(code)), code, count, unit)])

    return again


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def by_hash(shards: int):
    """Deals hashes to shards by ranges."""
    return lambda context, word: (shard_of(context, shards), context)


def by_context(bounds: np.ndarray):
    """Deals (context, word) pairs to shards by ranges of the context."""

    def deal(context, word):
        shard = np.searchsorted(bounds, context.astype(np.int64), "right") - 1
        own = context - bounds[shard].astype(U)
        if len(own) and (int(own.max()) >> 64 - WORD_BITS or int(word.max()) >> WORD_BITS):
            raise OverflowError("a shard has too many contexts or a level too many words for one code; use smaller shards")
        return shard, own << U(WORD_BITS) | word

    return deal


def blobs(rows: DataFrame, encode, deal, shards: int, size: int, fan: int | None = None) -> DataFrame:
    """Rows (unit = shard, blobs) of what ``encode(batch)`` yields as (context, word), dealt to shards by ``deal``.

    Tasks write at most ``fan`` blobs at a time.  With more shards than that a unit is a range of shards first, whose
    blobs are merged some at a time and cut again, until a unit is one shard.
    """
    fan = fan or FAN
    unit = -(-shards // fan)

    def run(batches):
        held, n = [], 0

        def flush():
            context = np.concatenate([c for c, _ in held])
            word = None if held[0][1] is None else np.concatenate([w for _, w in held])
            context, word, count = counted(context, word)
            yield from _emit(*deal(context, word), count, first)

        for batch in tk.steady(batches):
            for context, word in encode(batch):
                if len(context):
                    held.append((context, word))
                    n += len(context)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    first = unit
    found = rows.mapInArrow(run, BLOB)
    while unit > 1:
        calls, unit = max(1, -(-size // (fan * MERGE))), -(-unit // fan)
        dealt = found.withColumn("call", F.pmod(F.xxhash64("codes"), F.lit(calls)))
        found = dealt.groupBy("unit", "call").applyInPandas(_again(unit), BLOB)
    return found


# ---------------------------------------------------------------- the trie
class Trie:
    """Reads the levels that exist so far.

    ``bounds`` has the first context of each shard per level (none for level 1), ``offsets`` the first node of each.
    """

    def __init__(self, path: str, total: int, bounds: list[np.ndarray], offsets: list[np.ndarray]):
        self.path, self.total, self.bounds, self.offsets = path, total, bounds, offsets
        self.files: dict[tuple[int, int], dict] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_end"} | {"files": {}}

    @property
    def words(self) -> int:
        return int(self.offsets[0][-1])

    def size(self, level: int, shard: int) -> int:
        return int(self.offsets[level - 1][shard + 1] - self.offsets[level - 1][shard])

    def file(self, level: int, shard: int) -> dict:
        key = (level, shard)
        if key not in self.files:
            arrays = load(f"{self.path}/{level}-{shard}.bin")
            arrays["values"] = EliasFano(arrays, "v.")
            if level > 1:
                arrays["pointers"] = EliasFano(arrays, "p.")
            self.files[key] = arrays
        return self.files[key]

    def _parts(self, starts: np.ndarray, ids: np.ndarray, level: int):
        """(shard, places in ``ids``) of each shard of ``level`` that has nodes; shards begin at ``starts``."""
        shard = np.searchsorted(starts, ids, "right") - 1
        if len(starts) < 1 << 16:
            shard = shard.astype(np.uint16)  # sorted by radix
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order].astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(cut, cut[1:], strict=False):
            s = int(shard[order[a]])
            if self.size(level, s):
                yield s, order[a:b]

    def find(self, different: np.ndarray) -> np.ndarray:
        """Ids of distinct sorted word hashes, -1 for unknown."""
        out = np.full(len(different), -1, np.int64)
        shards = len(self.offsets[0]) - 1
        shard = shard_of(different, shards)
        cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(cut, cut[1:], strict=False):
            if self.size(1, s := int(shard[a])):
                i = self.file(1, s)["values"].find(different[a:b])
                out[a:b] = np.where(i >= 0, i + self.offsets[0][s], -1)
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for unknown."""
        different, back = distinct(hashes)
        return self.find(different)[back]

    def own(self, level: int, node: np.ndarray, what: str) -> np.ndarray:
        """``count`` or ``prob`` (log10) at nodes of a level."""
        out = np.zeros(len(node), np.int64 if what == "count" else np.float64)
        for s, at in self._parts(self.offsets[level - 1][:-1], node, level):
            arrays = self.file(level, s)
            local = node[at] - self.offsets[level - 1][s]
            out[at] = _count_at(arrays, local) if what == "count" else arrays["prob"][local] * -arrays["prob.scale"][0]
        return out

    def back(self, level: int, context: np.ndarray) -> np.ndarray:
        """Log10 weight that contexts leave to the shorter context at ``level``."""
        out = np.zeros(len(context))
        for s, at in self._parts(self.bounds[level - 1], context, level):
            arrays = self.file(level, s)
            out[at] = arrays["back"][context[at] - self.bounds[level - 1][s]] * -arrays["back.scale"][0]
        return out

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node at ``level`` of successor ``word`` (id or rank) of nodes of level - 1; -1 where there is none."""
        out = np.full(len(parent), -1, np.int64)
        asked = np.flatnonzero((parent >= 0) & (word >= 0))
        for s, at in self._parts(self.bounds[level - 1], parent[asked], level):
            at = asked[at]
            arrays = self.file(level, s)
            # each n-gram once and in order, which makes the searches below run through memory forwards
            code, back = distinct((parent[at] - self.bounds[level - 1][s]).astype(U) << U(WORD_BITS) | word[at].astype(U))
            local, own = (code >> U(WORD_BITS)).astype(np.int64), code & U((1 << WORD_BITS) - 1)
            context = np.flatnonzero(np.diff(local, prepend=-1))
            some = local[context]
            # pointers are kept strictly increasing by adding the node number
            first, end = (x.astype(np.int64) - some - k for k, x in enumerate(arrays["pointers"].pair(some)))
            base = np.zeros(len(some), U)
            base[first > 0] = arrays["values"].get(first[first > 0] - 1) + U(1)
            times = np.diff(np.append(context, len(local)))
            i = arrays["values"].find(np.repeat(base, times) + own)
            out[at] = np.where((i >= np.repeat(first, times)) & (i < np.repeat(end, times)), i + self.offsets[level - 1][s], -1)[back]
        return out

    def first_child(self, level: int, parent: np.ndarray) -> np.ndarray:
        """The node at ``level`` from which the successors of nodes of level - 1 begin."""
        node, back = distinct(parent)
        out = np.zeros(len(node), np.int64)
        for s, at in self._parts(self.bounds[level - 1], node, level):
            local = node[at] - self.bounds[level - 1][s]
            out[at] = self.file(level, s)["pointers"].get(local).astype(np.int64) - local + self.offsets[level - 1][s]
        return out[back]

    def contexts(self, nodes: np.ndarray, begins: np.ndarray, level: int) -> np.ndarray:
        """The nodes before each token; at level 1 the end token stands before each text, longer contexts don't reach over it."""
        before = np.concatenate([[-1], nodes[:-1]])[: len(nodes)]
        before[begins] = self.end_id if level == 1 else -1
        return before

    def grams(self, nodes: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, word id or rank) of the n-gram that ends in each token, one order longer than the last of ``nodes``.

        ``nodes`` has per level the node of the n-gram that ends in each token.  Either is -1 where the context or
        the n-gram without its first word is unknown.
        """
        k = len(nodes) + 1
        context = self.contexts(nodes[-1], begins, k - 1)
        if k == 2:
            return context, nodes[0]
        word = np.full(len(context), -1, np.int64)
        at = np.flatnonzero((context >= 0) & (nodes[-1] >= 0))
        word[at] = nodes[-1][at] - self.first_child(k - 1, self.contexts(nodes[-2], begins, k - 2)[at])
        return context, word

    @functools.cached_property
    def _end(self) -> int:
        return int(self.find(np.array([END], U))[0])

    @property
    def end_id(self) -> int:
        return self._end

    def unigram(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, log10 probabilities) of word ids."""
        count = np.zeros(len(ids), np.int64)
        known = ids >= 0
        count[known] = self.own(1, ids[known], "count")
        return count, np.log10((count + ADD) / (self.total + ADD * (self.words + 1)))

    def nodes(self, ids: np.ndarray, begins: np.ndarray, level: int) -> list[np.ndarray]:
        """Per level up to ``level`` the node of the n-gram that ends in each token."""
        found = [ids]
        while len(found) < level:
            found.append(self.child(len(found) + 1, *self.grams(found, begins)))
        return found

    def score(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unigram log10 probability, model log10 probability) of each token."""
        nodes = self.nodes(ids, begins, len(self.offsets))
        different, where = distinct(nodes[0])
        base = self.unigram(different)[1][where]
        best = base.copy()
        for k in range(2, len(nodes) + 1):
            context = self.contexts(nodes[k - 2], begins, k - 1)
            # the longest n-gram that is there has the probability, contexts of longer ones pass it on
            hit = nodes[k - 1] >= 0
            at = np.flatnonzero(~hit & (context >= 0))
            best[at] += self.back(k, context[at])
            if k == len(nodes):
                at = np.flatnonzero(hit)
            else:
                at = np.flatnonzero(hit & (nodes[k] < 0))
            best[at] = self.own(k, nodes[k - 1][at], "prob")
        return base, best


def _quantised(name: str, log10: np.ndarray) -> dict[str, np.ndarray]:
    scale = max(float(-log10.min()) if len(log10) else 0.0, 1e-9) / 255
    return {name: np.clip(np.rint(-log10 / scale), 0, 255).astype(np.uint8), name + ".scale": np.array([scale])}


def _counts(count: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as a byte each; those of 255 or more stand apart."""
    many = np.flatnonzero(count >= 255)
    return {"count": np.minimum(count, 255).astype(np.uint8), "count.at": _narrow(many), "count.many": _narrow(count[many])}


def _count_at(arrays: dict, node: np.ndarray) -> np.ndarray:
    """Counts at nodes of a shard."""
    out = arrays["count"][node].astype(np.int64)
    many = np.flatnonzero(out == 255)
    out[many] = arrays["count.many"][np.searchsorted(arrays["count.at"], node[many])]
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


MADE = "shard long, n long, total long, cuts array<long>"


def _made(shard: int, count: np.ndarray, share: int) -> pd.DataFrame:
    """What the driver needs of a shard: nodes, occurrences, and nodes at which its contexts may be cut for the next level."""
    running = np.cumsum(count)
    total = int(running[-1]) if len(running) else 0
    cuts = np.unique(np.searchsorted(running, np.arange(share, total, share), "right")) if share else np.zeros(0, np.int64)
    return pd.DataFrame({"shard": [shard], "n": [len(count)], "total": [total], "cuts": [cuts[(cuts > 0) & (cuts < len(count))].tolist()]})


def _last_words(arrays: dict) -> np.ndarray:
    """The successor in each node of a shard."""
    value = arrays["values"].all().astype(np.int64)
    pointer = arrays["pointers"].all().astype(np.int64)
    pointer -= np.arange(len(pointer))
    first = np.repeat(pointer[:-1], np.diff(pointer))
    return value - np.where(first > 0, value[first - 1] + 1, 0)


def _write_level(trie: Trie, level: int, s: int, code: np.ndarray, count: np.ndarray, top: bool, share: int) -> pd.DataFrame:
    if not len(code):  # a shard without nodes has no file
        return _made(s, count, share)
    lo = int(trie.bounds[level - 1][s])
    ends = np.append(trie.bounds[level - 1][1:], trie.offsets[level - 2][-1])
    parents = int(ends[s]) - lo
    # a shard's contexts lie in one shard of the level before
    of = int(np.searchsorted(trie.offsets[level - 2], lo, "right")) - 1
    part = slice(lo - int(trie.offsets[level - 2][of]), lo - int(trie.offsets[level - 2][of]) + parents)
    before = trie.file(level - 1, of)
    parent, word = (code >> U(WORD_BITS)).astype(np.int64), (code & U((1 << WORD_BITS) - 1)).astype(np.int64)
    pointer = np.searchsorted(parent, np.arange(parents + 1))
    last = pointer[1:][pointer[1:] > pointer[:-1]] - 1  # last successor of each parent that has any
    value = (word + np.concatenate([[0], np.cumsum(word[last] + 1)[:-1]]).repeat(np.diff(np.concatenate([[-1], last])))).astype(U)
    values = EliasFano.encode(value, "v.")
    del value
    context = _count_at(before, np.arange(part.start, part.stop))
    gone = np.bincount(parent, weights=count - DISCOUNT, minlength=parents)
    left = np.clip(1 - gone / np.maximum(context, 1), 1e-9, 1.0)
    if level == 2:
        different, where = distinct(word)
        lower, suffix = trie.unigram(different)[1][where], word
    else:
        # the suffix's node: the parent's last word leads to its successors, in which ``word`` is the rank
        inner = np.asarray(before["suffix"][part]).astype(np.int64) if level > 3 else _last_words(before)[part]
        suffix = trie.first_child(level - 1, inner[parent]) + word
        lower = trie.own(level - 1, suffix, "prob")
    prob = np.log10((count - DISCOUNT) / context[parent] + left[parent] * 10.0**lower)
    # counts and suffixes serve to build the next level only; at level 2 the suffix is the word, which the values tell
    save(
        f"{trie.path}/{level}-{s}.bin",
        values | EliasFano.encode((pointer + np.arange(parents + 1)).astype(U), "p.") | _counts(count[:0] if top else count) | {"suffix": _narrow(suffix[:0] if top or level == 2 else suffix)} | _quantised("prob", np.minimum(prob, 0)) | _quantised("back", np.log10(left)),
    )
    return _made(s, count, share)


# ---------------------------------------------------------------- from texts to nodes
def _texts(batch: pa.RecordBatch, i: int):
    """(first row, end row, token hashes, offsets) of pieces of a text column."""
    for lo, hi, u8, offsets in tk.pieces(batch.column(i), PIECE):
        yield lo, hi, *tokens(u8, offsets)


def _kind(most: int):
    return np.dtype("<i4" if most < 1 << 31 else "<i8")


def _id_pieces(batch: pa.RecordBatch, column: int, trie: Trie):
    """(first row, end row, word ids, offsets) of pieces of the column of word ids."""
    kind = _kind(trie.words)
    for lo, hi, u8, offsets in tk.pieces(batch.column(column), ID_PIECE):
        yield lo, hi, u8.view(kind).astype(np.int64), offsets // kind.itemsize


def _binary(ids: np.ndarray, cut: np.ndarray, kind: np.dtype) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * kind.itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def with_words(rows: DataFrame, trie: Trie) -> DataFrame:
    """``keep`` and ``train`` with the word ids of ``text`` as little-endian numbers."""
    kind = _kind(trie.words)

    def run(batches):
        for batch in tk.steady(batches):
            for lo, hi, hashes, cut in _texts(batch, 2):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), _binary(trie.ids(hashes), cut, kind)], names=["keep", "train", "ids"])

    return rows.select("keep", "train", "text").mapInArrow(run, StructType([*rows.select("keep", "train").schema.fields, StructField("ids", BinaryType())]))


def fit(spark: SparkSession, docs: DataFrame, keep: list[str], train: Column, order: int = ORDER, cut: tuple[int, ...] | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[Trie, DataFrame]:
    """Learn from the rows of ``docs`` where ``train`` holds.

    Gives the trie in the shared folder, and a table of all rows (keep, train, word ids).
    """
    cut = cut or (1,) * order
    rows = docs.select((F.struct(*(docs[f"`{c}`"] for c in keep)) if keep else F.lit(True)).alias("keep"), F.coalesce(train, F.lit(False)).alias("train"), docs["text"].alias("text"))
    learned = rows.where("train").select("text")
    path = new_folder(spark, "trie")
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // shard_bytes))
    share = max(1, size // shards // 6)  # occurrences that a shard of a later level may have, about: as many as tokens in a shard's bytes

    def words(batch):
        for _, _, hashes, _ in _texts(batch, 0):
            yield hashes, None

    def write_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, code, count = merged(pdf)
        save(f"{path}/1-{key[0]}.bin", EliasFano.encode(code, "v.") | _counts(count))
        return _made(int(key[0]), count, share)

    def offsets(found, of: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(first node of each shard, first contexts of the next level's shards, occurrences)."""
        n, begins, total = np.zeros(of, np.int64), [], 0
        for r in found.collect():  # a row per shard
            n[r["shard"]] = r["n"]
            total += r["total"]
            begins += [(r["shard"], c) for c in [0, *r["cuts"]] if r["n"]]
        first = np.concatenate([[0], np.cumsum(n)])
        return first, np.unique(np.array([0, *(first[s] + c for s, c in begins)], np.int64)), total

    made = blobs(learned, words, by_hash(shards), shards, size).groupBy("unit").applyInPandas(write_words, MADE)
    first, bounds, total = offsets(made, shards)
    trie = Trie(path, total, [np.zeros(0, np.int64)], [first])
    table = written(spark, with_words(rows, trie), "words", compression="zstd")
    for level in range(2, order + 1):
        trie = Trie(path, total, [*trie.bounds, bounds], trie.offsets)
        grams = blobs(table.where("train"), _grams(trie, level, cut), by_context(bounds), len(bounds), size)
        made = grams.groupBy("unit").applyInPandas(_writer(trie, level, cut[level - 1], level == order, share), MADE)
        first, bounds, _ = offsets(made, len(bounds))
        trie = Trie(path, total, trie.bounds, [*trie.offsets, first])
    return trie, table


def _grams(trie: Trie, level: int, cut: tuple[int, ...]):
    def grams(batch):
        for _, _, ids, offsets in _id_pieces(batch, 2, trie):
            nodes = trie.nodes(ids, offsets[:-1], level - 1)
            context, word = trie.grams(nodes, offsets[:-1])
            good = (context >= 0) & (word >= 0)
            if level == 2 and cut[1] > 1:
                for part in (context, word):
                    at = np.flatnonzero(good)
                    good[at] = trie.own(1, part[at], "count") >= cut[1]
            yield context[good].astype(U), word[good].astype(U)

    return grams


def _writer(trie: Trie, level: int, least: int, top: bool, share: int):
    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, code, count = merged(pdf)
        return _write_level(trie, level, int(key[0]), code[count >= least], count[count >= least], top, 0 if top else share)

    return write


def build(spark: SparkSession, rows: DataFrame, order: int = ORDER, cut: tuple[int, ...] | None = None, shard_bytes: int = SHARD_BYTES) -> Trie:
    """The trie of ``text`` of all ``rows``."""
    return fit(spark, rows, [], F.lit(True), order, cut, shard_bytes)[0]


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _totals(trie: Trie, ids: np.ndarray, cut: np.ndarray) -> list[pa.Array]:
    base, best = trie.score(ids, cut[:-1])
    add = lambda x: pa.array(np.add.reduceat(x, cut[:-1]) if len(x) else x)
    return [pa.array(np.diff(cut)), add((ids >= 0).astype(np.int64)), add(base), add(best)]


def score(docs: DataFrame, trie: Trie, keep: list[str]) -> DataFrame:
    """``keep`` columns of each document with n_tokens, n_known, base_score and score."""

    def one(u8, offsets):
        hashes, cut = tokens(u8, offsets)
        return dict(zip((c.split()[0] for c in SCORES.split(", ")), _totals(trie, trie.ids(hashes), cut), strict=True))

    return tk.map_text(docs, keep, "text", one, SCORES, PIECE)


def score_table(table: DataFrame, trie: Trie) -> DataFrame:
    """The same for a table of ``fit``: columns of keep, train and scores."""

    def run(batches):
        for batch in tk.steady(batches):
            for lo, hi, ids, cut in _id_pieces(batch, 2, trie):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), *_totals(trie, ids, cut)], names=["keep", "train", *(c.split()[0] for c in SCORES.split(", "))])

    new = StructType.fromDDL(SCORES)
    return table.mapInArrow(run, StructType([*table.select("keep", "train").schema.fields, *new.fields])).select("keep.*", "train", *new.names)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trie, table = fit(spark, docs, ["doc_id"], ~held_out())
    found = score_table(table, trie)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")
