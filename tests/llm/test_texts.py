"""Text primitives, pre-tokens and Elias-Fano sequences."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelark.llm import eliasfano, textkit, token_counts

from . import brute

PIECES = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "　", "\xa0", "!", "日本", "😀", "\r\n", "'ve", "<|endoftext|>", "<|endof", "\x1c", "́", "_"]
texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join) | st.none(), max_size=8)
PATTERN = regex.compile(public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_pretokens(rows):
    got = []
    for lo, hi, u8, offsets in textkit.pieces(pa.array(rows, pa.string()), 30):
        starts, ends, special = token_counts.pretokens(u8, offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        own = [[] for _ in range(hi - lo)]
        for a, b, d in zip(starts, ends, doc, strict=True):
            own[d].append(u8[a:b].tobytes().decode())
        got += own
    assert got == [[m for part in (t or "").split("<|endoftext|>") for m in PATTERN.findall(part)] for t in rows]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(rows):
    for table, find in ((textkit.ALNUM, brute.words), (textkit.NONSPACE, lambda t: brute.SPACED.findall((t or "").translate(brute.LOWER)))):
        got = []
        for _, _, u8, offsets in textkit.pieces(pa.array(rows, pa.string()), 16):
            w = textkit.Words(textkit.LOWER[u8], offsets, table)
            got += [[x.decode() for x in w.strings(a, b)] for a, b in zip(w.doc, w.doc[1:], strict=False)]
            hashes = w.hashes().tolist()
            assert hashes == [textkit.text_hash(x) for x in w.strings(0, None)]
        assert got == [find(t) for t in rows]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 2) | st.integers(0, 3000), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.uint64)
    ef = eliasfano.EliasFano(eliasfano.EliasFano.encode(v))
    assert (ef.get(np.arange(len(v))) == v).all() and (ef.find(v) == np.arange(len(v))).all()
    where = {int(x): i for i, x in enumerate(v)}
    assert ef.find(np.array(others, np.uint64)).tolist() == [where.get(x, -1) for x in others]


def test_files_are_mapped(tmp_path):
    eliasfano.save(f"file://{tmp_path}/a/b.bin", {"x": np.arange(5), "y": np.array([1, 2, 3], np.uint8)})
    back = eliasfano.load(f"file://{tmp_path}/a/b.bin")
    assert back["x"].tolist() == [0, 1, 2, 3, 4] and back["y"].tolist() == [1, 2, 3]


def thue_morse(size, pair):
    """Two strings of two letters that any polynomial hash modulo a power of two confuses."""
    a = "".join(pair[bin(i).count("1") % 2] for i in range(size))
    return a, a.translate(str.maketrans(pair, pair[::-1]))


@pytest.mark.parametrize("size", [8, 9, 16, 64, 65, 1024])
def test_hashes_of_strings_that_confuse_polynomials(size):
    strings = [s.encode() for pair in ("ab", "Ga") for s in thue_morse(size, pair)]
    assert len({textkit.text_hash(s) for s in strings}) == 4
    few = [bytes(x) for n in range(4) for x in itertools.product(b"\0ab", repeat=n)]
    assert len({textkit.text_hash(s) for s in few}) == len(few)
    both = np.frombuffer(b"".join(strings), np.uint8)
    cut = np.arange(5) * size
    got = textkit.spans_hash(both, cut[:-1], cut[1:])
    assert got.tolist() == [textkit.text_hash(s) for s in strings] and not set(got) & set(textkit.spans_hash(both, cut[:-1], cut[1:], 1))


def test_classes_are_those_of_the_tokenizer():
    path, rng = public_tokenizers.path(token_counts.TOKENIZER), random.Random(4)
    table = token_counts.classes(path)
    odd = np.flatnonzero(table != token_counts.classes())
    pool = [chr(c) for c in odd.tolist() if not 0xD800 <= c < 0xE000] + list(" '\n\t12smtdrevl　\x85!aß日")
    cut = token_counts._tokenizer(path).pre_tokenizer.pre_tokenize_str
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = token_counts.pretokens(raw, np.array([0, len(raw)]), table)
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [text[a:b] for _, (a, b) in cut(text)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 2) | st.integers(0, 3000) | st.integers(0, 50).map(lambda i: i * 2**50), min_size=2, max_size=200))
def test_neighbours_in_elias_fano(values):
    v = np.array(sorted(values), np.uint64)
    one, two = eliasfano.EliasFano(eliasfano.EliasFano.encode(v)).pair(np.arange(len(v) - 1))
    assert (one == v[:-1]).all() and (two == v[1:]).all()
    assert (eliasfano.EliasFano(eliasfano.EliasFano.encode(v)).all() == v).all()


def test_equal_high_parts_over_many_words():
    """A run of values with one high part that is longer than 64 bits."""
    v = np.concatenate([np.arange(300), [2**40, 2**40 + 1], 2**41 + np.arange(500) * 3]).astype(np.uint64)
    ef = eliasfano.EliasFano(eliasfano.EliasFano.encode(v))
    assert (ef.find(v) == np.arange(len(v))).all() and (ef.find(v + np.uint64(1))[-400:] == -1).all()
    one, two = ef.pair(np.arange(len(v) - 1))
    assert (one == v[:-1]).all() and (two == v[1:]).all()
