"""Every operator on the odd rows, against plain versions; and on an empty table."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorelark.llm import decontaminate, language, licenses, lines, lm, near, packing, quality, suffixes, token_counts

from . import brute


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_licenses(make, edge):
    got = licenses.scan(make(edge))
    expected = sorted(((d, *brute.license_places(t, licenses.BASE)[:4]) for d, t, *_ in edge), key=repr)
    assert sorted_rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word") == expected
    assert licenses.scan(make([])).count() == 0


def test_license_templates_need_their_key_phrases(make):
    _, text, keys = licenses.TEMPLATES[0]
    rows = [(1, "Intro. " + text.upper() + " end"), (2, text.replace(keys[0], "something else entirely here now")), (3, "the software is free " * 40)]
    got = {r.doc_id: r for r in licenses.scan(make(rows)).collect()}
    assert got[1].labels == ["mit"] and got[1].score > 0.95 and got[1].n_base == 0
    assert got[2].labels == [] and got[3].labels == []


def test_license_notices_with_inserted_words(make):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    rows = [(1, bsd), (2, "Copyright\n" + bsd)]
    for i, (_, text, keys) in enumerate(licenses.TEMPLATES[:9]):
        last = max(text.index(k) + len(k) for k in keys)
        rows.append((10 + i, text[:last] + " really" + text[last:] if last < len(text) else "really " + text))
    got = {r.doc_id: r for r in licenses.scan(make(rows)).collect()}
    assert all("bsd" in got[i].labels and got[i].score > 0.95 for i in (1, 2))
    assert all(label in got[10 + i].labels for i, (label, *_) in enumerate(licenses.TEMPLATES[:9]))


def test_language(spark, make, words):
    rng = random.Random(3)
    kinds = {"aa": words[:60], "bb": words[100:160], "cc": words[200:260]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k) for i, k in enumerate(list(kinds) * 60)]
    model = language.train(spark, make(rows))
    assert model.languages == ["aa", "bb", "cc"]
    fresh = [(k, " ".join(rng.choice(kinds[k]) for _ in range(25))) for k in kinds for _ in range(20)]
    docs = make([(i, t) for i, (_, t) in enumerate(fresh)] + [(900, None), (901, ""), (902, "123 !!"), (903, "Ω" * 50)])
    got = {r.doc_id: r for r in language.predict(spark, docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == k for i, (k, _) in enumerate(fresh)]) > 0.95
    assert not any(got[i].rejected for i in range(len(fresh)))
    assert [(got[i].lang_pred, got[i].rejected, got[i].score) for i in (900, 901, 902)] == [("und", True, 0.0)] * 3
    assert got[903].rejected and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_training_rows(spark, make, edge):
    model = language.train(spark, make([]))
    got = language.predict(spark, make(edge), model, ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == len(edge)


def test_language_rejects_other_languages(spark, make, words):
    """Unseen languages and random letters are rejected at several lengths, own texts aren't."""
    rng = random.Random(9)
    prose = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    rows = [(i, prose(words[:60] if i % 2 else words[100:160], rng.choice((5, 30, 120, 500))), "ab"[i % 2]) for i in range(240)]
    model = language.train(spark, make(rows))
    latin, cyrillic, greek, han = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5E00)))
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    strange = [" ".join(word(a) for _ in range(n)) for a in (latin, cyrillic, greek, han) for n in (20, 100, 500) for _ in range(10)]
    unseen = [prose([word(a) for _ in range(60)], n) for a in (latin, cyrillic) for n in (20, 100, 500) for _ in range(10)]
    own = [prose(words[:60], n) for n in (20, 100, 500) for _ in range(20)]
    got = {r.doc_id: r.rejected for r in language.predict(spark, make(list(enumerate(strange + unseen + own))), model, ["doc_id"]).collect()}
    n, k = len(strange), len(strange) + len(unseen)
    assert np.mean([got[i] for i in range(n)]) > 0.95 and np.mean([got[i] for i in range(n, k)]) > 0.95
    assert np.mean([got[i] for i in range(k, k + len(own))]) < 0.05


def test_language_against_plain_nearest_centroids(spark, make, edge, words):
    """N-grams, cosines and the nearest centroid, one text at a time."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(words[100 * (i % 3) : 100 * (i % 3) + 60]) for _ in range(rng.randint(5, 60))), "abc"[i % 3]) for i in range(90)]
    model = language.train(spark, make(rows))
    texts = [t for _, t, *_ in edge if t and len(t) < 20000] + [" a", "b ", " 1 é "]

    def plain(text):
        folded = []
        for b in text.encode():
            c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
            if c != 32 or not folded or folded[-1] != 32:
                folded.append(c)
        count = np.zeros(language.BUCKETS, np.int64)
        for n in language.GRAMS:
            for i in range(len(folded) - n + 1):
                h = 0
                for c in folded[i : i + n]:
                    h = (h * 0x01000193 + c * 0x9E3779B1) & 0xFFFFFFFF
                count[((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(count) * model.idf
        return (v / max(np.linalg.norm(v), 1e-12)) @ model.centroids.T

    got = {r.doc_id: r for r in language.predict(spark, make(list(enumerate(texts))), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        if any(c.isalpha() for c in text):
            cosines = plain(text)
            near = {model.languages[model.owner[k]] for k in np.flatnonzero(cosines > cosines.max() - 1e-5)}
            assert got[i].lang_pred in near and abs(got[i].score - np.clip(cosines.max(), 0, 1)) < 1e-4
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_language_of_repeated_rows(spark, make, words):
    """However often few texts are repeated, each language keeps its sample of distinct texts."""
    kinds = {lang: [f"{' '.join(words[a : a + 30])} {i}" for i in range(n)] for lang, a, n in (("aa", 0, 1), ("bb", 100, 1), ("cc", 200, 2), ("dd", 300, 1))}
    for lang, texts in kinds.items():
        alone = language.train(spark, make([(i, texts[i % len(texts)], lang) for i in range(1000)]), sample=1)
        assert alone.languages == [lang] and len(alone.owner) == 1
    rows = [(i, texts[i % len(texts)], lang) for lang, texts in kinds.items() for i in range(1000)]
    model = language.train(spark, make(rows))
    assert model.languages == list(kinds) and np.bincount(model.owner).tolist() == [1, 1, 2, 1]
    got = language.predict(spark, make([(i, texts[0]) for i, texts in enumerate(kinds.values())]), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in sorted(got)] == list(kinds)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination(spark, make, edge, block):
    body = edge[11][1].split()
    items = [(1, " ".join(body[40:75])), (2, "x"), (3, None), (4, ""), (None, " ".join(body[60:72])), (5, " ".join(edge[12][1].split()[3:12])), (6, "no such words here at all, none of them, never ever"), (1, " ".join(body[40:75]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(spark, make(edge), benchmark, ["doc_id"], block_bytes=block)
    expected = []
    for d, t, *_ in edge:
        places, found = brute.hit_words(t, items)
        expected.append((d, len(brute.words(t)), len(places), sorted(str(x) for x in found if x is not None)))
    assert sorted_rows(got, "doc_id", "n_words", "n_hit", "items") == sorted(expected, key=repr)
    assert decontaminate.find(spark, make([]), benchmark, ["doc_id"]).count() == 0
    assert {r.n_hit for r in decontaminate.find(spark, make(edge), benchmark.limit(0), ["doc_id"]).collect()} == {0}


@pytest.mark.parametrize("hot", [1 << 18, 5])
def test_token_counts(spark, make, edge, hot):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    expected = sorted(((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in edge), key=repr)
    assert sorted_rows(token_counts.counts(spark, make(edge), path, hot), "doc_id", "n_bytes", "n_tokens") == expected
    assert token_counts.counts(spark, make([]), path).count() == 0


def test_line_dedup(spark, make, edge):
    boiler = "Subscribe to our newsletter today, dear reader!"
    got = lines.dedup(spark, make(edge).select("doc_id", "source", "text")).collect()
    assert len(got) == len(edge)
    removed = {r.doc_id: r.n_removed for r in got if r.n_removed}
    assert removed == {**{100 + i: 1 for i in range(1, 14)}, 103: 2}
    assert all(boiler not in r.kept for r in got if r.doc_id in removed) and boiler in next(r.kept for r in got if r.doc_id == 100)
    assert all(r.kept == r.text for r in got if r.doc_id not in removed)
    assert lines.dedup(spark, make([])).count() == 0


def test_lines_near_the_threshold_are_counted_exactly(spark, make):
    rows = [(i, f"a line that stands on {n} sites", "en", f"s{i}") for n in (9, 10, 11) for i in range(n)]
    rows = [(k, t, lang, s) for k, (_, t, lang, s) in enumerate(rows)]
    got = collections.Counter(r.text for r in lines.dedup(spark, make(rows)).where("n_removed > 0").collect())
    assert got == {"a line that stands on 10 sites": 9, "a line that stands on 11 sites": 10}


def test_packing(make, edge):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, (_, t, *_) in enumerate(edge)]
    got = packing.pack(make(rows), path, with_ids=True).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in rows:
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in mine) == np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert all(r.length == packing.LENGTH for r in mine[1:])
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= packing.LENGTH
    assert packing.pack(make([]), path).count() == 0


def test_bins_choose_the_fullest_that_fits_and_close_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.place(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    b = packing.Bins(10, 2)
    assert [b.place(n)[0] for n in (8, 7, 6, 3, 2)] == [0, 1, 2, 1, 2]  # bin 0 closed when bin 2 opened


def test_quality(spark, make, edge):
    got = quality.score(spark, make(edge))
    expected = sorted(((d, *brute.quality(t)) for d, t, *_ in edge), key=repr)
    assert sorted_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected
    assert quality.score(spark, make([])).count() == 0


def test_quality_posteriors_find_the_bad_class():
    rng, rows = random.Random(5), collections.Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        votes = [0 if rng.random() < 0.2 else (2 if bad else 1) if rng.random() < 0.9 else (1 if bad else 2) for _ in quality.RULES]
        rows[bad, sum(v * 3**i for i, v in enumerate(votes))] += 1
    share, accuracy, posterior = quality.fit(collections.Counter({p: sum(n for (_, q), n in rows.items() if q == p) for _, p in rows}))
    right = sum(n for (bad, p), n in rows.items() if (posterior[p] < 0.5) == bad)
    assert right > 3960 and abs(share - 0.8) < 0.03 and all(abs(a - 0.9) < 0.03 for a in accuracy)
    assert quality.fit({})[2] == {}


@pytest.mark.parametrize("bucket", [8 << 20, 3000])
def test_suffixes(spark, make, edge, bucket):
    rows = edge
    got = suffixes.remove(spark, make(rows), ["doc_id"], bucket)
    expected = sorted(((d, *e) for (d, *_), e in zip(rows, brute.removed([t for _, t, *_ in rows]), strict=True)), key=repr)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffixes.remove(spark, make([]), ["doc_id"]).count() == 0


@pytest.mark.parametrize("bucket", [8 << 20, 1500])
def test_suffixes_of_strings_that_confuse_hashes(spark, make, bucket):
    """Bytes decide: strings that a polynomial hash takes for equal stay, one that is repeated with another surrounding goes."""
    rng = random.Random(8)
    mixed = ["".join(pair[bin(i).count("1") % 2] for i in range(512)) for pair in ("Ga", "aG")]
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    passage = noise(430)
    rows = [(0, mixed[0]), (1, mixed[1])] + [(2 + i, noise(rng.randrange(900)) + passage + noise(rng.randrange(900))) for i in range(30)]
    rows += [(40 + i, noise(200) + passage[i : i + 399] + noise(200)) for i in range(3)] + [(50, "\0" * 450), (51, "x" + "\0" * 420)]
    got = suffixes.remove(spark, make(rows), ["doc_id"], bucket)
    expected = sorted(((d, *e) for (d, _), e in zip(rows, brute.removed([t for _, t in rows]), strict=True)), key=repr)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_multikey_sort_orders_like_sorting_whole_rows():
    keys = np.random.default_rng(1).integers(0, 3, (500, 6)).astype(np.uint64)
    order, same = suffixes.multikey_sort(keys, keys[:, 0])
    rows = [tuple(r) for r in keys[order].tolist()]
    assert rows == sorted(rows) and same.tolist() == [False] + [a == b for a, b in zip(rows, rows[1:], strict=False)]


@pytest.mark.parametrize(("cut", "shard_bytes", "fan"), [((1, 2, 2), 32 << 20, 256), (None, 20000, 2)])
def test_lm(spark, make, edge, cut, shard_bytes, fan, monkeypatch):
    """Against plain interpolated discounting; with many shards also over several passes of blobs."""
    monkeypatch.setattr(lm, "FAN", fan)
    least = (cut or (1, 1, 1))[1]
    rows = [(i, t) for i, (_, t, *_) in enumerate(edge)] + [(1000 + i, "the cat sat on the mat and the dog sat on the cat") for i in range(12)]
    docs = make(rows)
    trie, table = lm.fit(spark, docs, ["doc_id"], ~lm.held_out(), cut=cut, shard_bytes=shard_bytes)
    got = {r.doc_id: r for r in lm.score(docs, trie, ["doc_id"]).collect()}
    again = {r.doc_id: r for r in lm.score_table(table, trie).collect()}
    assert all(again[i][c] == r[c] or math.isclose(again[i][c], r[c]) for i, r in got.items() for c in ("n_tokens", "n_known", "base_score", "score"))
    assert shard_bytes > 20000 or len(trie.bounds[2]) > len(trie.offsets[0]) > 8
    end, held = " end ", {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*brute.SPACED.findall((t or "").translate(brute.LOWER)), end] for i, t in rows}
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            x = [end, *w]
            uni.update(w)
            bi.update(zip(x, x[1:], strict=False))
            tri.update(zip(x, x[1:], x[2:], strict=False))
    total, size = sum(uni.values()), len(uni)
    bi, tri = ({k: n for k, n in c.items() if n >= least} for c in (bi, tri))
    assert trie.total == total and trie.words == size
    gone = collections.Counter()
    for k, n in [*bi.items(), *tri.items()]:
        gone[k[:-1]] += n - lm.DISCOUNT

    def p(*gram):
        if len(gram) == 1:
            return (uni[gram[0]] + 0.1) / (total + 0.1 * (size + 1))
        context = gram[:-1]
        seen = uni[context[0]] if len(context) == 1 else bi.get(context, 0)
        if not seen:
            return p(*gram[1:])
        kept = (bi if len(gram) == 2 else tri).get(gram, 0)
        return max(kept - lm.DISCOUNT, 0) / seen + (1 - gone[context] / seen) * p(*gram[1:])

    for i, w in tokens.items():
        x = [end, *w]
        r, n = got[i], len(w)
        assert (r.n_tokens, r.n_known) == (n, sum(uni[t] > 0 for t in w))
        assert math.isclose(r.base_score, sum(math.log10(p(t)) for t in w), rel_tol=1e-9)
        exact = math.log10(p(*x[:2])) + sum(math.log10(p(*x[k - 2 : k + 1])) for k in range(2, len(x)))
        assert abs(r.score - exact) < 0.02 * n + 0.05
    none = lm.build(spark, make([]))
    assert {round(r.score, 9) for r in lm.score(docs, none, ["doc_id"]).collect()} == {0.0}


def test_lm_query_keeps_ngrams_that_occur_once(spark, make, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    make([(learned, "one two three"), (held, "one two three")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm.query(spark, str(tmp_path)).collect()}
    uni = 1.1 / (4 + 0.1 * 5)
    bi = 0.25 + 0.75 * uni
    exact = math.log10(bi) + 3 * math.log10(0.25 + 0.75 * bi)
    assert got[held].held_out and all(abs(r.score - exact) < 0.02 * 4 for r in got.values())


def test_near(spark, make, edge):
    got = near.join(spark, make(edge)).collect()
    texts = [t for _, t, *_ in edge]
    linked = brute.links(texts)
    ids = [d for d, *_ in edge]
    expected = []
    for i, d in enumerate(ids):
        if not brute.shingle_set(texts[i]):
            expected.append((d, d, 0))
            continue
        group = [ids[j] for j in brute.component(linked, i) if ids[j] is not None]
        expected.append((d, min(group), len(linked[i])))
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == sorted(expected, key=repr)
    assert near.join(spark, make([])).count() == 0


def test_near_in_several_blocks(spark, make, words, monkeypatch):
    """Groups over many blocks give what one block gives."""
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "PER_CALL", 64)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.join(spark, make(rows)).collect()}
    linked = brute.links([t for _, t in rows])
    assert got == {i: (min(brute.component(linked, i)), len(linked[i])) for i, _ in rows}


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near.least_matches()
    assert least == sorted(least)
    rng = np.random.default_rng(4)
    shared = rng.random((2000, near.HASHES)) < 0.8  # similarity exactly at the threshold
    a = rng.integers(0, 256, near.HASHES).astype(np.uint8)
    b = np.where(shared, a, rng.integers(0, 256, shared.shape)).astype(np.uint8)
    assert len(near.survivors(a, b)) == 2000
    far = np.where(rng.random((2000, near.HASHES)) < 0.3, a, rng.integers(0, 256, shared.shape)).astype(np.uint8)
    assert len(near.survivors(a, far)) == 0
