"""License scan with a positional rare-token index (operator 1).

TEMPLATES hold the words of known license notices.  The index maps each of their words to postings (template,
position).  A document is scanned in three steps:

1. look-up: per template whose mandatory key phrases have all their words in the document, only the rarest word of
   the first key phrase is looked up, where rarity is the inverse document frequency over the whole corpus;
2. intersection: the key phrase is compared word by word at the places that the word's positions in it propose;
3. verification: the other mandatory key phrases must stand word by word within a template's length.  They decide;
   the share of the template's words found within BAND words of their places is the score only, so that inserted or
   left out words drop no notice.

The three base phrases are templates too, with the phrase itself as the key phrase.  A phrase can't occur
without its rarest word, so looking that word up at every place it has finds every place of the phrase.

Defined results: null is empty text; documents without license words get zero places, null bounds, empty labels
and score 0; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .decontaminate import Lookup

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, words of the notice, mandatory key phrases)
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("you may not use this file except in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("it under the terms of the gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("subject to the terms of the mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("obtaining a copy of the software and accompanying documentation covered by this license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("licensed under a creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("licensed under cc by sa 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("licensed under cc by 4 0",)),
    ("bsd", "bsd license", ("bsd license",)),
    ("mpl", "mozilla public license", ("mozilla public license",)),
    ("isc", "isc license", ("isc license",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("gpl", "gnu gpl", ("gnu gpl",)),
]
BAND = 8
SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def find_phrase(ids: np.ndarray, phrase: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of the places ``begins``, those where the words are the phrase."""
    begins = begins[(begins >= 0) & (begins + len(phrase) <= len(ids))]
    return begins[(ids[begins[:, None] + np.arange(len(phrase))] == phrase).all(1)] if len(begins) else begins


class Index:
    """Templates, postings and rarity; ``frequency`` has the documents of each vocabulary word."""

    def __init__(self, frequency: dict[int, int] | None = None):
        entries = [(label, phrase.encode().split(), [phrase.encode().split()], True) for phrase, label in BASE.items()]
        entries += [(label, text.encode().split(), [k.encode().split() for k in keys], False) for label, text, keys in TEMPLATES]
        vocabulary = sorted({w for _, words, keys, _ in entries for w in [*words, *(x for k in keys for x in k)]})
        hashes = np.array([tk.text_hash(w) for w in vocabulary], tk.U)
        self.look = Lookup(hashes)
        code = {w: int(np.searchsorted(self.look.sorted, h)) for w, h in zip(vocabulary, hashes, strict=True)}
        self.frequency = np.array([(frequency or {}).get(c, 0) for c in range(len(code))], np.int64)
        self.templates = [(label, np.array([code[w] for w in words]), [np.array([code[w] for w in k]) for k in keys], base) for label, words, keys, base in entries]
        #: Per template: the words that it needs, the rarest word of its first key phrase, and where the phrase has it.
        self.needs = []
        for _, _, keys, _ in self.templates:
            rarest = min(keys[0].tolist(), key=lambda w: (self.frequency[w], w))
            self.needs.append(({w for k in keys for w in k.tolist()}, rarest, np.flatnonzero(keys[0] == rarest)))

    def scan(self, place: np.ndarray, word: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, float, int]]]:
        """Base places (template, first word) and matches (template, score, first word) of one document.

        ``place`` and ``word`` are the document's license words; it has n words.
        """
        present = set(word.tolist())
        wanted = [t for t, (needed, _, _) in enumerate(self.needs) if needed <= present]
        if not wanted:
            return [], []
        ids = np.full(n, -1)
        ids[place] = word
        base, matches = [], []
        for t in wanted:
            _, template, keys, is_base = self.templates[t]
            _, rarest, at = self.needs[t]
            found = find_phrase(ids, keys[0], np.unique((place[word == rarest][:, None] - at).ravel()))
            if is_base:
                base += [(t, int(p)) for p in found]
                continue
            size = len(template)
            lead = int(find_phrase(template, keys[0], np.arange(size))[0])
            others = [find_phrase(ids, k, np.arange(n)) for k in keys[1:]] if len(found) else []
            best = None
            for p in (found - lead).tolist():
                if not all(np.searchsorted(o, p - size) < np.searchsorted(o, p + 2 * size) for o in others):
                    continue
                q = p + np.arange(size)[:, None] + np.arange(-BAND, BAND + 1)
                inside = (q >= 0) & (q < n)
                score = float((inside & (ids[np.where(inside, q, 0)] == template[:, None])).any(1).mean())
                if best is None or score > best[1]:
                    best = (t, score, p)
            if best:
                matches.append(best)
        return base, matches


def frequencies(docs: DataFrame) -> dict[int, int]:
    """Documents, of all, that have each vocabulary word; as many rows as the templates have words."""
    index = Index()

    def run(batches):
        for batch in tk.steady(batches):
            for _, _, u8, offsets in tk.pieces(batch.column(0)):
                words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
                at, code = index.look.find(words.hashes())
                pair = np.unique(np.stack([np.searchsorted(words.doc, at, "right") - 1, code]), axis=1)
                n = np.bincount(pair[1], minlength=len(index.look.sorted))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and SCAN of every document."""
    index = Index(frequencies(docs))

    def one(u8, offsets):
        words = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
        at, code = index.look.find(words.hashes())
        cut = np.searchsorted(at, words.doc)
        n = len(words.counts)
        out = {"n_words": words.counts, "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [[]] * n, "labels": [[]] * n, "score": [0.0] * n}
        for d in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[d], cut[d + 1])
            base, matches = index.scan(at[mine] - words.doc[d], code[mine], int(words.counts[d]))
            if not base and not matches:
                continue
            names = sorted({index.templates[t][0] for t, _ in base})
            out["n_base"][d], out["base_labels"][d] = len(base), names
            if base:
                begins = [p for _, p in base]
                out["first_word"][d], out["last_word"][d] = min(begins), max(begins)
            out["labels"][d] = sorted({*names, *(index.templates[t][0] for t, _, _ in matches)})
            out["score"][d] = 1.0 if base else max(s for _, s, _ in matches)
        return out

    return tk.map_text(docs, ["doc_id"], "text", one, SCAN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("base_labels", "labels")})
