"""Language identification by nearest centroid (operator 2).

A text becomes a normalised TF-IDF vector of byte n-grams of its letters, hashed into BUCKETS.  Each language has
up to CLUSTERS centroids, found by spherical k-means, because one language holds several kinds of text.  The
nearest centroid by cosine names the language; a text farther from it than the ``floor`` of its length is rejected.

Cosines grow with the length of a text, be it of the language or not.  So a language's floor is a line over
lengths: beginnings of its sampled texts, cut at LENGTHS bytes, are held against centroids of the other half of the
sample (own), and so are texts of random letters of four scripts and of the language's own letters dealt anew
(strangers).  The floor is the middle of the LOW quantile of own and the HIGH quantile of strangers, and never
above the former, so that where the two overlap no more than about LOW of a language's texts are lost.

Document frequencies cover all training rows.  Only the clustering looks at a sample, of the SAMPLE distinct texts
per language with the smallest hashes (all texts, if there are fewer), each weighted by its number of rows, so it is
the same in every run and no language is lost; that bound is a parameter.  The model has languages x CLUSTERS x
BUCKETS numbers whatever the corpus size.

Defined results: of languages whose centroids are equally near the first in the alphabet is named; a text of any length is
one task's, as some sixty bytes per byte; a null text, or one without a letter, is ``und`` with score 0 and is rejected; repeated rows
get the same result; rows with a null language are not learned from; without any training row all is ``und``;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .token_counts import _LETTER, byte_classes

BUCKETS, CLUSTERS, SAMPLE, GRAMS = 4096, 4, 400, (1, 2, 3, 4)
LENGTHS, LOW, HIGH, STRANGERS = tuple(1 << k for k in range(2, 15)), 0.05, 0.99, 10
_SCRIPTS = [[chr(c) for c in range(a, b)] for a, b in ((0x61, 0x7B), (0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00))]
_BLOCK = 128
#: Lower case; everything that is not a letter is one kind of gap.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256)], np.uint8)


def counts(u8: np.ndarray, offsets: np.ndarray):
    """(first document, matrix of n-gram counts) for blocks of documents of a piece."""
    text = _FOLD[u8].astype(np.uint32)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)  # runs of gaps count as one
    keep[offsets[:-1][offsets[:-1] < len(text)]] = True  # whatever the text before ends with
    sizes = tk.per_doc(keep, offsets)
    text = text[keep]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, len(sizes), _BLOCK):
        hi = min(lo + _BLOCK, len(sizes))
        part = text[offsets[lo] : offsets[hi]]
        own = np.repeat(np.arange(hi - lo), sizes[lo:hi]) * BUCKETS
        total = np.zeros((hi - lo) * BUCKETS, np.int64)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(part) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1) if len(part) >= n else h[:0]
            if n in GRAMS and len(h):
                same = own[: len(h)] == own[n - 1 :]
                slot = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)
                total += np.bincount((own[: len(h)] + slot)[same], minlength=len(total))
        yield lo, total.reshape(hi - lo, BUCKETS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    floor: np.ndarray  # lowest accepted cosine of each language at LENGTHS

    def floors(self, language: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Lowest accepted cosines of texts with so many n-grams; nothing is asked of an empty text."""
        at = np.log2(1 + len(GRAMS) * np.array([0, *LENGTHS]))
        x = np.log2(1 + grams)
        out = np.zeros(len(x))
        for k in np.unique(language).tolist():
            mine = language == k
            out[mine] = np.interp(x[mine], at, np.append(0.0, self.floor[k]))
        return out


def kmeans(v: np.ndarray, k: int, weight: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the farthest points, so it needs no chance."""
    weight = np.ones(len(v)) if weight is None else weight
    centre = [np.average(v, axis=0, weights=weight)]
    near = v @ centre[0]
    centres = [v[int(near.argmax())]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int((v @ np.array(centres).T).max(1).argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        which = (v @ c.T).argmax(1)
        c = np.array([np.average(v[which == j], axis=0, weights=weight[which == j]) if (which == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _cosines(texts: list[bytes], idf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each text with its nearest centroid."""
    if not texts:
        return np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return np.concatenate([(vectors(count, idf) @ c.T).max(1) for _, count in counts(np.frombuffer(b"".join(texts), np.uint8), offsets)])


def strangers(heads: list[bytes], size: int) -> list[bytes]:
    """Texts of ``size`` bytes of random letters, the same in every run."""
    rng = np.random.default_rng(size)
    out = []
    for letters in _SCRIPTS:
        for _ in range(STRANGERS):
            chars = rng.choice(letters, size)
            chars[np.cumsum(rng.integers(3, 9, size)).clip(max=size - 1)] = " "
            out.append("".join(chars).encode()[:size])
    for head in heads[: 2 * STRANGERS]:
        chars = np.array(list(head.decode(errors="ignore")) or [" "])
        letter = np.flatnonzero(np.char.isalpha(chars))
        chars[letter] = chars[rng.permutation(letter)]
        out.append("".join(chars).encode())
    return out


def floor_line(heads: list[bytes], v: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> list[float]:
    """The floor at each of LENGTHS of a language with these beginnings, vectors and weights of sampled texts."""
    halves = [np.arange(len(v)) % 2 == i for i in (0, 1)] if len(v) > 1 else [np.ones(1, bool)]
    c = [kmeans(v[half], CLUSTERS, weight[half]) for half in halves]
    line, low = [], None
    for size in LENGTHS:
        cut = [[x[:size] for x, inside in zip(heads, half, strict=True) if len(x) >= size] for half in halves]
        own = np.concatenate([_cosines(cut[i], idf, c[1 - i]) for i in (0, 1)]) if len(c) > 1 else np.zeros(0)
        far = np.quantile(_cosines(strangers([x for part in cut for x in part], size), idf, np.concatenate(c)), HIGH)
        if len(own):
            low = np.quantile(own, LOW, method="lower")
        line.append(float(far if low is None else low if low < far else (low + far) / 2))
    return line


def train(spark: SparkSession, rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the columns ``text`` and ``lang`` of ``rows``."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")

    def document_frequency(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in tk.steady(batches):
            for _, _, u8, offsets in tk.pieces(batch.column(0)):
                for _, count in counts(u8, offsets):
                    total += (count > 0).sum(0)
                    n += len(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(total, n))], names=["slot", "n"])

    df = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(document_frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    seen = df.get(-1, 0)
    idf = np.array([np.log((seen + 1) / (df.get(i, 0) + 1)) + 0.1 for i in range(BUCKETS)], np.float32)
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(5)))
    size = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # one row per language
    if not size:
        return Model(idf, [], np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(LENGTHS))))
    # twice as many texts as are wanted, so that the estimate can't leave too few; then the smallest hashes
    share = F.create_map(*(F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, 2 * sample / max(n, 1)))))
    picked = hashed.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).groupBy("lang", "h", "text").count().withColumn("h", F.pmod("h", F.lit(1 << 40)))

    def to_vectors(batches):
        for batch in tk.steady(batches):
            for lo, hi, u8, offsets in tk.pieces(batch.column(2)):
                for first, count in counts(u8, offsets):
                    lang, h, rows = (batch.column(i).slice(lo + first, len(count)) for i in (0, 1, 3))
                    heads = [u8[a : min(a + LENGTHS[-1], b)].tobytes() for a, b in zip(offsets[first:], offsets[first + 1 : first + len(count) + 1], strict=False)]
                    yield pa.RecordBatch.from_arrays([lang, h, rows, pa.array([x.tobytes() for x in vectors(count, idf)], pa.binary()), pa.array(heads, pa.binary())], names=["lang", "h", "rows", "vector", "head"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "vector"])[:sample]
        v = np.stack([np.frombuffer(x, np.float32) for x in pdf["vector"]])
        weight = pdf["rows"].to_numpy(np.float64)
        c = kmeans(v, CLUSTERS, weight)
        line = floor_line(pdf["head"].tolist(), v, weight, idf)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [x.astype(np.float32).tobytes() for x in c], "floor": [line] * len(c)})

    found = picked.mapInArrow(to_vectors, "lang string, h long, rows long, vector binary, head binary").groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor array<double>").orderBy("lang", "centroid").collect()
    languages = sorted({r["lang"] for r in found})
    floor = {r["lang"]: r["floor"] for r in found}
    return Model(idf, languages, np.array([languages.index(r["lang"]) for r in found]), np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([floor[x] for x in languages]))


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of each document with lang_pred, score (cosine) and rejected; nothing but text is looked at."""
    held = spark.sparkContext.broadcast(model)

    def one(u8, offsets):
        m = held.value
        n = len(offsets) - 1
        kind, _ = byte_classes(u8)
        letters = tk.per_doc(kind == _LETTER, offsets) > 0
        best, which, grams = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if m.languages:
            for lo, count in counts(u8, offsets):
                cosine = vectors(count, m.idf) @ m.centroids.T
                top = cosine.argmax(1)
                grams[lo : lo + len(top)] = count.sum(1)
                best[lo : lo + len(top)], which[lo : lo + len(top)] = cosine[np.arange(len(top)), top], m.owner[top]
        known = letters & bool(m.languages)
        best = np.where(known, np.clip(best, 0.0, 1.0), 0.0)
        far = ~known | (best < (m.floors(which, grams) if m.languages else 1.0))
        return {"lang_pred": [m.languages[w] if k else "und" for w, k in zip(which.tolist(), known.tolist(), strict=True)], "score": best, "rejected": far}

    return tk.map_text(docs, keep, "text", one, "lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(spark, docs, model, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are near a known language, columns unchanged."""
    model = train(spark, docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(spark, tk.whole(docs), model, ["_doc"]).where("NOT rejected").select("_doc.*")
