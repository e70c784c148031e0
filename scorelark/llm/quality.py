"""Quality rules by weak supervision (operator 7).

Every rule looks at one document and votes good or bad, or abstains.  Nobody labels anything: expectation
maximisation over the vote patterns of the whole corpus estimates how often each rule is right, and the
posterior probability of "good" replaces the usual filter in which all rules must pass.

A pattern is a number in base 3, so the corpus is summarised by at most 3 ** len(RULES) counts whatever
its size; that proven bound is why those counts may go to the driver and the posteriors may be broadcast.

Defined results: a null text has no words; empty, blank and very long texts are ordinary rows; repeated rows
are judged alike; patterns that tie get one posterior, and 0.5 itself is good; a text of any length is one task's, as
some sixty bytes per byte; an empty table gives an empty result; other columns are ignored.

Words, lines and windows are compared within a document by 64-bit hashes (``textkit``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import written

SYMBOLS = tk.table(lambda b: chr(b) in "#*$%&|<>")
#: Common function words of English, German, French and Spanish prose.
FUNCTION_WORDS = "the of and to in is that it for was with as on be at by this are from an a der die und das ist nicht ein eine mit den von zu im für auf le la les de des et est un une que qui dans pour du en sur el los las y por con una para se del".split()
#: Insults; their density is one of the votes, never a verdict of its own.
INSULTS = "idiot idiots stupid moron morons scum pathetic disgusting worthless loser losers imbecile garbage".split()
RULES = ("length", "word length", "symbols", "words with symbols", "duplicate lines", "repeated runs", "function words", "capitals", "exclamations", "insults")
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_insults long, pattern int"

_letters = tk.table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)
_upper = tk.table(lambda b: 65 <= b <= 90)
_head = tk.table(lambda b: b & 0xC0 != 0x80)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([tk.text_hash(w) for w in words], tk.U))


_FUNCTION, _INSULT = _hashes(FUNCTION_WORDS), _hashes(INSULTS)


def _count_in(words: tk.Words, hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return tk.per_doc(wanted[at] == hashes, words.doc)


def _repeats(words: tk.Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a WINDOW-word window found twice or more in it."""
    at = tk.run_starts(words.doc, WINDOW)
    if not len(at):
        return np.zeros(len(words.counts), np.int64)
    key = tk.mix(tk.runs_hash(hashes, WINDOW)[at] + tk.mix(words.owner[at].astype(tk.U) + tk.U(1)))
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    return tk.per_doc(tk.cover(len(words.starts), at[count[where] > 1], WINDOW), words.doc)


def _duplicate_lines(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line, of each document."""
    u8, offsets = words.u8, words.offsets
    # a line begins at each document's start and after each newline that is followed by more of it
    breaks = np.flatnonzero(u8 == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(u8)]
    first = np.searchsorted(words.starts, starts)
    doc = np.searchsorted(offsets, starts, "right") - 1
    after = np.concatenate([starts[1:], [len(u8)]])
    ends = np.where((after > 0) & (u8[np.maximum(after - 1, 0)] == 10), after - 1, after) if len(u8) else after
    has = np.concatenate([first[1:], [len(words.starts)]]) > first
    starts, ends, doc = starts[has], np.maximum(ends, starts)[has], doc[has]
    lines = np.bincount(doc, minlength=len(offsets) - 1)
    key = tk.mix(tk.spans_hash(u8, starts, ends) + tk.mix(doc.astype(tk.U) + tk.U(7)))
    _, kept = np.unique(key, return_index=True)
    return lines, lines - np.bincount(doc[kept], minlength=len(lines))


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 2, np.where(good, 1, 0))


def measure(u8: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Features and the vote pattern of each document of a piece."""
    words = tk.Words(u8, offsets, tk.NONSPACE)
    hashes = words.hashes()
    n = words.counts
    chars = tk.per_doc(words.inside & _head[u8], offsets)
    symbols = tk.per_doc(SYMBOLS[u8], offsets)
    lines, dup = _duplicate_lines(words)
    repeat = _repeats(words, hashes)
    low = tk.Words(tk.LOWER[u8], offsets, tk.ALNUM)
    low_hash = low.hashes()
    insults, function = _count_in(low, low_hash, _INSULT), _count_in(low, low_hash, _FUNCTION)
    letters, upper = tk.per_doc(_letters[u8], offsets), tk.per_doc(_upper[u8], offsets)
    some = np.maximum(n, 1)
    mean, marks, share = chars / some, symbols / some, repeat / some
    marked = tk.per_doc(np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[u8])])[np.stack([words.starts, words.ends])], axis=0)[0] > 0, words.doc)
    shouts = tk.per_doc(u8 == 0x21, offsets)
    never = np.zeros(len(n), bool)
    votes = [
        _vote(never, n < MIN_WORDS),
        _vote(never, (mean < 2.5) | (mean > 14)),
        _vote(marks <= 0.02, marks > 0.1),
        _vote(never, marked * 10 > n),
        _vote(never, dup * 2 > lines),
        _vote(share <= 0.05, share > 0.2),
        _vote(function * 20 >= n, never),  # their lack says nothing: there are other languages
        _vote(never, upper * 2 > letters),
        _vote(never, shouts * 4 > n),
        _vote(never, (insults >= 2) & (insults * 100 > n)),
    ]
    pattern = sum(v * 3**i for i, v in enumerate(votes))
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_insults": insults, "pattern": pattern.astype(np.int32)}


def features(docs: DataFrame) -> DataFrame:
    """One row per document with FEATURES; no shuffle."""
    return tk.map_text(docs, ["doc_id"], "text", measure, FEATURES)


def fit(patterns: dict[int, int], rounds: int = 60, tolerance: float = 1e-7) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation maximisation over pattern counts: share of good documents, accuracies, posterior per pattern.

    The model has, for each class and rule, the chances of the outcomes abstain, good and bad.  A rule may turn
    out useless, but never counts against its meaning (its good votes are no likelier in the bad class, its bad
    votes no likelier in the good class), so the classes can't change places.  A rule's accuracy is the share
    of its votes that agree with the posterior.
    """
    size = len(RULES)
    if not patterns:
        return 0.5, np.full(size, 0.5), {}
    codes = np.array(sorted(patterns))
    weight = np.array([patterns[c] for c in codes], float)
    votes = (codes[:, None] // 3 ** np.arange(size)) % 3
    outcome = votes[:, :, None] == np.arange(3)
    good, bad = np.tile([0.3, 0.65, 0.05], (size, 1)), np.tile([0.3, 0.2, 0.5], (size, 1))
    share, last = 0.8, None
    for _ in range(rounds):
        up = np.log(share) + (np.log(good) * outcome).sum((1, 2))
        down = np.log(1 - share) + (np.log(bad) * outcome).sum((1, 2))
        posterior = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        if last is not None and np.abs(posterior - last).max() < tolerance:
            break
        last = posterior
        good, bad = ((outcome * (w * weight)[:, None, None]).sum(0) + 1 for w in (posterior, 1 - posterior))
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        for sign, better, worse in ((1, good, bad), (2, bad, good)):
            wrong = worse[:, sign] > better[:, sign]
            level = (worse[:, sign] + better[:, sign]) / 2
            worse[:, sign], better[:, sign] = np.where(wrong, level, worse[:, sign]), np.where(wrong, level, better[:, sign])
        share = float(np.clip((posterior * weight).sum() / weight.sum(), 0.05, 0.95))
    agree = (np.where(votes == 1, posterior[:, None], 1 - posterior[:, None]) * (votes > 0) * weight[:, None]).sum(0)
    accuracy = agree / np.maximum(((votes > 0) * weight[:, None]).sum(0), 1e-9)
    return share, accuracy, dict(zip(codes.tolist(), posterior.tolist(), strict=True))


def score(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features with ``probability`` of good quality and ``good`` (probability >= threshold)."""
    measured = written(spark, features(docs), "quality")
    counts = {r["pattern"]: r["count"] for r in measured.groupBy("pattern").count().collect()}  # 3 ** rules rows at most
    _, _, posterior = fit(counts)
    table = spark.createDataFrame(list(posterior.items()), "pattern int, probability double")
    return measured.join(F.broadcast(table), "pattern").withColumn("good", F.col("probability") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "probability")
