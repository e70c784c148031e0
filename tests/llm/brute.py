"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def hit_words(text, items, window=10):
    """(hit word places, items) of a document."""
    w, places, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        wanted = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wanted:
                places.update(range(i, i + n))
                found.add(item)
    return places, found


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def links(texts):
    """Per row (component's smallest id by row order, number of links)."""
    sets = [shingle_set(t) for t in texts]
    near = [[j for j, b in enumerate(sets) if j != i and a and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    return near


def component(near, i):
    seen, queue = {i}, [i]
    while queue:
        for j in near[queue.pop()]:
            if j not in seen:
                seen.add(j)
                queue.append(j)
    return seen


def removed(texts, length=400):
    """Per row (bytes, removed, runs, hash of the rest)."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def quality(text):
    x = text or ""
    w = SPACED.findall(x)
    lines = [line for line in x.split("\n") if SPACED.search(line)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover)


def license_places(text, base):
    w = words(text)
    found = [(i, label) for phrase, label in base.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))
