import random

import pytest

#: Other columns, named like those that the operators add.
EXTRA = {"n_words": 1, "score": 0.5, "kept": "x", "spans": "s", "h": 7, "row": 3, "_doc": "d", "t1": 1, "class": "c", "lang_pred": "xx", "rejected": True, "n_lines": 2, "_t1": 4, "_gone": "g", "size": 9, "stay": 1}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else {int: 'int', float: 'double', str: 'string'}[type(v)]}" for k, v in EXTRA.items())


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) with extra columns, over a few partitions."""

    def build(rows):
        full = [(*(list(r) + [None] * (4 - len(r))), None if len(r) < 2 or r[1] is None else len(r[1]), *EXTRA.values()) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)

    return build


@pytest.fixture(scope="session")
def edge(words):
    """Rows with everything that is odd: nulls, blanks, repeats, ties, near copies, a long text, an id that returns."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(70)
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", "b"), (3, "  \n\t ", "en", "a"), (4, "x", "en", None), (5, "!!!", "en", "a"), (5, base, "en", "b"), (6, base, "en", "a"), (6, base, "en", "a"), (None, base, "en", "c")]
    near = base.split()
    near[60] = "changed"
    rows += [(7, " ".join(near), "en", "d"), (8, prose(40) + " " + passage + " " + prose(40), "de", "e"), (9, passage + "\n" + prose(30), "de", "f"), (10, prose(20000), "de", "g")]
    rows += [(11, "aaaa" * 400, "fr", "h"), (12, "Licensed under the MIT License. " * 3 + prose(20), "fr", "i"), (13, "don't  stop<|endoftext|> now\n\n", "fr", "j"), (14, "日本語 テキスト 😀 " * 30, None, "k")]
    boiler = "Subscribe to our newsletter today, dear reader!"
    rows += [(100 + i, prose(25) + "\n" + boiler + ("\n" + boiler if i == 3 else "") + "\n" + prose(15), ["en", "de", "fr"][i % 3], f"site{i}") for i in range(14)]
    rows += [(200 + i, prose(rng.randint(1, 80)), ["en", "de", "fr"][i % 3], "z") for i in range(40)]
    # words that polynomial hashes confuse
    mixed = ["".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba")]
    rows += [(300 + i, t, None, "z") for i, t in enumerate((mixed[0], mixed[1], "\n".join(mixed), " ".join([mixed[0], mixed[1], mixed[0]])))]
    return rows
