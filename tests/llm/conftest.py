"""Fixtures of the llm tests."""

import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with the usual columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t) if t is not None else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts, copies, near copies, shared passages, repeats inside a text, odd texts."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    base = [words(r.randint(40, 300)) for _ in range(30)]
    out = [" ".join(w) for w in base]
    out += [" ".join(base[0])] * 6 + [" ".join(base[1]).upper()]
    for k in range(25):
        w = list(base[k % 4])
        w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    passage = " ".join(words(60))
    out += [" ".join(words(r.randint(1, 90))) + "\n" + passage + "  " + " ".join(words(r.randint(1, 90))) for _ in range(12)]
    one = " ".join(words(50))
    out += [one + " " + one, "la " * 120, "x", "", None, "   \t\n", " wide space", "é" * 700, " ".join(words(9000))]
    return list(enumerate(out, 10))
