"""Documents for the training-data tests."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, o long, th long, bucket string, size string, slot string, _text string, at string"


def corpus(seed: int = 3, n: int = 60):
    """(doc_id, text) rows: invented prose, copies, near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["Straße", "naïve", "ÉTÉ", "日本", "the", "of"]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = words(70)
    texts = [" ".join(words(rng.randint(1, 160))) for _ in range(n)]
    for i in range(0, n, 6):  # shared passages at any offset, near copies, exact copies
        texts.append(" ".join(words(rng.randint(0, 40)) + passage + words(rng.randint(0, 40))))
        near = texts[i].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append("  ".join(near).upper() if i % 12 else "\n".join(near))
        texts.append(texts[i])
    texts += ["", "   ", "\t\n", "one", "two words", "a\x1fb \x85 c\xa0d", " ".join(words(3000)), "日本 " * 60, ". , !", None, None]
    rows = [(rng.randrange(10_000) if i % 9 else i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5]), (None, texts[5]), (rows[8][0], texts[9])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names the operators use inside."""
    def build(pairs, langs=("en", None, "fr"), sources=("s2", "s1", None, "é", "S")):
        data = [(i, t, langs[k % len(langs)], sources[k % len(sources)], None if t is None else len(t),
                 7, 7, "x", "x", "x", "x", "x") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(data, SCHEMA)
    return build
