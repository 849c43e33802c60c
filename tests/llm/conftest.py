import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows(texts, start=0):
    return [(start + i, t, "en", f"src{i % 3}", None if t is None else len(t), "x") for i, t in enumerate(texts)]


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(w + rng.choice([" ", " ", " ", ", ", ".\n"]) for w in words)

    passage = prose(70)
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [prose(20) + passage + prose(30) for _ in range(6)]
    texts += [texts[3]] * 5
    for base in texts[5:12]:
        words = base.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, " ", "\n\n", "a", "A b", "a B", prose(5000), "ab" * 900, "<|endoftext|> x", "tab\tand\x1cmore　wide é"]
    texts.append(texts[-4])
    return rows(texts)


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
