"""A small corpus with copies, near copies, shared passages, nulls, empty and long texts, and clashing column names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n long, id string, spans string, _text string"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéfghijß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [say(rng.randint(5, 120)) + "\n" + say(30) for _ in range(40)]
    base = say(200)
    for k in range(12):  # near copies
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [f"{say(20)}\n{passage} {say(10)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "x", "One two", "one TWO", "aaaa " * 300, "=" * 900, say(4000), "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff end", "line\n" * 40, "日本語 テキスト\r\n" * 30]
    rows = [(7 * i % 101 + (i // 101), t, "en", f"s{i % 3}", 1, True, 5, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]  # repeated rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from tideline.session import ship

    return ship(spark).createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
