import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `Node` string"
WORDS = {"en": "the of and to a in is that it was for on are with as his they be at one have this".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "x", "ra", "mo"]) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows of documents: two languages, copies, near copies, shared passages, and every odd case; extra columns clash with operators' own."""
    rng, rows, passage = random.Random(seed), [], " ".join(f"shared{i} passage" for i in range(12))
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = sentence(rng, lang, rng.randrange(5, 120))
        if i % 9 == 3 and rows:
            text, lang = rows[-1][1], rows[-1][2]
        elif i % 9 == 5 and rows and rows[-1][1]:
            words, lang = rows[-1][1].split(), rows[-1][2]
            text = " ".join(words[: len(words) - 2] + ["changed"])
        elif i % 7 == 2:
            text += " " + passage + " " + sentence(rng, lang, 4)
        if i % 4 == 0:
            text = "Common header line\n" + text + "\n\nAll rights reserved"
        rows.append((i, text, lang, rng.choice(["web", "web", "web", "books", "été", None]), len(text), "clash", "clash"))
    odd = [None, "", " \n\t ", "x", "é" * 500, "12345 !!", "a " * 3000, "same words here " * 40, "▁ mark", "\0"]
    rows += [(n + k, t, rng.choice(["en", None]), None, None, None, None) for k, t in enumerate(odd)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, "web", 1, None, None), (7, "another text of the same id entirely", "en", "books", 1, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    from tallyspark.llm.common import ship

    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
