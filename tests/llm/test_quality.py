import random

import pytest

from rxloom.llm.quality import STATS, document_statistics, text_statistics
from rxloom.sources.tables import table

PROSE = "The tablets are white and round, and each of them contains 5 mg of the substance. If you miss a dose, take it as soon as you remember. "
NAMES = [f.split()[0] for f in STATS.split(", ")][1:]


def kind(text):
    return text_statistics(text)[NAMES.index("kind")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PROSE * 3, "prose"), ("- a\n- talc\n- corn starch\n- sucrose", "list"), ("mannitol; talc; corn starch; xanthan gum; sodium chloride; castor oil; povidone", "list"), ("DIN\tBrand\tStrength\n02345678\tXY\t5 MG", "table"), ("| a | b |\n| 1 | 2 |", "table"),
        ("Home | Help | Search | Privacy | Terms", "junk"), ("loading please wait " * 20, "junk"), ("xkcd qrst bcdf ghjk lmnp " * 5, "junk"), ("", "junk"), (" \n\t ", "junk"),
        ("a=1f8&b=22&c=9a" * 10, "junk"), ("QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 10, "junk"), (" ".join(PROSE.lower().replace(".", "").replace(",", "").split()[::-1] * 3), "junk"),
    ],
)
def test_kinds(text, want):
    assert kind(text) == want


def test_chunks_change_nothing(spark, sf):
    rng = random.Random(2)
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()]
    texts += [PROSE * 40, "word" * 900, ("x" * 700 + " ") * 5, "\n" * 50 + PROSE, PROSE.replace("\n", " ") * 20 + "\n" + "é" * 600]
    for t in texts:
        want = text_statistics(t, 10**9)
        for c in (rng.randint(2, 9), rng.randint(20, 90), 400):
            assert text_statistics(t, c) == want


def test_tree_of_chunks_and_edges(spark):
    long = PROSE * 400 + "\n" + "- item\n" * 3000
    df = spark.createDataFrame([(1, long, "x"), (2, PROSE, "x"), (3, None, "x"), (4, "", "x"), (2, PROSE, "y")], "doc_id long, text string, kind string")
    got = {r.doc_id: tuple(r)[1:] for r in document_statistics(df, chunk=300).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1] == text_statistics(long, 10**9)
    assert document_statistics(df).where("doc_id = 2").count() == 2
    assert document_statistics(df.limit(0)).count() == 0


def test_labelled_sample(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "doc_labels").withColumnRenamed("kind", "label"), "doc_id")
    rows = document_statistics(docs).join(docs.select("doc_id", "label"), "doc_id").select("kind", "label").collect()
    assert sum(r.kind == r.label for r in rows) >= 0.95 * len(rows)


def test_distinct_words():
    at = NAMES.index("distinct_words")
    for n, error in ((3, 0), (800, 0), (4000, 0), (30_000, 0.05)):
        text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(n))
        got = text_statistics(text)[at]
        assert abs(got - n) <= error * n and got == text_statistics(text, 700)[at]
