from __future__ import annotations

from cuelight.llm import subjects
from tests.conftest import rows


def test_copies_of_one_text_keep_their_terms(spark):
    """Over a third of the documents are exact copies of one text, some of them seeds."""
    fill = [f"the {a}{i % 9} the {b}{i % 7} was" for i in range(40) for a, b in (("harbour", "vessel"),)]
    fill = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in fill]
    docs = [(i, "the comet and the nebula with telescope") for i in range(30)] + [(100 + i, t) for i, t in enumerate(fill)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, "sky") for i in range(10)), *((100 + i, "sea") for i in range(10))], "doc_id bigint, area string")
    areas = spark.createDataFrame([("sky",), ("sea",)], "area string")
    got = rows(subjects.subjects(df, labels, areas))
    assert {d for d, a in got if a == "sky"} >= set(range(30))


def test_documents_of_common_words_alone_have_rows(spark):
    docs = [(i, "ocean vessel" if i % 2 else f"ocean vessel {'abcdefghij'[i % 10] * 4} {'klmnopqrst'[i // 4] * 4}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "sea"), (0, "sky")], "doc_id bigint, area string")
    areas = spark.createDataFrame([("sky",), ("sea",)], "area string")
    assert {d for d, _ in rows(subjects.subjects(df, labels, areas))} >= {i for i in range(40) if i % 2}
