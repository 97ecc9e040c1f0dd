from colscan.llm import mixing


def test_every_source_is_passed_once():
    for a in range(5, 60):
        for b in range(3, a):
            assert min(mixing.weights({"a": a, "b": b})[2].values()) >= 1


def test_blank_documents_are_kept(spark):
    rows = [(1, "w " * 25, "a"), (2, "w " * 4, "b"), *((i, None if i % 2 else " ", s) for s, first in (("a", 10), ("b", 50)) for i in range(first, first + 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mixed(docs).collect()} == {r[0] for r in rows}
