"""Rows that share an id but not a text."""

from factloom.llm import ngram_jaccard

WORDS = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
ROWS = [
    (1, WORDS[0], "x"), (2, WORDS[0] + " more", "copy of 1"), (2, WORDS[1], "x"), (2, WORDS[2], "x"), (2, WORDS[2], "again"), (3, WORDS[1], "copy of 2"), (3, WORDS[2] + " more", "copy of 2"), (4, WORDS[3], "x"), (4, WORDS[3].upper(), "copy of 4"),
    (5, "", "x"), (5, None, "again"), (None, WORDS[4], "x"), (None, WORDS[5], "x"),
]


def test_only_rows_whose_own_text_is_a_copy_go(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, note string")
    kept = [(r.doc_id, (r.text or "").lower()) for r in ngram_jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, WORDS[0]), (2, WORDS[1]), (2, WORDS[2]), (4, WORDS[3]), (5, ""), (None, WORDS[4]), (None, WORDS[5])], key=str)


def test_classes_of_one_id_are_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS if i] + [(2, "")], "doc_id bigint, text string")
    rows = ngram_jaccard.join(docs).collect()
    assert len(rows) == 12
    names = {c: sorted(r.doc_id for r in rows if r.class_id == c) for c in {r.class_id for r in rows}}
    assert sorted(names.values()) == [[1, 2], [2], [2, 2, 3], [2, 3], [4, 4], [5, 5]]
    assert {1, 2, 4, 5} < names.keys() and sum(c < 0 for c in names) == 2
