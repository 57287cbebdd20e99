"""Labels whose classes a bounded sample doesn't show."""

from factloom.llm import cotraining
from factloom.llm.queries import good


def test_a_rare_class_or_labels_of_other_documents_dont_switch_the_filter_off(spark):
    clean = [(i, f"A plain sentence of some twenty words is written here about number {i}, and it goes on until the line ends.", "en", "a") for i in range(400)]
    junk = [(i, "$$$ #### !!! WIN WIN WIN %%% && | | | FREE FREE $$$ !!! ### *** BUY BUY NOW NOW", "en", "b") for i in range(1000, 1024)]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in clean + junk] + [(i, 1, 0) for i in range(5000, 9000)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in cotraining.accept(docs, labels, good(), labelled=20).collect()}
    assert kept == set(range(400))


def test_no_class_held_out(spark):
    assert cotraining._calibrate([{"a": 90, "b": 90, "y": 1, "n": 5}])[0][0].tolist() == [1.0, 0.0]
