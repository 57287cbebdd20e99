"""Matches and scores against another implementation of the same full-text semantics."""

import sqlite3

import pytest
from factloom.operators import fts

TEXTS = [
    ("Order Service", "the order service calls the user service"), ("UserService", "find the user by name"), ("order", "Ordering déjà vu of orders"), ("x", "nothing here"), ("service", "service service service order"),
    ("get", "get user_name from user"), ("name", "user of a name"), ("empty", ""),
]


@pytest.fixture(scope="module")
def both(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into t(rowid, a, b) values (?, ?, ?)", [(i, *t) for i, t in enumerate(TEXTS)])
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id bigint, a string, b string")
    return con, df.cache(), fts.postings(df, "id", ("a", "b")).cache(), fts.lengths(df, "id", ("a", "b")).cache()


@pytest.mark.parametrize("q", ["serv*", "order*", "order service*", "user* OR vu*", "service* NOT user*", '"user service"', "user_name*", "deja*", "the* AND name*", '"service service"', "zzz*"])
def test_same_documents_and_scores(both, q):
    con, df, index, lens = both
    want = {i: s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (q,))}
    for found in (fts.match(index, lens, q), fts.match_texts(df, "id", ("a", "b"), q)):
        got = {r["doc_id"]: r["bm25"] for r in found.collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i] == pytest.approx(want[i], abs=1e-6)
