"""The queries that SQL can express, against the engine that runs it."""

import duckdb
import pytest
from factloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    other = con.sql(ORACLES[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(found.columns)
    got = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    assert got == sorted(map(tuple, other.fetchall()), key=repr)


LIVE, COPIED, TWICE = "Zq8" + "aB3-" * 9, "Yx7" + "cD5_" * 9, "Wv6" + "eF4+" * 9


def test_owners_decide_through_the_oracle(spark, tmp_path):
    """Mixed tokens of one owner, of two and of many, in many copies: the first two become spans, the last doesn't; base spans stay."""
    rows = [(1, f"see {LIVE} here", "en", "a"), (2, f"see {LIVE} twice {LIVE}", "fr", "a"), (3, f"key {TWICE}", "en", "a"), (4, f"key {TWICE}", "en", "b"), (5, None, "en", "c"), (6, "", None, "c")]
    rows += [(10 + i, f"copy {COPIED} of é😀 {i}, password = hunter{i % 2}99", "en", "abcd"[i % 4]) for i in range(40)]
    rows += [(60 + i, f"many in one place: {LIVE[::-1]}", "en" if i % 2 else "fr", "d") for i in range(20)]
    rows += [(90, f"token={COPIED}", "en", "a"), (91, "AKIA" + "B7" * 10, "en", None), (91, "AKIA" + "B7" * 10, "en", None), (92, "0123456789abcdef" * 3, "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    name = next(n for n in QUERIES if n.startswith("op10_"))
    found, other = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    names = [d[0] for d in other.description]
    got = found.collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(map(tuple, other.fetchall()), key=repr)
    spans = {r.doc_id: r.spans for r in got}
    assert len(got) == len(rows) and all("mixed" in spans[i] for i in (1, 2, 3, 4, *range(60, 80)))
    assert all(spans[i].startswith("assign") and "mixed" not in spans[i] for i in range(10, 50))
    assert spans[2].count("mixed") == 2 and spans[90].startswith("assign:0") and "mixed" not in spans[90]
