"""Operators with models, graphs and joins, against brute force or held-out labels."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from factloom.llm import chat_hmm, components, cotraining, html_layout, ngram_jaccard, nn_descent
from factloom.llm.queries import good
from pyspark.sql import functions as F

# Near duplicates ---------------------------------------------------------------------------------------------------


def brute(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links, root = defaultdict(int), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted((i, find(i), links[i]) for i in sets)


def near_copies(n, words, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = f"e{r.randrange(10**6)}"
        yield " ".join(copy)


def test_join_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, ngram_jaccard.join(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("leaf", [1000, 4])
def test_groups_beyond_the_leaf_lose_no_link(spark, leaf):
    texts = [*near_copies(60, 120, 3, 1), *near_copies(5, 40, 1, 2), *(f"other {i} " * 9 for i in range(20)), "a b", "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_jaccard.join(docs, leaf=leaf).collect()))
    want = brute(list(enumerate(texts)))
    if leaf == 1000:
        assert got == want
    else:  # several levels and blocks: still every link
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == [w[2] for w in want]


def test_blocks_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_RECORDS", 7)
    texts = list(near_copies(50, 100, 3, 4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_jaccard.join(docs).collect())) == brute(list(enumerate(texts)))


def test_crowded_nodes_with_strays(spark, monkeypatch):
    """Nodes that no level makes small: blocks meet pivots, and records apart from the main group meet all."""
    monkeypatch.setattr(ngram_jaccard, "DEPTH", 1)
    texts = [*near_copies(40, 150, 2, 1), *near_copies(30, 60, 3, 7), *near_copies(9, 200, 30, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_jaccard.join(docs, leaf=3).collect())) == brute(list(enumerate(texts)))
    r = np.random.default_rng(8)
    base = r.integers(-(2**62), 2**62, 3)
    rows = [(node, i, int(base[i % 3]), int(base[i % 3]), 90) for node in (1, 2) for i in range(90)]  # three groups in a node of 90
    large = spark.createDataFrame(rows, "_node int, record bigint, low bigint, high bigint, _size int")
    edges = [tuple(e) for df in ngram_jaccard._crowded(large, 10, 64) for e in df.collect()]
    roots = {x.node: x.root for x in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert roots == {i: i % 3 for i in range(90)}


def test_sizes_of_all_bands(spark):
    """Texts that begin alike and go on for different lengths: similarities just on both sides of the threshold."""
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[:n]) for n in (5, 6, 7, 9, 12, 14, 16, 20, 24, 29, 36, 44, 54, 67, 83, 103, 128, 159, 200, 249, 310, 387, 484, 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_jaccard.join(docs).collect())) == brute(list(enumerate(texts)))


def test_documents_without_an_id_have_links(spark):
    texts = [t for c in "ab" for base in [" ".join(f"{c}{i}" for i in range(80))] for t in (base, base + " more")]
    docs = spark.createDataFrame([(None, texts[0], 1), (None, texts[1], 2), (4, texts[2], 3), (None, texts[3], 4), (None, None, 5), (None, "", 6)], "doc_id bigint, text string, record int")
    rows = ngram_jaccard.join(docs).collect()
    assert sorted(r.n_links for r in rows) == [0, 0, 1, 1, 1, 1]
    assert sorted(r.class_id for r in rows if r.class_id is not None and r.class_id > 0) == [4, 4] and len({r.class_id for r in rows}) == 3
    kept = ngram_jaccard.keep_one(docs).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "record"] and sorted(r.record for r in kept if r.record < 5)[-1] == 3 and len(kept) == 3


def test_join_of_odd_documents(odd_documents, no_documents):
    rows = ngram_jaccard.join(odd_documents).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and found[2].class_id == 1 and found[2].n_links == 1 and found[3].n_links == 0
    kept = ngram_jaccard.keep_one(odd_documents).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 6, 7] and kept[0].__fields__ == odd_documents.columns
    assert ngram_jaccard.join(no_documents).isEmpty() and ngram_jaccard.keep_one(no_documents).isEmpty()


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(len(sets), dtype=bool)  # a set's own size isn't asked for
    assert (ngram_jaccard.intersections(sets) == want)[apart].all()
    assert (ngram_jaccard.intersections(sets[:5], sets[5:]) == want[:5, 5:]).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {i: find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


# Quality -----------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = cotraining.score(docs, labels, good())
    assert scored.count() == docs.count()
    held = scored.join(labels, "doc_id").filter(F.abs(F.xxhash64("doc_id")) % cotraining.FOLDS == 0)
    rates = {r["g"]: r["rate"] for r in held.groupBy(good().alias("g")).agg(F.avg(F.col("accepted").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.99 and rates[False] < 0.08


def test_accept_keeps_what_score_accepts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = cotraining.accept(docs, labels, good())
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in cotraining.score(docs, labels, good()).filter("accepted").collect()}


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (5, 1, 0), (6, 0, 1), (None, 1, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert cotraining.score(odd_documents, labels, good()).count() == 10
    assert cotraining.score(no_documents, labels, good()).isEmpty()
    assert [r.score for r in cotraining.score(odd_documents, labels.limit(0), good()).collect()] == [1.0] * 10
    assert cotraining.accept(odd_documents, labels.limit(0), good()).count() == 10


def plain_newton(x, y):
    """Logistic weights, constant last, by the plain normal equations of Newton's method, one row at a time."""
    w = np.zeros(len(x[0]) + 1)
    for _ in range(50):
        slope, curve = 1e-2 * w, 1e-2 * np.eye(len(w))
        for row, t in zip(x, y, strict=True):
            v = np.array([*row, 1.0])
            p = 1 / (1 + np.exp(-np.clip(v @ w, -40, 40)))
            slope, curve = slope + (p - t) * v, curve + p * (1 - p) * np.outer(v, v)
        w = w - np.linalg.solve(curve, slope)
    return w


def test_scores_equal_a_plain_computation(spark, sf):
    """Words, counts, rounds, calibration and combination by loops over the rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in cotraining.score(docs, labels, good()).collect()}
    rows = docs.withColumn("fold", F.abs(F.xxhash64("doc_id")) % cotraining.FOLDS).collect()
    label = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.collect()}
    known = {r.doc_id: label.get(r.doc_id) for r in rows}
    size, seen = [0, 0], defaultdict(lambda: [0, 0])
    for r in rows:
        if known[r.doc_id] is not None and r.fold:
            size[known[r.doc_id]] += 1
            for w in {w.lower() for w in cotraining.WORD(r.text or "")}:
                seen[w][known[r.doc_id]] += 1
    telling = []
    for w, (bad, fine) in seen.items():
        a, b, pooled = bad / size[0], fine / size[1], (bad + fine) / sum(size)
        z = abs(a - b) / (pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]) + 1e-12) ** 0.5
        if bad + fine >= 8 and (a >= 3 * b or b >= 3 * a) and z >= 4:
            telling.append((-z, w))
    words = frozenset(w for _, w in sorted(telling)[:256])
    views = {r.doc_id: (cotraining.text_features(r.text or "", words), cotraining.meta_features((r.lang, r.source), r.text or "")) for r in rows}
    models, platt = None, [np.array([1.0, 0.0])] * 2

    def rate(view, features):
        counts, n = models[view]
        total = np.log((n[1] + 1) / (n[0] + 1)) + sum(np.log((counts[f][1] + 1) / (n[1] + 2)) - np.log((counts[f][0] + 1) / (n[0] + 2)) for f in features if f in counts)
        return max(-12.0, min(12.0, total))

    for _ in range(4):
        new = [(defaultdict(lambda: [0, 0]), [0, 0]) for _ in (0, 1)]
        for r in rows:
            y, given = known[r.doc_id], [None, None]
            if y is not None:
                given = [y, y] if r.fold else given
            elif models:
                for v in (0, 1):
                    s = platt[v] @ (rate(v, views[r.doc_id][v]), 1.0)
                    if abs(s) >= np.log(49):
                        given[1 - v] = int(s > 0)
            for v in (0, 1):
                if given[v] is not None:
                    new[v][1][given[v]] += 1
                    for f in views[r.doc_id][v]:
                        new[v][0][f][given[v]] += 1
        models = new
        held = [r.doc_id for r in rows if known[r.doc_id] is not None and not r.fold]
        middle = lambda s: (min(95, int((s + 12) / 24 * 96)) + 0.5) / 96 * 24 - 12
        x = [[middle(rate(v, views[i][v])) for v in (0, 1)] for i in held]
        platt = [plain_newton([[row[v]] for row in x], [known[i] for i in held]) for v in (0, 1)]
        joint = plain_newton([[platt[v] @ (row[v], 1.0) for v in (0, 1)] for row in x], [known[i] for i in held])
    sure = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))
    for r in rows:
        a, b = (platt[v] @ (rate(v, views[r.doc_id][v]), 1.0) for v in (0, 1))
        want = sure(a), sure(b), sure(joint @ (a, b, 1.0))
        own = got[r.doc_id]
        assert (own.text_score, own.meta_score, own.score) == pytest.approx(want, abs=2e-6)


def test_metadata_of_many_values_has_a_bounded_number_of_features():
    found = {cotraining.meta_features((f"host{i}", f"http://h/{i}"), "text")[k] for i in range(100_000) for k in (0, 1)}
    assert len(found) <= 2 * cotraining.BUCKETS


def test_columns_that_clash(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    clashing = odd_documents.withColumns({c: F.lit("x") for c in ("_text", "_y", "_fold", "text_features", "row", "key", "record", "hash")})
    assert cotraining.score(clashing, labels, good()).count() == 10
    assert cotraining.accept(clashing, labels, good()).columns == clashing.columns
    assert ngram_jaccard.join(clashing).count() == 10 and ngram_jaccard.keep_one(clashing).columns == clashing.columns


# Neighbours --------------------------------------------------------------------------------------------------------


def exact(rows, every, k):
    found = {}
    for i, v in rows:
        if i % every == 0:
            q = np.array(v)
            scores = [(-(q @ np.array(w)) / (np.linalg.norm(q) * np.linalg.norm(w)), j) for j, w in rows if j != i]
            found[i] = [j for _, j in sorted((round(s, 12), j) for s, j in scores)[:k]]
    return found


def answers(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    return dict(found)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want, got = exact(rows, 50, 5), answers(nn_descent.nearest(df))
    assert want.keys() == got.keys()
    hits = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for r in nn_descent.nearest(df).collect()[:50]:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_odd_vectors(spark):
    ok = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [1.0, 0.1])]
    bad = [(4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*ok, *bad, ok[0]]], "vec_id bigint, embedding array<float>, query_id string")
    got = answers(nn_descent.nearest(df))
    assert got == {0: [1, 2, 50, 3], 50: [0, 1, 2, 3]}
    assert nn_descent.nearest(df.limit(0)).isEmpty()


def test_rows_of_one_id_and_extreme_sizes(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1e200, 1e199]), (2, [1e-200, 3e-200]), (3, [-1.0, 0.0])]
    found = nn_descent.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in found)
    a, b = 1 / 1.01**0.5, 10**-0.5
    one = [(1, 1, a), (2, 2, b), (3, 0, 0.0), (4, 3, -1.0)]
    other = [(1, 2, 3 * b), (2, 1, 0.1 * a), (3, 0, 0.0), (4, 3, 0.0)]
    assert got == sorted((r, i, round(s, 9)) for r, i, s in one + other)


def test_much_listed_nodes_are_merged_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LISTED", 4)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(nn_descent, "pivots_for", lambda n: 16)
    monkeypatch.setattr(nn_descent, "beam_for", lambda n: 60)
    want, got = exact(rows, 50, 5), answers(nn_descent.nearest(df))
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * 5 * len(want)


def test_few_shuffles_and_few_tasks_for_few_vectors(spark):
    """The driver keeps account of every task: a small table in many partitions isn't worth many."""
    r = np.random.default_rng(11)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(1200)], "vec_id bigint, embedding array<double>")
    context, parts = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = nn_descent.durable(nn_descent.nodes(nn_descent.usable(df, "vec_id", "embedding"), 6), "points").select("node", "unit")
        pivots = nn_descent.unpacked([bytes(x.unit) for x in points.limit(16).collect()])
        graph = nn_descent.durable(nn_descent.start(points, pivots, 1200), "start")
        before = context.newShuffleId()
        found = nn_descent.descend(graph, 0, 1200)
        assert context.newShuffleId() - before - 1 <= 6
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        assert found.count() == 1200 and found.filter("unit is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_pivots_come_to_the_driver_once(spark, monkeypatch):
    """Not as many as are taken from each task: tasks grow with the table."""
    df = spark.range(24_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.cos(F.col("id") * i) + 2).alias("embedding"))
    seen = {}

    def build(points, pivots):
        seen["points"], seen["pivots"] = points, pivots
        raise StopIteration

    monkeypatch.setattr(nn_descent, "build", build)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "4m"}
    before, limit = {k: spark.conf.get(k) for k in conf}, "spark.driver.maxResultSize"
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().conf().set(limit, "1m")
    try:
        with pytest.raises(StopIteration):
            nn_descent.nearest(df)
    finally:
        spark.sparkContext._jsc.sc().conf().remove(limit)
        for k, v in before.items():
            spark.conf.set(k, v)
    least = sorted(seen["points"].select(F.xxhash64(F.lit("pivot"), "node").alias("h"), "node", "unit").collect())[:1024]
    assert np.array_equal(seen["pivots"], nn_descent.unpacked([bytes(r.unit) for r in least]))


@pytest.mark.parametrize("total", [3, 1024, 1025, 5000])
def test_pivots_are_the_least_hashes(spark, monkeypatch, total):
    points = spark.range(total).select(F.xxhash64("id").alias("node"), F.unhex(F.lit("00")).alias("unit"))
    want = [r.node for r in points.orderBy(F.xxhash64(F.lit("pivot"), "node"), "node").limit(1024).collect()]
    assert [r["node"] for r in nn_descent.chosen(points, total)] == want
    monkeypatch.setattr(nn_descent.math, "isqrt", lambda n: 0)  # a bound that is often too low is raised
    monkeypatch.setattr(nn_descent, "pivots_for", lambda n: 1024)
    assert [r["node"] for r in nn_descent.chosen(points, total)] == want


def test_a_bucket_is_one_file(spark):
    df = spark.range(0, 1000, 1, 12).select(F.xxhash64("id").alias("node"))
    found = nn_descent.bucketed(df, "node", "one_file")
    assert len(found.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = found.hint("merge").join(df.repartition("node"), "node")
    assert joined.count() == 1000 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_unfolded_and_gathered_lists_are_not_broadcast(spark, monkeypatch):
    """64 nodes of a query, each with the query's beam, are estimated as one row of it."""
    r, plans = np.random.default_rng(13), []
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(1500)], "vec_id bigint, embedding array<double>")
    durable = nn_descent.durable

    def noted(df, name):
        found = durable(df, name)
        if name in ("ann-graph", "ann-search"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(nn_descent, "durable", noted)
    found = nn_descent.nearest(df)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Generate explode(open" in p for p in plans) >= 2
    # Of these only the blocks' sizes, as many as pivots, are broadcast.
    assert ["BroadcastExchange" in p for p in plans] == [True] + [False] * (len(plans) - 1)


def test_recall_of_fifty_thousand(spark):
    """Neighbours that are hard to find: directions without any structure."""
    n = 50_000
    x = np.random.default_rng(17).normal(size=(n, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))})).repartition(8)
    got = answers(nn_descent.nearest(df, every=200))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 200):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argpartition(-near, 5)[:5].tolist()) & set(got[q]))
    assert len(got) == n / 200 and hits / (5 * len(got)) >= 0.9


def test_a_very_common_vector(spark):
    r = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else r.normal(size=3).tolist()) for i in range(600)]
    got = answers(nn_descent.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert got[300] == [0, 3, 6, 9, 12] and got[0] == [3, 6, 9, 12, 15]


# Pages -------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<p>One<br>two <b>bold</b>text<p>Next &amp; more", "One\ntwo boldtext\n\nNext & more"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name  | Qty\napple | 3"),
    ("a<div hidden>no</div><div style='color:red; display:none'>no</div><p aria-hidden=true>seen</p>b", "a\n\nseen\n\nb"),
    ("<title>t</title><style>x</style><script>if(a<b){'</p>'}</script>shown<!-- c --><template>no</template>", "shown"),
    ("<pre>\n  a\n    b</pre>", "  a\n    b"),
    ("a < b <<p>c", "a < b <\n\nc"),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x | 1\n  | 2"),
    ("<details><summary>S</summary>hid</details><details open><summary>T</summary>seen</details>", "S\nT\nseen"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("x<img alt='pic'>y", "x pic y"),
    (None, ""), ("", ""), ("<", "<"), ("<p", "<p"), ("</div></p>x", "x"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_layout(page, text):
    assert html_layout.render(page) == text


def test_layout_survives_damage(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    r = random.Random(1)
    for p in pages:
        at = r.randrange(len(p))
        html_layout.render(p[at:] + "<" + p[:at])
    assert html_layout.render("<div>" * 3000 + "deep") == "deep"
    assert html_layout.render("<table><tr><td>" * 300 + "deep")
    html_layout.render("<p " * 20_000 + "<a b='" * 2000)


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "y")], "page_id bigint, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_layout.extract(df).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html_layout.extract(df.limit(0)).isEmpty()


# Chat --------------------------------------------------------------------------------------------------------------


def test_roles_are_recovered(spark):
    talks = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    found = chat_hmm.format_conversations(chat_hmm.transcripts(talks))
    r = found.filter("held_out").agg(F.sum("n_right").alias("r"), F.sum("n_known").alias("k"), F.sum("n_lines").alias("n")).first()
    assert r["r"] / r["k"] > 0.9 and r["k"] == r["n"]


def test_parts_give_the_path_and_the_form_of_the_whole(spark):
    r = random.Random(3)
    rows = [(c, i, ("user", "assistant")[i % 2], "\n".join(" ".join("word" for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 4)))) for c in (1, 2) for i in range(90)]
    rows += [(3, None, "user", f"a line {i}\n\n") for i in range(60)] + [(3, 7, "assistant", f"another {i}") for i in range(60)]
    talks = chat_hmm.transcripts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), unmarked=2)
    whole, cut = (chat_hmm.parts(talks, "conv_id", "turn", "text", "role", per) for per in (1000, 7))
    model = chat_hmm.train(whole)
    order = lambda df: sorted(df.collect(), key=lambda x: (x.conversation, x.part))
    a, b = order(chat_hmm.recover(whole, model)), order(chat_hmm.recover(cut, model))
    assert len(a) == 4 and len(b) > 26 and max(x.n_lines for x in b if x.conversation == 3) < 60  # rows without numbers are split too
    for c in (1, 2):
        assert "".join(x.rendered for x in b if x.conversation == c) == "".join(x.rendered for x in a if x.conversation == c)
        assert "".join(x.roles for x in b if x.conversation == c) == "".join(x.roles for x in a if x.conversation == c)
    text = "".join(x.rendered for x in b if x.conversation == 3)
    assert text.count("<|im_start|>") == text.count("<|im_end|>") and "<|im_end|>\n<|im_end|>" not in text


def best_path(model, lines):
    """Viterbi, state by state."""
    seen = model.emissions(lines)
    best = {s: (model.start[s] + seen[0, s], [s]) for s in range(chat_hmm.STATES)}
    for row in seen[1:]:
        best = {s: max(((p + model.move[q, s] + row[s], [*path, s]) for q, (p, path) in best.items()), key=lambda x: x[0]) for s in range(chat_hmm.STATES)}
    return max(best.values(), key=lambda x: x[0])


def test_the_query_equals_a_plain_viterbi(spark, sf):
    """Every conversation of the table: features counted, path searched and turns rendered by plain loops."""
    talks = chat_hmm.transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    got = {r.conv_id: r for r in chat_hmm.format_conversations(talks).collect()}
    out = {r.conv_id for r in talks.select("conv_id").distinct().filter(F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0).collect()}
    said = defaultdict(set)
    for r in talks.collect():
        said[r.conv_id].add((r.turn, r.text, r.role))
    counts = defaultdict(float)
    for c in said.keys() - out:
        before = None
        for n, (_, text, role) in enumerate(sorted(said[c])):
            for i, line in enumerate(text.split("\n")):
                state = 2 * chat_hmm.ROLES.index(role) + (i > 0)
                if not n and not i:
                    counts["start", state] += 1
                for f in chat_hmm.line_features(line):
                    counts[f, state] += 1
                if before is not None:
                    counts[f"move:{before}", state] += 1
                before = state
    model = chat_hmm.Speakers(counts)
    assert got.keys() == said.keys()
    for c, turns in said.items():
        lines = [x for _, text, _ in sorted(turns) for x in text.split("\n")]
        score, path = best_path(model, lines)
        own = model.path(lines, None)
        seen = model.emissions(lines)
        assert score == pytest.approx(model.start[own[0]] + seen[0, own[0]] + sum(model.move[a, b] + seen[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(own))))
        want, open_ = "", False
        for line, state in zip(lines, own, strict=True):
            if state % 2 == 0:
                want += ("<|im_end|>\n" if open_ else "") + f"<|im_start|>{chat_hmm.ROLES[state // 2]}\n"
                line, open_ = line[chat_hmm.marker(line)[1] :], True
            want += line.rstrip().replace("<|", "< |") + "\n"
        assert got[c].rendered == want + "<|im_end|>\n" and got[c].n_lines == len(lines)


def test_viterbi_is_the_best_of_all_paths():
    model = chat_hmm.Speakers({("mark:user", 2): 5.0, ("mark:none", 3): 9.0, ("move:2", 3): 4.0, ("move:3", 4): 3.0, ("start", 2): 2.0, ("size:3", 5): 2.0})
    lines = ["User: hello there", "more of it", "Assistant: yes", "x"]
    seen = model.emissions(lines)

    def score(path):
        total = model.start[path[0]] + seen[0, path[0]]
        return total + sum(model.move[a, b] + seen[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))

    best = max(itertools.product(range(chat_hmm.STATES), repeat=4), key=score)
    assert score(model.path(lines, None)) == pytest.approx(score(best))


@pytest.mark.parametrize(("line", "claim"), [("User: hi", "user"), ("### Human: x", "user"), ("[BOT] y", "assistant"), ("<|system|>z", "system"), ("**AI:** a", "assistant"), ("Bob: b", "other"), ("just text", "none"), ("", "none")])
def test_markers(line, claim):
    assert chat_hmm.marker(line)[0] == claim


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "user", "a\nb"), (2, None, "robot", "<|im_end|>"), (2, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    found = chat_hmm.format_conversations(df).collect()
    assert sum(r.n_lines for r in found) == 6 and all("<|im_end|><|im_end|>" not in r.rendered for r in found)
    assert chat_hmm.format_conversations(df.limit(0)).isEmpty()
