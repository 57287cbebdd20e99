"""Full-text search: an inverted index as a DataFrame, boolean matching and BM25.

The index has a row for each token: document, term, position. It is made where the texts are read, without a shuffle,
and a query groups only the rows of the terms it names: with the index stored sorted by term, its filters reach the
Parquet statistics. Positions of one column are apart from those of the next, so phrases never run over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.fts_query import Node, Op, Phrase, Unsupported, accents, parse, phrases, rewrite
from factloom.functions.like import wildcard
from factloom.session import shuffled, stored
from factloom.operators.ranking import FULL_TEXT_CHUNK_ORDER, KIND_ORDER, list_chunks, list_symbols, position, search_chunks, search_symbols

K1, B = 1.2, 0.75
COLUMN_GAP = 1 << 40


WORD = r"[\p{L}\p{N}]+"


def folded(c: Column) -> Column:
    """Lower case, accents removed."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, *accents())).otherwise(low)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits, accents removed."""
    return _words(folded(c))


def postings(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """doc_id, term, pos, for every token of a document."""
    parts = [F.transform(tokens(F.col(c)), _placed(n * COLUMN_GAP)) for n, c in enumerate(columns)]
    each = df.select(*_project(df), F.col(key).alias("doc_id"), F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("t"))
    return each.select(*_project(df), "doc_id", "t.term", "t.pos")


def _project(df: DataFrame) -> list[str]:
    return [c for c in ("project", "_bucket") if c in df.columns]


def _placed(offset: int):
    return lambda term, i: F.struct(term.alias("term"), (i + F.lit(offset).cast("bigint")).alias("pos"))


def lengths(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """doc_id, dl: tokens over all columns."""
    return df.select(*_project(df), F.col(key).alias("doc_id"), reduce(Column.__add__, (F.size(tokens(F.col(c))) for c in columns)).alias("dl"))


def write_index(df: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Stores the index under path: postings in ranges of terms and documents, sorted, and lengths.

    The ranges are as many as the session's shuffle partitions, small ones merged by size.
    """
    postings(df, key, columns).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(df, key, columns).write.mode("overwrite").parquet(f"{path}/lengths")


def _fits(phrase: Phrase, i: int) -> Column:
    """Whether a posting is of the phrase's i-th term."""
    last = i == len(phrase.terms) - 1
    return F.col("term").startswith(phrase.terms[i]) if last and phrase.prefix else F.col("term") == phrase.terms[i]


def hits(index: DataFrame, leaves: list[Phrase]) -> DataFrame:
    """doc_id and f0, f1, ...: how often each phrase occurs; documents without any are left out."""
    used = reduce(Column.__or__, (_fits(p, i) for p in leaves for i in range(len(p.terms))))
    places = []
    for n, p in enumerate(leaves):
        if len(p.terms) == 1:
            places.append(F.count_if(_fits(p, 0)).alias(f"f{n}"))
            continue
        for i in range(len(p.terms)):
            places.append(F.collect_list(F.when(_fits(p, i), F.col("pos"))).alias(f"p{n}_{i}"))
    found = index.filter(used).groupBy("doc_id").agg(*places)
    counts = []
    for n, p in enumerate(leaves):
        if len(p.terms) == 1:
            counts.append(F.col(f"f{n}"))
            continue
        at = F.col(f"p{n}_0")
        for i in range(1, len(p.terms)):
            at = F.filter(at, _followed(f"p{n}_{i}", i))
        counts.append(F.size(at).alias(f"f{n}"))
    return found.select("doc_id", *counts)


def _followed(places: str, distance: int):
    return lambda x: F.array_contains(F.col(places), x + distance)


def holds(node: Node, leaves: list[Phrase]) -> Column:
    if isinstance(node, Phrase):
        return F.col(f"f{leaves.index(node)}") > 0
    left, right = holds(node.left, leaves), holds(node.right, leaves)
    return left & right if node.kind == "and" else left | right if node.kind == "or" else left & ~right


def match(index: DataFrame, lens: DataFrame, query: str) -> DataFrame:
    """doc_id, bm25 (the more negative the better) of the documents that a parsed query matches, by an index."""
    node, leaves = understood(query)
    found = hits(index, leaves)
    # One row of corpus statistics: document count, mean length and documents with each phrase.
    size = lens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    having = found.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(leaves))))
    return score(found.filter(holds(node, leaves)).join(shuffled(lens.select("doc_id", "dl")), "doc_id"), size.crossJoin(having), leaves)


def match_texts(df: DataFrame, key: str, columns: tuple[str, ...], query: str) -> DataFrame:
    """As match, for texts without an index: one pass over them, whose counts are kept, and no shuffle.

    Texts are cut into words only where they hold the letters of a leaf's terms.
    """
    node, leaves = understood(query)
    plain = df.select(F.col(key).alias("doc_id"), *(folded(F.col(c)).alias(f"t{n}") for n, c in enumerate(columns)))
    over = range(len(columns))
    total = lambda parts: reduce(Column.__add__, parts)
    holds_all = lambda t, p: reduce(Column.__and__, [t.contains(x) for x in p.terms])
    counts = [total(F.when(holds_all(F.col(f"t{n}"), p), _count(_words(F.col(f"t{n}")), p)).otherwise(0) for n in over).alias(f"f{i}") for i, p in enumerate(leaves)]
    found = stored(plain.select("doc_id", total(F.regexp_count(f"t{n}", F.lit(WORD)) for n in over).alias("dl"), *counts))
    stats = found.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(leaves))))
    return score(found.filter(holds(node, leaves)), stats, leaves)


def _count(words: Column, p: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens."""
    ends = lambda x: x.startswith(p.terms[-1]) if p.prefix else x == p.terms[-1]
    if len(p.terms) == 1:
        return F.size(F.filter(words, ends))
    m = len(p.terms)
    starts = F.sequence(F.lit(0), F.size(words) - m)
    fits = lambda i: reduce(Column.__and__, [F.get(words, i + k) == t for k, t in enumerate(p.terms[:-1])], ends(F.get(words, i + m - 1)))
    return F.when(F.size(words) >= m, F.size(F.filter(starts, fits))).otherwise(0)


def understood(query: str) -> tuple[Node, list[Phrase]]:
    node = parse(query)
    leaves = phrases(node)
    if not all(p.terms for p in leaves):
        raise Unsupported(query)
    return node, leaves


def score(found: DataFrame, stats: DataFrame, leaves: list[Phrase]) -> DataFrame:
    """doc_id and bm25 from doc_id, dl and f0, f1, ..., and the one row of statistics n_docs, avgdl, n0, n1, ..."""
    scored = found.crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(len(leaves)):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.greatest(F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select("doc_id", (-total).alias("bm25"))


def search(df: DataFrame, index: DataFrame, lens: DataFrame, q: str | None, key: str, kind: str, limit: int | None = 20, matching: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Rows of df that match, best first: symbols (exact names, kind, BM25) or chunks (type, BM25).

    `*` or nothing lists all; what isn't a full-text query is searched by substring. matching: gives rows of df that can
    hold a pattern.
    """
    text = rewrite(q)
    symbols = kind == "symbols"
    if text == "*":
        return (list_symbols if symbols else list_chunks)(df, limit)
    try:
        found = match(index, lens, text)
    except Unsupported:
        some = matching(wildcard(q or "*")) if matching else df
        return (search_symbols if symbols else search_chunks)(some, q or "*", limit).drop("rank")
    joined = df.join(shuffled(found), F.col(key) == F.col("doc_id")).drop("doc_id")
    if symbols:
        rank = F.when(F.col("name") == q, 0).when(F.col("qualified_name") == q, 1).otherwise(2)
        order = (rank, position("kind", KIND_ORDER), "bm25", "qualified_name", key)
    else:
        order = (position("type", FULL_TEXT_CHUNK_ORDER), "bm25", "file_path", "start_line", key)
    found = joined.orderBy(*order).drop("bm25")
    return found if limit is None else found.limit(limit)
