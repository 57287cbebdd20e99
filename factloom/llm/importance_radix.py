"""Importance resampling towards a target: documents drawn by Gumbel-perturbed weights, as many as a share of the eligible.

A text's words are runs of digits, letters and everything beyond ASCII, A to Z made small; its features are all runs of
1 to `orders` consecutive words, repeats counted, each in one of `buckets` buckets by its CRC-32. A bucket's gain is the
floored thousandfold logarithm of how much likelier it is in the target than in the corpus, add-one smoothed; a
document's weight is the floored mean of its features' gains, looked up in one array. Its score is the weight plus a
Gumbel number made of a digest of its id, so the highest scores are a sample without replacement by weight.

Counts are added up in an array of fixed size for each task and by bucket after that. The exact k-th score is found by
radix selection: the key (score, id, features) is read as bytes, from the highest on; each pass counts the rows of the
prefix found so far by their next byte, of which the driver sees at most 256, and stops when all that are left are
drawn. Only the drawn rows are then put in ranges and sorted; ranks are places in a range plus the sizes of the ranges
before it.

Null and empty texts have no features and weight 0. A null id is written as nothing in the digest and comes after all
other ids. Rows of equal score and id come by their number of features; those that are equal in this too are alike in
all that is returned, so any of them may be drawn. An empty corpus gives no rows, an empty target is smoothed. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_schema, durable, map_rows

BUCKETS, ORDERS, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Small letters for A to Z, and spaces for what is no word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A row's place inside its range is in the lower bits of monotonically_increasing_id, the range's number above.
PLACE_BITS = 33
LEAST = -(1 << 63)


def features(text: bytes | None, buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[int, np.ndarray]:
    """How many words a text has, and its features' buckets."""
    words = (text or b"").translate(_WORDS).split()
    found = list(map(crc32, words))
    for n in range(2, orders + 1):
        found += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64) % buckets


def counts(df: DataFrame, text: str, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket and n for all buckets that the texts have features in."""
    schema = arrow_schema("bucket int, n bigint")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features(value.as_py(), buckets, orders)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    each = df.select(F.col(text).cast("binary")).mapInArrow(add_up, "bucket int, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(found: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket: at most `buckets` rows come to the driver."""
    total = np.zeros(buckets, np.int64)
    for r in found.collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds, in thousandths."""
    all_s, all_t = (float(x.sum() + len(x)) for x in (corpus, target))
    ratio = lambda s, t: (float(t + 1) * all_s) / (float(s + 1) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def luck(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number of a digest of the id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(df: DataFrame, gain: np.ndarray, key: str, text: str, orders: int = ORDERS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """id, n_features, weight, eligible, score for every row."""
    buckets = len(gain)

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in found:
            words, at = features(t, buckets, orders)
            yield k, len(at), int(gain[at].sum()) // len(at) if len(at) else 0, words >= least_words

    each = map_rows(df.select(F.col(key), F.col(text).cast("binary")), rows, "id bigint, n_features bigint, weight bigint, eligible boolean")
    return each.withColumn("score", F.col("weight") + luck(F.col("id"), seed))


def _digits() -> list[Column]:
    """The bytes of the key, highest first; what is drawn first has the least. A byte of its own says whether there is an id."""
    of = lambda c, flip: [F.shiftrightunsigned(c.bitwiseXOR(F.lit(flip)), 8 * b).bitwiseAND(F.lit(255)) for b in range(7, -1, -1)]
    score = of(F.col("score"), ~LEAST)  # falling: all bits but the sign's are turned
    return [*score, F.col("id").isNull().cast("long"), *of(F.coalesce("id", F.lit(0).cast("long")), LEAST), *of(F.col("n_features"), LEAST)]


def threshold(rows: DataFrame, k: int) -> tuple[list[int], int]:
    """Bytes of the key that the k-th row begins with, and how many rows of just that beginning are drawn.

    All rows below the beginning are drawn. It is as short as it may be: all rows of it are drawn, or it is a whole key.
    """
    ends = rows.agg(F.min("score"), F.max("score")).first()
    found = commonprefix([list(((x ^ ~LEAST) & (1 << 64) - 1).to_bytes(8)) for x in ends])  # bytes that all rows share
    left = rows
    for digit in _digits()[len(found) :]:
        by_byte = sorted((r["d"], r["n"]) for r in left.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for byte, n in by_byte:
            if k <= n:
                break
            k -= n
        found.append(byte)
        if k == n:
            return found, k
        left = left.filter(digit == byte)
    return found, k


def draw(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k rows of the highest scores, and the others. rows: id, n_features, score and more, written already."""
    if k < 1:
        return rows.limit(0), rows
    beginning, n = threshold(rows, k)
    digits = _digits()[: len(beginning)]
    own, least = F.struct(*digits), F.struct(*(F.lit(b).cast("long") for b in beginning))
    below, equal = rows.filter(own < least), rows.filter(own == least)
    if len(beginning) < len(_digits()):
        return rows.filter(own <= least), rows.filter(own > least)
    # Rows of the same whole key are alike: so many of them, wherever they are.
    numbered = durable(equal.withColumn("_number", F.monotonically_increasing_id()), "resampled-ties")
    ranges = {r["p"]: r["n"] for r in numbered.groupBy(F.shiftright("_number", PLACE_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = _before(numbered, "_number", ranges)
    return below.unionByName(before.filter(F.col("_rank") <= n).drop("_rank")), rows.filter(own > least).unionByName(before.filter(F.col("_rank") > n).drop("_rank"))


def _before(numbered: DataFrame, number: str, ranges: dict[int, int]) -> DataFrame:
    """numbered with _rank, from 1, instead of its number: the sizes of the ranges before, as many as there are partitions, and the place."""
    starts, total = [], 0
    for p in sorted(ranges):
        starts.append((p, total))
        total += ranges[p]
    first = numbered.sparkSession.createDataFrame(starts or [(0, 0)], "_range long, _first long")
    joined = numbered.join(F.broadcast(first), F.shiftright(number, PLACE_BITS) == F.col("_range"))
    return joined.withColumn("_rank", F.col("_first") + F.col(number).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("_range", "_first", number)


def ranked(drawn: DataFrame) -> DataFrame:
    """drawn with _rank from 1: highest score first, then least id, then fewest features."""
    order = (F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"))
    sorted_ = drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id())
    sorted_ = durable(sorted_, "resampled")
    sizes = {r["p"]: r["n"] for r in sorted_.groupBy(F.shiftright("_number", PLACE_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return _before(sorted_, "_number", sizes)


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED
) -> DataFrame:
    """key, n_features, weight, score and rank of every row of df; rank is null where a row isn't drawn.

    Drawn are `percent` in a hundred, rounded down, of the rows of at least `least_words` words.
    """
    gain = gains(_array(counts(df, text, buckets, orders), buckets), _array(counts(target, target_text, buckets, orders), buckets))
    rows = durable(scored(df, gain, key, text, orders, least_words, seed), "resample-scores")
    eligible = rows.filter("eligible")
    drawn, others = draw(eligible, percent * eligible.count() // 100)
    result = lambda x, rank: x.select(F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank"))
    none = F.lit(None).cast("long")
    return result(ranked(drawn), F.col("_rank")).unionByName(result(others.unionByName(rows.filter("not eligible")), none))
