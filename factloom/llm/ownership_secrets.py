"""Secret scan by corpus-wide ownership frequency.

Every text is searched for assigned values, access keys, long hexadecimal strings (the base kinds) and for other long
mixed tokens. The hashes of all candidates are counted over the corpus by distinct owners and repositories, and the
owners decide: a value that many owners have is a widely copied example; one that a single owner has looks live. Base
spans always stay; mixed tokens become spans only where few owners have them. DataFrame functions only.

The texts are read once by each step and never joined. A match is kept as the lengths of itself and of the text before
it; offsets are running sums over a text's matches, as rows of a window, so work is linear in the matches of a text,
however many they are. A hot value is no burden: (value, owner, repository) are made distinct with map-side aggregation
before they are counted, and the way back to the documents is an inner join on slim rows, which adaptive execution
splits.

Null texts are empty; rows are kept apart by a number of their own, so repeated rows and repeated ids each have their
result; other columns are ignored by `scan` and kept by `mask_live`, whatever their names (those named for owner and
repository must exist; null is a value of theirs that isn't counted as an owner). Texts of any length are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import durable

#: The patterns that the results' contract states, and the group that holds the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Long tokens that hold a digit, a small and a capital letter.
MIXED = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{32,}"
KINDS = ("assign", "access", "hex", "mixed")
#: A value that so many owners have is an example that people copy.
COPIED_OWNERS = 3
ANY = (ASSIGN, ACCESS, HEX, MIXED)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """The leftmost matches that don't overlap: kind, n, gap and whole (code points), gap_b and whole_b (bytes), kept, hash.

    gap: the text between the match before and this one. kept: its value is long enough, and a mixed token is mixed.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())

    def facts(x: Column, n: Column) -> Column:
        kept = F.length(x["value"]) >= least
        if kind == KINDS.index("mixed"):
            kept = x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
        sizes = {"gap": F.length(x["gap"]), "whole": F.length(x["whole"]), "gap_b": F.octet_length(x["gap"]), "whole_b": F.octet_length(x["whole"])}
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), *(c.alias(k) for k, c in sizes.items()), kept.alias("kept"), F.when(kept, F.sha2(x["value"], 256)).alias("hash"))

    found = F.transform(zipped, facts)
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,whole:int,gap_b:int,whole_b:int,kept:boolean,hash:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def all_matches(text: Column) -> Column:
    return F.concat(matches(text, ASSIGN, 0, 2, 6), matches(text, ACCESS, 1), matches(text, HEX, 2), matches(text, MIXED, 3))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def spans(rows: DataFrame) -> DataFrame:
    """_row, owner, repository, hash, start, kind, end, start_b, end_b of every candidate. rows: _row, owner, repository, found.

    Mixed tokens that overlap a base span are none.
    """
    each = rows.filter(F.size("found") > 0).select("_row", "owner", "repository", F.explode("found").alias("x")).select("_row", "owner", "repository", "x.*").repartition("_row")
    so_far = Window.partitionBy("_row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"end": F.sum(F.col("gap") + F.col("whole")).over(so_far), "end_b": F.sum(F.col("gap_b") + F.col("whole_b")).over(so_far)}).filter("kept")
    each = each.withColumns({"start": F.col("end") - F.col("whole"), "start_b": F.col("end_b") - F.col("whole_b")})
    base = F.col("kind") < KINDS.index("mixed")
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"_reach": F.max(F.when(base, F.col("end"))).over(before), "_next": F.min(F.when(base, F.col("start"))).over(behind)})
    overlaps = (F.col("_reach") > F.col("start")) | (F.col("_next") < F.col("end"))
    free = base | ~F.coalesce(overlaps, F.lit(False))
    return each.filter(free).select("_row", "owner", "repository", "hash", *(F.col(c).cast("int").alias(c) for c in ("start", "kind", "end", "start_b", "end_b")))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories: distinct numbers over the whole corpus. found: hash, owner, repository."""
    once = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("repository").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("n").alias("repositories"))


def _named(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _counted(rows: DataFrame) -> DataFrame:
    """The candidates of every row with owners and repositories of their values."""
    each = durable(spans(rows), "secret-spans")
    counts = durable(ownership(each.select("hash", "owner", "repository")), "secret-owners")
    return each.drop("owner", "repository").join(counts, "hash")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, max_owners, max_repositories for every row.

    n_live and n_copied count the row's candidates that at most one owner has, and that `copied_owners` or more have.
    """
    repository = owner if repository is None else repository
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), all_matches(content).alias("found"), _named(owner).cast("string").alias("owner"), _named(repository).cast("string").alias("repository"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    span = F.struct("start", "kind", "end")
    stays = (F.col("kind") < KINDS.index("mixed")) | (F.col("owners") < copied_owners)
    found = _counted(rows).groupBy("_row").agg(
        *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.array_sort(F.collect_list(F.when(F.col("kind") < KINDS.index("mixed"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(stays, span))).alias("all"),
        F.count_if(F.col("owners") <= 1).alias("n_live"),
        F.count_if(F.col("owners") >= copied_owners).alias("n_copied"),
        F.max("owners").alias("max_owners"),
        F.max("repositories").alias("max_repositories"),
    )
    done = rows.select("_row", "key").join(found, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text_of = lambda c: F.coalesce(joined(F.col(c)), F.lit(""))
    return done.select(
        F.col("key").alias(key), zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all").alias("spans"), zero("n_live"), zero("n_copied"), zero("max_owners"), zero("max_repositories")
    )


def masked(text: Column, found: Column, mask: str) -> Column:
    """text with each of the sorted spans, or what of it isn't masked yet, replaced by the mask.

    found: start_b and end_b, in bytes, and cover: how far the spans before reach. Pieces are cut out of the bytes, which
    are bound once: a cut costs its own length.
    """

    def pieces(b: Column) -> Column:
        def piece(x: Column) -> Column:
            gap = F.when(x["start_b"] > x["cover"], F.substring(b, x["cover"] + 1, x["start_b"] - x["cover"]).cast("string")).otherwise("")
            return F.concat(gap, F.when(x["start_b"] >= x["cover"], mask).otherwise(""))

        end = F.array_max(F.transform(found, lambda x: x["end_b"]))
        return F.concat(F.array_join(F.transform(found, piece), ""), F.substring(b, end + 1, F.octet_length(b)).cast("string"))

    return F.get(F.transform(F.array(text.cast("binary")), pieces), F.lit(0))


def mask_live(
    df: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column | None = None, copied_owners: int = COPIED_OWNERS, mask: str = "[secret]", length: str | None = None
) -> DataFrame:
    """df, all rows and columns, with every secret that fewer than `copied_owners` owners have masked in `text`.

    length: a column to be set to the new length of the texts that change. Rows whose text holds no candidate pass
    through; the others are written once, numbered, and meet their live spans by a join on that number.
    """
    repository = owner if repository is None else repository
    content = F.coalesce(F.col(text), F.lit(""))
    suspect = content.rlike(ANY[0])
    for p in ANY[1:]:
        suspect = suspect | content.rlike(p)
    doc = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    rows = df.filter(suspect).select(doc, all_matches(content).alias("found"), _named(owner).cast("string").alias("owner"), _named(repository).cast("string").alias("repository"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    live = _counted(rows).filter(F.col("owners") < copied_owners).select("_row", "start_b", "end_b").distinct()
    earlier = Window.partitionBy("_row").orderBy("start_b", "end_b").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("cover", F.coalesce(F.max("end_b").over(earlier), F.lit(0)))
    live = durable(live.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start_b", "end_b", "cover"))).alias("spans")), "live-secrets")
    old = lambda c: F.col("doc").getField(c)
    # The new text has a name of its own: beside another expression, `text` inside a lambda would mean the new one.
    new = rows.select("_row", "doc").join(live, "_row", "left").withColumn("new", F.when(F.col("spans").isNull(), old(text)).otherwise(masked(old(text), F.col("spans"), mask)))
    types = dict(df.dtypes)
    sizes = F.when(F.col("spans").isNull(), old(length)).otherwise(F.length("new").cast(types[length])) if length else None
    new = new.select(*((F.col("new") if c == text else sizes if c == length else old(c)).alias(c) for c in df.columns))
    return df.filter(~suspect).unionByName(new)
