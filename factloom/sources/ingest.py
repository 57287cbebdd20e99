"""From files to fact tables: one parse of every changed file, names resolved by joins, a snapshot written at the end."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from functools import cache
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import begins, cognitive, cyclomatic, line_count, simple_name
from factloom.operators import call_targets, changes
from factloom.operators.joins import resolve_references
from factloom.schemas import DDL, FILE_COLUMN, conform, stable_id
from factloom.session import shuffled, stored
from factloom.sources.store import FILES_A_BUCKET, MOST_BUCKETS, PARTS, Change, Manifest, Outrun, Store, bucket, bucket_count

SYMBOL = "nth int, start_line int, end_line int, kind string, name string, qualified_name string, signature string, return_type string, parent_class string, modifiers int, javadoc string, super_class string, interfaces array<string>, is_data_class boolean, is_object boolean, is_sealed boolean, is_companion boolean, is_trait boolean, is_case_class boolean"
__all__ = ["PARTS", "Facts", "Outrun", "Store", "index", "parse_files", "repair", "resolve"]

#: What a parse gives for each table.
PARSED = {
    "symbols": SYMBOL,
    "references": "from_line int, context string, ref_name string",
    "calls": "caller_method string, caller_line int, callee_method string, roots array<string>, steps array<string>",
    "annotations": "name string, attributes map<string,string>, owner string, owner_kind string",
    "routes": "http_method string, path string, base_path string, method_path string, start_line int, owner string",
    "beans": "depends_on_type string, injection_type string, field_name string, start_line int, owner string",
    "bean_sources": "return_type string, bean_name string, source_type string, start_line int, owner string",
    "bindings": "config_key string, field_name string, binding_type string, start_line int, owner string",
    "tests": "test_class_name string, source_class_name string, mapping_type string",
    "chunks": "type string, start_line int, end_line int, name string, content string, package_name string, class_name string, signature string",
    "config": "line int, key string, value string, config_type string, content string",
    "dependencies": "line int, group_id string, artifact_id string, version string, scope string, dep_type string, classifier string",
    "modules": "module string",
    "types": "owner string, params array<string>, supers array<string>, interface boolean, members array<struct<name string, least int, most int, kind string>>",
    "scopes": "packages array<string>, names array<string>",
}


def parsers() -> dict:
    from factloom.sources import builds, java, jvm, settings, shell

    return {
        "java": java.parse, "kotlin": jvm.parse_kotlin, "scala": jvm.parse_scala, "shell": shell.parse, "yaml": settings.parse_yaml, "properties": settings.parse_properties,
        "env": settings.parse_env, "pom": builds.parse_pom, "gradle": builds.parse_gradle,
    }


def parse_files(files: DataFrame) -> DataFrame:
    """project, file_path, a column of rows for each table of PARSED, and errors. A file that can't be parsed has errors only."""
    fields = ", ".join(f"{t} array<struct<{', '.join(f'{c}' if ':' in c else c.replace(' ', ':', 1) for c in _columns(ddl))}>>" for t, ddl in PARSED.items())
    ddl = f"project string, file_path string, {fields}, errors array<string>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language = parsers()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for project, path, lang, content in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    try:
                        facts = by_language[lang](content or "")
                        row = {t: getattr(facts, t) for t in PARSED} | {"symbols": _numbered(facts.symbols), "errors": facts.errors}
                    except Exception as e:  # a file's fault stays its own: the others are indexed
                        row = {"errors": [f"{type(e).__name__}: {e}"]}
                    out.append({"project": project, "file_path": path} | row)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    # A table of a million files may be one small part of a file: they are dealt out, so that all cores parse.
    dealt = files.select("project", "file_path", "lang", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "file_path")
    return dealt.mapInArrow(run, ddl)


def _numbered(symbols: list[dict]) -> list[dict]:
    """Symbols of one name and signature are told apart by their order, not by lines, which move with every edit above."""
    seen: Counter = Counter()
    found = []
    for s in symbols:
        key = s.get("kind"), s.get("qualified_name"), s.get("signature")
        found.append(s | {"nth": seen[key]})
        seen[key] += 1
    return found


def _columns(ddl: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[at:i].strip())
            at = i + 1
    return [*parts, ddl[at:].strip()]


class Facts:
    """The fact tables of files, made when they are asked for; names of other files' symbols are left open, see resolve.

    counts: rows of each list that a parse gives, and errors.
    """

    def __init__(self, files: DataFrame, now_ms: int | None = None):
        self.files, self.parsed = files, stored(parse_files(files))
        self.now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        lists = (*PARSED, "errors")
        row = self.parsed.selectExpr("count(1) AS files", *(f"coalesce(sum(cardinality({t})), 0) AS {t}" for t in lists)).first()
        self.counts: dict[str, int] = row.asDict()

    #: The list that a table's rows come from.
    SOURCE = {"code_references": "references", "api_routes": "routes", "bean_dependencies": "beans", "config_bindings": "bindings", "test_mappings": "tests", "config_entries": "config", "code_metrics": "symbols", "file_meta": "files", "index_metadata": "files"}

    def some(self, table: str) -> bool:
        """Whether there may be rows of a table."""
        return self.counts[self.SOURCE.get(table, table)] > 0

    def table(self, name: str) -> DataFrame:
        return conform(getattr(self, f"_{name}")(), name)

    def _each(self, name: str) -> DataFrame:
        return self.parsed.select("project", "file_path", F.inline(name))

    def _identified(self, df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("id", stable_id("project", *key))

    def _symbols(self) -> DataFrame:
        return self._identified(self._each("symbols"), "file_path", "kind", "qualified_name", "signature", "nth")

    def _owned(self, df: DataFrame) -> DataFrame:
        owners = self._symbols().groupBy("project", "file_path", F.col("qualified_name").alias("owner")).agg(F.min("id").alias("symbol_id"))
        return df.join(shuffled(owners), ["project", "file_path", "owner"], "left")

    def _code_references(self) -> DataFrame:
        return self._identified(self._each("references"), "file_path", "from_line", "context").withColumnRenamed("file_path", "from_file")

    def _calls(self) -> DataFrame:
        return self._each("calls").withColumnsRenamed({"file_path": "caller_file", "callee_method": "named"})

    def _types(self) -> DataFrame:
        return self._identified(self._each("types"), "file_path", "owner")

    def _scopes(self) -> DataFrame:
        return self._each("scopes")

    def _annotations(self) -> DataFrame:
        by_kind = self._symbols().groupBy("project", "file_path", F.col("qualified_name").alias("owner"), F.col("kind").alias("owner_kind")).agg(F.min("id").alias("symbol_id"))
        return self._identified(self._each("annotations").join(shuffled(by_kind), ["project", "file_path", "owner", "owner_kind"], "left"), "file_path", "owner", "name")

    def _api_routes(self) -> DataFrame:
        return self._identified(self._owned(self._each("routes")), "file_path", "http_method", "path", "start_line")

    def _bean_sources(self) -> DataFrame:
        return self._identified(self._owned(self._each("bean_sources")), "file_path", "bean_name", "start_line")

    def _config_bindings(self) -> DataFrame:
        return self._identified(self._owned(self._each("bindings")), "file_path", "config_key", "field_name", "start_line")

    def _bean_dependencies(self) -> DataFrame:
        beans = self._owned(self._each("beans")).withColumnRenamed("symbol_id", "bean_symbol_id")
        return self._identified(beans, "file_path", "owner", "depends_on_type", "injection_type", "field_name")

    def _test_mappings(self) -> DataFrame:
        own_class = self._symbols().filter("kind = 'CLASS'").groupBy("project", "file_path", F.col("name").alias("test_class_name")).agg(F.min("id").alias("test_symbol_id"))
        return self._identified(self._each("tests").join(shuffled(own_class), ["project", "file_path", "test_class_name"], "left"), "file_path", "test_class_name")

    def _chunks(self) -> DataFrame:
        return self._identified(self._each("chunks"), "file_path", "type", "class_name", "name", "start_line")

    def _config_entries(self) -> DataFrame:
        return self._identified(self._each("config"), "file_path", "key", "line")

    def _dependencies(self) -> DataFrame:
        return self._identified(self._each("dependencies"), "file_path", "group_id", "artifact_id", "line", "scope")

    def _code_metrics(self) -> DataFrame:
        symbols = self._symbols()
        methods = self._each("chunks").filter("type = 'METHOD'").groupBy("project", "file_path", "class_name").agg(
            F.count(F.lit(1)).alias("method_count"), F.sum(line_count(F.col("content"))).alias("lines_of_code"), F.sum(cyclomatic(F.col("content"))).alias("cyclomatic_complexity"), F.sum(cognitive(F.col("content"))).alias("cognitive_complexity")
        )
        fields = symbols.filter("kind = 'FIELD'").groupBy("project", "file_path", F.col("parent_class").alias("class_name")).agg(F.count(F.lit(1)).alias("field_count"))
        kinds = symbols.filter("kind = 'CLASS'").select("project", "file_path", F.col("name").alias("class_name"), F.col("id").alias("symbol_id"), F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1).alias("package_name"))
        metrics = kinds.join(shuffled(methods), ["project", "file_path", "class_name"]).join(shuffled(fields), ["project", "file_path", "class_name"], "left")
        return metrics.withColumns({"field_count": F.coalesce("field_count", F.lit(0)), "complexity_estimate": F.col("cyclomatic_complexity"), "updated_at": F.lit(self.now_ms), "id": stable_id("project", "file_path", "class_name")})

    def _file_meta(self) -> DataFrame:
        counts = self.parsed.select("project", "file_path", F.coalesce(F.cardinality("symbols"), F.lit(0)).alias("symbol_count"))
        return self.files.select("project", "file_path", "size", "last_modified", "sha1").join(shuffled(counts), ["project", "file_path"], "left").withColumns({"symbol_count": F.coalesce("symbol_count", F.lit(0)), "last_indexed_at": F.lit(self.now_ms)})

    def _index_metadata(self) -> DataFrame:
        return self.files.select("project").distinct().select("project", F.lit("last_indexed_at").alias("key"), F.lit(str(self.now_ms)).alias("value"), F.lit(self.now_ms).alias("updated_at"))


#: What resolve finds in a table, and the name that it goes by.
RESOLVED: dict[str, tuple[tuple[str, ...], Column]] = {}


def _resolved() -> dict[str, tuple[tuple[str, ...], Column]]:
    if not RESOLVED:  # columns need a session
        RESOLVED.update({
            "code_references": (("symbol_id",), F.col("ref_name")),
            "calls": (("callee_method", "callee_file"), F.coalesce("callee_method", "named")),
            "bean_dependencies": (("depends_on_symbol_id", "same_file"), _bean_type()),
            "test_mappings": (("source_symbol_id",), F.col("source_class_name")),
        })
    return RESOLVED


def _bean_type() -> Column:
    return simple_name(F.regexp_replace("depends_on_type", "<.*", ""))


def resolve(table: str, df: DataFrame, symbols: DataFrame, declared: call_targets.Declared | None = None) -> DataFrame:
    """Rows of one of RESOLVED with every name that refers to a symbol resolved against all symbols of its project.

    A reference that names no symbol keeps a null symbol_id. A call whose target no file of the project tells, and that
    has no plain name either, or whose target is the platform's, keeps a null callee_method. declared: of all
    projects, for calls. Columns of df that begin with _ stay.
    """
    own = [c for c in df.columns if c.startswith("_")]
    named = symbols.select("project", "file_path", "id", "kind", "name", "qualified_name")
    classes = named.filter("kind = 'CLASS'")
    anywhere = classes.groupBy("project", F.col("name").alias("bean")).agg(F.min_by("id", F.struct("qualified_name", "file_path")).alias("any"))
    if table == "code_references":
        tag = lambda c: F.concat_ws("\u0001", "project", c)
        tagged = named.withColumns({"qualified_name": tag("qualified_name"), "name": tag("name")})
        references = df.drop("symbol_id").withColumns({"plain": F.col("ref_name"), "ref_name": tag("ref_name")})
        found = resolve_references(references, tagged, keep_open=True).withColumn("ref_name", F.col("plain"))
    elif table == "calls":
        targets = named.groupBy("project", F.col("qualified_name").alias("callee_method")).agg(F.min("file_path").alias("callee_file"))
        solved = call_targets.solve(df.drop("callee_file", "callee_method"), declared) if declared is not None else df.withColumns({"target": F.lit(None), "platform": F.lit(False)})
        target = F.coalesce(F.when(~F.coalesce(begins(F.col("target"), call_targets.PLATFORM), F.lit(False)), F.col("target")), F.when(~F.col("platform"), F.col("named")))
        found = solved.drop("callee_file").withColumn("callee_method", target).join(shuffled(targets), ["project", "callee_method"], "left")
        found = found.withColumn("id", F.when(F.col("callee_method").isNotNull(), stable_id("project", "caller_file", "caller_line", "caller_method", "callee_method")))
    elif table == "bean_dependencies":
        local = classes.groupBy("project", "file_path", F.col("name").alias("bean")).agg(F.min("id").alias("local"))
        beans = df.withColumn("bean", _bean_type()).join(shuffled(local), ["project", "file_path", "bean"], "left").join(shuffled(anywhere), ["project", "bean"], "left")
        found = beans.withColumns({"depends_on_symbol_id": F.coalesce("local", "any"), "same_file": F.col("local").isNotNull()})
    else:
        sources_ = anywhere.select("project", F.col("bean").alias("source_class_name"), F.col("any").alias("source_symbol_id"))
        found = df.drop("source_symbol_id").join(shuffled(sources_), ["project", "source_class_name"], "left")
    return conform(found, table, *own)


def index(store: Store, files: DataFrame, full_listing: bool = True, now_ms: int | None = None, lost: frozenset[int] = frozenset()) -> dict[str, int]:
    """Brings the store up to date with the files: what is new or changed is parsed, what vanished is removed.

    files: project, file_path, lang, size, last_modified, sha1, content. full_listing: files that aren't listed are gone.
    lost: buckets that can't be read; their files are parsed again. A writer that is outrun by another one starts again
    from the other's snapshot. Snapshots that nobody reads any more go.
    """
    while True:
        try:
            with store.pinned():
                done = _index(store, files, full_listing, now_ms, set(lost))
            break
        except Outrun:
            continue
    if done["changed"] or done["deleted"]:
        store.vacuum()
    return done


def repair(store: Store, files: DataFrame, deep: bool = False, now_ms: int | None = None) -> dict[str, int]:
    """Parses the files anew whose facts are in damaged parts of the store. files: a listing of all its projects."""
    with store.pinned():
        lost = frozenset(store.lost(deep))
    return index(store, files, True, now_ms, lost) if lost else {"changed": 0, "deleted": 0, "errors": 0}


def _index(store: Store, files: DataFrame, full_listing: bool, now_ms: int | None, lost: set[int]) -> dict[str, int]:
    at = store.manifest()
    # One pass over the listing: what is new or differs, with its content, and what is gone, without.
    known = store.rows("file_meta", without=lost).select("project", "file_path", F.col("sha1").alias("_sha1"), F.lit(True).alias("known"))
    listed = files.withColumn("_listed", F.lit(True))
    both = listed.join(shuffled(known), ["project", "file_path"], "full_outer" if full_listing else "left")
    differs = stored(both.filter(F.col("_listed").isNull() | F.col("known").isNull() | ~F.col("sha1").eqNullSafe(F.col("_sha1"))))
    gone = F.col("_listed").isNull()
    stale = differs.select("project", "file_path", gone.alias("gone"), F.coalesce("known", F.lit(False)).alias("known"))
    placed = _placed(stale, "file_meta", at.buckets).groupBy("gone", "known", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # by bucket
    n_changed, n_gone, n_known = (sum(r["n"] for r in placed if test(r)) for test in (lambda r: not r["gone"], lambda r: r["gone"], lambda r: r["known"]))
    if not placed and not lost:
        return {"changed": 0, "deleted": 0, "errors": 0}
    new = Facts(differs.filter(~gone).select(*files.columns), now_ms)
    before = at.files if not lost else store.rows("file_meta", without=lost).count()
    n_files = before + n_changed - (n_known - n_gone) - n_gone
    outgrown = n_files > 4 * FILES_A_BUCKET * at.buckets and at.buckets < MOST_BUCKETS
    if not at.number or outgrown or 2 * (n_changed + n_gone) > n_files:
        change = _anew(store, at, stale, new, bucket_count(n_files), lost, n_files)
    else:
        change = _increment(store, at, stale, {r["_bucket"] for r in placed} | lost, n_known > 0 or bool(lost), new, lost, n_files)
    store.write(change, at)
    return {"changed": n_changed, "deleted": n_gone, "errors": new.counts["errors"]}


def _declared(types: DataFrame, scopes: DataFrame) -> DataFrame:
    """h: a digest of each class's declaration and of the packages that its open names are looked for in."""
    both = types.join(shuffled(scopes.select("project", "file_path", "packages")), ["project", "file_path"], "left")
    return both.select(F.xxhash64(F.to_json(F.struct("project", "file_path", "packages", *types.drop("id", "project", "file_path", "_bucket").columns))).alias("h"))


def _left(rows: DataFrame, table: str, stale: DataFrame) -> DataFrame:
    """A table's rows without those of stale files."""
    named = FILE_COLUMN[table]
    return rows.join(shuffled(stale.select("project", F.col("file_path").alias(named))), ["project", named], "left_anti")


def _placed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", bucket(buckets, table))


def _metadata(store: Store, new: Facts) -> DataFrame:
    return changes.upsert(store.table("index_metadata"), new.table("index_metadata"), ("project", "key"), "updated_at")


#: What names are resolved by.
SYMBOL_NAMES = ("project", "file_path", "id", "kind", "name", "qualified_name")


def _anew(store: Store, at: Manifest, stale: DataFrame, new: Facts, buckets: int, lost: set[int], n_files: int) -> Change:
    """All of every table, in new buckets."""
    old = lambda t: bool(at.parts.get(t))

    def left(t: str) -> DataFrame:
        return _left(store.rows(t, without=lost).drop("_bucket"), t, stale).unionByName(new.table(t)) if old(t) else new.table(t)

    symbols = stored(left("symbols").select(*SYMBOL_NAMES)) if old("symbols") else new.table("symbols")

    def whole(t: str) -> tuple[DataFrame, None]:
        df = _metadata(store, new) if t == "index_metadata" else left(t)
        return _placed(resolve(t, df, symbols, call_targets.Declared(left("types"), left("scopes")) if t == "calls" else None) if t in _resolved() else df, t, buckets), None

    return Change(buckets, n_files, {t: lambda t=t: whole(t) for t in DDL if old(t) or new.some(t)})


def _increment(store: Store, at: Manifest, stale: DataFrame, own: set[int], known: bool, new: Facts, lost: set[int], n_files: int) -> Change:
    """The buckets of the stale files, and those of other files whose names now mean another symbol.

    known: some stale file has rows in the store.
    """
    before = store.rows("symbols", only=own, without=lost).select(*SYMBOL_NAMES)
    all_ = store.rows("symbols", without=lost).select(*SYMBOL_NAMES)
    fresh = new.table("symbols").select(*SYMBOL_NAMES)
    symbols = (_left(all_, "symbols", stale) if known else all_).unionByName(fresh)
    declared = call_targets.Declared(*((_left(store.rows(t, without=lost), t, stale) if known else store.rows(t, without=lost)).drop("_bucket").unionByName(new.table(t)) for t in ("types", "scopes")))
    lock = Lock()

    def retyped() -> bool:
        """Whether some class, member or type isn't declared as before: then calls of any file may have other targets."""
        was = _declared(store.rows("types", only=own, without=lost).join(shuffled(stale.select("project", "file_path")), ["project", "file_path"], "left_semi"), store.rows("scopes", only=own, without=lost))
        now = _declared(new.table("types"), new.table("scopes"))
        return not was.unionByName(now).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").isEmpty()

    @cache
    def moved() -> dict[str, set[int]]:
        if lost:  # what was there before isn't known
            return _moved(store, at, own, None, symbols, declared)
        if not known and not new.some("symbols"):
            return {}
        # Names whose symbols aren't what they were.
        gone = before.join(shuffled(stale.select("project", "file_path")), ["project", "file_path"], "left_semi") if known else before.limit(0)
        differs = gone.unionByName(fresh).groupBy(*SYMBOL_NAMES).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
        return _moved(store, at, own, differs.select("project", F.explode(F.array("name", "qualified_name")).alias("_name")).distinct(), symbols, declared if retyped() else None)

    def written(t: str) -> tuple[DataFrame, set[int]]:
        touched = set(own) if new.some(t) or (known and at.parts.get(t)) else set()
        if t in _resolved():
            with lock:
                touched |= moved().get(t, set())
        more = at.absorbed(t, touched) if touched else set()
        rows = store.rows(t, only=touched, without=lost)
        rows = (_left(rows, t, stale) if known else rows).unionByName(_placed(new.table(t), t, at.buckets))
        rows = resolve(t, rows, symbols, declared if t == "calls" else None) if t in _resolved() else rows
        return rows.unionByName(store.rows(t, only=more)) if more else rows, touched | more

    metadata = {"index_metadata": lambda: (_placed(_metadata(store, new), "index_metadata", at.buckets), None)}
    return Change(at.buckets, n_files, metadata | {t: lambda t=t: written(t) for t in DDL if t != "index_metadata" and (new.some(t) or at.parts.get(t))})


def _moved(store: Store, at: Manifest, own: set[int], names: DataFrame | None, symbols: DataFrame, declared: call_targets.Declared | None) -> dict[str, set[int]]:
    """Of each table the buckets, but for `own`, with rows that now resolve otherwise; names: only those of these names.

    declared: types and scopes if they aren't what they were. A call's target depends on every type on the way to it, so
    then all calls are looked at; else none can have moved.
    """
    differs = None
    for t, (found, name) in _resolved().items():
        if not at.parts.get(t) or t == "calls" and declared is None:
            continue
        df = store.rows(t, without=own).withColumn("_old", F.struct(*found))
        df = df if names is None or t == "calls" else df.withColumn("_name", name).join(shuffled(names), ["project", "_name"], "left_semi")
        df = resolve(t, df, symbols, declared if t == "calls" else None).filter(~F.struct(*found).eqNullSafe(F.col("_old"))).select(F.lit(t).alias("part"), "_bucket")
        differs = df if differs is None else differs.unionByName(df)
    moved: dict[str, set[int]] = {}
    for r in differs.distinct().collect() if differs is not None else ():  # buckets by table, whatever the rows
        moved.setdefault(r["part"], set()).add(r["_bucket"])
    return moved
