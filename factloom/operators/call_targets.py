"""Call targets: types of chains found step by step, by joins of scopes, classes and inherited members.

Names are resolved as the files' packages and imports say, ancestors by doubling, members by one table of every class
and name. Each step of a chain is one join over the distinct chains of a file, so a batch of joins
is repeated as often as the longest unfinished chain has steps. A type that the platform declares ends a chain.
"""

from __future__ import annotations

import re
from functools import cached_property
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.text import begins
from factloom.session import shuffled, stored
from factloom.sources.code_text import split_top
from factloom.sources.java import PLATFORM

#: What every object has, with its count of arguments.
OF_OBJECTS = ("getClass/0", "hashCode/0", "equals/1", "clone/0", "toString/0", "notify/0", "notifyAll/0", "wait/0", "wait/1", "wait/2", "finalize/0")
#: Names of java.lang that need no import.
LANG = tuple(
    "Object String Integer Long Short Byte Character Boolean Double Float Number Math StrictMath System Thread Runnable ThreadLocal Iterable Comparable CharSequence StringBuilder StringBuffer Enum Record Class ClassLoader Void Runtime Process ProcessBuilder Throwable Exception Error RuntimeException IllegalArgumentException IllegalStateException NullPointerException UnsupportedOperationException IndexOutOfBoundsException InterruptedException CloneNotSupportedException NumberFormatException ArithmeticException ClassCastException StackTraceElement AutoCloseable Cloneable".split()
)
#: Steps between two writes of what is left.
STRIDE = 3
CUT = r"(?=[<>,\[\]])|(?<=[<>,\[\]])"


@F.pandas_udf(StringType())
def _substituted(kind: pd.Series, params: pd.Series, given: pd.Series) -> pd.Series:
    """A type with a class's type parameters replaced by the arguments of `given`; `?` where there are none."""

    def one(k, ps, g):
        if k is None or "'" not in k:
            return k
        inside = g[g.index("<") + 1 : -1] if g and "<" in g and g.endswith(">") else ""
        values = dict(zip(ps if ps is not None else (), split_top(inside) if inside else (), strict=False))
        return re.sub(r"'([\w$]+)", lambda m: values.get(m[1], "?"), k)

    return pd.Series([one(*row) for row in zip(kind, params, given, strict=True)], dtype=object)


def raw(kind: Column) -> Column:
    """The class of a type, null for arrays."""
    return F.when(~kind.endswith("[]"), F.regexp_extract(kind, r"^[^<]*", 0))


def names(scopes: DataFrame, types: DataFrame) -> DataFrame:
    """project, file_path, known: what the names that a file leaves open mean there, by its package, then its imports of packages."""
    used = scopes.select("project", "file_path", "packages", F.explode("names").alias("name"))
    places = used.select("project", "file_path", "name", "packages", F.posexplode("packages").alias("place", "package"))
    places = places.withColumn("owner", F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")))
    hit = places.join(shuffled(types.select("project", "owner", F.lit(True).alias("there")).distinct()), ["project", "owner"], "left")
    hit = hit.groupBy("project", "file_path", "name", "packages").agg(F.min(F.when(F.col("there"), F.struct("place", "owner")))["owner"].alias("found"))
    stars = F.expr("slice(packages, 2, size(packages))")
    outside = F.when(F.col("name").isin(*LANG), F.concat(F.lit("java.lang."), "name")).when((F.size(stars) > 0) & F.forall(stars, lambda p: begins(F.concat(p, F.lit(".")), PLATFORM)), F.concat_ws(".", stars[0], F.col("name")))
    meant = hit.withColumn("found", F.coalesce("found", outside, F.lit("?")))
    return meant.groupBy("project", "file_path").agg(F.map_from_entries(F.collect_set(F.struct("name", "found"))).alias("known"))


def written_out(kind: Column, known: Column) -> Column:
    """A type with the file's open names replaced by what they mean."""
    part = lambda t: F.when(t.startswith("~"), F.coalesce(known[F.substring(t, 2, 1 << 30)], F.lit("?"))).otherwise(t)
    return F.array_join(F.transform(F.split(kind, CUT), part), "")


def ancestors(classes: DataFrame) -> DataFrame:
    """project, owner, above, given (above with its arguments, in terms of owner's parameters), depth; a class is its own at depth 0.

    Ways double twice before they are written, and a class is kept once, by its shortest way. A longer way than those
    looked at goes over a class at just that depth, so where there is none all are found: rounds grow with the logarithm
    of the depth, and a cycle of broken code ends.
    """
    params = classes.groupBy("project", F.col("owner").alias("above")).agg(F.min("params").alias("params"))
    own = F.when(F.size("params") > 0, F.concat("owner", F.lit("<"), F.array_join(F.transform("params", lambda p: F.concat(F.lit("'"), p)), ","), F.lit(">"))).otherwise(F.col("owner"))
    start = classes.select("project", "owner", F.col("owner").alias("above"), own.alias("given"), F.lit(0).alias("depth"))
    links = classes.select("project", "owner", F.explode("supers").alias("given")).select("project", "owner", raw(F.col("given")).alias("above"), "given", F.lit(1).alias("depth")).filter("above is not null")

    def doubled(found: DataFrame) -> DataFrame:
        upper = found.filter("depth > 0").select("project", F.col("owner").alias("above"), F.col("above").alias("_above"), F.col("given").alias("_given"), F.col("depth").alias("_depth"))
        met = found.filter("depth > 0").join(shuffled(params), ["project", "above"]).join(shuffled(upper), ["project", "above"])
        longer = met.select("project", "owner", F.col("_above").alias("above"), _substituted("_given", "params", "given").alias("given"), (F.col("depth") + F.col("_depth")).alias("depth"))
        return found.unionByName(longer).groupBy("project", "owner", "above").agg(F.min(F.struct("depth", "given")).alias("way")).select("project", "owner", "above", "way.given", "way.depth")

    found, reach = start.unionByName(links), 1
    while True:
        found, reach = stored(doubled(doubled(found))), 4 * reach
        if (found.agg(F.max("depth")).first()[0] or 0) < reach:
            return found


class Declared:
    """What the files of all projects declare, written out once for all that is solved against it.

    types: project, file_path, owner, params, supers, interface, members. scopes: project, file_path, packages, names.
    """

    def __init__(self, types: DataFrame, scopes: DataFrame):
        self.types, self.scopes = types, scopes
        self._lock = Lock()

    @cached_property
    def known(self) -> DataFrame:
        return stored(names(self.scopes, self.types))

    def prepare(self) -> None:
        with self._lock:  # tables are written by several threads
            _ = self.lookup

    @cached_property
    def classes(self) -> DataFrame:
        inside = self.types.join(shuffled(self.known), ["project", "file_path"], "left")
        out = lambda c: written_out(c, F.col("known"))
        member = lambda m: F.struct(m["name"].alias("name"), m["least"].alias("least"), m["most"].alias("most"), out(m["kind"]).alias("kind"))
        return stored(inside.select("project", "owner", "params", "interface", F.transform("supers", out).alias("supers"), F.transform("members", member).alias("members")))

    @cached_property
    def above(self) -> DataFrame:
        return ancestors(self.classes)

    @cached_property
    def lookup(self) -> DataFrame:
        """project, _class, name, overloads: of every class and name what it has or inherits, nearest first, classes before interfaces."""
        members = self.classes.select("project", F.col("owner").alias("above"), "interface", "params", F.inline("members"))
        kind = F.when(F.col("depth") == 0, F.col("kind")).otherwise(_substituted("kind", "params", "given"))
        found = self.above.join(shuffled(members), ["project", "above"]).select("project", F.col("owner").alias("_class"), "name", "interface", "depth", F.col("above").alias("declaring"), "least", "most", kind.alias("kind"))
        return stored(found.groupBy("project", "_class", "name").agg(F.array_sort(F.collect_set(F.struct("interface", "depth", "declaring", "least", "most", "kind"))).alias("overloads")))

    def bounds(self) -> DataFrame:
        """project, _class, params, only_platform: whether all that is above a class and not the project's is the platform's; null if there is nothing."""
        params = self.classes.groupBy("project", F.col("owner").alias("_class")).agg(F.min("params").alias("params"))
        ends = self.above.join(shuffled(params.select("project", F.col("_class").alias("above"))), ["project", "above"], "left_anti")
        outer = ends.groupBy("project", F.col("owner").alias("_class")).agg(F.bool_and(begins(F.col("above"), PLATFORM)).alias("only_platform"))
        return params.join(shuffled(outer), ["project", "_class"], "left")


def solve(calls: DataFrame, declared: Declared) -> DataFrame:
    """calls with `target`, the qualified name of the method that is called, and `platform`, whether the platform declares it.

    calls: project, caller_file, roots, steps and more. A null target that isn't the platform's isn't known: no class of
    the project has it, or a type on the way is another library's.
    """
    site = F.concat_ws("\u0001", F.concat_ws("\u0001", "roots"), F.lit("\u0002"), F.concat_ws("\u0001", "steps"))
    calls = calls.withColumn("_site", F.when(F.size("roots") > 0, site))
    declared.prepare()
    table, bounds = declared.lookup, declared.bounds()
    sites = calls.filter("_site is not null").select("project", F.col("caller_file").alias("file_path"), "_site", "roots", "steps").distinct()
    begun = sites.join(shuffled(declared.known), ["project", "file_path"], "left").select("project", "file_path", "_site", "steps", F.posexplode("roots").alias("root", "_root"), "known")
    begun = begun.withColumns({"at": F.substring_index("_root", ":", 1).cast("int"), "kind": written_out(F.expr("substring(_root, instr(_root, ':') + 1)"), F.col("known"))})
    state = begun.select("project", "file_path", "_site", "steps", "root", "at", "kind", F.lit(0).alias("taken"), F.lit(None).cast("string").alias("target"), F.lit("going").alias("verdict"))
    done = None
    while True:
        for _ in range(STRIDE):
            state = _step(state, table, bounds)
        state = stored(state)
        ended = state.filter("verdict <> 'going'")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("verdict = 'going'")
        if state.isEmpty():
            break
    # The first root that led anywhere; else the platform, if one root is its.
    rank = F.when(F.col("taken") > 0, 0).when(F.col("verdict") == "platform", 1).otherwise(2)
    best = done.groupBy("project", "file_path", "_site").agg(F.min_by(F.struct("target", "verdict"), F.struct(rank.alias("rank"), "root")).alias("best"))
    best = best.select("project", F.col("file_path").alias("caller_file"), "_site", F.when(F.col("best.verdict") == "found", F.col("best.target")).alias("target"), (F.col("best.verdict") == "platform").alias("platform"))
    return calls.join(shuffled(best), ["project", "caller_file", "_site"], "left").withColumn("platform", F.coalesce("platform", F.lit(False))).drop("_site")


def _step(state: DataFrame, table: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every chain that is going takes its next step."""
    going = (F.col("verdict") == "going") & (F.col("at") < F.size("steps"))
    step = F.when(going, F.element_at("steps", F.col("at") + 1))
    name, given = F.substring_index(step, "/", 1), F.when(step.contains("/"), F.substring_index(step, "/", -1).cast("int")).otherwise(F.lit(-1))
    now = state.withColumns({"_step": step, "name": name, "_given": given, "_class": F.when(going & ~begins(F.col("kind"), PLATFORM), raw(F.col("kind")))})
    now = now.join(shuffled(table), ["project", "_class", "name"], "left").join(shuffled(bounds), ["project", "_class"], "left")
    fit = F.expr("filter(overloads, o -> _given between o.least and o.most)[0]")
    now = now.withColumn("_fit", fit)
    element = (F.col("_step") == "[]") & F.col("kind").endswith("[]")
    last = F.col("at") + 1 >= F.size("steps")
    platform = begins(F.col("kind"), PLATFORM) & (F.col("_step") != "[]") | F.col("kind").endswith("[]") & (F.col("_step") != "[]")
    # A project's class that hasn't it: of the platform, if all that isn't the project's above it is.
    platform = platform | F.col("_fit").isNull() & (F.coalesce("only_platform", F.lit(False)) | F.col("params").isNotNull() & F.col("only_platform").isNull() & F.col("_step").isin(*OF_OBJECTS))
    found = F.col("_fit").isNotNull()
    after = {
        "verdict": F.when(~going, F.col("verdict")).when(element, F.when(last, "open").otherwise("going")).when(found, F.when(last, "found").otherwise("going")).when(platform, "platform").otherwise("open"),
        "target": F.when(going & found & last, F.concat_ws(".", "_fit.declaring", "name")).otherwise(F.col("target")),
        "taken": F.col("taken") + F.when(going & (found | element), 1).otherwise(0),
        "at": F.col("at") + F.when(going & (found | element), 1).otherwise(0),
        "kind": F.when(~going, F.col("kind")).when(element, F.expr("substring(kind, 1, length(kind) - 2)")).when(found, _substituted("_fit.kind", "params", "kind")).otherwise(F.col("kind")),
    }
    return now.withColumns(after).select(*state.columns)
