"""Graph patterns over triples: basic patterns, optional and negated ones, closure, neighbourhoods, construction."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.triples import COLUMNS


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in the folder that the session names; a temporary one only in a local session."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        if not named:
            named = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return df.checkpoint()


#: Bytes of files, counted as often as they are read, for each task that works on what is made of them.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to tasks by keys, more of them the larger its files, so that what a task holds does not grow with the tables."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in (leaves.apply(k) for k in range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    tasks = sum(int(str(x.stats().sizeInBytes())) for x in files) // DEALT_BYTES
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def pattern(t: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Solutions of one triple pattern; terms that start with ? are variables and become columns."""
    found: dict[str, str] = {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            t = t.where(F.col(place) == term)
        elif term[1:] in found:
            t = t.where(F.col(place) == F.col(found[term[1:]]))
        else:
            found[term[1:]] = place
    return t.select(*[F.col(place).alias(name) for name, place in found.items()])


def bgp(t: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Solutions of all patterns; each must share a variable with those before it, so nothing is a cross join."""
    out = None
    for one in patterns:
        own = pattern(t, *one)
        if out is None:
            out = own
            continue
        shared = [c for c in own.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{one} shares no variable with the patterns before it")
        out = out.join(own, shared)
    return out


def optional(left: DataFrame, right: DataFrame, maybe: tuple[str, ...] = ()) -> DataFrame:
    """Left join on shared variables; those in maybe may be unbound on the left and are then taken from the right."""
    shared = [c for c in right.columns if c in left.columns and c not in maybe]
    held = [c for c in right.columns if c in left.columns and c in maybe]
    own = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = F.lit(True)
    for c in shared:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    for c in held:
        on = on & (F.col(c).isNull() | (F.col(c) == F.col(f"_r_{c}")))
    new = [F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns]
    old = [F.coalesce(c, f"_r_{c}").alias(c) if c in held else F.col(c) for c in left.columns]
    return left.join(own, on, "left").select(*old, *new)


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns], "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns], "left_anti")


def ask(df: DataFrame, name: str = "answer") -> DataFrame:
    """One row: whether df has any row."""
    return df.limit(1).agg((F.count("*") > 0).alias(name))


def construct(solutions: DataFrame, *templates: tuple[Column, str, Column, str]) -> DataFrame:
    """The set of triples that the templates (subject, property, object, kind of object) make of solutions."""
    rows = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")) for s, p, o, kind in templates])
    return solutions.select(F.explode(rows).alias("t")).select("t.*").where("s IS NOT NULL AND o IS NOT NULL").distinct()


def merged(*graphs: DataFrame) -> DataFrame:
    """Set union of graphs."""
    out = graphs[0].select(COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(COLUMNS))
    return out.distinct()


def without(t: DataFrame, gone: DataFrame) -> DataFrame:
    """t without the triples of gone."""
    return t.join(gone.select(COLUMNS), COLUMNS, "left_anti")


def path_plus(edges: DataFrame) -> DataFrame:
    """(a, b): b is reached from a by one or more edges.

    Semi-naive, by doubling: only pairs that the last round found are extended, by all that are known, so known pairs are
    never joined with known ones again, and paths still double in length each round. It ends when no pair is new.
    """
    known = cut(edges.select("a", "b").distinct())
    fresh = known
    while not fresh.isEmpty():
        on = fresh.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        back = known.select("a", F.col("b").alias("m")).join(fresh.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        fresh = cut(on.union(back).distinct().join(known, ["a", "b"], "left_anti"))
        known = cut(known.union(fresh))
    return known


def neighbourhood(t: DataFrame, start: DataFrame, properties: list[str], hops: int = 2) -> DataFrame:
    """(root, s, p, o, hop): edges by the given properties out of start (column `root`), hop by hop."""
    edges = t.where(F.col("p").isin(properties) & (F.col("o_kind") == "iri")).select("s", "p", "o")
    at, out = start.select("root", F.col("root").alias("s")), None
    for hop in range(1, hops + 1):
        step = at.join(edges, "s").select("root", "s", "p", "o", F.lit(hop).alias("hop"))
        out = step if out is None else out.union(step)
        at = step.select("root", F.col("o").alias("s")).distinct()
    return out.groupBy("root", "s", "p", "o").agg(F.min("hop").alias("hop"))
