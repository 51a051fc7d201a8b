"""Dependency graph: edge resolution, root correction, chains and tree unfolding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import new_folder, stored

MAX_DEPTH = 5  # of the tree that is printed; chains have no limit
ARROW = " -> "


def node_ids(components: DataFrame) -> DataFrame:
    """components with id (name@version)."""
    return components.withColumn("id", F.concat_ws("@", "name", "version"))


def resolve_edges(components: DataFrame, edges: DataFrame, within=()) -> DataFrame:
    """(parent, child, ord) node ids. A child name stands for the last row of that name by (ordinal, version); unknown names and parents drop out, repeated children too.

    Columns in within, as ("project",), keep graphs apart and lead the result.
    """
    nodes = node_ids(components)
    names = nodes.groupBy(*within, F.col("name").alias("child_name")).agg(F.max_by("id", F.struct("ordinal", "version")).alias("child"))
    parents = nodes.select(*within, F.col("id").alias("parent_id")).distinct()
    found = edges.join(names, [*within, "child_name"]).join(parents, [*within, "parent_id"], "left_semi")
    return found.groupBy(*within, F.col("parent_id").alias("parent"), "child").agg(F.min("ord").alias("ord"))


def unresolved_edges(components: DataFrame, edges: DataFrame, within=()) -> DataFrame:
    """Edges whose child is no component's name."""
    return edges.join(components.select(*within, F.col("name").alias("child_name")), [*within, "child_name"], "left_anti")


def correct_roots(components: DataFrame, resolved: DataFrame, within=()) -> DataFrame:
    """components with is_direct_graph: no parent in the graph; is_direct itself where there are no edges at all."""
    nodes = node_ids(components)
    children = resolved.select(*within, F.col("child").alias("id")).distinct().withColumn("_has", F.lit(True))
    joined = nodes.join(children, [*within, "id"], "left")
    if within:
        joined = joined.join(resolved.select(*within).distinct().withColumn("_any", F.lit(True)), list(within), "left")
    else:
        joined = joined.join(F.broadcast(resolved.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))))
    return joined.withColumn("is_direct_graph", F.when(F.col("_any"), F.col("_has").isNull()).otherwise(F.col("is_direct"))).drop("_has", "_any")


def unfold(roots: DataFrame, resolved: DataFrame, depth: int = MAX_DEPTH, within=()) -> DataFrame:
    """(root, node, depth, path, cyclic) for every simple path from roots (root) of at most depth edges; a node that closes a cycle is listed once and not gone into.

    One join per level, each of which is stored, so that no level is made again for those below it. Paths multiply as the graph does, so
    depth bounds the work.
    """
    level = roots.select(*within, "root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit(False).alias("cyclic"))
    below = stored(resolved.select(*within, F.col("parent").alias("node"), "child")) if depth else None
    out = level
    for d in range(1, depth + 1):
        step = level.where("not cyclic").join(below, [*within, "node"])
        level = stored(step.select(*within, "root", F.col("child").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.array_contains("path", F.col("child")).alias("cyclic")))
        out = out.unionByName(level)
    return out


def until_empty(level: DataFrame, step) -> DataFrame:
    """Rows of level, of step(level, 1), step(of that, 2) and so on until one has none; each level is written out, to be read by the next."""
    spark, path, d, schema = level.sparkSession, new_folder(level.sparkSession), 0, level.schema
    while True:
        level.write.parquet(f"{path}/level={d}")
        level = spark.read.schema(schema).parquet(f"{path}/level={d}")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(path)
        d += 1
        level = step(level, d)


def parts_of_paths(roots: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Simple paths of any length from the roots, in parts: heads (root, gate, route, path), tails (gate, node, path), back (route, gate, path, child).

    Gates are the roots and the nodes with several parents. Every other node has one parent, so that below each gate hangs a tree, and trees have no
    node in common: a path is simple if it meets no gate twice. A head is a simple path from a root up to, but without, a gate; route has the
    gates that it goes through, that one last. A tail leads from a gate to a node of its tree. Each head before each tail of its gate is a
    simple path, and there are no others; heads and tails are written, their product is not. What is behind a head of a route through back's
    path ends at a gate of that route, child: a cycle.
    """
    edges = stored(resolved.select("parent", "child"))
    many = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("child").alias("gate"))
    gates = stored(roots.select(F.col("root").alias("gate")).union(many).distinct())
    inner = stored(edges.join(gates, edges["child"] == gates["gate"], "left_anti"))
    first = gates.select("gate", F.col("gate").alias("node"), F.array("gate").alias("path"))
    below = lambda level, _: level.join(inner, level["node"] == inner["parent"]).select("gate", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
    tails = until_empty(first, below)
    entries = edges.join(gates.select(F.col("gate").alias("child")), "child")
    exits = stored(tails.join(entries, tails["node"] == entries["parent"]).select("gate", "path", "child"))
    pairs = stored(exits.select("gate", "child").distinct())
    # Cycles are told by routes, of which there are few, not by the paths along them.
    routed = lambda rows: rows.select("route", "gate").distinct().join(pairs, "gate")
    seen = F.array_contains("route", F.col("child"))

    def onward(level: DataFrame, _: int) -> DataFrame:
        led = level.join(routed(level).where(~seen), ["route", "gate"]).join(exits.withColumnRenamed("path", "more"), ["gate", "child"])
        return led.select("root", F.col("child").alias("gate"), F.concat("route", F.array("child")).alias("route"), F.concat("path", "more").alias("path"))

    begun = roots.select("root", F.col("root").alias("gate"), F.array("root").alias("route"), F.array().cast("array<string>").alias("path"))
    heads = until_empty(begun, onward)
    return heads, tails, routed(heads).where(seen).join(exits, ["gate", "child"])


#: Rows of a cell of a product: of each side as many, so that a cell has four million pairs.
CELL = 2000
MAX_TASKS = 10_000
#: Rows of the left and of the right side that take turns. Snappy, in which results are written, leaves out what comes back within 64 KB, some hundred rows.
TURNS = (125, 8)


def packed(rows: DataFrame, keys, turn: int, cell: str, pack: str) -> DataFrame:
    """(keys, cell, pack): rows in arrays of turn neighbours by length, then by value, so that they begin alike; a cell has CELL neighbours.

    The order is that of ranges, each sorted by itself: cells and packs end where a range or a key does.
    """
    values = [c for c in rows.columns if c not in keys]
    order = [*keys, F.length(F.col(values[0]).cast("string")), *values]
    ranged = rows.repartitionByRange(rows.count() // (16 * CELL) + 1, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    within = [F.floor(F.col("_at") / size).alias(c) for size, c in ((CELL, cell), (turn, "_n"))]
    return stored(ranged.groupBy(*keys, *within).agg(F.sort_array(F.collect_list(F.struct("_at", *values))).alias(pack)).drop("_n"))


def product(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left and right joined on keys, where a key may have any number of rows on both sides: those of a key are dealt over cells of about CELL by CELL rows.

    A row is sent once for each CELL rows of the other side, so the shuffle has a thousandth of the pairs, and no task has more than some cells.
    What is joined are packs of rows; of two packs, each left row meets all right ones before the next. Rows that are alike thus come close
    together, and the result, whoever writes it, takes a fraction of the disk that it takes in the order of a plain join.
    """
    one, other = packed(left, keys, TURNS[0], "_i", "_l"), packed(right, keys, TURNS[1], "_j", "_r")
    cells = stored(one.select(*keys, "_i").distinct().join(other.select(*keys, "_j").distinct(), list(keys)))
    n, at = max(min(cells.count(), MAX_TASKS), 8), [*keys, "_i", "_j"]
    dealt, met = (rows.join(cells, [*keys, own]).repartition(n, *at) for rows, own in ((one, "_i"), (other, "_j")))
    pairs = dealt.join(met.hint("merge"), at).select(*keys, F.inline("_l"), "_r").drop("_at")
    return pairs.select(*left.columns, F.inline("_r")).drop("_at")


def unfold_all(roots: DataFrame, resolved: DataFrame) -> DataFrame:
    """What unfold() gives, for simple paths of any length, made of their parts as they are read.

    Simple paths end by themselves, but there may be exponentially many; every one is a row.
    """
    heads, tails, back = parts_of_paths(roots, resolved)
    whole = product(heads.select("root", "gate", F.col("path").alias("head")), tails, "gate").select("root", "node", F.concat("head", "path").alias("path"), F.lit(False).alias("cyclic"))
    ends = back.select("route", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
    cycles = product(heads.select("root", "route", F.col("path").alias("head")), ends, "route").select("root", "node", F.concat("head", "path").alias("path"), F.lit(True).alias("cyclic"))
    return whole.unionByName(cycles).select("root", "node", (F.size("path") - 1).alias("depth"), "path", "cyclic")


def reaching(targets: DataFrame, resolved: DataFrame) -> DataFrame:
    """(node) of the targets and of every node that a target can be reached from: parents are joined level by level until no new one is found, so that the work is that of the targets' ancestors."""
    up = stored(resolved.select("parent", "child"))
    level = stored(targets.select(F.col("target").alias("node")).distinct())
    known = level
    while not level.isEmpty():
        above = level.join(up, level["node"] == up["child"]).select(F.col("parent").alias("node")).distinct()
        level = stored(above.join(known, "node", "left_anti"))
        known = known.unionByName(level)
    return known


def all_chains(targets: DataFrame, roots: DataFrame, resolved: DataFrame, text: bool = False) -> DataFrame:
    """chains() over all simple paths, which are never written: each target meets the heads of its gate. With text, path is chain_text() of it, of texts made once for each part."""
    heads, tails, _ = parts_of_paths(roots, resolved)
    shown = chain_text if text else F.col
    heads = heads.select("gate", (F.when(F.size("path") > 0, shown("path")) if text else F.col("path")).alias("head"))
    ends = stored(targets.select("target").join(tails.select(F.col("node").alias("target"), "gate", shown("path").alias("tail")).join(heads.select("gate").distinct(), "gate", "left_semi"), "target", "left"))
    found = product(ends.where("gate is not null").select("gate", "tail", "target"), heads, "gate").select("target", (F.concat_ws(ARROW, "head", "tail") if text else F.concat("head", "tail")).alias("path"))
    return found.unionByName(ends.where("gate is null").select("target", (F.col("target") if text else F.array("target")).alias("path")))


def chains_to(targets: DataFrame, roots: DataFrame, resolved: DataFrame, text: bool = False) -> DataFrame:
    """all_chains() of the targets asked for, over their ancestors only: no path is begun or continued that can't end in a target."""
    near = stored(reaching(targets, resolved))
    inside = lambda rows, column: rows.join(near.select(F.col("node").alias(column)), column, "left_semi")
    return all_chains(targets, inside(roots, "root"), inside(inside(resolved.select("parent", "child"), "parent"), "child"), text)


def tree_lines(unfolded: DataFrame, resolved: DataFrame, depth: int = MAX_DEPTH, within=()) -> DataFrame:
    """Indented lines of the tree with the path that orders them; a node cut off by depth tells how many children it has."""
    below = resolved.groupBy(*within, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    mark = F.when(F.col("cyclic"), " (cycle)").when((F.col("depth") == depth) & (F.col("children") > 0), F.concat(F.lit(" ("), F.col("children").cast("string"), F.lit(" more)"))).otherwise("")
    return unfolded.join(below, [*within, "node"], "left").select(*within, "root", "path", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "node", mark).alias("line"))


def chains(targets: DataFrame, unfolded: DataFrame) -> DataFrame:
    """All chains root -> ... -> target among the paths unfolded, best of unfold_all(); a target that none of them reaches is a chain of its own."""
    found = unfolded.where("not cyclic").select(F.col("node").alias("target"), "path")
    return targets.join(found, "target", "left").select("target", F.coalesce("path", F.array("target")).alias("path"))


def chain_text(path):
    return F.concat_ws(ARROW, path)


def grouped_list(components: DataFrame) -> DataFrame:
    """Rows with their report group (1 direct, 2 direct dev, 3 transitive) and place: by name, then version and ecosystem."""
    group = F.when(~F.col("is_direct"), 3).when(F.col("is_dev"), 2).otherwise(1)
    return components.select(group.alias("list"), "name", "version", "ecosystem").orderBy("list", "name", "version", "ecosystem")
