import hashlib
import random

from stocklens.operators import graph


def simple_paths(edges, path):
    yield path
    for a, b in edges:
        if a == path[-1] and b not in path:
            yield from simple_paths(edges, [*path, b])


def test_chains_of_any_length(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "n4"), ("n8", "n2"), ("n9", "n0"), ("x", "y"), ("y", "x")]
    nodes = [f"n{i}" for i in range(10)] + ["x", "y", "alone"]
    want = {(p[-1], " -> ".join(p)) for p in simple_paths(edges, ["n0"])} | {(n, n) for n in ("x", "y", "alone")}
    roots = spark.createDataFrame([("n0",)], "root string")
    paths = graph.unfold_all(roots, spark.createDataFrame(edges, "parent string, child string"))
    got = graph.chains(spark.createDataFrame([(n,) for n in nodes], "target string"), paths).select("target", graph.chain_text("path").alias("chain")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert max(r.depth for r in paths.where("not cyclic").collect()) == 9


def test_chains_to_targets_touch_ancestors_only(spark):
    """Ten targets in a graph of 20,000 nodes: only their ancestors are gone through."""
    edges = [(f"n{i // 3}", f"n{i}") for i in range(1, 20_000)] + [("n40", "n4")]
    resolved = spark.createDataFrame(edges, "parent string, child string")
    targets = spark.createDataFrame([(f"n{i}",) for i in range(19_000, 19_010)] + [("apart",)], "target string")
    above = {r.node for r in graph.reaching(targets, resolved).collect()}
    want = {"apart"}
    for i in range(19_000, 19_010):
        while i:
            want.add(f"n{i}")
            i //= 3
        want.add("n0")
    assert above >= want and len(above) < 80
    found = {(r.target, graph_text(r.path)) for r in graph.chains_to(targets, spark.createDataFrame([("n0",)], "root string"), resolved).collect()}
    assert ("apart", "apart") in found and {t for t, _ in found} == {f"n{i}" for i in range(19_000, 19_010)} | {"apart"}
    assert all(path == "apart" or path.startswith("n0 -> ") for _, path in found)


def graph_text(path):
    return " -> ".join(path)


def test_paths_are_made_of_parts_that_are_not_multiplied(spark):
    """300 parents of a gate above 300 leaves, and a cycle back to it: 90,000 chains, of which only some hundred parts are written."""
    edges = [("r", f"a{i}") for i in range(300)] + [(f"a{i}", "g") for i in range(300)] + [("g", f"b{i}") for i in range(300)] + [("b7", "g"), ("b8", "a0")]
    resolved, roots = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("r",)], "root string")
    want = {(f"b{j}", f"r -> a{i} -> g -> b{j}") for i in range(300) for j in range(300)} | {("g", f"r -> a{i} -> g") for i in range(300)} | {(f"a{i}", f"r -> a{i}") for i in range(300)}
    # From b8 back to a0, unless the path came from there.
    want |= {("a0", f"r -> a{i} -> g -> b8 -> a0") for i in range(1, 300)}
    heads, tails, back = graph.parts_of_paths(roots, resolved)
    assert heads.count() < 1000 and tails.count() < 1000 and back.count() < 1000
    targets = spark.createDataFrame([(f"{x}{i}",) for x in "ab" for i in range(300)] + [("g",)], "target string")
    for text in (True, False):
        got = graph.all_chains(targets, roots, resolved, text).collect()
        assert len(got) == len(want) and {(r.target, r.path if text else graph_text(r.path)) for r in got} == want


def test_all_paths_and_cycles_as_plain_code_finds_them(spark, monkeypatch):
    """Dense random graphs, roots on cycles and below each other; cells of three rows give what large ones do."""
    rng = random.Random(5)
    monkeypatch.setattr(graph, "CELL", 3)
    for _ in range(3):
        edges = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(15)})
        want = sorted((p[0], p[-1], " ".join(p), cyclic) for r in ("n0", "n1", "n5") for p, cyclic in simple_and_cyclic(edges, [r]))
        got = graph.unfold_all(spark.createDataFrame([("n0",), ("n1",), ("n5",)], "root string"), spark.createDataFrame(edges, "parent string, child string"))
        rows = got.collect()
        assert sorted((r.root, r.node, " ".join(r.path), r.cyclic) for r in rows) == want and all(r.depth == len(r.path) - 1 for r in rows)


def simple_and_cyclic(edges, path):
    yield path, False
    for a, b in edges:
        if a == path[-1] and b in path:
            yield [*path, b], True
        elif a == path[-1]:
            yield from simple_and_cyclic(edges, [*path, b])


def test_rows_that_are_alike_are_written_close_together(spark, tmp_path):
    """1,000 long names before 200 leaves: what comes back within Snappy's blocks of 64 KB is hardly written again."""
    edges = [("r", hashlib.sha512(f"{i}".encode()).hexdigest()) for i in range(1000)]
    edges += [(a, "g") for _, a in edges] + [("g", f"b{i}") for i in range(200)]
    targets = spark.createDataFrame([(f"b{i}",) for i in range(200)], "target string")
    resolved, roots = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("r",)], "root string")
    graph.all_chains(targets, roots, resolved, text=True).write.parquet(str(tmp_path / "chains"))
    rows = spark.read.parquet(str(tmp_path / "chains"))
    assert rows.count() == rows.distinct().count() == 200_000
    assert sum(f.stat().st_size for f in (tmp_path / "chains").glob("*.parquet")) < 30 * 200_000


def test_product_gives_what_a_join_gives(spark, monkeypatch):
    """Keys without rows on one side, one with most rows, nulls and repeated rows, over many ranges, cells and packs."""
    monkeypatch.setattr(graph, "CELL", 4)
    rng = random.Random(7)
    rows = lambda n: [(rng.choice("aaaaabcd"), rng.choice([None, "v", "w" * rng.randrange(9)]), i % 90) for i in range(n)]
    left = spark.createDataFrame([*rows(200), ("left", "v", 1), (None, "v", 1)], "k string, x string, m long")
    right = spark.createDataFrame([*rows(150), ("right", "v", 1), (None, "v", 1)], "k string, y string, n long")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, graph.product(left, right, "k").select("k", "x", "m", "y", "n").collect())) == sorted(map(key, left.join(right, "k").collect()))
