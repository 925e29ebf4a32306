"""Queries over whole tables that DuckDB would be too slow for, against brute force."""

from quarry.plans import registry


def _lines(spark, tmp_path):
    rows = [(1, 3, 2), (50, 3, 5), (500, 25, 8), (900, 2, 3), (901, 11, 12), (901, 11, 13)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return rows


def _depths(edges):
    out = {}
    for root in {a for a, _ in edges}:
        depth, now = {root: 0}, [root]
        for node in now:
            for a, b in sorted(edges):
                if a == node and b not in depth:
                    depth[b] = depth[node] + 1
                    now.append(b)
        out |= {(root, n): k for n, k in depth.items()}
    return out


def test_walks_cover_all_edges(spark, tmp_path):
    edges = {(s, s % 7 + p % 9) for _, s, p in _lines(spark, tmp_path)}
    depths = _depths(edges)
    rows = lambda name: {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("closure") == set(depths)
    assert rows("revisits") == {(r, a, b) for (r, a) in depths for x, b in edges if x == a and depths[r, b] <= depths[r, a]}
    assert rows("hop_bfs_1") == {(r, n, k) for (r, n), k in depths.items() if k <= 1}


def test_components_cover_all_edges(spark, tmp_path):
    edges = [(f"p{p}", f"s{s}") for _, s, p in _lines(spark, tmp_path)]
    least = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {tuple(r) for r in registry.QUERIES["scope_components"](spark, str(tmp_path)).select("id", "component").collect()}
    assert got == set(least.items())
