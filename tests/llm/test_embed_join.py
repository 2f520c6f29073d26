import math

import numpy as np

from tabeval.llm import embed_join
from tabeval.llm.queries import op9_embed_join

SCHEMA = "vec_id long, embedding array<float>, label int, node string, component_id string"


def brute(rows):
    ok = [a for a, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {a: np.array(rows[a][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[a][1], np.float32).astype(float)) for a in ok}
    links = {a: [b for b in ok if b != a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93] for a in ok}
    out = []
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        keys = [rows[b][0] for b in seen if rows[b][0] is not None]
        top = min(keys) if keys else None
        out.append((r[0], len(links.get(a, ())), top, r[0] is not None and r[0] == top))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def clusters(seed, dims, groups, size, spread):
    pick = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = pick.normal(size=dims)
        for _ in range(size):
            v = base + pick.normal(size=dims) * spread * np.linalg.norm(base) / math.sqrt(dims)
            rows.append((len(rows), [float(x) for x in np.float32(v)], int(pick.integers(2))))
    return rows


def test_all_links(spark):
    rows = clusters(1, 24, 12, 12, 0.25) + [(1000 + r[0], r[1], r[2]) for r in clusters(2, 5, 10, 10, 0.3)]
    assert got(embed_join.join(frame(spark, rows))) == brute(rows)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(embed_join, "CELL_ROWS", 8)
    rows = clusters(3, 16, 2, 40, 0.2)
    assert got(embed_join.join(frame(spark, rows))) == brute(rows)


def test_spanning_links_join_the_same_nodes():
    from tabeval.llm import graph
    pick = np.random.default_rng(9)
    for n in (1, 5, 60):
        a, b = pick.integers(0, 10 * n, (2, 8 * n))
        whole, few = graph.Forest(), graph.Forest()
        for x, y in zip(a.tolist(), b.tolist()):
            whole.link(np.array([x]), np.array([y]))
        few.link(a, b)
        assert len(graph.spanning(a, b)[0]) < len(set(a) | set(b))
        assert dict(zip(*map(list, whole.star()))) == dict(zip(*map(list, few.star())))


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1),
            (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [], 1),
            (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [3e38, 3e38, 3e38], 1), (14, [1e-38, 1e-38, 1e-38], 1), (None, None, None)]
    assert got(embed_join.join(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert embed_join.join(frame(spark, [(1, [1.0], 1)]).where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op9_embed_join(spark, sf)) == brute(rows)
