import math

import numpy as np

from searchloom.llm import embedding_dedup as ed
from searchloom.llm.queries import op1_embeddings

from .helpers import roots


def brute(rows):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, links, count = len(rows), [], [0] * len(rows)
    for a in range(n):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    root = roots(n, links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, count[k], least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows))


def test_recall_and_precision_on_whole_tables(spark):
    for sf in ("sf0.001", "sf0.1"):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
        x = np.array([r.embedding for r in e], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        link = x @ x.T >= 0.95
        np.fill_diagonal(link, False)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op1_embeddings(spark, f"/root/testdata/{sf}").collect()}
        root = roots(len(e), [(int(i), int(j)) for i, j in zip(*np.nonzero(link), strict=True)])
        assert got == {r.vec_id: (int(link[k].sum()), e[root[k]].vec_id, root[k] == k) for k, r in enumerate(e)}


def test_small_groups_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        c = np.random.default_rng(i % 40).normal(size=8)
        rows.append((i, [float(v) for v in c + rng.normal(size=8) * 0.35]))
    monkeypatch.setattr(ed, "BLOCK", 16)  # one hot cell: many pairs of blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = sorted(tuple(r) for r in ed.groups(df).collect())
    assert got == want


def test_no_link_is_missed_on_low_rank_vectors_in_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cos = rng.uniform(0.9501, 0.96, size=(len(x), 1))
    e = np.concatenate((x, cos * x + np.sqrt(1 - cos * cos) * y)) @ np.linalg.qr(rng.normal(size=(256, 12)))[0].T
    monkeypatch.setattr(ed, "CELL_SIZE", 16)
    monkeypatch.setattr(ed, "BLOCK", 64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(e.tolist())], "vec_id long, embedding array<double>")
    link = e @ e.T >= 0.95
    np.fill_diagonal(link, False)
    assert {r.vec_id: r.n_links for r in ed.groups(df).collect()} == dict(enumerate(link.sum(axis=1).tolist()))


def test_tables_hold_a_vector_once_however_many_cells_it_visits(spark, monkeypatch):
    from pyspark.sql import functions as F
    from searchloom.llm.common import Scratch

    held, write = [], Scratch.write

    def counted(self, df, **options):
        out = write(self, df, **options)
        if "rows" in out.columns:
            held.append(out.agg(F.sum(F.size("rows"))).first()[0])
        return out

    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))
    e = base[np.arange(300) % 60] + rng.normal(size=(300, 24)) * 0.2
    monkeypatch.setattr(Scratch, "write", counted)
    for name, value in (("CELL_SIZE", 16), ("BLOCK", 8), ("TILE_BYTES", 24 * 8 * 20), ("MERGE", 3)):
        monkeypatch.setattr(ed, name, value, raising=False)
    rows = [(i, v) for i, v in enumerate(e.tolist())]
    got = sorted(tuple(r) for r in ed.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows) and held == [300]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [-1.0, 0.001])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, u long, component_id int")
    assert sorted(tuple(r) for r in ed.groups(df).collect()) == brute(rows)
    assert ed.groups(df.limit(0)).count() == 0 and ed.groups(df.where("vec_id < 3")).count() == 2
