"""Links of vectors against a full comparison."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quern.llm import embedding_dedup as ed


def full(rows, least=0.93):
    out = {}
    sound = []
    for k, (_, v, label) in enumerate(rows):
        ok = v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        sound.append(ok)
    n = len(rows)
    links, label = [0] * n, [rows[k][0] for k in range(n)]
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if sound[i] and sound[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    for k in range(n):
        out[rows[k][0]] = (links[k], label[k], label[k] == rows[k][0])
    return out


def made(n=300, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.1, 1.0])
        rows.append((i, c.astype(np.float32).tolist(), int(rng.integers(3))))
    nan = [float("nan")] * dim
    return rows + [(1000, None, 1), (1001, [], 1), (1002, [0.0] * dim, 1), (1003, nan, 1), (1004, [None] * dim, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 0), (1007, [float("inf")] * dim, 0), (1008, [1e30] * dim, 0), (1009, [2e30] * dim, 0)]


@pytest.mark.parametrize("block", [4096, 5])
def test_links_and_components(spark, block):
    rows = made()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, class_id string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.near_vectors(df, block=block).collect()}
    assert got == full(rows)


def test_copies_are_one_class(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, v, 1) for i in range(50)] + [(7, v, 1), (None, v, 1)], "vec_id long, embedding array<float>, label int")
    got = ed.near_vectors(df).collect()
    assert {r["n_links"] for r in got} == {51} and {r["component_id"] for r in got} == {0}


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_vectors(df).collect() == []


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.931
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ed.near_vectors(df).where("n_links > 0").count()
    assert got >= 0.99 * len(rows)


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    df = ed.op3_embedding_dedup(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ed.SQL})").fetchall())
