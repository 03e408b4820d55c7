"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ferrule.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return ""
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)  # pandas makes floats of integers beside nulls


def rows(df):
    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, db, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b


def test_topk_plan_keeps_no_shuffle(spark, sf):
    plan = QUERIES["knn_cosine"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_mmr_is_the_greedy_choice(spark, sf):
    from ferrule.operators.search import mmr, mmr_order

    docs = [{"a", "b"}, {"a", "b"}, {"c", "d"}, set()]
    assert mmr_order(docs, [0.1, 0.11, 0.2, 0.9], 3, 0.5) == [0, 2, 3]
    assert mmr_order(docs, [5.0, 4.0, 9.0, 9.0], 2, 0.5) == [0, 1]  # all below -1: the first
    rows = spark.createDataFrame([(i, f"aa bb w{i}", i / 1000) for i in range(500)], "item_id int, document string, distance double")
    assert mmr(rows, 400).count() == 400 and mmr(rows, 500).count() == 500 and mmr(rows, 7, lam=1.0).count() == 7
    assert len(QUERIES["mmr_select"](spark, sf).collect()) == 10


def test_knn_batch_blocks(spark):
    from ferrule.operators.search import knn_batch

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)).round(1)
    items = spark.createDataFrame([(f"k{i:03}", [float(v) for v in r]) for i, r in enumerate(x)] + [("n", None), ("s", [1.0]), ("z", [0.0] * 4)], "item_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:30])] + [(99, None)], "query_id int, query array<double>")
    y = x.astype(np.float32).astype(float)
    for metric in ("cosine", "l2", "l1"):
        one, many = (sorted(map(tuple, knn_batch(items, queries, 5, metric, block_bytes=b).collect())) for b in (1 << 20, 100))
        assert [(q, r) for q, _, _, r in sorted(one)] == [(q, r) for q, _, _, r in sorted(many)] and len(one) == 150
        assert sorted(r[2] for r in one) == pytest.approx(sorted(r[2] for r in many), abs=1e-9)
        for q, _, dist, rank in one:
            d = {"cosine": 1 - (y @ x[q]) / (np.linalg.norm(y, axis=1) * np.linalg.norm(x[q])), "l2": np.linalg.norm(y - x[q], axis=1), "l1": np.abs(y - x[q]).sum(1)}[metric]
            zero = {"cosine": [], "l2": [np.linalg.norm(x[q])], "l1": [np.abs(x[q]).sum()]}[metric]
            assert sorted([*d, *zero])[rank - 1] == pytest.approx(dist, abs=1e-6)


def test_plans_scan_little(spark, sf):
    for name, most in (("bm25_topk", 2), ("hybrid_rerank", 4), ("grep_lines", 1), ("knn_batched_topk", 1)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= most, name
        assert "CartesianProduct" not in plan
