"""Posting lists are read in blocks: a query has k rows for a block, and what a product of matrices leaves open is measured."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tracelake.llm import neighbours


@pytest.mark.parametrize("scale", [1.0, 1e8, 1e160])
def test_within_a_block_as_by_loops(scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)) + scale * (scale > 1)  # far from nought: little is left of a product's digits
    x[400:] = x[:100]  # equal distances, and ids with two rows
    ids = np.concatenate([np.arange(450), np.arange(50)])
    lst = rng.integers(0, 6, 500)
    q, qid = np.concatenate([x[:40], x[:40] + 0.01]), np.arange(80)
    wanted = rng.random((80, 6)) < 0.5
    got: dict[int, list] = {}
    for i, v, d in zip(*neighbours.within(x, ids, lst, q, qid, wanted, 10), strict=True):
        got.setdefault(int(i), []).append((float(d), int(v)))
    for i in range(80):
        best: dict[int, float] = {}
        for r in range(500):
            d = float(np.sqrt(((x[r] - q[i]) ** 2).sum()))
            if wanted[i, lst[r]] and ids[r] != i and d < best.get(int(ids[r]), np.inf):
                best[int(ids[r])] = d
        assert got.get(i, []) == sorted((d, v) for v, d in best.items())[:10]


def test_few_rows_for_a_query(spark, monkeypatch):
    """Rows that the lists give for a query: k for each block, and not for each list."""
    made, joined = [], PandasCogroupedOps.applyInPandas

    def counted(*args):
        out = joined(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", counted)
    v = np.random.default_rng(1).normal(size=(3000, 8))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in neighbours.nearest(d, a_list=50).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, 3000, 100))
    assert made == [300]
    true = {i: set(np.argsort(((v - v[i]) ** 2).sum(1), kind="stable")[1:11].tolist()) for i in got}
    assert sum(len(true[i] & set(x)) for i, x in got.items()) >= 0.9 * 300
