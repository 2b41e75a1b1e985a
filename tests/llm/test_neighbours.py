import numpy as np
import pytest
from helpers import SF

from sedimenta.llm import neighbours as N


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")


def exact(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return s, {i: np.argsort(-s[i], kind="stable")[:k].tolist() for i in range(len(x))}


@pytest.mark.parametrize("least", [None, 0.9])
def test_every_member_of_a_class_has_a_list(spark, least):
    x = np.ones((30, 8), np.float32)
    got = N.search(table(spark, x), "id", "embedding", 5, 8, least=least).toPandas()
    _, want = exact(x, 5)
    assert {q: g.sort_values("rank").x.tolist() for q, g in got.groupby("q")} == want


def test_classes_among_other_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:120] = x[50]
    x[200:203] = x[200]
    got = N.search(table(spark, x), "id", "embedding", 5, 8, recall=1.0).toPandas()
    _, want = exact(x, 5)
    lists = {q: g.sort_values("rank").x.tolist() for q, g in got.groupby("q")}
    assert len(lists) == 300 and all(lists[q] == want[q] for q in range(50, 120))
    assert sum(len(set(lists[q]) & set(want[q])) for q in want) >= 0.99 * 1500


def test_ties_go_to_the_smaller_id_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    x = np.zeros((200, 8), np.float32)
    x[:, 0] = 1
    x[np.arange(1, 200), 1 + np.arange(199) % 7] = 0.5  # seven directions at the same angle to row 0
    got = N.search(table(spark, x), "id", "embedding", 9, 8, queries=table(spark, x).where("id = 0")).toPandas()
    assert got.sort_values("rank").x.tolist() == list(range(1, 10)) and got.cosine.nunique() == 1


def test_two_levels_where_the_sample_is_small(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 40)
    monkeypatch.setattr(N, "SUB_SAMPLE", 300)
    monkeypatch.setattr(N, "GROUP_ROWS", 500)
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 8))).astype(np.float32)
    x[1000:2000] = x[1000] + 0.01 * rng.standard_normal((1000, 8))  # one leaf that holds a quarter
    df = table(spark, x)
    lists = N.search(df, "id", "embedding", 5, 8, sample_rows=120)
    assert "CoGroup" in lists._jdf.queryExecution().toString()
    some = df.where("id % 20 = 0")
    row = N.recall_of(lists, N.brute_force(df, "id", "embedding", some, 5, 8, block=64)).first()
    assert row.n_queries == 200 and row.recall >= 0.9
    assert lists.groupBy("q").count().where("count = 5").count() >= 3900


def test_brute_force_and_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 8)).astype(np.float32)
    df = table(spark, x)
    got = N.brute_force(df, "id", "embedding", df.where("id < 10"), 5, 8, block=4).toPandas()
    _, want = exact(x, 5)
    assert {q: g.sort_values("rank").x.tolist() for q, g in got.groupby("q")} == {q: want[q] for q in range(10)}
    none = N.recall_of(N.brute_force(df, "id", "embedding", df.limit(0), 5, 8), N.brute_force(df, "id", "embedding", df.limit(0), 5, 8)).first()
    assert (none.n_queries, none.recall) == (0, None)


@pytest.mark.parametrize("sample_rows", [30, 2000])
def test_exact_lists_whatever_the_sample(spark, monkeypatch, sample_rows):
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    x[100:130] = x[100]
    x[130:160] = x[130] * rng.integers(1, 5, (30, 1))  # one direction at several lengths
    df = table(spark, x)
    _, want = exact(x, 5)
    for queries in (None, df.where("id % 10 = 0")):
        got = N.search(df, "id", "embedding", 5, 8, queries=queries, recall=1.0, sample_rows=sample_rows).toPandas()
        lists = {q: g.sort_values("rank").x.tolist() for q, g in got.groupby("q")}
        assert lists == {q: want[q] for q in want if queries is None or q % 10 == 0}


@pytest.mark.parametrize("sample_rows", [30, 2000])
def test_exact_mutual_pairs_in_groups_on_borders(spark, monkeypatch, sample_rows):
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((60, 8))
    x = (centres[rng.integers(0, 60, 1500)] + 0.25 * rng.standard_normal((1500, 8))).astype(np.float32)
    x[400:600] = x[400] + 0.02 * rng.standard_normal((200, 8))  # a group in which nearly all pairs count
    df = table(spark, x)
    s, want = exact(x, 5)
    top = {i: {j for j in want[i] if s[i, j] >= 0.95} for i in want}
    near = N.search(df, "id", "embedding", 5, 8, least=0.95, recall=1.0, sample_rows=sample_rows).toPandas()
    assert {q: set(g.x) for q, g in near.groupby("q")} == {q: t for q, t in top.items() if t}
    monkeypatch.setattr(N, "SAMPLE_ROWS", sample_rows)
    monkeypatch.setattr(N, "DIM", 8)
    monkeypatch.setattr(N.search, "__defaults__", (5, 8, *N.search.__defaults__[2:]))
    got = {(r.id_a, r.id_b) for r in N.mutual_pairs(df, "id", "embedding").collect()}
    assert got == {(i, j) for i in top for j in top[i] if i < j and i in top[j]}


def test_recall_is_of_all_lists(spark, monkeypatch):
    search = N.search
    # lists of three in four queries are lost, those of ids divisible by 200 stand
    monkeypatch.setattr(N, "search", lambda *a, **k: search(*a, **k).where("q % 200 = 0"))
    monkeypatch.setattr(N, "TABLES", {"documents": "doc_id"})
    assert [r.enough for r in N.p5_recall(spark, SF).collect()] == [False]
