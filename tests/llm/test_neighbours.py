import numpy as np
import pytest

from docquery.llm.neighbours import block_neighbours, nearest

SCHEMA = "vec_id long, vector array<float>, label int"


def brute(rows, queries, k):
    points = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, own in points:
        if q in queries:
            near = sorted((float(np.sqrt(np.cumsum((p - own) ** 2)[-1])), i) for i, p in points if i != q and len(p) == len(own))
            out[q] = near[:k]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_odd_vectors_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5], 0) for i in range(20)]
    rows += [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [1.0, None, 2.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [float("inf"), 1.0, 1.0], 0), (105, [], 0), (106, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = {0, 7, 100, 101, 106}
    got = as_lists(nearest(df, df.where(df.vec_id.isin(*queries)), k=10))
    assert got == {q: x for q, x in brute(rows, queries, 10).items() if x}
    assert nearest(df.where("false"), df).count() == nearest(df, df.where("false")).count() == 0


@pytest.mark.parametrize("block", [900, 8192])
def test_recall(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((10, 64))
    data = centres[rng.integers(0, 10, 5000)] + rng.standard_normal((5000, 64))
    data = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = set(range(0, 5000, 100))
    got, true = as_lists(nearest(df, df.where("vec_id % 100 = 0"), block=block)), brute(rows, queries, 10)
    found = [len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in queries]
    assert np.mean(found) / 10 >= 0.9


@pytest.mark.parametrize("jitter", [0.0, 1e-3])
@pytest.mark.parametrize("seed", range(4))
def test_copies_do_not_hide_neighbours(seed, jitter):
    """A third of the rows are copies, or near copies, of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, 64))
    data = centres[rng.integers(0, 10, 2000)] + rng.standard_normal((2000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    copies = data[[7]] + jitter * rng.standard_normal((1000, 64))
    ids, points = rng.permutation(3000), np.concatenate((data, copies))
    asked = np.arange(0, 2000, 20)
    found = []
    for row, (got, far) in zip(asked, block_neighbours(ids, points, ids[asked], points[asked], 10), strict=True):
        squares = np.cumsum((points - points[row]) ** 2, axis=1)[:, -1]
        true = np.lexsort((ids, squares))
        true = true[true != row][:10]
        found.append(len(set(got) & set(ids[true])))
        assert len(got) == len(set(got)) == 10 and (np.diff(far) >= 0).all()
    assert np.mean(found) / 10 >= 0.97 and min(found) >= 7


def test_copies_keep_their_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0 + i], 0) for i in range(1, 5)] + [(3, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_lists(nearest(df, df.where("vec_id in (3, 101)"), k=10))
    assert [i for _, i in got[3]] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert got[101] == sorted([(1.0, i) for i in range(9)] + [(1.0, 3)] + [(1.0, 102)])[:10]
