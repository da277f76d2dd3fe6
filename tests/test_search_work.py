"""Both searches hand on few rows and are exact on copies, ties and cells."""

import numpy as np
import pytest

from docquery.operators import vectors
from docquery.operators.vectors import best_of_block, top_k
from docquery.sources import repository as stored
from docquery.sources.repository import PAYLOAD, VectorRepository


def rows_of(n, dimension, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dimension))
    rows[n // 2 : n // 2 + n // 10] = rows[1]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def brute(asked, ids, points, k):
    scores = np.round(np.einsum("qd,pd->qp", asked, points), 12)
    return [list(ids[np.lexsort((ids, -s))[:k]]) for s in scores]


@pytest.mark.parametrize("k", [1, 6, 3000])
@pytest.mark.parametrize("scale, cells", [(1, 0), (1, 1), (1, 40), (1e17, 0), (1e-9, 3)])
def test_kernel_is_exact(k, scale, cells):
    points, ids = rows_of(2000, 8) * scale, np.random.default_rng(4).permutation(2000)
    asked = points[:700:9] / scale
    starts = np.r_[np.arange(0, 2000, 2000 // cells), 2000] if cells else None
    wanted = np.ones((len(asked), len(starts) - 1), bool) if cells else None
    query, place, score, tied = best_of_block(asked, ids, points, k, None, starts, wanted)
    want = brute(asked, ids, points, k)
    assert [list(ids[place[query == q]]) for q in range(len(asked))] == want if scale < 1e9 else [len(x) for x in want] == list(np.bincount(query))
    assert np.allclose(score, np.einsum("ij,ij->i", asked[query], points[place])) and np.array_equal(tied, np.round(score, 12))
    if scale == 1:
        least = np.array([np.sort(points @ a)[-min(k, 4)] for a in asked]) - 1e-11
        some = best_of_block(asked, ids, points, k, least, starts, wanted)
        assert [list(ids[some[1][some[0] == q]]) for q in range(len(asked))] == [[i for i in w if points[np.flatnonzero(ids == i)[0]] @ a >= m] for w, a, m in zip(want, asked, least, strict=True)]


def test_cells_that_no_query_wants_are_not_compared():
    points, ids = rows_of(1000, 8), np.arange(1000)
    wanted = np.zeros((20, 10), bool)
    wanted[:, 3] = True
    _, place, _, _ = best_of_block(points[:20], ids, points, 5, None, np.arange(0, 1001, 100), wanted)
    assert len(place) == 100 and set(place // 100) == {3}


def test_stored_search_hands_on_few_rows_however_many_cells(spark, tmp_path, monkeypatch):
    points = rows_of(3000, 16)
    held = VectorRepository(spark, str(tmp_path / "v"), 16, cell_points=30)
    held.ensure()
    held.upsert(spark.createDataFrame([(i, [float(x) for x in v], (1, i, "c", 0, None, "d", "markdown", None, None)) for i, v in enumerate(points)], f"point_id long, vector array<double>, payload {PAYLOAD}"))
    asked = [(i, 1, [float(x) for x in points[i]]) for i in range(0, 3000, 30)]
    seen, ranked = [], stored.ranked
    monkeypatch.setattr(stored, "ranked", lambda found, *rest: seen.append(found.count()) or ranked(found, *rest))
    hits = held.search(spark.createDataFrame(asked, "query_id long, workspace_id long, vector array<double>"), 7).collect()
    got = {q: [r.point_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] for q, _, _ in asked}
    assert list(got.values()) == brute(points[::30], np.arange(3000), points, 7)
    assert held.cells().count() > 90 and max(seen) <= 2 * 7 * len(asked), seen


def test_points_are_moved_once_for_many_queries(spark, monkeypatch):
    points = rows_of(5000, 8)
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(points)]
    held, asked = (spark.createDataFrame(rows, f"{name} long, workspace_id long, vector array<double>") for name in ("point_id", "query_id"))
    calls, block = spark.sparkContext.accumulator(0), vectors._block_hits

    def counted(own, asked, k):
        calls.add(1)
        return block(own, asked, k)

    monkeypatch.setattr(vectors, "_block_hits", counted)
    hits = {(r.query_id, r["rank"]): r.point_id for r in top_k(held, asked, 3).collect()}
    assert [[hits[q, n] for n in (1, 2, 3)] for q in range(0, 5000, 100)] == brute(points[::100], np.arange(5000), points, 3)
    assert len(hits) == 15_000 and calls.value == 1
