import numpy as np
import pytest

from docquery.operators.vectors import latest, top_k, upserted
from docquery.sources.repository import PAYLOAD, VectorRepository
from docquery.sources.scratch import claim
from docquery.sources.store import Conflict, Store, Table

POINTS = f"point_id long, vector array<double>, payload {PAYLOAD}"


def payload(point, space):
    return (space, point // 10, f"c{point}", point % 10, None, "d.md", "markdown", None, None)


def clustered(n, dimension, groups, seed=1, spaces=2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, dimension))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    rows = middle[np.arange(n) % groups] + rng.standard_normal((n, dimension)) * 0.15 / np.sqrt(dimension)
    rows[n // 2 : n // 2 + 5] = rows[0]  # ties
    return [(i + 1, [float(x) for x in v], payload(i + 1, i % spaces + 1)) for i, v in enumerate(rows)]


def brute(points, queries, k):
    out = []
    for query, space, q in queries:
        own = [(p, v) for p, v, load in points if load[0] == space]
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        best = sorted((-round(float(unit(v) @ unit(q)), 12), p) for p, v in own)[:k]
        out += [(query, space, p, rank) for rank, (_, p) in enumerate(best, 1)]
    return sorted(out)


def got(hits):
    return sorted((r.query_id, r.workspace_id, r.point_id, r["rank"]) for r in hits.collect())


def queries_of(spark, points, every):
    rows = [(p, load[0], v) for p, v, load in points[::every]]
    return rows, spark.createDataFrame(rows, "query_id long, workspace_id long, vector array<double>")


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    points = clustered(6000, 24, 40)
    repository = VectorRepository(spark, str(tmp_path_factory.mktemp("vectors")), 24)
    repository.ensure()
    repository.upsert(spark.createDataFrame(points, POINTS))
    return points, repository


def test_stored_search_is_exact_and_reads_few_cells(spark, held):
    points, repository = held
    rows, asked = queries_of(spark, points, 100)
    hits, read = repository.explained(asked, 7)
    assert got(hits) == brute(points, rows, 7)
    assert {r.payload.chunk_id for r in hits.collect()} >= {"c1"} and {r.error_message for r in hits.collect()} == {None}
    of = {(r.workspace_id, r.cell): r.points for r in repository.cells().collect()}
    compared = sum(of[r.workspace_id, r.cell] for r in read.collect())
    assert len(of) > 60 and compared < 0.15 * len(rows) * len(points) / 2


def test_stored_points_are_read_by_partition(held):
    _, repository = held
    one = repository.cells().where("workspace_id = 1 and cell = 3")
    plan = repository._stored(one, ["point_id", "vector"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "payload" not in plan


@pytest.mark.parametrize("k", [1, 40, 5000])
def test_more_hits_than_a_cell_or_workspace_holds(spark, held, k):
    points, repository = held
    rows, asked = queries_of(spark, points, 2000)
    assert got(repository.search(asked, k)) == brute(points, rows, k)


def test_points_without_structure_and_odd_queries(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = [(i, [float(x) for x in rng.standard_normal(16)], payload(i, 1)) for i in range(700)]
    repository = VectorRepository(spark, str(tmp_path / "v"), 16)
    repository.ensure()
    none = spark.createDataFrame([(1, 1, [1.0] * 16)], "query_id long, workspace_id long, vector array<double>")
    assert repository.search(none).collect() == [] and repository.read().count() == 0
    repository.upsert(spark.createDataFrame(points, POINTS).repartition(3))
    rows, asked = queries_of(spark, points, 90)
    odd = [(900, 7, [1.0] * 16), (901, None, [1.0] * 16), (902, 1, None), (903, 1, [0.0] * 16), (904, 1, [1.0]), (905, 1, [float("nan")] * 16), (None, 1, [1.0] * 16), (906, 0, [1.0] * 16)]
    assert got(repository.search(asked.union(spark.createDataFrame(odd, asked.schema)), 5)) == brute(points, rows, 5)
    with pytest.raises(ValueError, match="limit"):
        repository.search(asked, 0)


def test_upserts_replace_move_and_let_the_last_win(spark, tmp_path):
    points = clustered(900, 8, 9)
    repository = VectorRepository(spark, str(tmp_path / "v"), 8, cell_points=20)
    repository.ensure()
    repository.upsert(spark.createDataFrame(points, POINTS))
    before = {(r.workspace_id, r.cell): r.generation for r in repository.cells().collect()}
    turned = [(p, [-x for x in v], load, at) for p, v, load in points[:3] for at in (2, 1)]
    turned = [(p, v if at == 2 else points[5][1], load, at) for p, v, load, at in turned]
    moved = [(p, v, payload(p, 3), 1) for p, v, _ in points[10:14]] + [(5000, points[0][1], payload(5000, 1), None)]
    repository.upsert(spark.createDataFrame(turned + moved, POINTS + ", at int"), "at")
    want = {p: (v, load) for p, v, load in points} | {p: (v, load) for p, v, load, at in turned + moved if at != 1 or load[0] == 3}
    now = [(p, v, load) for p, (v, load) in want.items()]
    stored = {r.point_id: (r.vector, tuple(r.payload)) for r in repository.read().collect()}
    assert stored.keys() == want.keys() and repository.read().count() == len(want)
    assert all(np.allclose(stored[p][0], np.array(v) / np.linalg.norm(v)) and stored[p][1] == load for p, v, load in now)
    rows, asked = queries_of(spark, now, 60)
    assert got(repository.search(asked, 6)) == brute(now, rows, 6)
    after = {(r.workspace_id, r.cell): r.generation for r in repository.cells().collect()}
    assert sum(after.get(c) == g for c, g in before.items()) > len(before) / 2
    repository.rebuild()
    assert got(repository.search(asked, 6)) == brute(now, rows, 6) and len({r.generation for r in repository.cells().collect()}) == 1


def test_guards_and_writers_that_meet(spark, tmp_path):
    root = str(tmp_path / "v")
    repository = VectorRepository(spark, root, 2)
    with pytest.raises(ValueError, match="not exist"):
        repository.read()
    repository.ensure()
    repository.ensure()
    with pytest.raises(ValueError, match="dimension 2"):
        VectorRepository(spark, root, 3).ensure()
    frame = lambda *rows: spark.createDataFrame(list(rows), POINTS)
    good = (1, [1.0, 0.0], payload(1, 1))
    for bad, message in [((2, [1.0], payload(2, 1)), "dimension mismatch"), ((None, [1.0, 0.0], payload(2, 1)), "point ID"), ((2, [1.0, 0.0], None), "payload"), ((2, [0.0, 0.0], payload(2, 1)), "zero"), ((2, [1.0, 0.0], payload(2, 0)), "workspace_id")]:
        with pytest.raises(ValueError, match=message):
            repository.upsert(frame(good, bad))
    repository.upsert(frame())
    assert repository.read().count() == 0
    late = VectorRepository(spark, root, 2)
    seen = late._last()
    repository.upsert(frame(good))
    late._last = lambda: seen
    with pytest.raises(Conflict):
        late.upsert(frame((7, [0.0, 1.0], payload(7, 1))))
    assert [r.point_id for r in repository.read().collect()] == [1]


def test_store_writers_that_meet(spark, tmp_path):
    """A reads, B commits, A commits: A fails and what B wrote stays."""
    schema = "id long, workspace_id long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    a, b = (Table(Store(spark, str(tmp_path / "s")), "one", schema) for _ in range(2))
    a.upsert(frame([(1, 1, "a"), (2, 1, "b")]), "id")
    base = a.store.state()
    merged = a.merged(frame([(1, 1, "late")]), "id", base)
    b.upsert(frame([(3, 1, "c")]), "id")
    with pytest.raises(Conflict):
        a.store.commit({"one": merged}, base=base)
    assert {r.id: r.v for r in b.read().collect()} == {1: "a", 2: "b", 3: "c"} == {r.id: r.v for r in a.read().collect()}
    a.upsert(spark.createDataFrame([(1, 1, "x", 2), (1, 1, "y", 1), (4, 1, "z", None), (4, 1, "w", 0)], schema + ", at int"), "id", "at")
    assert {r.id: r.v for r in b.read().collect()} == {1: "x", 2: "b", 3: "c", 4: "w"}


def test_one_writer_claims_a_path(spark, tmp_path):
    assert claim(spark, str(tmp_path / "log" / "1"), "mine") and not claim(spark, str(tmp_path / "log" / "1"), "yours")
    assert (tmp_path / "log" / "1").read_text() == "mine" and [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1"]


def test_last_of_a_batch(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, None, "c"), (2, None, "d"), (None, 1, "e"), (None, 1, "f")], "k long, at int, v string")
    kept = latest(rows, "k", "at").collect()
    assert sorted((r.k or 0) for r in kept) == [0, 0, 1, 2] and {r.at for r in kept if r.k == 1} == {5}
    assert sorted(map(str, kept)) == sorted(map(str, latest(rows.repartition(5), "k", "at").collect()))
    old = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], "point_id long, workspace_id long, vector array<double>")
    new = spark.createDataFrame([(1, 1, [8.0], 1), (1, 1, [9.0], 2), (3, 1, [3.0], 1)], "point_id long, workspace_id long, vector array<double>, at int")
    assert sorted((r.point_id, r.vector[0]) for r in upserted(old, new, "at").collect()) == [(1, 9.0), (2, 2.0), (3, 3.0)]


@pytest.mark.parametrize("split", [7, 50_000])
def test_top_k_of_768_components_in_any_parts(spark, split):
    points = clustered(400, 768, 30, spaces=3)
    unit = [(p, load[0], [float(x) for x in np.array(v) / np.linalg.norm(v)]) for p, v, load in points]
    rows, _ = queries_of(spark, points, 37)
    held = spark.createDataFrame([*unit, (9000, 1, None), (9001, 1, [1.0]), (9002, 1, [float("nan")] * 768), (9003, None, unit[0][2])], "point_id long, workspace_id long, vector array<double>")
    asked = spark.createDataFrame([*[(q, s, next(v for p, _, v in unit if p == q)) for q, s, _ in rows], (9000, 8, rows[0][2])], "query_id long, workspace_id long, vector array<double>")
    assert got(top_k(held, asked, 3, split, 3)) == brute(points, rows, 3)
