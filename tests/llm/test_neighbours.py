import numpy as np
import pytest

from corvane.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, other string"


def brute(ids, v, k, least):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] > least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=64) + rng.normal(size=(n, 64)) * 0.35 for n in rng.integers(2, 60, 60)]).astype(np.float32)
    ids = list(range(len(v)))
    df = spark.createDataFrame([(i, x.tolist(), "e") for i, x in zip(ids, v)], SCHEMA)
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(df).collect()}
    true = brute(ids, v.astype(np.float64), 5, 0.85)
    assert len(got & true) / len(true) >= 0.95 and len(got & true) / len(got) >= 0.95
    assert N.recall(df, every=7).first()["recall"] >= 0.9


def test_dirty_vectors_take_no_part_and_copies_pair_linearly(spark):
    a, b = [1.0] * 64, [1.0] * 63 + [0.9]
    bad = [None, [], [0.0] * 64, [1.0] * 63, [float("nan")] * 64, [1.0] * 63 + [None], [float("inf")] * 64]
    rows = [(i, a, None) for i in range(40)] + [(100, b, None), (100, b, None), (None, a, None)] + [(200 + i, x, None) for i, x in enumerate(bad)]
    got = [(r.vec_id, r.other, r["rank"]) for r in N.nearest(spark.createDataFrame(rows, SCHEMA), 5, 0.85).collect()]
    assert {i for i, _, _ in got} == {*range(40), 100}
    assert sorted(o for i, o, _ in got if i == 39) == [0, 1, 2, 3, 4]
    assert sorted(o for i, o, _ in got if i == 100) == [0, 1, 2, 3, 4]
    assert len(got) == 41 * 5


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 64, None)]])
def test_nothing_to_pair(spark, rows):
    assert N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_graph_search_finds_itself_and_small_graphs_work():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, sims = N.Graph(v).search(v, 1, 32, 20)
    assert (ids[:, 0] == np.arange(900)).mean() > 0.9
    assert N.Graph(v[:2]).search(v[:2], 3)[0][:, :2].tolist() == [[0, 1], [1, 0]]


def test_nearest_finds_neighbours_in_far_cells(spark, monkeypatch):
    """Cells far too small, cut by planes as well: most true neighbours are in other shards, and are found."""
    monkeypatch.setattr(N, "CELL_ROWS", 150)
    monkeypatch.setattr(N, "SHARD_ROWS", 100)
    rng = np.random.default_rng(5)
    v = (np.repeat(rng.normal(size=(90, 64)), 10, 0) + rng.normal(size=(900, 64)) * 0.6).astype(np.float32)
    df = spark.createDataFrame([(i - 5, x.tolist(), None) for i, x in enumerate(v)], SCHEMA)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for least in (-1.0, 0.7):
        got = {(r.vec_id, r.other) for r in N.nearest(df, 5, least).collect()}
        true = {(i - 5, j - 5) for i in range(900) for j in np.argsort(-s[i])[:5] if s[i, j] > least}
        assert len(got & true) / len(true) >= 0.95


def test_planes_are_crossed_by_the_floor():
    """A vector is sent to fewer shards the nearer its neighbours are, never to its own, and to no shard twice."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centers = N.fit_cells(v, 6)
    home = np.argmax(v @ centers.T, 1)
    cells = N.Cells(centers, np.bincount(home, minlength=6) * N.SHARD_ROWS / 100.0)
    assert cells.planes.min() >= 1
    sub = cells.sub(v, home)
    sent = []
    for floor in (0.2, 0.6, 0.9, 1.0):
        n = 0
        for c, b in {(int(c), int(b)) for c, b in zip(home, sub)}:
            rows = np.flatnonzero((home == c) & (sub == b))
            got = list(zip(*(x.tolist() for x in cells.routes(v[rows], c, b, np.full(len(rows), floor, np.float32)))))
            assert len(got) == len(set(got)) and all((x, y) != (c, b) for _, x, y in got)
            n += len(got)
        sent.append(n)
    assert sent[0] > sent[1] > sent[2] > sent[3] == 0


def test_builder_builds_only_the_level_it_hands_on(monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2 * N.TOP_ROWS, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    blobs = N._blobs(np.rint(v * N.SCALE).astype(np.int16))
    whole = N.Graph(N._vectors(blobs, 64))
    assert len(whole.levels) == 2
    built = []
    monkeypatch.setattr(N, "build_level", lambda x, *a, build=N.build_level: built.append(len(x)) or build(x, *a))

    class Shared:
        value = N.Cells(v[:1], np.array([len(v)]))

    pdf = N.pd.DataFrame({"cell": 0, "sub": 0, "vec_id": np.arange(len(v)), "v": blobs})
    out = N._builder(Shared, 5, 64, -1.0)(pdf)
    assert built == [len(v)]
    assert (N._level(out["links"].to_numpy()) == whole.levels[0][2]).all()
    assert (N._stack(out["own"].to_numpy(), np.int32, 5) == whole.search_own(5)[0]).all()
