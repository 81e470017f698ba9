import numpy as np
from pyspark.sql import functions as F

from tonalis.llm.neighbours import AXES, PROBES, axis_vector, brute_force, fit_lists, nearest, nearest_lists, track_neighbours

SCHEMA = "pista_id long, valores map<string,double>, vecino_id string"


def lists(df):
    out = {}
    for r in df.orderBy("pista_id", "puesto").collect():
        out.setdefault(r.pista_id, []).append(r.vecino_id)
    return out


def test_neutral_axes_ties_copies_and_missing_rows(spark):
    same = {a: 0.3 for a in AXES}
    rows = [(i, same, "") for i in range(1, 10)] + [(20, {"energy": 1.0, "tension": float("nan"), "darkness": None}, ""), (21, {"energy": 1.0}, ""), (22, None, ""), (None, same, "")]
    got = lists(track_neighbours(spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == [2, 3, 4, 5, 6] and got[9] == [1, 2, 3, 4, 5] and got[3] == [1, 2, 4, 5, 6]
    assert got[20][0] == 21 and got[21][0] == 20 and 22 not in got


def test_few_rows_zero_vectors_and_empty_tables(spark):
    assert track_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lists(track_neighbours(spark.createDataFrame([(1, {}, "")], SCHEMA))) == {}
    zero = spark.createDataFrame([(5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0])], "id long, v array<double>")
    got = nearest(zero, id_col="id", vector=F.col("v"), k=2)
    assert [(r.vecino_id, r.similitud) for r in got.filter("id = 5").orderBy("puesto").collect()] == [(6, 0.0), (7, 0.0)]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.random((40, 24))
    x = np.clip(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.15, (4000, 24)), 0, 1).round(4)
    ids = np.arange(1, 4001)
    df = spark.createDataFrame([(int(i), {a: float(v) for a, v in zip(AXES, r)}, "") for i, r in zip(ids, x)], SCHEMA)
    got = lists(track_neighbours(df))
    want = brute_force(ids, x, np.arange(0, 4000, 50))
    hit = sum(len(set(got[q]) & set(v)) for q, v in want.items())
    assert hit / sum(map(len, want.values())) >= 0.97


def test_axis_vector_uses_every_axis(spark):
    df = spark.createDataFrame([(1, {"workout_score": 0.9}, "")], SCHEMA)
    v = df.select(axis_vector("valores").alias("v")).first().v
    assert len(v) == 24 and v[-1] == 0.9 and v[0] == 0.5


def test_two_levels_of_centres_find_the_true_neighbours():
    rng = np.random.default_rng(11)
    centres = rng.random((40, 24))
    u = centres[rng.integers(0, 40, 8000)] + rng.normal(0, 0.15, (8000, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    first, second = fit_lists(u, 32, most=8)
    assert len(first) == 8 and len(second) == 4
    number = nearest_lists(u, first, second, PROBES)
    far = ((u[:50, None, :] - (first[:, None] + second[None]).reshape(-1, 24)[None]) ** 2).sum(-1)
    assert (number[:50, 0] == far.argmin(1)).mean() >= 0.9 and number.max() < 32
    asked = np.arange(0, 8000, 50)
    sim = u[asked] @ u.T
    sim[np.arange(len(asked)), asked] = -1
    best = np.argsort(-sim, axis=1)[:, :5]
    assert (number[best, 0][:, :, None] == number[asked][:, None, :]).any(-1).mean() >= 0.95


def test_one_level_where_the_lists_are_few_and_no_vector_is_lost():
    u = np.eye(6)
    first, second = fit_lists(u, 3)
    assert len(first) == 3 and second.shape == (1, 6) and not second.any()
    assert nearest_lists(u, first, second, 8).shape == (6, 3) and nearest_lists(u[:0], first, second, 8).shape == (0, 3)
