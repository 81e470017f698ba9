from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonalis.operators.hot_deck import fill_tracks, hot_deck

SCHEMA = "id long, artista_id long, album_id long, analizado_en timestamp_ntz, bpm double, energy double, mood_sad double, extra string, campo string"
T0 = datetime(2024, 1, 1)


def row(i, artist, album, t, bpm, energy=0.5, sad=0.5):
    return (i, artist, album, None if t is None else T0 + timedelta(seconds=t), bpm, energy, sad, "x", "y")


def cells(df):
    return {(r.id, r.campo): r for r in df.collect()}


def test_takes_the_nearest_donor_of_the_same_artist(spark):
    rows = [row(1, 7, 1, 0, 100.0), row(2, 7, 1, 10, None), row(3, 7, 1, 14, 120.0), row(4, 7, 2, 11, 90.0)]
    got = cells(fill_tracks(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == {(2, "bpm")}
    r = got[2, "bpm"]
    assert (r.valor, r.donante_id, r.nivel, r.relleno, r.distancia_seg) == ("120.0", 3, "artista", True, 4.0)


def test_ties_go_to_the_previous_donor_and_bad_values_are_no_donors(spark):
    rows = [row(1, 7, 1, 0, 100.0), row(2, 7, 1, 5, 0.0), row(3, 7, 1, 10, 130.0), row(4, 7, 1, 6, float("nan")), row(5, 7, 1, 7, 301.0, energy=1.0, sad=-0.1)]
    got = cells(fill_tracks(spark.createDataFrame(rows, SCHEMA)))
    assert got[2, "bpm"].donante_id == 1
    assert got[4, "bpm"].donante_id == 3 and got[5, "bpm"].donante_id == 3
    assert (5, "energy") not in got and got[5, "mood_sad"].donante_id == 4


def test_levels_album_then_time_then_nothing(spark):
    rows = [row(1, 1, 9, 0, 100.0), row(2, 2, 9, 5, None), row(3, 3, 8, 100, None), row(4, None, None, None, None)]
    got = cells(fill_tracks(spark.createDataFrame(rows, SCHEMA)))
    assert (got[2, "bpm"].nivel, got[3, "bpm"].nivel, got[4, "bpm"].nivel) == ("album", "tiempo", "tiempo")
    assert got[4, "bpm"].distancia_seg is None
    none = cells(fill_tracks(spark.createDataFrame([row(1, 1, 1, 0, None)], SCHEMA)))
    assert not none[1, "bpm"].relleno and none[1, "bpm"].valor is None


def test_empty_table_and_repeated_rows(spark):
    assert fill_tracks(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [row(1, 1, 1, 0, None)] * 2 + [row(2, 1, 1, 5, 80.0)] * 3
    got = fill_tracks(spark.createDataFrame(rows, SCHEMA)).filter("campo = 'bpm'").collect()
    assert [(r.id, r.donante_id) for r in got] == [(1, 2)]


def test_categorical_fields_and_equal_times(spark):
    df = spark.createDataFrame([(1, "a", 0, "rock"), (2, "a", 0, None), (3, "a", 0, "pop"), (4, "b", 0, None)], "id long, g string, t int, genero string").withColumn("t", F.timestamp_seconds("t"))
    out = hot_deck(df, id_col="id", fields={"genero": F.col("genero").isNotNull()}, levels=[("g", "g", [])], time="t")
    assert {(r.id, r.valor) for r in out.collect()} == {(2, "rock"), (4, None)}


@pytest.mark.parametrize("hot", [2000])
def test_a_hot_group_is_cut_over_pieces_and_matches_brute_force(spark, hot):
    rows = [row(i, 1, None, (i * 37) % 501, None if i % 3 else float(1 + i % 200)) for i in range(hot)]
    got = cells(fill_tracks(spark.createDataFrame(rows, SCHEMA)))
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    for k, r in enumerate(order):
        if r[4] is None:
            prev = next((x for x in reversed(order[:k]) if x[4] is not None), None)
            nxt = next((x for x in order[k + 1 :] if x[4] is not None), None)
            gaps = [(abs((x[3] - r[3]).total_seconds()), side, x[0]) for side, x in enumerate((prev, nxt)) if x]
            assert got[r[0], "bpm"].donante_id == min(gaps)[2]
