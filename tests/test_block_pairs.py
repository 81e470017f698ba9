"""Every record meets all other rows of its blocks, hot blocks too."""

from tonalis.operators import resolve as E

COLUMNS = "id long, titulo string, artista_nombre string, isrc string"


def pairs(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return sorted((r.id, r.c_id) for r in E.block_pairs(df, df).select("id", "c_id").collect())


def brute(rows):
    code = lambda a, b: a[3] is not None and a[3] == b[3]
    return sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and (code(a, b) or a[1:3] == b[1:3]))


def test_all_candidates_of_both_blocks_once(spark):
    rows = [(1, "uno", "ana", "A"), (2, "uno", "ana", "A"), (3, "uno", "ana", None), (4, "dos", "eva", "A"), (5, "tres", "eva", "B"), (6, "uno", "ana", "B")]
    assert pairs(spark, rows) == brute(rows)
    assert {c for i, c in pairs(spark, rows) if i == 1} == {2, 3, 4, 6}


def test_a_hot_block_is_dealt_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT_BLOCK", 7)
    rows = [(k, f"t{k % 19}", "x", "Z" if k % 2 else None) for k in range(60)]
    assert pairs(spark, rows) == brute(rows)


def test_the_gap_is_to_the_second_best_candidate(spark):
    df = spark.createDataFrame([(9, 1, 0.9), (9, 2, 0.85), (9, 3, 0.1)], "id long, c_id long, puntaje double")
    r = E.decided(df).first()
    assert (r.candidato, r.brecha, r.puntaje, r.ruta) == (1, 0.05, 0.75, "revision")


def test_ten_candidates_of_one_block_are_all_scored(spark):
    rows = [(k, "la misma", "x", None) for k in range(11)]
    got = pairs(spark, rows)
    assert sum(1 for a, _ in got if a == 0) == 10


def test_ambiguity_never_sinks_a_score_from_review_on_below_it(spark):
    df = spark.createDataFrame([(9, 1, 0.60), (9, 2, 0.58), (8, 1, 0.54), (8, 2, 0.50), (7, 1, 0.05)], "id long, c_id long, puntaje double")
    got = {r.id: (r.puntaje, r.ruta) for r in E.decided(df).collect()}
    assert got == {9: (0.55, "revision"), 8: (0.39, "cuarentena"), 7: (0.05, "cuarentena")}


def test_releases_cost_by_their_type_and_what_the_title_says(spark):
    from pyspark.sql import functions as F

    rows = [("Compilation", None, 0.2, 0.25), ("Live", None, 0.2, 0.20), (" live ", "Live", 0.65, 0.06), ("Album", "Live", 1.0, 0.0), (None, None, 0.4, 0.0), ("otro", None, 0.5, 0.0)]
    df = spark.createDataFrame([(k, v) for k, v, _, _ in rows], "k string, v string").select(E.release_score(F.col("k"), F.col("v")).alias("s"), E.release_penalty(F.col("k"), F.col("v")).alias("p"))
    assert [(r.s, round(r.p, 6)) for r in df.collect()] == [(s, p) for _, _, s, p in rows]


def test_titles_albums_and_causes_of_scored_pairs(spark):
    cols = "id long, titulo string, artista_nombre string, album_titulo string, duracion_seg double, track_number int, anio int, isrc string, mb_recording_id string, tipo string"
    base = ("Ana", 200.0, 1, 2000, None, None)
    rows = [(1, "luz", base[0], None, *base[1:], "Album"), (2, "luz", base[0], "disco", *base[1:], "Compilation")]
    df = spark.createDataFrame([(i, t, a, b, *r) for i, t, a, b, *r in rows], cols)
    got = {(r.id, r.c_id): r for r in E.scored(E.block_pairs(df, df), True).collect()}
    assert got[1, 2].s_album == 0.5 and got[2, 1].s_album == 0.2 and got[1, 2].s_tipo_release == 0.2
    assert abs(got[2, 1].puntaje - (0.28 + 0.23 + 0.18 + 0.02 + 0.07 + 0.07 + 0.035 + 0.04)) < 1e-6
    assert abs(got[1, 2].puntaje - (0.28 + 0.23 + 0.18 + 0.05 + 0.07 + 0.014 + 0.035 + 0.04 - 0.25)) < 1e-6
    assert {(r.id, r.causa) for r in E.causes(E.scored(E.block_pairs(df, df), True)).collect()} == {(1, "tipo_dudoso")}


def test_prepared_records_score_like_plain_ones(spark):
    cols = "id long, titulo string, artista_nombre string, album_titulo string, duracion_seg double, track_number int, anio int, isrc string, mb_recording_id string, tipo string"
    rows = [(1, "Luz (Live)", "Ana", "Uno", 200.0, 1, 2000, "A", None, "Live"), (2, "luz", "ana", None, 210.0, 2, 2001, "A", None, "Compilation"), (3, "Lúz [Remix]", "Eva", "", None, None, None, "A", None, None), (4, "otra", None, "Uno", 1.0, 1, 1, "A", None, "EP")]
    df = spark.createDataFrame(rows, cols)
    keep = ["id", "c_id", "s_titulo", "s_artista", "s_album", "s_tipo_release", "puntaje"]
    plain = sorted(map(tuple, E.scored(E.block_pairs(df, df), True).select(keep).collect()))
    ready = E.prepared(df)
    assert sorted(map(tuple, E.scored(E.block_pairs(ready, ready), True).select(keep).collect())) == plain and len(plain) == 12


def test_prepared_records_have_the_full_similarity_of_plain_ones(spark):
    cols = "id long, titulo string, artista_nombre string, album_titulo string, duracion_seg double, track_number int, anio int, isrc string, mb_recording_id string, tipo string"
    texts = [("Luz (Live)", "Ana", "Uno"), ("luz", "ána b", None), ("Lúz [Remix]", "Eva", "x" * 70), ("ab", None, "Uno (Remix)"), ("", "-", "Unó dos"), ("风 sous la pluie", "Ana Luz", "x" * 60 + "y")]
    df = spark.createDataFrame([(k, *t, 200.0 + k, k, 2000, "A", None, "Live" if k % 2 else "Album") for k, t in enumerate(texts)], cols)
    keep = ["id", "c_id", "s_titulo", "s_artista", "s_album", "puntaje"]
    plain = sorted(map(tuple, E.scored(E.block_pairs(df, df)).select(keep).collect()))
    ready = E.prepared(df, False)
    assert sorted(map(tuple, E.scored(E.block_pairs(ready, ready)).select(keep).collect())) == plain and len(plain) == 30


def test_matching_blocks_of_many_pairs_are_those_of_the_sequence_matcher():
    import random
    from difflib import SequenceMatcher

    from tonalis.functions.text import matched_characters

    rng = random.Random(3)
    a, b = (["".join(rng.choice("abñ 风") for _ in range(rng.randrange(1, 64))) for _ in range(400)] for _ in range(2))
    assert matched_characters(a, b).tolist() == [sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b)]


RECORD = "id long, titulo string, artista_nombre string, album_titulo string, duracion_seg double, track_number int, anio int, isrc string, mb_recording_id string, tipo string"


def odd_records(n):
    import random

    rng = random.Random(5)
    titles = ["Luz (Live)", "luz", "Lúz [Remix]", "ab", "", "风 sous la pluie", "Luz (Remastered)", "x" * 64 + " y", "la la la"]
    artists, albums = ["Ana", "ána b", "Eva", None, "-", "Guadalupe Fitanbel", "guadalupe fitenbal"], ["Uno", None, "", "Uno (Remix)", "Unó dos", "x" * 70, "-"]
    seconds, kinds = [200.0, 203.5, 207.01, 214.2, 229.99, 260.0, None, float("nan")], ["Album", " live ", "Compilation", "Remix", None, "", "otro"]
    pick = rng.choice
    return [(k, pick(titles), pick(artists), pick(albums), pick(seconds), pick([1, 2, 5, None]), pick([1999, 2000, 2002, None]), pick(["A", "A", "B", f"C{k}", None]), None, pick(kinds)) for k in range(n)]


def test_full_scores_are_those_of_the_joined_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 16)
    df = spark.createDataFrame(odd_records(150), RECORD)
    joined = sorted(map(tuple, E.scored(E.block_pairs(df, df)).select("id", "c_id", "puntaje").collect()))
    assert sorted(map(tuple, E.full_scores(df).collect())) == joined and len(joined) > 5000


def test_two_texts_are_compared_once_however_many_pairs_have_them(monkeypatch):
    import numpy as np
    import pyarrow as pa

    n, met = 600, []
    text = lambda name, m: [f"{name} {k % m}" for k in range(n)]
    columns = {"_block": ["i:A"] * n, "_tile": [0] * n, "_side": [1] * n, "id": list(range(n)), "isrc": ["A"] * n, "g_titulo": text("luz", 3), "g_entero": text("luz", 3), "g_artista": text("ana", 5), "g_album": text("uno", 2), "f_sin_album": [False] * n, "_tipo": ["album"] * n}
    columns |= {"_variante": pa.array([None] * n, pa.string())} | {x: [0.0] * n for x in ("_s_igual", "_s_otro", "_p_igual", "_p_otro", "duracion_seg")} | {x: [1] * n for x in ("track_number", "anio")}
    real = E.form_similarities
    monkeypatch.setattr(E, "form_similarities", lambda forms, a, b: met.append(len(a)) or real(forms, a, b))
    table = pa.table(columns)
    out = pa.Table.from_batches(E._scored_tiles(iter(table.to_batches(max_chunksize=70))))
    assert len(out) == n * (n - 1) and sorted(met) == [4, 9, 25]
    assert len(np.unique(out["id"].to_numpy() * n + out["c_id"].to_numpy())) == len(out)


def test_pairs_with_long_runs_are_matched_beside_others():
    from difflib import SequenceMatcher

    from tonalis.functions.text import matched_characters

    a = ["guadalupe fitanbel", "fitanbel guadalupe", "abcabcabcabc", "aaaaabaaaaa", "x", "a" * 63, "abcdefghijklmnopqrstuvwxyz0123456", "ab"]
    pairs = [(x, y) for x in a for y in a]
    assert matched_characters(*map(list, zip(*pairs))).tolist() == [sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in pairs]
