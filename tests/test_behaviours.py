"""Hand-computed cases of single operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonalis.functions import text as X
from tonalis.functions import vectors as V
from tonalis.operators import dedupe, features, interface, jobs, library, listening, planner, quality, resolve, smartlists, sync
from tonalis.operators.search import Question, search_tracks
from tonalis.sources import changes, files

T0 = datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "equal"), [(200.0, 203.0, True), (200.0, 204.0, False), (None, 200.0, False), (None, None, False)])
def test_duration_tolerance_includes_both_ends(spark, a, b, equal):
    assert one(spark, dedupe.same_duration(F.lit(a).cast("double"), F.lit(b).cast("double"))) is equal


def test_text_forms(spark):
    assert one(spark, X.compare_form(F.lit("  ¡Canción, del MAR_1!  "))) == "cancion del mar_1"
    assert one(spark, X.canonical(F.lit("Don’t  Stop…"))) == "don t stop"
    assert one(spark, X.slug(F.lit("¿Qué? — a/b"))) == "qué_a_b" and one(spark, X.slug(F.lit(" "))) == "sin_titulo"
    assert one(spark, X.clean_title(F.lit("Song (Official Video) extra"))) == "Song"
    assert one(spark, X.strip_version(F.lit("Hotel (Remaster) (feat. A)"))) == "Hotel (feat. A)"
    assert one(spark, X.main_artist(F.lit("Drake feat. Future"))) == "Drake" and one(spark, X.featuring(F.lit("Drake (feat. Future)"))) == "Future"
    p = one(spark, X.parse_file_name(F.lit("Artist - 01 - Title.mp3")))
    assert (p.artista, p.pista, p.titulo) == ("Artist", "01", "Title")
    assert one(spark, X.variant_type(F.lit("Song (Live at X)"))) == "Live" and one(spark, X.variant_type(F.lit("Alive"))) is None
    assert one(spark, X.dominant_script(F.lit("Ночь a"))) == "cirilico" and one(spark, X.all_latin(F.lit("São 1"))) is True
    assert one(spark, X.eta_label(F.lit(3725.0))) == "1h 02m" and one(spark, X.minutes_seconds(F.lit(65.9))) == "1:05"
    assert one(spark, X.combined_similarity(F.lit("a b"), F.lit("a b"))) == 1.0 and one(spark, X.combined_similarity(F.lit(""), F.lit("a"))) == 0.0


def test_nulls_in_text_functions(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, X.compare_form(nothing)) == "" and one(spark, X.slug(nothing)) == "sin_titulo" and one(spark, X.isrc_code(nothing)) is None and one(spark, X.year_of(nothing)) is None


def test_tag_threshold_is_included(spark):
    df = spark.createDataFrame([(1, 0.35, 0.3499, float("nan"))], "id long, energy double, calmness_proxy double, x double")
    got = features.tags(df, {"energetica": "energy", "tranquila": "calmness_proxy", "nada": "x"}, "reglas", False)
    assert [(r.tag, r.puntaje) for r in got.collect()] == [("energetica", 0.35)]


def test_keys_tempos_and_energy(spark):
    d = lambda a, b: one(spark, planner.key_distance(F.lit(a), F.lit(b)))
    assert (d("8B", "8B"), d("12A", "1A"), d("8A", "8B"), d("1B", "11B"), d("1A", "6B")) == (0, 1, 1, 2, 3)
    assert one(spark, planner.key_distance(F.lit(None).cast("string"), F.lit("1A"))) == 99
    assert one(spark, planner.tempo_factor(F.lit(70.0), F.lit(140.0))) == 1.0 and one(spark, planner.tempo_factor(F.lit(0.0), F.lit(100.0))) == 0.5
    assert one(spark, planner.energy_factor(F.lit(0.5), F.lit(0.6))) == 1.0
    assert one(spark, planner.wheel_code(F.lit(" A "), F.lit("Minor"))) == "8A" and one(spark, planner.wheel_code(F.lit("H"), F.lit("major"))) is None


def test_cosine_of_zero_and_ragged_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0.0 and one(spark, V.cosine(arr(1, 0, 5), arr(1, 0))) == 1.0


def test_the_same_seed_gives_the_same_plan(spark):
    rows = [(1, k, k % 5, 200.0, (k % 10) / 10, (k * 7 % 30) / 30) for k in range(60)]
    df = spark.createDataFrame(rows, "sesion_id long, pista_id long, artista_id long, duracion_seg double, energy double, score_total double")
    a, b = ([tuple(r) for r in planner.plan_sessions(df, minutes=30).orderBy("posicion").collect()] for _ in range(2))
    assert a == b and len({r[2] for r in a}) == len(a)
    per = {}
    for r in a:
        per[r[2] % 5] = per.get(r[2] % 5, 0) + 1
    assert max(per.values()) <= 2


def tracks(spark, rows):
    cols = "id long, titulo string, artista_nombre string, album_titulo string, artista_id long, album_id long, genero string, anio int, favorita int, veces_reproducida long, ultimo_acceso timestamp_ntz, indexado_en timestamp_ntz, estado string, duracion_seg double, bitrate_kbps int, tamano_bytes long, hash_sha256 string, mb_recording_id string, isrc string, track_number int"
    base = dict(titulo="t", artista_nombre="a", album_titulo="b", artista_id=1, album_id=1, genero="folk", anio=2000, favorita=0, veces_reproducida=0, ultimo_acceso=None, indexado_en=T0, estado="biblioteca", duracion_seg=200.0, bitrate_kbps=128, tamano_bytes=10, hash_sha256=None, mb_recording_id=None, isrc=None, track_number=1)
    names = [c.split()[0] for c in cols.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], cols)


def plays(spark, rows):
    return spark.createDataFrame([(k, p, T0 + timedelta(hours=h)) for k, (p, h) in enumerate(rows)], "id long, pista_id long, reproducido_en timestamp_ntz")


def test_never_played_excludes_tracks_with_history(spark):
    got = listening.never_played(tracks(spark, [dict(id=1), dict(id=2), dict(id=3, veces_reproducida=4)]), plays(spark, [(2, 0), (None, 1)]))
    assert [r.id for r in got.collect()] == [1]


def test_repeated_plays_count_once(spark):
    h = plays(spark, [(1, 0), (1, 1)])
    assert listening.plays_per_track(h.unionByName(h)).collect()[0].n == 2


def test_observable_keeper_prefers_favourites_then_bitrate_and_is_not_transitive(spark):
    rows = [dict(id=1, bitrate_kbps=320), dict(id=2, favorita=1), dict(id=3, duracion_seg=203.0), dict(id=4, duracion_seg=206.0), dict(id=5, titulo=" ")]
    got = {(r.id, r.conserva) for r in dedupe.observable_losers(tracks(spark, rows)).collect()}
    assert got == {(1, 2), (3, 2)}
    assert dedupe.observable_losers(tracks(spark, [])).count() == 0


def test_top_songs_need_enough_plays(spark):
    c = smartlists.candidates(tracks(spark, [dict(id=1, veces_reproducida=59), dict(id=2)]), plays(spark, []))
    assert smartlists.top_songs(c).count() == 0
    c = smartlists.candidates(tracks(spark, [dict(id=1, veces_reproducida=60), dict(id=2)]), plays(spark, []))
    assert [r.id for r in smartlists.top_songs(c).collect()] == [1]


def test_number_rows_over_pieces(spark):
    df = spark.createDataFrame([(k % 3, (k * 37) % 101, k) for k in range(300)], "g int, o int, k int")
    got = {(r.g, r.o, r.k): r.posicion for r in library.number_rows(df, ["g"], [F.asc("o"), F.asc("k")]).collect()}
    for g in range(3):
        for n, r in enumerate(sorted((x for x in got if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            assert got[r] == n


def test_search_is_blind_to_accents_and_finds_typing_errors(spark):
    t = tracks(spark, [dict(id=1, titulo="Corazón eterno", artista_nombre="Ana"), dict(id=2, titulo="Otra cosa", artista_nombre="Luz", veces_reproducida=99)])
    assert [r.id for r in search_tracks(t, "corazon").collect()] == [1]
    assert [r.id for r in search_tracks(t, "corason eterno", fuzzy=True).collect()] == [1]
    assert search_tracks(t, "zzz").count() == 0 and Question("de la").words == ["de", "la"]


def test_pages_cover_the_log_once(spark):
    log = spark.createDataFrame([("pista", k, k) for k in range(1, 26)], "entidad string, entidad_id long, version long")
    since, seen = 0, []
    while True:
        rows = sync.page(log, since, 10).collect()
        seen += [r.entidad_id for r in rows]
        since = rows[0].siguiente
        if not rows[0].hay_mas:
            break
    assert seen == list(range(1, 26))


def test_last_write_must_be_newer_and_dated(spark):
    local = spark.createDataFrame([(1, 0, T0), (2, 0, T0), (3, 0, None)], "id long, f int, t timestamp")
    remote = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + timedelta(seconds=1)), (3, 1, None), (3, 1, T0)], "id long, f int, t timestamp")
    assert {r.id: r.f for r in sync.last_write_wins(local, remote, "id", "f", "t").collect()} == {1: 0, 2: 1, 3: 1}


def test_weighted_mean_by_rows_equals_the_fold(spark):
    df = spark.createDataFrame([(1, k, float(k * k % 17)) for k in range(40)], "g long, k long, v double")
    m = None
    for x in (float(k * k % 17) for k in range(40)):
        if x > 0:
            m = x if m is None else 0.35 * x + 0.65 * m
    assert jobs.ewma_rows(df, "g", [F.desc("k")], "v").first().media == pytest.approx(m)
    assert one(spark, jobs.ewma(F.array(*[F.lit(float(k * k % 17)) for k in range(40)]))) == pytest.approx(m)


def test_index_actions(spark):
    lib = spark.createDataFrame([("/a", "h1"), ("/b", None)], "ruta_archivo string, hash_sha256 string")
    new = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "h1"), ("/d", "h9"), ("/e", None)], "ruta_archivo string, hash_sha256 string")
    got = {r.ruta_archivo: r.accion for r in changes.index_actions(new, lib).collect()}
    assert got == {"/a": "omitir", "/b": "actualizar", "/c": "rechazar", "/d": "insertar", "/e": "insertar"}


def test_move_and_cursor(spark):
    assert [one(spark, changes.move(F.lit(k), 2, 4)) for k in range(1, 6)] == [1, 4, 2, 3, 5]
    assert one(spark, changes.next_index(F.lit(4), F.lit(5), "all")) == 0 and one(spark, changes.next_index(F.lit(4), F.lit(5), "none")) is None


def test_fallback_filter_and_round(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert interface.keep_unless_empty(df, F.col("id") > 5).count() == 2 and interface.keep_unless_empty(df, F.col("id") > 1).count() == 1
    assert quality.sample_round(df, df, "id", 5, "s").count() == 2


def test_lyrics_and_prose(spark):
    assert one(spark, interface.synced_lyrics(F.lit("[00:01.00] a\n\n[00:59.5]  b  c"))) == "[00:01.00] a\n[00:59.5] b c"
    assert one(spark, interface.synced_lyrics(F.lit("[00:01.00] a\nno time"))) == ""
    assert one(spark, interface.document_like(F.lit("x" * 200))) is True and one(spark, interface.document_like(F.lit(""))) is False


def test_match_scores(spark):
    s = lambda a, b: one(spark, resolve.duration_score(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert (s(200, 203), s(200, 210), s(200, 230), s(200, 231), s(None, 1)) == (1.0, 0.5, 0.05, 0.0, 0.5)


def test_validation_names_the_first_failure(spark):
    assert one(spark, files.first_failure({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)})) == "b"


def test_suggestions_leave_out_the_recent_and_the_current_artist_as_long_as_something_remains(spark):
    rows = [dict(id=1), dict(id=2), dict(id=3, artista_id=2, album_id=2), dict(id=4, artista_id=2, album_id=3, favorita=1)]
    recent = spark.createDataFrame([(4,)], "pista_id long")
    assert [r.id for r in interface.suggest(tracks(spark, rows), recent, 1).collect()] == [3]
    everything = spark.createDataFrame([(2,), (3,), (4,)], "pista_id long")
    assert {r.id for r in interface.suggest(tracks(spark, rows), everything, 1).collect()} == {3, 4}


def test_distinct_covers_are_far_apart(spark):
    df = spark.createDataFrame([(1, k, k, h) for k, h in enumerate((0, 1, 0xFF, 0xFF00, 0xFFFF, 0xF0F0, 3))] + [(2, 50, 0, None)], "g long, id long, o long, h long")
    got = sorted((r.puesto, r.id) for r in smartlists.pick_distinct(df, "g", "id", "o", "h").collect())
    assert got == [(1, 0), (2, 2), (3, 3), (4, 4)]


def test_refined_order_keeps_the_first_and_all_tracks(spark):
    rows = [(1, k + 1, k, b, "8A", 0.5) for k, b in enumerate((100.0, 160.0, 101.0, 161.0, 102.0))]
    got = planner.refine_order(spark.createDataFrame(rows, "lista_id long, posicion long, pista_id long, bpm double, clave string, energy double")).orderBy("posicion").collect()
    assert got[0].pista_id == 0 and sorted(r.pista_id for r in got) == list(range(5))


def test_filter_or_all_and_promotion(spark):
    pairs = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False), (2, 4, None)], "id long, c_id long, ok boolean")
    assert {(r.id, r.c_id) for r in resolve.filter_or_all(pairs, F.col("ok")).collect()} == {(1, 1), (2, 3), (2, 4)}
    ev = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.7, True), (2, 3, 0.95, True), (2, 4, 0.9, True), (3, 5, 0.9, False)], "id long, c_id long, evidencia double, fuerte boolean")
    assert [(r.id, r.c_id, r.brecha) for r in resolve.promoted(ev).collect()] == [(1, 1, 0.2)]


def test_changes_of_equal_version_are_not_lost_between_pages(spark):
    log = spark.createDataFrame([(e, k, 5) for e in ("album", "pista") for k in range(1, 8)] + [("pista", 99, 6)], "entidad string, entidad_id long, version long")
    since, after, seen = 0, None, []
    while True:
        rows = sync.page(log, since, 4, after).collect()
        seen += [(r.entidad, r.entidad_id) for r in rows]
        since, after = rows[0].siguiente, (rows[0].siguiente_entidad, rows[0].siguiente_id)
        if not rows[0].hay_mas:
            break
    assert seen == [(e, k) for e in ("album", "pista") for k in range(1, 8)] + [("pista", 99)]


def test_free_names_fill_the_first_hole(spark):
    from tonalis.operators.library import free_names

    taken = spark.createDataFrame([(n,) for n in ("Mix", "Mix 2", "Mix 4", "Rock", "Rock 3", "Solo 2", None)], "nombre string")
    wanted = spark.createDataFrame([("Mix",), ("Rock",), ("Jazz",), ("Solo",), (None,)], "nombre string")
    assert {r.nombre: r.libre for r in free_names(wanted, taken).collect()} == {"Mix": "Mix 3", "Rock": "Rock 2", "Jazz": "Jazz", "Solo": "Solo"}


def test_this_is_exceeds_fifty_or_fills_with_similar_tracks(spark):
    own = [dict(id=k, artista_id=1, album_id=None, favorita=k % 2) for k in range(1, 101)]
    few = [dict(id=500 + k, artista_id=2) for k in range(10)] + [dict(id=600 + k, artista_id=3 + k // 6) for k in range(60)]
    c = tracks(spark, own + few).withColumn("plays", F.col("id") % 7)
    got = smartlists.this_is(c, 1).collect()
    assert len(got) == 80 and all(r.propia for r in got)
    got = smartlists.this_is(c, 2).collect()
    assert sum(r.propia for r in got) == 10 and len(got) > 25 and not {r.id for r in got if not r.propia} & {r.id for r in got if r.propia}


def test_error_classes_of_missing_modules(spark):
    for text, kind in (("No module named 'librosa'", "librosa_missing"), ("no module named soundfile", "soundfile_missing"), ("No module named audioread", "audioread_missing"), ("no module named x", "dependency_missing"), ("bad codec", "codec_error")):
        assert one(spark, features.error_class(F.lit(text))) == kind


def test_digests_of_files_equal_hashlib(spark, tmp_path):
    import hashlib

    from tonalis.sources import files

    body = {"b.bin": b"x" * 100, "c.bin": bytes(range(256)) * 10_000}
    for n, b in body.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.digests(files.scan_files(spark, str(tmp_path)), head=64, end=1000).collect()}
    for n, b in body.items():
        d = lambda x: hashlib.sha256(x).hexdigest()
        assert (got[n].entero, got[n].cabeza, got[n].extremos) == (d(b), d(b[:64]), d(b if len(b) <= 2000 else b[:1000] + b[-1000:]))


def concepts():
    from tonalis.operators.intents import Concept

    return (
        Concept("calma", ("tranquilo", "calma"), {"calmness": 0.8, "energy": -0.4}, role="priority", genres=("folk",), boosts=("noche",), opposites=("fiesta",)),
        Concept("noche", ("noche", "de noche"), {"night_score": 1.0, "calmness": 0.2}, 0.5, genres=("ambient", "jazz")),
        Concept("fiesta", ("fiesta",), {"energy": 1.0}, 1.0, opposites=("calma",)),
        Concept("metal", ("metal",), {"aggressiveness": 0.6}, 1.0, genres=("metal",)),
        Concept("muy", ("muy",), {}, role="strong"),
        Concept("poco", ("un poco",), {}, role="weak"),
    )


def test_phrases_with_negations_degrees_boosts_and_contradictions():
    from tonalis.operators.intents import parse

    x = parse("algo muy tranquilo sin metal", concepts())
    assert x.axes == pytest.approx({"calmness": 1.28, "energy": -0.64, "aggressiveness": -0.6}) and x.focus == ["calma"] and x.excluded == ["metal"] and x.excluded_genres == ["metal"]
    assert parse("sin fiesta pero metal", concepts()).axes == pytest.approx({"aggressiveness": 0.6, "energy": -1.0})
    assert parse("un poco fiesta", concepts()).axes == pytest.approx({"energy": 0.55})
    x = parse("tranquilo de noche", concepts())  # calma supports noche: the shared axis is raised
    assert x.axes == pytest.approx({"calmness": (0.8 + 0.1) * 1.25, "energy": -0.4, "night_score": 0.5}) and x.genres == pytest.approx({"folk": 1.0, "ambient": 0.25, "jazz": 0.25})
    x = parse("tranquilo o fiesta", concepts())  # of equal weights the later one stays
    assert x.contradictions == ["calma|fiesta"] and x.axes == pytest.approx({"energy": 1.0})
    assert parse("", concepts()).axes == {} and parse("nada conocido", concepts()).vector == [0.0] * len(parse("", concepts()).vector)


def test_tracks_are_scored_and_excluded(spark):
    from tonalis.operators import intents as I

    x = I.parse("tranquilo sin metal", concepts())
    feats = ", ".join(f"{f} double" for f in I.FEATURE_AXES)
    rows = [(1, "a", "b", "metal", ["x"], {"calmness": 1.0}, *[None] * len(I.FEATURE_AXES)), (2, "a", "b", None, ["metal"], {"calmness": 1.0}, *[0.5] * len(I.FEATURE_AXES)), (3, "calma", "b", "folk", None, {"calmness": float("nan")}, *[float("nan")] * len(I.FEATURE_AXES))]
    df = spark.createDataFrame(rows, f"id long, titulo string, artista_nombre string, genero string, vibe_tags array<string>, valores map<string,double>, {feats}")
    scored = df.select("*", I.track_score(x, concepts()).alias("puntaje"))
    full = {r.id: r.puntaje for r in scored.collect()}
    left = {r.id: r.puntaje for r in I.without_excluded(scored, x, concepts()).collect()}
    assert set(left) == {2, 3} and left[2] == pytest.approx(full[2] / 2) and left[3] == full[3] > 0
    got = I.intents(spark.createDataFrame([(1, "tranquilo"), (2, None)], "id long, t string"), concepts(), "id", "t")
    assert {r.id: dict(r.ejes) for r in got.collect()} == {1: {"calmness": 0.8, "energy": -0.4}, 2: {}}


def test_bm25_prefers_the_title_and_rare_words(spark):
    from tonalis.operators.search import match_tokens, search_bm25, token_index

    t = tracks(spark, [dict(id=1, titulo="luna llena", artista_nombre="sol"), dict(id=2, titulo="mar", artista_nombre="luna"), dict(id=3, titulo="sol"), dict(id=4, titulo="luna", estado="revision"), *[dict(id=k, titulo="otra") for k in range(5, 15)]])
    assert [r.id for r in search_bm25(t, "lun").collect()] == [1, 2] and search_bm25(t, "").count() == 0
    assert [r.id for r in match_tokens(token_index(t), "lun so").collect()] == [1] and match_tokens(token_index(t), "zz").count() == 0


def test_bounded_ratio_equals_the_sequence_ratio_from_its_limit_on():
    from difflib import SequenceMatcher
    from itertools import product

    from tonalis.operators.search import bounded_ratio

    for a, b in product(("cancion", "canson", "", "mar azul", "luz"), repeat=2):
        r = SequenceMatcher(None, a, b).ratio()
        assert bounded_ratio(a, b, 0.8) == (r if r >= 0.8 and (a or b) else 0.0)


def test_manifests_merge_by_entry_and_unite_sets(spark):
    schema = "g long, e long, v string, t long, s array<string>"
    old = spark.createDataFrame([(1, 1, "a", 5, ["x"]), (1, 2, "b", 5, ["y"])], schema)
    new = spark.createDataFrame([(1, 1, "A", 5, ["z", "x"]), (1, 2, "B", 4, None), (2, 9, "C", 1, [])], schema)
    got = {(r.g, r.e): (r.v, r.s) for r in changes.merged_entries(old, new, "g", "e", "t", ["s"]).collect()}
    assert got == {(1, 1): ("A", ["x", "z"]), (1, 2): ("b", ["y"]), (2, 9): ("C", [])}


def test_a_table_is_replaced_whole_and_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.swap_in(spark.range(3), path)
    changes.swap_in(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="(?i)divi"):
        changes.swap_in(spark.range(2).select((F.lit(1) / (F.col("id") * 0)).alias("x")), path)
    assert spark.read.parquet(path).count() == 5


def test_cascade_keeps_rows_without_a_parent_and_leaves_tombstones(spark):
    plays = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id long, pista_id long")
    left, tombs = changes.cascade(spark.createDataFrame([(7,), (7,), (None,)], "id long"), "id", {"h": (plays, "pista_id")}, 42)
    assert sorted(r.id for r in left["h"].collect()) == [2, 3] and [tuple(r) for r in tombs.collect()] == [("pista", 7, 42)]


def test_smoothed_and_queue_estimates(spark):
    steps = spark.createDataFrame([("r", 1, 2.0, 6), ("r", 2, 4.0, 6), ("r", 3, 9.0, 6), ("s", 1, 1.0, 3), ("u", 1, 1.0, 2), ("u", 2, 8.0, 2)], "run string, k int, e double, total int")
    got = {r.run: (r.hechos, r.resto) for r in jobs.smoothed_rest(steps, "run", "k", "e", "total").collect()}
    mean = 0.25 * 3.0 + 0.75 * 2.0  # after two items 4 s / 2, after three 9 s / 3
    assert got == {"r": (3, round(mean * 3)), "s": (1, None), "u": (2, None)}
    n = lambda *x: one(spark, jobs.queue_rest(*[F.lit(v) for v in x]))
    assert n(2, 5, 20.0, 0.0, 0.0) == 30.0 and n(0, 3, 0.0, 0.5, 10.0) == 50.0 and n(0, 3, 0.0, 0.01, 10.0) is None


def test_sources_are_fused(spark):
    rows = [(1, "Luz", "Ana", None, "Luz", "Ana", None, 0.95), (2, None, "", None, "Mar", "Eva", "US-ABC-12-34567", None), (3, "Luz", "Ana", None, None, None, None, 0.8), (4, "Luz", "Ana", None, "Otra", "Nadie", None, None)]
    df = spark.createDataFrame(rows, "id long, titulo string, artista_nombre string, isrc string, x_titulo string, x_artista string, x_isrc string, huella double")
    got = {r.id: r for r in resolve.fused(df).collect()}
    assert got[1].confianza == 0.55 and got[3].confianza == 0.15 and got[4].confianza == 0.0
    assert (got[2].titulo, got[2].artista, got[2].fuente_titulo, got[2].isrc, got[2].confianza) == ("Mar", "Eva", "externa", "USABC1234567", 0.30)


def test_hints_and_third_look(spark):
    assert one(spark, resolve.hint_evidence(F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(True))) == 1.0
    assert one(spark, resolve.hint_evidence(F.lit(0.5), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("boolean"))) == 0.275
    ev = spark.createDataFrame([(1, 1, 0.95, True), (1, 2, 0.80, True), (2, 3, 0.95, True), (3, 4, 0.95, True), (3, 5, 0.85, True)], "id long, c_id long, evidencia double, fuerte boolean")
    hints = spark.createDataFrame([(1, 0.8), (2, 0.79), (3, 0.9)], "id long, pista double")
    assert [r.id for r in resolve.third_look(ev, hints).collect()] == [1]


def test_picture_hashes_volumes_and_phases(spark):
    grey = F.array(*[F.lit(float(v)) for v in [10] * 32 + [200] * 32])
    h = one(spark, smartlists.picture_hash(grey, F.lit(255), F.lit(16), F.lit(0)))
    assert h.forma == 2**32 - 1 and h.color == 0xF10
    v = one(spark, planner.volumes(F.lit("harmonic_mix"), F.lit(0.5)))
    assert (v.sale, v.entra) == (0.7, 0.7) and one(spark, planner.volumes(F.lit("hard_cut"), F.lit(0.5))).entra == 1.0
    assert planner.phase_at("stable", 0.0) == ("warmup", planner.PHASE_TARGETS["warmup"]) and planner.phase_at("stable", 1.0)[0] == "cooldown"
    name, target = planner.phase_at("stable", 0.0999999)  # the end of a phase is the next one's target
    assert name == "warmup" and target == pytest.approx(planner.PHASE_TARGETS["groove"], abs=1e-4)


def test_playlists_close_over_tracks_albums_and_artists(spark):
    t = tracks(spark, [dict(id=1, album_id=10, artista_id=100), dict(id=2, album_id=None, artista_id=None), dict(id=3)])
    lists = spark.createDataFrame([(5,), (6,)], "id long")
    members = spark.createDataFrame([(5, 1), (5, 2), (6, 3), (5, 99)], "lista_id long, pista_id long")
    got = {(r.entidad, r.entidad_id) for r in sync.playlist_closure(t, lists, members, [5]).collect()}
    assert got == {("pista", 1), ("pista", 2), ("album", 10), ("artista", 100), ("lista", 5)}
    rows = spark.createDataFrame([(1, 0, 5), (2, 1, 9)], "id long, f int, version long")
    assert {r.id: (r.f, r.version) for r in sync.toggled(rows, spark.createDataFrame([(1,), (1,)], "id long"), "f").collect()} == {1: (1, 10), 2: (1, 9)}


def test_rules_dispatch_by_name_and_broken_ones_give_nothing(spark):
    lists = {"a": spark.createDataFrame([(k, k) for k in range(1, 80)], "id long, puesto int")}
    rules = spark.createDataFrame([(1, '{"regla": "a", "limite": 2}'), (2, '{"regla": "a"}'), (3, '{"regla": "b"}'), (4, "{"), (5, None)], "regla_id int, regla_json string")
    got = {}
    for r in smartlists.dispatched(rules, lists).collect():
        got.setdefault(r.regla_id, []).append(r.id)
    assert sorted(got[1]) == [1, 2] and len(got[2]) == 50 and set(got) == {1, 2}


def test_never_pool_falls_back_and_lacking_names_what_is_missing(spark):
    t = tracks(spark, [dict(id=1, veces_reproducida=1), dict(id=2, veces_reproducida=9)])
    none = spark.createDataFrame([], "pista_id long")
    assert [r.id for r in quality.never_pool(t, none).collect()] == [1]
    t = tracks(spark, [dict(id=1), dict(id=2), dict(id=3, veces_reproducida=1)])
    assert [r.id for r in quality.never_pool(t, spark.createDataFrame([(1,)], "pista_id long")).collect()] == [2]
    df = spark.createDataFrame([(1, None, "x"), (2, "y", "x")], "id long, a string, b string")
    assert [(r.id, r.faltan) for r in quality.lacking(df, "id", {"A": "a", "B": "b"}).collect()] == [(1, ["A"])]


def test_model_fields_of_broken_json_are_null(spark):
    m = one(spark, features.model_fields(F.lit('{"danceability": {"score": 1.4}, "audioset_vggish_embeddings": {"dim": 128}}')))
    assert m.danceability_model == 1.0 and m.embeddings_dim == 128 and m.mood_sad is None
    assert one(spark, features.model_fields(F.lit("{"))).danceability_model is None
    s = one(spark, features.intent_summary(F.lit("algo")))
    assert (s.intencion, s.etiqueta) == ("generic", "Selección musical general")
