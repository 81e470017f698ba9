from tonalis.llm.garbled import Language, readings, restore

SCHEMA = "doc_id long, text string, source string, texto string"
CLEAN = "La canción más íntima del álbum repite el corazón de la sesión. Según contó después, la melodía también está en la grabación — «última» edición… ¿Qué será mañana? El órgano acompaña la percusión en São Paulo, coração. Тишина после концерта, голос и мелодия ищет рассвете."


def docs(extra):
    return [(k, CLEAN, f"s{k % 3}", "x") for k in range(1, 600)] + extra


def run(spark, extra):
    return {r.doc_id: r for r in restore(spark.createDataFrame(docs(extra), SCHEMA)).collect()}


def wrong(text, true, read):
    return text.encode(true).decode(read)


def test_swaps_are_found_and_restored(spark):
    text = "la canción más íntima, según contó después la grabación"
    extra = [(1001, wrong(text, "utf-8", "cp437"), "s1", ""), (1002, wrong(text, "cp1252", "cp850"), "s2", ""), (1003, wrong(wrong(text, "utf-8", "latin-1"), "utf-8", "latin-1"), "s1", ""), (1004, wrong("тишина после концерта, голос", "cp1251", "latin-1"), None, ""), (1005, text.upper(), "s1", ""), (1006, "la canci" + wrong("ó", "utf-8", "latin-1") + "n", "nuevo", "")]
    got = run(spark, extra)
    assert set(got) == {1001, 1002, 1003, 1004, 1006}
    assert got[1001].texto == got[1002].texto == got[1003].texto == text and got[1004].texto == "тишина после концерта, голос" and got[1006].texto == "la canción"


def test_lost_characters_are_reported(spark):
    got = run(spark, [(1001, "la canci�n m�s", "s1", "")])
    assert set(got) == {1001} and got[1001].perdidos == 2


def test_correct_text_nulls_empty_and_repeats(spark):
    extra = [(1001, None, "s1", ""), (1002, "", "s1", ""), (1003, "plain ascii only", None, ""), (1004, "CORAÇÃO MAÑANA ÁLBUM", "s1", ""), (1005, "½ × ± · Â l’ombre", "s1", "")]
    assert run(spark, extra) == {}
    bad = (1006, wrong("canción más íntima", "utf-8", "cp1252"), "s1", "")
    assert len(run(spark, [bad, bad])) == 1
    assert restore(spark.createDataFrame([], SCHEMA)).count() == 0


def test_readings_start_with_the_stored_one():
    assert "".join(m for _, m in readings("canciÃ³n")[0]) == "canciÃ³n"
    assert "canción" in {"".join(m for _, m in r) for r in readings("canciÃ³n")}


def test_bigrams_without_data_do_not_fail():
    assert Language([]).pair("a", "b") < 0


def test_a_very_long_text_with_one_garbled_word(spark):
    text = CLEAN * 700 + " canci" + wrong("ó", "utf-8", "latin-1") + "n " + CLEAN * 10
    got = run(spark, [(1001, text, "s1", ""), (1002, CLEAN * 700, "s1", "")])
    assert set(got) == {1001} and got[1001].palabras == 1 and " canción " in got[1001].texto


def test_damage_whose_bigrams_are_usual_in_the_corpus_is_still_compared_with_the_other_readings():
    from collections import Counter

    import pandas as pd

    from tonalis.llm import garbled as G

    bad = wrong(CLEAN.split(" —")[0], "cp1252", "mac_roman")
    seen = Counter((source, t) for source, text in (("a", CLEAN), ("b", CLEAN), ("roto", bad)) for _ in range(60) for t in text.split(" "))
    rows = pd.DataFrame([(t, n) for (_, t), n in seen.items()], columns=["token", "clean"])
    pairs = pd.concat(G._count_pairs([rows]))
    cipher = G.Cipher(Language([(chr(a), chr(b), n) for a, b, n in pairs.itertuples(index=False)]))
    ways = {t: G.weighed(t, cipher.language) for _, t in seen if not t.isascii()}
    for _ in range(G.ROUNDS):
        cipher.learn([e for (source, t), n in seen.items() if t in ways for e in cipher.expect(source, ways[t], n)])
    stored = wrong("íntima", "cp1252", "mac_roman")
    assert cipher.decide("roto", stored)[:2] == (True, "íntima")
    assert cipher.decide("a", "íntima")[0] is False


def test_every_source_has_its_own_cipher_however_many_there_are(spark):
    """900 sources, one of which swaps pages: its damage is restored, and what is correct elsewhere stays."""
    page = "la canción más íntima según contó después la grabación"
    broken = [(5000 + k, wrong(page, "cp1252", "mac_roman"), "roto", "") for k in range(30)]
    got = run(spark, [(2000 + k, page, f"fuente {k}", "") for k in range(900)] + broken)
    assert set(got) == {i for i, *_ in broken} and {r.texto for r in got.values()} == {page}


def test_a_large_source_is_dealt_over_several_tasks(spark, monkeypatch):
    from tonalis.llm import garbled as G

    extra = [(1001, "la " + wrong("canción más íntima", "utf-8", "cp437"), "s1", ""), (1002, wrong("según contó después", "utf-8", "cp1252"), "s2", "")]
    whole = {i: r.texto for i, r in run(spark, extra).items()}
    monkeypatch.setattr(G, "CELL_TOKENS", 7)
    assert {i: r.texto for i, r in run(spark, extra).items()} == whole and set(whole) == {1001, 1002}
