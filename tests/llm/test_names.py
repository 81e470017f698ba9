import random

from tonalis.llm.names import core_cost, edits, jaro_winkler, link_spellings, parse, sound, spelling_pairs, typing_cost, within_edits


def groups(spark, names):
    df = link_spellings(spark.createDataFrame([(n, 1) for n in names], "nombre string, entidad int"))
    by = {}
    for r in df.collect():
        by.setdefault(r.entidad, set()).add(r.nombre)
    return sorted(map(sorted, by.values()))


def test_measures():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert edits("hermanos", "hremanos") == 1 and edits("abc", "") == 3
    assert sound("zirgervon") == sound("sirjerbon")


def test_parse():
    assert parse("Runchorux, Gérard") == ("runchorux", ["gerard"], False) == parse("GÉRARD_RUNCHORUX - Topic")
    assert parse("Xavier & Paty Rergorzoz")[2] and parse("Las Kirgachox") == ("kirgachox", ["@"], False)
    assert parse("Mario Gómez") == ("gomez", ["mario"], False) and parse("Msrgaret Gómez") == ("gomez", ["margaret"], False) and parse("Ttío Gómez")[1] == ["roberto|trio"]
    assert parse("VV.AA.") is None and parse("") is None and parse("Artista  Desconocido") is None and parse("—") is None


def test_typos_reordering_nicknames_initials_and_glued_names_link(spark):
    names = ["Gérard Runchorux", "gerard runchorux", "Runchorux, Gérard", "Gréard Runchorux", "Gérard Runchroux", "Gégé Runchorux", "G. Runchorux", "GérardRunchorux", "Gérard «Gégé» Runchorux"]
    assert groups(spark, names) == [sorted(names)]


def test_a_shared_surname_is_no_link_and_unclear_initials_stay_alone(spark):
    names = ["Teresa Vudronez", "Tomás Vudronez", "Roberto Vudronez", "T. Vudronez", "Teresa y Roberto Vudronez"]
    assert groups(spark, names) == sorted([[n] for n in names])


def test_nulls_empties_labels_repeats_and_empty_table(spark):
    assert groups(spark, [None, "", "  ", "Varios Artistas", "Unknown Artist", "Solo Uno", "Solo Uno"]) == [["Solo Uno"]]
    df = spark.createDataFrame([], "nombre string, entidad int")
    assert link_spellings(df).count() == 0


def test_pairs_are_in_binary_order(spark):
    df = spark.createDataFrame([("b", 1), ("é", 1), ("Z", 1), ("x", 2)], "nombre string, entidad long")
    assert {(r.nombre_a, r.nombre_b) for r in spelling_pairs(df).collect()} == {("Z", "b"), ("Z", "é"), ("b", "é")}


def test_reordered_names_outside_the_table_link(spark):
    names = ["Carlos Pérez", "Pérez Carlos", "PEREZ CARLOS", "Perez Crlos", "Carla Pérez", "Carlos Gómez", "Gómez Pérez"]
    assert groups(spark, names) == sorted([sorted(names[:4]), ["Carla Pérez"], ["Carlos Gómez"], ["Gómez Pérez"]])


def test_typing_cost():
    assert typing_cost("gomez", "gomez") == 0 and typing_cost("gomez", "gomwz") == 0.5 == typing_cost("gomez", "ogmez") == typing_cost("gomez", "gommez")
    assert typing_cost("gomez", "gmez") == 0.8 and typing_cost("gomez", "gopez") == 1.2
    assert core_cost("firrdabel", "fordabel") is not None and core_cost("gomez", "lopez") is None and core_cost("abc", "abd") is None


def test_very_long_names_do_not_grow_without_bound(spark):
    long = "Isabel " + "pneumo" * 4000
    assert groups(spark, [long, long.upper(), "x " * 3000]) == sorted([sorted([long, long.upper()]), ["x " * 3000]])


def planted(seed, artists):
    """Invented artists with typed variants: (spelling, artist). Half of the given names stand in no table."""
    rng = random.Random(seed)
    part = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "l", "s"])
    given = ["isabel", "eduardo", "roberto", "patricia", "wenceslao", "begoña", "hildegard", "thorsten", "marisol", "evaristo"]
    out, taken = [], set()
    while len(taken) < artists:
        core, first = part() + part() + part() + rng.choice("zxnr"), rng.choice(given)
        if core[:4] in taken:  # no two artists that a person could confuse
            continue
        taken.add(core[:4])
        name = f"{first.title()} {core.title()}"
        k = rng.randrange(1, len(core) - 2)
        swapped = core[:k] + core[k + 1] + core[k] + core[k + 2 :]
        j = rng.randrange(1, len(core))
        out += [(v, core) for v in {
            name, name.upper(), name.lower().replace(" ", "_"), f"{core.title()}, {first.title()}", f"{first.title()} {swapped.title()}", f"{first.title()} {(core[:j] + core[j] + core[j:]).title()}",
            f"{first.title()}  {(swapped[:2] + swapped[1:]).title()}", f"{first[0].upper()}. {core.title()}", f"{name} (Oficial)", f"{name} Records", name.replace(" ", "  "),
        }]
    return out


def test_recall_and_precision_on_planted_variants(spark):
    rows = planted(5, 150)
    df = link_spellings(spark.createDataFrame([(n, 1) for n, _ in rows], "nombre string, entidad int"))
    found = {r.nombre: r.entidad for r in df.collect()}
    true, by = {}, {}
    for n, a in rows:
        true.setdefault(a, set()).add(n)
        by.setdefault(found[n], set()).add(a)
    whole = sum(len(v) * (len(v) - 1) // 2 for v in true.values())
    hit = sum(found[x] == found[y] for v in true.values() for x in v for y in v if x < y)
    assert hit / whole >= 0.97, hit / whole
    assert all(len(v) == 1 for v in by.values())


def test_long_cores_are_compared_in_a_band():
    long = "pneumo" * 2000
    assert within_edits(long, long[:5000] + "x" + long[5000:9000] + long[9001:], 2) and not within_edits(long, "x" + long[:-3], 2)
    assert core_cost(long, long[:7] + "q" + long[8:]) is not None and core_cost(long, long[::-1]) is None
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        plain = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            plain.append([i])
            for j, y in enumerate(b, 1):
                plain[i].append(min(plain[i - 1][j] + 1, plain[i][j - 1] + 1, plain[i - 1][j - 1] + (x != y)))
        assert all(within_edits(a, b, k) == (plain[-1][-1] <= k) for k in range(4))


def test_a_slip_that_many_names_share_is_no_head_of_its_own(spark):
    rng = random.Random(9)
    part = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    cores = list({(c := part() + part() + part() + part())[:4]: c.title() for _ in range(4000)}.values())[:300]
    names = [f"Alejandro {c}" for c in cores] + [f"Alejanrdo {c}" for c in cores[:14]]
    found = {r.nombre: r.entidad for r in link_spellings(spark.createDataFrame([(n, 1) for n in names], "nombre string, entidad int")).collect()}
    assert all(found[f"Alejanrdo {c}"] == found[f"Alejandro {c}"] for c in cores[:14])


def test_an_abbreviation_with_a_mistyped_core_takes_the_nearest_one(spark):
    names = ["Gérard Runchorux", "Gabriela Runchoruz", "G. Runchroux"]
    assert groups(spark, names) == [["G. Runchroux", "Gérard Runchorux"], ["Gabriela Runchoruz"]]
