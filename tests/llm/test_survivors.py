from datetime import datetime, timedelta

from tonalis.llm.survivors import current_rows, group_orders, grouped, learn_precedence, survivors, without_cycles

SCHEMA = "id long, isrc string, hash_sha256 string, mb_recording_id string, bitrate_kbps int, actualizado_en timestamp_ntz, estado string, root string"
T0 = datetime(2024, 1, 1)
H, M = "ab" * 32, "12345678-1234-1234-1234-1234567890ab"


def row(i, isrc=None, h=None, m=None, b=None, t=0, estado="biblioteca"):
    return (i, isrc, h, m, b, None if t is None else T0 + timedelta(days=t), estado, "x")


def found(spark, rows):
    return {(r.grupo_id, r.campo): r.pista_id for r in survivors(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_identifiers_are_compared_in_one_form_and_link_through_other_rows(spark):
    rows = [row(3, isrc="ISRC us-abc-12-34567", b=128, t=1), row(2, isrc="USABC1234567", h="sha256:" + H.upper(), b=320, t=2), row(5, h=H, m="urn:uuid:{" + M + "}", t=9), row(7, m=M.upper(), b=64, t=3)]
    assert found(spark, rows) == {(2, "isrc"): 2, (2, "hash_sha256"): 5, (2, "mb_recording_id"): 5, (2, "bitrate_kbps"): 2, (2, "registro"): 2}


def test_fillers_and_impossible_values_link_nothing(spark):
    rows = [row(1, isrc="US0000000000", h="0" * 64, m="f" * 32), row(2, isrc="US0000000000", h="0" * 64, m="f" * 32), row(3, isrc=""), row(4, isrc="")]
    assert found(spark, rows) == {}
    got = found(spark, [row(1, h=H, b=10), row(2, h=H, b=2001)])
    assert (1, "bitrate_kbps") not in got and got[1, "registro"] == 1


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert found(spark, [row(1, h=H)] * 3) == {}
    assert found(spark, [row(None, h=H), row(1, h=H)]) == {}
    assert found(spark, []) == {}


def test_ties_go_to_the_smallest_id(spark):
    got = found(spark, [row(9, h=H, b=128), row(4, h=H, b=128)])
    assert got[4, "hash_sha256"] == 4 and got[4, "bitrate_kbps"] == 4 and got[4, "registro"] == 4


def history(n=6):
    out = []
    for k in range(n):
        h = f"{k + 1:02x}" * 31 + "9a"
        out += [row(100 + 2 * k, h=h, t=1, estado="cuarentena"), row(101 + 2 * k, h=h, t=5, estado="biblioteca")]
    return out


def test_precedence_is_learned_and_places_rows_without_a_time(spark):
    rows = [*history(), row(1, h=H, t=9, estado="cuarentena"), row(2, h=H, t=None, estado="biblioteca"), row(3, h=H, t=None, estado="cuarentena")]
    learned = learn_precedence(grouped(spark.createDataFrame(rows, SCHEMA)))
    assert [(r.antes, r.despues) for r in learned.collect()] == [("cuarentena", "biblioteca")]
    assert found(spark, rows)[1, "hash_sha256"] == 2  # later than the dated row by its state
    rows = [*history(), row(1, h=H, t=9, estado="biblioteca"), row(2, h=H, t=None, estado="cuarentena")]
    assert found(spark, rows)[1, "hash_sha256"] == 1
    rows = [*history(), row(1, h=H, t=None, estado="cuarentena"), row(2, h=H, t=None, estado="biblioteca")]
    assert found(spark, rows)[1, "hash_sha256"] == 2


def test_cycles_of_precedence_are_opened_and_orders_stay_within_a_group(spark):
    df = spark.createDataFrame([("estado", "a", "b", 5), ("estado", "b", "c", 5), ("estado", "c", "a", 3)], "campo string, antes string, despues string, n long")
    order = without_cycles(df)
    assert {(r.antes, r.despues) for r in order.collect()} == {("a", "b"), ("b", "c")}
    values = spark.createDataFrame([(1, "estado", v) for v in "abc"] + [(2, "estado", v) for v in "ac"] + [(3, "bitrate_kbps", v) for v in "ab"], "root long, campo string, valor string")
    # without b in the group there is no path from a to c
    assert {(r.root, r.antes, r.despues) for r in group_orders(values, order).collect()} == {(1, "a", "b"), (1, "b", "c"), (1, "a", "c")}


def test_values_without_a_path_leave_the_dated_row(spark):
    rows = [*history(), row(1, h=H, t=9, estado="otra"), row(2, h=H, t=None, estado="biblioteca")]
    assert found(spark, rows)[1, "hash_sha256"] == 1
    got = {(r.campo): (r.pista_id, r.por_orden) for r in current_rows(spark.createDataFrame([*history(), row(1, h=H, t=9, estado="cuarentena"), row(2, h=H, t=None)], SCHEMA)).filter("grupo_id = 1").collect()}
    assert got["hash_sha256"] == (2, True) and got["registro"] == (1, False)


def test_transitions_of_two_fields_that_disagree_decide_nothing(spark):
    up = [row(300 + k, h=f"{k // 2 + 1:02x}" * 31 + "8b", b=(128, 320)[k % 2], t=1 + k % 2, estado="x") for k in range(8)]
    base = [*history(), *up]
    # the state says later, the bitrate says earlier
    assert found(spark, [*base, row(1, h=H, b=320, t=9, estado="cuarentena"), row(2, h=H, b=128, t=None, estado="biblioteca")])[1, "hash_sha256"] == 1
    assert found(spark, [*base, row(1, h=H, b=128, t=9, estado="cuarentena"), row(2, h=H, b=320, t=None, estado="cuarentena")])[1, "hash_sha256"] == 2


def test_planted_missing_times_are_recovered_by_the_order(spark):
    """Records age x -> y -> z; the times of a third of the latest rows are taken away, and the order finds them again."""
    rows, true = [], {}
    for k in range(60):
        h = f"{k + 1:02x}" * 31 + "7c"
        for n, s in enumerate("xyz"):
            rows.append(row(1000 + 10 * k + n, h=h, t=None if k % 3 == 0 and s == "z" else 10 * n + k % 5, estado=s))
        true[1000 + 10 * k] = 1002 + 10 * k
    got = found(spark, rows)
    assert {g: i for (g, c), i in got.items() if c == "hash_sha256"} == true


def test_a_hot_identifier_is_one_group(spark):
    rows = [row(i, h=H, b=32 + i, t=i % 7) for i in range(1, 1500)]
    got = found(spark, rows)
    assert got[1, "bitrate_kbps"] == 1499 and len(got) == 3
