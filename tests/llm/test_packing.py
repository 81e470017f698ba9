import numpy as np
import pytest

from tonalis.llm import packing

DOCS, BOXES = "doc_id long, text string, tokens string", "contenedor string, capacidad_tokens int, doc_id string"
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(packing.VOCABULARY), reason="no vocabulary file")


def packed(spark, docs, boxes):
    return packing.pack(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS), spark.createDataFrame([(*b, "") for b in boxes], BOXES)).collect()


def test_every_token_once_and_no_window_over_its_capacity(spark):
    words = ["sol", "luna", "mar", "viento", "tambor", "guitarra"]
    docs = [(i, " ".join(words[(i * j) % 6] for j in range(i % 90))) for i in range(400)] + [(900, "largo " * 700)]
    rows = packed(spark, docs, [("a", 64), ("b", 256)])
    enc = packing.encoding(packing.VOCABULARY)
    for box, size in (("a", 64), ("b", 256)):
        spans, fill = {}, {}
        for r in rows:
            if r.contenedor == box:
                spans.setdefault(r.doc_id, []).append((r.desde, r.hasta))
                fill[r.ventana] = fill.get(r.ventana, 0) + r.tokens
        assert max(fill.values()) <= size and sum(fill.values()) / (size * len(fill)) > 0.95
        for i, t in docs:
            n, at = len(enc.encode_ordinary(t)), 0
            assert len(spans[i]) == max(1, -(-n // size))
            for a, b in sorted(spans[i]):
                assert a == at
                at = b
            assert at == n


def test_nulls_empties_and_bad_containers(spark):
    rows = packed(spark, [(1, None), (2, ""), (None, "x"), (3, "hola")], [("a", 8), (None, 8), ("z", 0), ("a", 4)])
    assert {(r.contenedor, r.doc_id) for r in rows} == {("a", 1), ("a", 2), ("a", 3)} and len({r.ventana for r in rows}) == 1
    assert packed(spark, [], [("a", 8)]) == [] and packed(spark, [(1, "x")], []) == []


def test_neighbours_share_a_window():
    terms = [np.array([1, 2], dtype=np.int32), np.array([8, 9], dtype=np.int32)] * 3
    counts = [np.ones(2, dtype=np.int32)] * 6
    idf = np.ones(packing.BUCKETS, dtype=np.float32)
    index = packing._Index(terms, counts, idf, 2.0)
    size = np.full(6, 10)
    windows = packing.fill_windows(size, 30, index, np.arange(6))
    assert sorted(map(sorted, windows)) == [[0, 2, 4], [1, 3, 5]]


def test_best_fit_uses_the_largest_that_fits():
    assert [sorted(w) for w in packing.fill_windows(np.array([6, 5, 4, 3, 2]), 10)] == [[0, 2], [1, 3, 4]]


def test_all_terms_and_all_neighbours_of_a_seed_count():
    # the seed's 300 terms: one item shares only the last of them; 200 items share a term, all follow while they fit
    terms = [np.arange(300, dtype=np.int32)] + [np.array([k], dtype=np.int32) for k in range(100, 300)] + [np.array([999], dtype=np.int32)] * 2
    counts = [np.ones(len(t), dtype=np.int32) for t in terms]
    index = packing._Index(terms, counts, np.ones(packing.BUCKETS, dtype=np.float32), 2.0)
    assert (index.score[0, 1:201] > 0).all() and (index.score[0, 201:] == 0).all()
    size, how = np.array([50] + [1] * 202), np.empty(203, dtype=np.int8)
    windows = packing.fill_windows(size, 250, index, np.arange(203), how)
    assert sorted(windows[0]) == list(range(201)) and (how[1:201] == packing.NEIGHBOUR).all() and how[0] == packing.SEED


def test_shares_by_reason(spark):
    docs = [(i, "sol luna mar viento " * (i % 7 + 1)) for i in range(60)]
    made = packing.pack(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS), spark.createDataFrame([("a", 64, "")], BOXES), reasons=True)
    row = packing.placed(made).first()
    assert abs(row.semilla + row.vecinos + row.tamano - 1) < 1e-9 and row.vecinos > 0
