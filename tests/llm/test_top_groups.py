from tonalis.llm.top_groups import top_items

ITEMS, PARENTS = "sesion_id long, pista_id long, score_total double, descartada boolean, artista_id string", "id long, artista_id long, score_total int"


def top(spark, items, parents, n=2):
    df = top_items(spark.createDataFrame(items, ITEMS), spark.createDataFrame(parents, PARENTS), item="pista_id", tie="sesion_id", score="score_total", parent_id="id", group="artista_id", n=n, rejected="descartada")
    return sorted((r.artista_id, r.puesto, r.sesion_id, r.pista_id) for r in df.collect())


def test_ties_by_item_then_session_and_repeats_once(spark):
    items = [(2, 10, 0.9, False, "x"), (1, 10, 0.9, False, "x"), (1, 10, 0.9, False, "x"), (1, 11, 0.9, None, "x"), (1, 12, 0.95, True, "x")]
    assert top(spark, items, [(10, 1, 0), (11, 1, 0), (12, 1, 0)], 3) == [(1, 1, 1, 10), (1, 2, 2, 10), (1, 3, 1, 11)]


def test_null_and_nan_scores_null_groups_and_orphans_do_not_compete(spark):
    items = [(1, 1, None, False, ""), (1, 1, float("nan"), False, ""), (2, 1, -0.5, False, ""), (1, 2, 0.7, False, ""), (1, 99, 0.8, False, ""), (None, 1, 0.9, False, "")]
    assert top(spark, items, [(1, 5, 0), (2, None, 0), (None, 5, 0)]) == [(5, 1, 2, 1)]


def test_empty_and_hot_group(spark):
    assert top(spark, [], [(1, 1, 0)]) == [] and top(spark, [(1, 1, 0.5, False, "")], []) == []
    items = [(s, p, ((s * 31 + p * 17) % 100) / 100, False, "") for s in range(40) for p in range(50)]
    want = sorted(items, key=lambda r: (-r[2], r[1], r[0]))[:5]
    assert [(s, p) for _, _, s, p in top(spark, items, [(p, 1, 0) for p in range(50)] * 2, 5)] == [(r[0], r[1]) for r in want]


def test_the_group_limit_runs_before_each_shuffle(spark):
    df = top_items(spark.createDataFrame([(1, 1, 0.5, False, "")], ITEMS), spark.createDataFrame([(1, 1, 0)], PARENTS), item="pista_id", tie="sesion_id", score="score_total", parent_id="id", group="artista_id")
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
