"""The k most similar vectors of every vector: inverted lists of randomly rotated one-bit codes, reranked by error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.llm.top_groups import rank_limit
from tonalis.materialise import discard, materialise, spread

#: The axes of a track's vector (fixed values of the project).
AXES = (
    "acoustic_weight", "aggressiveness", "bass_weight", "brightness", "calmness", "cinematic_level", "club_energy", "danceability",
    "darkness", "electronic_weight", "energy", "euphoria", "focus_score", "instrumental_focus", "melancholy", "night_score",
    "orchestral_weight", "rhythmic_density", "storytelling", "tension", "vocal_female", "vocal_focus", "vocal_male", "workout_score",
)
NEUTRAL = 0.5
#: Rows that the lists' centres are fitted on at most (every row is indexed), and the largest number of centres of one level.
FIT_ROWS, MAX_CENTRES = 50_000, 4096
#: Vectors of a list on average: the number of lists grows with the table, the work for a vector does not.
LIST_ROWS = 1024
#: Lists up to which the table of their pieces (a row a list) is broadcast.
BROADCAST_LISTS = 200_000
#: Lists that a vector is looked for in; half-width of the error bound in standard deviations.
PROBES, WIDTH = 10, 2.5
#: Bits of a code, bits of a query's coordinate; index rows and queries of one task.
BITS, QUERY_BITS = 64, 4
CHUNK, QUERIES = 16_384, 65_536


def axis_vector(values: str, axes: Sequence[str] = AXES) -> Column:
    """The map column ``values`` as an array; an axis that is absent, null or not finite is neutral."""

    def axis(a: str) -> Column:
        v = F.element_at(F.col(values), F.lit(a)).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v + F.lit(0.0)).otherwise(F.lit(NEUTRAL))

    return F.array(*[axis(a) for a in axes])


def _rotation(dim: int) -> np.ndarray:
    """BITS x dim: the columns of a random rotation that the padded vector meets (fixed seed)."""
    q, _ = np.linalg.qr(np.random.default_rng(20240117).normal(size=(max(BITS, dim), max(BITS, dim))))
    return q[:BITS, :dim] if dim <= BITS else q[:BITS] * math.sqrt(dim / BITS)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(s, min(s + size, n)) for s in range(0, n, size))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of the inverted lists by k-means over unit vectors (fixed seed)."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for b in _blocks(len(sample), 4096):
            own = (2 * sample[b] @ centres.T - (centres**2).sum(1)).argmax(1)
            np.add.at(total, own, sample[b])
            count += np.bincount(own, minlength=len(centres))
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def _residuals(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = np.concatenate([(2 * data[b] @ centres.T - (centres**2).sum(1)).argmax(1) for b in _blocks(len(data), 4096)])
    return data - centres[own]


def fit_lists(sample: np.ndarray, wanted: int, most: int = MAX_CENTRES) -> tuple[np.ndarray, np.ndarray]:
    """Centres of two levels: a list's centre is the sum of one of each. Up to ``most`` lists the second level is the origin alone;
    beyond it refines every cell, so that ``most`` squared lists are told apart by two small tables."""
    first = fit_centres(sample, max(1, min(wanted, most, len(sample))))
    fine = min(-(-wanted // len(first)), most, len(sample))
    second = fit_centres(_residuals(sample, first), fine) if fine > 1 else np.zeros((1, sample.shape[1]))
    return first, second


def nearest_lists(u: np.ndarray, first: np.ndarray, second: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the lists nearest to each vector, nearest first: the best cells of the first level with all their refinements."""
    near, width = [], min(probes, len(first) * len(second))
    for b in _blocks(len(u), max(1, 4_000_000 // (len(first) + probes * len(second)))):
        v = u[b]
        far = (first**2).sum(1) - 2 * v @ first.T
        cells = np.argpartition(far, width - 1, axis=1)[:, :width] if width < len(first) else np.tile(np.arange(len(first)), (len(v), 1))
        far = np.take_along_axis(far, cells, 1)[:, :, None] + ((second**2).sum(1) - 2 * v @ second.T)[:, None, :] + 2 * (first @ second.T)[cells]
        number, far = (cells[:, :, None] * len(second) + np.arange(len(second))).reshape(len(v), -1), far.reshape(len(v), -1)
        part = np.argpartition(far, width - 1, axis=1)[:, :width] if width < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(v), 1))
        best = np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable"), 1)
        near.append(np.take_along_axis(number, best, 1))
    return np.concatenate(near).astype(np.int32) if near else np.empty((0, width), dtype=np.int32)


def _encode(batches: Iterable[pd.DataFrame], first: np.ndarray, second: np.ndarray, rotation: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """The lists to look in (the first is the vector's own), code and correction scalars of each vector."""
    for batch in batches:
        u = _unit(np.array(batch["vec"].tolist(), dtype=np.float64).reshape(len(batch), -1))
        near = nearest_lists(u, first, second, probes)
        rest = u - first[near[:, 0] // len(second)] - second[near[:, 0] % len(second)]
        turned = rest @ rotation.T
        norm = np.linalg.norm(rest, axis=1)
        sign = turned >= 0
        code = np.packbits(sign, axis=1, bitorder="little").view("<i8").reshape(-1)
        # <code, vector> of unit length: what the estimate is divided by
        align = np.divide(np.abs(turned).sum(1) / math.sqrt(BITS), norm, out=np.ones(len(u)), where=norm > 0)
        yield pd.DataFrame({"cls": batch["cls"], "ids": batch["ids"], "probes": list(near), "code": code, "norm": norm, "align": align, "unit": [x.tobytes() for x in u], "vec": batch["vec"]})


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    one = column.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False), one.value_lengths().to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _search(index: pa.Table, queries: pa.Table, centre: np.ndarray, rotation: np.ndarray, k: int) -> pa.Table:
    """For each query the k+1 best ids of one piece of a list, by exact similarity of the vectors that the bounds let through."""
    dim = len(centre)
    o, code = _matrix(index["unit"], dim), index["code"].to_numpy().view(np.uint64)
    norm, align = index["norm"].to_numpy(), index["align"].to_numpy()
    first = index["cls"].to_numpy()
    members, many = _lists(index["ids"])
    offset = np.concatenate([[0], np.cumsum(many)])
    ones = np.bitwise_count(code).astype(np.float32)
    scale = (norm / align / math.sqrt(BITS)).astype(np.float32)
    spread_o = (norm * np.sqrt(np.maximum(0, 1 - align**2)) / align / math.sqrt(BITS - 1) * WIDTH).astype(np.float32)
    base_o = (o @ centre - centre @ centre).astype(np.float32)
    fixed = np.stack([ones * scale, scale, base_o, np.ones_like(scale)])
    q_all, q_id = _matrix(queries["of"], dim), queries["asked"].to_numpy()
    top = min(k + 1, len(o))
    out_q, out_n, out_id, out_sim = [], [], [], []
    for b in _blocks(len(q_all), max(1, min(512, 64_000 // max(1, len(o))))):
        q = q_all[b]
        rest = q - centre
        turned = rest @ rotation.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        total = np.zeros((len(q), len(o)), dtype=np.uint16)
        for bit in reversed(range(QUERY_BITS)):
            plane = np.packbits((level >> bit) & 1, axis=1, bitorder="little").view("<u8").reshape(-1, 1)
            total <<= 1
            total += np.bitwise_count(plane & code)
        # the estimate is 2 * (step * total + low * ones) - sum, scaled; all but the first term is a product of a few columns
        own = np.stack([2 * low, -turned.sum(axis=1), np.ones(len(q)), q @ centre], axis=1).astype(np.float32)
        guess = total * (2 * step[:, None]).astype(np.float32)
        guess *= scale
        guess += own @ fixed
        some = np.argpartition(guess, len(o) - top, axis=1)[:, len(o) - top :] if top < len(o) else np.tile(np.arange(len(o)), (len(q), 1))
        floor = np.round(np.einsum("qd,qtd->qt", q, o[some]), 6).min(axis=1)  # top of them are at least this near
        guess += np.linalg.norm(rest, axis=1)[:, None].astype(np.float32) * spread_o + np.float32(2e-6)
        guess[np.arange(len(q))[:, None], some] = np.inf
        row, col = np.nonzero(guess >= floor[:, None].astype(np.float32) - np.float32(1e-6))
        sim = np.empty(len(row))
        for s in _blocks(len(row), 200_000):
            sim[s] = np.einsum("pd,pd->p", q[row[s]], o[col[s]])
        sim = np.round(sim, 6)
        keep = sim >= floor[row]
        row, col, sim = row[keep], col[keep], sim[keep]
        for best_of in ("class", "id"):  # the best k+1 classes, then the best k+1 of their ids
            if best_of == "id":
                length = many[col]
                at = np.repeat(offset[col] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(col) else np.empty(0, dtype=np.int64)
                row, sim, col = np.repeat(row, length), np.repeat(sim, length), members[at]
            name = first[col] if best_of == "class" else col
            order = np.lexsort((name, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(q)))[:-1]])
            keep = np.arange(len(row)) - begin[row] <= k
            row, col, sim = row[keep], col[keep], sim[keep]
        out_q.append(q_id[b])
        out_n.append(np.bincount(row, minlength=len(q)))
        out_id.append(col)
        out_sim.append(sim)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(out_n))]).astype(np.int32))
    return pa.table({"cls": np.concatenate(out_q), "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_id))), "sims": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_sim)))})


def nearest(vectors: DataFrame, *, id_col: str, vector: Column, k: int = 5) -> DataFrame:
    """(id, vecino_id, puesto, similitud): the k nearest of every row by cosine similarity rounded to 6 decimals.

    Equal similarity goes to the smaller id; a row is never its own neighbour. The search is approximate: a vector is looked
    for in the PROBES lists nearest to it, and inside a list every vector is estimated from its one-bit code; those whose error
    bound reaches the k-th best are compared exactly. Recall is measured against brute force in the tests.

    Defined cases: rows without id or vector take no part; a vector of norm 0 has similarity 0 with all and gets the smallest ids;
    equal vectors are one class, so any number of copies costs one comparison; a repeated id counts once (with each of its
    different vectors); fewer than k other rows give what there is; an empty table gives an empty result; further
    columns are ignored.

    Plan: classes of equal vectors (group limit before the shuffle); centres fitted on at most FIT_ROWS of them; one
    table of codes; index and queries meet by (list, piece of the list, block of queries), each of bounded size; the best of each
    piece are merged per class. A list has LIST_ROWS vectors on average whatever the size of the table, so the work grows in
    proportion to it. Broadcast: two levels of centres (at most MAX_CENTRES rows each) and the rotation.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    few = rank_limit(base.distinct(), ["vec"], [F.asc("id")], k + 1)
    kept = materialise(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("vec", "ids", F.col("ids")[0].alias("cls")), "classes")
    classes = spread(kept, "cls")
    total = classes.count()
    sample = [r.vec for r in classes.select("vec", F.xxhash64("cls").alias("h"), "cls").orderBy("h", "cls").limit(FIT_ROWS).collect()]
    least = [r.id for r in base.select("id").distinct().orderBy("id").limit(k + 1).collect()]
    dim = len(sample[0]) if sample else 1
    data = _unit(np.array(sample, dtype=np.float64).reshape(-1, dim))
    first, second = fit_lists(data, max(1, round(total / LIST_ROWS))) if len(data) else (np.zeros((1, dim)), np.zeros((1, dim)))
    model = spark.sparkContext.broadcast((first, second, _rotation(dim)))
    coded = materialise(
        classes.mapInPandas(lambda it: _encode(it, *model.value, PROBES), "cls long, ids array<long>, probes array<int>, code long, norm double, align double, unit binary, vec array<double>"), "codes"
    )
    at = coded.select("cls", "ids", "code", "norm", "align", "unit", F.col("probes")[0].alias("list"))
    ask = coded.select(F.col("cls").alias("asked"), F.col("unit").alias("of"), F.explode("probes").alias("list"))
    # a row a list: how many pieces its vectors and its queries are cut into
    cuts = at.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("pieces")).join(ask.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "list")
    written = materialise(cuts, "cuts")
    cuts = F.broadcast(written) if written.count() <= BROADCAST_LISTS else written
    index = at.join(cuts, "list").select("cls", "ids", "code", "norm", "align", "unit", "list", F.expr("pmod(xxhash64(cls, 1), pieces)").cast("int").alias("piece"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    wanted = ask.join(cuts, "list").select("asked", "of", "list", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), F.expr("pmod(xxhash64(asked, 2), blocks)").cast("int").alias("block"))

    def piece(i: pa.Table, q: pa.Table) -> pa.Table:
        if not len(i) or not len(q):
            return pa.table({"cls": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float64()))})
        one, two, r = model.value
        cell, fine = divmod(i["list"][0].as_py(), len(two))
        return _search(i, q, one[cell] + two[fine], r, k)

    keys = ["list", "piece", "block"]
    part = index.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(piece, "cls long, ids array<long>, sims array<double>")
    merged = part.select("cls", F.arrays_zip(F.transform("sims", lambda s: -s).alias("n"), F.col("ids").alias("id")).alias("c")).groupBy("cls").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("best"))
    zero = F.array(*[F.struct(F.lit(0.0).alias("n"), F.lit(i).cast("long").alias("id")) for i in least]) if least else F.col("best")
    best = coded.select("cls", F.col("ids").alias("own"), "vec", F.forall("vec", lambda x: x == 0).alias("flat")).join(merged, "cls").withColumn("best", F.when(F.col("flat"), zero).otherwise(F.col("best")))
    best = materialise(best.select("own", "vec", "best"), "best")
    for table in (kept, coded, written):
        discard(table)
    mine = best.select(F.explode("own").alias("id"), "best")
    # classes with more members than the list holds: the rest are joined by vector, salted because one class may be a third of all
    salts = 32
    big = best.filter(F.size("own") > k).select("own", F.col("vec").alias("v"), "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rest = base.distinct().withColumn("salt", F.expr(f"cast(pmod(xxhash64(id), {salts}) as int)"))
    others = rest.join(big, (rest["vec"] == big["v"]) & (rest["salt"] == big["salt"])).filter(~F.array_contains("own", F.col("id"))).select("id", "best")
    all_rows = mine.unionByName(others).select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)).alias("p", "b"))
    return all_rows.select(F.col("id").alias(id_col), F.col("b.id").alias("vecino_id"), (F.col("p") + 1).alias("puesto"), (-F.col("b.n") + F.lit(0.0)).alias("similitud"))


def track_neighbours(axes: DataFrame, k: int = 5) -> DataFrame:
    """:func:`nearest` over ``ejes_pista``; only rows with ``valores`` take part."""
    return nearest(axes.filter(F.col("valores").isNotNull()), id_col="pista_id", vector=axis_vector("valores"), k=k)


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """The exact answer for the rows numbered in ``queries``, in blocks; for tests and measurements."""
    u = _unit(x)
    out = {}
    for b in _blocks(len(queries), 256):
        sim = np.round(u[queries[b]] @ u.T, 6)
        for r, q in enumerate(queries[b]):
            cut = np.partition(sim[r], -min(len(u), k + 1))[-min(len(u), k + 1)]
            near = np.nonzero(sim[r] >= cut)[0]
            order = near[np.lexsort((ids[near], -sim[r][near]))]
            out[int(ids[q])] = [int(i) for i in ids[order] if i != ids[q]][:k]
    return out
