"""Documents packed into containers of fixed capacity, each filled with lexical neighbours of its first document."""

from __future__ import annotations

import base64
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.llm.leakage import words
from tonalis.materialise import discard, materialise, spread

#: The rank file that counts tokens: a parameter, or the setting TONALIS_VOCABULARY, never part of this repository. Without either the
#: file of that name in the folder of tokenizers. Its splitting pattern is a fixed value.
VOCABULARY = os.environ.get("TONALIS_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents and terms of a shard of the index at most, on average; buckets that terms are hashed into.
SHARD_DOCS, SHARD_TERMS, BUCKETS = 1000, 500_000, 1 << 18
#: Terms of a shard that are multiplied at a time.
COLUMNS = 4096
#: How a piece came into its window: it opened it, as a neighbour of the seed, or because it was the largest that fitted.
SEED, NEIGHBOUR, LARGEST = range(3)
#: A window that is filled less than this goes back to the common pool; pieces of one pool.
FULL, POOL_ITEMS = 0.97, 20_000
K1, B = 1.2, 0.75

_COLUMNS = "contenedor string, ventana string, orden int, doc_id {}, parte int, desde int, hasta int, tokens int, modo int"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _features(batches: Iterable[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    enc, memo = encoding(path), {}
    for batch in batches:
        sizes, terms, counts = [], [], []
        for text in batch["text"]:
            text = text or ""
            sizes.append(len(enc.encode_ordinary(text)))
            c: dict[int, int] = {}
            for w, k in Counter(words(text)).items():
                b = memo.get(w)
                if b is None:
                    if len(memo) > 500_000:
                        memo.clear()
                    b = memo[w] = zlib.crc32(w.encode()) % BUCKETS
                c[b] = c.get(b, 0) + k
            terms.append(np.fromiter(c.keys(), dtype=np.int32, count=len(c)))
            counts.append(np.fromiter(c.values(), dtype=np.int32, count=len(c)))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes, "terms": terms, "counts": counts})


def _leading(batches: Iterable[pd.DataFrame], idf: np.ndarray) -> Iterator[pd.DataFrame]:
    """The two most telling terms of each document: what the shards are sorted by, so that related texts meet."""
    for batch in batches:
        one, two = [], []
        for t, c in zip(batch["terms"], batch["counts"]):
            top = t[np.lexsort((t, -idf[t] * np.minimum(c, 3)))[:2]] if len(t) else t
            one.append(int(top[0]) if len(top) else -1)
            two.append(int(top[1]) if len(top) > 1 else -1)
        yield batch.assign(lead=one, second=two)


class _Sizes:
    """Unused items by size: the largest that fits is found by bisection and a chain over the used ones."""

    def __init__(self, size: np.ndarray) -> None:
        self.order = np.argsort(size, kind="stable")
        self.sorted = size[self.order]
        self.place = np.empty(len(size), dtype=np.int64)
        self.place[self.order] = np.arange(len(size))
        self.down = list(range(len(size)))  # down[k]: the nearest unused place at or below k, -1 - ... if none

    def find(self, k: int) -> int:
        path = []
        while k >= 0 and self.down[k] != k:
            path.append(k)
            k = self.down[k]
        for p in path:
            self.down[p] = k
        return k

    def use(self, item: int) -> None:
        k = int(self.place[item])
        self.down[k] = k - 1

    def largest(self, room: int) -> int:
        """The largest unused item of at most this size, or -1."""
        k = self.find(int(np.searchsorted(self.sorted, room, side="right")) - 1)
        return -1 if k < 0 else int(self.order[k])


class _Index:
    """Inverted BM25 index of a shard, asked with all its documents at once; document frequencies come from the whole corpus.

    The postings are sorted by term and evaluated COLUMNS terms at a time, so memory has a bound whatever the texts.
    ``score[a, b]`` is the score of document b for all terms of document a. Terms that only one document of the shard has
    can't bring two together and are left out of the product.
    """

    def __init__(self, terms: Sequence[np.ndarray], counts: Sequence[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n = n = len(terms)
        length = np.array([c.sum() for c in counts], dtype=np.float64)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.empty(0, dtype=np.int32)
        tf = np.concatenate(counts).astype(np.float64) if n else np.empty(0)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1.0)))).astype(np.float32)
        shared, place, many = np.unique(term, return_inverse=True, return_counts=True)
        kept = many > 1
        column = (np.cumsum(kept) - 1)[place]
        keep = kept[place]
        doc, column, weight = doc[keep], column[keep], weight[keep]
        order = np.argsort(column, kind="stable")
        doc, column, weight = doc[order], column[order], weight[order]
        self.score = np.zeros((n, n), dtype=np.float32)
        for lo in range(0, int(kept.sum()), COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            has, w = np.zeros((n, COLUMNS), dtype=np.float32), np.zeros((n, COLUMNS), dtype=np.float32)
            has[doc[a:b], column[a:b] - lo] = 1
            w[doc[a:b], column[a:b] - lo] = weight[a:b]
            self.score += has @ w.T


def fill_windows(size: np.ndarray, capacity: int, index: _Index | None = None, owner: np.ndarray | None = None, how: np.ndarray | None = None) -> list[list[int]]:
    """Windows as lists of items: the largest unused item opens one, its neighbours follow, best first, until none fits, then the largest that fit.

    ``owner`` is the document of each item in ``index``; ``how`` is filled with SEED, NEIGHBOUR or LARGEST. Items without size join the first window.
    """
    sizes, unused, windows = _Sizes(size), size > 0, []
    how = np.empty(len(size), dtype=np.int8) if how is None else how
    how[:] = LARGEST
    least = int(size[unused].min()) if unused.any() else 0
    for k in np.nonzero(~unused)[0]:
        sizes.use(k)

    def put(window: list[int], k: int, reason: int) -> int:
        window.append(k)
        unused[k] = False
        sizes.use(k)
        how[k] = reason
        return int(size[k])

    while (seed := sizes.largest(capacity)) >= 0:
        window: list[int] = []
        room = capacity - put(window, seed, SEED)
        if index is not None and room >= least:
            score = index.score[owner[seed], owner]
            near = np.nonzero(unused & (size <= room) & (score > 0))[0]
            near = near[np.lexsort((near, -score[near]))]
            while len(near):  # every neighbour that still fits
                room -= put(window, int(near[0]), NEIGHBOUR)
                near = near[1:]
                near = near[size[near] <= room]
        while room >= least and (k := sizes.largest(room)) >= 0:
            room -= put(window, k, LARGEST)
        windows.append(window)
    empty = [int(k) for k in np.nonzero(size == 0)[0]]
    if empty:
        if windows:
            windows[0] += empty
        else:
            windows.append(empty)
    return windows


def _pieces(tokens: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(document, part, from, to): a document is cut only if it alone exceeds the capacity."""
    return [(d, p, p * capacity, min((p + 1) * capacity, int(n))) for d, n in enumerate(tokens) for p in range(max(1, -(-int(n) // capacity)))]


def _pack_shard(batches: Iterable[pd.DataFrame], idf: np.ndarray, mean: float, containers: list[tuple[str, int]], shard: str) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    docs = pd.concat(parts, ignore_index=True)
    tokens, index = docs["tokens"].to_numpy(), _Index(docs["terms"].tolist(), docs["counts"].tolist(), idf, mean)
    ids = docs["doc_id"]
    for name, capacity in containers:
        piece = np.array(_pieces(tokens, capacity), dtype=np.int64).reshape(-1, 4)
        size = piece[:, 3] - piece[:, 2]
        how = np.empty(len(size), dtype=np.int8)
        rows = [(w, o, k) for w, window in enumerate(fill_windows(size, capacity, index, piece[:, 0], how)) for o, k in enumerate(window)]
        w, o, k = np.array(rows, dtype=np.int64).T
        p = piece[k]
        yield pd.DataFrame({"contenedor": name, "ventana": [f"{shard}-{x}" for x in w], "orden": o, "doc_id": ids.iloc[p[:, 0]].to_numpy(), "parte": p[:, 1], "desde": p[:, 2], "hasta": p[:, 3], "tokens": size[k], "modo": how[k]})


def pack(documents: DataFrame, containers: DataFrame, *, vocabulary: str = VOCABULARY, reasons: bool = False) -> DataFrame:
    """(contenedor, ventana, orden, doc_id, parte, desde, hasta, tokens): every document in a window of each container.

    ``desde`` and ``hasta`` are token positions. A document is cut only if it alone exceeds the capacity: into full pieces and
    a rest. A window is opened by the largest unused document of its shard and filled with the best unused neighbours
    by BM25 on all its terms, best first, until no unused document that shares a term with it fits; then with the largest
    that fit. The few windows that stay under FULL (the last of a shard) go to a common pool and are filled again by size alone.
    ``reasons`` adds ``modo``, how each piece was placed (SEED, NEIGHBOUR, LARGEST); :func:`placed` sums it up.

    Defined cases: null and empty texts have 0 tokens and sit in any window; rows without doc_id are left out; repeated
    rows are packed as often as they occur; containers without name or with a capacity below 1 are left out, of one name the
    largest capacity holds; empty tables give an empty result; further columns are ignored.

    Plan: one pass over the texts gives token counts and hashed terms; document frequencies over the whole corpus are a vector
    of BUCKETS numbers, whatever the corpus; the feature rows are range-partitioned by their most telling terms into shards of
    bounded size, each packed for all containers in one task; only the few open windows are shuffled again.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    sizes = containers.filter("contenedor is not null and capacidad_tokens >= 1").groupBy("contenedor").agg(F.max("capacidad_tokens").alias("n")).orderBy("contenedor").limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("more than 1000 containers")
    wanted = [(r.contenedor, int(r.n)) for r in sizes]
    docs = spread(documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id")
    made = materialise(docs.mapInPandas(lambda it: _features(it, vocabulary), f"doc_id {kind}, tokens int, terms array<int>, counts array<int>"), "features")
    n, total, words_all = made.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    df = np.zeros(BUCKETS)
    for r in made.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most BUCKETS rows
        df[r["t"]] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = words_all / max(n, 1)
    sent = spark.sparkContext.broadcast(idf)
    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil(total / SHARD_TERMS))
    led = made.mapInPandas(lambda it: _leading(it, sent.value), f"doc_id {kind}, tokens int, terms array<int>, counts array<int>, lead int, second int")
    cut = led.repartitionByRange(shards, "lead", "second", "doc_id").drop("lead", "second")
    schema = _COLUMNS.format(kind)

    def shard(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _pack_shard(batches, sent.value, mean, wanted, str(TaskContext.get().partitionId()))

    packed = materialise(cut.mapInPandas(shard, schema), "packed")
    discard(made)
    limits = spark.createDataFrame(wanted or [("", 1)], "contenedor string, n int")
    filled = packed.groupBy("contenedor", "ventana").agg(F.sum("tokens").alias("t")).join(F.broadcast(limits), "contenedor")
    loose = filled.filter(F.col("t") < FULL * F.col("n")).select("contenedor", "ventana")
    again = packed.join(loose, ["contenedor", "ventana"], "left_semi")
    pools = again.groupBy("contenedor").agg(F.ceil(F.count("*") / POOL_ITEMS).alias("pools"))
    pooled = again.join(F.broadcast(pools), "contenedor").withColumn("pool", F.expr("cast(pmod(xxhash64(doc_id, parte), pools) as int)")).drop("pools")
    capacity = dict(wanted)

    def repack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "parte"], ignore_index=True)
        size = items["tokens"].to_numpy().astype(np.int64)
        how = np.empty(len(size), dtype=np.int8)
        rows = [(w, o, k) for w, window in enumerate(fill_windows(size, capacity[key[0]], how=how)) for o, k in enumerate(window)]
        w, o, k = np.array(rows, dtype=np.int64).T
        out = items.iloc[k].reset_index(drop=True)
        return out.assign(ventana=[f"p{key[1]}-{x}" for x in w], orden=o, modo=how[k])[_NAMES]

    closed = packed.join(loose, ["contenedor", "ventana"], "left_anti")
    out = closed.select(*_NAMES).unionByName(pooled.groupBy("contenedor", "pool").applyInPandas(repack, schema))
    return out if reasons else out.drop("modo")


def placed(packed: DataFrame) -> DataFrame:
    """(contenedor, semilla, vecinos, tamano): the share of tokens that opened a window, came as neighbours, and by size alone.

    ``packed`` has ``modo`` (:func:`pack` with ``reasons``).
    """
    share = lambda m: F.sum(F.when(F.col("modo") == m, F.col("tokens")).otherwise(0)) / F.sum("tokens")
    return packed.groupBy("contenedor").agg(share(SEED).alias("semilla"), share(NEIGHBOUR).alias("vecinos"), share(LARGEST).alias("tamano"))


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(contenedor, ventanas, piezas, tokens, ocupacion): windows, pieces, tokens and used share of each container."""
    size = containers.groupBy("contenedor").agg(F.max("capacidad_tokens").alias("n"))
    per = packed.groupBy("contenedor", "ventana").agg(F.count("*").alias("d"), F.sum("tokens").alias("t"))
    return per.groupBy("contenedor").agg(F.count("*").alias("ventanas"), F.sum("d").alias("piezas"), F.sum("t").alias("tokens")).join(F.broadcast(size), "contenedor").select("contenedor", "ventanas", "piezas", "tokens", (F.col("tokens") / (F.col("ventanas") * F.col("n"))).alias("ocupacion"))
