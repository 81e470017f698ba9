"""Records matched with candidates: blocked pairs, weighted evidence, gaps and thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tonalis.functions.text import array_jaccard, combined_forms, combined_similarity, compare_form, form_similarities, isrc_code, rounded, strip_version, token_jaccard, tokens, variant_type
from tonalis.materialise import task_count

# Weights of the criteria, thresholds, bonuses.
WEIGHTS = {"titulo": 0.28, "artista": 0.23, "duracion": 0.18, "album": 0.10, "track_number": 0.07, "tipo_release": 0.07, "isrc": 0.07}
ACCEPT, REVIEW, GAP, PENALTY_GAP = 0.82, 0.55, 0.10, 0.15
ACCEPTED_TYPES = ("Album", "Single", "EP")
YEAR, CODE = 0.04, 0.22
PENALTY_COMPILATION, PENALTY_VARIANT = 0.25, 0.20
ODD_TYPES = ("compilation", "live", "remix", "dj-mix")
#: Candidates of a block whose records one task takes; beyond that they are dealt over several.
HOT_BLOCK = 256
#: Records of a block that meet as many others at a time in :func:`full_scores`, the pairs that are scored at a time, and the texts that are compared at a time.
TILE, PAIRS, TEXTS = 3072, 1 << 18, 1 << 20


def duration_score(a: Column, b: Column) -> Column:
    """1 within 3 s, then linear to 0.5 at 10 s and to 0.05 at 30 s, else 0; unknown is neutral."""
    d = F.abs(a - b)
    return F.coalesce(F.when(d <= 3, 1.0).when(d <= 10, F.bround(1.0 - 0.5 * ((d - 3) / 7), 4)).when(d <= 30, F.bround(F.greatest(F.lit(0.05), 0.5 - 0.45 * ((d - 10) / 20)), 4)).when(d.isNotNull(), 0.0), F.lit(0.5))


def number_score(a: Column, b: Column) -> Column:
    """1 equal, 0.4 next to it, else 0; unknown is neutral."""
    return F.coalesce(F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.4).when((a - b).isNotNull(), 0.0), F.lit(0.5))


def release_score(kind: Column, variant: Column | None = None) -> Column:
    """How usual a type of release is; an unusual one is tolerated if the record's title names the same variant."""
    k = F.lower(F.trim(kind))
    odd = k.isin(*ODD_TYPES)
    same = F.lit(False) if variant is None else F.coalesce(F.lower(variant) == k, F.lit(False))
    return F.when(k.isin("album", "single", "ep"), 1.0).when(odd & same, 0.65).when(odd, 0.2).when(F.coalesce(k, F.lit("")) == "", 0.4).otherwise(0.5)


def release_penalty(kind: Column, variant: Column) -> Column:
    """What a compilation, and a live or remixed release costs; the latter little if the record's title names the same variant."""
    k = F.lower(F.trim(kind))
    same = F.coalesce(F.lower(variant) == k, F.lit(False))
    return F.when(k == "compilation", PENALTY_COMPILATION).when(k.isin("live", "remix", "dj-mix"), F.when(same, PENALTY_VARIANT * 0.30).otherwise(PENALTY_VARIANT)).otherwise(0.0)


def code_score(a: Column, b: Column) -> Column:
    """Agreement of identifiers: 1, 0.1 if they differ, 0.4 if only the record has one, else neutral."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).otherwise(0.1)).when(a.isNotNull(), 0.4).otherwise(0.5)


def year_bonus(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(a == b, YEAR).when(F.abs(a - b) <= 1, YEAR * 0.5), F.lit(0.0))


def similarity(a: Column, b: Column, exact: bool = False) -> Column:
    """The combined similarity, or only the shared words where no Python may run."""
    return token_jaccard(a, b) if exact else combined_similarity(a, b)


def blocks() -> Column:
    """The blocks of a record: its code, and its title without version with its artist, in comparison form."""
    words = F.concat(F.lit("t:"), compare_form(strip_version(F.col("titulo"))), F.lit("|"), compare_form(F.col("artista_nombre")))
    return F.array_compact(F.array(F.when(F.col("isrc").isNotNull(), F.concat(F.lit("i:"), "isrc")), words))


def block_pairs(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records with every candidate that shares one of their blocks, candidate columns as ``c_*``; each pair once, none with itself.

    ``id`` is unique on both sides. The records of a block that many candidates share are dealt over several tasks, each with all of
    its candidates. A pair that shares both blocks is kept from the code's block alone, so no pair has to be shuffled.
    """
    c = candidates.withColumn("_block", F.explode(blocks()))
    c = c.select("_block", *[F.col(x).alias(f"c_{x}") for x in candidates.columns])
    hot = c.groupBy("_block").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_BLOCK).select("_block", F.ceil(F.col("_n") / HOT_BLOCK).cast("int").alias("_parts"))
    dealt = records.withColumn("_block", F.explode(blocks())).join(hot, "_block", "left").withColumn("_part", F.coalesce(F.pmod(F.hash("id"), F.col("_parts")), F.lit(0))).drop("_parts")
    every = c.join(hot, "_block", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    once = F.col("_block").startswith("i:") | ~F.coalesce(F.col("isrc") == F.col("c_isrc"), F.lit(False))
    return dealt.join(every, ["_block", "_part"]).filter((F.col("id") != F.col("c_id")) & once).drop("_block", "_part")


def prepared(records: DataFrame, exact: bool = True) -> DataFrame:
    """Records with what :func:`scored` compares, made once a record instead of once a pair: words (``f_*``), or for the full similarity comparison forms (``g_*``)."""
    c = F.col
    texts = {"titulo": strip_version(c("titulo")), "entero": c("titulo"), "artista": c("artista_nombre"), "album": strip_version(c("album_titulo"))}
    forms = {f"f_{k}": tokens(t) for k, t in texts.items()} if exact else {f"g_{k}": compare_form(t) for k, t in texts.items()}
    return records.withColumns(forms | {"f_sin_album": compare_form(F.coalesce(c("album_titulo"), F.lit(""))) == "", "f_variante": variant_type(c("titulo"))})


def scored(pairs: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs with the score of each criterion and ``puntaje``: the weighted sum with bonuses for year and code, less the penalties of the release.

    Titles are compared without their version first; a weak match may be made up for by the whole titles. An album that the record lacks is
    neutral, one that only the candidate lacks is a weak sign against it. Pairs of :func:`prepared` records are compared by their words.
    """
    c = F.col
    ready = ("f_titulo" if exact else "g_titulo") in pairs.columns
    if ready and exact:
        alike = lambda _, f: array_jaccard(c(f), c(f"c_{f}"))
    elif ready:
        alike = lambda _, f: combined_forms(c(f"g{f[1:]}"), c(f"c_g{f[1:]}"))
        # a whole title that is the one without version can't be more alike than that: it is not compared again
        again = (c("g_titulo") != c("g_entero")) | (c("c_g_titulo") != c("c_g_entero"))
        pairs = pairs.withColumn("g_entero", F.when(again, c("g_entero")))
    else:
        alike = lambda x, _: similarity(x(""), x("c_"), exact)
    base = alike(lambda p: strip_version(c(f"{p}titulo")), "f_titulo")
    full = alike(lambda p: c(f"{p}titulo"), "f_entero") * 0.95
    artist = alike(lambda p: c(f"{p}artista_nombre"), "f_artista")
    none, other_none = (c(f"{p}f_sin_album") if ready else compare_form(F.coalesce(c(f"{p}album_titulo"), F.lit(""))) == "" for p in ("", "c_"))
    album = F.when(none, 0.5).when(other_none, 0.2).otherwise(alike(lambda p: strip_version(c(f"{p}album_titulo")), "f_album"))
    variant = c("f_variante") if ready else variant_type(c("titulo"))
    parts = {
        "s_titulo": F.when(base < 0.7, F.greatest(base, full)).otherwise(base), "s_artista": artist,
        "s_album": album, "s_duracion": duration_score(c("duracion_seg"), c("c_duracion_seg")), "s_track_number": number_score(c("track_number"), c("c_track_number")),
        "s_tipo_release": release_score(c("c_tipo"), variant), "s_isrc": code_score(c("isrc"), c("c_isrc")),
    }
    df = pairs.withColumns(parts)
    total = sum((F.col(f"s_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)) + year_bonus(c("anio"), c("c_anio")) + F.coalesce(F.when(c("isrc") == c("c_isrc"), CODE), F.lit(0.0)) - release_penalty(c("c_tipo"), variant)
    return df.withColumn("puntaje", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6))


def full_scores(records: DataFrame) -> DataFrame:
    """(id, c_id, puntaje) of every blocked pair of records with the full similarity: what :func:`scored` makes of their :func:`block_pairs`.

    Pairs are made beside the texts of their block, so that two texts are compared once however many pairs have them, and no text is joined to a
    pair. A block of more than TILE records is cut into parts, by artist; each pair of parts is a tile of its own.
    """
    c = F.col
    kind = F.trim(c("tipo"))
    ready = prepared(records, False).withColumns({
        "_tipo": F.lower(kind), "_variante": F.lower("f_variante"), "_s_igual": release_score(c("tipo"), kind), "_s_otro": release_score(c("tipo")),
        "_p_igual": release_penalty(c("tipo"), kind), "_p_otro": release_penalty(c("tipo"), F.lit(None).cast("string")), "_block": F.explode(blocks()),
    })
    w = Window.partitionBy("_block").orderBy("g_artista", "id")
    n, parts = c("_n"), F.ceil(c("_n") / TILE).cast("int")
    ready = ready.withColumns({"_n": F.count("*").over(Window.partitionBy("_block")), "_place": F.row_number().over(w)}).filter(n > 1)
    ready = ready.withColumns({"_parts": parts, "_part": F.floor((c("_place") - 1) * parts / n).cast("int")})
    # a tile's records come first, then those that are candidates too (the tile of a part with itself), then the other candidates
    tile = lambda q: F.struct((c("_part") * c("_parts") + q).alias("_tile"), F.when(q == c("_part"), 1).otherwise(0).alias("_side"))
    other = lambda q: F.struct((q * c("_parts") + c("_part")).alias("_tile"), F.lit(2).alias("_side"))
    every = F.sequence(F.lit(0), c("_parts") - 1)
    rows = ready.withColumn("_t", F.explode(F.concat(F.transform(every, tile), F.transform(F.filter(every, lambda q: q != c("_part")), other)))).select(
        "_block", "_t._tile", "_t._side", "id", "isrc", "g_titulo", "g_entero", "g_artista", "g_album", "f_sin_album", "_tipo", "_variante", "_s_igual", "_s_otro", "_p_igual", "_p_otro",
        c("duracion_seg").cast("double").alias("duracion_seg"), c("track_number").cast("long").alias("track_number"), c("anio").cast("long").alias("anio"),
    )
    rows = rows.repartition(4 * task_count(records.sparkSession), "_block", "_tile").sortWithinPartitions("_block", "_tile", "_side")
    key = records.schema["id"].dataType
    return rows.mapInArrow(_scored_tiles, StructType([StructField("id", key), StructField("c_id", key), StructField("puntaje", DoubleType())]))


def _scored_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of rows that are sorted by tile; several small tiles are taken at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        starts = _tile_starts(table)
        yield from _scored_pieces(table.slice(0, starts[-1]), starts)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield from _scored_pieces(rest, np.array([0, len(rest)]))


def _tile_starts(table: pa.Table) -> np.ndarray:
    block, tile = _codes(table["_block"])[1], table["_tile"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (tile[1:] != tile[:-1])) + 1])


def _scored_pieces(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``starts``: of the tiles, and the end of the last one."""
    k = 0
    while k < len(starts) - 1:
        end = max(k + 1, int(np.searchsorted(starts, starts[k] + TILE, "right")) - 1)
        yield from _scored_piece(table.slice(starts[k], starts[end] - starts[k]).combine_chunks(), starts[k : end + 1] - starts[k])
        k = end


def _codes(*columns: pa.ChunkedArray) -> tuple[list[str], ...]:
    """The distinct texts of some columns, and of each column the places of its rows among them; -1 for null."""
    coded = pa.concat_arrays([x for column in columns for x in column.chunks]).dictionary_encode()
    return coded.dictionary.to_pylist(), *np.split(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(columns))


def _scored_piece(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The scores of some whole tiles; the same sum as in :func:`scored`, term by term."""
    side = table["_side"].to_numpy()
    tile = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    low = (starts[:-1] + np.bincount(tile, side == 0, len(starts) - 1).astype(np.int64))[tile]  # a record's first candidate
    meets = np.where(side < 2, starts[1:][tile] - low, 0)

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        upto, k = np.cumsum(meets), 0
        while k < len(meets):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
            m = meets[k:end]
            r = np.repeat(np.arange(k, end), m)
            yield r, np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m) + low[r]
            k = end

    alike = {name: _similarities(*_codes(*(table[x] for x in columns)), side=side, pairs=int(meets.sum()), slices=slices) for name, columns in {"titulo": ("g_titulo", "g_entero"), "artista": ("g_artista",), "album": ("g_album",)}.items()}
    numbers = {}
    for x in ("duracion_seg", "track_number", "anio"):
        numbers[x] = table[x].fill_null(0).to_numpy(), ~table[x].is_null().to_numpy()
    flat = {x: table[x].to_numpy() for x in ("f_sin_album", "_s_igual", "_s_otro", "_p_igual", "_p_otro")}
    _, kind, variant = _codes(table["_tipo"], table["_variante"])
    _, code = _codes(table["isrc"])
    by_code = np.array([x.startswith("i:") for x in table["_block"].take(pa.array(starts[:-1])).to_pylist()], dtype=bool)[tile]
    ids = pa.concat_arrays(table["id"].chunks)

    def apart(x: str, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, there = numbers[x]
        return np.abs(value[r] - value[c]), there[r] & there[c]

    _, who = _codes(pa.chunked_array([ids]))
    for r, c in slices():
        same_code = (code[r] == code[c]) & (code[r] >= 0)
        keep = (who[r] != who[c]) & (by_code[r] | ~same_code)
        r, c, same_code = r[keep], c[keep], same_code[keep]
        if not len(r):
            continue
        title = alike["titulo"](0, r, c)
        title = np.where(title < 0.7, np.maximum(title, alike["titulo"](1, r, c) * 0.95), title)
        album = np.where(flat["f_sin_album"][r], 0.5, np.where(flat["f_sin_album"][c], 0.2, alike["album"](0, r, c)))
        d, known = apart("duracion_seg", r, c)
        length = np.where(known, 0.0, 0.5)
        length[known & (d <= 3)] = 1.0
        for some, score in ((known & (d > 3) & (d <= 10), lambda d: 1.0 - 0.5 * ((d - 3) / 7)), (known & (d > 10) & (d <= 30), lambda d: np.maximum(0.05, 0.5 - 0.45 * ((d - 10) / 20)))):
            length[some] = rounded(score(d[some]), 4, True)
        d, known = apart("track_number", r, c)
        number = np.where(known, np.where(d == 0, 1.0, np.where(d == 1, 0.4, 0.0)), 0.5)
        same = (variant[r] == kind[c]) & (kind[c] >= 0)
        release, penalty = (np.where(same, flat[f"_{x}_igual"][c], flat[f"_{x}_otro"][c]) for x in "sp")
        identity = np.where(code[r] >= 0, np.where(code[c] >= 0, np.where(same_code, 1.0, 0.1), 0.4), 0.5)
        scores = {"titulo": title, "artista": alike["artista"](0, r, c), "duracion": length, "album": album, "track_number": number, "tipo_release": release, "isrc": identity}
        d, known = apart("anio", r, c)
        total = sum((scores[k] * v for k, v in WEIGHTS.items()), 0.0) + np.where(known & (d <= 1), np.where(d == 0, YEAR, YEAR * 0.5), 0.0) + np.where(same_code, CODE, 0.0) - penalty
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), ids.take(pa.array(c)), pa.array(rounded(np.clip(total, 0.0, 1.0), 6, False))], ["id", "c_id", "puntaje"])


def _similarities(forms: list[str], *codes: np.ndarray, side: np.ndarray, pairs: int, slices: Callable) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """The similarity of the texts of rows r and c by one of ``codes``, looked up: every two texts that meet are compared once."""
    places = []
    for rows in (side < 2, side > 0):
        used = np.unique(np.concatenate([x[rows] for x in codes]))
        place = np.zeros(len(forms), dtype=np.int64)
        place[used] = np.arange(len(used))
        places.append((used, [place[x] for x in codes]))
    (lefts, left), (rights, right) = places
    cells = len(lefts) * len(rights)
    at = lambda k, r, c: left[k][r] * len(rights) + right[k][c]
    dense = cells <= 4 * pairs
    if dense:
        met = np.zeros(cells, dtype=bool)
        for r, c in slices():
            for k in range(len(codes)):
                met[at(k, r, c)] = True
        need = np.flatnonzero(met)
    else:
        need = np.unique(np.concatenate([at(k, r, c) for r, c in slices() for k in range(len(codes))] or [np.zeros(0, dtype=np.int64)]))
    values = np.zeros(cells if dense else len(need), dtype=np.int16)  # four digits
    for k in range(0, len(need), TEXTS):
        some = need[k : k + TEXTS]
        values[some if dense else slice(k, k + len(some))] = np.rint(form_similarities(forms, lefts[some // len(rights)], rights[some % len(rights)]) * 1e4)
    return (lambda k, r, c: values[at(k, r, c)] / 1e4) if dense else (lambda k, r, c: values[np.searchsorted(need, at(k, r, c))] / 1e4)


def decided(pairs: DataFrame) -> DataFrame:
    """The best candidate of each record, its gap to the second, and the route: aceptado, revision or cuarentena.

    A gap below GAP to a second candidate costs PENALTY_GAP, but never takes a score from REVIEW on below it. Only the two best of a
    record are ranked (group limit), so a record with many candidates is cheap.
    """
    w = Window.partitionBy("id").orderBy(F.desc("puntaje"), "c_id")
    two = pairs.select("id", "c_id", "puntaje").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    best = two.groupBy("id").agg(F.max_by("c_id", -F.col("_n")).alias("candidato"), F.max("puntaje").alias("_p"), (F.max("puntaje") - F.when(F.count("*") > 1, F.min("puntaje")).otherwise(0.0)).alias("brecha"), F.count("*").alias("_many"))
    floor = F.when(F.col("_p") >= REVIEW, REVIEW).otherwise(0.0)
    p = F.when((F.col("_many") > 1) & (F.col("brecha") < GAP), F.greatest(floor, F.col("_p") - PENALTY_GAP)).otherwise(F.col("_p"))
    out = best.withColumn("puntaje", F.round(p, 6)).withColumn("brecha", F.round("brecha", 6))
    return out.select("id", "candidato", "puntaje", "brecha", F.when(F.col("puntaje") >= ACCEPT, "aceptado").when(F.col("puntaje") >= REVIEW, "revision").otherwise("cuarentena").alias("ruta"))


def causes(pairs: DataFrame, title: str = "titulo") -> DataFrame:
    """(id, ruta, causa): why a record is not accepted, from its best candidate, first rule first.

    For review: a second candidate as good, a doubtful type of release (unless the title itself names a variant), a marginal length, else the
    score. For quarantine: a title that says too little, else the score. ``pairs`` as from :func:`scored`.
    """
    w = Window.partitionBy("id").orderBy(F.desc("puntaje"), "c_id")
    best = pairs.select("id", "c_id", "puntaje", "c_tipo", "s_titulo", "s_duracion", variant_type(F.col(title)).alias("variante")).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    d = decided(pairs).select("id", "ruta", "brecha", F.col("puntaje").alias("_final"))
    j = best.join(d, "id").withColumn("_unclear", F.col("_final") < F.round("puntaje", 6))
    typed = F.coalesce(F.col("c_tipo").isin(*ACCEPTED_TYPES), F.lit(False))
    review = F.when(F.col("_unclear"), "candidatos_ambiguos").when(~typed & F.col("variante").isNull(), "tipo_dudoso").when(F.col("s_duracion") < 0.3, "duracion_marginal").otherwise("puntaje_intermedio")
    low = F.when(F.col("s_titulo") < 0.3, "metadata_insuficiente").otherwise("puntaje_bajo")
    return j.filter("ruta <> 'aceptado'").select("id", "ruta", F.when(F.col("ruta") == "revision", review).otherwise(low).alias("causa"))


def second_evidence(pairs: DataFrame) -> Column:
    """The evidence of the second look at a pair."""
    c = F.col
    d = F.abs(c("duracion_seg") - c("c_duracion_seg"))
    length = F.coalesce(F.when(d <= 2, 1.0).when(d <= 5, 0.8).when(d <= 12, 0.6).when(d.isNotNull(), 0.2), F.lit(0.5))
    same = lambda a, b: F.coalesce((c(a) == c(b)).cast("double"), F.lit(0.0))
    return F.bround(c("s_titulo") * 0.28 + c("s_artista") * 0.26 + length * 0.18 + same("isrc", "c_isrc") * 0.18 + same("mb_recording_id", "c_mb_recording_id") * 0.10, 4)


def first_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of the highest precedence for each record: ``keys`` (id, rango, clave) against ``rules`` (clave, valor)."""
    return keys.join(rules, "clave").groupBy("id").agg(F.min_by("valor", F.struct("rango", "clave")).alias("valor"), F.min("rango").alias("rango"))


def code(c: str) -> Column:
    return isrc_code(F.col(c))


def solid_identity() -> Column:
    """Whether title and artist agree well enough: with an identifier, or very well without."""
    t, a = F.col("s_titulo"), F.col("s_artista")
    return (t >= 0.75) & (a >= 0.65) & (F.col("isrc").isNotNull() | F.col("mb_recording_id").isNotNull() | ((t >= 0.90) & (a >= 0.85)))


def sources_used() -> Column:
    """The kinds of evidence that a pair has, as an array."""
    return F.array_compact(F.array(F.when(F.col("isrc") == F.col("c_isrc"), "isrc"), F.when(F.col("mb_recording_id") == F.col("c_mb_recording_id"), "mb"), F.when(F.col("s_titulo") >= 0.75, "titulo"), F.when(F.col("s_artista") >= 0.70, "artista")))


def agreement_bonus(title: Column, artist: Column) -> Column:
    """A bonus for sources that agree independently: on both, or on one of the two."""
    both = (title >= 0.75).cast("int") + (artist >= 0.70).cast("int")
    return F.when(both == 2, 0.06).when(both == 1, 0.03).otherwise(0.0)


def filter_or_all(pairs: DataFrame, rule: Column) -> DataFrame:
    """For each record the candidates that meet a rule, or all of them if none does: one flag a record, joined back."""
    flagged = pairs.withColumn("_hit", F.coalesce(rule, F.lit(False)))
    some = flagged.groupBy("id").agg(F.bool_or("_hit").alias("_some"))
    return flagged.join(some, "id").filter(F.col("_hit") | ~F.col("_some")).drop("_hit", "_some")


def promoted(evidence: DataFrame, least: float = 0.86, gap: float = 0.12) -> DataFrame:
    """(id, c_id, evidencia, brecha): records whose best evidence is high, well ahead of the second, and backed by an identifier.

    ``evidence``: id, c_id, evidencia, fuerte.
    """
    w = Window.partitionBy("id").orderBy(F.desc("evidencia"), "c_id")
    two = evidence.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    best = two.groupBy("id").agg(F.max_by(F.struct("c_id", "fuerte"), -F.col("_n")).alias("b"), F.max("evidencia").alias("evidencia"), F.round(F.max("evidencia") - F.when(F.count("*") > 1, F.min("evidencia")).otherwise(0.0), 6).alias("brecha"))
    return best.filter((F.col("evidencia") >= least) & (F.col("brecha") >= gap) & F.col("b.fuerte")).select("id", "b.c_id", "evidencia", "brecha")


def folder_of(kind: Column, title: Column, album: Column, exact: bool = False) -> Column:
    """The folder of a release: by its type, else by whether the release is named like the track."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    like = similarity(strip_version(title), strip_version(album), exact)
    return F.when(k == "album", "albumes").when(k.isin("single", "ep"), "singles_y_ep").when(k != "", "otros").when(F.coalesce(album, F.lit("")) == "", "otros").when(like >= 0.75, "singles_y_ep").otherwise("albumes")


def fused(rows: DataFrame, exact: bool = False) -> DataFrame:
    """(id, titulo, artista, fuente_titulo, fuente_artista, isrc, confianza): local tags completed and confirmed by two other sources.

    ``rows``: id, titulo, artista_nombre, isrc; x_titulo, x_artista, x_isrc of a source that names the recording (null if it does not); huella, the
    score of one that only recognises it. A local text that is too short for a comparison gives way; a code from outside always counts.
    Confidence: with a code 0.30, else 0.15 for each text that agrees and 0.10 for each that was missing (0.35 at most), plus 0.25, 0.15 or 0.05 by the score.
    """
    c = F.col
    titles, artists = (compare_form(F.coalesce(c(x), F.lit(""))) for x in ("titulo", "artista_nombre"))
    x_title, x_artist = (compare_form(F.coalesce(c(x), F.lit(""))) for x in ("x_titulo", "x_artista"))
    df = rows.withColumns({"_t": titles, "_a": artists, "_xt": x_title, "_xa": x_artist})
    no_title, no_artist = F.length("_t") < 1, F.length("_a") < 2
    df = df.withColumns({"_nt": no_title & (c("_xt") != ""), "_na": no_artist & (c("_xa") != "")})
    ft, fa = F.when(c("_nt"), c("_xt")).otherwise(c("_t")), F.when(c("_na"), c("_xa")).otherwise(c("_a"))
    code = F.coalesce(isrc_code(c("x_isrc")), isrc_code(c("isrc")))
    named = (c("_xt") != "") | (c("_xa") != "")
    agree = lambda a, b: F.when((a != "") & (b != ""), F.when(similarity(a, b, exact) >= 0.75, 0.15).otherwise(0.0)).otherwise(0.0)
    told = F.least(F.lit(0.35), agree(ft, c("_xt")) + agree(fa, c("_xa")) + F.when((ft == "") & (c("_xt") != ""), 0.10).otherwise(0.0) + F.when((fa == "") & (c("_xa") != ""), 0.10).otherwise(0.0))
    first = F.when(named, F.when(code.isNotNull(), 0.30).otherwise(told)).otherwise(0.0)
    heard = F.when(c("huella") >= 0.90, 0.25).when(c("huella") >= 0.75, 0.15).when(c("huella").isNotNull(), 0.05).otherwise(0.0)
    source = lambda x: F.when(x, "externa").otherwise("local")
    return df.select(
        "id", F.when(c("_nt"), c("x_titulo")).otherwise(c("titulo")).alias("titulo"), F.when(c("_na"), c("x_artista")).otherwise(c("artista_nombre")).alias("artista"), source(c("_nt")).alias("fuente_titulo"),
        source(c("_na")).alias("fuente_artista"), code.alias("isrc"), F.round(F.least(F.lit(1.0), first + heard), 4).alias("confianza"),
    )


def hint_evidence(title: Column, artist: Column, seconds_apart: Column, same_code: Column) -> Column:
    """How far a hint from a third source supports a record: title, artist, length and code."""
    length = F.when(seconds_apart <= 3, 1.0).when(seconds_apart <= 8, 0.8).when(seconds_apart.isNotNull(), 0.35).otherwise(0.5)
    return F.bround(title * 0.40 + artist * 0.35 + length * 0.15 + F.coalesce(same_code.cast("double"), F.lit(0.0)) * 0.10, 4)


def third_look(evidence: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, c_id, evidencia, brecha): records promoted on a third look: evidence of 0.90 and 0.14 ahead, a hard sign, and a hint of 0.80 or more.

    ``evidence`` as for :func:`promoted`; ``hints``: id, pista.
    """
    return promoted(evidence, 0.90, 0.14).join(hints.filter("pista >= 0.8").select("id"), "id", "left_semi")
