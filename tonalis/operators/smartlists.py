"""Rules that make playlists: each is a filter, an order and a cap, or a ranking within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators.library import in_library
from tonalis.operators.listening import top_by_group, with_plays

# Sizes of the lists.
CAP, TOP_MINIMUM = 50, 60
FORGOTTEN_DAYS, DISCOVER_BELOW = 60, 10
ARTISTS, PER_ARTIST, ALBUMS, PER_ALBUM = 10, 5, 10, 4
RETURN_TRACKS, RETURN_PLAYS, RETURN_FAVOURITES, RETURN_TOP = 6, 6, 2, 6
SIMILAR_PER_ARTIST, SOFT_PER_ALBUM = 4, 8
THIS_IS, THIS_IS_LEAST = 80, 25

COLUMNS = ("id", "titulo", "artista_id", "album_id", "genero", "favorita", "veces_reproducida", "ultimo_acceso", "indexado_en")


def candidates(tracks: DataFrame, history: DataFrame) -> DataFrame:
    """Library tracks with their plays: what every rule reads."""
    return with_plays(in_library(tracks).select(*COLUMNS), history).withColumn("reciente", F.greatest("ultima", "ultimo_acceso"))


def capped(df: DataFrame, *order: Column, cap: int = CAP) -> DataFrame:
    return df.orderBy(*order, F.asc("id")).limit(cap).select("id", "titulo")


def favourites_playing(c: DataFrame) -> DataFrame:
    return capped(c.filter((F.col("favorita") == 1) & (F.col("plays") > 0)), F.desc("plays"), F.desc_nulls_last("reciente"))


def rediscover(c: DataFrame) -> DataFrame:
    return capped(c.filter(F.col("plays") > 0), F.asc_nulls_first("reciente"))


def recents(c: DataFrame) -> DataFrame:
    return capped(c, F.desc("indexado_en"))


def to_discover(c: DataFrame) -> DataFrame:
    return capped(c.filter(F.col("plays") < DISCOVER_BELOW), F.asc("plays"), F.desc("indexado_en"))


def recent_unplayed(c: DataFrame) -> DataFrame:
    return capped(c.filter(F.col("plays") == 0), F.desc("indexado_en"))


def forgotten_favourites(c: DataFrame, now: Column) -> DataFrame:
    """Favourites not heard for FORGOTTEN_DAYS days or ever."""
    old = F.col("reciente").isNull() | (F.col("reciente") < now - F.expr(f"INTERVAL '{FORGOTTEN_DAYS}' DAY"))
    return capped(c.filter((F.col("favorita") == 1) & old), F.asc_nulls_first("reciente"))


def top_songs(c: DataFrame) -> DataFrame:
    """The most played, or nothing while the library has fewer than TOP_MINIMUM plays in all."""
    enough = c.agg(F.coalesce(F.sum("plays"), F.lit(0)) >= TOP_MINIMUM).scalar()
    return capped(c.filter((F.col("plays") > 0) & enough), F.desc("plays"), F.desc_nulls_last("reciente"))


def frequent(c: DataFrame, group: str, groups: int, per: int) -> DataFrame:
    """The ``per`` most played tracks of each of the ``groups`` most played artists or albums: two rankings, no loop."""
    played = c.filter(F.col(group).isNotNull() & (F.col("plays") > 0))
    best = played.groupBy(group).agg(F.sum("plays").alias("_all")).orderBy(F.desc("_all"), group).limit(groups)
    best = best.withColumn("puesto_grupo", F.row_number().over(Window.orderBy(F.desc("_all"), group)))  # at most ``groups`` rows
    own = played.join(F.broadcast(best), group)
    return top_by_group(own, group, [F.desc("plays"), F.asc("id")], per, "puesto").select("id", "titulo", F.col(group).alias("grupo"), "puesto_grupo", "puesto")


def albums_to_return(c: DataFrame) -> DataFrame:
    """The most played tracks of albums that are large and liked enough."""
    own = c.filter(F.col("album_id").isNotNull())
    per = own.groupBy("album_id").agg(F.count("*").alias("_n"), F.sum("plays").alias("_p"), F.sum("favorita").alias("_f"))
    good = per.filter((F.col("_n") >= RETURN_TRACKS) & ((F.col("_p") >= RETURN_PLAYS) | (F.col("_f") >= RETURN_FAVOURITES))).select("album_id")
    return top_by_group(own.join(good, "album_id", "left_semi"), "album_id", [F.desc("plays"), F.asc("id")], RETURN_TOP, "puesto").select("id", "titulo", F.col("album_id").alias("grupo"), "puesto")


def similar_to(c: DataFrame, artist: int, cap: int = CAP) -> DataFrame:
    """Tracks of other artists in a genre of the artist, at most SIMILAR_PER_ARTIST of each."""
    genres = c.filter((F.col("artista_id") == artist) & F.col("genero").isNotNull()).select("genero").distinct()
    others = c.filter(F.col("artista_id").isNotNull() & (F.col("artista_id") != artist)).join(genres, "genero", "left_semi")
    return capped(top_by_group(others, "artista_id", [F.desc("plays"), F.asc("id")], SIMILAR_PER_ARTIST), F.desc("plays"), cap=cap)


def this_is(c: DataFrame, artist: int) -> DataFrame:
    """(id, titulo, propia): the artist's own tracks by favourites and plays, those past SOFT_PER_ALBUM of one album after the rest; an
    artist with fewer than THIS_IS_LEAST is filled up with similar tracks. Tracks without an album have no such limit."""
    own = c.filter(F.col("artista_id") == artist)
    order = [F.desc("favorita"), F.desc("plays"), F.asc("id")]
    first = own.orderBy(*order).limit(4 * THIS_IS)
    ranked = first.withColumn("_rn", F.row_number().over(Window.partitionBy("album_id").orderBy(*order)))  # 4 * THIS_IS rows
    mine = capped(ranked, F.asc((F.col("_rn") > SOFT_PER_ALBUM) & F.col("album_id").isNotNull()), *order, cap=THIS_IS)
    have = mine.agg(F.count("*")).scalar()
    others = similar_to(c, artist, THIS_IS).join(c.select("id", "plays"), "id")
    rank = F.row_number().over(Window.orderBy(F.desc("plays"), "id"))  # THIS_IS rows
    fill = others.withColumn("_k", rank).filter((have < THIS_IS_LEAST) & (F.col("_k") <= THIS_IS - have))
    return mine.withColumn("propia", F.lit(True)).unionByName(fill.select("id", "titulo", F.lit(False).alias("propia")))


def signature(members: DataFrame, group: str, item: str, position: str) -> DataFrame:
    """A digest of each ordered list, for the detection of changes: a sum of digests of (position, item), so that no list has
    to be collected."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(position).cast("string"), F.col(item).cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return members.groupBy(group).agg(F.sum(part).cast("string").alias("firma"))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two perceptual hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def pick_distinct(items: DataFrame, group: str, key: str, order: str, bits: str, n: int = 4, apart: int = 6) -> DataFrame:
    """(group, puesto, key): up to n items of each group in order, each more than ``apart`` bits from those picked before.

    One aggregate a pick finds the next item of every group; a group of any size is never held in one place.
    """
    left = items.select(group, key, order, bits).filter(F.col(bits).isNotNull())
    out = None
    for k in range(n):
        pick = left.groupBy(group).agg(F.min(F.struct(order, key, bits)).alias("_p"))
        row = pick.select(group, F.lit(k + 1).alias("puesto"), F.col(f"_p.{key}").alias(key))
        out = row if out is None else out.unionByName(row)
        if k + 1 < n:
            left = left.join(pick, group).filter(hamming(F.col(bits), F.col(f"_p.{bits}")) > apart).drop("_p")
    return out


def catalogue(lists: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(regla, n, basta): the size of every list and whether it reaches its minimum."""
    out = None
    for name, df in lists.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("regla"), "n", (F.col("n") >= least.get(name, 1)).alias("basta"))
        out = one if out is None else out.unionByName(one)
    return out


def mood_lists(features: DataFrame, moods: dict[str, dict[str, float]], least: float = 0.35, per: int = 30) -> DataFrame:
    """(animo, puesto, id, puntaje): the best tracks of every mood (weights of intents), all moods in one scan and one group limit."""
    from tonalis.operators.features import weighted_intents

    each = F.array(*[F.struct(F.lit(k).alias("animo"), F.round(weighted_intents(w), 6).alias("puntaje")) for k, w in moods.items()])
    rows = features.select("id", F.explode(each).alias("m")).select("id", "m.*").filter(F.col("puntaje") >= least)
    return top_by_group(rows, "animo", [F.desc("puntaje"), F.asc("id")], per, "puesto").select("animo", "puesto", "id", "puntaje")


def dispatched(rules: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(regla_id, id): for each rule, a JSON object with ``regla`` and perhaps ``limite``, the tracks of the list that it names; unknown or broken rules give none.

    ``lists`` maps a name to ids with their ``puesto``. The lists have fixed sizes, the rules are joined by name.
    """
    spec = rules.select("regla_id", F.from_json("regla_json", "regla string, limite int").alias("r")).select("regla_id", "r.regla", F.coalesce("r.limite", F.lit(CAP)).alias("limite"))
    all_lists = None
    for name, df in lists.items():
        one = df.select(F.lit(name).alias("regla"), "id", "puesto")
        all_lists = one if all_lists is None else all_lists.unionByName(one)
    return spec.join(all_lists, "regla").filter(F.col("puesto") <= F.col("limite")).select("regla_id", "id")


# The label of each kind of list.
LABELS = {
    "favoritos": "Me gusta", "usuario": "Manual", "this_is": "This is...", "mood": "Inteligente", "top_canciones": "Top", "top_artistas": "Mix", "top_albumes": "Mix", "album_mix": "Mix", "artist_mix": "Mix",
    "recientes": "Para ti", "descubrimiento_local": "Para ti",
}


def list_class(kind: Column, tipo: Column, origin: Column) -> Column:
    """struct(categoria, etiqueta) of a playlist by its kind, type and origin, first rule first."""
    made = (tipo == "automatica") | (origin == "generado")
    category = F.when(kind == "favoritos", "me_gusta").when(kind == "this_is", "this_is").when((tipo == "manual") & (origin == "usuario"), "creada").when(made, "inteligente").when(tipo == "sistema", "sistema").otherwise("creada")
    known = F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), kind)
    label = F.coalesce(known, F.when(made, "Para ti").when(tipo == "sistema", "Sistema").otherwise("Manual"))
    return F.struct(category.alias("categoria"), label.alias("etiqueta"))


def picture_hash(grey: Column, red: Column, green: Column, blue: Column) -> Column:
    """struct(forma, color): the perceptual hash of a picture: a bit for each of 64 grey values, set from their mean on, and its mean colour in 12 bits.

    ``grey`` is an array of 64 numbers, the colours are 0 to 255.
    """
    mean = F.aggregate(grey, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(grey))
    shape = F.aggregate(grey, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x >= mean, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
    part = lambda c: F.floor(c / 16).cast("int")
    return F.struct(shape.alias("forma"), (F.shiftleft(part(red), 8) + F.shiftleft(part(green), 4) + part(blue)).alias("color"))
