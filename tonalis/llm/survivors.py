"""Duplicate groups by shared identifiers, and the row that supplies each field of the surviving record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.materialise import discard, materialise
from tonalis.operators.components import connected_components

#: Rows up to which a table of learned values is broadcast; beyond it is joined by shuffle.
BROADCAST_ROWS = 100_000
#: A transition counts as a precedence from this many groups and this share of the groups that show the two values.
MIN_SUPPORT, MIN_SHARE = 3, 0.6


def identifier(column: str, pattern: str) -> Column:
    """The identifier in its compared form, or an empty text if it is not usable: what the first group of ``pattern`` takes
    of the value in capitals without blanks, hyphens and braces."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(F.upper(F.col(column)), r"[\s\p{Z}{}\-]", ""), pattern, 1), F.lit(""))


#: An optional label, the form, and nowhere one single character throughout (isrc: after its two letters).
PATTERNS = {
    "isrc": r"^(?:ISRC:?)?([A-Z]{2}(?!(.)\2*$)[A-Z0-9]{3}[0-9]{7})$",
    "hash_sha256": r"^(?:SHA256:)?((?!(.)\2*$)[0-9A-F]{64})$",
    "mb_recording_id": r"^(?:URN:UUID:)?((?!(.)\2*$)[0-9A-F]{32})$",
}


def with_identifiers(tracks: DataFrame, time: str = "actualizado_en") -> DataFrame:
    """id, the three identifiers in compared form (null if unusable), usable bitrate, time and state of each track."""
    rest = [F.when(F.col("bitrate_kbps").between(32, 2000), F.col("bitrate_kbps")).alias("bitrate_kbps"), F.col(time).alias("_t"), F.coalesce(F.col("estado"), F.lit("")).alias("_state")]
    bare = tracks.filter(F.col("id").isNotNull()).select("id", *[identifier(c, p).alias(c) for c, p in PATTERNS.items()], *rest)
    return bare.select("id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in PATTERNS], "bitrate_kbps", "_t", "_state")


IDENTIFIERS = tuple(PATTERNS)
NODES = tuple(f"_n_{c}" for c in IDENTIFIERS)
#: The fields whose values follow each other as a record ages.
ATTRIBUTES = {"estado": "_state", "bitrate_kbps": "bitrate_kbps"}


def _node(kind: str) -> Column:
    """The identifier as a number of 126 bits: two hashes, so that 10^12 identifiers still don't meet by chance."""
    one, two = (F.shiftrightunsigned(h, 1).cast("decimal(20,0)") for h in (F.xxhash64(F.lit(kind), F.col(kind)), F.xxhash64(F.col(kind), F.lit(2), F.lit(kind))))
    return (one * F.lit(str(2**63)).cast("decimal(20,0)") + two).cast("decimal(38,0)")


def _values() -> Column:
    """(campo, valor) of each attribute of a row that has one."""
    return F.explode(F.filter(F.array(*[F.struct(F.lit(a).alias("campo"), F.col(c).cast("string").alias("valor")) for a, c in ATTRIBUTES.items()]), lambda x: x["valor"].isNotNull()))


def _summaries(rows: DataFrame) -> DataFrame:
    """Per (shared identifiers, state, bitrate) what any choice needs; a row for each, however many tracks share them."""
    minus = (-F.col("id")).alias("i")
    full = F.struct(sum((F.col(c).isNotNull().cast("int") for c in (*NODES, "bitrate_kbps")), F.lit(0)).alias("n"), F.coalesce("bitrate_kbps", F.lit(-1)).alias("b"), F.col("_t").alias("t"), minus)
    return rows.groupBy("_nodes", "_state", "bitrate_kbps").agg(
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.min("_t").alias("since"),
        *[F.max(F.when(F.col(n).isNotNull() & F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), minus))).alias(f"dated_{c}") for c, n in zip(IDENTIFIERS, NODES)],
        *[F.max(F.when(F.col(n).isNotNull() & F.col("_t").isNull(), -F.col("id"))).alias(f"undated_{c}") for c, n in zip(IDENTIFIERS, NODES)],
        F.max(F.when(F.col("bitrate_kbps").isNotNull(), F.struct(F.col("bitrate_kbps").alias("b"), F.col("_t").alias("t"), minus))).alias("bit"),
        F.max(full).alias("full"),
    )


def learn_precedence(groups: DataFrame) -> DataFrame:
    """(campo, antes, despues, n): pairs of values of an attribute of which the first is seen before the second in clearly more groups.

    ``groups`` has ``root``, the attributes and ``since``, the first time the group shows them. Per group and attribute the values are
    ordered by that time and each consecutive pair is one vote; a group contributes at most one vote a value, so a hot
    group weighs no more.
    """
    first = groups.filter(F.col("since").isNotNull()).select("root", "since", _values().alias("v")).groupBy("root", "v.campo", "v.valor").agg(F.min("since").alias("since"))
    w = Window.partitionBy("root", "campo").orderBy("since", "valor")  # a row a value of the group
    votes = first.select("campo", F.lag("valor").over(w).alias("antes"), F.col("valor").alias("despues"), (F.lag("since").over(w) < F.col("since")).alias("_later")).filter("_later")
    n = votes.groupBy("campo", "antes", "despues").agg(F.count("*").alias("n"))
    back = n.select("campo", F.col("antes").alias("despues"), F.col("despues").alias("antes"), F.col("n").alias("_back"))
    return n.join(back, ["campo", "antes", "despues"], "left").filter((F.col("n") >= MIN_SUPPORT) & (F.col("n") >= MIN_SHARE * (F.col("n") + F.coalesce("_back", F.lit(0))))).select("campo", "antes", "despues", "n")


def without_cycles(precedence: DataFrame) -> DataFrame:
    """The precedences that form a partial order: values are ranked by votes won minus votes lost, and what goes against that rank is dropped."""
    ends = precedence.select("campo", F.explode(F.array(F.struct(F.col("despues").alias("valor"), F.col("n").alias("g")), F.struct(F.col("antes").alias("valor"), (-F.col("n")).alias("g")))).alias("e"))
    net = ends.groupBy("campo", "e.valor").agg(F.sum("e.g").alias("g"))
    rank = F.struct("g", "valor")
    lo, hi = net.select("campo", F.col("valor").alias("antes"), rank.alias("ra")), net.select("campo", F.col("valor").alias("despues"), rank.alias("rd"))
    return precedence.join(lo, ["campo", "antes"]).join(hi, ["campo", "despues"]).filter("ra < rd").select("campo", "antes", "despues")


def group_orders(values: DataFrame, order: DataFrame) -> DataFrame:
    """(root, campo, antes, despues): the partial order of the values that each group shows, with all its consequences.

    ``values``: root, campo, valor. Only precedences between two values of the group count; paths are doubled in each round until none is new.
    """
    have = values.select("root", "campo", "valor").distinct()
    order = F.broadcast(order) if order.count() <= BROADCAST_ROWS else order
    edges = have.withColumnRenamed("valor", "antes").join(order, ["campo", "antes"]).join(have.withColumnRenamed("valor", "despues"), ["root", "campo", "despues"])
    edges = materialise(edges.select("root", "campo", "antes", "despues"), "orders")
    n, seen = edges.count(), 0
    while n > seen:
        further = edges.withColumnRenamed("despues", "mid").join(edges.withColumnRenamed("antes", "mid"), ["root", "campo", "mid"]).select("root", "campo", "antes", "despues")
        longer = materialise(edges.unionByName(further).distinct(), "orders")
        discard(edges)
        edges, seen, n = longer, n, longer.count()
    return edges


def grouped(tracks: DataFrame, time: str = "actualizado_en") -> DataFrame:
    """The summaries of :func:`_summaries` with the ``root`` of their duplicate group, materialised.

    Tracks are linked through identifiers: an identifier is a node, a track links the identifiers it has. Identifiers of a single track link
    nothing and go first: what follows runs over the tracks that share one. Of these only one row per (shared identifiers, state,
    bitrate) is linked and joined to the components.
    """
    rows = with_identifiers(tracks, time)
    nodes = [F.when(F.col(c).isNotNull(), _node(c)).alias(n) for c, n in zip(IDENTIFIERS, NODES)]
    keyed = materialise(rows.select("id", "bitrate_kbps", "_t", "_state", *nodes).filter(F.coalesce(*NODES).isNotNull()), "keyed")
    each = keyed.select("id", F.explode(F.array_compact(F.array(*NODES))).alias("node"))
    shared = materialise(each.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("node"), "shared")
    linked = each.join(shared, "node").groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("_nodes"))  # three a row of the track
    per_key = materialise(_summaries(keyed.join(linked, "id")).withColumn("_key", F.col("_nodes")[0]), "summaries")
    links = per_key.select(F.col("_key").alias("a"), F.explode("_nodes").alias("b")).filter("a <> b").distinct()
    roots = connected_components(links)
    out = per_key.drop("_nodes").join(roots.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    made = materialise(out, "grouped")
    for table in (keyed, shared, per_key):
        discard(table)
    return made


def _latest_undated(groups: DataFrame) -> DataFrame | None:
    """(root, campo, i): where rows without a time decide, minus the id of the topologically latest one; None if no row lacks its time.

    A candidate is the latest dated row of the group that has the field, or a row without a time, by its profile of attributes. One
    profile comes before another if the group's partial order says so for some attribute and the reverse for none. Those
    that come after the dated candidate (all, if there is none) compete: the one with most candidates before it wins.
    """
    missing = F.greatest(*[F.col(f"undated_{c}").isNotNull() for c in IDENTIFIERS])
    opened = materialise(groups.filter(missing).select("root").distinct(), "undated")
    if opened.isEmpty():
        return None
    attributes = list(ATTRIBUTES.values())
    mine = groups.join(opened, "root")
    per = mine.groupBy("root", *attributes).agg(*[F.max(f"{k}_{c}").alias(f"{k}_{c}") for k in ("dated", "undated") for c in IDENTIFIERS])
    per = materialise(per.select("root", *attributes, F.explode(F.array(*[F.struct(F.lit(c).alias("de"), F.col(f"dated_{c}").alias("d"), F.col(f"undated_{c}").alias("u")) for c in IDENTIFIERS])).alias("x")).select("root", *attributes, "x.*").filter("d is not null or u is not null"), "profiles")
    orders = group_orders(mine.select("root", _values().alias("v")).select("root", "v.*"), without_cycles(learn_precedence(groups)))
    dated = per.filter("d is not null").groupBy("root", "de").agg(F.max(F.struct("d", *attributes)).alias("x")).select("root", "de", *[f"x.{a}" for a in attributes], F.lit(True).alias("dated"))
    loose = per.filter("u is not null").select("root", "de", *attributes, F.lit(False).alias("dated"), "u")
    profile = F.struct(*attributes)
    before = dated.unionByName(loose.drop("u")).select("root", "de", "dated", profile.alias("x"), _values().alias("v")).select("root", "de", "dated", "x", "v.*")
    after = loose.select("root", "de", profile.alias("y"), _values().alias("v")).select("root", "de", "y", "v.*")
    for_it = before.withColumnRenamed("valor", "antes").join(orders, ["root", "campo", "antes"]).join(after.withColumnRenamed("valor", "despues"), ["root", "de", "campo", "despues"]).withColumn("s", F.lit(1))
    against = before.withColumnRenamed("valor", "despues").join(orders, ["root", "campo", "despues"]).join(after.withColumnRenamed("valor", "antes"), ["root", "de", "campo", "antes"]).withColumn("s", F.lit(-1))
    columns = ["root", "de", "x", "y", "dated", "s"]
    pairs = for_it.select(columns).unionByName(against.select(columns)).groupBy("root", "de", "x", "y").agg(F.min("s").alias("worst"), F.max("dated").alias("dated")).filter("worst = 1")
    depth = pairs.groupBy("root", "de", "y").agg(F.count("*").alias("n"), F.max("dated").alias("follows"))
    ranked = loose.withColumn("y", profile).join(depth, ["root", "de", "y"], "left").join(dated.select("root", "de", F.lit(True).alias("has")), ["root", "de"], "left")
    ranked = ranked.filter(F.col("has").isNull() | F.coalesce("follows", F.lit(False)))
    return ranked.groupBy("root", "de").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("u").alias("i"))).alias("b")).select("root", F.col("de").alias("campo"), "b.i")


def current_rows(tracks: DataFrame, time: str = "actualizado_en") -> DataFrame:
    """(grupo_id, campo, pista_id, por_orden): :func:`survivors`, with whether the learned order and not a time chose the row."""
    groups = grouped(tracks, time)
    dated = [F.max(F.col(f"dated_{c}")).alias(f"dated_{c}") for c in IDENTIFIERS]
    per = groups.groupBy("root").agg(F.min("low").alias("grupo_id"), F.max("high").alias("_high"), *dated, F.max("bit").alias("bit"), F.max("full").alias("full")).filter("grupo_id < _high")
    chosen = [F.struct(F.lit(c).alias("campo"), F.col(f"dated_{c}.i").alias("i")) for c in IDENTIFIERS]
    chosen += [F.struct(F.lit("bitrate_kbps").alias("campo"), F.col("bit.i").alias("i")), F.struct(F.lit("registro").alias("campo"), F.col("full.i").alias("i"))]
    rows = per.select("root", "grupo_id", F.explode(F.array(*chosen)).alias("_c")).select("root", "grupo_id", "_c.*")
    undated = _latest_undated(groups)
    if undated is None:
        return rows.filter("i is not null").select("grupo_id", "campo", (-F.col("i")).alias("pista_id"), F.lit(False).alias("por_orden"))
    rows = rows.join(undated.withColumnRenamed("i", "_o"), ["root", "campo"], "left")
    return rows.select("grupo_id", "campo", (-F.coalesce("_o", "i")).alias("pista_id"), F.col("_o").isNotNull().alias("por_orden")).filter("pista_id is not null")


def survivors(tracks: DataFrame, time: str = "actualizado_en") -> DataFrame:
    """(grupo_id, campo, pista_id): for each duplicate group the row that supplies each field, and the surviving row.

    Groups, usable values and choices are those of TESTDATA.md, problem 5. ``grupo_id`` is the smallest id of the group.

    Currency: among rows with a ``time`` the latest is the most current. For rows without one the transitions between values of
    ATTRIBUTES are learned from the dated rows of all groups; in each group they give a partial order of the values that
    it shows, and the topologically latest row wins if it comes after the latest dated row, or if no row is dated. Values with
    no path between them in the group leave the dated row in place. Where every row has a time the order changes nothing.

    Defined cases: rows without id are ignored, rows without a usable identifier are in no group; repeated rows (same id)
    make no group by themselves; null states are one state; ties go to the smallest id; an empty table gives an empty
    result; further columns are ignored.
    """
    return current_rows(tracks, time).drop("por_orden")
