"""Incremental exchange, over the library's change times and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.operators import jobs as K
from tonalis.operators import sync as Y
from tonalis.operators.listening import membership
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()

_LOG = """(SELECT 'pista' AS entidad, id AS entidad_id, epoch_us(actualizado_en) AS version FROM pistas UNION ALL SELECT 'album', id, epoch_us(creado_en) FROM albums UNION ALL SELECT 'artista', id, epoch_us(creado_en) FROM artistas)"""


def _log(t: Tables) -> DataFrame:
    one = lambda df, c: df.select("id", Y.version_of(F.col(c)).alias("version"))
    return Y.entities({"pista": one(t.pistas, "actualizado_en"), "album": one(t.albums, "creado_en"), "artista": one(t.artistas, "creado_en")})


@query("SELECT id, row_number() OVER (ORDER BY actualizado_en, id) + 1000 AS version FROM pistas")
def sync_stamp(t: Tables) -> DataFrame:
    """Consecutive versions in the order of the changes."""
    return Y.stamp(t.pistas.select("id", "actualizado_en"), [F.asc("actualizado_en"), F.asc("id")], 1000).select("id", "version")


@query("""SELECT p.id, p.titulo, p.actualizado_en, e.valores IS NOT NULL AS con_ejes FROM pistas p LEFT JOIN ejes_pista e ON e.pista_id = p.id WHERE p.actualizado_en > (SELECT max(actualizado_en) FROM pistas) - INTERVAL 90 DAY""")
def sync_delta(t: Tables) -> DataFrame:
    """Tracks changed in the last ninety days, with whether they have axes."""
    since = t.pistas.agg(F.max("actualizado_en") - F.expr("INTERVAL '90' DAY")).scalar()
    d = Y.delta(t.pistas.select("id", "titulo", "actualizado_en"), "actualizado_en", since)
    return d.join(t.ejes_pista.select(F.col("pista_id").alias("id"), "valores"), "id", "left").select("id", "titulo", "actualizado_en", F.col("valores").isNotNull().alias("con_ejes"))


@query(f"SELECT entidad, entidad_id, version FROM {_LOG}")
def sync_log(t: Tables) -> DataFrame:
    return _log(t)


@query(f"""WITH x AS (SELECT *, row_number() OVER (ORDER BY version, entidad, entidad_id) AS n FROM {_LOG} WHERE version > 1609500000000000)
SELECT entidad, entidad_id, version, (SELECT count(*) FROM x) > 100 AS hay_mas, (SELECT version FROM x WHERE n <= 100 ORDER BY n DESC LIMIT 1) AS siguiente, (SELECT entidad FROM x WHERE n <= 100 ORDER BY n DESC LIMIT 1) AS siguiente_entidad, (SELECT entidad_id FROM x WHERE n <= 100 ORDER BY n DESC LIMIT 1) AS siguiente_id FROM x WHERE n <= 100""")
def sync_page(t: Tables) -> DataFrame:
    """A page of the merged change log."""
    return Y.page(_log(t), 1609500000000000, 100)


@query("""SELECT sesion_id AS lista_id, list(pista_id ORDER BY agregado, pista_id) AS ids FROM (SELECT sesion_id, pista_id, min(calculado_en) AS agregado FROM score_detalle GROUP BY 1, 2) GROUP BY 1""")
def sync_playlists(t: Tables) -> DataFrame:
    """Every playlist with its ordered ids."""
    return Y.ordered_members(membership(t.score_detalle), "lista_id", "pista_id", "agregado")


@query("""SELECT entidad, entidad_id FROM (SELECT 'pista' AS entidad, id AS entidad_id FROM pistas WHERE artista_id IN (1, 2, 3) UNION SELECT 'album', album_id FROM pistas WHERE artista_id IN (1, 2, 3) AND album_id IS NOT NULL UNION SELECT 'artista', artista_id FROM pistas WHERE artista_id IN (1, 2, 3))""")
def sync_selection(t: Tables) -> DataFrame:
    """What a choice of artists needs."""
    return Y.closure(t.pistas, [1, 2, 3])


@query("""SELECT h.pista_id AS entidad_id, count(*) AS n FROM (SELECT DISTINCT id, pista_id FROM historial) h WHERE h.pista_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pistas p WHERE p.id = h.pista_id) GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM (SELECT DISTINCT id, titulo_snap FROM historial WHERE pista_id IS NULL)""")
def sync_tombstones(t: Tables) -> DataFrame:
    """Plays whose track is gone: by id where it is known, and those without one."""
    h = t.historial.select("id", "pista_id", "titulo_snap").distinct()
    known = h.filter("pista_id is not null").select("id", "pista_id").distinct().join(t.pistas.select(F.col("id").alias("pista_id")), "pista_id", "left_anti").groupBy(F.col("pista_id").alias("entidad_id")).agg(F.count("*").alias("n"))
    return known.unionByName(h.filter("pista_id is null").agg(F.lit(None).cast("bigint").alias("entidad_id"), F.count("*").alias("n")))


@query("""WITH r AS (SELECT user_id AS id, arg_max((value > 20)::INT, (ts, (value > 20)::INT)) AS favorita, max(ts) AS t FROM events GROUP BY 1), l AS (SELECT id, favorita, ultimo_acceso AS t FROM pistas)
SELECT l.id, CASE WHEN r.t IS NOT NULL AND (l.t IS NULL OR r.t > l.t) THEN r.favorita ELSE l.favorita END AS favorita, CASE WHEN r.t IS NOT NULL AND (l.t IS NULL OR r.t > l.t) THEN r.t ELSE l.t END AS t, (r.t IS NOT NULL AND (l.t IS NULL OR r.t > l.t)) AS remota FROM l LEFT JOIN r ON r.id = l.id""")
def sync_last_write(t: Tables) -> DataFrame:
    """Favourites of the library overruled by newer ones of the event stream."""
    local = t.pistas.select("id", "favorita", F.col("ultimo_acceso").alias("t"))
    remote = t.events.select(F.col("user_id").alias("id"), (F.col("value") > 20).cast("int").alias("favorita"), F.col("ts").alias("t"))
    return Y.last_write_wins(local, remote, "id", "favorita", "t")


@query("""SELECT user_id, max(ts) AS visto, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1""")
def sync_active_devices(t: Tables) -> DataFrame:
    return Y.active_since(t.events, "user_id", "ts", 2)


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def sync_upsert(t: Tables) -> DataFrame:
    """The last event of each key: what an upsert of the stream would leave."""
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return Y.latest(e, ["user_id", "k"], "ts", "event_id", ["event_type", "value"])


@query("""SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT id, pista_id, reproducido_en FROM historial)""")
def sync_append(t: Tables) -> DataFrame:
    """Two copies of the play log merged: every play once."""
    h = t.historial.select("id", "pista_id", "reproducido_en")
    return Y.union_log([h, h], ["id", "pista_id", "reproducido_en"]).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT b.id, coalesce(b.mb_release_id, 'ruta:' || min(p.ruta_archivo)) AS portada FROM albums b LEFT JOIN pistas p ON p.album_id = b.id GROUP BY b.id, b.mb_release_id")
def sync_covers(t: Tables) -> DataFrame:
    """An album's release, else a path of one of its tracks."""
    first = t.pistas.filter("album_id is not null").groupBy(F.col("album_id").alias("id")).agg(F.min("ruta_archivo").alias("r"))
    return t.albums.select("id", "mb_release_id").join(first, "id", "left").select("id", F.coalesce("mb_release_id", F.concat(F.lit("ruta:"), "r")).alias("portada"))


_STATES = ["view", "click", "purchase", "signup", "error"]


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in _STATES) + ", count(*) AS total FROM events")
def job_counts(t: Tables) -> DataFrame:
    return K.counts_by_state(t.events, "event_type", _STATES)


@query("SELECT event_id, user_id, ts FROM events WHERE event_type IN ('signup', 'error') ORDER BY user_id, ts, event_id LIMIT 1")
def job_next(t: Tables) -> DataFrame:
    """The next job by priority and arrival."""
    return K.next_job(t.events, "event_type", ["signup", "error"], ["user_id", "ts", "event_id"]).select("event_id", "user_id", "ts")


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1")
def job_next_fifo(t: Tables) -> DataFrame:
    return K.next_job(t.events, "event_type", ["signup"], ["ts", "event_id"]).select("event_id", "ts")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def job_latest(t: Tables) -> DataFrame:
    return K.last_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS event_type FROM events")
def job_recovered(t: Tables) -> DataFrame:
    return K.recovered(t.events.select("event_id", "event_type"), "event_type", "click", "view")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY 1) WHERE e IN ('click', 'view'))")
def job_enqueue(t: Tables) -> DataFrame:
    """Items whose last job is not active."""
    last = K.last_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])
    return K.to_enqueue(t.events.select("user_id").distinct(), last, "user_id", "event_type", ["click", "view"])


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS intentos, arg_max(event_type, (ts, event_id)) AS ultimo FROM events GROUP BY 1")
def job_attempts(t: Tables) -> DataFrame:
    return K.attempts(t.events, "user_id", "event_type", "signup")


@query("""WITH r AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'view')) AS hechas, date_diff('millisecond', min(ts), max(ts)) AS ms FROM events GROUP BY 1)
SELECT user_id, total, hechas, round(CASE WHEN hechas > 0 AND ms > 0 THEN ms / hechas END, 4) AS ms_por_pista, round(CASE WHEN hechas > 0 AND ms > 0 THEN hechas / (ms / 60000.0::DOUBLE) ELSE 0.0::DOUBLE END, 8) AS por_minuto,
round(CASE WHEN hechas > 0 AND ms > 0 THEN ms / hechas * greatest(total - hechas, 0) / 1000.0::DOUBLE WHEN total - hechas <= 0 THEN 0.0::DOUBLE END, 3) AS faltan_seg FROM r""")
def run_eta(t: Tables) -> DataFrame:
    """Mean time, rate and time left of every run (the events of a user as its items)."""
    ms = F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1000) - F.floor(F.unix_micros(F.min("ts").cast("timestamp")) / 1000)
    r = t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("hechas"), ms.alias("ms"))
    e = K.eta_columns(F.col("total"), F.col("hechas"), F.col("ms"))
    return r.select("user_id", "total", "hechas", F.round(e["ms_por_pista"], 4).alias("ms_por_pista"), F.round(e["por_minuto"], 8).alias("por_minuto"), F.round(e["faltan_seg"], 3).alias("faltan_seg"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 0), r AS (SELECT user_id, n, value AS m FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, 0.35::DOUBLE * o.value + 0.65::DOUBLE * r.m FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, round(arg_max(m, n), 5) AS media FROM r GROUP BY 1""")
def run_ewma(t: Tables) -> DataFrame:
    """The exponentially weighted mean of the values of every user in order."""
    e = t.events.select("user_id", "ts", "event_id", "value")
    return K.ewma_rows(e, "user_id", [F.desc("ts"), F.desc("event_id")], "value").select("user_id", F.round("media", 5).alias("media"))


@query("SELECT user_id, round(avg(value), 6) AS media, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
def run_means(t: Tables) -> DataFrame:
    return t.events.filter("value > 0").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("media"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS turno FROM events WHERE event_type IN ('signup', 'click')")
def job_listing(t: Tables) -> DataFrame:
    """The active jobs in order of arrival, numbered over pieces."""
    from tonalis.operators.library import number_rows

    a = t.events.filter(F.col("event_type").isin("signup", "click")).select(F.lit(0).alias("g"), "event_id", "user_id", "ts")
    return number_rows(a, ["g"], [F.asc("ts"), F.asc("event_id")], "turno").select("event_id", "user_id", "ts", "turno")


@query("""SELECT id, coalesce(finalizado_en, (SELECT max(creado_en) FROM dj_sesiones)) AS fin, finalizado_en IS NULL AS cerrada FROM dj_sesiones""")
def job_close_orphans(t: Tables) -> DataFrame:
    """Sessions that never ended are closed at the time of the newest."""
    last = t.dj_sesiones.agg(F.max("creado_en")).scalar()
    return t.dj_sesiones.select("id", F.coalesce("finalizado_en", last).alias("fin"), F.col("finalizado_en").isNull().alias("cerrada"))


_RUNS = """s AS (SELECT user_id, ts, epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS e, event_id FROM events WHERE event_type <> 'error'), t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)"""


@query(f"""WITH {_RUNS}, n AS (SELECT s.user_id, e, total, row_number() OVER (PARTITION BY s.user_id ORDER BY ts, e) AS k FROM s JOIN t ON t.user_id = s.user_id), u AS (SELECT *, e / k AS v, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) - 1 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM n WHERE e >= 3 AND k >= 2),
m AS (SELECT user_id, sum(v * pow(0.75, b) * CASE WHEN b = n - 1 THEN 1.0 ELSE 0.25 END) AS m FROM u GROUP BY 1), d AS (SELECT user_id, max(k) AS hechos, max(total) AS total FROM n GROUP BY 1)
SELECT d.user_id, CAST(hechos AS INT) AS hechos, CASE WHEN total > hechos AND m IS NOT NULL THEN greatest(1, CAST(round(m * (total - hechos)) AS INT)) END AS resto FROM d LEFT JOIN m ON m.user_id = d.user_id""")
def import_eta(t: Tables) -> DataFrame:
    """What every run still needs by a smoothed mean; here a user is a run and an error an item that is still to be done."""
    start = t.events.filter("event_type <> 'error'").groupBy("user_id").agg(F.min("ts").alias("_s"))
    total = t.events.groupBy("user_id").agg(F.count("*").alias("total"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - (F.unix_micros(F.col("_s").cast("timestamp")) / 1e6)
    steps = t.events.filter("event_type <> 'error'").join(start, "user_id").join(total, "user_id").select("user_id", "ts", seconds.alias("e"), "total")
    return K.smoothed_rest(steps, "user_id", "ts", "e", "total")


@query("""WITH q AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS hechos, sum(value) AS pasado, max(value) / 100 AS parte, min(value) AS actual FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) GROUP BY 1)
SELECT user_id, round(CASE WHEN hechos > 0 AND pasado > 0 THEN greatest(0.001, pasado) / hechos * greatest(0, total - hechos) WHEN parte > 0.05 AND actual > 0 AND total - hechos > 0 THEN greatest(0.001, actual) / parte * (1 - parte) + greatest(0.001, actual) / parte * greatest(0, total - hechos - 1) END, 4) AS resto FROM q""")
def queue_eta(t: Tables) -> DataFrame:
    """What every queue still needs; here the events of the first day by user."""
    first = t.events.agg(F.to_date(F.min("ts"))).scalar()
    q = t.events.filter(F.to_date("ts") == first).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("hechos"), F.sum("value").alias("pasado"), (F.max("value") / 100).alias("parte"), F.min("value").alias("actual"))
    return q.select("user_id", F.round(K.queue_rest(*[F.col(c) for c in ("hechos", "total", "pasado", "parte", "actual")]), 4).alias("resto"))


@query("""WITH m AS (SELECT DISTINCT pista_id FROM score_detalle WHERE sesion_id IN (2, 3, 4)), p AS (SELECT id, album_id, artista_id FROM pistas WHERE id IN (SELECT pista_id FROM m))
SELECT DISTINCT entidad, entidad_id FROM (SELECT 'pista' AS entidad, id AS entidad_id FROM p UNION ALL SELECT 'album', album_id FROM p WHERE album_id IS NOT NULL UNION ALL SELECT 'artista', artista_id FROM p WHERE artista_id IS NOT NULL UNION ALL SELECT 'lista', id FROM dj_sesiones WHERE id IN (2, 3, 4))""")
def sync_playlist_selection(t: Tables) -> DataFrame:
    """What a choice of playlists needs: their tracks with albums and artists, and the lists."""
    return Y.playlist_closure(t.pistas, t.dj_sesiones.select("id"), t.score_detalle.select(F.col("sesion_id").alias("lista_id"), "pista_id"), [2, 3, 4])


@query(f"""WITH l AS (SELECT * FROM {_LOG} WHERE version > 1609500000000000), v AS (SELECT max(version) AS v FROM {_LOG}) SELECT entidad, count(*) AS n, max(version) AS ultima, (SELECT v FROM v) AS version_actual, list(entidad_id ORDER BY version DESC, entidad_id)[1:5] AS recientes FROM l GROUP BY 1""")
def sync_manifest(t: Tables) -> DataFrame:
    """The manifest of the changes after a version: per entity how many, the last one, and the five newest ids."""
    return Y.manifest(_log(t), 1609500000000000, 5)


@query("""WITH m AS (SELECT epoch_us(max(actualizado_en)) AS v FROM pistas), c AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM pistas WHERE genero = 'jazz') SELECT p.id, CASE WHEN c.id IS NULL THEN p.favorita ELSE 1 - p.favorita END AS favorita, CASE WHEN c.id IS NULL THEN epoch_us(p.actualizado_en) ELSE (SELECT v FROM m) + c.k END AS version FROM pistas p LEFT JOIN c ON c.id = p.id""")
def sync_toggle(t: Tables) -> DataFrame:
    """Favourites of one genre switched over and stamped with new versions."""
    rows = t.pistas.select("id", "favorita", Y.version_of(F.col("actualizado_en")).alias("version"))
    return Y.toggled(rows, t.pistas.filter("genero = 'jazz'").select("id"), "favorita")
