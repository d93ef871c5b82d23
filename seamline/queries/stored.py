"""The stored index, kept by snapshots and by a stream, functions around sites, and constants by scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import constants, extract, store
from seamline.plans.lineage import fresh_folder
from seamline.sources.lens import lens, lens_sql
from seamline.sources.tables import table
from seamline.streaming import upsert_stream

_ID = "concat_ws(':', user_id, event_type) AS id"
_FILE = lambda c: F.concat(F.lit("f"), F.col(c) % 10).alias("file")
_ROUNDS = ("event_id % 3 <> 0", "event_id % 5 <> 0", "event_id % 7 > 2")


def stored_index(spark, folder):
    """Three snapshots of the events' last properties, one after the other: the table's records and the files that each touched."""
    e, path = table(spark, folder, "events"), fresh_folder(spark)
    for where in _ROUNDS:
        last = e.where(where).groupBy("user_id", "event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("json"))
        store.sync_table(spark, path, last.select(F.lit("default").alias("repo"), F.expr(_ID), _FILE("user_id"), "json"))
    rows = store.read(spark, path).select(F.lit(len(_ROUNDS)).alias("version"), "repo", "id", "file", "json")
    for n in range(len(_ROUNDS)):
        rows = rows.unionByName(store.touched(spark, path, n).select(F.lit(n).alias("version"), "repo", F.lit(None).cast("string").alias("id"), "file", F.lit(None).cast("string").alias("json")))
    return rows


def streamed_index(spark, folder):
    """Events as a stream of changes in no order, signups as deletions, in three batches; the table after the last."""
    source, path, log = (fresh_folder(spark) for _ in range(3))
    gone = F.when(F.col("event_type") != "signup", F.col("props"))
    changes = table(spark, folder, "events").select(F.lit("default").alias("repo"), F.col("user_id").cast("string").alias("id"), _FILE("event_id"), gone.alias("json"), F.col("event_id").alias("ord"))
    changes.repartition(6, F.col("ord") % 6).write.parquet(source)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(source)
    upsert_stream(stream, path, log).awaitTermination()
    return store.read(spark, path)


def enclosing_functions(spark, folder):
    """The innermost function and the nearest component around each API call, with functions that nest and overlap."""
    length = F.when(F.col("line") == 0, 380).when(F.col("line") == 10, 200).when(F.col("line") == 20, 30).otherwise(250) + F.length("name")
    spans = lens(spark, folder, "functions").select("repo", "file", "id", "name", "line", (F.col("line") + length).alias("last_line"), F.col("containing_component").isNotNull().alias("component"))
    return extract.enclosing(lens(spark, folder, "api_calls"), spans)


def scoped_constants(spark, folder):
    """Constants of nested classes with supertypes and static imports."""
    get = lambda n: lens(spark, folder, n)
    parts = get("scoped_parts").groupBy("repo", "type", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "literal", "ref", "owner"))), lambda p: F.struct(p["literal"].alias("literal"), p["ref"].alias("ref"), p["owner"].alias("owner"))).alias("parts"))
    return constants.scoped_constants(get("scoped_types").withColumnRenamed("outer_type", "outer"), get("scoped_supers"), get("scoped_imports"), parts)


_LAST = lambda v, where: f"SELECT {v} AS v, user_id || ':' || event_type AS id, 'f' || (user_id % 10) AS file, max_by(props, (ts, event_id)) AS json FROM events WHERE {where} GROUP BY user_id, event_type"
QUERIES = {f.__name__: f for f in (stored_index, streamed_index, enclosing_functions, scoped_constants)}
ORACLES = {
    "stored_index": f"""WITH s AS ({" UNION ALL ".join(_LAST(v, w) for v, w in enumerate(_ROUNDS))}),
      t AS (SELECT DISTINCT coalesce(b.v, a.v + 1) AS version, coalesce(b.file, a.file) AS file FROM (FROM s WHERE v < {len(_ROUNDS) - 1}) a FULL JOIN s b ON b.id = a.id AND b.v = a.v + 1 WHERE a.json IS DISTINCT FROM b.json)
      SELECT CAST({len(_ROUNDS)} AS INT) AS version, 'default' AS repo, id, file, json FROM s WHERE v = {len(_ROUNDS) - 1} UNION ALL SELECT CAST(version AS INT), 'default', NULL, file, NULL FROM t""",
    "streamed_index": """SELECT 'default' AS repo, user_id::VARCHAR AS id, 'f' || (event_id % 10) AS file, props AS json, event_id AS ord FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'signup'""",
    "enclosing_functions": f"""WITH {lens_sql('functions', 'api_calls')}, sp AS (SELECT *, line + CASE line WHEN 0 THEN 380 WHEN 10 THEN 200 WHEN 20 THEN 30 ELSE 250 END + length(name) AS last FROM functions),
      m AS (SELECT c.repo, c.file, c.line, s.id AS fn, s.name, s.containing_component IS NOT NULL AS comp, row(s.last - s.line, -s.line, s.id) AS o
        FROM (SELECT DISTINCT repo, file, line FROM api_calls) c JOIN sp s ON s.repo = c.repo AND s.file = c.file AND c.line BETWEEN s.line AND s.last),
      g AS (SELECT repo, file, line, arg_min(fn, o) AS function_id, arg_min(name, o) FILTER (comp) AS component FROM m GROUP BY repo, file, line)
      SELECT repo, id, function_id, component FROM api_calls JOIN g USING (repo, file, line)""",
    "scoped_constants": f"""WITH RECURSIVE {lens_sql('scoped_types', 'scoped_supers', 'scoped_imports', 'scoped_parts')},
      up AS (SELECT type, type AS holder, []::INT[] AS way FROM scoped_types UNION ALL SELECT u.type, s.parent, u.way || [CAST(s.ord AS INT)] FROM up u JOIN scoped_supers s ON s.type = u.holder WHERE s.parent IN (SELECT type FROM scoped_types)),
      ar AS (SELECT type, type AS scope, 0 AS level FROM scoped_types UNION ALL SELECT a.type, t.outer_type, a.level + 1 FROM ar a JOIN scoped_types t ON t.type = a.scope WHERE t.outer_type IS NOT NULL),
      us AS (SELECT DISTINCT type, owner, ref FROM scoped_parts WHERE ref IS NOT NULL),
      sc AS (SELECT us.*, scope, level FROM us JOIN ar USING (type) WHERE owner IS NULL UNION ALL SELECT us.*, owner, 0 FROM us WHERE owner IS NOT NULL
        UNION ALL SELECT us.*, i.owner, 1000000 + i.ord FROM us JOIN scoped_imports i USING (type) WHERE us.owner IS NULL AND (i.name IS NULL OR i.name = us.ref)),
      de AS (SELECT DISTINCT type AS holder, name AS ref FROM scoped_parts),
      tg AS (SELECT sc.type, sc.owner, sc.ref, up.holder FROM sc JOIN up ON up.type = sc.scope JOIN de ON de.holder = up.holder AND de.ref = sc.ref QUALIFY row_number() OVER (PARTITION BY sc.type, sc.owner, sc.ref ORDER BY level, way) = 1),
      bp AS (SELECT p.*, t.holder FROM scoped_parts p LEFT JOIN tg t ON t.type = p.type AND t.ref = p.ref AND t.owner IS NOT DISTINCT FROM p.owner),
      ba AS (SELECT type, max(holder) AS prev, max(literal) AS own FROM bp WHERE name = 'BASE' GROUP BY type),
      bv AS (SELECT type, own AS value FROM ba WHERE prev IS NULL AND type NOT IN (SELECT type FROM bp WHERE name = 'BASE' AND ref IS NOT NULL) UNION ALL SELECT ba.type, bv.value || ba.own FROM ba JOIN bv ON bv.type = ba.prev),
      pv AS (SELECT p.type, any_value(v.value) || any_value(p2.literal) AS value FROM bp p LEFT JOIN bv v ON v.type = p.holder JOIN bp p2 ON p2.type = p.type AND p2.name = 'PATH' AND p2.i = 1 WHERE p.name = 'PATH' AND p.i = 0 GROUP BY p.type),
      fv AS (SELECT p.type, v.value || '/f' || CASE WHEN q.type IS NULL THEN '' ELSE w.value END AS value FROM bp p LEFT JOIN pv v ON v.type = p.holder LEFT JOIN (FROM bp WHERE name = 'FULL' AND i = 2) q ON q.type = p.type LEFT JOIN bv w ON w.type = q.holder WHERE p.name = 'FULL' AND p.i = 0),
      al AS (SELECT type, 'BASE' AS name, (SELECT value FROM bv WHERE bv.type = ba.type) AS value FROM ba UNION ALL SELECT type, 'PATH', value FROM pv UNION ALL SELECT type, 'FULL', value FROM fv UNION ALL SELECT type, name, NULL FROM bp WHERE name = 'ROUND')
      SELECT 'default' AS repo, type, name, coalesce(value, '<expr>') AS value FROM al""",
}
