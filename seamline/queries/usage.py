"""Linking, usage, rankings, search and graphs over the lens tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import graph, link, usage
from seamline.plans.lineage import stored
from seamline.queries.duck import linked, norm, shown
from seamline.sources.lens import lens, lens_sql


#: What graphs and impacts of files read of linked calls.
CALLS = ("repo", "id", "api_key", "status", "endpoint_id", "caller_function_id", "wrapper_function_id", "file")


class Facts:
    """The lens tables of one folder, linked, each derived when first asked for. ``keep`` stores endpoints and linked
    calls, for queries that read them several times: with all columns, or those named, so that no others are shuffled."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool | tuple[str, ...] = False):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _lens(self, name: str) -> DataFrame:
        return lens(self.spark, self.folder, name)

    @cached_property
    def endpoints(self) -> DataFrame:
        return stored(self._lens("endpoints")) if self.keep else self._lens("endpoints")

    @cached_property
    def functions(self) -> DataFrame:
        return self._lens("functions")

    @cached_property
    def files(self) -> DataFrame:
        return self._lens("files")

    @cached_property
    def calls(self) -> DataFrame:
        return self._lens("api_calls")

    @cached_property
    def reads(self) -> DataFrame:
        return self._lens("property_accesses")

    @cached_property
    def linked(self) -> DataFrame:
        found = link.link_calls(self.calls, self.endpoints)
        if not self.keep:
            return found
        return stored(found if self.keep is True else found.select(*self.keep))

    def usage(self) -> DataFrame:
        return usage.api_usage(self.linked, self.reads, self.functions, self.endpoints)

    def graph(self):
        return graph.build_graph(self.linked, self.reads, self.functions, self.endpoints)


def link_calls(spark, folder):
    return Facts(spark, folder).linked.select("repo", "id", "status", "endpoint_id", "candidates", "api_key")


def configured_clients(spark, folder):
    f = Facts(spark, folder)
    clients = f.endpoints.where("pos % 50 = 0").groupBy("repo", F.concat(F.lit("client."), F.lower("method")).alias("callee")).agg(F.min_by("method", "pos").alias("method"), F.min_by("path", "pos").alias("path"))
    return link.with_clients(f.calls, clients).groupBy("repo", "resolution", "method", "endpoint_pattern").agg(F.count("*").alias("calls"), F.count("query_keys").alias("with_keys"))


def call_sites(spark, folder):
    f = Facts(spark, folder)
    return usage.call_sites(f.linked, f.functions).select("repo", "id", "api_key", "file", "function_name", "component", "via")


def field_reads(spark, folder):
    f = Facts(spark, folder)
    return usage.field_reads(f.reads, f.linked).select("repo", "id", "api_key", "status", "file", "call_file")


def rank_apis(spark, folder):
    return usage.rank_apis(Facts(spark, folder, keep=True).usage())


def api_usage_no_backend(spark, folder):
    f = Facts(spark, folder)
    bare = f.calls.withColumns({"status": F.lit("not-found"), "endpoint_id": F.lit(None).cast("string"), "api_key": F.coalesce(F.concat_ws(" ", F.coalesce("method", F.lit("?")), F.when(F.col("endpoint_pattern").isNotNull(), F.col("endpoint_pattern")).otherwise(F.concat(F.lit("<"), "callee", F.lit(">")))))})
    return usage.api_usage(bare, f.reads, f.functions, None)


def field_counts(spark, folder):
    f = Facts(spark, folder)
    return usage.field_counts(f.reads, f.linked)


def unused_endpoints(spark, folder):
    f = Facts(spark, folder)
    return usage.unused_endpoints(f.linked, f.endpoints)


def file_apis(spark, folder):
    f = Facts(spark, folder)
    return usage.file_apis(f.linked, f.reads)


def rank_files(spark, folder):
    f = Facts(spark, folder)
    return usage.rank_files(f.linked, f.reads)


def client_functions(spark, folder):
    f = Facts(spark, folder)
    return usage.client_functions(f.linked.withColumn("file", F.when(F.col("col") == 3, F.concat("file", F.lit("x"))).otherwise(F.col("file"))), f.functions)


def blast_radius(spark, folder):
    f = Facts(spark, folder, keep=CALLS)
    return usage.blast_radius(f.linked, f.reads, f.functions)


def index_summary(spark, folder):
    f = Facts(spark, folder)
    return usage.summary(f.files, f.functions, f.calls, f.reads)


def match_api_keys(spark, folder):
    f = Facts(spark, folder, keep=True)
    return usage.match_api_keys(usage.api_keys(f.linked, f.endpoints), f.endpoints, "get /b1/economy/small/bolt/:id").unionByName(usage.match_api_keys(usage.api_keys(f.linked, f.endpoints), f.endpoints, "c1#H"))


def search(spark, folder):
    f = Facts(spark, folder, keep=True)
    return usage.search("card1", f.usage(), f.linked, f.reads, f.functions, f.files, usage.blast_radius(f.linked, f.reads, f.functions)).unionByName(
        usage.search("s1", f.usage(), f.linked, f.reads, f.functions, f.files, usage.blast_radius(f.linked, f.reads, f.functions)).where("kind = 'file'")
    )


def dependents(spark, folder):
    return graph.dependents(lens(spark, folder, "imports"))


def graph_nodes(spark, folder):
    return Facts(spark, folder, keep=CALLS).graph()[0]


def graph_edges(spark, folder):
    return Facts(spark, folder, keep=CALLS).graph()[1]


def graph_reach(spark, folder):
    nodes, edges = Facts(spark, folder, keep=CALLS).graph()
    return graph.reach(nodes, stored(edges))


def merged_graphs(spark, folder):
    f = Facts(spark, folder, keep=(*CALLS, "col"))
    halves = [graph.build_graph(f.linked.where(part), f.reads, f.functions, f.endpoints, unused=False) for part in ("col <= 3", "col >= 3")]
    nodes, edges = graph.merge_graphs(*[tuple(map(stored, half)) for half in halves])
    return nodes.select("repo", "id", "kind", "label", F.lit(None).cast("string").alias("dst")).unionByName(edges.select("repo", F.col("src").alias("id"), "kind", F.lit(None).cast("string").alias("label"), "dst"))


def api_impact(spark, folder):
    f = Facts(spark, folder, keep=True)
    keys = usage.match_api_keys(usage.api_keys(f.linked, f.endpoints), f.endpoints, "c11#h")
    found = usage.impact_of_api(keys, f.usage(), usage.field_counts(f.reads, f.linked))
    return found.withColumn("fields", F.transform("fields", lambda x: F.concat_ws("=", x["path"], x["reads"].cast("string"))))


def file_impact(spark, folder):
    f = Facts(spark, folder, keep=CALLS)
    return usage.impact_of_files(f.linked, f.reads, f.functions, graph.dependents(lens(spark, folder, "imports")))


_ONLY = "SELECT repo, id, api_key, file, call_file, status FROM reads"
_USAGE = """
keys AS (SELECT repo, api_key FROM linked UNION SELECT repo, id FROM endpoints),
u AS (
  SELECT k.repo, k.api_key, coalesce(c.status, 'unused') AS status, e.handler, coalesce(c.n, 0) AS call_sites, coalesce(r.n, 0) AS field_reads, coalesce(f.n, 0) AS files, coalesce(p.n, 0) AS components
  FROM keys k LEFT JOIN (SELECT repo, api_key, count(*) AS n, min_by(status, id) AS status FROM linked GROUP BY ALL) c USING (repo, api_key)
  LEFT JOIN (SELECT repo, api_key, count(*) AS n FROM reads GROUP BY ALL) r USING (repo, api_key)
  LEFT JOIN (SELECT repo, api_key, count(DISTINCT file) AS n FROM (SELECT repo, api_key, file FROM linked UNION SELECT repo, api_key, file FROM reads) GROUP BY ALL) f USING (repo, api_key)
  LEFT JOIN (SELECT repo, api_key, count(DISTINCT component) AS n FROM (SELECT repo, api_key, component FROM sites UNION SELECT repo, api_key, containing_component FROM reads) GROUP BY ALL) p USING (repo, api_key)
  LEFT JOIN endpoints e ON e.repo = k.repo AND e.id = k.api_key)"""
_FILE_APIS = "fa AS (SELECT repo, file, api_key, list(DISTINCT kind ORDER BY kind) AS via FROM (SELECT repo, file, api_key, 'call' AS kind FROM linked UNION ALL SELECT repo, file, api_key, 'read' FROM reads) GROUP BY repo, file, api_key)"
_RADIUS = """
t AS (SELECT repo, file AS home, id FROM linked UNION SELECT l.repo, f.file, l.id FROM linked l JOIN functions f ON f.repo = l.repo AND f.id = l.wrapper_function_id UNION SELECT repo, file, api_call_id FROM reads),
br AS (
  SELECT repo, home AS file, count(*) FILTER (kind = 'api') AS apis, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'component') AS components FROM (
    SELECT t.repo, home, 'api' AS kind, api_key AS what FROM t JOIN sites s ON s.repo = t.repo AND s.id = t.id UNION SELECT t.repo, home, 'file', s.file FROM t JOIN sites s ON s.repo = t.repo AND s.id = t.id
    UNION SELECT t.repo, home, 'component', s.component FROM t JOIN sites s ON s.repo = t.repo AND s.id = t.id UNION SELECT t.repo, home, 'file', r.file FROM t JOIN reads r ON r.repo = t.repo AND r.api_call_id = t.id
    UNION SELECT t.repo, home, 'component', r.containing_component FROM t JOIN reads r ON r.repo = t.repo AND r.api_call_id = t.id UNION SELECT repo, home, 'file', home FROM t) x
  WHERE what IS NOT NULL GROUP BY repo, home)"""


def _search(text: str) -> str:
    return f"""
  SELECT repo, 'api' AS kind, api_key AS label, handler AS detail, 1 AS apis, files FROM u WHERE contains(lower(api_key), '{text}') OR contains(lower(handler), '{text}')
  UNION ALL SELECT f.repo, 'file', path, NULL, coalesce(a.n, 0), coalesce(br.files, 1) FROM files f LEFT JOIN (SELECT repo, file, count(*) AS n FROM fa GROUP BY ALL) a ON a.repo = f.repo AND a.file = f.path
    LEFT JOIN br ON br.repo = f.repo AND br.file = f.path WHERE contains(lower(path), '{text}')
  UNION ALL SELECT f.repo, CASE WHEN containing_component = name THEN 'component' ELSE 'function' END, name, file || ':' || line, coalesce(x.apis, 0), coalesce(x.files, 0) FROM functions f
    LEFT JOIN (SELECT repo, fid, count(DISTINCT api_key) AS apis, count(DISTINCT file) AS files FROM (SELECT repo, caller_function_id AS fid, api_key, file FROM linked UNION ALL SELECT repo, wrapper_function_id, api_key, file FROM linked
      UNION ALL SELECT repo, containing_function_id, api_key, file FROM reads) GROUP BY ALL) x ON x.repo = f.repo AND x.fid = f.id WHERE name <> '<anonymous>' AND contains(lower(name), '{text}')"""


_MATCH = "keys AS (SELECT repo, api_key FROM linked UNION SELECT repo, id FROM endpoints), n AS (SELECT k.*, handler FROM keys k LEFT JOIN endpoints e ON e.repo = k.repo AND e.id = k.api_key)"
_TIER = lambda tier: f"SELECT repo, api_key, tier FROM (SELECT repo, api_key, {tier} AS tier FROM n WHERE {tier} IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY repo))"
_SECOND = "split_part(api_key, ' ', 2)"
_T1 = f"CASE WHEN api_key = 'get /b1/economy/small/bolt/:id' THEN 1 WHEN split_part(api_key, ' ', 1) = 'GET' AND split_part(api_key, ' ', 2) <> '' AND {norm(_SECOND)} = '/b1/economy/small/bolt/{{param}}' THEN 2 WHEN contains(lower(handler), 'get /b1/economy/small/bolt/:id') THEN 3 END"
_T2 = f"CASE WHEN api_key = 'c1#H' THEN 1 WHEN split_part(api_key, ' ', 2) <> '' AND {norm(_SECOND)} = '/c1#H' THEN 2 WHEN contains(lower(handler), 'c1#h') THEN 3 END"
_GRAPH = f"""
s1 AS (SELECT l.repo, 'api:' || api_key AS api, CASE WHEN f.id IS NOT NULL THEN caller_function_id ELSE 'file:' || l.file END AS target, w.id AS client, l.file, f.id IS NOT NULL AS has_caller FROM linked l
  LEFT JOIN functions f ON f.repo = l.repo AND f.id = l.caller_function_id LEFT JOIN functions w ON w.repo = l.repo AND w.id = l.wrapper_function_id),
f1 AS (SELECT r.repo, 'api:' || api_key AS api, 'field:' || api_key || '#' || {shown('r.path')} AS field, CASE WHEN f.id IS NOT NULL THEN containing_function_id ELSE 'file:' || r.file END AS usr, {shown('r.path')} AS path, api_key, r.file, f.id IS NOT NULL AS has_reader
  FROM reads r LEFT JOIN functions f ON f.repo = r.repo AND f.id = r.containing_function_id),
used AS (SELECT repo, target AS fid FROM s1 WHERE has_caller UNION SELECT repo, client FROM s1 WHERE client IS NOT NULL UNION SELECT repo, usr FROM f1 WHERE has_reader),
home AS (SELECT f.* FROM functions f JOIN used u ON u.repo = f.repo AND u.fid = f.id),
ge AS (
  SELECT repo, src, dst, max_by(kind, turn) AS kind FROM (
    SELECT repo, api AS src, coalesce(client, target) AS dst, 'calls' AS kind, 0 AS turn FROM s1 UNION ALL SELECT repo, client, target, 'calls', 0 FROM s1 WHERE client IS NOT NULL
    UNION ALL SELECT repo, api, field, 'has-field', 1 FROM f1 UNION ALL SELECT repo, field, usr, 'reads', 2 FROM f1 UNION ALL SELECT repo, id, 'file:' || file, 'defined-in', 3 FROM home) WHERE src <> dst GROUP BY ALL),
gn AS (
  SELECT a.repo, 'api:' || a.api_key AS id, 'endpoint' AS kind, a.api_key AS label, e.handler AS detail, a.status, e.file, e.line FROM (SELECT repo, api_key, min_by(status, id) AS status FROM linked GROUP BY ALL) a LEFT JOIN endpoints e ON e.repo = a.repo AND e.id = a.api_key
  UNION ALL SELECT DISTINCT repo, field, 'field', path, api_key, NULL, NULL, NULL FROM f1
  UNION ALL SELECT repo, id, CASE WHEN containing_component = name THEN 'component' ELSE 'function' END, CASE WHEN name = '<anonymous>' AND containing_component IS NOT NULL THEN containing_component || ' (callback)' ELSE name END, file || ':' || line, NULL, file, line FROM home
  UNION ALL SELECT repo, 'file:' || p, 'file', p, NULL, NULL, p, NULL FROM (SELECT repo, file AS p FROM home UNION SELECT repo, file FROM s1 WHERE NOT has_caller UNION SELECT repo, file FROM f1 WHERE NOT has_reader)
  UNION ALL SELECT e.repo, 'api:' || id, 'endpoint', id, handler, 'unused', file, line FROM endpoints e ANTI JOIN (SELECT repo, api_key AS id FROM linked) l USING (repo, id))"""
_REACH = """
pr AS (SELECT repo, src AS a, dst AS b FROM ge UNION SELECT pr.repo, pr.a, ge.dst FROM pr JOIN ge ON ge.repo = pr.repo AND ge.src = pr.b),
im AS (SELECT p.repo, p.a AS id FROM pr p JOIN gn x ON x.repo = p.repo AND x.id = p.a JOIN gn y ON y.repo = p.repo AND y.id = p.b WHERE x.kind IN ('endpoint', 'field') AND y.kind = 'file'
  UNION ALL SELECT p.repo, p.b FROM pr p JOIN gn x ON x.repo = p.repo AND x.id = p.a JOIN gn y ON y.repo = p.repo AND y.id = p.b WHERE x.kind = 'endpoint' AND y.kind NOT IN ('endpoint', 'field'))"""

QUERIES = {
    f.__name__: f
    for f in (
        link_calls, configured_clients, call_sites, field_reads, rank_apis, api_usage_no_backend, field_counts, unused_endpoints, file_apis, rank_files, client_functions, blast_radius,
        index_summary, match_api_keys, search, dependents, graph_nodes, graph_edges, graph_reach, merged_graphs, api_impact, file_impact,
    )
}
ORACLES = {
    "link_calls": linked("SELECT repo, id, status, endpoint_id, candidates, api_key FROM linked"),
    "configured_clients": f"""WITH {lens_sql('endpoints', 'api_calls')}, cl AS (SELECT repo, 'client.' || lower(method) AS callee, min_by(method, pos) AS m, min_by(path, pos) AS p FROM endpoints WHERE pos % 50 = 0 GROUP BY ALL)
      SELECT c.repo, CASE WHEN p IS NOT NULL THEN 'config' ELSE resolution END AS resolution, coalesce(m, method) AS method, coalesce({norm('p')}, endpoint_pattern) AS endpoint_pattern, count(*) AS calls,
      count(CASE WHEN p IS NULL THEN query_keys END) AS with_keys FROM api_calls c LEFT JOIN cl USING (repo, callee) GROUP BY ALL""",
    "call_sites": linked("SELECT repo, id, api_key, file, function_name, component, via FROM sites"),
    "field_reads": linked(_ONLY),
    "rank_apis": linked("SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, call_sites DESC, api_key) AS rank FROM u", extra=_USAGE),
    "api_usage_no_backend": linked(
        "SELECT repo, api_key, 'no-backend' AS status, NULL AS handler, call_sites, field_reads, files, components FROM nb",
        extra="""b AS (SELECT * REPLACE (coalesce(method, '?') || ' ' || coalesce(endpoint_pattern, '<' || callee || '>') AS api_key) FROM sites),
        br AS (SELECT a.*, b.api_key FROM property_accesses a JOIN b ON a.repo = b.repo AND a.api_call_id = b.id),
        nb AS (SELECT * FROM (SELECT repo, api_key, count(*) AS call_sites FROM b GROUP BY ALL) JOIN (SELECT repo, api_key, count(DISTINCT file) AS files, count(DISTINCT component) AS components FROM
          (SELECT repo, api_key, file, component FROM b UNION ALL SELECT repo, api_key, file, containing_component FROM br) GROUP BY ALL) USING (repo, api_key)
          LEFT JOIN (SELECT repo, api_key, count(*) AS fr FROM br GROUP BY ALL) USING (repo, api_key) SELECT_FIX)""".replace("SELECT * FROM (SELECT repo, api_key, count(*) AS call_sites", "SELECT repo, api_key, call_sites, coalesce(fr, 0) AS field_reads, files, components FROM (SELECT repo, api_key, count(*) AS call_sites").replace(" SELECT_FIX", ""),
    ),
    "field_counts": linked(f"SELECT repo, api_key, {shown('path')} AS path, count(*) AS reads FROM reads GROUP BY ALL"),
    "unused_endpoints": linked("SELECT repo, id, handler FROM endpoints e ANTI JOIN (SELECT repo, api_key AS id FROM linked) l USING (repo, id)"),
    "file_apis": linked("SELECT * FROM fa", extra=_FILE_APIS),
    "rank_files": linked("SELECT repo, file, count(*) AS apis, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, file) AS rank FROM fa GROUP BY repo, file", extra=_FILE_APIS),
    "client_functions": linked("SELECT l.repo, f.file, f.name, count(*) AS call_sites, count(DISTINCT api_key) AS apis FROM linked l JOIN functions f ON f.repo = l.repo AND f.id = l.wrapper_function_id WHERE f.file <> CASE WHEN l.col = 3 THEN l.file || 'x' ELSE l.file END GROUP BY ALL"),
    "blast_radius": linked("SELECT * FROM br", extra=_RADIUS),
    "index_summary": f"""WITH {lens_sql('endpoints', 'functions', 'files', 'api_calls', 'property_accesses')} SELECT * FROM (SELECT repo, count(*) AS files FROM files GROUP BY ALL) JOIN (SELECT repo, count(*) AS functions FROM functions GROUP BY ALL) USING (repo)
      JOIN (SELECT repo, count(*) AS calls, count(endpoint_pattern) AS resolved_calls FROM api_calls GROUP BY ALL) USING (repo) JOIN (SELECT repo, count(*) AS reads FROM property_accesses GROUP BY ALL) USING (repo)""",
    "match_api_keys": linked(f"{_TIER(_T1)} UNION ALL {_TIER(_T2)}", extra=_MATCH),
    "search": linked(f"SELECT * FROM ({_search('s1')}) WHERE kind = 'file' UNION ALL {_search('card1')}", "files", extra=f"{_USAGE}, {_FILE_APIS}, {_RADIUS}"),
    "dependents": f"WITH RECURSIVE {lens_sql('imports')}, c AS (SELECT repo, resolved_file AS file, file AS dependent FROM imports WHERE resolved_file IS NOT NULL AND resolved_file <> file UNION SELECT c.repo, c.file, i.file FROM c JOIN imports i ON i.repo = c.repo AND i.resolved_file = c.dependent) SELECT * FROM c WHERE file <> dependent",
    # the two halves' union is the graph of all calls
    "merged_graphs": linked("SELECT repo, id, kind, label, NULL AS dst FROM gn WHERE status IS DISTINCT FROM 'unused' UNION ALL SELECT repo, src, kind, NULL, dst FROM ge", extra=_GRAPH),
    "api_impact": linked(
        f"""SELECT k.repo, k.api_key, 3 AS tier, u.status, u.handler, u.call_sites, u.field_reads, u.files, u.components, fc.fields FROM (SELECT repo, id AS api_key FROM endpoints WHERE contains(lower(handler), 'c11#h')) k JOIN u USING (repo, api_key)
        LEFT JOIN (SELECT repo, api_key, list(p || '=' || n ORDER BY p) AS fields FROM (SELECT repo, api_key, {shown('path')} AS p, count(*) AS n FROM reads GROUP BY ALL) GROUP BY ALL) fc USING (repo, api_key)""",
        extra=_USAGE,
    ),
    "file_impact": linked(
        """SELECT br.repo, br.file, coalesce(o.n, 0) AS own_apis, coalesce(c.n, 0) AS clients, coalesce(d.n, 0) AS dependents, br.apis, br.files, br.components FROM br
        LEFT JOIN (SELECT repo, file, count(*) AS n FROM fa GROUP BY ALL) o USING (repo, file)
        LEFT JOIN (SELECT repo, file, count(*) AS n FROM (SELECT DISTINCT l.repo, f.file, f.name FROM linked l JOIN functions f ON f.repo = l.repo AND f.id = l.wrapper_function_id WHERE f.file <> l.file) GROUP BY ALL) c USING (repo, file)
        LEFT JOIN (SELECT repo, file, count(*) AS n FROM dep WHERE file <> dependent GROUP BY ALL) d USING (repo, file)""",
        "imports",
        extra=f"{_FILE_APIS}, {_RADIUS}, dep AS (SELECT repo, resolved_file AS file, file AS dependent FROM imports WHERE resolved_file IS NOT NULL AND resolved_file <> file UNION SELECT dep.repo, dep.file, i.file FROM dep JOIN imports i ON i.repo = dep.repo AND i.resolved_file = dep.dependent)",
    ),
    "graph_nodes": linked("SELECT * FROM gn", extra=_GRAPH),
    "graph_edges": linked("SELECT * FROM ge", extra=_GRAPH),
    "graph_reach": linked("SELECT gn.repo, gn.id, gn.kind, coalesce(n, 0) AS impact FROM gn LEFT JOIN (SELECT repo, id, count(*) AS n FROM im GROUP BY ALL) USING (repo, id)", extra=f"{_GRAPH}, {_REACH}"),
}
