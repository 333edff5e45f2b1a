"""

Most queries run on a Java tree rendered from the star-schema tables (one file
per region, nation, supplier and customer), those named `port_*` on a second
one rendered from `part` (interfaces, implementors, long methods, overloads),
those named `yard_*` on a third one rendered from `orders`, `lineitem` and
`supplier` (every way to name a class, every kind of declaration).
Their structure follows from the keys, so the SQL derives what the analysis
must find from the keys alone.  The others run operators on the text tables.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rendered.star import port_corpus, sql_text, star_corpus  # noqa: E402
from rendered.yard import yard_corpus  # noqa: E402
from sourceloom.documents import prompts, texts  # noqa: E402
from sourceloom.functions import layers, naming, text  # noqa: E402
from sourceloom.operators import changes, components, dependencies, flows, mermaid, resolve, symbols, tables  # noqa: E402
from sourceloom.operators.cards import render_card  # noqa: E402
from sourceloom.operators.fingerprints import regeneration  # noqa: E402
from sourceloom.operators.renames import digests, renames  # noqa: E402
from sourceloom.operators.select import fit_to_budget, select_with_coverage  # noqa: E402
from sourceloom.operators.skew import first_per_group, hot_keys  # noqa: E402
from sourceloom.plans.analysis import Analysis  # noqa: E402
from sourceloom.plans.context import ProjectContext  # noqa: E402
from sourceloom.plans.incremental import Graph  # noqa: E402
from sourceloom.plans.runs import package_report  # noqa: E402
from sourceloom.plans.trees import SnapshotTree, changed_files, changed_folders  # noqa: E402
from sourceloom.session import shared_folder, written  # noqa: E402
from sourceloom.sources.parse import file_hash, parse_files  # noqa: E402
from sourceloom.sources.worktree import has_extension, is_excluded  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_analyses: dict[tuple[str, str, str], Analysis] = {}
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def analysis(spark: SparkSession, sf_dir: str, corpus=star_corpus) -> Analysis:
    """An analysed tree of a folder, parsed once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus.__name__)
    if key not in _analyses:
        _analyses[key] = Analysis(parse_files(corpus(spark, sf_dir)))
    return _analyses[key]


_contexts: dict[tuple[str, str], ProjectContext] = {}


def context(spark: SparkSession, sf_dir: str) -> ProjectContext:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = ProjectContext(analysis(spark, sf_dir), "acme", ["java"], 12_288)
    return _contexts[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if oracle is not None:
            _ORACLES[function.__name__] = oracle
        return function

    return register


def strings(column) -> F.Column:
    return F.array_join(column, ",")


# What the keys say about the tree, for the SQL side.
_TREE = """
WITH cls AS (
  SELECT 'com.acme.region.RegionStore' || r_regionkey AS fqn, 'RegionStore' || r_regionkey AS name, 'com.acme.region' AS package,
         'src/main/java/com/acme/region/RegionStore' || r_regionkey || '.java' AS path, 'data' AS layer, 'Data' AS label, 0 AS is_route,
         1 AS n_methods FROM region
  UNION ALL SELECT 'com.acme.nation.NationService' || n_nationkey, 'NationService' || n_nationkey, 'com.acme.nation',
         'src/main/java/com/acme/nation/NationService' || n_nationkey || '.java', 'service', 'Service', 0, 1 FROM nation
  UNION ALL SELECT 'com.acme.supplier.SupplierApi' || s_suppkey, 'SupplierApi' || s_suppkey, 'com.acme.supplier',
         'src/main/java/com/acme/supplier/SupplierApi' || s_suppkey || '.java', 'api', 'API', 1, 1 FROM supplier
  UNION ALL SELECT 'com.acme.customer.Customer' || c_custkey, 'Customer' || c_custkey, 'com.acme.customer',
         'src/main/java/com/acme/customer/Customer' || c_custkey || '.java', 'domain', 'Domain', 0,
         CASE WHEN c_custkey % 6 IN (1, 2, 3) THEN 1 ELSE 0 END FROM customer
), edge AS (
  SELECT 'com.acme.nation.NationService' || n_nationkey AS src, 'com.acme.region.RegionStore' || n_regionkey AS dst, 'field' AS kinds FROM nation
  UNION ALL SELECT 'com.acme.supplier.SupplierApi' || s_suppkey, 'com.acme.nation.NationService' || s_nationkey, 'field' FROM supplier
  UNION ALL SELECT 'com.acme.customer.Customer' || c_custkey, 'com.acme.nation.NationService' || c_nationkey,
         CASE c_custkey % 6 WHEN 0 THEN 'field' WHEN 1 THEN 'param' WHEN 2 THEN 'return' WHEN 3 THEN 'creates'
                            WHEN 4 THEN 'extends' ELSE 'implements' END FROM customer
), call AS (
  SELECT 'com.acme.nation.NationService' || n_nationkey AS caller_class, 'resolve' AS caller_method,
         'com.acme.region.RegionStore' || n_regionkey AS callee_class, 'load' AS callee_method FROM nation
  UNION ALL SELECT 'com.acme.supplier.SupplierApi' || s_suppkey, 'get', 'com.acme.nation.NationService' || s_nationkey, 'resolve' FROM supplier
), imp AS (
  SELECT path, 0 AS import_ord, 'javax.persistence.EntityManager' AS import_path FROM cls WHERE layer = 'data'
  UNION ALL SELECT c.path, 0, e.dst FROM cls c JOIN edge e ON e.src = c.fqn
  UNION ALL SELECT 'src/main/java/com/acme/customer/Customer' || c_custkey || '.java', 1,
         CASE c_custkey % 3 WHEN 0 THEN 'java.util.List' WHEN 1 THEN 'okhttp3.OkHttpClient'
                            ELSE 'org.apache.kafka.clients.producer.KafkaProducer' END FROM customer
), fan AS (
  SELECT c.fqn, (SELECT count(*) FROM edge e WHERE e.dst = c.fqn) AS fan_in, (SELECT count(*) FROM edge e WHERE e.src = c.fqn) AS fan_out,
         c.is_route, c.layer, c.label FROM cls c
), ranked AS (
  SELECT fqn, layer, label, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out,
         CAST(3 * fan_in + fan_out + 15 * is_route AS BIGINT) AS importance FROM fan
), entry AS (
  SELECT s_suppkey, s_nationkey, n_regionkey, row_number() OVER (ORDER BY 'SupplierApi' || s_suppkey) AS flow_ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY flow_ord <= 8
), member AS (
  SELECT 'com.acme.region.RegionStore' || r_regionkey AS fqn, 'Keeps region ' || r_regionkey || '.' AS summary, NULL AS heritage,
         NULL AS field, 'public void load()' AS method FROM region
  UNION ALL SELECT 'com.acme.nation.NationService' || n_nationkey, NULL, NULL, 'RegionStore' || n_regionkey || ' store', 'void resolve()' FROM nation
  UNION ALL SELECT 'com.acme.supplier.SupplierApi' || s_suppkey, NULL, NULL, 'NationService' || s_nationkey || ' service', 'public void get()' FROM supplier
  UNION ALL SELECT 'com.acme.customer.Customer' || c_custkey, 'Customer number ' || c_custkey || '.',
         CASE c_custkey % 6 WHEN 4 THEN 'extends: NationService' || c_nationkey WHEN 5 THEN 'implements: NationService' || c_nationkey END,
         CASE c_custkey % 6 WHEN 0 THEN 'NationService' || c_nationkey || ' owner' WHEN 4 THEN 'String name' WHEN 5 THEN 'String name' END,
         CASE c_custkey % 6 WHEN 1 THEN 'void accept(NationService' || c_nationkey || ' owner)'
                            WHEN 2 THEN 'NationService' || c_nationkey || ' owner()' WHEN 3 THEN 'void make()' END FROM customer
)
"""

# Text of a class card, from `member` and `edge`; at most 40 neighbours are named.
_CARDS = (
    _TREE
    + """
, used AS (
  SELECT dst AS fqn, count(*) AS n, list_slice(list_sort(list(src)), 1, 40) AS users FROM edge GROUP BY dst
), uses AS (SELECT src AS fqn, min(dst) AS dst FROM edge GROUP BY src
), card AS (
  SELECT r.fqn, r.layer, r.label, r.importance, m.field, m.summary, concat_ws(chr(10),
      '### class ' || r.fqn, '- layer: ' || r.layer, '- modifiers: public', '- ' || m.heritage, '- summary: ' || m.summary,
      '- fields: ' || m.field, '- methods:' || chr(10) || '  - ' || m.method) AS brief, concat_ws(chr(10), brief, '- depends on: ' || d.dst,
      '- used by: ' || array_to_string(u.users, ', ') || CASE WHEN u.n > 40 THEN ', ... (' || (u.n - 40) || ' more not shown)' ELSE '' END
    ) AS card
  FROM ranked r JOIN member m USING (fqn) LEFT JOIN used u USING (fqn) LEFT JOIN uses d USING (fqn)
)
"""
)


# -- sources and parsing --------------------------------------------------------------------


@query(
    f"""SELECT path, sha256(text) AS content_hash, package, n_imports, 1 AS n_classes, 0 AS n_errors FROM ({sql_text()})"""
)
def parsed_files(spark, sf_dir):
    p = analysis(spark, sf_dir).parsed
    return p.select(
        "path", "content_hash", "package", F.size("imports.path").alias("n_imports"), F.size("classes.name").alias("n_classes"),
        F.size("parse_errors").alias("n_errors"),
    )


@query(_TREE + "SELECT path, import_ord, import_path, FALSE AS is_static, FALSE AS is_wildcard FROM imp")
def file_imports(spark, sf_dir):
    return analysis(spark, sf_dir).imports


@query(_TREE + "SELECT fqn, method AS signature FROM member WHERE method IS NOT NULL")
def method_signatures(spark, sf_dir):
    return analysis(spark, sf_dir).methods.select("fqn", "signature")


@query(
    _TREE
    + """SELECT fqn, regexp_extract(field, '^(\\S+) ', 1) AS type, regexp_extract(field, ' (\\S+)$', 1) AS name, 'private' AS modifiers
FROM member WHERE field IS NOT NULL"""
)
def class_fields(spark, sf_dir):
    rows = tables.fields(analysis(spark, sf_dir).classes)
    return rows.select("fqn", "type", "name", strings("modifiers").alias("modifiers"))


@query(
    """SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^(?s:.*/en/.*|.*\\.org/.*)$')
AND NOT regexp_matches(url, '^(?s:.*ref=.)$')"""
)
def exclude_filter(spark, sf_dir):
    """Pages of which no glob matches the url."""
    patterns = ["**/en/**", "*.org/*", "*ref=?"]
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(~is_excluded(F.col("url"), patterns))


@query(
    """WITH named AS (SELECT p_partkey, 'lib/' || replace(p_name, ' ', '/') || '.' || lower(p_type) AS path FROM part)
SELECT p_partkey, path FROM named WHERE path LIKE '%.economy' OR path LIKE '%.small'"""
)
def extension_filter(spark, sf_dir):
    path = F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("."), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.filter(has_extension(F.col("path"), {".economy", ".small"}))


@query("SELECT sha256(text) AS content_hash, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    """Contents stored more than once."""
    rows = table(spark, sf_dir, "documents").select(file_hash(F.col("text").cast("binary")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n_copies")).filter("n_copies > 1")


# -- scalar functions -------------------------------------------------------------------------


@query(
    """WITH named AS (SELECT p_partkey, 'com.acme.' || p_type || '.HTTP' || list_aggregate(list_transform(
  string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') || 'DAO_v' || p_size AS fqn FROM part)
SELECT p_partkey, fqn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(
  regexp_replace(fqn, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z0-9]+'), lambda w: lower(w)))), ',') AS words FROM named"""
)
def word_tokens(spark, sf_dir):
    camel = F.array_join(
        F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )
    fqn = F.concat(F.lit("com.acme."), "p_type", F.lit(".HTTP"), camel, F.lit("DAO_v"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", fqn.alias("fqn"))
    return rows.withColumn("words", strings(F.array_sort(naming.name_words(F.col("fqn")))))


@query(
    """WITH typed AS (SELECT 'Map<String, ' || replace(p_name, ' ', '.') || '<' || p_type || '[]>>...' AS t FROM part)
SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(replace(t, '...', ''), '[]', ''),
  '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')) AS name FROM typed) WHERE name <> 'String' GROUP BY name"""
)
def type_names(spark, sf_dir):
    """Names inside generic type texts, and how often each is met."""
    t = F.concat(F.lit("Map<String, "), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("<"), "p_type", F.lit("[]>>..."))
    rows = table(spark, sf_dir, "part").select(F.explode(naming.type_names(t)).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || role || chr(10) || text || '</think>' || text || ' <think>x</think>',
  '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS answer FROM conversations"""
)
def strip_think(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>"), "role", F.lit("\n"), "text", F.lit("</think>"), "text", F.lit(" <think>x</think>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_thinking(wrapped).alias("answer"))


@query(
    """SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
  lambda x: x <> '' AND NOT starts_with(x, '@'))[1] AS summary FROM documents"""
)
def first_line(spark, sf_dir):
    """First telling line of every document, put into a doc comment."""
    doc = F.concat(F.lit("/**\n * "), F.replace("text", F.lit("\n"), F.lit("\n * ")), F.lit("\n */"))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(doc).alias("summary"))


@query(
    "SELECT p_partkey, CAST(greatest(floor(p_partkey * 0.5), 500) * 3 AS BIGINT) AS detail_chars FROM part"
)
def detail_chars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.detail_chars(F.col("p_partkey")).cast("bigint").alias("detail_chars"))


@query(
    """WITH numbered AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n
  FROM documents)
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY rn) || CASE WHEN max(n) > 15 THEN ', and ' || (max(n) - 15) || ' more' ELSE '' END AS listing
FROM numbered WHERE rn <= 15 GROUP BY source"""
)
def truncated_lists(spark, sf_dir):
    """Documents of every source: the first 15, and how many more there are."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    totals = docs.groupBy("source").agg(F.count("*").alias("n"))
    first = first_per_group(docs, ["source"], [F.asc("doc_id")], 15)
    lists = first.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    ids = F.transform("ids", lambda i: i.cast("string"))
    return lists.join(totals, "source").select("source", text.truncated_list(ids, 15, F.col("n")).alias("listing"))


@query("SELECT 'com.acme.supplier.SupplierApi' || s_suppkey AS fqn, 'get' AS method, 'GET /suppliers/' || s_suppkey AS label FROM supplier")
def route_labels(spark, sf_dir):
    rows = analysis(spark, sf_dir).classes.select("fqn", "annotations", "annotation_args", F.explode("methods").alias("m"))
    base = F.try_element_at("annotation_args", layers.route_annotation(F.col("annotations")))
    route = layers.route_annotation(F.col("m.annotations"))
    label = layers.route_label(base, route, F.try_element_at("m.annotation_args", route))
    return rows.select("fqn", F.col("m.name").alias("method"), label.alias("label")).filter("label is not null")


# -- symbols, resolution, dependencies --------------------------------------------------------


@query(_TREE + "SELECT fqn, path, package, 'class' AS kind, CAST(1 AS BIGINT) AS n_declared FROM cls")
def symbol_index(spark, sf_dir):
    return analysis(spark, sf_dir).symbols.select("fqn", "path", "package", "kind", "n_declared")


@query(_TREE + "SELECT name, fqn FROM cls")
def unique_names(spark, sf_dir):
    return symbols.unique_names(analysis(spark, sf_dir).symbols).select("name", "fqn")


@query(_TREE + "SELECT package, count(*) AS class_count FROM cls GROUP BY package")
def package_counts(spark, sf_dir):
    return analysis(spark, sf_dir).packages


@query(_TREE + "SELECT src, dst, kinds FROM edge")
def dependency_edges(spark, sf_dir):
    return analysis(spark, sf_dir).dependency_edges.select("src", "dst", strings("kinds").alias("kinds"))


@query(_TREE + "SELECT src, dst, kinds FROM edge")
def dependency_edges_split(spark, sf_dir):
    """The same edges with every name of ten uses or more treated as a hot key."""
    a = analysis(spark, sf_dir)
    found = resolve.candidates(written(dependencies.references(a.classes), "references"))
    edges = dependencies.dependency_edges(resolve.resolve(found, a.names, dependencies.REFERENCE, hot_keys(found, "key", 10)))
    return edges.select("src", "dst", strings(dependencies.kind_names(F.col("kind_mask"))).alias("kinds"))


@query(_TREE + "SELECT DISTINCT s.package AS src_package, d.package AS dst_package FROM edge JOIN cls s ON s.fqn = src JOIN cls d ON d.fqn = dst WHERE s.package <> d.package")
def package_graph(spark, sf_dir):
    return analysis(spark, sf_dir).package_edges


@query(_TREE + "SELECT fqn, fan_in, fan_out FROM ranked WHERE fan_in + fan_out > 0")
def fan_in_out(spark, sf_dir):
    return dependencies.fan(analysis(spark, sf_dir).edges)


@query(_TREE + "SELECT fqn, importance FROM ranked")
def importance(spark, sf_dir):
    return analysis(spark, sf_dir).ranked.select("fqn", "importance")


@query(_TREE + "SELECT src, dst, 'class' AS kind FROM edge WHERE kinds = 'implements'")
def implementors(spark, sf_dir):
    rows = analysis(spark, sf_dir).implementors
    return rows.select("src", F.col("target").alias("dst"), F.col("target_kind").alias("kind"))


# -- classification ------------------------------------------------------------------------------


@query(_TREE + "SELECT layer, fqn FROM cls")
def layer_members(spark, sf_dir):
    return components.layer_members(analysis(spark, sf_dir).symbols).select("layer", "fqn")


@query(
    _TREE
    + """, numbered AS (SELECT layer, fqn, row_number() OVER (PARTITION BY layer ORDER BY path) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM cls)
SELECT layer, max(n) AS n_classes, string_agg(fqn, ', ' ORDER BY rn) || CASE WHEN max(n) > 15 THEN ', and ' || (max(n) - 15) || ' more' ELSE '' END AS listing
FROM numbered WHERE rn <= 15 GROUP BY layer UNION ALL SELECT 'unclassified', 0, ''"""
)
def layer_breakdown(spark, sf_dir):
    return analysis(spark, sf_dir).layer_breakdown.select("layer", "n_classes", "listing")


@query(
    _TREE
    + """, roots AS (SELECT array_to_string(list_slice(string_split(import_path, '.'), 1, 2), '.') AS root, path, import_ord FROM imp)
SELECT root, count(*) AS n_imports FROM roots WHERE root NOT IN ('com.acme', 'com') GROUP BY root
ORDER BY n_imports DESC, min(path || import_ord) LIMIT 15"""
)
def external_roots_topn(spark, sf_dir):
    return analysis(spark, sf_dir).external_roots.select("root", "n_imports")


_SYSTEM = """, sys AS (SELECT path, import_ord, CASE WHEN starts_with(import_path, 'javax.persistence') THEN 'Relational Database'
  WHEN starts_with(import_path, 'okhttp3') THEN 'HTTP / REST Client' WHEN starts_with(import_path, 'org.apache.kafka') THEN 'Messaging / Streaming' END AS category,
  CASE WHEN starts_with(import_path, 'javax.persistence') THEN 'javax.persistence' WHEN starts_with(import_path, 'okhttp3') THEN 'okhttp3'
  WHEN starts_with(import_path, 'org.apache.kafka') THEN 'org.apache.kafka' END AS prefix FROM imp)
"""


@query(_TREE + _SYSTEM + "SELECT path, import_ord, category, prefix FROM sys WHERE category IS NOT NULL")
def import_categories(spark, sf_dir):
    rows = tables.import_categories(analysis(spark, sf_dir).parsed)
    return rows.select("path", "import_ord", "category", "prefix")


@query(_TREE + _SYSTEM + "SELECT category, string_agg(DISTINCT prefix, ',') AS prefixes FROM sys WHERE category IS NOT NULL GROUP BY category")
def external_systems(spark, sf_dir):
    return analysis(spark, sf_dir).external_systems.select("category", strings("prefixes").alias("prefixes"))


_COMPONENT = (
    _TREE
    + _SYSTEM
    + """, comp AS (
  SELECT DISTINCT s.label AS src, d.label AS dst FROM edge JOIN cls s ON s.fqn = src JOIN cls d ON d.fqn = dst WHERE s.label <> d.label
  UNION SELECT c.label, sys.category FROM cls c JOIN sys USING (path) WHERE category IS NOT NULL
  UNION SELECT 'Client', 'API' FROM supplier)
"""
)


@query(_COMPONENT + "SELECT src, dst FROM comp")
def component_graph(spark, sf_dir):
    return analysis(spark, sf_dir).component_edges


_GRAPH_LINES = """, met AS (SELECT src AS node, src AS s, '' AS d FROM {0} UNION ALL SELECT dst, src, dst FROM {0}),
  placed AS (SELECT node, min(struct_pack(s := s, d := d)) AS spot FROM met GROUP BY node),
  lines AS (SELECT spot.s AS src, spot.d AS dst, 0 AS part, '    ' || regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') || '["' || node || '"]' AS line FROM placed
  UNION ALL SELECT src, dst, 1, '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') FROM {0})
"""


@query(
    _COMPONENT + _GRAPH_LINES.format("comp")
    + "SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY src, dst, part) AS mermaid FROM lines"
)
def component_mermaid(spark, sf_dir):
    return analysis(spark, sf_dir).component_mermaid


@query(_TREE + _GRAPH_LINES.format("edge") + "SELECT src, dst, part, line FROM lines")
def class_graph_lines(spark, sf_dir):
    """The class graph as diagram lines; never brought together in one row."""
    return mermaid.graph_lines(analysis(spark, sf_dir).edges.select("src", "dst"))


# -- calls and flows --------------------------------------------------------------------------------


@query(_TREE + "SELECT caller_class, caller_method, callee_class, callee_method FROM call")
def call_edges(spark, sf_dir):
    return analysis(spark, sf_dir).calls.select("caller_class", "caller_method", "callee_class", "callee_method")


@query(_TREE + "SELECT caller_class, caller_method, CAST(1 AS BIGINT) AS n_calls, min(callee_class || '.' || callee_method) AS first_call FROM call GROUP BY ALL")
def calls_by_caller(spark, sf_dir):
    from sourceloom.operators.calls import calls_by_caller as grouped

    rows = grouped(analysis(spark, sf_dir).calls)
    first = F.min_by(F.concat("callee_class", F.lit("."), "callee_method"), "call_rank")
    return rows.groupBy("caller_class", "caller_method").agg(F.count("*").alias("n_calls"), first.alias("first_call"))


@query(_TREE + "SELECT flow_ord, 'com.acme.supplier.SupplierApi' || s_suppkey AS entry_class, 'get' AS entry_method FROM entry")
def entry_points_topk(spark, sf_dir):
    a = analysis(spark, sf_dir)
    rows = flows.entry_points(a.methods, a.meaningful_calls)
    return rows.select(F.col("flow_ord").cast("bigint").alias("flow_ord"), "entry_class", "entry_method")


@query(
    _TREE
    + """SELECT flow_ord, 1 AS step_ord, 'com.acme.supplier.SupplierApi' || s_suppkey AS caller_class, 'get' AS caller_method,
  'com.acme.nation.NationService' || s_nationkey AS callee_class, 'resolve' AS callee_method, NULL AS return_type FROM entry
UNION ALL SELECT flow_ord, 2, 'com.acme.nation.NationService' || s_nationkey, 'resolve', 'com.acme.region.RegionStore' || n_regionkey, 'load', NULL FROM entry
UNION ALL SELECT flow_ord, 3, 'com.acme.region.RegionStore' || n_regionkey, 'load', 'Relational Database', 'load', 'result' FROM entry"""
)
def trace_flow(spark, sf_dir):
    rows = analysis(spark, sf_dir).flows.select(F.col("flow_ord").cast("bigint").alias("flow_ord"), F.posexplode("steps").alias("i", "s"))
    return rows.select("flow_ord", (F.col("i") + 1).alias("step_ord"), "s.*")


_DIAGRAM = """'sequenceDiagram
    participant Client as Client
    participant com_acme_supplier_SupplierApi' || s_suppkey || ' as SupplierApi' || s_suppkey || '
    participant com_acme_nation_NationService' || s_nationkey || ' as NationService' || s_nationkey || '
    participant com_acme_region_RegionStore' || n_regionkey || ' as RegionStore' || n_regionkey || '
    participant Relational_Database as Relational Database
    Client->>com_acme_supplier_SupplierApi' || s_suppkey || ': GET /suppliers/' || s_suppkey || '
    com_acme_supplier_SupplierApi' || s_suppkey || '->>com_acme_nation_NationService' || s_nationkey || ': resolve()
    com_acme_nation_NationService' || s_nationkey || '->>com_acme_region_RegionStore' || n_regionkey || ': load()
    com_acme_region_RegionStore' || n_regionkey || '->>Relational_Database: load()
    Relational_Database-->>com_acme_region_RegionStore' || n_regionkey || ': result'"""


@query(_TREE + f"SELECT flow_ord, 'GET /suppliers/' || s_suppkey AS entry_label, {_DIAGRAM} AS mermaid FROM entry")
def flow_diagrams(spark, sf_dir):
    rows = analysis(spark, sf_dir).flows
    return rows.select(F.col("flow_ord").cast("bigint").alias("flow_ord"), "entry_label", "mermaid")


# -- cards, selection, prompts --------------------------------------------------------------------------


@query(_CARDS + "SELECT fqn, card FROM card")
def class_cards(spark, sf_dir):
    return analysis(spark, sf_dir).cards.select("fqn", render_card().alias("card"))


def _coverage_sql(source: str, labels: list[str], budget: int | str, max_count: int | None, picked: str = "picked") -> str:
    """SQL of a shared-budget selection over `source`(label, cost, rn, used): one CTE per group, slack carried on."""
    count = max_count if max_count is not None else 1 << 40
    share = f"share_{picked}"
    sql = f""", {share} AS (SELECT greatest({budget} // count(DISTINCT label), 1) AS chars, greatest({count} // count(DISTINCT label), 1) AS cnt FROM {source}),
  k0 AS (SELECT 0 AS chars, 0 AS cnt)"""
    for i, label in enumerate(labels, 1):
        sql += f""", g{i} AS (SELECT s.chars + k.chars AS chars, s.cnt + k.cnt AS cnt FROM {share} s, k{i - 1} k),
  s{i} AS (SELECT r.* FROM {source} r, g{i} WHERE label = '{label}' AND (rn = 1 OR used <= g{i}.chars) AND rn <= g{i}.cnt),
  k{i} AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM {source} WHERE label = '{label}') THEN greatest(g{i}.chars - (SELECT max(used) FROM s{i}), 0) ELSE k{i - 1}.chars END AS chars,
    CASE WHEN EXISTS (SELECT 1 FROM {source} WHERE label = '{label}') THEN greatest(g{i}.cnt - (SELECT count(*) FROM s{i}), 0) ELSE k{i - 1}.cnt END AS cnt FROM g{i}, k{i - 1})"""
    sql += f", {picked} AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, len(labels) + 1)) + ")\n"
    return re.sub(r"\b([gsk])(\d)\b", rf"\1\2_{picked}", sql)


_SELECTED = (
    _CARDS
    + """, costed AS (SELECT fqn, label, card, brief, field, summary, importance, length(card) + 2 AS cost FROM card),
  run AS (SELECT *, row_number() OVER w AS rn, sum(cost) OVER (PARTITION BY label ORDER BY importance DESC, fqn ROWS UNBOUNDED PRECEDING) AS used
    FROM costed WINDOW w AS (PARTITION BY label ORDER BY importance DESC, fqn))"""
    + _coverage_sql("run", ["API", "Service", "Domain", "Data"], 12_288, 150)
)


@query(_SELECTED + "SELECT label AS layer, fqn, rn AS rank, importance FROM picked")
def selected_cards(spark, sf_dir):
    """The cards documents are written from."""
    rows = context(spark, sf_dir).selected
    return rows.select(F.col("group").alias("layer"), "fqn", F.col("rank").cast("bigint").alias("rank"), "importance")


@query(_SELECTED + """SELECT (SELECT count(*) FROM cls) AS n_classes, (SELECT count(*) FROM cls) AS n_files, count(*) AS n_selected,
  count(*) < (SELECT count(*) FROM cls) AS truncated FROM picked""")
def context_counts(spark, sf_dir):
    return context(spark, sf_dir).counts.select("n_classes", "n_files", "n_selected", "truncated")


_DOC_RUN = """WITH run AS (SELECT doc_id, lang AS label, length(text) + 2 AS cost,
  row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn,
  sum(length(text) + 2) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
"""


@query(
    _DOC_RUN + _coverage_sql("run", ["en", "de", "fr", "es"], 60_000, 150).lstrip()
    + "SELECT label AS lang, doc_id, rn AS rank, CAST(used AS BIGINT) AS used FROM picked"
)
def coverage_selection(spark, sf_dir):
    """Short documents first, all languages present, under one budget of characters and of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.length("text") + 2).cast("bigint").alias("cost"))
    order = [F.asc("n_chars"), F.asc("doc_id")]
    kept = select_with_coverage(docs, "lang", ["en", "de", "fr", "es"], order, "cost", 60_000, 150)
    return kept.select("lang", "doc_id", F.col("rank").cast("bigint").alias("rank"), "used")


@query(
    """WITH run AS (SELECT doc_id, source, row_number() OVER w AS rn, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, rn AS rank, CAST(used AS BIGINT) AS used FROM run WHERE rn = 1 OR used <= 40000"""
)
def budget_prefix(spark, sf_dir):
    """Per source the longest run of documents that fits a budget; the first always."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") + 2).cast("bigint").alias("cost"))
    kept = fit_to_budget(docs, ["source"], [F.asc("doc_id")], "cost", 40_000)
    return kept.select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"), "used")


@query(
    """WITH c AS (SELECT doc_id, source, doc_id % 3 AS cost FROM documents),
run AS (SELECT doc_id, source, row_number() OVER w AS rn, sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used
  FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, rn AS rank, CAST(used AS BIGINT) AS used FROM run WHERE rn = 1 OR used <= 20"""
)
def budget_of_small_costs(spark, sf_dir):
    """The same with costs from 0 on (an empty text): rows that cost nothing fit without limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length(F.expr("repeat('x', cast(doc_id % 3 as int))")).cast("bigint").alias("cost"))
    kept = fit_to_budget(docs, ["source"], [F.asc("doc_id")], "cost", 20)
    return kept.select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"), "used")


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_README = (
    _SELECTED
    + """, top AS (SELECT fqn, brief, row_number() OVER (ORDER BY importance DESC, fqn) AS place FROM picked QUALIFY place <= 25),
  cut AS (SELECT *, sum(length(brief) + 2) OVER (ORDER BY place) AS used FROM top QUALIFY place = 1 OR used <= 6144),
  types AS (SELECT string_agg(brief, chr(10) || chr(10) ORDER BY place) || CASE WHEN count(*) < (SELECT count(*) FROM top)
      THEN chr(10) || chr(10) || '... and ' || ((SELECT count(*) FROM top) - count(*)) || ' more not shown in detail' ELSE '' END AS t FROM cut),
  packs AS (SELECT string_agg('- `' || package || '` (' || n || ' types)', chr(10) ORDER BY package) AS t FROM (SELECT package, count(*) AS n FROM cls GROUP BY package)),
  root AS (SELECT array_to_string(list_slice(string_split(import_path, '.'), 1, 2), '.') AS root, count(*) AS n, min(path || import_ord) AS at_first FROM imp
    WHERE NOT starts_with(import_path, 'com.acme') GROUP BY 1),
  roots AS (SELECT string_agg(root, ', ' ORDER BY n DESC, at_first) AS t FROM root)
SELECT 'README.md' AS doc, 'Write README.md for the repository "acme".\n\nFacts:\n- Languages: java\n- Files: ' || (SELECT count(*) FROM cls)
  || '\n- Types: ' || (SELECT count(*) FROM cls) || '\n- Packages:\n' || (SELECT t FROM packs)
  || '\n- External dependencies, most imported first: ' || (SELECT t FROM roots)
  || CASE WHEN (SELECT count(*) FROM picked) < (SELECT count(*) FROM cls)
       THEN '\nNote: the code base is large; the types below are a part of it.\n' ELSE '\n' END
  || '\nPublic types:\n\n' || (SELECT t FROM types) || """
    + _lit("\n\n" + texts.README_TASK)
    + " AS prompt"
)


@query(_README)
def readme_prompt(spark, sf_dir):
    return prompts.readme_prompt(context(spark, sf_dir))


_FLOW_TEXT = f"""'Flow from a client call of com.acme.supplier.SupplierApi' || s_suppkey || '.get():
  1. Client calls com.acme.supplier.SupplierApi' || s_suppkey || '.get()
  2. com.acme.supplier.SupplierApi' || s_suppkey || '.get() calls com.acme.nation.NationService' || s_nationkey || '.resolve()
  3. com.acme.nation.NationService' || s_nationkey || '.resolve() calls com.acme.region.RegionStore' || n_regionkey || '.load()
  4. com.acme.region.RegionStore' || n_regionkey || '.load() calls Relational Database.load()\n' || {_lit(texts.FLOW_NOTE)}
  || '\n```mermaid\n' || {_DIAGRAM} || '\n```'"""


@query(
    _TREE
    + f""", text AS (SELECT flow_ord, {_FLOW_TEXT} AS t FROM entry), cut AS (SELECT *, sum(length(t) + 2) OVER (ORDER BY flow_ord) AS used FROM text
  QUALIFY flow_ord = 1 OR used <= 12288)
SELECT 'SEQUENCE.md' AS doc, 'Write SEQUENCE.md, the main call flows of the repository "acme".\n\n' || {_lit(texts.SEQUENCE_HEAD)} || '\n\n'
  || string_agg(t, '\n\n' ORDER BY flow_ord) || CASE WHEN count(*) < (SELECT count(*) FROM text)
       THEN '\n\n... and ' || ((SELECT count(*) FROM text) - count(*)) || ' more flow(s) not shown due to prompt size limits' ELSE '' END
  || '\n\n' || {_lit(texts.SEQUENCE_TASK)} AS prompt FROM cut"""
)
def sequence_prompt(spark, sf_dir):
    return prompts.sequence_prompt(context(spark, sf_dir))


_ARCHITECTURE = (
    _SELECTED.replace(", costed AS", _SYSTEM + """, comp AS (
  SELECT DISTINCT s.label AS src, d.label AS dst FROM edge JOIN cls s ON s.fqn = src JOIN cls d ON d.fqn = dst WHERE s.label <> d.label
  UNION SELECT c.label, sys.category FROM cls c JOIN sys USING (path) WHERE category IS NOT NULL
  UNION SELECT 'Client', 'API' FROM supplier)""" + _GRAPH_LINES.format("comp") + ", costed AS", 1)
    + f""", nth AS (SELECT layer, fqn, row_number() OVER (PARTITION BY layer ORDER BY path) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM cls),
  listing AS (SELECT layer, string_agg(fqn, ', ' ORDER BY rn) || CASE WHEN max(n) > 15 THEN ', and ' || (max(n) - 15) || ' more' ELSE '' END AS t
    FROM nth WHERE rn <= 15 GROUP BY layer),
  layers AS (SELECT {_lit(texts.LAYERS)} || '\n' || string_agg(CASE layer WHEN 'api' THEN {_lit(texts.LAYER_LINES["api"])} WHEN 'service' THEN
    {_lit(texts.LAYER_LINES["service"])} WHEN 'domain' THEN {_lit(texts.LAYER_LINES["domain"])} ELSE {_lit(texts.LAYER_LINES["data"])} END || t, '\n'
    ORDER BY CASE layer WHEN 'api' THEN 0 WHEN 'service' THEN 1 WHEN 'domain' THEN 2 ELSE 3 END) AS t FROM listing),
  systems AS (SELECT {_lit(texts.SYSTEMS)} || '\n' || string_agg('- ' || category || ' (via ' || prefix || ')', '\n' ORDER BY category) AS t
    FROM (SELECT DISTINCT category, prefix FROM sys WHERE category IS NOT NULL)),
  nouns AS (SELECT *, row_number() OVER (ORDER BY importance DESC, fqn) AS place FROM picked WHERE label = 'Domain'),
  domain AS (SELECT {_lit(texts.DOMAIN)} || '\n' || string_agg('- **' || fqn || '** (class): ' || coalesce(field, 'no fields') || ' — ' || summary, '\n' ORDER BY place)
    || CASE WHEN (SELECT count(*) FROM nouns) > 12 THEN '\n- ...and ' || ((SELECT count(*) FROM nouns) - 12) || ' more domain types not shown in detail' ELSE '' END
    || '\n' || {_lit(texts.DOMAIN_NOTE)} AS t FROM nouns WHERE place <= 12),
  primary_flow AS (SELECT {_FLOW_TEXT} AS t FROM entry WHERE flow_ord = 1),
  graph AS (SELECT 'graph TD\n' || string_agg(line, '\n' ORDER BY src, dst, part) AS t FROM lines),
  facts AS (SELECT layers.t AS l, systems.t AS s, domain.t AS d, primary_flow.t AS p, graph.t AS g FROM layers, systems, domain, primary_flow, graph),
  room AS (SELECT greatest(12288 - length(l) - length(s) - length(d) - length(p) - length(g), 1500) AS n FROM facts),
  rest AS (SELECT label, card, row_number() OVER w AS rn, sum(cost) OVER w AS used
    FROM (SELECT * EXCLUDE (rn, used) FROM picked WHERE label <> 'Domain') WINDOW w AS (PARTITION BY label ORDER BY importance DESC, fqn ROWS UNBOUNDED PRECEDING))"""
    + _coverage_sql("rest", ["API", "Service", "Data"], "(SELECT n FROM room)", None, "shown")
    + f""", section AS (SELECT label, '#### ' || label || ' layer\n\n' || string_agg(card, '\n\n' ORDER BY rn) AS t FROM shown GROUP BY label),
  detail AS (SELECT string_agg(t, '\n\n' ORDER BY CASE label WHEN 'API' THEN 0 WHEN 'Service' THEN 1 ELSE 2 END) ||
    CASE WHEN (SELECT count(*) FROM rest) > (SELECT count(*) FROM shown) THEN '\n\n... and ' || ((SELECT count(*) FROM rest) - (SELECT count(*) FROM shown)) ||
      ' more classes not shown in detail due to prompt size limits' ELSE '' END AS t FROM section)
SELECT 'ARCHITECTURE.md' AS doc, 'Write ARCHITECTURE.md for the repository "acme".\n\n' || {_lit(texts.ARCHITECTURE_HEAD)} || '\n\n' || l || '\n\n' || s
  || '\n\nDomain model:\n' || d || '\n\nPrimary request flow, traced through the call graph:\n' || p
  || '\n\nVERIFIED FACT: component graph (nodes are layers and external systems; an edge means `uses`):\n```mermaid\n' || g
  || '\n```\n\nClasses by verified layer, as evidence for your text:\n\n' || detail.t || '\n\n---\n\n' || {_lit(texts.ARCHITECTURE_TASK)} AS prompt
FROM facts, detail"""
)


@query(_ARCHITECTURE)
def architecture_prompt(spark, sf_dir):
    return prompts.architecture_prompt(context(spark, sf_dir))


# -- snapshots, fingerprints -------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    """Two states of a document store: later, texts are stripped of outer space,
    toxic documents are gone, and the benchmark items have come in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.select(path.alias("path"), F.sha2("text", 256).alias("content_hash"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    stripped = F.sha2(F.regexp_replace("text", r"\n+", "\n"), 256)
    kept = docs.join(toxic, "doc_id", "left_anti").select(path.alias("path"), stripped.alias("content_hash"))
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash")
    )
    return old, kept.unionByName(items)


_SNAPSHOTS = """WITH old AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents),
new AS (SELECT source || '/' || doc_id AS path, sha256(regexp_replace(text, '\\n+', chr(10), 'g')) AS h FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION ALL SELECT 'benchmark/' || item_id, sha256(text) FROM benchmark),
diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed'
        WHEN old.h = new.h THEN 'unchanged' ELSE 'modified' END AS change, coalesce(new.h, old.h) AS h FROM old FULL JOIN new ON old.path = new.path)
"""


def _change_set(spark, sf_dir):
    """What version control lists, whatever the contents say: documents of good quality as modified, toxic ones as deleted."""
    marked = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 1")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(marked, "doc_id")
    status = F.when(F.col("toxic") == 1, "D").otherwise("M")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return rows.select(status.alias("status"), path.alias("path"), F.lit(None).cast("string").alias("old_path"))


_ACTIONS = (
    _SNAPSHOTS
    + """, listed AS (SELECT source || '/' || doc_id AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic IS DISTINCT FROM 1),
act AS (SELECT path, CASE change WHEN 'removed' THEN 'remove' WHEN 'unchanged' THEN 'reuse' ELSE 'parse' END AS action,
        change IN ('added', 'modified') OR change = 'unchanged' AND path IN (SELECT path FROM listed) AS in_change_set FROM diff)
"""
)


@query(_SNAPSHOTS + "SELECT path, change FROM diff")
def snapshot_diff(spark, sf_dir):
    return changes.compare_snapshots(*_snapshots(spark, sf_dir))


def _trees(spark, sf_dir):
    """The document store as a tree of folders, and after an edit: of toxic documents good ones are rewritten in capitals
    and the others taken away; benchmark items come in."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1")
    path = F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), (F.length("text") / 256).cast("long").cast("string"), F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", path.alias("path"))
    location = f"{shared_folder(spark).rstrip('/')}/sourceloom-tables/trees-{uuid.uuid4().hex}"
    old = SnapshotTree.build(docs.select("path", F.sha2("text", 256).alias("content_hash")), location)
    toxic = docs.join(labels, "doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")), F.sha2("text", 256))
    put = toxic.filter("quality = 1").select("path", F.sha2(F.upper("text"), 256).alias("content_hash")).union(items)
    return old, old.edited(toxic.filter("quality = 0").select("path"), put)


_TREES = """WITH named AS (SELECT doc_id, text, concat_ws('/', source, coalesce(lang, 'none'), length(text) // 256, doc_id) AS path FROM documents),
old AS (SELECT path, sha256(text) AS h FROM named WHERE text IS NOT NULL),
new AS (SELECT path, sha256(CASE WHEN l.doc_id IS NULL THEN text ELSE upper(text) END) AS h FROM named n
        LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND quality = 1) l ON l.doc_id = n.doc_id
        WHERE text IS NOT NULL AND n.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)
        UNION ALL SELECT 'benchmark/' || item_id, sha256(text) FROM benchmark),
diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
         old.path AS old_path, new.path AS new_path, old.h IS DISTINCT FROM new.h AS differs FROM old FULL JOIN new ON old.path = new.path)
"""


@query(_TREES + "SELECT path, change FROM diff WHERE differs")
def tree_changed_files(spark, sf_dir):
    return changed_files(*_trees(spark, sf_dir))


@query(
    _TREES
    + """, parts AS (SELECT *, string_split(path, '/') AS p FROM diff),
deep AS (SELECT *, unnest(range(0, least(len(p) - 1, 4) + 1)) AS level FROM parts)
SELECT level::INTEGER AS level, array_to_string(p[1:level], '/') AS folder,
CASE WHEN count(old_path) = 0 THEN 'added' WHEN count(new_path) = 0 THEN 'removed' ELSE 'modified' END AS change,
count(old_path) AS old_files, count(new_path) AS new_files FROM deep GROUP BY 1, 2 HAVING bool_or(differs)"""
)
def tree_changed_folders(spark, sf_dir):
    return changed_folders(*_trees(spark, sf_dir))


@query(
    """SELECT 'docs/' || doc_id AS path, 'changed' AS side FROM documents WHERE n_chars > 1000
UNION ALL SELECT 'old/' || doc_id, 'removed' FROM documents WHERE n_chars > 1000
UNION ALL SELECT 'docs/' || doc_id, 'changed' FROM documents WHERE n_chars BETWEEN 501 AND 1000
UNION ALL SELECT 'docs/' || doc_id, 'removed' FROM documents WHERE n_chars <= 500"""
)
def change_set_paths(spark, sf_dir):
    """Both sides of a change set: long documents moved, middle ones edited, short ones deleted."""
    n, name = F.col("n_chars"), F.col("doc_id").cast("string")
    status = F.when(n > 1000, "R").when(n > 500, "M").otherwise("D")
    rows = table(spark, sf_dir, "documents").select(
        status.alias("status"), F.concat(F.lit("docs/"), name).alias("path"), F.when(n > 1000, F.concat(F.lit("old/"), name)).alias("old_path")
    )
    changed = changes.changed_paths(rows).withColumn("side", F.lit("changed"))
    return changed.unionByName(changes.removed_paths(rows).withColumn("side", F.lit("removed")))


@query(
    r"""WITH RECURSIVE old AS (SELECT source || '/' || doc_id AS p, coalesce(text, '') AS t FROM documents),
new AS (SELECT 'moved/' || doc_id AS p, coalesce(regexp_replace(text, '\n[^\n]*\z', ''), '') AS t FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'benchmark/' || item_id, text FROM benchmark),
same AS (SELECT o.p AS old_path, n.p AS path FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p) AS k FROM old) o
         JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p) AS k FROM new) n ON o.t = n.t AND o.k = n.k),
a AS (SELECT p, line, sum(strlen(line) + 1) AS b FROM (SELECT p, unnest(string_split(t, chr(10))) AS line FROM old WHERE t <> '' AND p NOT IN (SELECT old_path FROM same)) GROUP BY ALL),
z AS (SELECT p, line, sum(strlen(line) + 1) AS b FROM (SELECT p, unnest(string_split(t, chr(10))) AS line FROM new WHERE t <> '' AND p NOT IN (SELECT path FROM same)) GROUP BY ALL),
size AS (SELECT p, sum(b) AS n FROM a GROUP BY p UNION ALL SELECT p, sum(b) FROM z GROUP BY p),
common AS (SELECT a.p AS old_path, z.p AS path, sum(least(a.b, z.b)) AS n FROM a JOIN z USING (line) GROUP BY ALL),
pair AS (SELECT old_path, path, CAST(c.n * 100 // greatest(x.n, y.n) AS INTEGER) AS score FROM common c JOIN size x ON x.p = old_path JOIN size y ON y.p = path WHERE c.n * 100 >= greatest(x.n, y.n) * 50),
found AS (
  SELECT old_path, path, score, FALSE AS taken FROM pair
  UNION ALL
  SELECT old_path, path, score, best FROM (
    SELECT *, bool_or(best) OVER (PARTITION BY old_path) OR bool_or(best) OVER (PARTITION BY path) AS settled FROM (
      SELECT old_path, path, score, row_number() OVER (PARTITION BY old_path ORDER BY score DESC, path) = 1
        AND row_number() OVER (PARTITION BY path ORDER BY score DESC, old_path) = 1 AS best FROM found WHERE NOT taken)) WHERE best OR NOT settled)
SELECT path, old_path, 100 AS score FROM same UNION ALL SELECT path, old_path, score FROM found WHERE taken"""
)
def renamed_files(spark, sf_dir):
    """Which file moved where, after all documents moved without their last line, toxic ones went and benchmark items came."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    name = F.col("doc_id").cast("string")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    old = docs.select(F.concat("source", F.lit("/"), name).alias("path"), F.col("text").alias("content"))
    length = F.char_length("text") - F.char_length(F.substring_index("text", "\n", -1)) - 1
    shorter = F.when(F.contains("text", F.lit("\n")), F.left("text", length)).otherwise(F.col("text"))
    new = docs.select("doc_id", F.concat(F.lit("moved/"), name).alias("path"), shorter.alias("content"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), F.col("text").alias("content"))
    # written before the join, which would otherwise come first and move the texts
    new = written(digests(new), "digests-moved").join(toxic, "doc_id", "left_anti").drop("doc_id")
    return renames(old, new.unionByName(written(digests(items), "digests-items"))).select("path", "old_path", "score")


@query(_ACTIONS + "SELECT path, action, in_change_set FROM act")
def update_actions(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return changes.update_plan(old, new, _change_set(spark, sf_dir))


@query(
    _ACTIONS
    + """SELECT count(*) FILTER (action <> 'remove') AS files_scanned, count(*) FILTER (in_change_set) AS files_parsed,
count(*) FILTER (action = 'remove') AS files_removed, count(*) FILTER (action <> 'remove' AND NOT in_change_set) AS files_reused FROM act"""
)
def update_counters(spark, sf_dir):
    return changes.run_counters(update_actions(spark, sf_dir))


@query(_SNAPSHOTS + "SELECT path, h AS content_hash FROM new")
def merged_snapshot(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    plan = update_actions(spark, sf_dir)
    fresh = new.join(plan.filter("action = 'parse'").select("path"), "path", "left_semi")
    return changes.merge_snapshot(old, fresh, plan)


@query("SELECT * FROM (VALUES ('README.md', 'unchanged'), ('ARCHITECTURE.md', 'changed'), ('SEQUENCE.md', 'changed')) AS t(doc, reason)")
def fingerprint_decisions(spark, sf_dir):
    """What to write again after the body of every nation's method lost its call."""
    edited = star_corpus(spark, sf_dir).withColumn(
        "content", F.replace(F.col("content").cast("string"), F.lit("store.load();"), F.lit("")).cast("binary")
    )
    after = Analysis(parse_files(edited)).fingerprints
    return regeneration(after, analysis(spark, sf_dir).fingerprints).select("doc", "reason")


# -- edits of a kept graph ------------------------------------------------------------------------------------

_graphs: dict[tuple[str, str], Graph] = {}


def updated_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The kept graph of the tree after an edit: region 0 and customers in debt are gone, every fifth nation calls nothing any more.

    Nations of region 0 are resolved again because a key of theirs lost its meaning, not because they were edited.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        root, end = F.lit("src/main/java/com/acme/"), F.lit(".java")
        debt = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(root, F.lit("customer/Customer"), F.col("c_custkey").cast("string"), end).alias("path"))
        region = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.concat(root, F.lit("region/RegionStore"), F.col("r_regionkey").cast("string"), end).alias("path"))
        quiet = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 1").select(F.concat(root, F.lit("nation/NationService"), F.col("n_nationkey").cast("string"), end).alias("path"))
        silent = F.replace(F.col("content").cast("string"), F.lit("store.load();"), F.lit("")).cast("binary")
        edited = star_corpus(spark, sf_dir).join(quiet, "path", "left_semi").select("path", silent.alias("content"))
        graph = Graph.build(analysis(spark, sf_dir).parsed)
        _graphs[key] = graph.update(parse_files(edited), debt.union(region))[0]
    return _graphs[key]


_KEPT = """ WHERE dst <> 'com.acme.region.RegionStore0'
  AND src NOT IN (SELECT 'com.acme.customer.Customer' || c_custkey FROM customer WHERE c_acctbal < 0)"""


@query(_TREE + "SELECT src, dst, kinds FROM edge" + _KEPT)
def updated_dependency_edges(spark, sf_dir):
    """Class edges after an edit, from the references of what it concerns."""
    e = updated_graph(spark, sf_dir).dependency_edges
    return e.select("src", "dst", strings(dependencies.kind_names(F.col("kind_mask"))).alias("kinds"))


@query(
    _TREE
    + """SELECT caller_class, caller_method, callee_class, callee_method FROM call WHERE callee_class <> 'com.acme.region.RegionStore0'
  AND caller_class NOT IN (SELECT 'com.acme.nation.NationService' || n_nationkey FROM nation WHERE n_nationkey % 5 = 1)"""
)
def updated_calls(spark, sf_dir):
    """Calls after an edit."""
    return updated_graph(spark, sf_dir).calls.rows().select("caller_class", "caller_method", "callee_class", "callee_method")


@query(_TREE + "SELECT DISTINCT s.package AS src_package, d.package AS dst_package FROM edge JOIN cls s ON s.fqn = src JOIN cls d ON d.fqn = dst" + _KEPT)
def updated_package_graph(spark, sf_dir):
    """Package edges after an edit, from the counts of class edges behind each."""
    return updated_graph(spark, sf_dir).pairs.rows().select("src_package", "dst_package")


@query(
    _TREE
    + """, shown AS (FROM entry WHERE n_regionkey = 0 OR s_nationkey % 5 = 1)
SELECT doc, CASE WHEN doc = 'SEQUENCE.md' AND NOT EXISTS (FROM shown) THEN 'unchanged' ELSE 'changed' END AS reason
FROM (SELECT unnest(['README.md', 'ARCHITECTURE.md', 'SEQUENCE.md']) AS doc)"""
)
def updated_decisions(spark, sf_dir):
    """What to write after an edit, from digests that rows were taken from and added to."""
    after = updated_graph(spark, sf_dir).analysis().fingerprints
    return regeneration(after, analysis(spark, sf_dir).fingerprints).select("doc", "reason")


@query(
    _TREE
    + """, small AS (SELECT flow_ord FROM entry JOIN supplier USING (s_suppkey) WHERE s_acctbal < 5000),
doc AS (SELECT unnest(['README.md', 'ARCHITECTURE.md', 'SEQUENCE.md']) AS doc)
SELECT 'edited' AS run, doc, CASE WHEN doc = 'SEQUENCE.md' AND EXISTS (FROM small) OR doc = 'ARCHITECTURE.md' AND EXISTS (FROM small WHERE flow_ord = 1)
  THEN 'changed' ELSE 'unchanged' END AS reason FROM doc
UNION ALL SELECT 'first', doc, 'initial' FROM doc UNION ALL SELECT 'forced', doc, 'forced' FROM doc"""
)
def route_edit_decisions(spark, sf_dir):
    """What to write after the routes of suppliers with small balances got another path: only flows that show one change."""
    name = F.concat(F.lit("src/main/java/com/acme/supplier/SupplierApi"), F.col("s_suppkey").cast("string"), F.lit(".java"))
    small = table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select(name.alias("path"), F.lit(True).alias("small"))
    other = F.replace(F.col("content").cast("string"), F.lit('@GetMapping("/'), F.lit('@GetMapping("/small/')).cast("binary")
    edited = star_corpus(spark, sf_dir).join(small, "path", "left")
    edited = edited.select("path", F.when(F.col("small"), other).otherwise(F.col("content")).alias("content"))
    before, after = analysis(spark, sf_dir).fingerprints, Analysis(parse_files(edited)).fingerprints
    runs = {"edited": regeneration(after, before), "first": regeneration(after, None), "forced": regeneration(after, before, force=True)}
    return reduce(DataFrame.unionByName, (d.select(F.lit(run).alias("run"), "doc", "reason") for run, d in runs.items()))


@query(_TREE + """SELECT package, count(*) OVER (PARTITION BY package) AS class_count, 'class' AS kind, name, n_methods, fan_out
FROM cls JOIN ranked USING (fqn)""")
def scan_report(spark, sf_dir):
    rows = package_report(analysis(spark, sf_dir))
    return rows.select("package", "class_count", "kind", "name", "n_methods", "fan_out")


# -- the second tree: interfaces, implementors, overloads, the step limit --------------------------------------

_PORTS = """
WITH line AS (
  SELECT p_partkey AS p, i, greatest(p_partkey - i, 0) AS port FROM (SELECT p_partkey, p_size, unnest(range(1, p_size % 15 + 2)) AS i FROM part)
), impl AS (
  SELECT p_partkey AS p, 'com.acme.adapter.Adapter' || p_partkey AS fqn FROM part
  UNION ALL SELECT p_partkey, 'com.acme.adapter.Backup' || p_partkey FROM part WHERE p_partkey % 5 = 0
), edge AS (
  SELECT fqn AS src, 'com.acme.port.Port' || p AS dst, 'implements' AS kinds FROM impl
  UNION ALL SELECT fqn, 'com.acme.base.Meter', 'field' FROM impl
  UNION ALL SELECT 'com.acme.task.StockTask' || p_partkey, 'com.acme.base.BaseTask', 'extends' FROM part
  UNION ALL SELECT 'com.acme.task.StockTask' || p_partkey, 'com.acme.base.Money', 'field' FROM part
  UNION ALL SELECT DISTINCT 'com.acme.task.StockTask' || p, 'com.acme.port.Port' || port, 'field' FROM line
), call AS (
  SELECT fqn AS caller_class, 'quote' AS caller_method, 'com.acme.base.Meter' AS callee_class, 'read' AS callee_method FROM impl
  UNION ALL SELECT 'com.acme.task.StockTask' || p, 'run', 'com.acme.port.Port' || port, 'quote' FROM line
  UNION ALL SELECT 'com.acme.task.StockTask' || p_partkey, 'run', 'com.acme.base.Money', 'add' FROM (SELECT p_partkey, unnest([1, 2]) FROM part)
), slot AS (
  SELECT p, row_number() OVER (ORDER BY n DESC, name, copy) AS flow_ord FROM (
    SELECT p, 'com.acme.task.StockTask' || p AS name, count(*) AS n, unnest([1, 2]) AS copy FROM line GROUP BY p) QUALIFY flow_ord <= 8
), walk AS (
  SELECT flow_ord, slot.p, i, 0 AS sub, port FROM slot JOIN line USING (p)
  UNION ALL SELECT flow_ord, slot.p, min(i), 1, port FROM slot JOIN line USING (p) WHERE port % 5 <> 0 GROUP BY ALL
), step AS (
  SELECT *, row_number() OVER (PARTITION BY flow_ord ORDER BY i, sub) AS step_ord FROM walk QUALIFY step_ord <= 12
), named AS (
  SELECT flow_ord, step_ord,
    CASE sub WHEN 0 THEN 'com.acme.task.StockTask' || p ELSE 'com.acme.adapter.Adapter' || port END AS caller_class,
    CASE sub WHEN 0 THEN 'run' ELSE 'quote' END AS caller_method,
    CASE WHEN sub = 1 THEN 'com.acme.base.Meter' WHEN port % 5 = 0 THEN 'com.acme.port.Port' || port ELSE 'com.acme.adapter.Adapter' || port END AS callee_class,
    CASE sub WHEN 0 THEN 'quote' ELSE 'read' END AS callee_method, CASE sub WHEN 0 THEN 'String' END AS return_type,
    step_ord = max(step_ord) OVER (PARTITION BY flow_ord) AS is_last FROM step
)
"""


def port_analysis(spark, sf_dir):
    return analysis(spark, sf_dir, port_corpus)


@query(_PORTS + "SELECT src, dst, kinds FROM edge")
def port_dependency_edges(spark, sf_dir):
    return port_analysis(spark, sf_dir).dependency_edges.select("src", "dst", strings("kinds").alias("kinds"))


@query(_PORTS + "SELECT src, dst, kinds FROM edge")
def port_edges_split(spark, sf_dir):
    """The same edges with the common base class treated as the hot key it is."""
    a = port_analysis(spark, sf_dir)
    found = resolve.candidates(written(dependencies.references(a.classes), "references"))
    edges = dependencies.dependency_edges(resolve.resolve(found, a.names, dependencies.REFERENCE, hot_keys(found, "key", 100)))
    return edges.select("src", "dst", strings(dependencies.kind_names(F.col("kind_mask"))).alias("kinds"))


@query(_PORTS + "SELECT dst AS fqn, count(*) AS fan_in FROM edge GROUP BY dst")
def port_fan_in(spark, sf_dir):
    return dependencies.fan(port_analysis(spark, sf_dir).edges).filter("fan_in > 0").select("fqn", "fan_in")


@query(_PORTS + "SELECT caller_class, caller_method, count(*) AS n_calls, count(*) AS last_rank FROM call GROUP BY ALL")
def port_calls_by_caller(spark, sf_dir):
    """Methods with up to 17 calls: all are kept."""
    from sourceloom.operators.calls import calls_by_caller as grouped

    rows = grouped(port_analysis(spark, sf_dir).calls).groupBy("caller_class", "caller_method")
    return rows.agg(F.count("*").alias("n_calls"), F.max("call_rank").cast("bigint").alias("last_rank"))


@query(_PORTS + "SELECT caller_class, caller_method, callee_class, callee_method, count(*) AS n FROM call GROUP BY ALL")
def port_calls(spark, sf_dir):
    columns = ["caller_class", "caller_method", "callee_class", "callee_method"]
    return port_analysis(spark, sf_dir).calls.groupBy(*columns).agg(F.count("*").alias("n"))


@query(_PORTS + "SELECT 'com.acme.port.Port' || p AS interface, min(fqn) AS implementor FROM impl GROUP BY p HAVING count(*) = 1")
def port_redirects(spark, sf_dir):
    """Interfaces a trace passes through to their only implementor."""
    return port_analysis(spark, sf_dir).redirects


@query(_PORTS + """SELECT caller_class, caller_method, count(*) AS n_calls FROM call
WHERE callee_class <> 'com.acme.base.Money' GROUP BY ALL""")
def port_meaningful_calls(spark, sf_dir):
    """Calls but for those on plain data."""
    rows = port_analysis(spark, sf_dir).meaningful_calls
    return rows.groupBy("caller_class", "caller_method").agg(F.count("*").alias("n_calls"))


@query(
    _PORTS
    + """SELECT flow_ord, step_ord, caller_class, caller_method, callee_class, callee_method, return_type FROM named
UNION ALL SELECT flow_ord, step_ord + 1, callee_class, callee_method, 'Relational Database', callee_method, 'result' FROM named
WHERE is_last AND callee_class = 'com.acme.base.Meter'"""
)
def port_flows(spark, sf_dir):
    """Flows through interfaces up to the step limit, overloads filling slots of their own."""
    rows = port_analysis(spark, sf_dir).flows.select(F.col("flow_ord").cast("bigint").alias("flow_ord"), F.posexplode("steps").alias("i", "s"))
    return rows.select("flow_ord", (F.col("i") + 1).cast("bigint").alias("step_ord"), "s.*")


# -- the third tree: every way to name a class, every kind of declaration ---------------------------------------

_YARD = """
WITH base AS (
  SELECT o_orderkey AS o, min(l_suppkey) AS s, o_orderkey % 8 AS way, o_orderkey % 3 AS form, o_orderkey % 5 < 3 AS is_public
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
), ord AS (
  SELECT *, CASE way WHEN 3 THEN 'yard.bins' WHEN 4 THEN 'yard.spare' WHEN 7 THEN '' ELSE 'yard.orders' END AS package,
    CASE WHEN package = '' THEN '' ELSE package || '.' END || 'Order' || o AS fqn, 'src/yard/Order' || o || '.java' AS path,
    CASE way WHEN 6 THEN 'yard.bins.' ELSE '' END || 'Bin' || s AS bin,
    'yard.bins.Bin' || s AS near, 'yard.spare.Bin' || s AS spare, s % 3 = 0 AS has_spare, s % 3 <> 0 AND s % 4 <> 0 AS is_single,
    CASE WHEN way IN (0, 3, 6) THEN near WHEN way IN (4, 5) AND has_spare THEN spare
         WHEN way = 5 OR way = 4 AND is_single THEN near WHEN way IN (1, 2, 7) AND is_single THEN near END AS typed,
    CASE WHEN way <> 6 THEN typed WHEN has_spare THEN spare WHEN is_single THEN near END AS called
  FROM base
), decl AS (
  SELECT fqn, 'Order' || o AS name, package, path, CASE form WHEN 0 THEN 'class' WHEN 1 THEN 'enum' ELSE 'record' END AS kind, is_public FROM ord
  UNION ALL SELECT fqn || '.Line', 'Line', package, path, 'class', FALSE FROM ord WHERE form = 0
  UNION ALL SELECT fqn || '.Line.Probe', 'Probe', package, path, 'interface', FALSE FROM ord WHERE form = 0
  UNION ALL SELECT fqn || '.Mark', 'Mark', package, path, 'annotation', TRUE FROM ord WHERE form = 0
  UNION ALL SELECT 'yard.bins.Bin' || s_suppkey, 'Bin' || s_suppkey, 'yard.bins', 'src/yard/bins/Bin' || s_suppkey || '.java', 'class', TRUE FROM supplier
  UNION ALL SELECT 'yard.spare.Bin' || s_suppkey, 'Bin' || s_suppkey, 'yard.spare', 'src/yard/spare/Bin' || s_suppkey || '.java', 'class', TRUE
    FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT 'yard.bins.Bin' || s_suppkey, 'Bin' || s_suppkey, 'yard.bins', 'src/yard/twice/Bin' || s_suppkey || '.java', 'enum', TRUE
    FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT 'yard.book.Ledger', 'Ledger', 'yard.book', 'src/yard/book/Ledger.java', 'class', TRUE
), imp AS (
  SELECT path, unnest(CASE way WHEN 0 THEN [near] WHEN 2 THEN ['yard.bins.*', near || '.open'] WHEN 5 THEN [spare, near] WHEN 6 THEN [spare] ELSE [] END) AS import_path,
    unnest(CASE way WHEN 0 THEN [0] WHEN 2 THEN [0, 1] WHEN 5 THEN [0, 1] WHEN 6 THEN [0] ELSE [] END) AS import_ord,
    way = 2 AND import_ord = 1 AS is_static, way = 2 AND import_ord = 0 AS is_wildcard FROM ord
), edge AS (
  SELECT fqn AS src, typed AS dst, CASE form WHEN 0 THEN 'field,param' ELSE 'field' END AS kinds FROM ord WHERE typed IS NOT NULL
  UNION ALL SELECT fqn, 'yard.book.Ledger', CASE form WHEN 0 THEN 'creates,param' WHEN 1 THEN 'return' ELSE 'creates,return' END FROM ord
  UNION ALL SELECT 'yard.book.Ledger', 'yard.bins.Bin1', 'field'
), call AS (
  SELECT fqn AS caller_class, m.caller_method, m.callee_class, m.callee_method FROM (
    SELECT fqn, unnest(CASE form WHEN 0 THEN [
        {'caller_method': 'Order' || o, 'callee_class': fqn, 'callee_method': 'check'},
        {'caller_method': 'handle', 'callee_class': 'yard.book.Ledger', 'callee_method': 'post'},
        {'caller_method': 'handle', 'callee_class': typed, 'callee_method': 'fill'},
        {'caller_method': 'handle', 'callee_class': fqn, 'callee_method': 'check'},
        {'caller_method': 'handle', 'callee_class': fqn, 'callee_method': 'check'},
        {'caller_method': 'handle', 'callee_class': called, 'callee_method': 'open'},
        {'caller_method': 'handle', 'callee_class': typed, 'callee_method': 'next'}]
      WHEN 2 THEN [{'caller_method': 'total', 'callee_class': typed, 'callee_method': 'next'}] ELSE [] END) AS m FROM ord)
  WHERE m.callee_class IS NOT NULL
  UNION ALL SELECT 'yard.book.Ledger', 'post', 'yard.book.Ledger', 'part' || unnest(range(1, 21))
)
"""


def yard_analysis(spark, sf_dir):
    return analysis(spark, sf_dir, yard_corpus)


@query(
    _YARD
    + """SELECT d.path, nullif(any_value(d.package), '') AS package, count(*) AS n_classes, coalesce(any_value(i.n), 0) AS n_imports,
  CASE WHEN any_value(ord.o) % 11 = 0 THEN 1 ELSE 0 END AS n_errors
FROM decl d LEFT JOIN ord USING (path) LEFT JOIN (SELECT path, count(*) AS n FROM imp GROUP BY path) i USING (path) GROUP BY d.path"""
)
def yard_files(spark, sf_dir):
    """Files with several classes, without a package, with a syntax error."""
    return yard_analysis(spark, sf_dir).parsed.select(
        "path", "package", F.size("classes.name").cast("bigint").alias("n_classes"), F.size("imports.path").cast("bigint").alias("n_imports"),
        F.size("parse_errors").alias("n_errors"),
    )


@query(_YARD + "SELECT path, import_ord, import_path, is_static, is_wildcard FROM imp")
def yard_imports(spark, sf_dir):
    """Plain, static and wildcard imports."""
    return yard_analysis(spark, sf_dir).imports


@query(
    _YARD
    + """SELECT fqn, max_by(path, path) AS path, max_by(kind, path) AS kind, max_by(package, path) AS package, bool_or(is_public) AS is_public,
  count(*) AS n_declared FROM decl GROUP BY fqn"""
)
def yard_symbols(spark, sf_dir):
    """Nested types of all kinds; of equal qualified names the last declaration."""
    return yard_analysis(spark, sf_dir).symbols.select("fqn", "path", "kind", "package", "is_public", "n_declared")


@query(_YARD + "SELECT name, any_value(fqn) AS fqn FROM decl GROUP BY name HAVING count(*) = 1")
def yard_unique_names(spark, sf_dir):
    """Simple names that one declaration bears; others are ambiguous or declared twice."""
    return symbols.unique_names(yard_analysis(spark, sf_dir).symbols).select("name", "fqn")


@query(_YARD + "SELECT DISTINCT fqn FROM decl WHERE is_public")
def yard_public_api(spark, sf_dir):
    return symbols.public_api(yard_analysis(spark, sf_dir).symbols).select("fqn")


@query(_YARD + "SELECT fqn, CASE form WHEN 0 THEN 'T extends Comparable<T>|U' ELSE 'K' END AS type_parameters FROM ord WHERE form <> 1")
def yard_type_parameters(spark, sf_dir):
    rows = yard_analysis(spark, sf_dir).classes.filter(F.size("type_parameters") > 0)
    return rows.select("fqn", F.array_join("type_parameters", "|").alias("type_parameters"))


@query(
    _YARD
    + """SELECT fqn, f.field_ord, f.name, f.type, f.modifiers FROM (SELECT fqn, unnest(CASE form
  WHEN 0 THEN [{'field_ord': 0, 'name': 'bin', 'type': bin, 'modifiers': 'private'}, {'field_ord': 1, 'name': 'other', 'type': bin, 'modifiers': 'private'},
    {'field_ord': 2, 'name': 'first', 'type': 'Line', 'modifiers': 'private'}]
  WHEN 1 THEN [{'field_ord': 0, 'name': 'OPEN', 'type': 'Order' || o, 'modifiers': 'static,final'},
    {'field_ord': 1, 'name': 'CLOSED', 'type': 'Order' || o, 'modifiers': 'static,final'}, {'field_ord': 2, 'name': 'bin', 'type': bin, 'modifiers': 'private'}]
  ELSE [{'field_ord': 0, 'name': 'bin', 'type': bin, 'modifiers': 'final'}] END) AS f FROM ord)
UNION ALL SELECT fqn || '.Line', 0, 'qty', 'int', '' FROM ord WHERE form = 0
UNION ALL SELECT 'yard.bins.Bin' || s_suppkey, unnest([0, 1]), unnest(['LEFT', 'RIGHT']), 'Bin' || s_suppkey, 'static,final' FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'yard.book.Ledger', 0, 'first', 'yard.bins.Bin1', 'private'"""
)
def yard_fields(spark, sf_dir):
    """Several declarators, enum constants, record components, fields of nested types."""
    rows = tables.fields(yard_analysis(spark, sf_dir).classes)
    return rows.select("fqn", "field_ord", "name", "type", strings("modifiers").alias("modifiers"))


@query(
    _YARD
    + """SELECT fqn, m.method_ord, m.signature, m.is_constructor FROM (SELECT fqn, unnest(CASE form
  WHEN 0 THEN [{'method_ord': 0, 'signature': 'protected Order' || o || '(' || bin || '... many)', 'is_constructor': TRUE},
    {'method_ord': 1, 'signature': 'public void handle(Ledger bin, int times)', 'is_constructor': FALSE},
    {'method_ord': 2, 'signature': 'private void check()', 'is_constructor': FALSE}]
  ELSE [{'method_ord': 0, 'signature': 'Ledger total()', 'is_constructor': FALSE}] END) AS m FROM ord)
UNION ALL SELECT fqn || '.Line.Probe', 0, 'void look()', FALSE FROM ord WHERE form = 0
UNION ALL SELECT fqn, unnest([0, 1, 2]), unnest(['public static void open()', 'public ' || name || ' next()', 'void fill()']), FALSE
  FROM decl WHERE name LIKE 'Bin%' AND kind = 'class'
UNION ALL SELECT fqn, 0, 'void fill()', FALSE FROM decl WHERE name LIKE 'Bin%' AND kind = 'enum'
UNION ALL SELECT 'yard.book.Ledger', 0, 'public void post()', FALSE"""
)
def yard_signatures(spark, sf_dir):
    """Constructors, a variable number of arguments, methods of nested types."""
    return yard_analysis(spark, sf_dir).methods.select("fqn", "method_ord", "signature", "is_constructor")


@query(_YARD + "SELECT src, dst, kinds FROM edge")
def yard_dependency_edges(spark, sf_dir):
    """Qualified names, imports in order, the own package, unique simple names: each decides some edges, and some names mean nothing."""
    return yard_analysis(spark, sf_dir).dependency_edges.select("src", "dst", strings("kinds").alias("kinds"))


@query(
    _YARD
    + """, place AS (SELECT fqn, max_by(package, path) AS package FROM decl GROUP BY fqn)
SELECT DISTINCT s.package AS src_package, d.package AS dst_package FROM edge JOIN place s ON s.fqn = src JOIN place d ON d.fqn = dst
WHERE s.package <> d.package"""
)
def yard_package_graph(spark, sf_dir):
    return yard_analysis(spark, sf_dir).package_edges


@query(_YARD + "SELECT 'used by' AS side, src AS fqn FROM edge WHERE dst = 'yard.book.Ledger' UNION ALL SELECT 'uses', dst FROM edge WHERE src = 'yard.book.Ledger'")
def yard_neighbours(spark, sf_dir):
    """Both sides of one class that all others use."""
    edges, fqn = yard_analysis(spark, sf_dir).edges, "yard.book.Ledger"
    users = dependencies.dependents_of(edges, fqn).select(F.lit("used by").alias("side"), F.col("src").alias("fqn"))
    return users.unionByName(dependencies.dependencies_of(edges, fqn).select(F.lit("uses").alias("side"), F.col("dst").alias("fqn")))


@query(_YARD + "SELECT caller_class, caller_method, callee_class, callee_method, count(*) AS n FROM call GROUP BY ALL")
def yard_calls(spark, sf_dir):
    """Calls on oneself, on parameters that hide fields, on fields and on class names; chained and foreign ones are dropped."""
    columns = ["caller_class", "caller_method", "callee_class", "callee_method"]
    return yard_analysis(spark, sf_dir).calls.groupBy(*columns).agg(F.count("*").alias("n"))


@query(
    _YARD
    + """, called AS (SELECT DISTINCT callee_class, callee_method FROM call),
able AS (SELECT fqn, 'handle' AS method FROM ord WHERE form = 0 AND is_public UNION ALL SELECT 'yard.book.Ledger', 'post'),
ranked AS (SELECT fqn, method, (fqn, method) IN (SELECT (callee_class, callee_method) FROM called) AS is_called,
    (SELECT count(*) FROM call WHERE caller_class = fqn AND caller_method = method) AS n FROM able)
SELECT row_number() OVER (ORDER BY is_called, n DESC, fqn, method) AS flow_ord, fqn AS entry_class, method AS entry_method FROM ranked
QUALIFY flow_ord <= 8"""
)
def yard_entry_points(spark, sf_dir):
    """Methods that nobody calls come before one with more calls that all others call."""
    a = yard_analysis(spark, sf_dir)
    rows = flows.entry_points(a.methods, a.calls)
    return rows.select(F.col("flow_ord").cast("bigint").alias("flow_ord"), "entry_class", "entry_method")


# -- contract --------------------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Class dependency edges of the tree rendered from the smallest tables."""
    return dependency_edges(spark, "/root/testdata/sf0.001")


def _optional() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the subpackage `llm` and of the pipeline, as far as they are there."""
    found, sql = {}, {}
    try:
        from sourceloom.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("sourceloom.llm", "sourceloom.llm.queries"):
            raise
        return found, sql
    found.update(llm.QUERIES)
    sql.update(llm.ORACLES)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return _QUERIES | _optional()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _optional()[1]
