"""Queries on catalogs made of the part table: a document of 300 parts each, groups of 30, enhancements within enhancements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog, maintenance, records

ROOT, GROUP = 300, 30


def _marker(of: str = "k"):
    return F.concat(F.lit("{{ insert: param, p_"), F.col(of).cast("string"), F.lit(" }}"))


def _controls(spark, d) -> DataFrame:
    """``k, c``: each part as a control, by what its key leaves when divided by small numbers."""
    k, key = F.col("k"), F.col("k").cast("string")
    prop = lambda name, value, kind=None: F.struct(F.lit(name).alias("name"), F.lit(kind).cast("string").alias("class"), value.alias("value"))
    none = F.lit(None).cast("string")
    props = F.array(prop("label", F.concat(F.lit("0"), key), "zero-padded"), prop("label", F.concat(F.lit("XX-"), key)), prop("sort-id", F.concat(F.lit("xx-"), F.lpad(key, 9, "0"))), prop("status", F.when(k % 7 == 3, "withdrawn").otherwise("live")))
    param = F.struct(
        F.concat(F.lit("p_"), key).alias("id"), F.when(k % 8 == 2, F.concat("p_name", F.lit(" "), _marker())).when(k % 8 == 6, F.col("p_name")).alias("label"), F.when(k % 4 == 0, F.array("p_brand", "p_type")).alias("values"),
        F.when(k % 4 == 1, F.struct(F.when(k % 8 == 1, "one-or-more").alias("how-many"), F.array(F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")), F.concat(F.lit("as "), _marker("up"), F.lit("\n"))).alias("choice"))).alias("select"),
        F.when(k % 4 == 3, F.array(F.struct(F.lit(" ; ").alias("prose")), F.struct(F.when(k % 8 == 3, F.concat(F.lit(" "), _marker("up"), F.lit(" ;. "))).otherwise(F.concat("p_name", F.lit(";. "))).alias("prose")))).alias("guidelines"),
    )
    part = lambda name, id_, prose, label=none, parts=None: [id_.alias("id"), F.lit(name).alias("name"), prose.alias("prose"), F.when(label.isNotNull(), F.array(prop("label", label))).alias("props"), *([parts.alias("parts")] if parts is not None else [])]
    leaf = F.struct(*part("item", F.concat(F.lit("xx-"), key, F.lit("_smt.a")), F.concat(F.lit("use  "), _marker(), F.lit(" daily")), F.lit("a.")))
    empty = F.struct(*part("item", none, F.lit("")))
    statement = F.struct(*part("statement", F.concat(F.lit("xx-"), key, F.lit("_smt")), F.concat(F.lit("Do "), _marker(), F.lit(" .")), none, F.array(leaf, empty)))
    other = F.struct(*part("guidance", none, F.when(k % 5 == 0, "").otherwise(F.col("p_type")), none, F.array(empty)))
    unread = F.struct(*part("assessment", none, F.lit("not read"), none, F.array(empty)))
    parts = F.when(k % 2 == 0, F.array(other, unread, statement)).otherwise(F.array(statement, other, unread))
    rows = spark.read.parquet(f"{d}/part.parquet").withColumn("k", F.col("p_partkey")).withColumn("up", F.greatest(F.col("k") - F.col("k") % 4, F.lit(0)))
    # a parameter that is a selection, or has guidelines, names the one of its block of four that has values
    return rows.select("k", F.struct(F.concat(F.lit("xx-"), key).alias("id"), F.col("p_name").alias("title"), props.alias("props"), F.array(param).alias("params"), parts.alias("parts")).alias("c"))


def catalog_documents(spark, d) -> DataFrame:
    """``root, document`` (VARIANT)."""
    all_ = _controls(spark, d)
    third = all_.filter("k % 3 = 2").select((F.col("k") - 1).alias("k"), F.col("c").alias("inner"))
    below = lambda rows: rows.withColumn("c", F.col("c").withField("controls", F.when(F.col("inner").isNotNull(), F.array("inner")))).drop("inner")
    second = below(all_.filter("k % 3 = 1").join(catalog.dealt(third), "k", "left")).select((F.col("k") - 1).alias("k"), F.col("c").alias("inner"))
    first = below(all_.filter("k % 3 = 0").join(catalog.dealt(second), "k", "left"))
    group = first.groupBy(F.floor(F.col("k") / GROUP).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json("c").alias("c")))), lambda x: x["c"]).alias("controls"))
    body = F.concat(F.lit('{"id":"g'), F.col("g").cast("string"), F.lit('","title":"Group '), F.col("g").cast("string"), F.lit('","parts":[{"name":"overview","prose":"About these.","parts":[{"name":"item"}]}],"controls":['), F.array_join("controls", ","), F.lit("]}"))
    root = group.select(F.floor(F.col("g") * GROUP / ROOT).alias("root"), "g", body.alias("body")).groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "body"))), lambda x: x["body"]), ",").alias("groups"))
    head = F.concat(F.lit('{"catalog":{"uuid":"u'), F.col("root").cast("string"), F.lit('","metadata":{"title":"t","version":"1","last-modified":"2024-01-01","oscal-version":"1.1"},"groups":['), "groups", F.lit("]}}"))
    return root.select("root", F.parse_json(head).alias("document"))


def _tables(spark, d) -> catalog.Catalog:
    return catalog.catalog_tables(catalog_documents(spark, d))


def catalog_metadata(spark, d):
    return _tables(spark, d).metadata


def catalog_groups(spark, d):
    return _tables(spark, d).groups.select("root", "group_id", "title")


def parent_propagation(spark, d):
    return _tables(spark, d).controls.select("root", "group_id", "id", "title", "label", "padded_label", "sort_id", "withdrawn", "base_id", "is_enhancement")


def catalog_parts(spark, d):
    return _tables(spark, d).parts.groupBy("root", "control_id").agg(F.count("*").alias("parts"), F.count_if(F.col("depth") > 0).alias("inner_parts"), F.count_if(F.coalesce("prose", F.lit("")) != "").alias("said"), F.max("label").alias("label"))


def parameter_render(spark, d):
    return catalog.rendered(_tables(spark, d).parameters)


def _named_documents(spark, d) -> DataFrame:
    """Documents as controls whose labels have nothing to do with their ids."""
    n = F.col("doc_id").cast("string")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return rows.select("doc_id", F.concat(F.lit("zz-"), n).alias("id"), F.concat(F.lit("Straße "), n).alias("label"), F.concat(F.upper("source"), F.lit("/"), n).alias("padded_label"), F.concat(F.lit("ΟΔΟΣ "), n, F.lit("ς")).alias("sort_id"), (F.col("n_chars") % 5 == 0).alias("withdrawn"))


def control_index(spark, d):
    """What names each document: the forms that it is published under, by their keys."""
    return catalog.control_index(_named_documents(spark, d)).select("form", "id")


def index_resolve(spark, d):
    """A turn of a conversation asks for a document, in one of eight spellings; two of them name none."""
    named = _named_documents(spark, d)
    n = (F.col("conv_id") * 7 + F.col("turn")).cast("string")
    said = ["STRASSE %s", "  straße %s\n", "zz-%s", "SRC3/%s", "οδοσ %sΣ", "ZZ-0%s", "strase %s", "Straße  %s"]
    text = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("%s"), n) for x in said)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    asked = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.alias("text"))
    return catalog.resolve(asked, named).select("conv_id", "turn", "text", "resolved")


def chunk_catalog(spark, d):
    return catalog.chunk_catalog(_tables(spark, d)).select("root", "chunk_id", "control_id", "base_control_id", "control_label", "title", "part_path", "text")


def resolution_digest(spark, d):
    return catalog.resolution_digest(_tables(spark, d))


def catalog_totals(spark, d):
    """Controls, enhancements, withdrawn and live ones, parts and parameters of each document."""
    t = _tables(spark, d)
    counts = t.controls.groupBy("root").agg(F.count_if(~F.col("is_enhancement")).alias("base"), F.count_if("is_enhancement").alias("enhancements"), F.count_if("withdrawn").alias("withdrawn"), F.count_if(~F.col("withdrawn")).alias("live"))
    return counts.join(t.parts.groupBy("root").agg(F.count("*").alias("parts")), "root").join(t.parameters.groupBy("root").agg(F.count("*").alias("parameters")), "root")


def query_vector_rows(spark, d):
    """Recorded vectors in the order of their questions."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("what is "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), "embedding")
    width = v.select(F.size("embedding")).first()[0]
    return records.query_vectors(v, width).select("question", "row", F.size("embedding").alias("width"))


def encoder_with_recordings(spark, d):
    """Two thirds of the questions have recorded vectors, which are used as they are; the others get the encoder's."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("question"), "embedding")
    made = records.encoded(v.select("question"), v.filter("cast(question as long) % 3 > 0"), lambda rest: rest.withColumn("embedding", F.array(F.length("question").cast("float"))))
    return made.select("question", "recorded", F.size("embedding").alias("width"))


def recording_report(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.sha2("text", 256).alias("key"), "conv_id", F.length("text").alias("n"))
    before = t.filter("conv_id % 3 = 0").select("key").unionByName(spark.range(5).select(F.concat(F.lit("gone"), F.col("id").cast("string")).alias("key")))
    done = t.filter("conv_id % 3 > 0").groupBy("key").agg(F.max("n").alias("usage_prompt_tokens"), F.lit(2).alias("usage_completion_tokens"))
    return records.recording_report(t, before, done)


def ranged_digest(spark, d):
    return maintenance.ranged_digest(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", ["doc_id", "lang", "n_chars"], "source", 100)


def multi_part_digest(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", T.multi_digest(F.col("doc_id"), F.col("quality"), F.col("toxic")).alias("digest"))


_K = "(SELECT *, p_partkey AS k FROM part)"
_R = f"""(SELECT k, k // {ROOT} AS root, p_name, p_type, CASE k % 4 WHEN 0 THEN p_brand || ', ' || p_type
  WHEN 1 THEN '[selection (' || CASE WHEN k % 8 = 1 THEN 'one or more' ELSE 'one' END || '): ' || p_type || '; as ' || (SELECT q.p_brand || ', ' || q.p_type FROM part q WHERE q.p_partkey = k - 1) || ']'
  WHEN 3 THEN CASE WHEN k % 8 = 3 THEN '[organization-defined ' || (SELECT q.p_brand || ', ' || q.p_type FROM part q WHERE q.p_partkey = k - 3) || ']' ELSE '[organization-defined ' || p_name || ']' END
  ELSE '[organization-defined ' || p_name || CASE WHEN k % 8 = 2 THEN ' {{{{ insert: param, p_' || k || ' }}}}' ELSE '' END || ']' END AS rendered FROM {_K})"""
_SAID = "CASE WHEN k % 5 = 0 THEN NULL ELSE p_type END"
_NAMED = "(SELECT doc_id, 'zz-' || doc_id AS id, unnest(['zz-' || doc_id, 'strasse ' || doc_id, lower(source) || '/' || doc_id, 'οδοσ ' || doc_id || 'σ']) AS form FROM documents)"
QUERIES = {f.__name__: f for f in (catalog_metadata, catalog_groups, parent_propagation, catalog_parts, parameter_render, control_index, index_resolve, chunk_catalog, resolution_digest, catalog_totals, query_vector_rows, encoder_with_recordings, recording_report, ranged_digest, multi_part_digest)}
SQL = {
    "catalog_metadata": f"SELECT root, 'u' || root AS uuid, 't' AS title, '1' AS version, '2024-01-01' AS last_modified, '1.1' AS oscal_version, CAST(count(DISTINCT k // {GROUP}) AS INTEGER) AS n_groups FROM (SELECT k, k // {ROOT} AS root FROM {_K}) GROUP BY root",
    "catalog_groups": f"SELECT DISTINCT k // {ROOT} AS root, 'g' || (k // {GROUP}) AS group_id, 'Group ' || (k // {GROUP}) AS title FROM {_K}",
    "parent_propagation": f"""SELECT k // {ROOT} AS root, 'g' || (k // {GROUP}) AS group_id, 'xx-' || k AS id, p_name AS title, 'XX-' || k AS label, '0' || k AS padded_label, 'xx-' || lpad(CAST(k AS VARCHAR), 9, '0') AS sort_id,
  k % 7 = 3 AS withdrawn, 'xx-' || CASE WHEN k % 3 = 0 THEN k ELSE k - 1 END AS base_id, k % 3 > 0 AS is_enhancement FROM {_K}""",
    "catalog_parts": f"SELECT k // {ROOT} AS root, 'xx-' || k AS control_id, CAST(7 AS BIGINT) AS parts, CAST(4 AS BIGINT) AS inner_parts, CAST(3 + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS said, 'a.' AS label FROM {_K} UNION ALL SELECT k // {ROOT}, NULL, 2 * count(DISTINCT k // {GROUP}), count(DISTINCT k // {GROUP}), count(DISTINCT k // {GROUP}), NULL FROM {_K} GROUP BY 1",
    "parameter_render": f"SELECT root, 'p_' || k AS param, rendered FROM {_R}",
    "control_index": f"SELECT form, id FROM {_NAMED}",
    "index_resolve": f"""WITH a AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS c, CAST(conv_id * 7 + turn AS VARCHAR) AS n FROM conversations),
t AS (SELECT *, CASE c WHEN 0 THEN 'STRASSE ' || n WHEN 1 THEN '  straße ' || n || chr(10) WHEN 2 THEN 'zz-' || n WHEN 3 THEN 'SRC3/' || n WHEN 4 THEN 'οδοσ ' || n || 'Σ' WHEN 5 THEN 'ZZ-0' || n WHEN 6 THEN 'strase ' || n ELSE 'Straße  ' || n END AS text FROM a)
SELECT conv_id, turn, t.text, CASE WHEN c IN (0, 1, 2, 4) OR c = 3 AND source = 'src3' OR c = 5 AND length(n) < 3 THEN 'zz-' || doc_id END AS resolved FROM t LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = n""",
    "chunk_catalog": f"""SELECT root, 'xx-' || k || ':smt' || CASE WHEN said IS NULL THEN '' ELSE '+guidance' END AS chunk_id, 'xx-' || k AS control_id, 'xx-' || CASE WHEN k % 3 = 0 THEN k ELSE k - 1 END AS base_control_id, 'XX-' || k AS control_label, p_name AS title,
  'smt' || CASE WHEN said IS NULL THEN '' ELSE '+guidance' END AS part_path, 'XX-' || k || ' ' || p_name || E'\\n\\nControl:\\nDo ' || rendered || E'.\\na. use ' || rendered || ' daily' || CASE WHEN said IS NULL THEN '' ELSE E'\\n\\nDiscussion:\\n' || said END AS text
FROM (SELECT *, {_SAID} AS said FROM {_R}) WHERE k % 7 <> 3""",
    "resolution_digest": f"""WITH p AS (SELECT root, k, unnest(range(7)) AS n, unnest(CASE WHEN k % 2 = 0 THEN [coalesce(said, ''), '', 'not read', '', stm, leaf, ''] ELSE [stm, leaf, '', coalesce(said, ''), '', 'not read', ''] END) AS prose
  FROM (SELECT *, {_SAID} AS said, 'Do ' || rendered || '.' AS stm, 'use ' || rendered || ' daily' AS leaf FROM {_R})),
c AS (SELECT root, k, sha256(string_agg('xx-' || k || chr(31) || n || chr(31) || prose || chr(30), '' ORDER BY n)) AS digest FROM p GROUP BY root, k)
SELECT CAST(root AS VARCHAR) AS root, sha256((SELECT string_agg(digest || chr(30), '' ORDER BY k) FROM c WHERE c.root = r.root) || (SELECT string_agg('p_' || k || chr(31) || rendered || chr(30), '' ORDER BY 'p_' || k) FROM {_R} x WHERE x.root = r.root)) AS digest
FROM (SELECT DISTINCT root FROM {_R}) r""",
    "catalog_totals": f"SELECT k // {ROOT} AS root, count(*) FILTER (k % 3 = 0) AS base, count(*) FILTER (k % 3 > 0) AS enhancements, count(*) FILTER (k % 7 = 3) AS withdrawn, count(*) FILTER (k % 7 <> 3) AS live, 7 * count(*) + 2 * count(DISTINCT k // {GROUP}) AS parts, count(*) AS parameters FROM {_K} GROUP BY 1",
    "query_vector_rows": "SELECT 'what is ' || vec_id || '?' AS question, row_number() OVER (ORDER BY 'what is ' || vec_id || '?') - 1 AS row, CAST(len(embedding) AS INTEGER) AS width FROM embeddings",
    "encoder_with_recordings": "SELECT CAST(vec_id AS VARCHAR) AS question, vec_id % 3 > 0 AS recorded, CAST(CASE WHEN vec_id % 3 > 0 THEN len(embedding) ELSE 1 END AS INTEGER) AS width FROM embeddings",
    "recording_report": """WITH t AS (SELECT sha256(text) AS key, conv_id, length(text) AS n FROM conversations WHERE role = 'user'), b AS (SELECT key FROM t WHERE conv_id % 3 = 0),
w AS (SELECT key, max(n) AS n FROM t WHERE conv_id % 3 > 0 GROUP BY key)
SELECT count(*) FILTER (key NOT IN (SELECT key FROM b)) AS recorded, count(*) FILTER (key IN (SELECT key FROM b)) AS skipped, CAST(5 AS BIGINT) AS orphans,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM w WHERE key NOT IN (SELECT key FROM b)) AS prompt_tokens, (SELECT 2 * count(*) FROM w WHERE key NOT IN (SELECT key FROM b)) AS completion_tokens FROM t""",
    "ranged_digest": """WITH r AS (SELECT *, doc_id // 100 AS n, row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS i FROM documents),
p AS (SELECT source, n, sha256(string_agg(i || chr(31) || doc_id || chr(31) || coalesce(lang, '') || chr(31) || n_chars || chr(30), '' ORDER BY i)) AS digest FROM r GROUP BY source, n)
SELECT source, count(*) AS ranges, sha256(string_agg(chr(31) || n || chr(31) || digest || chr(30), '' ORDER BY n)) AS digest FROM p GROUP BY source""",
    "multi_part_digest": "SELECT doc_id, sha256(doc_id || chr(30) || quality || chr(30) || toxic || chr(30)) AS digest FROM labels",
}
