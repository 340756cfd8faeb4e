"""Queries on identifiers, markers, white space, chunks and lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog, maintenance
from tessera.operators.encoders import word_count

CONTROLS = ["ac-1", "ac-2", "ac-2.3", "ia-5", "ia-5.1", "sc-28"]
PUNCTUATED = ". \u00a0 \t, x\u00a0 ;\n \n\n\n\ny"


def _cases(spark, d):
    """``k, text``: identifiers in all notations, some damaged, made of each part's key; see ``_CASES``."""
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.expr(_CASE).alias("text"))


def _known(spark, d):
    """Controls by canonical identifier: a seventh of all that the cases can name."""
    return spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 7 = 0").select(F.expr(_CANONICAL).alias("id")).distinct()


def canonical_id(spark, d):
    return _cases(spark, d).select("k", "text", T.canonical_id(F.col("text")).alias("canonical"))


def control_of_part(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ["_smt.a", "_obj", "", "_", "_a_b"])), (F.col("k") % 5 + 1).cast("int"))
    parts = _cases(spark, d).select("k", F.concat("text", tail).alias("text"))
    return parts.select("k", "text", T.control_of_part(F.col("text")).alias("control"), T.whole_part(F.col("text")).alias("suffix"))


def published_forms(spark, d):
    return _known(spark, d).select("id", F.posexplode(T.published_forms(F.col("id"))).alias("pos", "form"))


def identifier_resolve(spark, d):
    return catalog.resolve(_cases(spark, d), _known(spark, d)).select("k", "text", "canonical", "resolved")


def whitespace_normalise(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.normal_space(F.replace("text", F.lit(". "), F.lit(PUNCTUATED))).alias("text"))


def preview(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.preview(F.col("text")).alias("preview"))


def script_checksum(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.checksum(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("checksum"))


def _parameters(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    none = F.lit(None)
    n = F.col("p_partkey")
    values = F.when(n % 5 == 0, F.array(F.col("p_brand"), F.col("p_type"))).otherwise(none.cast("array<string>"))
    choices = F.when(n % 5 == 1, F.array(F.col("p_brand"), F.col("p_type"))).when(n % 25 == 2, F.array().cast("array<string>")).otherwise(none.cast("array<string>"))
    label = F.when(n % 5 == 3, F.concat(F.when(n % 2 == 0, "organization-defined ").otherwise(""), F.lower("p_name")))
    guide = F.when(n % 5 == 4, F.array(F.lit(" ;."), F.concat(F.lower("p_name"), F.lit(" ; ."))))
    shown = T.rendered_parameter(values, F.when(n % 2 == 0, "one-or-more").otherwise("one"), choices, label, guide)
    return part.select(F.concat(F.lit("p_"), n.cast("string")).alias("param"), n.alias("id"), shown.alias("rendered"))


def slot_render(spark, d):
    return _parameters(spark, d).select("id", "rendered")


def marker_resolve(spark, d):
    p = _parameters(spark, d)
    lead = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "Policy").otherwise("within (")
    tail = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, "; and").when(F.col("id") % 4 == 2, "days").otherwise(")")
    mark = F.concat(F.lit("{{ insert: param, "), F.col("param"), F.lit(" }}"))
    prose = p.select("id", F.concat(lead, F.lit(" \t"), mark, F.lit(" and "), mark, F.lit("  "), tail).alias("text"))
    return catalog.resolve_markers(prose, p.select("param", "rendered"))


def chunk_assemble(spark, d):
    return _chunks(spark, d).select("id", "chunk_id", "part_path", "text")


def _chunks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source", "lang", "text")
    title = F.concat(F.upper("source"), F.lit(" "), F.col("lang"))
    one = docs.select("id", title.alias("title"), F.lit(0).alias("pos"), F.when(F.col("id") % 4 == 3, "objective").otherwise("statement").alias("part"), F.lit("Control").alias("heading"), F.col("text").alias("prose"))
    two = docs.select("id", title.alias("title"), F.lit(1).alias("pos"), F.lit("guidance").alias("part"), F.lit("Discussion").alias("heading"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("See  "), F.col("lang"), F.lit(" ."))).alias("prose"))
    return catalog.assemble_chunks(one.unionByName(two))


def part_path_counts(spark, d):
    return _chunks(spark, d).groupBy("part_path").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first")


def length_distribution(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return maintenance.nearest_rank(docs.select("lang", "n_chars"), "lang", "n_chars", {"median": 0.5, "p90": 0.9, "p99": 0.99})


def truncation_counts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("words", word_count(F.col("text")))
    windows = docs.select("words", F.explode(F.array(*map(F.lit, (256, 512, 8192)))).alias("window"))
    return windows.groupBy("window").agg(F.count_if(F.col("words") > F.col("window")).alias("cut"), F.round(100 * F.count_if(F.col("words") > F.col("window")) / F.count("*"), 1).alias("percent"))


def token_count(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", word_count(F.col("text")).alias("tokens"))


def tree_flatten(spark, d):
    """Regions with their nations, and those with their customers' segments, as JSON trees."""
    nation, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer"))
    ordered = lambda items: F.array_sort(F.collect_list(items))
    leaves = customer.select("c_nationkey", "c_mktsegment").distinct().groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(ordered(F.struct(F.col("c_mktsegment").alias("id"))).alias("parts"))
    inner = nation.join(leaves, "n_nationkey", "left").groupBy("n_regionkey").agg(ordered(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("prose"), "parts")).alias("parts"))
    roots = spark.read.parquet(f"{d}/region.parquet").join(inner, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    node = F.to_json(F.struct(F.col("r_name").alias("id"), F.lit("").alias("prose"), "parts"))
    get = lambda p: F.expr(f"try_variant_get(node, '{p}', 'string')")
    return catalog.flatten(roots.select(F.col("r_regionkey").alias("root"), F.parse_json(node).alias("node")), "parts").select("root", "path", "depth", "parent", get("$.id").alias("id"), get("$.prose").alias("prose"))


def catalog_counts(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return catalog.catalog_counts(labels.select((F.col("doc_id") % 3 == 0).alias("is_enhancement"), (F.col("quality") == 0).alias("withdrawn")))


def count_differences(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    counts = lambda x: x.agg(F.count("*").alias("rows"), F.sum("quality").alias("good"), F.count_if(F.col("toxic") > 5).alias("none"))
    return maintenance.count_differences(counts(labels), counts(labels.filter("quality = 1")))


def class_order(spark, d):
    order = F.array(*map(F.lit, ("user", "assistant", "system")))
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter(F.col("role").isin("user", "assistant"))
    return turns.groupBy("role").agg(F.count("*").alias("n")).withColumn("place", F.array_position(order, F.col("role"))).orderBy("place")


def repeated_texts(spark, d):
    return maintenance.duplicates(spark.read.parquet(f"{d}/documents.parquet").select(F.sha2("text", 256).alias("sha256")), "sha256")


#: Family, number and enhancement of a part's key; the same words for Spark and for DuckDB.
_FAMILY, _NUMBER, _EXTRA = "substring('acausciapm', CAST(k % 5 AS INT) * 2 + 1, 2)", "CAST(k % 40 + 1 AS STRING)", "CAST(k % 3 AS STRING)"
_CANONICAL = f"{_FAMILY} || '-' || {_NUMBER} || CASE WHEN k % 3 = 0 THEN '' ELSE '.' || {_EXTRA} END".replace("k %", "p_partkey %")
#: Notations by the key's remainder: what stands between family and number, and around the enhancement. The last ones are none.
_NOTATIONS = [("-", "(", ")"), (" ", " (", ")"), ("", ".", ""), ("_", ". ", " "), (" - ", "( ", " )"), ("-0", "(0", ")"), ("-", " .", ""), ("-", "(", ""), ("--", ".", ""), ("-", "", ")")]
_CASE = "CASE k % 11 " + " ".join(f"WHEN {n} THEN {'upper' if n % 2 else ''}({_FAMILY}) || '{a}' || {_NUMBER} || CASE WHEN k % 3 = 0 THEN '' ELSE '{b}' || {_EXTRA} || '{c}' END" for n, (a, b, c) in enumerate(_NOTATIONS)) + " ELSE 'see ' || p_name END"
_CASE = _CASE.replace("k %", "p_partkey %")


def _numbers(text: str, n: int) -> str:
    return f"CAST(list_filter(regexp_split_to_array({text}, '[^0-9]+'), lambda x: x <> '')[{n}] AS INTEGER)"


#: By hand, without the pattern under test: digits only, and what is left of the text without them.
_PARTED = r"regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), ' ', '', 'g')"
CANON = rf"""CASE WHEN regexp_matches({_PARTED}, '^[a-z][a-z][-_]?#$') THEN left(lower(trim(text)), 2) || '-' || {_numbers('text', 1)}
  WHEN regexp_matches({_PARTED}, '^[a-z][a-z][-_]?#\.#$') OR regexp_matches({_PARTED}, '^[a-z][a-z][-_]?#\(#\)$') THEN left(lower(trim(text)), 2) || '-' || {_numbers('text', 1)} || '.' || {_numbers('text', 2)} END"""
_CASES = f"(SELECT p_partkey AS k, {_CASE.replace('AS STRING', 'AS VARCHAR')} AS text FROM part)"
_KNOWN = f"(SELECT DISTINCT {_CANONICAL.replace('AS STRING', 'AS VARCHAR')} AS id FROM part WHERE p_partkey % 7 = 0)"
_FORMS = """SELECT id, unnest([id, fam || '-' || num || CASE WHEN ext = '' THEN '' ELSE '(' || ext || ')' END,
  fam || '-' || lpad(num, 2, '0') || CASE WHEN ext = '' THEN '' ELSE '(' || lpad(ext, 2, '0') || ')' END,
  lower(fam) || '-' || lpad(num, 2, '0') || CASE WHEN ext = '' THEN '' ELSE '.' || lpad(ext, 2, '0') END]) AS form, unnest([0, 1, 2, 3]) AS pos
FROM (SELECT id, upper(split_part(id, '-', 1)) AS fam, regexp_extract(id, '-(\\d+)', 1) AS num, regexp_extract(id, '\\.(\\d+)$', 1) AS ext FROM """ + _KNOWN + ")"
_SPACED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' +([;,.:])', '\1', 'g'), '[ \t\r\f\x0b]+(\n|$)', '\1', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"
_PARAMS = """(SELECT p_partkey AS id, 'p_' || p_partkey AS param, CASE
  WHEN p_partkey % 5 = 0 THEN p_brand || ', ' || p_type
  WHEN p_partkey % 25 = 2 THEN '[organization-defined selection]'
  WHEN p_partkey % 5 = 1 THEN '[selection (' || CASE WHEN p_partkey % 2 = 0 THEN 'one or more' ELSE 'one' END || '): ' || p_brand || '; ' || p_type || ']'
  WHEN p_partkey % 5 IN (3, 4) THEN '[organization-defined ' || lower(p_name) || ']'
  ELSE '[organization-defined value]' END AS rendered FROM part)"""
_CHUNKS = f"""(SELECT doc_id AS id, doc_id || ':' || path AS chunk_id, path AS part_path,
  {_SPACED.format(x="upper(source) || ' ' || lang || E'\\n\\n' || body")} AS text FROM (
  SELECT *, concat_ws('+', CASE WHEN s THEN 'statement' END, CASE WHEN g THEN 'guidance' END) AS path,
    concat_ws(E'\\n\\n', CASE WHEN s THEN E'Control:\\n' || text END, CASE WHEN g THEN E'Discussion:\\nSee  ' || lang || ' .' END) AS body
  FROM (SELECT *, doc_id % 4 <> 3 AND text <> '' AS s, doc_id % 3 = 0 AS g FROM documents)) WHERE s OR g)"""

QUERIES = {f.__name__: f for f in (canonical_id, control_of_part, published_forms, identifier_resolve, whitespace_normalise, preview, script_checksum, slot_render, marker_resolve, chunk_assemble, part_path_counts, length_distribution, truncation_counts, token_count, tree_flatten, catalog_counts, count_differences, class_order, repeated_texts)}
SQL = {
    "canonical_id": f"SELECT k, text, {CANON} AS canonical FROM {_CASES}",
    "control_of_part": f"""WITH p AS (SELECT k, text || CASE k % 5 WHEN 0 THEN '_smt.a' WHEN 1 THEN '_obj' WHEN 2 THEN '' WHEN 3 THEN '_' ELSE '_a_b' END AS whole FROM {_CASES}),
c AS (SELECT k, whole, split_part(whole, '_', 1) AS text, CASE WHEN contains(whole, '_') THEN nullif(substr(whole, strpos(whole, '_') + 1), '') END AS suffix FROM p)
SELECT k, whole AS text, CASE WHEN suffix IS NOT NULL THEN {CANON} END AS control, suffix FROM c""",
    "published_forms": f"SELECT id, pos, form FROM ({_FORMS})",
    "identifier_resolve": f"""WITH f AS (SELECT DISTINCT lower(form) AS form, id FROM ({_FORMS})), a AS (SELECT k, text, {CANON} AS canonical FROM {_CASES})
SELECT k, text, canonical, coalesce(f.id, c.id) AS resolved FROM a LEFT JOIN f ON lower(trim(text)) = form LEFT JOIN {_KNOWN} c ON c.id = canonical""",
    "whitespace_normalise": "SELECT doc_id, " + _SPACED.format(x="replace(replace(text, '. ', '. ' || chr(160) || ' ' || chr(9) || ', x' || chr(160) || ' ;' || chr(10) || ' ' || repeat(chr(10), 4) || 'y'), chr(160), ' ')") + " AS text FROM documents",
    "preview": r"SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE CASE WHEN strpos(substr(x, 1, 237), ' ') = 0 THEN '...' ELSE left(x, 237 - strpos(reverse(substr(x, 1, 237)), ' ')) || ' ...' END END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)",
    "script_checksum": "SELECT item_id, sha256(text) AS checksum FROM benchmark",
    "slot_render": f"SELECT id, rendered FROM {_PARAMS}",
    "marker_resolve": f"""SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Policy ' ELSE 'within (' END || rendered || ' and ' || rendered ||
  CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '; and' WHEN 2 THEN ' days' ELSE ')' END AS resolved FROM {_PARAMS}""",
    "chunk_assemble": f"SELECT id, chunk_id, part_path, text FROM {_CHUNKS}",
    "part_path_counts": f"SELECT part_path, count(*) AS n, min(id) AS first FROM {_CHUNKS} GROUP BY part_path",
    "length_distribution": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, max(n_chars) AS largest, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.5::DOUBLE))) AS median, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.99::DOUBLE))) AS p99 FROM r GROUP BY lang""",
    "truncation_counts": r"""WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents)
SELECT w2 AS window, count(*) FILTER (words > w2) AS cut, round(100.0::DOUBLE * count(*) FILTER (words > w2) / count(*), 1) AS percent FROM w, (SELECT unnest([256, 512, 8192]) AS w2) GROUP BY w2""",
    "token_count": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM documents",
    "tree_flatten": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CAST(n_nationkey AS VARCHAR)) - 1 AS i FROM nation),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS j FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer))
SELECT r_regionkey AS root, '0' AS path, 0 AS depth, NULL AS parent, r_name AS id, '' AS prose FROM region
UNION ALL SELECT n_regionkey, '0.' || lpad(CAST(i AS VARCHAR), 9, '0'), 1, r_name, CAST(n_nationkey AS VARCHAR), n_name FROM n JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_regionkey, '0.' || lpad(CAST(i AS VARCHAR), 9, '0') || '.' || lpad(CAST(j AS VARCHAR), 9, '0'), 2, CAST(n_nationkey AS VARCHAR), c_mktsegment, NULL FROM c JOIN n ON c_nationkey = n_nationkey""",
    "catalog_counts": "SELECT count(*) FILTER (doc_id % 3 <> 0) AS base, count(*) FILTER (doc_id % 3 = 0) AS enhancements, count(*) FILTER (quality = 0) AS withdrawn, count(*) FILTER (quality <> 0) AS live FROM labels",
    "count_differences": """SELECT * FROM (SELECT 'rows' AS field, count(*) AS expected, count(*) FILTER (quality = 1) AS actual FROM labels
UNION ALL SELECT 'good', CAST(sum(quality) AS BIGINT), CAST(sum(quality) FILTER (quality = 1) AS BIGINT) FROM labels) WHERE expected <> actual""",
    "class_order": "SELECT role, count(*) AS n, CAST(CASE role WHEN 'user' THEN 1 ELSE 2 END AS BIGINT) AS place FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role",
    "repeated_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
}
