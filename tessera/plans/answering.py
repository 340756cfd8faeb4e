"""Queries on answers, recordings and upkeep of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import text as T
from tessera.operators import answering, answers, encoders, maintenance, search
from tessera.plans.texts import CANON, CONTROLS

#: Synthetic answers: a turn's text with citations around it, by turn number.
_CITES = ["[AC-2] says so, and [ ia-5 ] too; [ac-02] again [not one].", "See [SC-28] and [ZZ-9] ([AC-2(3)]).", "No citation, but [brackets] and [AC-1]."]
INSTRUCTIONS = "Answer from the excerpts and cite each control in square brackets."


def _answers(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    added = F.element_at(F.array(*map(F.lit, _CITES)), (F.col("conv_id") % 3 + 1).cast("int"))
    return t.select(key.alias("id"), "conv_id", F.concat("text", F.lit("\n"), added, F.lit("\n")).alias("answer"))


def _checked(spark, d):
    a = _answers(spark, d)
    known = spark.createDataFrame([(x,) for x in CONTROLS], "id string")
    got = a.select("id", F.explode(F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("ac-2"), F.lit("ia-5"))).otherwise(F.array(F.lit("ac-2.3")))).alias("canonical"))
    return answers.check_citations(answers.parse_citations(a, "id"), known, got, "id")


def citation_parse(spark, d):
    return answers.parse_citations(_answers(spark, d), "id")


def citation_check(spark, d):
    return _checked(spark, d).select("id", "pos", "cited_as", "canonical", "exists_flag", "retrieved_flag", "valid", "reason")


def citation_counts(spark, d):
    return _checked(spark, d).groupBy("id").agg(F.count("*").alias("total"), F.count_if(~F.col("valid")).alias("invalid"))


def answer_segments(spark, d):
    a = _answers(spark, d)
    return answers.answer_segments(a, answers.parse_citations(a, "id"), "id")


def answer_lines(spark, d):
    a = _answers(spark, d).withColumn("lines", T.answer_lines(F.col("answer")))
    return a.select("id", F.size("lines").alias("n"), (T.answer_of(F.col("lines")) == F.col("answer")).alias("same"))


def _retrieved(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("label"), "text")
    found = search.batch_top_k(v, queries, 3).join(docs, "vec_id")
    return found.withColumn("question", F.concat(F.lit("what about "), F.col("q_id").cast("string"), F.lit("?")))


def prompt_render(spark, d):
    return answers.render_prompts(_retrieved(spark, d), INSTRUCTIONS)


def _questions(spark, d):
    """Every user turn, and whether the assistant replied to it."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    replies = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(replies, ["conv_id", "turn"], "left").withColumn("id", key)


def _keys(spark, d):
    key = answers.request_key({"purpose": F.lit("answer"), "model": F.lit("m-1"), "prompt": F.col("question")})
    return _questions(spark, d).select("id", "turn", "question", "reply", key.alias("key"))


def request_key(spark, d):
    return _keys(spark, d).select("id", "key")


def _sampling():
    """Numbers, a list, a null and an object within, by turn."""
    turn = F.col("turn")
    penalty = F.struct((turn * 1.5).cast("double").alias("presence"), F.when(turn % 2 == 0, 0.1).alias("frequency"))
    return F.struct(((turn % 10) / F.lit(10.0)).cast("double").alias("temperature"), (256 * (turn + 1)).cast("long").alias("max_tokens"), F.array(F.lit("\n"), F.lit("é")).alias("stop"), F.lit(None).cast("long").alias("seed"), (turn % 2 == 0).alias("stream"), penalty.alias("penalty"))


def whole_request_key(spark, d):
    """Keys of whole requests: fields, numbers and lists, nested."""
    fields = {"purpose": F.lit("answer"), "model": F.lit("m-1"), "model_version": F.lit("2"), "prompt": F.col("question"), "sampling": _sampling()}
    return _questions(spark, d).select("id", answers.whole_request_key(fields).alias("key"))


def answer_batch(spark, d):
    """Every user turn answered from the benchmark's items: retrieved, prompted, keyed as a whole, replayed and checked."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("chunk_id"), F.concat(F.lit("ac-"), (F.col("item_id") % 9 + 1).cast("string")).alias("control_id"), "text")
    corpus = items.withColumn("label", F.upper("control_id")).withColumn("embedding", encoders.keyword_axes(F.col("text"), _AXES))
    turns = _questions(spark, d)
    asked = answering.requests(turns.select(F.col("id").alias("q_id"), "question"), corpus, lambda q: q.withColumn("q", encoders.keyword_axes(F.col("question"), _AXES)), answering.Model("m-1", "2", F.struct(F.lit(0.5).alias("temperature"))), "answer", INSTRUCTIONS, 3, lambda p: p.withColumn("tokens", encoders.word_count(F.col("prompt"))))
    said = turns.filter("reply is not null").select(F.col("id").alias("q_id"), F.concat(F.lit("See [AC-"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("] and [AC-99].")).alias("said"))
    recordings = asked.join(said, "q_id").groupBy("key").agg(F.min("said").alias("said")).select("key", T.answer_lines(F.col("said")).alias("answer_lines"))
    controls = spark.createDataFrame([(f"ac-{n}",) for n in range(1, 10)], "id string")
    out = answering.answer_all(asked, recordings, controls)
    return out.select("q_id", "key", "control_ids", F.col("counted_prompt_tokens").alias("tokens"), "answered", "decline", "n_citations", "invalid", F.transform("citations", lambda c: c["reason"]).alias("reasons"))


def _recordings(spark, d):
    """The assistant's replies as recordings of the questions."""
    k = _keys(spark, d).filter("reply is not null").groupBy("key").agg(F.min("reply").alias("answer"))
    return k.select("key", T.answer_lines(F.col("answer")).alias("answer_lines"))


def replay_or_decline(spark, d):
    return answers.replay(_keys(spark, d), _recordings(spark, d)).select("id", "answered", "answer", "decline")


def recorded_vector_lookup(spark, d):
    q = _questions(spark, d)
    recorded = q.filter("reply is not null").select("question", F.lit(True).alias("recorded")).distinct()
    return q.join(recorded, "question", "left").select("id", F.coalesce("recorded", F.lit(False)).alias("recorded"))


def orphans(spark, d):
    """Recordings of questions that open no conversation."""
    return _recordings(spark, d).join(_keys(spark, d).filter("turn = 0"), "key", "left_anti").select("key").orderBy("key")


def skip_recorded(spark, d):
    k = _keys(spark, d)
    done = _recordings(spark, d)
    to = k.join(done, "key", "left_anti").agg(F.lit("record").alias("what"), F.count("*").alias("n"))
    return to.unionByName(k.join(done, "key", "left_semi").agg(F.lit("skip").alias("what"), F.count("*").alias("n")))


def same_questions(spark, d):
    q = _questions(spark, d)
    k, held = q.select("question").distinct(), q.filter("reply is not null").select("question").distinct()
    missing, extra = k.join(held, "question", "left_anti"), held.join(k, "question", "left_anti")
    return missing.agg(F.count("*").alias("missing")).crossJoin(extra.agg(F.count("*").alias("extra"))).select("missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("same"))


def upsert_merge(spark, d):
    """All documents over a corpus of the labelled ones."""
    old = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit("2024-01-01").cast("timestamp").alias("created"))
    new = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    return maintenance.upsert(old, new, "doc_id", "created", F.lit("2025-01-01").cast("timestamp")).select("doc_id", "n_chars", "created")


def stale_delete(spark, d):
    """What goes from a corpus of all documents when the labelled ones are all that is left."""
    return maintenance.stale(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id")


def provenance_check(spark, d):
    """Each part as what a corpus says of itself; the first check that fails."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(k % 2 == 0, "m").otherwise(F.col("p_name")).alias("name"), F.when(k % 3 > 0, "r1").alias("revision"), F.col("p_size").alias("dimensions"), F.col("p_type").alias("chunker"))
    checks = [("name", F.col("name") == "m"), ("revision", F.col("revision") == "r1"), ("dimensions", F.col("dimensions") > 25), ("chunker", F.col("chunker") != "SMALL")]
    return rows.select("p_partkey", maintenance.first_failure(checks).alias("failure"))


def manifest_compare(spark, d):
    """Each part as an entry and as what is observed of it, changed by its key."""
    k, name = F.col("p_partkey"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("name")
    part = spark.read.parquet(f"{d}/part.parquet")
    kinds = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    entries = part.select(name, F.col("p_brand").alias("identity"), F.when(k % 4 > 0, F.sha2("p_type", 256)).alias("digest"), kinds.alias("invalidates"))
    seen = part.select(name, F.when(k % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("identity"), F.when(k % 7 > 0, F.sha2(F.when(k % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")), 256)).alias("digest"))
    return maintenance.compare_manifest(entries, seen)


def ledger_drift(spark, d):
    """Parts as scripts and as a ledger of what was applied."""
    part = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_partkey", "version")
    scripts = part.filter("version % 5 > 0").select("version", F.sha2("p_name", 256).alias("checksum"))
    ledger = part.filter("version % 3 > 0").select("version", F.sha2(F.when(F.col("version") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("checksum"))
    return maintenance.ledger_drift(scripts, ledger)


def schema_health(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("version"))
    return maintenance.schema_health(part, 7)


def ordered_digest(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return maintenance.ordered_digest(docs.select("source", "doc_id", "lang", "n_chars"), ["doc_id"], ["doc_id", "lang", "n_chars"], "source")


def file_hash(spark, d):
    """The files of the pages table, each whole."""
    return sources.file_digests(spark, f"{d}/pages.parquet").select("size", "sha256")


#: What an entry invalidates, by its key.
_KINDS = [[], ["corpus", "queries"], ["counts"], ["judge", "counts"], ["generation"], ["queries", "generation", "judge"]]
_AXES = ["the", "der", "que"]


def answer_end_to_end(spark, d):
    """Encode, search, render, key, replay, check, for the user turns of every twentieth conversation, against all documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("AC-"), (F.col("doc_id") % 9 + 1).cast("string")).alias("label"), "text")
    corpus = docs.withColumn("embedding", encoders.keyword_axes(F.col("text"), _AXES))
    asked = _questions(spark, d).filter("conv_id % 20 = 0").select(F.col("id").alias("q_id"), "conv_id", "question", F.col("reply").isNotNull().alias("answered"))
    vectors = asked.withColumn("q", encoders.keyword_axes(F.col("question"), _AXES))
    found = search.batch_top_k(corpus, vectors, 2, key="doc_id").join(docs, "doc_id").join(asked, "q_id")
    prompts = answers.render_prompts(found, INSTRUCTIONS).withColumn("key", F.sha2("prompt", 256))
    said = prompts.join(asked.select("q_id", "conv_id", "answered"), "q_id").withColumn("answer", F.when(F.col("answered"), F.concat(F.lit("See [AC-"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("] and [AC-99]."))))
    cited = answers.parse_citations(said.filter("answered"), "q_id")
    known = spark.createDataFrame([(f"ac-{n}",) for n in range(1, 10)], "id string")
    checked = answers.check_citations(cited, known, found.select("q_id", T.canonical_id(F.col("label")).alias("canonical")), "q_id")
    counted = checked.groupBy("q_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("valid"))
    return said.join(counted, "q_id", "left").select("q_id", "key", "answered", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("valid", F.lit(0)).alias("valid"))


_ANSWERS = "(SELECT conv_id || '/' || turn AS id, conv_id, text || chr(10) || CASE conv_id % 3 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(_CITES)) + " END || chr(10) AS answer FROM conversations WHERE role = 'assistant')"
#: Brackets cut out and named by digits and letters alone, without the pattern under test.
_PARSED = f"""(SELECT id, conv_id, CAST(row_number() OVER (PARTITION BY id ORDER BY nr) - 1 AS INTEGER) AS pos, text AS cited_as, canonical FROM (
  SELECT *, row_number() OVER (PARTITION BY id, canonical ORDER BY nr) AS nth FROM (
    SELECT id, conv_id, nr, text, {CANON} AS canonical FROM (
      SELECT id, conv_id, unnest(list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda x: trim(x))) AS text, unnest(range(len(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1)))) AS nr FROM {_ANSWERS} a))
  WHERE canonical IS NOT NULL) WHERE nth = 1)"""
_CHECKED = f"""(SELECT id, pos, cited_as, canonical, canonical IN ({', '.join(f"'{c}'" for c in CONTROLS)}) AS exists_flag,
  CASE WHEN conv_id % 2 = 0 THEN canonical IN ('ac-2', 'ia-5') ELSE canonical = 'ac-2.3' END AS retrieved_flag FROM {_PARSED})"""
_Q = "(SELECT q.conv_id || '/' || q.turn AS id, q.conv_id, q.turn, q.text AS question, r.text AS reply FROM conversations q LEFT JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant' WHERE q.role = 'user')"
_JSON = """'"' || array_to_string(list_transform(regexp_extract_all(replace(replace(question, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '[ -~]+|[^ -~]'), lambda c: CASE WHEN regexp_matches(c, '^[ -~]') THEN c
  WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(13) THEN chr(92) || 'r' WHEN c = chr(9) THEN chr(92) || 't' WHEN c = chr(8) THEN chr(92) || 'b' WHEN c = chr(12) THEN chr(92) || 'f'
  WHEN unicode(c) < 65536 THEN chr(92) || printf('u%04x', unicode(c)) ELSE chr(92) || printf('u%04x', 55296 + (unicode(c) - 65536) // 1024) || chr(92) || printf('u%04x', 56320 + (unicode(c) - 65536) % 1024) END), '') || '"'"""
_KEYS = f"""(SELECT id, turn, question, reply, sha256('{{"model":"m-1","prompt":' || {_JSON} || ',"purpose":"answer"}}') AS key FROM {_Q})"""
_TOP = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS q_id, e AS q FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q_id, vec_id, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS d FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS rank FROM s)
"""


def _axes(x: str) -> str:
    hits = [f"CAST(contains(lower({x}), '{w}') AS INTEGER)" for w in _AXES]
    return f"CASE WHEN {' + '.join(hits)} = 0 THEN [1 / sqrt(3), 1 / sqrt(3), 1 / sqrt(3)] ELSE [{', '.join(f'{h} / sqrt({" + ".join(hits)})' for h in hits)}] END"


QUERIES = {f.__name__: f for f in (citation_parse, citation_check, citation_counts, answer_segments, answer_lines, prompt_render, request_key, whole_request_key, answer_batch, replay_or_decline, recorded_vector_lookup, orphans, skip_recorded, same_questions, upsert_merge, stale_delete, provenance_check, manifest_compare, ledger_drift, schema_health, ordered_digest, file_hash, answer_end_to_end)}
SQL = {
    "citation_parse": f"SELECT id, pos, cited_as, canonical FROM {_PARSED}",
    "citation_check": f"SELECT *, exists_flag AND retrieved_flag AS valid, CASE WHEN exists_flag AND retrieved_flag THEN NULL WHEN NOT exists_flag THEN 'not a control in the catalog' ELSE 'cited but not retrieved' END AS reason FROM {_CHECKED}",
    "citation_counts": f"SELECT id, count(*) AS total, count(*) FILTER (NOT (exists_flag AND retrieved_flag)) AS invalid FROM {_CHECKED} GROUP BY id",
    "answer_segments": f"""WITH c AS (SELECT id, list(cited_as) AS cited FROM {_PARSED} GROUP BY id),
a AS (SELECT id, regexp_split_to_array(answer, '\\[[^\\[\\]]+\\]') AS lit, regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1) AS inn, coalesce(cited, []) AS cited FROM {_ANSWERS} x LEFT JOIN c USING (id)),
s AS (SELECT id, string_split(array_to_string(list_transform(range(1, len(lit) + 1), lambda i: lit[i] || CASE WHEN i > len(inn) THEN '' WHEN list_contains(cited, inn[i]) THEN chr(1) || chr(2) || inn[i] || chr(1) ELSE '[' || inn[i] || ']' END), ''), chr(1)) AS runs FROM a),
r AS (SELECT id, unnest(list_filter(runs, lambda x: x <> '')) AS run, unnest(range(len(list_filter(runs, lambda x: x <> '')))) AS pos FROM s)
SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN run[1] = chr(2) THEN 'citation' ELSE 'text' END AS kind, CASE WHEN run[1] = chr(2) THEN substr(run, 2) ELSE run END AS text FROM r""",
    "answer_lines": f"SELECT id, CAST(len(answer) - len(replace(answer, chr(10), '')) + 1 AS INTEGER) AS n, array_to_string(string_split(answer, chr(10)), chr(10)) = answer AS same FROM {_ANSWERS}",
    "prompt_render": _TOP + f"""SELECT q_id, '{INSTRUCTIONS}' || E'\\n\\n' || string_agg('[D-' || vec_id || E']\\n' || text, E'\\n\\n' ORDER BY rank) || E'\\n\\nQuestion: what about ' || q_id || '?' AS prompt
FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY q_id""",
    "request_key": f"SELECT id, key FROM {_KEYS}",
    "whole_request_key": f"""SELECT id, sha256('{{"model":"m-1","model_version":"2","prompt":' || {_JSON} || ',"purpose":"answer","sampling":{{"max_tokens":' || 256 * (turn + 1) || ',"penalty":{{"frequency":' || CASE WHEN turn % 2 = 0 THEN '0.1' ELSE 'null' END
  || ',"presence":' || CAST(turn * 1.5 AS DOUBLE) || '}},"seed":null,"stop":["' || chr(92) || 'n","' || chr(92) || 'u00e9"],"stream":' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ',"temperature":' || CAST((turn % 10) / 10.0 AS DOUBLE) || '}}}}') AS key FROM {_Q}""",
    "answer_batch": f"""WITH corpus AS (SELECT item_id, 'ac-' || (item_id % 9 + 1) AS control_id, text, {_axes('text')} AS e FROM benchmark), asked AS (SELECT id AS q_id, conv_id, question, reply IS NOT NULL AS replied, {_axes('question')} AS q FROM {_Q}),
s AS (SELECT q_id, item_id, control_id, text, 1 - (e[1]*q[1] + e[2]*q[2] + e[3]*q[3]) / (sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3]) * sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3])) AS d FROM corpus, asked),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, item_id) AS rank FROM s),
p AS (SELECT q_id, '{INSTRUCTIONS}' || E'\n\n' || string_agg('[' || upper(control_id) || E']\n' || text, E'\n\n' ORDER BY rank) AS head, list(control_id ORDER BY rank) AS control_ids FROM r WHERE rank <= 3 GROUP BY q_id),
f AS (SELECT q_id, conv_id, replied, head || E'\n\nQuestion: ' || question AS question, control_ids FROM p JOIN asked USING (q_id)),
k AS (SELECT *, sha256('{{"model":"m-1","model_version":"2","prompt":' || {_JSON} || ',"purpose":"answer","sampling":{{"temperature":0.5}}}}') AS key FROM f),
a AS (SELECT key, min(conv_id % 9 + 1) AS n FROM k WHERE replied GROUP BY key)
SELECT q_id, key, control_ids, CAST(len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS INTEGER) AS tokens, n IS NOT NULL AS answered, CASE WHEN n IS NULL THEN 'no recorded answer' END AS decline, CASE WHEN n IS NULL THEN 0 ELSE 2 END AS n_citations,
  CAST(CASE WHEN n IS NULL THEN 0 WHEN list_contains(control_ids, 'ac-' || n) THEN 1 ELSE 2 END AS BIGINT) AS invalid, CASE WHEN n IS NULL THEN []::VARCHAR[] ELSE [CASE WHEN list_contains(control_ids, 'ac-' || n) THEN NULL ELSE 'cited but not retrieved' END, 'not a control in the catalog'] END AS reasons FROM k LEFT JOIN a USING (key)""",
    "replay_or_decline": f"""WITH k AS (SELECT * FROM {_KEYS}), r AS (SELECT key, min(reply) AS said FROM k WHERE reply IS NOT NULL GROUP BY key)
SELECT id, r.key IS NOT NULL AS answered, said AS answer, CASE WHEN r.key IS NULL THEN 'no recorded answer' END AS decline FROM k LEFT JOIN r USING (key)""",
    "recorded_vector_lookup": f"WITH k AS (SELECT * FROM {_Q}) SELECT id, question IN (SELECT question FROM k WHERE reply IS NOT NULL) AS recorded FROM k",
    "orphans": f"WITH k AS (SELECT * FROM {_KEYS}) SELECT DISTINCT key FROM k WHERE reply IS NOT NULL AND key NOT IN (SELECT key FROM k WHERE turn = 0)",
    "skip_recorded": f"""WITH k AS (SELECT * FROM {_KEYS}), r AS (SELECT DISTINCT key FROM k WHERE reply IS NOT NULL)
SELECT 'record' AS what, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT 'skip', count(*) FROM k WHERE key IN (SELECT key FROM r)""",
    "same_questions": f"WITH k AS (SELECT * FROM {_Q}) SELECT *, missing = 0 AND extra = 0 AS same FROM (SELECT count(DISTINCT question) AS missing, CAST(0 AS BIGINT) AS extra FROM k WHERE question NOT IN (SELECT question FROM k WHERE reply IS NOT NULL))",
    "upsert_merge": "SELECT doc_id, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2025-01-01' END AS created FROM documents",
    "stale_delete": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "provenance_check": "SELECT p_partkey, CASE WHEN p_partkey % 2 > 0 AND p_name <> 'm' THEN 'name' WHEN p_partkey % 3 = 0 THEN 'revision' WHEN p_size <= 25 THEN 'dimensions' WHEN p_type = 'SMALL' THEN 'chunker' END AS failure FROM part",
    "manifest_compare": f"""WITH e AS (SELECT p_partkey AS k, p_brand AS identity, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS made, CASE p_partkey % {len(_KINDS)} {" ".join(f"WHEN {n} THEN {x}::VARCHAR[]" for n, x in enumerate(_KINDS))} END AS kinds,
  CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS seen, CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END END AS now FROM part)
SELECT * FROM (SELECT 'e' || k AS name, CASE WHEN made IS NULL AND now IS NOT NULL THEN 'appeared' WHEN made IS NOT NULL AND now IS NULL THEN 'gone' WHEN identity <> seen THEN 'identity' WHEN made <> now THEN 'digest' END AS state,
  CAST(CASE WHEN list_contains(kinds, 'corpus') THEN 0 WHEN list_contains(kinds, 'queries') THEN 1 WHEN list_contains(kinds, 'generation') THEN 2 WHEN list_contains(kinds, 'judge') THEN 3 WHEN list_contains(kinds, 'counts') THEN 4 ELSE 5 END AS INTEGER) AS rank, CAST(len(kinds) AS INTEGER) AS kinds FROM e) WHERE state IS NOT NULL""",
    "ledger_drift": "SELECT * FROM (SELECT p_partkey AS version, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 = 0 THEN 'pending' WHEN p_partkey % 5 = 0 AND p_partkey % 3 > 0 THEN 'ahead' WHEN p_partkey % 5 > 0 AND p_partkey % 7 = 0 AND p_name <> p_type THEN 'changed' END AS state FROM part) WHERE state IS NOT NULL",
    "schema_health": "SELECT max(p_partkey) = 7 AS healthy, 7 AS expected, max(p_partkey) AS applied FROM part",
    "ordered_digest": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT source, sha256(string_agg(i || chr(31) || doc_id || chr(31) || coalesce(lang, '') || chr(31) || n_chars || chr(30), '' ORDER BY i)) AS digest FROM r GROUP BY source",
    "answer_end_to_end": f"""WITH docs AS (SELECT doc_id, 'AC-' || (doc_id % 9 + 1) AS label, text FROM documents), corpus AS (SELECT *, {_axes('text')} AS e FROM docs),
asked AS (SELECT id AS q_id, conv_id, question, reply IS NOT NULL AS answered FROM {_Q} WHERE conv_id % 20 = 0), qs AS (SELECT *, {_axes('question')} AS q FROM asked),
s AS (SELECT q_id, conv_id, answered, question, doc_id, label, text, 1 - (e[1]*q[1] + e[2]*q[2] + e[3]*q[3]) / (sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3]) * sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3])) AS d FROM corpus, qs),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, doc_id) AS rank FROM s),
p AS (SELECT q_id, any_value(conv_id) AS conv_id, any_value(answered) AS answered, sha256('{INSTRUCTIONS}' || E'\\n\\n' || string_agg('[' || label || E']\\n' || text, E'\\n\\n' ORDER BY rank) || E'\\n\\nQuestion: ' || any_value(question)) AS key, list(label) AS labels FROM r WHERE rank <= 2 GROUP BY q_id)
SELECT q_id, key, answered, CAST(CASE WHEN answered THEN 2 ELSE 0 END AS BIGINT) AS citations, CAST(CASE WHEN answered AND list_contains(labels, 'AC-' || (conv_id % 9 + 1)) THEN 1 ELSE 0 END AS BIGINT) AS valid FROM p""",
}
