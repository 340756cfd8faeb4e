"""Recorded calls, recorded query vectors and question lists: read with their refusals, written, used with an encoder for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import answer_lines
from tessera.operators.maintenance import current, publish, unique
from tessera.sources.npy import read_npy, write_npy
from tessera.storage import forget, place_of, saved

RECORDING = "key string, purpose string, question string, control_ids array<string>, model string, model_version string, recorded_on date, usage_prompt_tokens int, usage_completion_tokens int, counted_prompt_tokens int, answer_lines array<string>"


def refused(ok: Column, value: Column, *message: Column | str) -> Column:
    """The value, or an error where it isn't ok."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat_ws(" ", *(F.lit(m) if isinstance(m, str) else m for m in message))))


def read_recordings(spark: SparkSession, folder: str, purpose: str | None = None) -> DataFrame:
    """Recordings of a folder of JSON files, one each, named by their key.

    Text that isn't such a document fails the query, and so do a file whose name isn't its key, a field that is absent or
    unknown, and a purpose other than ``purpose``.
    """
    names = [x.split()[0] for x in RECORDING.split(", ")]
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    keys = F.json_object_keys("value")
    exact = keys.isNotNull() & (F.size(F.array_except(keys, F.lit(names))) == 0) & (F.size(F.array_except(F.lit(names), keys)) == 0)
    parsed = raw.select("file", F.from_json(refused(exact, F.col("value"), "not a recording:", F.col("file")), RECORDING, {"mode": "FAILFAST"}).alias("r")).select("file", "r.*")
    key = refused(F.concat(F.col("key"), F.lit(".json")) == F.col("file"), F.col("key"), "filed under another name:", F.col("file"))
    out = parsed.withColumn("key", key)
    if purpose is not None:
        out = out.withColumn("purpose", refused(F.col("purpose") == purpose, F.col("purpose"), "of another purpose:", F.col("file")))
    return out.select(*names)


def write_recordings(calls: DataFrame, folder: str) -> None:
    """Add recordings, as a partitioned table of JSON lines by purpose; a key that stands twice, or is stored already, fails before
    anything is written. (``answering.record_generations`` has a table that can be written to again.)"""
    rows = unique(calls, "key", what="a key twice")
    fs, place = place_of(calls.sparkSession, folder)
    if fs.exists(place) and (again := rows.join(recorded_calls(calls.sparkSession, folder).select("key"), "key", "left_semi").first()):
        raise ValueError(f"recorded already: {again['key']}")
    rows.write.mode("append").partitionBy("purpose").option("compression", "none").json(folder)


def recorded_calls(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_recordings`` wrote."""
    return spark.read.schema(RECORDING).option("mode", "FAILFAST").json(folder)


def read_questions(document: DataFrame, classes: list[str]) -> DataFrame:
    """``id, class, text, because`` of a question list ``document`` (VARIANT); an id or a text that stands twice, a class that
    isn't known and a field that is absent fail the query. Comments are left out."""
    listed = document.select(F.explode(F.expr("try_variant_get(document, '$.questions', 'array<variant>')")).alias("q"))
    get = lambda p: F.expr(f"try_variant_get(q, '$.{p}', 'string')")
    rows = listed.select(*(refused(get(p) != "", get(p), f"a question without {p}").alias(p) for p in ("id", "class", "text", "because")))
    rows = rows.withColumn("class", refused(F.col("class").isin(classes), F.col("class"), "no such class:", F.col("class")))
    return unique(unique(rows, "id", what="an id twice"), "text", what="a question twice")


def questions_of(questions: DataFrame, kind: str) -> DataFrame:
    return questions.filter(F.col("class") == kind)


def retrieved_ids(ranked: DataFrame, key: str = "q_id", of: str = "control_id") -> DataFrame:
    """``key, ids``: what each query retrieved, in rank order, repeats kept."""
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", of))), lambda x: x[of]).alias("ids"))


def query_vectors(questions: DataFrame, width: int, question: str = "question", vector: str = "embedding") -> DataFrame:
    """``question, row, embedding array<float>``: vectors numbered by their sorted questions, from 0. A question that stands
    twice, a null one or vector, and another width fail the query.

    Numbers come from counts of sorted ranges, so no task sorts all questions.
    """
    rows = unique(questions.select(F.col(question).alias("question"), F.col(vector).cast("array<float>").alias("embedding")), "question", what="a question twice")
    right = F.col("question").isNotNull() & (F.size("embedding") == width)
    checked = rows.withColumn("embedding", refused(right, F.col("embedding"), "no vector of the width for:", F.coalesce("question", F.lit("null"))))
    bucket = F.substring(F.hex(F.encode("question", "utf-8")), 1, 4)  # ranges by the first two bytes
    dealt = checked.withColumn("__b", bucket)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    starts = dealt.groupBy("__b").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("__b", "start")
    nth = F.row_number().over(Window.partitionBy("__b").orderBy("question")) - 1
    return dealt.withColumn("nth", nth).join(starts, "__b").select("question", (F.col("start") + F.col("nth")).cast("long").alias("row"), "embedding")


def checked_query_vectors(stored: DataFrame, index: dict[str, object], name: str, revision: str, width: int) -> DataFrame:
    """Stored ``question, row, embedding`` as they are, if the index says that this model made them (``embedder_name,
    embedder_revision, dimensions``), all vectors have its width, rows run from 0 without gaps and no question stands twice."""
    for field, want in (("embedder_name", name), ("embedder_revision", revision), ("dimensions", width)):
        if index.get(field) != want:
            raise ValueError(f"recorded with {field} {index.get(field)!r}, not {want!r}")
    if stored.schema["embedding"].dataType.simpleString() != "array<float>":
        raise ValueError("vectors that aren't float32")
    rows = unique(unique(stored, "question", what="a question twice"), "row", what="a row twice")
    n = rows.agg(F.count("*").alias("__n"), F.max("row").alias("__last"), F.min("row").alias("__first"))
    both = rows.crossJoin(F.broadcast(n))  # one row
    whole = (F.col("__first") == 0) & (F.col("__last") == F.col("__n") - 1)
    return both.withColumn("row", refused(whole, F.col("row"), "rows with gaps")).withColumn("embedding", refused(F.size("embedding") == width, F.col("embedding"), "another width for:", F.col("question"))).select("question", "row", "embedding")


def encoded(questions: DataFrame, recorded: DataFrame, encode, question: str = "question") -> DataFrame:
    """``questions`` with ``embedding, recorded``: the recorded vector of exactly this text, else what ``encode(df)``, which adds
    ``embedding``, makes of the rest."""
    held = unique(recorded, "question", what="a question twice").select(F.col("question").alias(question), "embedding")
    known = questions.join(held, question).withColumn("recorded", F.lit(True))
    rest = encode(questions.join(held, question, "left_anti")).withColumn("recorded", F.lit(False))
    return known.unionByName(rest.withColumn("embedding", F.col("embedding").cast("array<float>")))


def vectors_are_recorded(questions: DataFrame, stored: DataFrame, question: str = "question") -> bool:
    """Whether exactly these questions are recorded, so that recording again would change nothing."""
    mine, theirs = questions.select(F.col(question).alias("question")), stored.select("question")
    return mine.join(theirs, "question", "left_anti").isEmpty() and theirs.join(mine, "question", "left_anti").isEmpty()


def record_query_vectors(questions: DataFrame, encode, root: str, index: dict[str, object], question: str = "question", force: bool = False) -> bool:
    """Encode and publish the vectors of all questions under ``root``, with the index in the rows; returns whether it did.

    Nothing is done where exactly these questions are recorded by the model that ``index`` names, unless ``force``.
    """
    spark = questions.sparkSession
    named = ("embedder_name", "embedder_revision", "dimensions")
    try:
        old = current(spark, root)
        first = old.select(*named).first()
        if not force and first is not None and all(first[c] == index[c] for c in named) and vectors_are_recorded(questions, old, question):
            return False
    except Exception as missing:  # nothing has been recorded
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    made = query_vectors(encode(questions.select(question)), int(index["dimensions"]), question)
    publish(made.select("*", *(F.lit(index[c]).alias(c) for c in named)), root)
    return True


def write_query_store(questions: DataFrame, folder: str, index: dict[str, object], question: str = "question", vector: str = "embedding") -> None:
    """Write vectors by question as a matrix (``vectors.npy``, a folder of shards) and an index of which row is whose.

    Rows follow the sorted questions. Refused: a question twice, a null one or vector, another width than ``index["dimensions"]``.
    """
    rows = saved(query_vectors(questions, int(index["dimensions"]), question, vector))
    folder = folder.rstrip("/")
    write_npy(rows.select("row", F.col("embedding").alias("vector")), f"{folder}/vectors.npy", int(index["dimensions"]))
    facts = [F.lit(index[c]).alias(c) for c in ("embedder_name", "embedder_revision", "dimensions")]
    rows.select(*facts, "question", "row").write.json(f"{folder}/index")
    forget(rows)


def read_query_store(spark: SparkSession, folder: str, name: str, revision: str, width: int) -> DataFrame:
    """``question, row, embedding`` of a folder with ``vectors.npy``, a file or shards, and its index: ``index.json``, one document with a
    list of ``queries``, or ``index``, a table of JSON lines.

    Refused: no vectors or no index; an index that isn't one; vectors of a model of another name or revision or of other
    dimensions; an array that can't be read, that isn't float32, or of another shape than the index says; rows that aren't
    each one question's; a question twice.
    """
    folder = folder.rstrip("/")
    one, many = (place_of(spark, f"{folder}/{x}") for x in ("index.json", "index"))
    facts = ("embedder_name", "embedder_revision", "dimensions")
    if one[0].exists(one[1]):
        document = spark.read.text(f"{folder}/index.json", wholetext=True).select(F.try_parse_json("value").alias("d"))
        get = lambda of, path, kind: F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")
        head = [get("d", c, "string" if c != "dimensions" else "int").alias(c) for c in facts]
        rows = document.select(*head, F.explode_outer(get("d", "queries", "array<variant>")).alias("q")).select(*facts, get("q", "question", "string").alias("question"), get("q", "row", "long").alias("row"))
    elif many[0].exists(many[1]):
        rows = spark.read.schema("embedder_name string, embedder_revision string, dimensions int, question string, row long").json(f"{folder}/index")
    else:
        raise ValueError(f"no recorded query vectors in {folder}")
    broken = rows.filter(" or ".join(f"{c} is null" for c in (*facts, "question", "row"))).first()
    if broken is not None or (first := rows.select(*facts).first()) is None:
        raise ValueError(f"{folder}: not an index of query vectors")
    stored = read_npy(spark, f"{folder}/vectors.npy").select("row", F.col("vector").alias("embedding"))
    sizes = stored.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if (n := rows.count()) != sizes["n"] or (n and sizes["width"] != first["dimensions"]):
        raise ValueError(f"{folder}: an array of {sizes['n']} by {sizes['width']}, and an index of {n} by {first['dimensions']}")
    both = rows.select("question", "row").join(stored, "row", "left").select("question", "row", "embedding")
    return checked_query_vectors(both, first.asDict(), name, revision, width)


def recording_report(requests: DataFrame, recordings: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """``recorded, skipped, orphans, prompt_tokens, completion_tokens``, in one row.

    ``requests(id, key)`` are all that are wanted, ``recordings(key)`` what was there before, ``done(key, usage_prompt_tokens,
    usage_completion_tokens)`` the new ones. Without ``force`` recorded keys are skipped; orphans are keys that no request has.
    """
    was = recordings.select("key").distinct()
    wanted = requests.select("id", "key")
    skipped = wanted.join(was, "key", "left_semi") if not force else wanted.limit(0)
    new = wanted.join(skipped.select("key").distinct(), "key", "left_anti")
    orphans = was.join(wanted, "key", "left_anti")
    tokens = done.join(new.select("key").distinct(), "key", "left_semi").agg(F.coalesce(F.sum("usage_prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("usage_completion_tokens"), F.lit(0)).alias("completion_tokens"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(new, "recorded").crossJoin(count(skipped, "skipped")).crossJoin(count(orphans, "orphans")).crossJoin(tokens)  # rows of one


def to_record(requests: DataFrame, recordings: DataFrame, force: bool = False) -> DataFrame:
    """The requests that are to be recorded: all with ``force``, else those without a recording."""
    return requests if force else requests.join(recordings.select("key").distinct(), "key", "left_anti")


#: Names that a log line has itself: fixed names.
RESERVED = ("at", "level", "message", "error", "stack")


def log_lines(events: DataFrame, now: Column, message: Column, level: Column | None = None, error: Column | None = None, stack: Column | None = None) -> DataFrame:
    """Rows for ``write_json_lines``: ``at`` (ISO time in UTC), ``level, message``, the columns of ``events``, and ``error, stack`` where there is
    one. A column with a name that a line has itself moves to ``field_<name>``, so that nothing is lost or overwritten."""
    moved = [F.col(f"`{c}`").alias(f"field_{c}" if c in RESERVED else c) for c in events.columns]
    at = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    none = F.lit(None).cast("string")
    failed = none if error is None else error
    return events.select(at.alias("at"), F.coalesce(none if level is None else level, F.when(failed.isNotNull(), "ERROR").otherwise("INFO")).alias("level"), message.alias("message"), *moved, failed.alias("error"), (none if stack is None else stack).alias("stack"))


def answer_log(answers: DataFrame, now: Column, seconds: Column) -> DataFrame:
    """Rows to append to a log: ``at`` (ISO time in UTC), ``id, answered, citations, invalid, ms`` rounded to a tenth."""
    at = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return answers.select(at.alias("at"), "id", "answered", "citations", "invalid", F.round(seconds * 1000, 1).alias("ms"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and characters as they are."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)))).write.option("lineSep", "\n").text(path)


def recording(requests: DataFrame, said: Column, today: Column) -> DataFrame:
    """Rows of RECORDING from requests ``key, purpose, question, control_ids, model, model_version, usage_prompt_tokens,
    usage_completion_tokens, counted_prompt_tokens`` and an answer."""
    return requests.withColumn("recorded_on", today).withColumn("answer_lines", answer_lines(said)).select(*(x.split()[0] for x in RECORDING.split(", ")))


