"""Whole questions in one batch: retrieved, prompted, keyed, replayed or recorded, and checked."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import answer_lines
from tessera.operators import answers, commits, maintenance, search
from tessera.operators.records import RECORDING


@dataclass(frozen=True)
class Model:
    """What a request is keyed by besides its prompt; ``sampling`` is a struct, or any other value that JSON can hold."""

    name: str
    version: str
    sampling: Column


def requests(asked: DataFrame, corpus: DataFrame, encode: Callable[[DataFrame], DataFrame], model: Model, purpose: str, instructions: str, k: int = 10, count: Callable[[DataFrame], DataFrame] | None = None, key: str = "chunk_id") -> DataFrame:
    """``q_id, question, control_ids, prompt, key, counted_prompt_tokens`` of ``asked(q_id, question)``.

    ``encode`` adds ``q`` to them; ``corpus`` has ``key, control_id, label, text, embedding``. ``control_ids`` are those retrieved, by
    rank, repeats kept. The key is that of the whole request (``answers.whole_request_key``). ``count`` adds ``tokens`` to rows with
    ``prompt``; without it the count is null. A question for which nothing is retrieved has a prompt without excerpts.
    """
    questions = maintenance.unique(asked.select("q_id", "question"), "q_id", what="a question's id twice")
    vectors = encode(questions).select("q_id", "q")
    found = search.batch_top_k(corpus, vectors, k, key=key).join(corpus.select(key, "control_id", "label", "text"), key)
    excerpt = F.concat(F.lit("["), "label", F.lit("]\n"), "text")
    ranked = found.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "control_id", excerpt.alias("excerpt")))).alias("x"))
    joined = questions.join(ranked, "q_id", "left").withColumn("x", F.coalesce("x", F.expr("filter(array(struct(0 AS rank, '' AS control_id, '' AS excerpt)), y -> false)")))
    body = F.concat_ws("\n\n", F.lit(instructions), *[F.nullif(F.array_join(F.transform("x", lambda r: r["excerpt"]), "\n\n"), F.lit(""))], F.concat(F.lit("Question: "), "question"))
    made = joined.select("q_id", "question", F.transform("x", lambda r: r["control_id"]).alias("control_ids"), body.alias("prompt"))
    fields = {"purpose": F.lit(purpose), "model": F.lit(model.name), "model_version": F.lit(model.version), "prompt": F.col("prompt"), "sampling": model.sampling}
    keyed = made.withColumn("key", answers.whole_request_key(fields))
    return (count(keyed).withColumnRenamed("tokens", "counted_prompt_tokens") if count else keyed.withColumn("counted_prompt_tokens", F.lit(None).cast("int"))).select("q_id", "question", "control_ids", "prompt", "key", F.col("counted_prompt_tokens").cast("int").alias("counted_prompt_tokens"))


def answer_all(asked_requests: DataFrame, recordings: DataFrame, controls: DataFrame, manifest: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``requests`` with what was recorded for them: ``answered, answer, decline, citations, n_citations, invalid``.

    ``manifest`` is what ``maintenance.check_manifest`` takes, and is checked once, before anything is replayed: a recording of
    another corpus is refused. A request without a recording declines, which isn't an error, and cites nothing. Citations are
    ``cited_as, canonical, exists, retrieved, valid, reason``, in order; one is valid if it names a control of ``controls(id)`` that
    was retrieved for its question.
    """
    if manifest is not None:
        maintenance.check_manifest(*manifest)
    said = answers.replay(asked_requests, recordings)
    got = asked_requests.select(F.col("q_id"), F.explode("control_ids").alias("canonical"))
    cited = answers.check_citations(answers.parse_citations(said.filter("answered").select("q_id", "answer"), "q_id"), controls, got, "q_id")
    one = F.struct("pos", "cited_as", "canonical", F.col("exists_flag").alias("exists"), F.col("retrieved_flag").alias("retrieved"), "valid", "reason")
    listed = cited.groupBy("q_id").agg(F.array_sort(F.collect_list(one)).alias("c"), F.count_if(~F.col("valid")).alias("invalid"))
    whole = said.join(listed, "q_id", "left")
    none = F.expr("filter(array(struct('' AS cited_as, '' AS canonical, true AS exists, true AS retrieved, true AS valid, '' AS reason)), y -> false)")
    citations = F.coalesce(F.transform("c", lambda x: F.struct(*(x[n].alias(n) for n in ("cited_as", "canonical", "exists", "retrieved", "valid", "reason")))), none)
    return whole.select(*asked_requests.columns, "answered", "answer", "decline", citations.alias("citations"), F.coalesce(F.size("c"), F.lit(0)).alias("n_citations"), F.coalesce("invalid", F.lit(0)).alias("invalid"))


def observed(rows: DataFrame, name: str = "answers") -> tuple[DataFrame, Observation]:
    """Answers with an observation of ``questions, answered, declined, citations, invalid, prompt_tokens``, filled by whatever reads them: no
    pass of its own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.observe(seen, F.count(F.lit(1)).alias("questions"), F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("declined"), total("n_citations").alias("citations"), total("invalid").alias("invalid"), total("counted_prompt_tokens").alias("prompt_tokens")), seen


#: Makes an answer of a request, ``(key, prompt)``: answer, model, version, prompt tokens, completion tokens. The key is to be
#: passed on where the other side knows keys of requests that it answers once.
Complete = Callable[[str, str], tuple[str, str, str, int, int]]


class Calls:
    """Answers by key in a shared folder, one file each, which appears whole and is never replaced."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self.fs.create_dir(self.folder, recursive=True)

    def get(self, key: str) -> list | None:
        try:
            with self.fs.open_input_stream(f"{self.folder}/{key}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, call: list) -> list:
        """What is stored for the key: this, or what another attempt has stored before."""
        path, temp = f"{self.folder}/{key}.json", f"{self.folder}/.{key}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps(call).encode())
        if self.local:
            try:
                os.link(temp, path)
            except FileExistsError:
                pass
            os.unlink(temp)
        elif self.get(key) is None:
            self.fs.move(temp, path)
        return self.get(key)


def record_generations(asked_requests: DataFrame, root: str, load: Callable[[], Complete], purpose: str, today: Column, now: Column, force: bool = False) -> dict:
    """Ask for every request that isn't recorded under ``root``, and record what is said: ``recorded, skipped, orphans, prompt_tokens,
    completion_tokens``. With ``force`` all are asked again.

    Recordings are a table of commits by key, so a run that fails records nothing, and one that is repeated records nothing
    twice. Calls are kept by key while a run lasts: a task that is tried again takes what its first try was told, so a key that
    was answered isn't asked again, and equal requests are asked once. ``load`` makes the client, once in a worker.
    """
    spark, root = asked_requests.sparkSession, root.rstrip("/")
    known = commits.entry(spark, f"{root}/recordings")
    have = commits.table(spark, f"{root}/recordings") if known else None
    was = have.select("key") if known else spark.createDataFrame([], "key string")
    wanted = asked_requests.join(was, "key", "left_anti") if not force else asked_requests
    # equal requests are one call, told of the first question by id
    first = wanted.groupBy("key").agg(F.min(F.struct("q_id", "question", "control_ids", "prompt", "counted_prompt_tokens")).alias("r")).select("key", "r.*")
    calls = f"{root}/calls-{uuid.uuid4().hex if force else (known.version if known else 0)}"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete, held = load(), Calls(calls)
        for b in batches:
            said = [held.get(key) or held.put(key, list(complete(key, prompt))) for key, prompt in zip(b["key"], b["prompt"], strict=True)]
            yield pd.DataFrame(said, columns=["answer", "model", "model_version", "usage_prompt_tokens", "usage_completion_tokens"]).assign(key=list(b["key"]))[["key", "answer", "model", "model_version", "usage_prompt_tokens", "usage_completion_tokens"]]

    told = first.select("key", "prompt").mapInPandas(ask, "key string, answer string, model string, model_version string, usage_prompt_tokens int, usage_completion_tokens int")
    rows = first.drop("prompt").join(told, "key").withColumn("purpose", F.lit(purpose)).withColumn("recorded_on", today).withColumn("answer_lines", answer_lines(F.col("answer")))
    rows = rows.select(*(x.split()[0] for x in RECORDING.split(", ")))
    done = commits.merge(rows, f"{root}/recordings", "key", now, created="first_recorded_at")
    keys = asked_requests.select("key").distinct()
    fresh = commits.table(spark, f"{root}/recordings").join(first.select("key"), "key", "left_semi") if done["rows"] else None
    tokens = fresh.agg(F.coalesce(F.sum("usage_prompt_tokens"), F.lit(0)), F.coalesce(F.sum("usage_completion_tokens"), F.lit(0))).first() if fresh is not None else (0, 0)
    asked_n, skipped = asked_requests.count(), asked_requests.join(was, "key", "left_semi").count() if not force else 0
    fs, place = maintenance.place_of(spark, calls)
    fs.delete(place, True)  # recorded now
    return {"recorded": asked_n - skipped, "skipped": skipped, "orphans": was.join(keys, "key", "left_anti").count(), "prompt_tokens": tokens[0], "completion_tokens": tokens[1]}


def recorded(spark, root: str) -> DataFrame:
    """What ``record_generations`` has recorded under ``root``."""
    return commits.table(spark, f"{root.rstrip('/')}/recordings").drop("first_recorded_at")
