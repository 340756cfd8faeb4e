"""What all that a corpus and its recordings were made of is now: identities and digests, to hold against a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators.maintenance import ordered_digest


def digest_of(*parts: str) -> str:
    """SHA-256 over parts, each followed by 0x1E."""
    return sha256("".join(p + "\x1e" for p in parts).encode()).hexdigest()


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@dataclass(frozen=True)
class Input:
    """An input by what it calls itself and by what it is: ``parts`` gives the strings that are digested; None is an input that
    isn't there. ``feeds`` names inputs and costs that follow from it."""

    identity: str | None
    parts: Callable[[], list[str]] | None
    feeds: tuple[str, ...] = field(default_factory=tuple)


def observe(spark: SparkSession, inputs: dict[str, Input]) -> DataFrame:
    """``name, identity, digest`` of each input; nothing is written."""
    rows = [(name, x.identity, None if x.parts is None else digest_of(*x.parts())) for name, x in inputs.items()]
    return spark.createDataFrame(rows, "name string, identity string, digest string")


def invalidated(inputs: dict[str, Input], costs: list[str]) -> dict[str, list[str]]:
    """For each input the costs that a change of it brings, through whatever it feeds, in the order of ``costs``. An input that
    feeds itself, and a name that is neither an input nor a cost, are refused."""
    known: dict[str, set[str]] = {}

    def reach(name: str, through: tuple[str, ...]) -> set[str]:
        if name in through:
            raise ValueError(f"an input that feeds itself: {name}")
        if name not in known:
            known[name] = set()
            for to in inputs[name].feeds:
                if to not in inputs and to not in costs:
                    raise ValueError(f"{name} feeds {to}, which isn't known")
                known[name] |= {to} if to in costs else reach(to, (*through, name))
        return known[name]

    return {name: [c for c in costs if c in reach(name, ())] for name in inputs}


def manifest_of(spark: SparkSession, inputs: dict[str, Input], costs: list[str]) -> DataFrame:
    """``name, identity, digest, invalidates``: a manifest that says of the inputs what they are now."""
    reached = spark.createDataFrame(list(invalidated(inputs, costs).items()), "name string, invalidates array<string>")
    return observe(spark, inputs).join(reached, "name")


def catalog_digests(tables: C.Catalog) -> tuple[str, str]:
    """Of all documents: the digest of what the resolver makes, and of what the chunker makes.

    Both come of the tables of one walk, in one job: a row for each document and digest, joined by document order.
    """
    made = C.resolution_digest(tables).select(F.lit("resolution").alias("what"), F.col("root").cast("long").alias("root"), "digest")
    chunks = ordered_digest(C.chunk_catalog(tables), ["path"], ["chunk_id", "text"], "root").select(F.lit("chunks").alias("what"), F.col("root").cast("long").alias("root"), "digest")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("root", "digest"))), lambda x: F.concat(x["root"].cast("string"), F.lit("\x1f"), x["digest"])), "\x1e")
    found = {r["what"]: r["digest"] for r in made.unionByName(chunks).groupBy("what").agg(F.sha2(listed, 256).alias("digest")).collect()}  # two rows
    return found.get("resolution", ""), found.get("chunks", "")


def corpus_inputs(tables: C.Catalog, *, release: dict, resolution_version: str, chunker_version: str, embedder: dict, template_version: str, template: str, tokenizer: dict, judge: str | None = None) -> dict[str, Input]:
    """The seven inputs of a corpus and its recordings. A version is a claim and the digest beside it checks it; the catalog is
    digested once for both that need it, and only if one of them is asked for."""
    held: list[tuple[str, str]] = []

    def of_catalog(n: int) -> str:
        if not held:
            held.append(catalog_digests(tables))
        return held[0][n]

    return {
        "catalog": Input(str(release["release"]), lambda: [canonical(release)], ("parameter_resolution", "counts")),
        "parameter_resolution": Input(f"resolution {resolution_version}", lambda: [resolution_version, of_catalog(0)], ("chunker",)),
        "chunker": Input(f"chunker {chunker_version}", lambda: [chunker_version, of_catalog(1)], ("corpus", "generation", "counts")),
        "embedder": Input(f"{embedder['name']} @ {str(embedder['revision'])[:8]}", lambda: [canonical(embedder)], ("corpus", "queries", "generation")),
        "prompt_template": Input(f"template {template_version}", lambda: [template_version, template], ("generation", "counts")),
        "tokenizer": Input(str(tokenizer["encoding"]), lambda: [str(tokenizer["encoding"]), canonical(tokenizer)], ("counts",)),
        "judge_prompt": Input(None, None, ("judge",)) if judge is None else Input("judge", lambda: [judge], ("judge",)),
    }
