"""A nested control catalog as flat tables: groups, controls, parts and parameters; identifiers; chunks; digests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import MARKER, canonical_id, form_key, normal_space, part_suffix, published_forms, rendered_parameter
from tessera.operators.maintenance import unique
from tessera.storage import saved

#: How deep trees are read; a deeper one fails the query.
LEVELS = 6


def string_at(node: str, path: str) -> Column:
    """A string of a JSON value; null if it is absent or anything else."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({node}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({node}, '{path}', 'string') END")


def list_at(node: str, path: str) -> Column:
    """The values of an array; empty if it is absent or anything else."""
    return F.expr(f"coalesce(try_variant_get({node}, '{path}', 'array<variant>'), cast(array() AS array<variant>))")


def flatten(nodes: DataFrame, children: str, levels: int = LEVELS) -> DataFrame:
    """All nodes of JSON trees in document order: ``path, depth, parent, node`` (VARIANT) with all other columns of ``nodes``.

    ``nodes`` has ``node``, and ``path`` where it isn't a whole document; ``children`` names the array of child nodes.
    ``path`` sorts as the document reads, and ``parent`` is the id of the node above. Each level is one projection of the one
    before it, without a shuffle. A tree of over ``levels`` levels fails the query.
    """
    kept = [c for c in nodes.columns if c not in ("node", "path", "parent", "depth")]
    path = F.col("path") if "path" in nodes.columns else F.lit("0")
    level = nodes.select(*kept, path.alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "node")
    out = level
    for depth in range(1, levels + 1):
        below = level.select(*kept, "path", string_at("node", "$.id").alias("parent"), F.posexplode(list_at("node", f"$.{children}")).alias("n", "node"))
        over = F.raise_error(F.lit(f"a tree of over {levels} levels")) if depth == levels else F.lit(depth)
        level = below.select(*kept, F.concat("path", F.lit("."), F.lpad(F.col("n").cast("string"), 9, "0")).alias("path"), over.cast("int").alias("depth"), "parent", "node")
        out = out.unionByName(level)
    return out


@dataclass(frozen=True, eq=False)
class Catalog:
    """A catalog's documents as tables, all keyed by ``root``, the document: see ``catalog_tables``."""

    metadata: DataFrame
    groups: DataFrame
    controls: DataFrame
    parts: DataFrame
    parameters: DataFrame


_STRINGS, _LISTS = ("kind", "path", "parent", "group_id", "control_id", "top", "top_part", "top_name", "id", "name", "title", "class", "label", "padded_label", "sort_id", "status", "prose", "how_many", "alt_identifier"), ("values", "choices", "guidelines")
_NODE = pa.schema([("root", pa.int64()), ("depth", pa.int32()), *((c, pa.string()) for c in _STRINGS), *((c, pa.list_(pa.string())) for c in _LISTS)])
_METADATA = {"title": "title", "version": "version", "last-modified": "last_modified", "oscal-version": "oscal_version"}


def _text(node: dict, key: str, what: str | None = None) -> str | None:
    """A string; where ``what`` is named it must be there and not be empty."""
    found = node.get(key)
    found = found if isinstance(found, str) else None
    if what is not None and not found:
        raise ValueError(f"{what} has no {key}")
    return found


def _items(node: dict, key: str, what: str | None = None) -> list:
    """An array, empty if it is anything else; where ``what`` is named all items must be objects."""
    found = node.get(key)
    found = found if isinstance(found, list) else []
    if what is not None and not all(isinstance(x, dict) for x in found):
        raise ValueError(f"{what} isn't an object")
    return found


def property_of(node: dict, name: str, kind: str | None = None) -> str | None:
    """The value of the first of ``props`` with this name and exactly this class (none, if None); null unless it is a string."""
    first = next((p for p in _items(node, "props") if isinstance(p, dict) and p.get("name") == name and p.get("class") == kind), {})
    return _text(first, "value")


def _once(seen: set[str], name: str, what: str) -> str:
    if name in seen:
        raise ValueError(f"{what} twice: {name}")
    seen.add(name)
    return name


def _parts(node: dict, path: str, **head: object) -> Iterator[dict]:
    """The parts of a control or group, each followed by those in it."""
    for n, first in enumerate(_items(node, "parts", "a part")):
        top = f"{path}/.{n:09d}"
        head |= {"kind": "part", "top": top, "top_part": _text(first, "id"), "top_name": _text(first, "name", "a part")}
        inner = [(top, 0, first)]
        while inner:
            place, depth, part = inner.pop()
            yield {**head, "path": place, "depth": depth, "id": _text(part, "id"), "name": _text(part, "name", "a part"), "title": _text(part, "title"), "prose": _text(part, "prose"), "label": property_of(part, "label")}
            inner += [(f"{place}.{k:09d}", depth + 1, p) for k, p in reversed(list(enumerate(_items(part, "parts", "a part"))))]


def nodes_of(root: int, document: object) -> Iterator[dict]:
    """The groups, controls, parts and parameters of one document, in its order; see ``catalog_tables``."""
    if not isinstance(document, dict) or not isinstance(document.get("catalog"), dict):
        raise ValueError(f"{root}: no top-level catalog")
    top = document["catalog"]
    about = top.get("metadata")
    if not isinstance(about, dict):
        raise ValueError(f"{root}: no metadata")
    if not (groups := _items(top, "groups", "a group")):
        raise ValueError(f"{root}: a catalog without groups")
    yield {"kind": "metadata", "id": _text(top, "uuid", "the catalog"), "values": [_text(about, k, "metadata") for k in _METADATA], "depth": len(groups)}
    at = lambda path, n: f"{path}.{n:09d}"
    controls: set[str] = set()
    parameters: set[str] = set()
    for g, group in enumerate(groups):
        group_id = _text(group, "id", "a group")
        yield {"kind": "group", "path": at("0", g), "group_id": group_id, "title": _text(group, "title", "a group"), "class": _text(group, "class")}
        yield from _parts(group, at("0", g), group_id=group_id)
        waiting = [(at(at("0", g), n), None, c) for n, c in reversed(list(enumerate(_items(group, "controls", "a control"))))]
        while waiting:  # depth first, without recursion
            path, parent, control = waiting.pop()
            own = _once(controls, _text(control, "id", "a control"), f"{root}: a control")
            yield {
                "kind": "control", "path": path, "parent": parent, "group_id": group_id, "id": own, "title": _text(control, "title", own), "class": _text(control, "class"), "label": property_of(control, "label"),
                "padded_label": property_of(control, "label", "zero-padded"), "sort_id": property_of(control, "sort-id"), "status": property_of(control, "status"),
            }
            waiting += [(at(path, n), own, c) for n, c in reversed(list(enumerate(_items(control, "controls", "a control"))))]
            for param in _items(control, "params", "a parameter"):
                chosen = param.get("select") if isinstance(param.get("select"), dict) else None
                yield {
                    "kind": "parameter", "control_id": own, "id": _once(parameters, _text(param, "id", "a parameter"), f"{root}: a parameter"), "label": _text(param, "label"), "values": [str(v) for v in _items(param, "values")], "alt_identifier": property_of(param, "alt-identifier"),
                    "how_many": None if chosen is None else _text(chosen, "how-many") or "one", "choices": None if chosen is None else [str(v) for v in _items(chosen, "choice")],
                    "guidelines": [said for x in _items(param, "guidelines") if isinstance(x, dict) and (said := _text(x, "prose"))],
                }
            yield from _parts(control, path, group_id=group_id, control_id=own)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for root, document in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for some in batched(nodes_of(root, json.loads(document.as_py())), 4096):
                yield pa.RecordBatch.from_pylist([{"root": root, **x} for x in some], _NODE)


def catalog_tables(documents: DataFrame) -> Catalog:
    """The tables of catalog documents ``root long, document`` (VARIANT, or JSON as a string).

    metadata: root, uuid, title, version, last_modified, oscal_version, n_groups. groups: root, path, group_id, title, class.
    controls: root, path, group_id, id, title, class, label, padded_label, sort_id, withdrawn, base_id (the nearest control
    around it, or itself), is_enhancement. parts: root, group_id, control_id (null for a group's own), path, depth, top (path of
    the control's own part), top_part, top_name, id, name, title, prose, label. parameters: root, control_id, param, label, values,
    how_many, choices, guidelines, alt_identifier. Paths sort as the document reads.

    Each document is walked once, in a stream, by its own row's task; the walk's rows are written by kind, and every table
    reads its own kind. Refused in that one pass: no ``catalog``, no groups, a required string that is absent or empty,
    something that isn't an object where one must be, and a control or parameter id that stands twice in a document; and a
    ``root`` that two documents have. Optional values of another type are null, such lists empty.
    """
    text = F.to_json("document") if documents.schema["document"].dataType.simpleString() == "variant" else F.col("document")
    schema = "root long, depth int, " + ", ".join(f"`{c}` string" for c in _STRINGS) + ", " + ", ".join(f"`{c}` array<string>" for c in _LISTS)
    nodes = saved(documents.select(F.col("root").cast("long").alias("root"), text.alias("document")).mapInArrow(_walked, schema), by=["kind"])
    of = lambda kind: nodes.filter(F.col("kind") == kind)
    if twice := of("metadata").groupBy("root").count().filter("count > 1").first():
        raise ValueError(f"two documents are {twice['root']}")
    metadata = of("metadata").select("root", F.col("id").alias("uuid"), *(F.col("values")[n].alias(c) for n, c in enumerate(_METADATA.values())), F.col("depth").alias("n_groups"))
    controls = of("control").select("root", "path", "group_id", "id", "title", "class", "label", "padded_label", "sort_id", F.coalesce(F.col("status") == "withdrawn", F.lit(False)).alias("withdrawn"), F.coalesce("parent", "id").alias("base_id"), F.col("parent").isNotNull().alias("is_enhancement"))
    parts = of("part").select("root", "group_id", "control_id", "path", "depth", "top", "top_part", "top_name", "id", "name", "title", "prose", "label")
    parameters = of("parameter").select("root", "control_id", F.col("id").alias("param"), "label", "values", "how_many", "choices", "guidelines", "alt_identifier")
    return Catalog(metadata, of("group").select("root", "path", "group_id", "title", "class"), controls, parts, parameters)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows as a join's side that grows with the input: both sides are dealt by the key and sorted.

    Left to itself the engine judges a table by its files, which are compressed: a few MB of markers or controls are hundreds of
    MB of rows, and would go through the driver to every executor.
    """
    return rows.hint("merge")


#: How deep parameters may name each other, through their choices or their guidance.
DEPTH = 8


def _peeled(elements: DataFrame, plain: DataFrame, finish: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """``param, rendered`` of ``plain`` and of those that ``finish`` makes of ``own, texts`` (their elements, resolved, in order).

    ``elements(own, n, text)`` name other parameters by markers. That graph is peeled from the inside: a round takes up the
    parameters whose last open marker names one of the round before, and no others. What is open, and what a round made, are
    saved, so no plan grows with the depth. What can't be peeled in ``depth`` rounds fails. ``elements`` and ``plain`` are read
    in each round and so are to be cheap: a saved table's rows, or little more.
    """
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(MARKER), 1)))
    front, open_, asked = plain, elements.select("own", named.alias("param")).distinct(), elements.select("own").distinct()
    made = [front]
    for _ in range(depth):
        left = saved(open_.join(dealt(front), "param", "left_anti"))
        ready = asked.join(dealt(left), "own", "left_anti")
        texts = elements.join(dealt(ready), "own", "left_semi").withColumn("__key", F.concat_ws("\x1e", "own", F.col("n").cast("string")))
        done = resolve_markers(texts.select("__key", "text"), reduce(DataFrame.unionByName, made), "__key", "text", checked=False)
        whole = done.select(F.substring_index("__key", "\x1e", 1).alias("own"), F.substring_index("__key", "\x1e", -1).cast("int").alias("n"), "resolved")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "resolved"))), lambda x: x["resolved"])
        front = saved(finish(whole.groupBy("own").agg(listed.alias("texts"))))
        made.append(front)
        if (stuck := left.first()) is None:
            return reduce(DataFrame.unionByName, made)
        if front.isEmpty():
            break
        open_, asked = left, left.join(dealt(front), "param", "left_semi").select("own").distinct()
    raise ValueError(f"unknown, circular or too deep: {stuck['own']} names {stuck['param']}")


def nested_parameters(parameters: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``param, rendered`` without markers, of texts that may name each other: resolved from the inside; a cycle, an unknown name
    or more than ``depth`` levels fail."""
    own = saved(unique(parameters.select("param", "rendered"), "param", what="a parameter twice"))
    marked = F.coalesce(F.col("rendered").rlike(MARKER), F.lit(False))
    elements = own.filter(marked).select(F.col("param").alias("own"), F.lit(0).alias("n"), F.col("rendered").alias("text"))
    return _peeled(elements, own.filter(~marked), lambda whole: whole.select(F.col("own").alias("param"), F.col("texts")[0].alias("rendered")), depth)


def rendered(parameters: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``root, param, rendered``: what stands for each parameter of its document.

    Values and labels stand as they are. Choices are resolved and then stripped, each by itself; so are guidelines, up to the
    first that can't come to nothing, and the first that says something counts. See ``rendered_parameter`` and ``nested_parameters``.
    The rows are read several times, so they are to come from a table, as those of ``catalog_tables`` do.
    """
    none, empty = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    valued, labelled = F.coalesce(F.size("values") > 0, F.lit(False)), F.coalesce("label", F.lit("")) != ""
    # a guideline that has more than markers, blanks and full stops says something
    telling = F.transform(F.coalesce("guidelines", empty), lambda x: F.regexp_replace(x, MARKER, "").rlike(r"[^;.\s]"))
    needed = F.when(F.array_contains(telling, True), F.slice("guidelines", 1, F.array_position(telling, True).cast("int"))).otherwise(F.col("guidelines"))
    texts = F.when(valued, empty).when(F.col("choices").isNotNull(), F.col("choices")).when(labelled, empty).otherwise(F.coalesce(needed, empty))
    name = F.concat_ws("\x1f", F.col("root").cast("string"), "param")
    rows = parameters.select(name.alias("own"), "values", "how_many", F.col("choices").isNotNull().alias("chosen"), "label", texts.alias("texts"))
    plain = rows.filter(F.size("texts") == 0).select(F.col("own").alias("param"), rendered_parameter(F.col("values"), F.col("how_many"), F.when(F.col("chosen"), empty), F.col("label"), none).alias("rendered"))
    scoped = F.regexp_replace("text", r"(\{\{\s*insert:\s*param,\s*)", F.concat(F.lit("$1"), F.substring_index("own", "\x1f", 1), F.lit("\x1f")))
    elements = rows.select("own", F.posexplode("texts").alias("n", "text")).select("own", "n", scoped.alias("text"))
    facts = rows.select("own", "how_many", "chosen").filter(F.size("texts") > 0)

    def finish(whole: DataFrame) -> DataFrame:
        both = whole.join(dealt(facts), "own")
        made = rendered_parameter(none, F.col("how_many"), F.when(F.col("chosen"), F.col("texts")), F.lit(None).cast("string"), F.col("texts"))
        return both.select(F.col("own").alias("param"), made.alias("rendered"))

    return _peeled(elements, plain, finish, depth).select(F.substring_index("param", "\x1f", 1).cast("long").alias("root"), F.substring_index("param", "\x1f", -1).alias("param"), "rendered")


def resolved_parts(catalog: Catalog, shown: DataFrame | None = None) -> DataFrame:
    """The controls' ``parts`` that have prose, empty or not, with it resolved; ``shown`` is ``rendered(catalog.parameters)``."""
    shown = rendered(catalog.parameters) if shown is None else shown
    scope = F.concat(F.col("root").cast("string"), F.lit("\x1f"))
    marked = F.col("prose").rlike(MARKER)
    said = catalog.parts.filter(F.col("prose").isNotNull() & F.col("control_id").isNotNull())
    keyed = said.filter(marked).withColumn("__key", F.concat(scope, "path"))
    scoped = F.regexp_replace("prose", r"(\{\{\s*insert:\s*param,\s*)", F.concat(F.lit("$1"), scope))
    done = resolve_markers(keyed.select("__key", scoped.alias("prose")), shown.select(F.concat(scope, "param").alias("param"), "rendered"), "__key", "prose", checked=False)
    resolved = keyed.drop("prose").join(dealt(done.withColumnRenamed("resolved", "prose")), "__key").drop("__key")
    return said.filter(~marked).unionByName(resolved)


#: Parts of a control that its chunk holds, in this order, and the heading of each: fixed values.
HEADINGS = {"statement": "Control", "guidance": "Discussion"}


def chunk_catalog(catalog: Catalog) -> DataFrame:
    """``root, path, chunk_id, control_id, base_control_id, control_label, title, part_path, text``: a chunk for each live
    control, in document order by ``path``: label and title, then the prose of its own statement and guidance parts, and of all
    parts in them, line by line with list labels.

    A live control without such prose fails the query; so does any control, withdrawn or not, that lacks one of its published
    forms or shares one with another of its document (see ``control_index``, which is made first).
    """
    control_index(catalog.controls, "root", checked=False)  # the walk refuses ids that repeat
    live = catalog.controls.filter(~F.col("withdrawn"))
    order = F.array_position(F.lit(list(HEADINGS)), F.col("top_name"))
    lines = resolved_parts(catalog).filter(F.col("top_name").isin(*HEADINGS) & (F.col("prose") != ""))
    line = F.when(F.coalesce("label", F.lit("")) != "", F.concat("label", F.lit(" "), "prose")).otherwise(F.col("prose"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", items.alias("x")))), lambda s: s["x"]), "\n")
    heading = F.element_at(F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair)), F.col("top_name"))
    section = lines.groupBy("root", "control_id", "top", "top_name", "top_part").agg(joined(line).alias("body"))
    body = F.concat(heading, F.lit(":\n"), "body").alias("text")
    whole = section.groupBy("root", "control_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "top", body, part_suffix(F.col("top_part"), F.col("top_name")).alias("suffix")))).alias("sections"))
    found = live.join(dealt(whole), (live["root"] == whole["root"]) & (live["id"] == whole["control_id"]), "left").drop(whole["root"])
    lacks = F.when(F.col("sections").isNull(), "no statement or guidance")
    checked = found.withColumn("control_id", F.when(lacks.isNull(), F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", "id", lacks))))
    path = F.array_join(F.transform("sections", lambda s: s["suffix"]), "+")
    text = F.concat(F.col("label"), F.lit(" "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n"))
    return checked.select("root", "path", F.concat("control_id", F.lit(":"), path).alias("chunk_id"), "control_id", F.col("base_id").alias("base_control_id"), normal_space(F.col("label")).alias("control_label"), normal_space(F.col("title")).alias("title"), path.alias("part_path"), normal_space(text).alias("text"))


def resolution_digest(catalog: Catalog) -> DataFrame:
    """``root, digest``: SHA-256 over the resolved prose, empty or not, of all controls' parts in document order, each as control, 0x1F, the part's place
    among all of its control's, 0x1F, text, 0x1E, and then over the rendered parameters by id, each as id, 0x1F, text, 0x1E.

    Made of one digest of each control's parts, so that only digests of a document come together.
    """
    place = F.row_number().over(Window.partitionBy("root", "control_id").orderBy("path")) - 1
    numbered = catalog.parts.filter("control_id is not null").select("root", "control_id", "path", place.alias("n"))
    shown = rendered(catalog.parameters)
    texts = resolved_parts(catalog, shown).select("root", "path", "prose").join(dealt(numbered), ["root", "path"])
    ordered = lambda items, *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, items.alias("x")))), lambda s: s["x"]), "")
    one = texts.groupBy("root", "control_id").agg(F.sha2(ordered(F.concat_ws("\x1f", "control_id", F.col("n").cast("string"), F.concat("prose", F.lit("\x1e"))), "n"), 256).alias("digest"))
    both = one.join(dealt(catalog.controls.select("root", F.col("id").alias("control_id"), "path")), ["root", "control_id"]).select("root", F.lit(0).alias("kind"), F.col("path").alias("at"), F.concat("digest", F.lit("\x1e")).alias("x"))
    shown = shown.select(F.col("root").cast("string").alias("root"), F.col("param").alias("at"), "rendered").select("root", F.lit(1).alias("kind"), "at", F.concat_ws("\x1f", "at", F.concat("rendered", F.lit("\x1e"))).alias("x"))
    rows = both.withColumn("root", F.col("root").cast("string")).unionByName(shown)
    return rows.groupBy("root").agg(F.sha2(ordered(F.col("x"), "kind", "at"), 256).alias("digest"))


def catalog_counts(controls: DataFrame) -> DataFrame:
    """``base, enhancements, withdrawn, live`` of controls with ``is_enhancement`` and ``withdrawn``."""
    enhanced = F.coalesce(F.col("is_enhancement"), F.lit(False))
    gone = F.coalesce(F.col("withdrawn"), F.lit(False))
    return controls.agg(F.count_if(~enhanced).alias("base"), F.count_if(enhanced).alias("enhancements"), F.count_if(gone).alias("withdrawn"), F.count_if(~gone).alias("live"))


_PUBLISHED = ("label", "padded_label", "sort_id")


def control_index(controls: DataFrame, *scope: str, checked: bool = True) -> DataFrame:
    """``scope, form, id``: what names each control, by its key (see ``form_key``): its id and the labels that it is published
    under, whatever they have to do with the id. A table of controls without the columns ``label, padded_label, sort_id`` is
    taken to be published under the forms that follow from the ids.

    The table is saved, and refused while it is made: a control that stands twice (not looked for if not ``checked``), one without all of its forms, and a form
    that two controls have. Controls and forms are two sides of a graph, and such a form is one with two neighbours; withdrawn
    controls count. ``scope`` names columns within which all that holds, such as a document.
    """
    own = unique(controls, *scope, "id", what="a control twice") if checked else controls
    forms = F.array("id", *_PUBLISHED) if set(_PUBLISHED) <= set(controls.columns) else published_forms(F.col("id"))
    lacking = F.exists(forms, lambda x: F.coalesce(x, F.lit("")) == "")
    whole = F.when(lacking, F.raise_error(F.concat(F.lit("not all published forms: "), "id"))).otherwise(F.transform(forms, form_key))
    edges = own.select(*scope, "id", F.explode(F.array_distinct(whole)).alias("form"))
    ends = edges.groupBy(*scope, "form").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    clash = F.raise_error(F.concat(F.lit("a form names two controls: "), "form", F.lit(" is "), "id", F.lit(" and "), "other"))
    return saved(ends.select(*scope, "form", F.when(F.col("id") == F.col("other"), F.col("id")).otherwise(clash).alias("id")))


def resolve(asked: DataFrame, controls: DataFrame, column: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``asked`` with ``canonical`` and ``resolved``: by a published form, else by the canonical identifier, else null.

    ``index`` is ``control_index(controls)``, which is made where it isn't given.
    """
    forms = (control_index(controls) if index is None else index).select("form", F.col("id").alias("by_form"))
    ids = controls.select(F.col("id").alias("by_id")).distinct()
    keyed = asked.withColumn("form", form_key(F.col(column))).withColumn("canonical", canonical_id(F.col(column)))
    found = keyed.join(forms, "form", "left").join(ids, F.col("canonical") == F.col("by_id"), "left")
    return found.withColumn("resolved", F.coalesce("by_form", "by_id")).drop("form", "by_form", "by_id")


def known_controls(asked: DataFrame, controls: DataFrame, column: str = "id") -> DataFrame:
    """``asked`` with ``known``: whether this is exactly a canonical identifier of a control. No other form counts."""
    ids = controls.select(F.col("id").alias(column)).distinct().withColumn("known", F.lit(True))
    return asked.join(ids, column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def checked_count(rows: DataFrame, expected: int, what: str = "chunks") -> DataFrame:
    """The rows, if there are as many as expected: the live controls of the pinned document."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} {what}, not {expected}")
    return rows


def required_controls(asked: DataFrame, controls: DataFrame, column: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``resolve`` where each must name a control; one that doesn't fails the query."""
    out = resolve(asked, controls, column, index)
    return out.withColumn("resolved", F.coalesce("resolved", F.raise_error(F.concat(F.lit("no such control: "), F.coalesce(F.col(column), F.lit("null"))))))


def marker_pieces(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, pos, literal, match, param, following, more, earlier``: texts cut at parameter markers, with the literal and the
    match that follow and the match before; the last piece has no match."""
    cut = lambda n: F.regexp_extract_all(F.col(text), F.lit(MARKER), n)
    arrays = texts.select(key, F.split(F.col(text), MARKER, -1).alias("__l"), cut(0).alias("__m"), cut(1).alias("__p"))
    late = lambda c: F.slice(c, 2, F.size("__l"))
    names = ("literal", "match", "param", "following", "more", "earlier")
    zipped = F.arrays_zip(*(x.alias(n) for x, n in zip((F.col("__l"), F.col("__m"), F.col("__p"), late("__l"), late("__m"), F.concat(F.array(F.lit(None).cast("string")), "__m")), names, strict=True)))
    return arrays.select(key, F.posexplode(zipped).alias("pos", "p")).select(key, "pos", *(F.col("p")[n].alias(n) for n in names))


def resolve_markers(texts: DataFrame, parameters: DataFrame, key: str = "id", text: str = "text", strict: bool = True, checked: bool = True) -> DataFrame:
    """``key, resolved``: markers replaced by ``rendered`` of ``parameters(param, rendered)``; an unknown one fails the query,
    or if not ``strict`` makes the text null, and a parameter that stands twice fails it (not looked for if not ``checked``).
    Values stand as they are: see ``nested_parameters`` for those with markers.

    A blank before the marker is kept if the text so far isn't empty and doesn't end in a line end or opening bracket; one
    after it, if text follows that doesn't begin with punctuation or a closing bracket.
    """
    parameters = parameters.select(F.col("param").alias("__param"), "rendered")
    parameters = unique(parameters, "__param", what="a parameter twice") if checked else parameters
    # pieces that name none are spread, not sent to one task as nulls
    named = F.coalesce("param", F.concat(F.lit("\x1f\x1f"), F.col(key).cast("string")))
    joined = marker_pieces(texts.select(key, text), key, text).withColumn("__named", named).join(dealt(parameters), F.col("__named") == F.col("__param"), "left")
    unknown = F.col("match").isNotNull() & F.col("rendered").isNull()
    missing = F.raise_error(F.concat(F.lit("no such parameter: "), F.col("param"))) if strict else F.lit("")
    value = F.when(F.col("match").isNull(), F.lit("")).when(unknown, missing).otherwise(F.col("rendered"))
    before = F.when(F.col("literal") != "", F.right(F.col("literal"), F.lit(1))).when(F.col("earlier").isNotNull(), F.right(F.col("earlier"), F.lit(1)))
    lead = F.when(F.col("match").rlike(r"^[ \t]") & before.isNotNull() & ~before.isin("\n", "(", "["), " ").otherwise("")
    after = F.when(F.coalesce(F.col("following"), F.lit("")) != "", F.left(F.col("following"), F.lit(1))).when(F.col("more").isNotNull(), "{")
    trail = F.when(F.col("match").rlike(r"[ \t]$") & after.isNotNull() & ~after.isin(*";,.:)]"), " ").otherwise("")
    piece = F.concat("literal", F.when(F.col("match").isNull(), "").otherwise(F.concat(lead, value, trail)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    joined_pieces = F.array_join(F.transform(ordered, lambda x: x["piece"]), "")
    return joined.groupBy(key).agg(F.when(~F.bool_or(unknown), joined_pieces).alias("resolved"))


def assemble_chunks(sections: DataFrame, key: str = "id") -> DataFrame:
    """``key, chunk_id, part_path, text`` from ``key, title, pos, part, heading, prose``: a title line, then each section that
    has prose under its heading, by ``pos``; keys without any prose give no chunk."""
    used = sections.filter((F.col("part").isin("statement", "guidance")) & (F.coalesce(F.col("prose"), F.lit("")) != ""))
    parts = F.array_sort(F.collect_list(F.struct("pos", "part", F.concat("heading", F.lit(":\n"), "prose").alias("body"))))
    grouped = used.groupBy(key).agg(F.first("title").alias("title"), parts.alias("parts"))
    path = F.array_join(F.transform("parts", lambda p: p["part"]), "+")
    body = F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n")
    return grouped.select(key, F.concat(F.col(key).cast("string"), F.lit(":"), path).alias("chunk_id"), path.alias("part_path"), normal_space(F.concat("title", F.lit("\n\n"), body)).alias("text"))
