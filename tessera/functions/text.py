"""Text expressions: identifiers, parameter markers, white space, citations, answers. All are built-in columns, no UDF.

Patterns are ASCII: ``\\d`` and letters don't match other scripts' digits or letters.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, the same wherever identifiers, markers and citations are written: the notations below, the steps of
# ``normal_space``, the words of ``slot`` and ``rendered_parameter``, and the two reasons in ``operators/answers.py``.
#: Two letters, a number and perhaps an enhancement in parentheses or after a point.
IDENTIFIER = r"^\s*([A-Za-z]{2})\s*[-_ ]?\s*(\d{1,3})\s*(?:\(\s*(\d{1,3})\s*\)|\.\s*(\d{1,3}))?\s*$"
#: A parameter marker, with the blanks around it.
MARKER = r"[ \t]*\{\{\s*insert:\s*param,\s*([^\s}]+)\s*\}\}[ \t]*"
BRACKETED = r"\[([^\[\]]+)\]"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(x: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(x, _ENDS, "")


def canonical_id(x: Column) -> Column:
    """``AC-02 (03)`` and its like as ``ac-2.3``; null if it isn't an identifier. Says nothing of whether one exists."""
    part = lambda n: F.regexp_extract(x, IDENTIFIER, n)
    extra = F.coalesce(F.nullif(part(3), F.lit("")), F.nullif(part(4), F.lit("")))
    base = F.concat(F.lower(part(1)), F.lit("-"), part(2).try_cast("int").cast("string"))
    return F.when(x.rlike(IDENTIFIER), F.concat(base, F.coalesce(F.concat(F.lit("."), extra.try_cast("int").cast("string")), F.lit(""))))


def control_of_part(x: Column) -> Column:
    """The canonical identifier before the first underscore; null without one or with nothing after it."""
    at = F.instr(x, "_")
    return F.when((at > 0) & (F.length(x) > at), canonical_id(F.substring(x, F.lit(1), at - 1)))


#: Characters whose full case folding isn't their lower case, with what they fold to, as Python's Unicode tables have it.
FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c.lower()}


def casefolded(x: Column) -> Column:
    """Full Unicode case folding, character by character: ``Straße`` and ``STRASSE`` are one."""
    folds = F.from_json(F.lit(json.dumps(FOLDS)), "map<string,string>")
    each = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)."), 0), lambda c: F.coalesce(F.try_element_at(folds, c), F.lower(c)))
    return F.when(x.rlike(r"\A[\x00-\x7f]*\z"), F.lower(x)).otherwise(F.array_join(each, ""))


def form_key(x: Column) -> Column:
    """The key of a published form: stripped and case-folded; null if nothing is left."""
    return F.nullif(casefolded(stripped(x)), F.lit(""))


def published_forms(canonical: Column) -> Column:
    """All ways in which a canonical identifier is published."""
    family, number = F.upper(F.substring_index(canonical, "-", 1)), F.regexp_extract(canonical, r"-(\d+)", 1)
    extra = F.regexp_extract(canonical, r"\.(\d+)$", 1)
    has = extra != ""
    plain = F.concat(family, F.lit("-"), number, F.when(has, F.concat(F.lit("("), extra, F.lit(")"))).otherwise(""))
    padded = F.concat(family, F.lit("-"), F.lpad(number, 2, "0"), F.when(has, F.concat(F.lit("("), F.lpad(extra, 2, "0"), F.lit(")"))).otherwise(""))
    sortable = F.concat(F.lower(family), F.lit("-"), F.lpad(number, 2, "0"), F.when(has, F.concat(F.lit("."), F.lpad(extra, 2, "0"))).otherwise(""))
    return F.array(canonical, plain, padded, sortable)


def slot(label: Column) -> Column:
    """A named blank, which says that the organization defines it."""
    named = F.lower(label).startswith("organization-defined ")
    return F.concat(F.lit("["), F.when(named, label).otherwise(F.concat(F.lit("organization-defined "), label)), F.lit("]"))


def rendered_parameter(values: Column, how_many: Column, choices: Column, label: Column, guidelines: Column) -> Column:
    """Values, else a selection, else the label, else the first guideline that says something, else a general blank.

    Choices and guidelines have no markers any more: they are stripped here, after their markers are resolved.
    """
    selection = F.concat(F.lit("[selection ("), F.replace(how_many, F.lit("-"), F.lit(" ")), F.lit("): "), F.array_join(F.transform(choices, stripped), "; "), F.lit("]"))
    selection = F.when(F.size(choices) == 0, F.lit("[organization-defined selection]")).otherwise(selection)
    said = F.transform(guidelines, lambda x: stripped(F.regexp_replace(x, r"[;. ]+\z", "")))
    advice = F.get(F.filter(said, lambda x: x != ""), F.lit(0))
    return (
        F.when(F.size(values) > 0, F.array_join(values, ", "))
        .when(choices.isNotNull(), selection)
        .when(F.coalesce(label, F.lit("")) != "", slot(label))
        .when(F.coalesce(advice, F.lit("")) != "", slot(advice))
        .otherwise(F.lit("[organization-defined value]"))
    )


def normal_space(x: Column) -> Column:
    """Single blanks, none before punctuation or at line ends, at most one empty line, nothing at the ends."""
    x = F.replace(x, F.lit("\u00a0"), F.lit(" "))
    for pattern, put in ((r"[ \t]+", " "), (r" +([;,.:])", "$1"), (r"(?m)[ \t\r\f\x0b]+$", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, put)
    return stripped(x)


def preview(x: Column, size: int = 240) -> Column:
    """One line of whole words, with dots where it is cut; dots alone where not even the first word fits."""
    line = stripped(F.regexp_replace(x, r"\s+", " "))
    cut = F.regexp_extract(F.substring(line, 1, size - 3), r"^(.*)\s\S*$", 1)
    return F.when(F.length(line) <= size, line).otherwise(F.concat(cut, F.when(cut == "", "...").otherwise(" ...")))


def checksum(x: Column) -> Column:
    """SHA-256 whatever the line ends."""
    return F.sha2(F.replace(x, F.lit("\r"), F.lit("")), 256)


def bracketed(x: Column) -> Column:
    """Array of what stands in square brackets, in order."""
    return F.regexp_extract_all(x, F.lit(BRACKETED), 1)


def answer_lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def answer_of(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def part_suffix(part: Column, name: Column) -> Column:
    """What a part is called within its control: its id after the first underscore, else its name."""
    return F.coalesce(whole_part(part), name)


def whole_part(x: Column) -> Column:
    """After the first underscore of a part's id; null if there is nothing."""
    at = F.instr(x, "_")
    return F.when((at > 0) & (F.length(x) > at), F.substring(x, at + 1, F.length(x)))


def multi_digest(*parts: Column) -> Column:
    """SHA-256 over parts, each followed by 0x1E; a null part is an empty one."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1e")))), 256)
