"""JSON Schema as column expressions: a schema is compiled once, in the driver, to an expression over a VARIANT that gives
the places at which a value breaks it. Nothing but Spark's own functions runs in tasks.

Problems are named by the keyword that is broken; places are JSON pointers. A keyword that can't be compiled is an error,
so that no rule is passed over in silence.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBLEM = "array<struct<path:string,problem:string>>"

#: Keywords that say nothing about validity; formats are notes unless a reader decides otherwise.
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, null or number; null for what is missing."""
    known = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    kinds = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)), F.when(value.isNotNull(), "number"))


def member(value: Column, name: str) -> Column:
    """The member of an object, null if it has none or is no object."""
    quote = "'" if '"' in name else '"'
    if quote in name:
        raise ValueError(f"a name with both quotes can't be a path: {name}")
    return F.variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def elements(value: Column) -> Column:
    """The elements of an array, else null."""
    return F.when(kind_of(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def members(value: Column) -> Column:
    """The members of an object as a map, else null."""
    return F.when(kind_of(value) == "object", F.try_variant_get(value, "$", "map<string,variant>"))


def _pointer(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    """schema with its reference into the same file followed."""
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#"):
            raise ValueError(f"only references within the schema can be compiled: {ref}")
        if ref in seen:
            raise ValueError(f"a schema that holds itself can't be compiled: {ref}")
        found = root
        for part in ref[1:].split("/")[1:]:
            found = found[part.replace("~1", "/").replace("~0", "~")]
        if found is True or found is False:
            found = {} if found else {"not": {}}
        rest = {k: v for k, v in schema.items() if k != "$ref" and k not in NOTES}
        seen, schema = (*seen, ref), {"allOf": [found, rest]} if rest else found
    return schema, seen


def _equals(value: Column, kind: Column, wanted: object) -> Column:
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return (kind == "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _problems(value: Column, schema: dict | bool, path: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """The problems of a value; none if it is missing. The value and its kind are held by an array of one, so that they are
    read once however many keywords ask for them."""
    held = F.array(F.struct(value.alias("value"), kind_of(value).alias("kind")))
    return F.flatten(F.transform(F.filter(held, lambda x: x["kind"].isNotNull()), lambda x: _of_kind(x["value"], x["kind"], schema, path, root, seen)))


def _of_kind(value: Column, kind: Column, schema: dict | bool, path: Column, root: dict, seen: tuple[str, ...]) -> Column:
    none = F.array().cast(PROBLEM)
    if schema is True:
        return none
    one = lambda at, name: F.struct(at.alias("path"), F.lit(name).alias("problem"))
    if schema is False:
        return F.array(one(path, "false"))
    schema, seen = _resolved(schema, root, seen)
    singles, deeper = [], []
    array = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>"))
    fields = F.when(kind == "object", F.try_variant_get(value, "$", "map<string,variant>"))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    whole = (kind == "number") & (number == F.floor(number))

    def broken(keyword: str, condition: Column, at: Column = path) -> None:
        singles.append(F.when(condition, one(at, keyword)))

    bounds = {"minimum": number.__lt__, "maximum": number.__gt__, "exclusiveMinimum": number.__le__, "exclusiveMaximum": number.__ge__}
    lengths = {"minLength": F.length(text).__lt__, "maxLength": F.length(text).__gt__}
    sizes = {"minItems": F.size(array).__lt__, "maxItems": F.size(array).__gt__}
    counts = {"minProperties": F.size(fields).__lt__, "maxProperties": F.size(fields).__gt__}
    for keyword, wanted in schema.items():
        if keyword == "type":
            kinds = [wanted] if isinstance(wanted, str) else wanted
            fits = kind.isin([k for k in kinds if k != "integer"]) if set(kinds) != {"integer"} else F.lit(False)
            broken("type", ~(fits | (whole if "integer" in kinds else F.lit(False))))
        elif keyword == "enum":
            fits = F.lit(False)
            for x in wanted:
                fits = fits | F.coalesce(_equals(value, kind, x), F.lit(False))
            broken("enum", ~fits)
        elif keyword == "const":
            broken("const", ~F.coalesce(_equals(value, kind, wanted), F.lit(False)))
        elif keyword in bounds:
            broken(keyword, (kind == "number") & bounds[keyword](F.lit(float(wanted))))
        elif keyword in lengths:
            broken(keyword, (kind == "string") & lengths[keyword](F.lit(int(wanted))))
        elif keyword in sizes:
            broken(keyword, (kind == "array") & sizes[keyword](F.lit(int(wanted))))
        elif keyword in counts:
            broken(keyword, (kind == "object") & counts[keyword](F.lit(int(wanted))))
        elif keyword == "pattern":
            broken("pattern", (kind == "string") & ~text.rlike(wanted))
        elif keyword == "uniqueItems":
            if wanted:
                texts = F.transform(array, lambda x: F.to_json(x))
                broken("uniqueItems", F.size(F.array_distinct(texts)) < F.size(texts))
        elif keyword == "required":
            for name in wanted:
                broken("required", (kind == "object") & member(value, name).isNull(), F.concat(path, F.lit(_pointer(name))))
        elif keyword == "properties":
            for name, inner in wanted.items():
                deeper.append(F.when(kind == "object", _problems(member(value, name), inner, F.concat(path, F.lit(_pointer(name))), root, seen)))
        elif keyword == "additionalProperties":
            others = F.map_filter(fields, lambda k, _: ~k.isin(list(schema.get("properties", {}))))
            at = lambda k: F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
            if wanted is False:
                deeper.append(F.transform(F.map_keys(others), lambda k: one(at(k), "additionalProperties")))
            elif wanted is not True:
                deeper.append(F.flatten(F.transform(F.map_entries(others), lambda e: _problems(e["value"], wanted, at(e["key"]), root, seen))))
        elif keyword == "items":
            deeper.append(F.flatten(F.transform(array, lambda x, i: _problems(x, wanted, F.concat(path, F.lit("/"), i.cast("string")), root, seen))))
        elif keyword == "allOf":
            deeper += [_problems(value, inner, path, root, seen) for inner in wanted]
        elif keyword in ("anyOf", "oneOf"):
            fits = sum(((F.size(_problems(value, inner, path, root, seen)) == 0).cast("int") for inner in wanted), F.lit(0))
            broken(keyword, fits == 0 if keyword == "anyOf" else fits != 1)
        elif keyword == "not":
            broken("not", F.size(_problems(value, wanted, path, root, seen)) == 0)
        elif keyword not in NOTES:
            raise ValueError(f"a keyword that can't be compiled: {keyword}")
    found = F.filter(F.array(*singles), lambda x: x.isNotNull()) if singles else none
    return F.concat(found.cast(PROBLEM), *[F.coalesce(d.cast(PROBLEM), none) for d in deeper])


def schema_problems(value: Column, schema: dict | bool) -> Column:
    """Where a VARIANT breaks a schema, as an array of (path, problem); null for a null value. Members that are null are
    there: only type, enum and const say whether they may be."""
    return F.when(value.isNotNull(), _problems(value, schema, F.lit(""), schema if isinstance(schema, dict) else {}, ()))


#: Members that don't count as content, and the length from which a summary says something.
METADATA = ["citation", "citations", "line_number", "line_numbers"]
LEAST_SUMMARY = 20


def holds_something(value: Column) -> Column:
    """Whether a value is neither missing, null, blank nor empty."""
    kind = kind_of(value)
    return F.coalesce(
        F.when(kind == "null", False).when(kind == "string", F.trim(F.try_variant_get(value, "$", "string")) != "")
        .when(kind == "array", F.size(elements(value)) > 0).when(kind == "object", F.size(members(value)) > 0).otherwise(kind.isNotNull()),
        F.lit(False),
    )


def entries_say_something(value: Column) -> Column:
    """Whether an array has an element that holds something, objects by their members other than METADATA."""
    by_member = lambda x: F.exists(F.map_entries(members(x)), lambda e: ~e["key"].isin(METADATA) & holds_something(e["value"]))
    return F.coalesce(F.exists(elements(value), lambda x: F.when(kind_of(x) == "object", by_member(x)).otherwise(holds_something(x))), F.lit(False))


def members_say_something(value: Column) -> Column:
    """Whether an object has a member that says something: arrays by their elements. Names that begin with _ don't count."""
    told = lambda x: F.when(kind_of(x) == "array", entries_say_something(x)).otherwise(holds_something(x))
    return F.coalesce(F.exists(F.map_entries(members(value)), lambda e: ~e["key"].startswith("_") & told(e["value"])), F.lit(False))


def section_is_documented(value: Column, section: str) -> Column:
    """Whether the section of a document (a path of names between dots) says enough: a purpose by the length of its summary,
    a text by its own, an array by its entries, an object by its members; any other value does if it is not null."""
    for name in section.split("."):
        value = member(value, name)
    long_enough = lambda x: F.length(F.trim(F.try_variant_get(x, "$", "string"))) >= LEAST_SUMMARY
    kind = kind_of(value)
    if section.rsplit(".", 1)[-1] == "purpose":
        summary = member(value, "summary")
        return F.coalesce((kind == "object") & (kind_of(summary) == "string") & long_enough(summary), F.lit(False))
    return F.coalesce(
        F.when(kind == "array", entries_say_something(value)).when(kind == "object", members_say_something(value)).when(kind == "string", long_enough(value)).otherwise(kind != "null"), F.lit(False)
    )
