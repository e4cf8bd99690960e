"""Validation of documents, given as facts, against nested schemas and against each other.

A schema is compiled to a tree of places.  One pass takes every fact along its path through the tree: it meets the conditions of its
place (type, options, pattern, length, range, number of values), and it notes which keys it shows to be there in the mappings that hold it.
One aggregation by mapping then finds required keys that are missing, always or under a condition; no keyword has a plan of its own.

Documents are checked against each other by claims: a fact defines a key of some role or uses one.  All claims of all roles are
rows of one aggregation, in which a key that is used and not defined is a finding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.documents import NAMING
from ..sources.reports import filled

FINDING = ["scope", "severity", "file", "path", "message"]
#: What JSON calls the types of values.
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


class Schema:
    """A JSON schema with references inside the same document."""

    def __init__(self, document: dict) -> None:
        self.document = document
        self._places: dict[tuple[str, ...], dict] = {}

    def at(self, place: tuple[str, ...]) -> dict:
        """The schema of a place: steps are property names, "[]" for entries of a list and "{}" for values of a mapping."""
        if place not in self._places:
            if place:
                above, step = self.at(place[:-1]), place[-1]
                inner = above.get("items") if step == "[]" else above.get("additionalProperties") if step == "{}" else above.get("properties", {}).get(step)
                self._places[place] = self.merged(inner if isinstance(inner, dict) else {})
            else:
                self._places[place] = self.merged(self.document)
        return self._places[place]

    def merged(self, schema: dict) -> dict:
        """A schema with its references followed and all parts of `allOf` in it; its own keys count first, conditions add up."""
        out, rules = dict(schema), []
        while "$ref" in out or "allOf" in out:
            parts = list(out.pop("allOf", ()))
            if (ref := out.pop("$ref", None)) is not None:
                target = self.document
                for step in filter(None, ref.removeprefix("#").split("/")):
                    target = target[step.replace("~1", "/").replace("~0", "~")]
                parts.append(target)
            for part in parts:
                if "if" in part:
                    rules.append({k: part[k] for k in ("if", "then", "else") if k in part})
                mine = {k: v for k, v in part.items() if k not in ("if", "then", "else")}
                merged = {k: {**mine[k], **out[k]} for k in ("properties",) if k in mine and k in out} | {"required": sorted({*mine.get("required", ()), *out.get("required", ())})}
                out = {**mine, **out, **{k: v for k, v in merged.items() if v}}
        if "if" in out:
            rules.append({k: out[k] for k in ("if", "then", "else") if k in out})
        return out | {"rules": [*out.get("rules", ()), *rules]}

    def walk(self, steps: list[str]) -> tuple[tuple[str, ...], list[tuple[int, tuple[str, ...], str | None]], str | None]:
        """The place of a path, the mappings on the way (how many steps lead to each, its place, the key below it), and a key that no mapping allows."""
        place, seen, k = (), [], 0
        while True:
            here = self.at(place)
            mapping = "properties" in here or isinstance(here.get("additionalProperties"), dict) or here.get("type") == "object"
            if k == len(steps):
                return place, [*seen, (k, place, None)] if mapping else seen, None
            if isinstance(here.get("items"), dict) and here.get("type", "array") == "array":
                place, k = (*place, "[]"), k + 1
            elif steps[k] in here.get("properties", {}):
                seen.append((k, place, steps[k]))
                place, k = (*place, steps[k]), k + 1
            elif isinstance(here.get("additionalProperties"), dict):
                inner = self.merged(here["additionalProperties"])
                whole = not ({"properties", "items", "additionalProperties"} & set(inner))  # a key may hold points
                place, k = (*place, "{}"), len(steps) if whole else k + 1
            else:
                return place, seen, steps[k] if here.get("additionalProperties") is False else None


def is_of(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("number", "integer"):
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, TYPES.get(kind, object))


def faults(value: object, schema: dict, merged, names_of_entries: bool = False) -> Iterator[str]:
    """What is wrong with a value at its place; the names of a list's entries stand for the list itself."""
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if kinds and not any(is_of(value, k) for k in kinds):
        yield f"is not of type {' or '.join(kinds)}"
        return
    if "const" in schema and value != schema["const"]:
        yield f"is not {json.dumps(schema['const'])}"
    if "enum" in schema and value not in schema["enum"]:
        yield "is not one of the options"
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"doesn't match {schema['pattern']}"
        if len(value) < schema.get("minLength", 0):
            yield f"is shorter than {schema['minLength']}"
        if len(value) > schema.get("maxLength", len(value)):
            yield f"is longer than {schema['maxLength']}"
    if is_of(value, "number"):
        if value < schema.get("minimum", value) or value <= schema.get("exclusiveMinimum", value - 1):
            yield "is below the range"
        if value > schema.get("maximum", value) or value >= schema.get("exclusiveMaximum", value + 1):
            yield "is above the range"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield f"has fewer than {schema['minItems']} values"
        if len(value) > schema.get("maxItems", len(value)):
            yield f"has more than {schema['maxItems']} values"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield "has a value twice"
        if isinstance(schema.get("items"), dict) and not names_of_entries:
            inner = merged(schema["items"])
            for fault in sorted({f for v in value if not isinstance(v, dict) for f in faults(v, inner, merged)}):
                yield f"has a value that {fault}"
    for several in ("anyOf", "oneOf"):
        if several in schema:
            right = sum(not any(faults(value, merged(s), merged)) for s in schema[several])
            if right == 0 or several == "oneOf" and right > 1:
                yield "fits none of the alternatives" if right == 0 else "fits several alternatives"


def checked(schema: Schema, path: str, text: str) -> tuple[list[tuple[str, str]], list[tuple]]:
    """(path, message) of what is wrong with a fact, and (mapping's path, its place, key, value) of what it shows to be there."""
    value, steps = json.loads(text), path.split(".") if path else []
    place, seen, unknown = schema.walk(steps)
    if unknown is not None:
        return [(path, f"{unknown} isn't declared")], [(".".join(steps[:k]), "/".join(p), key, None) for k, p, key in seen]
    here = schema.at(place)
    inner = schema.merged(here["items"]) if isinstance(here.get("items"), dict) else {}
    named = isinstance(value, list) and bool(value) and "properties" in inner
    wrong = [(path, m) for m in faults(value, here, schema.merged, named)]
    shown = [(".".join(steps[:k]), "/".join(p), key, text if k == len(steps) - 1 else None) for k, p, key in seen if key is not None or isinstance(value, dict)]
    if named:  # entries are called by their naming key, which is no fact of its own
        field = next((f for f in NAMING if f in inner["properties"]), None)
        for name in value if field else ():
            entry = f"{path}.{name}" if path else str(name)
            wrong += [(f"{entry}.{field}", m) for m in faults(name, schema.merged(inner["properties"][field]), schema.merged)]
            shown.append((entry, "/".join((*place, "[]")), field, json.dumps(name)))
    return wrong, shown


def _stem(file: Column) -> Column:
    return F.regexp_extract(file, r"^([^.]+)", 1)


def conditions(schema: Schema) -> Iterator[tuple[str, str, list[str] | None, list[str]]]:
    """(place, key, its values or None for always, keys that are then required) of every mapping of a schema, each once."""
    todo, seen = [()], set()
    while todo:
        place = todo.pop()
        here = schema.at(place)
        mark = json.dumps(here, sort_keys=True, default=str)
        if len(place) > 40 or (mark, place[-1:]) in seen and len(place) > 8:  # a schema within itself
            continue
        seen.add((mark, place[-1:]))
        if here.get("required"):
            yield "/".join(place), "", None, list(here["required"])
        for rule in here["rules"]:
            for key, test in rule["if"].get("properties", {}).items():
                values = [json.dumps(v) for v in test.get("enum", [test["const"]] if "const" in test else [])]
                if values and rule.get("then", {}).get("required"):
                    yield "/".join(place), key, values, list(rule["then"]["required"])
        todo += [(*place, k) for k in here.get("properties", {})]
        todo += [(*place, "[]")] if isinstance(here.get("items"), dict) else []
        todo += [(*place, "{}")] if isinstance(here.get("additionalProperties"), dict) else []


def validate(facts: DataFrame, schemas: dict[str, dict], files: tuple[str, ...] = ()) -> DataFrame:
    """scope, severity (error), file, path and message of all that is wrong in facts(scope, file, fact, value), by file names without their ending.

    files are those that every scope must have.  Conditions of the form "if a key has one of these values, then others are required" are known.
    """
    spark, compiled = facts.sparkSession, {name: Schema(s) for name, s in schemas.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scope, file, stem, fact, value in frame.itertuples(index=False):
                wrong, shown = checked(compiled[stem], fact, value)
                rows += [(scope, file, stem, "wrong", p, None, m, None) for p, m in wrong]
                rows += [(scope, file, stem, "shown", at, place, key, text) for at, place, key, text in shown]
            yield pd.DataFrame(rows, columns=["scope", "file", "stem", "kind", "path", "place", "text", "value"])

    known = facts.where("fact IS NOT NULL").select("scope", "file", _stem(F.col("file")).alias("stem"), "fact", "value")
    met = known.where(F.col("stem").isin(sorted(schemas))).mapInPandas(run, "scope string, file string, stem string, kind string, path string, place string, text string, value string")
    # one aggregation: a mapping's keys, which the schema bounds, and the wrong values, which are rows of their own
    key = ["scope", "file", "stem", "kind", "path", "place", F.when(F.col("kind") == "wrong", F.col("text")).alias("message")]
    met = met.groupBy(*key).agg(F.collect_set(F.when(F.col("kind") == "shown", F.col("text"))).alias("keys"), F.collect_set(F.when((F.col("kind") == "shown") & F.col("value").isNotNull(), F.concat("text", F.lit("="), "value"))).alias("values"))
    asked = [(name, place, k, values, wanted) for name, s in compiled.items() for place, k, values, wanted in conditions(s)]
    rules = spark.createDataFrame(asked, "stem string, place string, `if` string, options array<string>, wanted array<string>")
    ruled = met.where("kind = 'shown'").join(F.broadcast(rules), ["stem", "place"])  # a row for each mapping of a schema
    holds = F.col("options").isNull() | F.exists("options", lambda o: F.array_contains("values", F.concat("if", F.lit("="), o)))
    missing = ruled.where(holds).select("scope", "file", "path", F.explode(F.array_except("wanted", "keys")).alias("k"), "if", "options")
    says = F.when(F.col("options").isNull(), "is missing").otherwise(F.concat(F.lit("is missing with this "), "if"))
    missing = missing.select("scope", "file", F.concat_ws(".", F.nullif("path", F.lit("")), "k").alias("path"), says.alias("message"))
    found = met.where("kind = 'wrong'").select("scope", "file", "path", "message").unionByName(missing)
    if files:
        have = facts.groupBy("scope").agg(F.collect_set(F.when(_stem(F.col("file")).isin(list(files)), _stem(F.col("file")))).alias("have"))
        gone = have.select("scope", F.explode(F.array_except(F.array(*map(F.lit, files)), "have")).alias("file"), F.lit("").alias("path"), F.lit("the file is missing").alias("message"))
        found = found.unionByName(gone)
    return found.select("scope", F.lit("error").alias("severity"), "file", "path", "message").distinct()


@dataclass(frozen=True)
class Claim:
    """Facts of a file whose path matches define or use a key of a role; {v} is the fact's value (each of a list), {1} a group of the path.

    values narrow it to facts with one of these values, or with unlike=True to all others.  A use that no fact of its scope defines is a finding.
    """

    role: str
    kind: str  # "defines" or "uses"
    file: str
    path: str
    key: str
    message: str = ""
    severity: str = "error"
    values: tuple[str, ...] = ()
    unlike: bool = False


#: What the documents of a report say about each other.
REPORT_CLAIMS: tuple[Claim, ...] = (
    Claim("field", "defines", "report", r"fields\.([^.]+)\..+", "{1}"),
    Claim("field", "uses", "report", r"sections\.([^.]+)\.fields", "{v}", "a section names a field that isn't defined"),
    Claim("field", "uses", "lineage", r"fields\.([^.]+)\..+", "{1}", "lineage names a field that isn't defined"),
    Claim("placed", "defines", "report", r"sections\.([^.]+)\.fields", "{v}"),
    Claim("placed", "uses", "report", r"fields\.([^.]+)\.type", "{1}", "the field stands in no section"),
    Claim("traced", "defines", "lineage", r"fields\.([^.]+)\..+", "{1}"),
    Claim("traced", "uses", "report", r"fields\.([^.]+)\.type", "{1}", "the field has no lineage"),
    Claim("column", "defines", "lineage", r"fields\.([^.]+)\.column", "{1}"),
    Claim("column", "uses", "lineage", r"fields\.([^.]+)\.status", "{1}", "a mapped field names no column", values=("proposed", "verified")),
    Claim("mapped", "defines", "lineage", r"fields\.([^.]+)\.status", "{1}", values=("unmapped",), unlike=True),
    Claim("mapped", "uses", "lineage", r"fields\.([^.]+)\.column", "{1}", "an unmapped field names a column"),
    Claim("table", "defines", "lineage", r"table\..+", "table"),
    Claim("table", "uses", "lineage", r"fields\.([^.]+)\.column", "table", "columns are named, but no table"),
    Claim("source", "defines", "lineage", r"source\..+", "source"),
    Claim("source", "uses", "lineage", r"table\..+", "source", "a table is named, but no data source", "warn"),
    Claim("parameter", "defines", "report", r"report\.parameters", "{v}"),
    Claim("parameter", "uses", "lineage", r"parameters\.([^.]+)", "{1}", "lineage binds a parameter that isn't declared"),
    Claim("parameter", "uses", "manifest", r"parameters\.([^.]+)\..+", "{1}", "the manifest has a parameter that isn't declared"),
    Claim("query", "defines", "lineage", r"queries\.([^.]+)\..+", "lineage:queries.{1}"),
    Claim("query", "uses", "manifest", r"parameters\.([^.]+)\.universe", "{v}", "a parameter's universe is no query of the lineage"),
    Claim("id", "defines", "report", r"report\.id", "{v}"),
    Claim("id", "uses", "manifest", "template_id", "{v}", "the manifest is of another report"),
    Claim("version", "defines", "provenance", r"template\.version", "{v}"),
    Claim("version", "uses", "manifest", "version", "{v}", "the manifest's version isn't the template's"),
    Claim("input", "defines", "provenance", "source_reports", "{v}"),
    Claim("input", "uses", "provenance", r"runs\.([^.]+)\.inputs", "{v}", "a run used an unknown source"),
)


def unmet(facts: DataFrame, claims: tuple[Claim, ...] = REPORT_CLAIMS, needed: dict[str, str] | None = None) -> DataFrame:
    """scope, severity, file, path and message for each key of a role that is used and not defined, at the first place that uses it.

    needed names a file by role: the role's uses count only in scopes that have the file.
    """
    listed, scalar = F.from_json("value", "array<string>"), F.when(F.startswith("value", F.lit('"')), F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]")).otherwise(F.col("value"))
    texts = F.when(F.startswith("value", F.lit("[")), listed).otherwise(F.array(scalar))
    rows = facts.where("fact IS NOT NULL").select("scope", F.lit(None).cast("string").alias("report"), F.lit(None).cast("string").alias("source"), "file", _stem(F.col("file")).alias("stem"), "fact", F.explode_outer(texts).alias("text"))
    step, groups = F.split("fact", r"\.")[0], {}
    for c in claims:
        meets = F.col("fact").rlike(f"^{c.path}$")
        if c.values:
            among = F.coalesce(F.col("text").isin(list(c.values)), F.lit(False))
            meets = meets & (~among if c.unlike else among)
        uses = c.kind == "uses"
        made = F.struct(F.lit(c.role).alias("role"), filled(c.key, c.path).alias("key"), F.lit(not uses).alias("defines"), F.lit(c.message).alias("message"), F.lit(c.severity).alias("severity"))
        groups.setdefault((c.file, re.match(r"\w*", c.path)[0]), []).append(F.when(meets, made))
    made = None
    for (file, first), parts in groups.items():
        mine = (F.col("stem") == file) & (step == first)
        made = F.when(mine, F.array(*parts)) if made is None else made.when(mine, F.array(*parts))
    stated = rows.select("scope", "file", "fact", F.explode(F.array_compact(made)).alias("c")).select("scope", "file", "fact", "c.*").where("key IS NOT NULL")
    use = F.when(~F.col("defines"), F.struct("file", "fact", "message", "severity"))
    found = stated.groupBy("scope", "role", "key").agg(F.max("defines").alias("defined"), F.min(use).alias("use")).where("NOT defined")
    if needed:
        have = facts.groupBy("scope").agg(F.collect_set(_stem(F.col("file"))).alias("have"))  # a report's few files
        ask = F.create_map(*[F.lit(x) for kv in needed.items() for x in kv])[F.col("role")]
        found = found.join(have, "scope").where(ask.isNull() | F.array_contains("have", ask))
    return found.select("scope", "use.severity", "use.file", F.col("use.fact").alias("path"), F.concat("use.message", F.lit(": "), "key").alias("message"))
