"""What a nested schema asks for, as rows: path, type, required, options."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, type string, required boolean, options string, pattern string, depends string"

#: Paths that a schema may ask for (they are gathered as one array).
MOST_PATHS = 1 << 14


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    """A schema with its reference into the same document (#/a/b) followed, its own keys first, and the references on the way to it."""
    while "$ref" in schema:
        ref = schema["$ref"]
        own = {k: v for k, v in schema.items() if k != "$ref"}
        if ref in seen:  # a schema within itself: its inner part is as above
            return own or {"type": "object"}, seen
        target = root
        for step in ref.removeprefix("#").strip("/").split("/"):
            target = target[step.replace("~1", "/").replace("~0", "~")] if step else target
        schema, seen = {**target, **own}, (*seen, ref)
    return schema, seen


def flatten(schema: dict, path: str = "", required: bool = True, depends: str | None = None, root: dict | None = None, seen: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Rows of a JSON schema (a small document): objects by property, arrays by [], maps by {}; `if` names what a branch depends on.

    References within the document are followed, each once on a way, so a schema that holds itself ends there.
    """
    root = schema if root is None else root
    schema, seen = _resolved(schema, root, seen)
    kind = schema.get("type", "object" if "properties" in schema else "any")
    if path:
        yield path, kind, required, ",".join(map(str, schema.get("enum", ()))) or None, schema.get("pattern"), depends
    step = f"{path}." if path else ""
    wanted = set(schema.get("required", ()))
    for name, sub in schema.get("properties", {}).items():
        yield from flatten(sub, f"{step}{name}", required and name in wanted, depends, root, seen)
    if isinstance(schema.get("items"), dict):
        yield from flatten(schema["items"], f"{path}[]", required, depends, root, seen)
    if isinstance(schema.get("additionalProperties"), dict):
        yield from flatten(schema["additionalProperties"], f"{path}{{}}", required, depends, root, seen)
    if "then" in schema:
        when = ", ".join(f"{k}={v.get('const', v.get('enum'))}" for k, v in schema.get("if", {}).get("properties", {}).items())
        for name in schema["then"].get("required", ()):
            yield f"{step}{name}", "any", True, None, None, when


def requirements(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame(list(flatten(schema)), ROWS)


def missing(facts: DataFrame, required: DataFrame) -> DataFrame:
    """scope and path of required(path) that facts(scope, fact) lack: neither the path nor anything below it is there.

    The paths of a schema are few (MOST_PATHS at most, else an error), so a scope's present ones are one bounded set.
    """
    wanted = required.where("required AND depends IS NULL AND NOT contains(path, '[]') AND NOT contains(path, '{}')").select("path").distinct()
    paths = [r.path for r in wanted.limit(MOST_PATHS + 1).collect()]
    if len(paths) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} required paths")
    steps = F.split("fact", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))
    asked = F.array(*map(F.lit, paths)).cast("array<string>")
    found = facts.select("scope", F.explode_outer(F.array_intersect(above, asked)).alias("path"))
    have = found.groupBy("scope").agg(F.collect_set("path").alias("have"))
    return have.select("scope", F.explode(F.array_except(asked, "have")).alias("path"))
