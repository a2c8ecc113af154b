"""JSON contracts as column checks: a schema is compiled to expressions over a parsed payload, so contracts are data."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv

#: How the parsed payload names a JSON type, by its first letters.
KINDS = {
    "string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"],
    "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"],
}


def compile_schema(schema: dict[str, Any], definitions: dict[str, Any], value: Column, name: Column) -> Column:
    """An array of violations of one value (a variant, null if it is not there) against one schema.

    Understood: type (one or several), required, properties, items, minimum, maximum, enum and references to ``definitions``. Members
    that no schema names are allowed. A value of the wrong type is told once and not looked into.
    """
    if "$ref" in schema:
        return compile_schema(definitions[schema["$ref"].rsplit("/", 1)[-1]], definitions, value, name)
    kind = F.schema_of_variant(value)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    right = F.lit(False) if types else F.lit(True)
    for t in types:
        for k in KINDS[t]:
            right = right | kind.startswith(k)
    inner: list[Column] = []

    def told(condition: Column, text: str) -> Column:
        return F.when(condition, F.array(F.concat(name, F.lit(f": {text}")))).otherwise(F.array().cast("array<string>"))

    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        inner.append(told(number < schema["minimum"], f"below {schema['minimum']:g}"))
    if "maximum" in schema:
        inner.append(told(number > schema["maximum"], f"above {schema['maximum']:g}"))
    if "enum" in schema:
        inner.append(told(~F.try_variant_get(value, "$", "string").isin(schema["enum"]), "not one of the values"))
    for member, of in schema.get("properties", {}).items():
        held = F.try_variant_get(value, f"$.{member}", "variant")
        path = F.when(name == "", F.lit(member)).otherwise(F.concat(name, F.lit(f".{member}")))
        absent = F.array(F.concat(path, F.lit(": missing"))) if member in schema.get("required", []) else F.array().cast("array<string>")
        inner.append(F.when(held.isNull(), absent).otherwise(compile_schema(of, definitions, held, path)))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")

        def item(v: Column, i: Column) -> Column:
            return compile_schema(schema["items"], definitions, v, F.concat(name, F.lit("["), i.cast("string"), F.lit("]")))

        inner.append(F.coalesce(F.flatten(F.transform(items, item)), F.array().cast("array<string>")))
    wrong = F.array(F.concat(name, F.lit(f": not {' or '.join(types)}")))
    return F.when(~right, wrong).otherwise(F.concat(*inner) if inner else F.array().cast("array<string>"))


def check_schema(df: DataFrame, schema: dict[str, Any], definitions: dict[str, Any], payload: str = "payload") -> DataFrame:
    """Adds violations (array of "path: what is wrong", in the schema's order) and conforms. A null payload or one that is no
    JSON is "unreadable"."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(payload)))
    found = compile_schema(schema, definitions, F.col("__v"), F.lit(""))
    found = F.transform(found, lambda v: F.regexp_replace(v, "^: ", "payload: "))
    checked = parsed.withColumn("violations", F.when(F.col("__v").isNull(), F.array(F.lit("unreadable"))).otherwise(found))
    return checked.withColumn("conforms", F.size("violations") == 0).drop("__v")


def check_response(df: DataFrame, task: str, payload: str = "payload") -> DataFrame:
    """A task's answers against its contract (vqa, caption, grounding, change, fusion)."""
    return check_schema(df, fv.RESPONSE_SCHEMAS[task], fv.SCHEMA_DEFINITIONS, payload)
