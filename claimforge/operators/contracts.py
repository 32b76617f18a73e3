"""Content contracts, compiled from nested rule tables to column expressions over VARIANT.

A contract row (required fields, types, item and part fields) is joined to its candidates by object type, a few dozen rows
that are broadcast, and every rule is an expression over that row and the parsed content: no Python, and no plan that grows
with the number of object types. A violation is (place, kind, fields); `reason` words it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimforge.functions.text import strip_space
from claimforge.rules import RuleSet

VIOLATION = "struct<place string, kind string, fields array<string>>"
#: Kinds of violations, in the order in which they are reported, and their words.
KINDS = {
    "no_contract": "content contract is missing for the object type",
    "wrong_module": "the object type is not allowed in the module",
    "missing": "missing required content fields",
    "blank": "content fields must be non-empty texts",
    "type": "invalid content field types",
    "item_object": "content item must be an object",
    "item_missing": "content item lacks fields",
    "item_type": "content item has invalid field types",
    "part_object": "part must be an object",
    "part_missing": "part lacks texts",
    "part_other": "part has unsupported fields",
    "repeats": "repeats the expression",
    "summary_only": "a summary alone is no knowledge object",
}
#: Kinds that are about no field.
ALONE = ("no_contract", "wrong_module", "item_object", "part_object", "summary_only")
#: Violations that writing the content once more can mend.
REPAIRABLE = ("missing", "type", "item_object", "item_missing", "item_type")
ROW = "object_type string, modules array<string>, required_fields array<string>, may_be_empty array<string>, not_blank array<string>, field_types array<struct<name string, type string>>, item_fields array<string>, item_types array<struct<name string, type string>>, parts array<struct<name string, fields array<string>>>, unlike array<struct<list string, field string, of string>>"


def contract_rows(rules: RuleSet) -> list[tuple]:
    """One row for each object type that has a contract."""
    homes: dict[str, list[str]] = {}
    for module, _, kind, item_only in rules.modules:
        if not item_only:
            homes.setdefault(kind, []).append(module)
    rows = []
    for kind, required, may_be_empty, _, item_fields in rules.contracts:
        shape = rules.shapes.get(kind, {})
        typed = lambda name: [(k, v) for k, v in shape.get(name, {}).items()]  # noqa: B023, E731
        rows.append((kind, homes.get(kind, []), required, may_be_empty, list(shape.get("notBlank", [])), typed("fields"), item_fields, typed("items"), typed("parts"), [tuple(x) for x in shape.get("unlike", [])]))
    return rows


def contract_rules(spark: SparkSession, rules: RuleSet) -> DataFrame:
    return spark.createDataFrame(contract_rows(rules), ROW)


#: Names of a VARIANT's types in contracts.
TYPES = {"STRING": "text", "ARRAY": "list", "OBJECT": "object"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` evaluated once however often it is used; the optimiser would write a column of its own into each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(named: Column) -> Column:
    """text, list, object, or other, of a VARIANT whose schema has this name."""
    kinds = F.create_map(*[F.lit(v) for pair in TYPES.items() for v in pair])
    return F.coalesce(F.element_at(kinds, F.split_part(named, F.lit("<"), F.lit(1))), F.lit("other"))


def is_empty(named: Column, x: Column) -> Column:
    """Null, "", [] and {} are empty; 0 and false are not. Only what may be a list of nulls is written as JSON to tell."""
    return F.when(named.isin("VOID", "OBJECT<>"), True).when(named == "STRING", F.try_variant_get(x, "$", "string") == "").when(named == "ARRAY<VOID>", F.to_json(x) == "[]").otherwise(False)


def known(x: Column) -> Column:
    """A VARIANT with its kind and whether it is empty."""
    return bound(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), lambda n: F.struct(kind_of(n).alias("kind"), is_empty(n, x).alias("empty"), x.alias("x")))


def fields_of(x: Column) -> Column:
    """The fields of a VARIANT object as `known` values; none of anything else."""
    return F.transform_values(F.coalesce(F.try_variant_get(x, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: known(v))


def items_of(field: Column) -> Column:
    """The elements of a field that is a list; none of anything else."""
    return F.coalesce(F.try_variant_get(field["x"], "$", "array<variant>"), F.array().cast("array<variant>"))


def blank(field: Column) -> Column:
    """Not a text, or one without a character that shows."""
    return F.when(field["kind"] == "text", strip_space(F.try_variant_get(field["x"], "$", "string")) == "").otherwise(True)


def text_of(field: Column) -> Column:
    return F.when(field["kind"] == "text", F.try_variant_get(field["x"], "$", "string"))


def _found(place: Column, kind: str, fields: Column) -> Column:
    return F.struct(place.alias("place"), F.lit(kind).alias("kind"), fields.alias("fields"))


def _mistyped(fields: Column, types: Column) -> Column:
    """Fields of another type than the contract names."""
    wrong = F.filter(types, lambda t: F.coalesce(F.element_at(fields, t["name"])["kind"] != t["type"], F.lit(False)))
    return F.transform(wrong, lambda t: F.concat_ws(" must be ", t["name"], t["type"]))


def _each(items: Column, place: Column, check: Callable[[Column, Column], Column]) -> Column:
    """What check(element with its kind and fields, place) finds in all elements of a list, numbered from 1."""
    elements = F.transform(items, lambda x: F.struct(kind_of(F.schema_of_variant(x)).alias("kind"), fields_of(x).alias("own")))
    return F.flatten(F.transform(elements, lambda x, i: check(x, F.concat_ws(" ", place, (i + 1).cast("string")))))


def compiled(fields: Column, module: Column, c: Callable[[str], Column]) -> Column:
    """All violations of a content's fields (`fields_of`); c(name) gives a column of the contract's row, all null where there is none.
    Each rule is evaluated once: it says what it would report, and what isn't so or names no field is taken out at the end."""
    at = lambda name: F.element_at(fields, name)
    here, none, nothing = F.lit("$"), F.array().cast("array<string>"), F.array().cast(f"array<{VIOLATION}>")
    missing = F.filter(c("required_fields"), lambda f: at(f).isNull() | (at(f)["empty"] & ~F.array_contains(c("may_be_empty"), f)))
    bare = F.filter(c("not_blank"), lambda f: F.coalesce(bound(at(f), lambda x: x.isNotNull() & blank(x)), F.lit(False)))
    held = F.get(F.filter(c("required_fields"), lambda f: F.coalesce(at(f)["kind"] == "list", F.lit(False))), F.lit(0))

    def item(x: Column, place: Column) -> Column:
        lacks = F.filter(c("item_fields"), lambda f: F.coalesce(F.element_at(x["own"], f)["empty"], F.lit(True)))
        return F.when(x["kind"] != "object", F.array(_found(place, "item_object", none))).otherwise(F.array(_found(place, "item_missing", lacks), _found(place, "item_type", _mistyped(x["own"], c("item_types")))))

    items = F.when(F.size(c("item_fields")) > 0, _each(items_of(at(held)), F.lit("item"), item)).otherwise(nothing)

    def parts(p: Column) -> Column:
        def part(x: Column, place: Column) -> Column:
            lacks = F.filter(p["fields"], lambda f: bound(F.element_at(x["own"], f), blank))
            other = F.array_sort(F.array_except(F.map_keys(x["own"]), p["fields"]))
            return F.when(x["kind"] != "object", F.array(_found(place, "part_object", none))).otherwise(F.array(_found(place, "part_missing", lacks), _found(place, "part_other", other)))

        return _each(items_of(at(p["name"])), p["name"], part)

    def unlike(u: Column) -> Column:
        texts = F.transform(items_of(at(u["of"])), lambda x: F.when(F.schema_of_variant(x) == "STRING", strip_space(F.try_variant_get(x, "$", "string"))))
        repeats = lambda x, said: F.coalesce(F.array_contains(said, text_of(F.element_at(x["own"], u["field"]))), F.lit(False))
        found = lambda said: _each(items_of(at(u["list"])), u["list"], lambda x, place: F.array(F.when(repeats(x, said), _found(place, "repeats", F.array(u["field"])))))
        return bound(F.filter(texts, lambda x: x.isNotNull() & (x != "")), found)

    rules = F.concat(
        F.array(
            F.when(~F.coalesce(F.array_contains(c("modules"), module), F.lit(False)), _found(here, "wrong_module", none)),
            _found(here, "missing", missing),
            _found(here, "blank", bare),
            _found(here, "type", _mistyped(fields, c("field_types"))),
        ),
        items,
        F.flatten(F.transform(c("parts"), parts)),
        F.flatten(F.transform(c("unlike"), unlike)),
        F.array(F.when((F.size(F.map_keys(fields)) == 1) & F.map_contains_key(fields, F.lit("summary")), _found(here, "summary_only", none))),
    )
    so = F.filter(rules, lambda v: v.isNotNull() & ((F.size(v["fields"]) > 0) | v["kind"].isin(*ALONE)))
    return F.when(c("required_fields").isNull(), F.array(_found(here, "no_contract", none))).otherwise(so)


def with_violations(candidates: DataFrame, rules: RuleSet, content: str = "content") -> DataFrame:
    """`candidates` (object_type, module and content as JSON text) with `violations`. Content that is no JSON object has no fields."""
    names = [f.name for f in T.StructType.fromDDL(ROW) if f.name != "object_type"]
    own = {n: f"__contract_{n}" for n in names}
    contracts = contract_rules(candidates.sparkSession, rules).withColumnsRenamed(own)
    met = candidates.join(F.broadcast(contracts), "object_type", "left")
    violations = bound(fields_of(F.try_parse_json(F.col(content))), lambda fields: compiled(fields, F.col("module"), lambda n: F.col(own[n])))
    return met.withColumn("violations", violations).drop(*own.values())


def reason(v: Column) -> Column:
    """A violation in words: what is wrong, where, and the fields it is about."""
    words = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), v["kind"])
    return F.concat(words, F.when(v["place"] == "$", "").otherwise(F.concat(F.lit(" ("), v["place"], F.lit(")"))), F.when(F.size(v["fields"]) == 0, "").otherwise(F.concat(F.lit(": "), F.array_join(v["fields"], ", "))))
