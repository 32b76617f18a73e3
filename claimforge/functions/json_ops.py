"""Dynamic JSON: canonical form, paths and recursive rewrites.

What a VARIANT expression can say stays in the JVM. Recursive walks are Arrow UDFs over whole batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Keys that refer to sources or order items instead of holding knowledge.
REFERENCE_KEYS = ("claimRef", "evidenceRefs", "factReferences", "sourceClaimIds", "sourceClaimId", "sourceRef", "evidenceRef", "elementId", "stepId", "stepOrder", "category", "type")
EVALUATION_REFERENCE_KEYS = REFERENCE_KEYS + ("anchorId", "evidence", "exactQuote")

STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]")
LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])


def canonical_json(x: Column) -> Column:
    """Key-sorted compact JSON; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(x))


def object_only(x: Column) -> Column:
    """The text if it is a JSON object, else null."""
    parsed = F.try_parse_json(x)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), x)


def is_empty_json(x: Column) -> Column:
    """Missing, null, "", [] and {} are empty; 0 and false are not."""
    return F.coalesce(F.regexp_replace(x, r"\s", "").isin("", "null", '""', "[]", "{}"), F.lit(True))


def field_json(doc: Column, name: str | Column) -> Column:
    """A field of a JSON object as JSON text; null where it is absent."""
    if isinstance(name, str):
        return F.get_json_object(F.concat(F.lit('{"v":['), F.coalesce(doc, F.lit("null")), F.lit("]}")), f"$.v[0].{name}") if "'" in name else F.to_json(F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "variant"))
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), F.concat(F.lit("$."), name), "variant"))


def keys(doc: Column) -> Column:
    return F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))


def has_any_key(doc: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(keys(doc), F.array(*[F.lit(n) for n in names]))


def walk(value, path: str, skip: frozenset, out: list) -> list:
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in skip:
                walk(v, f"{path}.{k}", skip, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", skip, out)
    elif value is not None and value != "":
        out.append((path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)))
    return out


def load(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def leaves(x: Column, skip: tuple[str, ...] = REFERENCE_KEYS) -> Column:
    """(path, value) of each leaf that holds knowledge, in document order."""
    hidden = frozenset(skip)

    @F.pandas_udf(T.ArrayType(LEAF))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "value": v} for p, v in walk(load(t), "$", hidden, [])])

    return run(x)


def at_path(value, path: str):
    for field, index in STEP.findall(path):
        if field:
            if not isinstance(value, dict) or field not in value:
                return None
            value = value[field]
        elif not isinstance(value, list) or int(index) >= len(value):
            return None
        else:
            value = value[int(index)]
    return value


def leaves_under(x: Column, paths: Column, skip: tuple[str, ...] = REFERENCE_KEYS) -> Column:
    """For each path of an array, the leaves at or below it; a path through a reference key has none."""
    hidden = frozenset(skip)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("path", T.StringType())])))
    def run(texts: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(texts, given):
            doc, rows = load(t), []
            for p in [] if ps is None else ps:
                if not isinstance(p, str) or not p.startswith("$") or any(f in hidden for f, _ in STEP.findall(p)):
                    continue
                plain = "$." + p[len("$.content.") :] if p.startswith("$.content.") else p
                rows += [{"given": p, "path": leaf} for leaf, _ in walk(at_path(doc, plain), plain, hidden, [])]
            out.append(rows)
        return pd.Series(out)

    return run(x, paths)


def differences(old, new, path: str = "$") -> list[str]:
    """Paths at which two values differ; lists compare place by place."""
    if isinstance(old, dict) and isinstance(new, dict):
        return [p for k in sorted({*old, *new}) for p in ([f"{path}.{k}"] if (k in old) != (k in new) else differences(old[k], new[k], f"{path}.{k}"))]
    if isinstance(old, list) and isinstance(new, list):
        return [p for i in range(max(len(old), len(new))) for p in ([f"{path}[{i}]"] if i >= min(len(old), len(new)) else differences(old[i], new[i], f"{path}[{i}]"))]
    return [] if type(old) is type(new) and old == new else [path]


@F.pandas_udf(T.ArrayType(T.StringType()))
def changed_paths(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([differences(load(a) or {}, load(b) or {}) for a, b in zip(old, new)])


def without(value, names: frozenset):
    if isinstance(value, dict):
        return {k: without(v, names) for k, v in value.items() if k not in names}
    return [without(v, names) for v in value] if isinstance(value, list) else value


def drop_keys(x: Column, *names: str) -> Column:
    """The JSON without the named keys, at any depth."""
    hidden = frozenset(names)

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else json.dumps(without(load(t), hidden), ensure_ascii=False, sort_keys=True, separators=(",", ":")))

    return run(x)
