"""Stable ids and fingerprints: hashes of joined or canonical text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimforge.functions.json_ops import canonical_json
from claimforge.functions.text import entity_name, falsy_chain


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def short_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix-XXXX: the first hex digits of the hash of the parts joined by bars."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.left(sha(F.concat_ws("|", *parts)), F.lit(length))))


def entity_id(workspace: Column, kind: Column, name: Column) -> Column:
    return short_id("BE", 16, workspace, kind, entity_name(name))


def object_id(workspace: Column, kind: Column, identity_key: Column) -> Column:
    return short_id("KO", 16, workspace, kind, identity_key)


def relationship_id(kind: Column, source: Column, target: Column) -> Column:
    return short_id("KR", 20, kind, source, target)


def item_id(text: Column, *given: Column) -> Column:
    """The first given id that isn't empty, else twelve digits of the text's hash."""
    return falsy_chain(*given, F.left(sha(text), F.lit(12)))


def identity_key(hints_json: Column) -> Column:
    """Hash of the identity fields in canonical form."""
    return sha(canonical_json(hints_json))


def lineage_key(module: Column, kind: Column, first_anchor: Column, identity: Column) -> Column:
    return sha(F.concat_ws("|", module, kind, first_anchor, identity))


def fingerprint(*parts: Column) -> Column:
    """Hash of a struct of parts in order; nulls stand as nulls."""
    return sha(F.to_json(F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}))
