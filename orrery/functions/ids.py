"""Identifiers from hashes, as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def joined(*parts: Column) -> Column:
    """Parts with a separator between; a null raises, as it would silently vanish."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.raise_error(F.lit("an id part is null")).cast("string")) for p in parts])


def stable_id(namespace: str, *parts: Column) -> Column:
    """Namespace and 20 hex digits; the namespace is inside the hash."""
    return F.concat(F.lit(f"{namespace}-"), F.substring(F.sha2(joined(F.lit(namespace), *parts), 256), 1, 20))


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """The same with the prefix outside the hash."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined(*parts), 256), 1, 20))


def canonical_json(value: Column) -> Column:
    """Sorted keys and no blanks; numbers in their shortest form."""
    return F.to_json(F.parse_json(value))


def content_id(namespace: str, json: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(f"{namespace}-"), F.substring(F.sha2(canonical_json(json), 256), 1, digits))


def semantic_digest(json: Column) -> Column:
    """SHA-256 of a JSON value, whatever the order of its keys and its blanks."""
    return F.sha2(canonical_json(json), 256)


def set_digest(items: Column) -> Column:
    """semantic_digest() of a set given as an array of JSON texts: their order does not count."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(items, canonical_json)), ","), F.lit("]")), 256)


def family_id(group: Column, scene: Column, episode: Column, variant: Column) -> Column:
    """The id of a question family: from its consistency group, or else from scene, episode and variant."""
    return F.when(group != "", stable_id("family", group)).otherwise(stable_id("family", scene, episode, variant))


def request_hash(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash_rank_key(salt: str, *parts: Column) -> Column:
    """What to order by for an order that a salt fixes."""
    return F.sha2(F.concat_ws(":", F.lit(salt), *[p.cast("string") for p in parts]), 256)


def view_number(view_id: Column) -> Column:
    """1-based number of view-NNN; other forms raise."""
    n = F.regexp_extract(view_id, r"^view-(\d+)$", 1)
    return F.when(n != "", n.cast("int") + 1).otherwise(F.raise_error(F.concat(F.lit("no view id: "), view_id)).cast("int"))


def redact_paths(text: Column) -> Column:
    """Local absolute paths without their folders."""
    return F.regexp_replace(text, r"(?<![\w/])/(?:[\w.\-]+/)+([\w.\-]+)", "<path>/$1")
