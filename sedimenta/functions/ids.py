"""Content hashes, identities and pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of an object of fixed shape, keys in sorted order, nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(kind: Column, origin: Column, payload: Column, parents: Column | None = None) -> Column:
    """sha256 over {kind, origin, parent_hashes, payload}; parents sorted, empty as null."""
    sorted_ = F.when(F.size(parents) > 0, F.array_sort(parents)) if parents is not None else F.lit(None).cast("array<string>")
    body = canonical_json(kind=kind, origin=origin, payload=payload, parent_hashes=sorted_)
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("entity:"), F.sha2(F.concat_ws("|", F.lower(F.trim(name)), kind), 256))


def entity_id_v2(name: Column, disambiguator: Column) -> Column:
    return F.concat(F.lit("entity:v2:"), F.sha2(F.concat_ws("|", F.lower(F.trim(name)), disambiguator.cast("string")), 256))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def cluster_id(members: Column) -> Column:
    return F.concat(F.lit("cluster:"), F.sha2(F.array_join(F.array_sort(members), "\n"), 256))
