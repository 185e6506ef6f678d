"""Identifiers and orders by hash."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(value: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes; null stays null."""
    return F.sha2(value.cast("string").cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and raw UTF-8. Null fields must not occur: JSON would leave them out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def canonical_uid(prefix: str, **fields: Column) -> Column:
    return F.concat(F.lit(prefix), sha256_text(canonical_json(**fields)))


def hash_key(namespace: str, *parts: Column) -> Column:
    """The key of a deterministic order: SHA-256 of namespace and parts joined by '|'."""
    return sha256_text(F.concat_ws("|", F.lit(namespace), *[p.cast("string") for p in parts]))


def seed_of(digest: Column) -> Column:
    """The first eight bytes of a hex digest, big-endian, halved so that they fit a bigint."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftright(low, 1) + F.shiftleft(high, 31)


def digest_of(value) -> str:
    """Digest of a driver-side value: compact JSON, sorted keys, ASCII; NaN is refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def task_dataset_uid(task: Column, dataset: Column) -> Column:
    return canonical_uid("td_", dataset_id=dataset, task_id=task)


def flow_uid(flow: Column) -> Column:
    return canonical_uid("flow_", flow_id=flow)


def observation_uid_artifact(artifact: Column, namespace: str, row: Column) -> Column:
    """An observation named by the file it comes from and its row there."""
    return canonical_uid("obs_", artifact_sha256=artifact, namespace=F.lit(namespace), source_row_index=row)


def observation_uid_row(namespace: str, row: Column) -> Column:
    """An observation named by its row alone."""
    return canonical_uid("obs_", namespace=F.lit(namespace), row_index=row)


def config_id(config: dict) -> str:
    """The name of a configuration: its canonical JSON's digest."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def id_order(value: Column) -> Column:
    """Sorts identities given as text: whole numbers first, by size, then all others by their characters."""
    number = F.when(value.rlike(r"^-?\d+$"), value.cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.when(number.isNull(), value).alias("name"))
