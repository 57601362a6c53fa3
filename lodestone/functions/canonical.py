"""Canonical JSON and the identities derived from it: of the plan's records, on the driver, and of tables' rows, as column expressions."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> bytes:
    """Compact JSON: the order of mappings as given (records in declared order, maps sorted by the caller)."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def sha256_id(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def digest_record(identity: str) -> dict[str, str]:
    algorithm, _, value = identity.partition(":")
    if algorithm != "sha256" or len(value) != 64 or set(value.lower()) - set("0123456789abcdef"):
        raise ValueError(f"not a sha256 identity: {identity!r}")
    return {"algorithm": algorithm, "value": value.lower()}


def ordered(value: Any) -> Any:
    """Free-form JSON with the keys of every object in order."""
    if isinstance(value, dict):
        return {k: ordered(value[k]) for k in sorted(value)}
    return [ordered(x) for x in value] if isinstance(value, list) else value


def artifact_manifest(content: str, kind: str, media_type: str | None = None, schema: str | None = None, format_version: str | None = None, annotations: dict[str, str] | None = None) -> bytes:
    record: dict[str, Any] = {"version": 1, "content": digest_record(content), "kind": kind}
    if media_type is not None:
        record["media_type"] = media_type
    if schema is not None:
        record["schema"] = digest_record(schema)
    if format_version is not None:
        record["format_version"] = format_version
    if annotations:
        record["annotations"] = ordered(annotations)
    return canonical_json(record)


def artifact_id(content: str, kind: str, **fields: Any) -> str:
    return sha256_id(artifact_manifest(content, kind, **fields))


def receipt_id(receipt: dict[str, Any]) -> str:
    """The identity of a receipt: all declared fields but receipt_id, in declared order."""
    fields = ("schema", "producer", "activity", "environment", "inputs", "outputs", "command", "diagnostics", "started_at", "finished_at", "payload")  # fixed order
    return sha256_id(canonical_json({f: receipt.get(f) for f in fields}))


def requirement_hash(reference: str, include: list[str], exclude: list[str], **more: Any) -> str:
    return sha256_id(canonical_json({"reference": reference, "selection": {"include": include, "exclude": exclude}} | ordered(more)))


# ---------------------------------------------------------------- as columns


def quoted(text: Column | str) -> Column:
    """JSON text of a string: quotes, backslashes and all control characters below U+0020 escaped, the short way where there is one."""
    c = F.col(text) if isinstance(text, str) else text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"')):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    whole = c
    for code in range(0x20):
        whole = F.replace(whole, F.lit(chr(code)), F.lit(short.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike("[\\x00-\\x1f]"), whole).otherwise(c), F.lit('"'))


def digest_json(identity: Column | str) -> Column:
    c = F.col(identity) if isinstance(identity, str) else identity
    return F.concat(F.lit('{"algorithm":"sha256","value":"'), F.substring_index(c, ":", -1), F.lit('"}'))


def object_json(**fields: Column) -> Column:
    """A JSON object of fields in the order given, each JSON text."""
    parts = [F.concat(F.lit(("," if i else "") + json.dumps(k) + ":"), v) for i, (k, v) in enumerate(fields.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def list_json(values: Column, item=quoted) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, item), ","), F.lit("]"))


def map_json(values: Column, item=quoted) -> Column:
    """A map as an object, by key."""
    pairs = F.array_sort(F.map_keys(values))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda k: F.concat(quoted(k), F.lit(":"), item(F.element_at(values, k)))), ","), F.lit("}"))


def hashed(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def receipt_ids(**fields: Column) -> Column:
    """``receipt_id`` of rows: fields are JSON text; those that are left out are null."""
    order = ("schema", "producer", "activity", "environment", "inputs", "outputs", "command", "diagnostics", "started_at", "finished_at", "payload")  # fixed order
    return hashed(object_json(**{f: F.coalesce(fields[f], F.lit("null")) if f in fields else F.lit("null") for f in order}))


def requirement_hashes(reference: Column, include: Column, exclude: Column) -> Column:
    """``requirement_hash`` of rows."""
    return hashed(object_json(reference=quoted(reference), selection=object_json(include=list_json(include), exclude=list_json(exclude))))


def action_keys(command: Column, inputs: Column, code: Column, parameters: Column, variables: Column, outputs: Column, network: Column, sandbox: Column, platform: Column) -> Column:
    """Keys of actions as rows: maps of identities, parameters and outputs as canonical JSON text (null: none), platform or null."""
    text = lambda c: F.coalesce(quoted(c), F.lit("null"))
    return hashed(object_json(version=F.lit("1"), command=list_json(command), inputs=map_json(inputs, digest_json), code=map_json(code, digest_json), parameters=F.coalesce(parameters, F.lit("null")), environment=object_json(variables=map_json(variables)), outputs=outputs, network=text(network), sandbox=text(sandbox), platform=text(platform)))
