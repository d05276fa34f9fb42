"""Merge-patches of JSON texts (RFC 7396), to any depth."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(target, patch):
    """Members of an object patch replace those of the target, null removes, objects merge; anything else replaces all."""
    if not isinstance(patch, dict):
        return patch
    result = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            result.pop(key, None)
        else:
            result[key] = merged(result.get(key), value)
    return result


def merge_patch(target: Column, patch: Column) -> Column:
    """The patched JSON text, members in the target's order and new ones after them.

    A null patch leaves the target as it is; a null target is an empty object. A text that is no JSON is an error.
    """
    @F.arrow_udf("string")
    def apply(targets: pa.Array, patches: pa.Array) -> pa.Array:
        out = []
        for old, new in zip(targets.to_pylist(), patches.to_pylist(), strict=True):
            if new is None:
                out.append(old)
            else:
                value = merged(None if old is None else json.loads(old), json.loads(new))
                out.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    return apply(target, patch)
