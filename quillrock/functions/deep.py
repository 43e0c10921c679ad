"""Unicode NFC of every string of a table, however deep it lies."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def normalised(a: pa.Array) -> pa.Array:
    """The same array with its strings in NFC: of arrays, maps (keys too) and structs the parts are walked once a batch.

    Arrow's own normal form does not compose, so Python's makes it, of batches that are not all ASCII.
    """
    kind = a.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        if pc.all(pc.string_is_ascii(a)).as_py() in (True, None):
            return a
        return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()], kind)
    if pa.types.is_struct(kind):
        parts = [normalised(x) for x in a.flatten()]
        return pa.StructArray.from_arrays(parts, fields=[pa.field(f.name, x.type) for f, x in zip(kind, parts, strict=True)], mask=pc.is_null(a))
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        # offsets of what this batch holds, from 0; a null row is empty there
        lengths = pc.fill_null(pc.list_value_length(a) if pa.types.is_list(kind) else pa.array(np.diff(a.offsets.to_numpy()), pa.int32()), 0)
        ends = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False)))).astype(np.int32)
        starts = pa.array(ends, mask=np.append(pc.is_null(a).to_numpy(zero_copy_only=False), False))
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(starts, normalised(a.flatten()))
        first, last = (a.offsets[0].as_py(), a.offsets[len(a)].as_py()) if len(a) else (0, 0)
        if pc.any(pc.is_null(a)).as_py() and last - first != ends[-1]:
            raise ValueError("null maps that hold entries")
        return pa.MapArray.from_arrays(starts, normalised(a.keys.slice(first, last - first)), normalised(a.items.slice(first, last - first)))
    return a


def deep_nfc(df: DataFrame) -> DataFrame:
    """df with all of its strings in NFC, in one Arrow step; other values are passed through as they are."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([normalised(c) for c in b.columns], b.schema.names)

    return df.mapInArrow(run, df.schema)
