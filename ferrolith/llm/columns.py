"""Adding computed columns to a table of documents, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ferrolith.llm.bytetext import Chunk, chunks, release

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def with_text_columns(
    docs: DataFrame,
    compute: Callable[[], Callable[[Chunk], dict[str, object]]],
    columns: dict[str, str],
    keep: Sequence[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """docs (or only the columns in keep) and the computed columns, which replace columns of the same names.

    compute() is called once in each task and gives a function of a Chunk of documents; that returns for each name in
    columns (name to SQL type) one value a document. A null text counts as empty. Runs per batch, without a shuffle.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in columns]
    sent = docs.select(*[docs[c] for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([f for f in sent.schema.fields if f.name in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()])

    def run(batches):
        work = compute()
        for batch in batches:
            held = batch.column(sent_names.index(text)).cast(pa.large_binary())
            parts = [work(c) for c in chunks(held)]
            new = [_joined([p[n] for p in parts], ARROW[t]) for n, t in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column(sent_names.index(n)) for n in kept_names] + new, names=[*kept_names, *columns])
            del held, parts, new, batch
        release()

    sent_names, kept_names = sent.columns, [f.name for f in schema.fields if f.name not in columns]
    return sent.mapInArrow(run, schema)


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    if parts and isinstance(parts[0], np.ndarray):
        return pa.array(np.concatenate(parts), kind)
    return pa.array([x for p in parts for x in p], kind)
