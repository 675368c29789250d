"""Rows of a stream packed by their key, many in one, for operators that keep them as state: a state has then one row for each
batch and key, with the others' columns as compressed Arrow bytes. Both ways work on one batch alone, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

def pack(df: DataFrame, by: list[str], most: int = 100_000) -> DataFrame:
    """The columns of ``by``, and ``packed``: the other columns of rows that are equal in these. A task gathers about so many rows at most
    before it packs them."""
    rest = [c for c in df.columns if c not in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for c in by:
            told = pc.rank(t[c], sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (told.max(initial=0) + 1) + told, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        ends = np.flatnonzero(np.diff(code[order], append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        rows, opts = t.select(rest).take(pa.array(order)), pa.ipc.IpcWriteOptions(compression="zstd")
        blobs = []
        for a, z in zip(starts, ends, strict=True):
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rows.schema, options=opts) as out:
                out.write_table(rows.slice(a, z - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        keys = t.select(by).take(pa.array(order[starts]))
        return pa.RecordBatch.from_arrays([*[keys[c].combine_chunks() for c in by], pa.array(blobs, pa.binary())], [*by, "packed"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in by], "packed binary"]))


def unpack(df: DataFrame, columns: str) -> DataFrame:
    """The rows of ``packed``, which has ``columns``, each with the other columns of its row."""
    other = [c for c in df.columns if c != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in enumerate(b.column("packed")):
                rows = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
                for part in rows.to_batches():
                    same = [b.column(c).take(pa.array(np.full(part.num_rows, i))) for c in other]
                    yield pa.RecordBatch.from_arrays([*same, *part.columns], [*other, *part.schema.names])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in other], columns]))


def counts(key: str, columns: str):
    """A function of lists of packs, which gives each list's different rows, of ``key`` and ``columns``, with how often they are in it as
    ``quantity``: a row for each key, with the others as its ``lines``. It leaves a row's other columns as they are, and so a watermark on them."""

    def run(packs: pa.Array) -> pa.Array:
        each = []
        for blobs in packs:
            t = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs.values])
            t = t.group_by(t.column_names, use_threads=False).aggregate([([], "count_all")]).rename_columns([*t.column_names, "quantity"])
            t = t.sort_by(key.split()[0]).combine_chunks()
            keys = t[key.split()[0]].combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1])
            lines = t.drop_columns([key.split()[0]]).to_struct_array().combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(t)], pa.int32()), lines)
            each.append(pa.StructArray.from_arrays([keys.take(pa.array(starts)), lists], [key.split()[0], "lines"]))
        ends = np.cumsum([0, *[len(x) for x in each]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(each))

    return F.arrow_udf(run, f"array<struct<{key.replace(' ', ': ')}, lines: array<struct<{', '.join(c.replace(' ', ': ') for c in columns.split(', '))}, quantity: bigint>>>>")
