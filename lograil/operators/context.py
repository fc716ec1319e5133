"""Matching lines and those around them, where lines stand in order, without moving them.

Partitions of files hold lines in order. So a task sees most of what is around a match, and only lines at the edges of runs, which the next run's or the run before's matches may show, are looked up by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograil.shared import materialize

SHOWN, EDGE, EDGE_MATCH = 0, 1, 2


def context_in_order(lines: DataFrame, matched: Column, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines and up to 200 before and after each, with is_context; as records.with_context, and exact however lines are dealt out.

    A run is a stretch of a partition in which lines of one source follow each other. Inside runs, matches show what is around them as the lines go by. The first `after` and the last `before` lines of each run that were not
    shown, and the numbers of the matches near its edges, are the only rows that meet: so the work is small where runs are long, as they are in lines as they were read. Line numbers of a source are distinct.
    """
    if not 0 <= before <= 200 or not 0 <= after <= 200:
        raise ValueError("0 to 200 lines of context")
    names, margin = lines.columns, max(before, after)
    d = lines.withColumn("_hit", F.coalesce(matched, F.lit(False)))

    def run(batches):
        held: pa.Table | None = None
        done = at_start = 0  # rows of held that were judged already; the place of its first row in its run
        for batch in _and_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            new = [pa.Table.from_batches([batch])] if batch is not None else []
            if not new and held is None:
                return
            table = pa.concat_tables(([held] if held is not None else []) + new).combine_chunks()
            n = table.num_rows
            if not n:
                return
            source = table.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            line, hit = table.column("line_no").to_numpy(), table.column("_hit").to_numpy(zero_copy_only=False).astype(bool)
            begins = np.ones(n, bool)
            begins[1:] = (source[1:] != source[:-1]) | (line[1:] != line[:-1] + 1)
            begins[0] = at_start == 0
            place = np.arange(n)
            first = np.maximum.accumulate(np.where(begins, place, 0))
            last = np.minimum.accumulate(np.where(np.append(begins[1:], True), place, n)[::-1])[::-1]
            from_start = place - first + np.where(first == 0, at_start, 0)
            # The nearest matches of the same run.
            behind = np.maximum.accumulate(np.where(hit, place, -1))
            ahead = np.minimum.accumulate(np.where(hit, place, 2 * n)[::-1])[::-1]
            shown = hit | ((behind >= first) & (place - behind <= after)) | ((ahead <= last) & (ahead - place <= before))
            limit = n if batch is None else max(int(first[-1]), n - margin, done)  # what is behind may still be shown, or be at an edge
            judged = np.zeros(n, bool)
            judged[done:limit] = True
            to_end = last - place
            edge = judged & ~shown & ((from_start < after) | (to_end < before))
            edge_match = judged & hit & ((from_start < before) | (to_end < after))
            yield _rows(table, ((judged & shown, SHOWN), (edge, EDGE), (edge_match, EDGE_MATCH)), hit)
            keep = max(limit - after, 0)
            held, done, at_start = table.slice(keep), limit - keep, int(from_start[keep]) if keep < n else 0
            if keep < n and begins[keep]:
                at_start = 0

    def _rows(table, parts, hit):
        order = np.concatenate([np.flatnonzero(x) for x, _ in parts])
        kind = np.concatenate([np.full(x.sum(), k) for x, k in parts])
        out = table.take(pa.array(order)).drop_columns(["_hit"]).combine_chunks()
        batch = out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in out.schema], names)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(~hit[order]), pa.array(kind.astype(np.int32))], [*names, "is_context", "_kind"])

    def _and_end(batches):
        yield from batches
        yield None

    schema = T.StructType([*lines.schema.fields, T.StructField("is_context", T.BooleanType()), T.StructField("_kind", T.IntegerType())])
    found = materialize(d.mapInArrow(run, schema), "context")
    near = found.filter(F.col("_kind") == EDGE_MATCH).select("source", F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no")).distinct()
    edges = found.filter(F.col("_kind") == EDGE).join(near, ["source", "line_no"], "left_semi").withColumn("is_context", F.lit(True))
    return found.filter(F.col("_kind") == SHOWN).unionByName(edges).drop("_kind")
