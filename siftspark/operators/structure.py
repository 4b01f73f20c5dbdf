"""Containment of places in nested intervals, by one merge over sorted rows: a stack-tree join.

Intervals of one path nest or lie apart, as syntax nodes do. Rows of a path come sorted by place; the stack holds the
intervals open there, so that a row costs its own answers and nothing for the rest of the file. Rows of a path stream
through one task, which keeps the open intervals alone: a file of any size takes linear time and the memory of its
depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enclosing(places: DataFrame, intervals: DataFrame, nearest: bool = False) -> DataFrame:
    """places: path, place; intervals: path, start, stop and further columns. Each place with every interval that holds it (start <= place <= stop), or with the innermost.

    Places that repeat are taken once. A null path holds nothing; empty tables give an empty result.
    """
    more = [c for c in intervals.columns if c != "path"]
    inner = places.select("path", F.col("place").cast("int").alias("place_"), F.lit(None).cast("int").alias("stop_"))
    rows = intervals.select("path", F.col("start").cast("int").alias("place_"), F.col("stop").cast("int").alias("stop_"), *more).unionByName(inner, allowMissingColumns=True)
    rows = rows.where("path IS NOT NULL").repartition("path").sortWithinPartitions("path", "place_", F.col("stop_").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, stack, still = None, None, [], None  # last: the place answered last; stack: where an open interval stops, and its row
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if still is None else pa.concat_tables([still, rows])
            before = rows.num_rows - batch.num_rows
            at, held = [], []
            path = batch.column("path")
            other = [path[0].as_py() != here, *pc.not_equal(path[1:], path[:-1]).to_pylist()] if len(path) else []
            for i, (new, place, stop) in enumerate(zip(other, *(batch.column(c).to_pylist() for c in ("place_", "stop_"))), before):
                if new:
                    last, stack = None, []
                while stack and stack[-1][0] < place:
                    stack.pop()
                if stop is not None:
                    stack.append((stop, i))
                elif place != last and stack:
                    last = place
                    at += [place] * (1 if nearest else len(stack))
                    held += [stack[-1][1]] if nearest else [k for _, k in stack]
            if held:
                found = rows.take(pa.array(held)).combine_chunks()
                yield pa.RecordBatch.from_arrays([found.column("path").chunk(0), pa.array(at, pa.int32()), *(found.column(c).chunk(0) for c in more)], ["path", "place", *more])
            still = rows.take(pa.array([k for _, k in stack], pa.int64()))
            stack = [(stop, k) for k, (stop, _) in enumerate(stack)]
            here = path[-1].as_py() if len(path) else here

    schema = ", ".join(["path string", "place int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in intervals.schema if f.name != "path")])
    return rows.mapInArrow(run, schema)
