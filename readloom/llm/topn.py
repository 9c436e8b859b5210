"""The N highest items of every group through mergeable bounded heaps.

A heap of at most N items per group is built on each side of the shuffle: before it over the rows of an input split,
after it over the heaps that arrive for a group. So no more than N rows of a group leave a split, and a group with
millions of rows is reduced where the rows lie. Items compare by score, then by the smaller id; an id that comes again
is the same item.
"""

from __future__ import annotations

from heapq import heappush, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups a split holds before it hands its heaps on; handing on early costs rows, never results.
FLUSH_GROUPS = 200_000
_SCHEMA = pa.schema([("g", pa.string()), ("id", pa.int64()), ("score", pa.int64())])


def offer(heap: list, n: int, score: int, ident: int) -> None:
    """Add an item to a heap of at most n; its root is the item that goes first."""
    item = (score, -ident)
    if len(heap) < n:
        if item not in heap:
            heappush(heap, item)
    elif item > heap[0] and item not in heap:
        heapreplace(heap, item)


def _emit(heaps) -> pa.RecordBatch:
    g, i, s = [], [], []
    for key, heap in heaps:
        for score, ident in heap:
            g.append(key)
            i.append(-ident)
            s.append(score)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], schema=_SCHEMA)


def top_items(df: DataFrame, group: str, score: str, ident: str, n: int = 3) -> DataFrame:
    """``group, id, score`` of the n highest items of each group: score descending, then id ascending.

    Rows with a null group, score or id are no items. An id counts once per group; if it comes with several scores each
    (score, id) pair is an item. A group with fewer than n items comes out with all of them; an empty table gives no rows.
    """
    x = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{ident}`").cast("bigint").alias("id"), F.col(f"`{score}`").cast("bigint").alias("score")).na.drop()

    def build(batches):
        heaps: dict[str, list] = {}
        for b in batches:
            for g, i, s in zip(*(c.to_pylist() for c in b.columns)):
                heap = heaps.get(g)
                if heap is None:
                    heaps[g] = [(s, -i)]
                elif len(heap) < n or s >= heap[0][0]:
                    offer(heap, n, s, i)
            if len(heaps) > FLUSH_GROUPS:
                yield _emit(heaps.items())
                heaps = {}
        yield _emit(heaps.items())

    def merge(batches):
        key, heap = None, []
        for b in batches:
            done = []
            for g, i, s in zip(*(c.to_pylist() for c in b.columns)):
                if g != key:
                    if heap:
                        done.append((key, heap))
                    key, heap = g, []
                offer(heap, n, s, i)
            if done:
                yield _emit(done)
        if heap:
            yield _emit([(key, heap)])

    schema = "g string, id bigint, score bigint"
    out = x.mapInArrow(build, schema).repartition("g").sortWithinPartitions("g").mapInArrow(merge, schema)
    return out.select(F.col("g").alias(group), F.col("id").alias(ident), "score")


def mapping_score(gt_score: str = "gt_score", maps: str = "maps"):
    """A mapping's score: ``gt_score``, else what its MAP text carries behind ``:::`` (decimal or hexadecimal).

    Null if neither is there. Scores over the largest BIGINT count as it.
    """
    text = F.regexp_extract(F.split(F.col(maps), ",")[0], r":::(0x[0-9a-fA-F]+|[0-9]+)$", 1)
    hexa = F.conv(F.substring(text, 3, 40), 16, 10)
    number = F.when(text.startswith("0x"), hexa).when(text != "", text)
    most = F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")
    carried = F.when(number.isNotNull(), F.least(F.coalesce(number.try_cast("decimal(38,0)"), most), most).cast("bigint"))
    return F.coalesce(F.col(gt_score), carried)
