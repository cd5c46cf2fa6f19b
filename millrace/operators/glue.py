"""Glueing the sentences of a sentence-level source into documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.stage import ranges, settle


def glued(rows: DataFrame, source: str = "source", order: str = "doc_id", text: str = "text", least: int = 2000) -> DataFrame:
    """(source, doc_ord, text): stripped rows joined by line feeds until their lengths reach `least`; what is left is a document too.

    Where a document ends depends on all before it in its source, so a source is one sequence. Only the lengths make that walk, as Arrow batches that
    stream through the source's task in order and are never held together; texts are joined by an aggregate afterwards. Rows with the same order value are
    told apart by their text.
    """
    cleaned = settle(rows.where(F.col(text).isNotNull() & (F.col(text) != "")).select(source, order, F.regexp_replace(text, "^(?U)\\s+|(?U)\\s+$", "").alias("_t")), "sentences")
    cleaned = cleaned.withColumn("_k", F.xxhash64("_t"))
    keyed = cleaned.select(source, order, F.length("_t").alias("_n"), "_k")
    dealt = keyed.repartition(ranges(rows), source).sortWithinPartitions(source, order, "_k")
    schema = f"`{source}` string, `{order}` {rows.schema[order].dataType.simpleString()}, _n int, _k long, _c long, doc_ord long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, at, last, again = None, 0, 0, None, 0
        for b in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for s, *row, n in zip(*[b.column(c).to_pylist() for c in (source, order, "_k", "_n")]):
                if s != name:
                    name, size, at = s, 0, 0
                again, last = again + 1 if (s, row) == last else 0, (s, row)
                out[0].append(again)
                out[1].append(at)
                size += n
                if size >= least:
                    size, at = 0, at + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in out]], [*b.schema.names, "_c", "doc_ord"])

    numbers = dealt.mapInArrow(number, schema).drop("_n")
    counted = cleaned.withColumn("_c", F.row_number().over(W.partitionBy(source, order, "_k").orderBy("_t")).cast("long") - 1)
    joined = counted.join(numbers, [source, order, "_k", "_c"]).groupBy(source, "doc_ord").agg(F.array_sort(F.collect_list(F.struct(order, "_k", "_t"))).alias("_p"))
    return joined.select(source, "doc_ord", F.array_join(F.transform("_p", lambda p: p["_t"]), "\n").alias(text))
