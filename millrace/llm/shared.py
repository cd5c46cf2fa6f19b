"""What several operators of this folder use: intermediate tables, a bounded memo, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.stage import drop, free, settle, shared_dir, standing

__all__ = ["ROWS", "Memo", "bounded", "drop", "free", "input_bytes", "settle", "shared_dir", "standing", "unused"]


#: A table of a number or two in each row is broadcast up to so many rows, some tens of megabytes.
ROWS = 1 << 20


def bounded(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has ROWS rows at most, else joined as Spark sees fit."""
    return F.broadcast(table) if table.count() <= ROWS else table


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it no column's."""
    while name in df.columns:
        name += "_"
    return name


class Memo(dict):
    """Results by string, for short strings only, emptied when it would hold more than `most` bytes; what is long is worked out each time."""

    LONGEST, OVERHEAD = 64, 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, name: str, value, size: int) -> None:
        if len(name) <= self.LONGEST:
            self.held += size + 4 * len(name) + self.OVERHEAD
            if self.held > self.most:
                self.clear()
                self.held = size + 4 * len(name) + self.OVERHEAD
            self[name] = value


def input_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and bytes of one text column, by one small aggregate."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])
