"""Writing shards, token blocks and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.stage import observed, ranges, settle


def shards(df: DataFrame, path: str, rows: int = 50_000, *order: str, parts: int | None = None) -> dict[str, int]:
    """Gzipped JSON lines in order, `rows` to a file at most. Returns how many documents and characters were written, counted on the way."""
    dealt = df.repartitionByRange(parts or ranges(df), *order).sortWithinPartitions(*order) if order else df
    dealt, watch = observed(dealt.select("text", "source"), "shards", documents=F.count(F.lit(1)), characters=F.coalesce(F.sum(F.length("text")), F.lit(0)))
    dealt.write.option("maxRecordsPerFile", rows).option("compression", "gzip").mode("overwrite").json(path)
    return watch.get


def token_blocks(blocks: DataFrame, path: str) -> None:
    """(split, block_id, ids) as rows of little-endian 16-bit integers, one folder for each split, in order of block_id within files.

    Parquet keeps the bytes with their place; the concatenation of `data` by block_id is the flat file that a trainer maps.
    """
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            data = [np.asarray(ids, "<u2").tobytes() for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("split"), b.column("block_id"), pa.array(data, pa.binary())], ["split", "block_id", "data"])

    packed = blocks.select("split", "block_id", F.assert_true(F.forall("ids", lambda i: i.between(0, 65_535)), F.lit("an id does not fit 16 bits")).alias("_ok"), "ids").where("_ok IS NULL").drop("_ok")
    packed.mapInArrow(pack, "split string, block_id long, data binary").sortWithinPartitions("block_id").write.partitionBy("split").mode("overwrite").parquet(path)


def one_json(row: DataFrame, path: str) -> None:
    """A one-row manifest as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def token_files(blocks: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """The blocks of each split as flat little-endian 16-bit files, and what was written: (split, file, first_block, blocks).

    A task writes one run of consecutive blocks of a split to `<split>/<first block>.bin`, so the files of a split, one behind the other in order of their
    names, are the flat stream, and readers.token_blocks() reads any of them. `folder` is a path or URI of a store that all executors reach. Files are written
    under a name of their own and moved, so a task that runs twice leaves one whole file.
    """
    import uuid

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        out, name, done, told = None, None, 0, []

        def close():
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/{name[0]}/{name[1]:012d}.bin")
                told.append((name[0], f"{name[1]:012d}.bin", name[1], done))

        for b in batches:
            for split, block_id, ids in zip(b.column("split").to_pylist(), b.column("block_id").to_pylist(), b.column("ids")):
                if name is None or name[0] != split:
                    close()
                    name, done = (split, block_id), 0
                    store.create_dir(f"{root}/{split}")
                    temporary = f"{root}/{split}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                values = ids.values.to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() > 65_535):
                    raise ValueError("an id does not fit 16 bits")
                out.write(values.astype("<u2").tobytes())
                done += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["split", "file", "first_block", "blocks"])

    ordered = settle(blocks.select("split", "block_id", "ids"), "blocks").repartitionByRange(parts or ranges(blocks), "split", "block_id").sortWithinPartitions("split", "block_id")
    return settle(ordered.mapInArrow(write, "split string, file string, first_block long, blocks long"), "files")


def pairs(df: DataFrame, path: str, target: int, *order: str) -> None:
    """The first `target` instruction pairs in order, as JSON lines in UTF-8."""
    df.orderBy(*order).limit(target).select("instruction", "response", *[c for c in ("domain", "task", "angle") if c in df.columns]).write.mode("overwrite").json(path)
