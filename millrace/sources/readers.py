"""Reading raw sources and shards into DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import first_filled

#: Columns that may hold the text of a raw row; the first that is filled counts.
TEXT_FIELDS = ("text", "content", "raw_content", "document")


def raw_rows(df: DataFrame) -> DataFrame:
    """`text` from the first filled text column; rows without one go."""
    present = [c for c in TEXT_FIELDS if c in df.columns]
    return df.withColumn("text", first_filled(*present)).where("text <> ''")


def registered(spark: SparkSession, sources: list[tuple[str, str, bool]], order: list[str] | None = None) -> DataFrame:
    """The registry of sources as rows (priority, source, path, sentences), in the given order of priority; names that are not registered are dropped."""
    known = {name: (name, path, sentences) for name, path, sentences in sources}
    rows = [(k, *known[name]) for k, name in enumerate(n for n in order or known if n in known)]
    return spark.createDataFrame(rows, "priority int, source string, path string, sentences boolean")


def head(df: DataFrame, n: int, *order: str, by: str | None = None) -> DataFrame:
    """The first n rows, of each source if there is a column for it, before anything is dropped; n = 0 is all."""
    if not n:
        return df
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")  # planned with a limit for each group before the shuffle


def published(pages: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Measures from the two summaries that a model page publishes, whichever are there: malformed or missing ones leave nulls.

    `pages` holds the files by name: the training summary, and the comparison with an earlier model. The ratio is that of old to new bits per character.
    """
    training = F.from_json(F.col(text), "parameters long, unique_train_tokens long, epochs double, best_eval_perplexity double")
    both = F.from_json(F.col(text), "new struct<bits_per_character:double>, old struct<bits_per_character:double>")
    row = pages.agg(F.max(F.when(F.col(name) == "training_summary", training)).alias("t"), F.max(F.when(F.col(name) == "comparison", both)).alias("c"))
    new, old = F.col("c.new.bits_per_character"), F.col("c.old.bits_per_character")
    return row.select("t.parameters", "t.unique_train_tokens", "t.epochs", "t.best_eval_perplexity", new.alias("new_bits"), old.alias("old_bits"), F.try_divide(old, new).alias("ratio"))


def json_lines(spark: SparkSession, path: str, schema: str = "text string, source string") -> DataFrame:
    """JSON lines, also gzipped; malformed lines go, missing fields are empty. `file` is where a row comes from."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(parsed.alias("j"), F.col("_metadata.file_path").alias("file")).where("j._corrupt_record IS NULL").select("j.*", "file").drop("_corrupt_record")
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def shards(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Filled rows of `shard-*.jsonl.gz` whose source is not excluded."""
    rows = json_lines(spark, f"{folder}/shard-*.jsonl.gz").where("text <> ''")  # `file` gives the order of the shards
    return rows.where(~F.coalesce("source", F.lit("")).isin(*exclude)) if exclude else rows


def strict_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Instruction pairs; a malformed line is an error."""
    return spark.read.schema("enstriksyon string, repons string, domain string, task string, angle string").option("mode", "FAILFAST").json(path)


def mixed_files(spark: SparkSession, text_globs: list[str] = (), json_lists: list[str] = (), json_lines_globs: list[str] = (), field: str = "text") -> DataFrame:
    """(name, text): whole text files, items of JSON lists, and JSON lines."""
    parts = []
    base = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    for path in text_globs:
        parts.append(spark.read.text(path, wholetext=True).select(base.alias("name"), F.col("value").alias("text")))
    for path in json_lists:
        raw = spark.read.text(path, wholetext=True).select(base.alias("file"), F.parse_json("value").alias("v"))
        each = raw.selectExpr("file", "posexplode(CAST(v AS ARRAY<VARIANT>)) AS (i, value)")
        whole = F.when(F.col("value").cast("string").startswith("{"), F.coalesce(F.try_variant_get("value", f"$.{field}", "string"), F.lit(""))).otherwise(F.col("value").cast("string"))
        parts.append(each.select(F.concat("file", F.lit("#"), F.col("i").cast("string")).alias("name"), whole.alias("text")))
    for path in json_lines_globs:
        # A file is one row here, so that lines keep their numbers; these are small sources, and large ones go through json_lines().
        lines = spark.read.text(path, wholetext=True).select(base.alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\\n$", ""), "\n")).alias("i", "line"))
        parsed = lines.withColumn("j", F.from_json("line", f"`{field}` string")).where("trim(line) <> ''")
        parts.append(parsed.select(F.concat("file", F.lit("#"), F.col("i").cast("string")).alias("name"), F.coalesce(F.col("j")[field], F.lit("")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(file, block_id, ids) of flat little-endian 16-bit files; what does not fill a block at the end is left out."""
    import numpy as np
    import pyarrow as pa

    def cut(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                rows = ids[: len(ids) // block * block].reshape(-1, block).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.int32()))], ["file", "block_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block_id long, ids array<int>")
