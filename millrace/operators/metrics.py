"""Measures of tokenizers, models and training runs over scored tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last position of each band.
BANDS = ((0, 32), (32, 64), (64, 128), (128, 256), (256, 512))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def learning_rate(step: Column, total: int, peak: float, warmup: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to the floor."""
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * progress))))


def bits_per_character(scored: DataFrame, *by: str) -> DataFrame:
    """From (loss, tokens, characters) of each text; the first token is not predicted."""
    nats, tokens, chars = F.sum(F.col("loss") * (F.col("tokens") - 1)), F.sum(F.col("tokens") - 1), F.sum("characters")
    return scored.where("tokens >= 32").groupBy(*by).agg(
        (nats / math.log(2) / F.greatest(chars, F.lit(1))).alias("bits_per_character"), perplexity(nats / F.greatest(tokens, F.lit(1))).alias("perplexity_per_token"), (tokens / F.greatest(chars, F.lit(1))).alias("tokens_per_character")
    )


def position_bands(scored: DataFrame, block: int, *by: str) -> DataFrame:
    """Mean loss and hit rate by band of positions; bands that reach beyond the block, or are empty, are left out."""
    bands = [(a, b) for a, b in (*BANDS, (512, block - 1)) if a < b <= block - 1]
    case = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(bands))):
        case = F.when((F.col("pos") >= a) & (F.col("pos") < b), F.lit(k)).otherwise(case)
    first, last = F.array(*[F.lit(a) for a, _ in bands]), F.array(*[F.lit(b) for _, b in bands])
    out = scored.withColumn("_k", case).where("_k IS NOT NULL").groupBy(*by, "_k").agg(F.avg("loss").alias("loss"), F.avg(F.col("hit").cast("double")).alias("hit"))
    return out.withColumn("first", F.get(first, F.col("_k"))).withColumn("last", F.get(last, F.col("_k"))).drop("_k")


def prefix_match(made: Column, real: Column) -> tuple[Column, Column]:
    """Words before two word lists differ, and equal places by the number of words made."""
    n = F.least(F.size(made), F.size(real))
    same = F.zip_with(F.slice(made, 1, n), F.slice(real, 1, n), lambda a, b: a == b)
    run = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(n)
    return run, F.size(F.filter(same, lambda x: x)) / F.greatest(F.size(made), F.lit(1))


def position_profile(rows: DataFrame, key: str, vector: str, window: int = 16, init: float = 0.02) -> DataFrame:
    """How many leading rows of a position matrix were trained, by the spread of each row in windows of rows.

    The windows are the only rows that meet in one task: one number for every `window` rows of a model's context.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    n = F.size(vector)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1))
    spreads = rows.select(F.floor(F.col(key) / window).alias("w"), spread.alias("s"))
    means = spreads.groupBy("w").agg(F.avg("s").alias("m"), F.count(F.lit(1)).alias("c")).where(F.col("c") == window).select("w", "m")
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    half = means.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    tail = means.crossJoin(F.broadcast(half)).where("w >= half")  # one row on the right
    middle = tail.agg(F.avg("m").alias("tail_mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY m)").alias("median"))
    mad = tail.crossJoin(F.broadcast(middle)).agg(F.greatest(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(m - median))"), F.lit(1e-6)).alias("mad"))
    moved = means.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(mad)).where("abs(m - median) > 6 * mad").agg(F.max("w").alias("last"))
    one = total.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(moved))
    trained = F.when(F.abs(F.col("tail_mean") - init) > 0.05 * init, F.col("rows")).otherwise(F.coalesce((F.col("last") + 1) * window, F.lit(0)))
    return one.select(trained.cast("long").alias("trained"), "rows", "tail_mean")


def patience(history: DataFrame, most: int, margin: float = 1e-4) -> DataFrame:
    """Best held-out loss, checks since, and the step at which a run with that patience stops, from (run, step, loss) rows.

    A new best must be better by the margin, so the fold is over the ordered losses of a run; a run's checks are few.
    """
    ordered = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("h"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("bigint").alias("stopped"))

    def step(s: Column, x: Column) -> Column:
        better = x["loss"] < s["best"] - margin
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        go = s["stopped"].isNull()
        return F.struct(
            F.when(go & better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(go, waited).otherwise(s["waited"]).alias("waited"), F.when(go & (waited >= most), x["step"].cast("bigint")).otherwise(s["stopped"]).alias("stopped")
        )

    return ordered.select("run", F.aggregate("h", start, step).alias("r")).select("run", F.col("r.best").alias("best"), F.col("r.waited").alias("waited"), F.col("r.stopped").alias("stopped"))


def block_perplexity(losses: DataFrame, *by: str) -> DataFrame:
    """Perplexity from the mean loss of blocks of equal length, from rows with `loss`."""
    return losses.groupBy(*by).agg(perplexity(F.avg("loss")).alias("perplexity"))


def held_out_loss(losses: DataFrame, limit: int, batch: int, *by: str) -> DataFrame:
    """Mean loss over the blocks that whole batches take until `limit` blocks are reached, from (block_id, loss); block_id counts from 0 without gaps.

    Batches weigh by their blocks, so their means add up to the mean of the blocks.
    """
    taken = F.ceil(F.lit(limit) / F.lit(batch)) * batch
    return losses.where(F.col("block_id") < taken).groupBy(*by).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("blocks"))


def window_losses(windows: DataFrame, starts: tuple[int, ...] = (0, 600), length: int = 64, *by: str) -> DataFrame:
    """Mean loss of windows of `length` tokens at each start, over texts that reach so far; NaN where none does. From (start, tokens, loss)."""
    asked = windows.select(*by).distinct().withColumn("start", F.explode(F.array(*[F.lit(s) for s in starts])))
    means = windows.where(F.col("tokens") >= F.col("start") + length).groupBy(*by, "start").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("texts"))
    found = asked.join(means, [*by, "start"], "left")
    return found.withColumn("loss", F.coalesce("loss", F.lit(float("nan")))).withColumn("texts", F.coalesce("texts", F.lit(0)).cast("long"))


def stop_rate(made: DataFrame, *by: str) -> DataFrame:
    """How many texts ended by themselves, and of how many, from (last_id, end_id, prompt_tokens, tokens, most_new)."""
    ended = (F.col("last_id") == F.col("end_id")) | (F.col("tokens") < F.col("prompt_tokens") + F.col("most_new"))
    return made.groupBy(*by).agg(F.count_if(ended).alias("stopped"), F.count(F.lit(1)).alias("prompts"))


def can_end(end_id: Column, vocabulary: Column) -> Column:
    """Whether a model can emit its end id at all; an unset id counts as 0."""
    return F.coalesce(end_id, F.lit(0)) < vocabulary


def throughput(checks: DataFrame) -> DataFrame:
    """Tokens seen, tokens a second and hours left at each check, from (step, first_step, total_steps, tokens_per_step, seconds); steps count from 0."""
    seen = (F.col("step") + 1 - F.col("first_step")) * F.col("tokens_per_step")
    rate = seen / F.col("seconds")
    left = (F.col("total_steps") - F.col("step") - 1) * F.col("tokens_per_step") / F.greatest(rate, F.lit(1.0)) / 3600
    return checks.select((F.col("step") + 1).alias("step"), seen.alias("tokens_seen"), F.bround(rate).cast("long").alias("tokens_per_second"), left.alias("hours_left"))


def compared(measures: DataFrame, models: list[str], model: str = "model", name: str = "measure", value: str = "value") -> DataFrame:
    """One row for each measure and a column for each model, from long rows."""
    return measures.groupBy(name).pivot(model, models).agg(F.first(value, ignorenulls=True))


def fertility_delta(mine: Column, theirs: Column) -> Column:
    """By how many percent a tokenizer's token counts differ from another's on the same text."""
    return 100 * (mine / theirs - 1)


def training_arithmetic(runs: DataFrame) -> DataFrame:
    """Steps and tokens of runs, and whether they see fewer than 20 tokens a parameter, from (run, blocks, block, batch, accumulation, epochs, parameters)."""
    per_step = F.col("batch") * F.col("accumulation")
    steps = F.greatest(F.lit(1), F.floor(F.col("blocks") / per_step))
    total = F.floor(F.col("epochs") * steps)
    short = F.col("blocks") * F.col("block") * F.col("epochs") < 20 * F.col("parameters")
    return runs.select("run", (per_step * F.col("block")).cast("long").alias("tokens_per_step"), steps.cast("long").alias("steps_per_epoch"), total.cast("long").alias("total_steps"), (20 * F.col("parameters")).cast("long").alias("tokens_wanted"), short.alias("short"))


def survey(sources: DataFrame, bytes_per_token: float = 3.6) -> DataFrame:
    """Tokens of each source, and whether it is for evaluation only; sizes in memory come before sizes on disk."""
    size = F.coalesce(F.nullif(F.col("bytes_memory"), F.lit(0)), F.col("bytes_files"))
    return sources.withColumn("bytes", size).where("bytes > 0").withColumn("tokens", F.floor(F.col("bytes") / bytes_per_token)).withColumn("evaluation", F.contains(F.col("note"), F.lit("EVALUATION")))


def survey_totals(surveyed: DataFrame, wanted: float = 2.24e9) -> DataFrame:
    usable = F.coalesce(F.sum(F.when(~F.col("evaluation"), F.col("tokens"))), F.lit(0)).cast("long")
    return surveyed.agg(usable.alias("usable_tokens"), F.count(F.lit(1)).alias("sources"), F.round(usable / wanted, 6).alias("share"))


def survey_document(surveyed: DataFrame, bytes_per_token: float = 3.6) -> DataFrame:
    """The survey as one JSON document: what a token takes, usable tokens, and all sources by name. Sources are a short list by nature."""
    one = F.struct("source", "bytes", F.col("tokens").cast("long").alias("tokens"), "note", "evaluation")
    usable = F.coalesce(F.sum(F.when(~F.col("evaluation"), F.col("tokens"))), F.lit(0)).cast("long")
    return surveyed.agg(usable.alias("u"), F.array_sort(F.collect_list(one)).alias("s")).select(F.to_json(F.struct(F.lit(bytes_per_token).alias("bytes_per_token"), F.col("u").alias("usable_tokens"), F.col("s").alias("sources"))).alias("document"))


def configs(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct configurations, in order."""
    return rows.select(*columns).distinct().orderBy(*columns)


def fertility(counted: DataFrame) -> DataFrame:
    """Tokens by white-space words over all texts, from (tokens, words)."""
    return counted.agg((F.sum("tokens") / F.greatest(F.sum("words"), F.lit(1))).alias("fertility"), F.count(F.lit(1)).alias("documents"))


def nearest_configs(names: Column, marks: tuple[str, ...] = ("ht", "hat", "cre"), most: int = 4) -> Column:
    """Of sorted configuration names, the first few that hold one of the marks."""
    return F.slice(F.filter(F.array_sort(names), lambda x: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.lower(x), m))), 1, most)
