"""The grid of prompts for a teacher, filling their template, and calling the teacher in waves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The topics, kinds and settings that prompts combine, and the prompt itself.
DOMAINS = (
    "lavi chak jou",
    "sante ak byennèt",
    "agrikilti ak jaden",
    "edikasyon ak lekòl",
    "biznis ak lajan",
    "teknoloji ak telefòn",
    "kilti ak istwa Ayiti",
    "manje ak kizin",
    "dwa sitwayen",
    "travay ak metye",
    "fanmi ak timoun",
    "vwayaj ak transpò",
    "mizik ak dans",
    "espò ak jwèt",
    "relijyon ak kwayans",
    "anviwònman ak dlo",
    "move tan ak siklòn",
    "kay ak konstriksyon",
    "mache ak komès",
    "bèt ak elvaj",
    "lapolis ak sekirite",
    "lajistis ak tribinal",
    "bank ak prè",
    "entènèt ak rezo sosyal",
    "maladi ak remèd",
    "gwosès ak tibebe",
    "granmoun ak swen",
    "andikap ak aksè",
    "dyaspora ak imigrasyon",
    "lang ak literati",
    "jounal ak radyo",
    "atizana ak metye men",
    "lapèch ak lanmè",
    "elektrisite ak enèji",
    "fatra ak pwòpte",
    "maryaj ak seremoni",
    "lantèman ak dèy",
    "jaden dlo ak irigasyon",
    "kredi ak sòl",
    "chomaj ak djòb",
)
TASKS = (
    "yon kesyon ak repons li",
    "rezime yon ti tèks ou mete nèt andedan enstriksyon an",
    "senplifye yon fraz ki difisil pou yon moun ki pa li anpil",
    "yon vire nan yon konvèsasyon natirèl ant de moun",
    "klasifye santiman oswa entansyon yon ti mesaj ou bay",
    "rale enfòmasyon presi nan yon ti tèks ou bay",
    "reekri yon fraz pou li pi poli oswa pi kout",
    "bay yon lis etap pou fè yon bagay",
)
ANGLES = (
    "pou yon jenn moun",
    "pou yon granmoun",
    "nan zòn riral",
    "nan yon gwo vil",
    "pou yon ti biznis",
    "nan yon fanmi",
    "pou yon elèv",
    "pou yon moun kap travay",
    "nan yon sitiyasyon ijan",
    "nan lavi chak jou",
    "pou yon gwoup nan kominote a",
    "pou yon moun ki fèk kòmanse",
)
SHAPE = '[{"enstriksyon": "...", "repons": "..."}]'
TEMPLATE = f"""W ap ede bati yon seri done pou antrene yon modèl lang nan kreyòl ayisyen.

Ekri {{count}} pè enstriksyon ak repons sou tèm sa a: {{domain}}, {{angle}}.
Kalite travay la dwe se: {{task}}.

Règ:
- Tout bagay dwe an kreyòl ayisyen natirèl jan yo pale l an Ayiti, ak bon òtograf ak aksan yo.
- Pa mete franse. Pa mete anglè.
- Chak enstriksyon dwe kanpe pou kont li. Si li pale sou yon tèks, mete tèks la andedan enstriksyon an.
- Chak repons dwe gen ant 2 ak 6 fraz, konkrè epi itil.
- Varye fason ou ekri yo, pa repete menm fraz la.
- Voye SÈLMAN yon JSON array, anyen dòt, konsa: {SHAPE}"""


def grid(spark: SparkSession, seed: int = 42) -> DataFrame:
    """All combinations with `job`, their place in a seeded hash order; three fixed lists."""
    one, two, three = (spark.createDataFrame([(x,) for x in values], f"{name} string").coalesce(1) for name, values in (("domain", DOMAINS), ("task", TASKS), ("angle", ANGLES)))
    made = one.crossJoin(two).crossJoin(three)
    from millrace.operators.corpus import ranked

    order = made.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "domain", "task", "angle")))
    return ranked(order, ("_h",), 4).withColumnRenamed("rank", "job").drop("_h")


def prompt(domain: Column, task: Column, angle: Column, count: int = 10) -> Column:
    """The template filled in; a field that is left is an error."""
    filled = F.lit(TEMPLATE)
    for name, value in (("{domain}", domain), ("{task}", task), ("{angle}", angle), ("{count}", F.lit(str(count)))):
        filled = F.replace(filled, F.lit(name), value)
    rest = F.replace(filled, F.lit(SHAPE), F.lit(""))
    return F.when(F.assert_true(~F.contains(rest, F.lit("{")), F.lit("a field of the prompt is not filled in")).isNull(), filled)


def wave_size(kept: int, attempted: int, target: int, per_call: int, budget: int) -> int:
    """How many calls to make next, from the pairs that calls have yielded so far."""
    per = kept / attempted if attempted else per_call * 0.9
    return min(max(int((target - kept) / max(per, 0.5)) + 4, 8), budget - attempted)


def asked(jobs: DataFrame, ask: Callable[[str], str], count: int = 10) -> DataFrame:
    """`reply` of a caller's function to each job's prompt; null where the call failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(p: str) -> str | None:
            try:
                return ask(p)
            except Exception:  # noqa: BLE001  a failed call is counted, whatever failed
                return None

        for b in batches:
            yield b.assign(reply=b["prompt"].map(safe)).drop(columns=["prompt"])

    with_prompt = jobs.withColumn("prompt", prompt(F.col("domain"), F.col("task"), F.col("angle"), count))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema.fields) + ", reply string"
    return with_prompt.mapInPandas(run, schema)


def generate(spark: SparkSession, ask: Callable[[str], str], target: int = 30_000, per_call: int = 10, seed: int = 42, p=None) -> tuple[DataFrame, dict[str, int]]:
    """Kept pairs in order of their jobs, `target` at most, and how many were dropped for each reason.

    Calls go out in waves sized by the yield so far; a wave's replies are written, so no call is made twice.
    """
    from millrace.functions.profiles import Pairs
    from millrace.operators import pairs as P
    from millrace.sources.stage import settle

    p = p or Pairs()
    cells, budget, attempted, kept, every = grid(spark, seed), -(-target // per_call) * 3, 0, 0, None
    n = cells.count()
    while kept < target and attempted < budget:
        wave = wave_size(kept, attempted, target, per_call, budget)
        jobs = spark.range(attempted, attempted + wave).withColumnRenamed("id", "call").withColumn("job", F.pmod(F.col("call"), F.lit(n))).join(F.broadcast(cells), "job")
        replies = settle(asked(jobs.repartition(spark.sparkContext.defaultParallelism), ask, per_call), "replies")
        every = replies if every is None else every.unionByName(replies)
        attempted += wave
        judged = P.rejected(P.parsed(every.where("reply IS NOT NULL")), p)
        good = P.deduplicated(judged.where("reason IS NULL").drop("reason"), ("call", "pos"), p)
        kept = good.count()
    if every is None:
        return P.parsed(asked(cells.limit(0).withColumn("call", F.lit(0)), ask)), {}
    counts = {r["reason"]: r["n"] for r in judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    failed, passed = every.where("reply IS NULL").count(), judged.where("reason IS NULL").count()
    counts |= {"call failed": failed} if failed else {}
    counts |= {"duplicate": passed - kept} if passed > kept else {}
    return good.orderBy("call", "pos").limit(target), counts
