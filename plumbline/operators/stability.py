"""Run-to-run spread and bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.scoring import rates, ratio, tally
from plumbline.schemas import CATEGORIES
from plumbline.session import durable, ship

METRICS = ("precision", "recall", "f1", "false_alarm_rate")
#: A draw is followed in arrays of so many picks.
PICKED = 1 << 20


def run_rates(scored: DataFrame) -> DataFrame:
    """Rates of each run."""
    return rates(scored.groupBy("run").agg(*tally()))


def spread(by_run: DataFrame) -> DataFrame:
    """The population standard deviation of the rounded rates over runs."""
    deviation = lambda m: F.bround(F.coalesce(F.stddev_pop(m), F.lit(0.0)), 4).alias(f"{m}_std")
    return by_run.agg(F.count("*").alias("runs"), *map(deviation, METRICS))


def flip_rate(scored: DataFrame) -> DataFrame:
    """The share of cases whose outcome differs between runs."""
    kinds = scored.groupBy("case_id").agg(F.count_distinct("outcome").alias("kinds"))
    return kinds.agg(F.count("*").alias("cases"), ratio(F.count_if(F.col("kinds") > 1), F.count("*")).alias("flip_rate"))


def rank_places(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """1-based places of the nearest-rank quantiles among ``n`` ordered values, halves to even."""
    place = lambda q: min(n - 1, max(0, round(q * (n - 1)))) + 1
    return place(alpha / 2), place(1 - alpha / 2)


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank quantile of a list, not interpolated."""
    place = F.greatest(F.lit(1), F.bround(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)
    return F.try_element_at(F.sort_array(values), place)


def interval(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi) of any number of values a key: equal values are counted first, then a running count finds the ranks."""
    counted = draws.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    rank = lambda q: F.greatest(F.lit(1), F.bround(F.lit(q) * (F.col("__all") - 1)).cast("long") + 1)
    at = lambda q: F.min(F.when(F.col("__upto") >= rank(q), F.col(value)))
    return placed.groupBy(*keys).agg(at(0.025).alias("lo"), at(0.975).alias("hi"))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with their place in the order of ``by``, from 0: places within ranges, and how many stand before each range."""
    ranged = durable(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))  # a row a partition
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__part", "__before")


def hashed_bootstrap(scored: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Draws with replacement by a hash of (seed, draw, slot), so any engine and any partitioning draws alike.

    ``scored`` has (case_id, tp, fn, fp, tn), pooled over runs. Cases are numbered by id; the numbering and the draws are
    one equi-join, and every draw's counts are one aggregation.
    """
    cases = numbered(scored, "case_id", "slot")
    n = scored.agg(F.count("*").alias("n"))
    token = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")))
    picked = F.conv(F.substring(token, 1, 8), 16, 10).cast("long") % F.col("n")
    slots = cases.select("slot").crossJoin(F.broadcast(n)).select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = slots.select("draw", picked.alias("slot")).join(cases, "slot")
    return rates(drawn.groupBy("draw").agg(*(F.sum(k).alias(k) for k in ("tp", "fn", "fp", "tn"))), None)


def exact_bootstrap(outcomes: list[tuple[str, str, list[str]]], draws: int = 2000, seed: int = 0) -> list[tuple]:
    """(scope, metric, mean, lo, hi) with Python's own generator: all cases first, then the categories on the same stream
    in first-seen order. ``outcomes`` has (case_id, category, outcomes by run) in case order. The plain form, for a small benchmark; ``exact_intervals`` draws the same from tables."""

    def rated(chosen: list[list[str]]) -> dict[str, float]:
        flat = [o for runs in chosen for o in runs]
        tp, fn, fp, tn = (flat.count(k) for k in ("TP", "FN", "FP", "TN"))
        part = lambda a, b: a / b if b else 0.0
        p, r = part(tp, tp + fp), part(tp, tp + fn)
        return {"precision": p, "recall": r, "f1": part(2 * p * r, p + r), "false_alarm_rate": part(fp, fp + tn)}

    def bounds(values: list[float]) -> tuple[float, float]:
        low, high = rank_places(len(values))
        ordered = sorted(values)
        return round(ordered[low - 1], 4), round(ordered[high - 1], 4)

    rng, rows = random.Random(seed), []
    every = [runs for _, _, runs in outcomes]
    samples = [rated([rng.choice(every) for _ in every]) for _ in range(draws)]
    for metric, mean in rated(every).items():
        rows.append(("overall", metric, round(mean, 4), *bounds([s[metric] for s in samples])))
    drift = {c for c, _, d in CATEGORIES if d}
    for category in dict.fromkeys(c for _, c, _ in outcomes):
        own = [runs for _, c, runs in outcomes if c == category]
        wanted, metric = ("TP", "recall") if category in drift else ("FP", "false_alarm_rate")
        share = lambda chosen, wanted=wanted: sum(r.count(wanted) for r in chosen) / sum(map(len, chosen))
        values = [share([rng.choice(own) for _ in own]) for _ in range(draws)]
        rows.append((category, metric, round(share(own), 4), *bounds(values)))
    return rows


def stream(state: tuple) -> np.random.MT19937:
    """Python's own generator in a given state, whose words come in arrays."""
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    return words


def picks(words: np.random.MT19937, n: int, count: int) -> Iterator[np.ndarray]:
    """``count`` times what ``random.choice`` picks of ``n``, in arrays: the high bits of a word, and the next word where
    they are ``n`` or more. No word is taken that ``random.choice`` would not take."""
    shift = np.uint64(32 - n.bit_length())
    while count:
        found = words.random_raw(min(count, PICKED)) >> shift
        found = found[found < n]
        count -= len(found)
        yield found


def exact_intervals(spark: SparkSession, scored: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(scope, metric, mean, lo, hi) with Python's own generator: all cases first, then the categories on the same stream in
    first-seen order. ``scored`` has (case_id, category, case_pos, run, outcome).

    The stream is one, so the driver walks it for where each draw begins, for which it needs only how many cases there are.
    Tasks follow it from there over the cases in their order, a byte or two each: which of the distinct outcomes by run it has."""
    listed = scored.groupBy("case_id", "category", "case_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "outcome"))), lambda x: x["outcome"]), ",").alias("o"))
    placed = durable(listed.select("category", "case_pos", "o"))
    kinds = [r["o"] for r in placed.select("o").distinct().orderBy("o").collect()]  # outcomes by run, few
    seen = [(r["category"], r["n"]) for r in placed.groupBy("category").agg(F.count("*").alias("n"), F.min("case_pos").alias("first")).orderBy("first").collect()]
    if not kinds:
        return spark.createDataFrame([], "scope string, metric string, mean double, lo double, hi double")
    narrow = "smallint" if max(len(kinds), len(seen)) < 1 << 15 else "int"
    code = lambda c, names: F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])[F.col(c)].cast(narrow).alias(c)
    rows = placed.select("case_pos", code("o", kinds), code("category", [c for c, _ in seen])).orderBy("case_pos").select("o", "category").toArrow()
    own, of = rows.column("o").to_numpy(), rows.column("category").to_numpy()
    counted = np.array([[kind.split(",").count(k) for k in ("TP", "FN", "FP", "TN")] for kind in kinds], np.int64)
    scopes = [("overall", own), *((category, own[of == k]) for k, (category, _) in enumerate(seen))]

    words, begins = stream(random.Random(seed).getstate()[1]), []
    for place, (_, cases) in enumerate(scopes):
        for _ in range(draws):
            at = words.state["state"]
            begins.append((place, np.append(at["key"], at["pos"]).astype(np.uint32).tobytes()))
            for _ in picks(words, len(cases), len(cases)):
                pass
    shared = spark.sparkContext.broadcast(([cases for _, cases in scopes], len(kinds)))
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cases, n_kinds = shared.value
        for frame in frames:
            for place, begin in zip(frame["place"], frame["begin"], strict=True):
                n, total = len(cases[place]), np.zeros(n_kinds, np.int64)
                for found in picks(stream(tuple(np.frombuffer(begin, np.uint32).tolist())), n, n):
                    total += np.bincount(cases[place][found.astype(np.int64)], minlength=n_kinds)
                yield pd.DataFrame({"place": [place], "kinds": [total.tolist()]})

    tasks = spark.createDataFrame(begins, "place int, begin binary").repartition(spark.sparkContext.defaultParallelism)
    drawn = [[] for _ in scopes]
    for r in tasks.mapInPandas(run, "place int, kinds array<long>").collect():  # a row a draw
        drawn[r["place"]].append(np.array(r["kinds"]) @ counted)
    return spark.createDataFrame(_intervals(scopes, counted, drawn), "scope string, metric string, mean double, lo double, hi double")


def _intervals(scopes: list[tuple[str, np.ndarray]], counted: np.ndarray, drawn: list[list[np.ndarray]]) -> list[tuple]:
    """Rows from the (TP, FN, FP, TN) of each scope's draws."""
    part = lambda a, b: a / b if b else 0.0

    def rated(tally: np.ndarray) -> dict[str, float]:
        tp, fn, fp, tn = map(int, tally)
        p, r = part(tp, tp + fp), part(tp, tp + fn)
        return {"precision": p, "recall": r, "f1": part(2 * p * r, p + r), "false_alarm_rate": part(fp, fp + tn)}

    def bounds(values: list[float]) -> tuple[float, float]:
        low, high = rank_places(len(values))
        ordered = sorted(values)
        return round(ordered[low - 1], 4), round(ordered[high - 1], 4)

    drift, rows = {c for c, _, d in CATEGORIES if d}, []
    for (scope, cases), samples in zip(scopes, drawn, strict=True):
        whole = np.bincount(cases, minlength=len(counted)) @ counted
        if not rows:
            every = [rated(s) for s in samples]
            rows = [(scope, metric, round(mean, 4), *bounds([s[metric] for s in every])) for metric, mean in rated(whole).items()]
            continue
        at, metric = (0, "recall") if scope in drift else (2, "false_alarm_rate")
        share = lambda tally, at=at: int(tally[at]) / int(tally.sum())
        rows.append((scope, metric, round(share(whole), 4), *bounds([share(s) for s in samples])))
    return rows
