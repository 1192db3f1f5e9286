"""Ranking chunks for rules by TF-IDF cosine, as joins of sparse vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.session import discard, durable, ship

DIMENSIONS = 2048
#: Texts are counted by about PART documents in a task. Groups of at most WITHIN documents are weighted where their texts are;
#: with a larger group, tokens are dealt instead.
WITHIN, PART = 1000, 4000


def dealt(docs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` documents dealt by ``keys`` over a partition per ``PART``, which no coalescing changes: what a task counts of them
    in memory stays the same however many there are."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // PART)), *keys)


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, n): how often each token occurs in each document."""
    return X.token_rows(docs, keys, text)


def document_frequency(terms: DataFrame, group: list[str]) -> DataFrame:
    """(group, token, df): in how many documents each token occurs; ``terms`` has a row a document and token."""
    return terms.groupBy(*group, "token").agg(F.count("*").alias("df"))


def idf(total: Column, df: Column) -> Column:
    """Smoothed inverse document frequency; a token that no document has counts as df 0."""
    return F.log((F.greatest(total, F.lit(1)) + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def weighted(
    terms: DataFrame, frequency: DataFrame, totals: DataFrame, keys: list[str], group: list[str], asked: DataFrame | None = None
) -> DataFrame:
    """(keys, token, w, band): TF-IDF vectors of length 1. ``totals`` has (group, total). With ``asked`` (group, token) only
    those tokens are returned; the length counts all. ``band`` is the binary logarithm of the document's number of tokens.
    ``terms`` is read twice: lengths add up within the tasks that hold a document's terms, so few rows are shuffled for them."""

    def raw(rows: DataFrame) -> DataFrame:
        joined = rows.join(frequency, [*group, "token"], "left")
        joined = joined.join(totals, group) if group else joined.crossJoin(F.broadcast(totals))  # one row
        return joined.select(*keys, "token", ((1 + F.log("n")) * idf(F.col("total"), F.col("df"))).alias("w"))

    length = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    norms = raw(terms).groupBy(*keys).agg(length, F.floor(F.log2(F.count("*"))).cast("int").alias("band"))
    kept = terms if asked is None else terms.join(asked, [*group, "token"], "left_semi")
    return raw(kept).join(norms, keys).select(*keys, "token", (F.col("w") / F.col("norm")).alias("w"), "band")


def weighted_within(docs: DataFrame, totals: DataFrame, keys: list[str], group: list[str], n: int) -> DataFrame:
    """What ``weighted`` gives of ``docs`` (keys, text; ``rule`` among the keys) for the tokens that rules of the group have:
    the ``n`` texts are dealt by group, and all else follows where they are."""
    terms = term_counts(dealt(docs, group, n), keys).join(totals, group)
    token = Window.partitionBy(*group, "token")
    known = terms.withColumn("df", F.count("*").over(token)).withColumn("__asked", F.max("rule").over(token))
    raw = known.select(*keys, "token", "__asked", ((1 + F.log("n")) * idf(F.col("total"), F.col("df"))).alias("w"))
    doc = Window.partitionBy(*keys)
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
    return raw.select(*keys, "token", "__asked", unit.alias("w"), F.floor(F.log2(F.count("*").over(doc))).cast("int").alias("band")).where("__asked").drop("__asked")


def bucketed(vectors: DataFrame, keys: list[str], bucket: Column, weight: str = "w") -> DataFrame:
    """(keys, bucket, w): colliding tokens add up, then length 1."""
    added = vectors.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(weight).alias("w"))
    norm = F.coalesce(F.nullif(F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys))), F.lit(0.0)), F.lit(1.0))
    return added.withColumn("w", F.col("w") / norm)


def blake_buckets(vocabulary: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(token, bucket) by the first 8 bytes of BLAKE2b; over the vocabulary, not over the text."""
    ship(vocabulary.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(bucket=[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % dimensions for t in frame["token"]])[["token", "bucket"]]

    return vocabulary.select("token").distinct().mapInPandas(run, "token string, bucket int")


def md5_bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


#: For a first threshold a rule looks at the best chunks of its best tokens: SEED_TOKENS (token, band) pairs of it and
#: SEED_CHUNKS * k chunks of each. Tokens that together reach less than SHARE of the threshold are looked at in a second
#: pass, for the pairs that are left; with 1 the first pass is smallest, with less the second. Results are the same with any.
SEED_TOKENS, SEED_CHUNKS, SHARE = 8, 2, 0.5


@dataclass(frozen=True)
class Postings:
    """Unit vectors of rules and of chunks, as tables of one row a token.

    ``asked``: (group, rule_key, token, wr). ``held``: (group, chunk_key, band, token, wc), only tokens that rules have.
    ``peaks``: (group, band, token, peak), the largest weight of a token among the chunks of a band. Bands of like length
    keep peaks low: a token's weight falls with the number of tokens beside it.
    """

    asked: DataFrame
    held: DataFrame
    peaks: DataFrame
    group: list[str]
    slack: float


def postings(rules: DataFrame, chunks: DataFrame, group: list[str], decimals: int = 6) -> Postings:
    """Both sides are documents of the frequencies. ``slack`` is what rounding can add to a score."""
    sides = [(rules, "rule_id", True), (chunks, "chunk_id", False)]
    both = [side.select(*group, F.col(name).cast("string").alias("doc"), F.lit(rule).alias("rule"), "text") for side, name, rule in sides]
    keys = [*group, "rule", "doc"]
    count = [side.groupBy(*group).agg(F.count("*").alias("total")) for side in both]
    totals = count[0].unionByName(count[1]).groupBy(*group).agg(F.sum("total").alias("total"))
    totals, docs = durable(totals), both[0].unionByName(both[1])
    largest, n = (x or 0 for x in totals.agg(F.max("total"), F.sum("total")).first())
    if group and largest <= WITHIN:
        vectors = durable(weighted_within(docs, totals, keys, group, n))
    else:
        terms = durable(term_counts(dealt(docs, keys, n), keys))  # texts move once, their tokens stay
        wanted = durable(terms.where("rule").select(*group, "token").distinct())
        frequency = durable(document_frequency(terms, group))  # written, so that Spark knows its size before it joins
        vectors = durable(weighted(terms, frequency, totals, keys, group, wanted))
        discard(terms, wanted, frequency)
    discard(totals)
    asked = vectors.where("rule").select(*group, F.col("doc").alias("rule_key"), "token", F.col("w").alias("wr"))
    held = vectors.where("not rule").select(*group, F.col("doc").alias("chunk_key"), "band", "token", F.col("w").alias("wc"))
    peaks = held.groupBy(*group, "band", "token").agg(F.max("wc").alias("peak"))
    return Postings(asked, held, durable(peaks), group, 2.0 * 10**-decimals)


def thresholds(index: Postings, k: int) -> DataFrame:
    """(group, rule_key, threshold): a score that the rule's k-th best chunk has at least. Rules for which ``k`` chunks were
    not met are left out."""
    g, seeds = index.group, k * SEED_CHUNKS
    impact = index.asked.join(index.peaks, [*g, "token"]).withColumn("impact", F.col("wr") * F.col("peak"))
    best = Window.partitionBy(*g, "rule_key").orderBy(F.col("impact").desc(), "token", "band")
    chosen = impact.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= SEED_TOKENS).select(*g, "rule_key", "token", "band")
    heaviest = Window.partitionBy(*g, "band", "token").orderBy(F.col("wc").desc(), "chunk_key")
    asked = index.held.join(chosen.select(*g, "band", "token").distinct(), [*g, "band", "token"], "left_semi")
    champions = asked.withColumn("__n", F.row_number().over(heaviest)).where(F.col("__n") <= seeds).select(*g, "band", "token", "chunk_key")
    pairs = chosen.join(champions, [*g, "band", "token"]).select(*g, "rule_key", "chunk_key").distinct()
    met = pairs.join(index.asked, [*g, "rule_key"]).join(index.held, [*g, "chunk_key", "token"])
    score = met.groupBy(*g, "rule_key", "chunk_key").agg(F.sum(F.col("wr") * F.col("wc")).alias("score"))
    order = Window.partitionBy(*g, "rule_key").orderBy(F.col("score").desc())
    kth = score.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == k)
    return kth.select(*g, "rule_key", F.col("score").alias("threshold"))


def split_tokens(index: Postings, reached: DataFrame, share: float = SHARE) -> DataFrame:
    """(group, rule_key, band, token, wr, essential, rest, threshold): which tokens a chunk of the band has to share with the
    rule. Tokens count up from the least impact; those whose sum stays below ``share`` of the threshold cannot reach it
    together, and ``rest`` is that sum."""
    g = index.group
    impact = index.asked.join(index.peaks, [*g, "token"]).withColumn("impact", F.col("wr") * F.col("peak"))
    known = impact.join(reached, [*g, "rule_key"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    upwards = Window.partitionBy(*g, "rule_key", "band").orderBy("impact", "token").rowsBetween(Window.unboundedPreceding, 0)
    summed = known.withColumn("essential", F.sum("impact").over(upwards) >= share * F.col("threshold") - index.slack)
    whole = Window.partitionBy(*g, "rule_key", "band")
    rest = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("impact"))).over(whole)
    return summed.withColumn("rest", rest).select(*g, "rule_key", "band", "token", "wr", "essential", "rest", "threshold")


def candidates(index: Postings, tokens: DataFrame, k: int) -> DataFrame:
    """(group, rule_key, chunk_key, band, partial): pairs that share an essential token and can still be among the rule's
    first ``k``; ``partial`` is their score from the essential tokens. The k-th best of these is a threshold as well."""
    g = index.group
    met = tokens.where("essential").join(index.held, [*g, "band", "token"])
    summed = met.groupBy(*g, "rule_key", "chunk_key", "band").agg(
        F.sum(F.col("wr") * F.col("wc")).alias("partial"), F.max("rest").alias("rest"), F.max("threshold").alias("threshold")
    )
    can = durable(summed.where(F.col("partial") + F.col("rest") >= F.col("threshold") - index.slack))
    order = Window.partitionBy(*g, "rule_key").orderBy(F.col("partial").desc())
    kth = can.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == k).select(*g, "rule_key", F.col("partial").alias("__kth"))
    raised = F.greatest("threshold", F.coalesce("__kth", F.lit(0.0)))
    left = can.join(kth, [*g, "rule_key"], "left").where(F.col("partial") + F.col("rest") >= raised - index.slack)
    return left.select(*g, "rule_key", "chunk_key", "band", "partial")


def best_pairs(index: Postings, k: int, decimals: int = 6) -> DataFrame:
    """(group, rule_key, chunk_key, score): every pair whose rounded score is above 0 and may be among the rule's first
    ``k``, with its whole score; the pairs that are left out have at least ``k`` better ones.

    As in ranked retrieval with score bounds: a first threshold from the heaviest chunks of a rule's heaviest tokens, then
    only pairs by tokens without which the threshold is out of reach, then the other tokens for the pairs that are left.
    """
    g = index.group
    tokens = durable(split_tokens(index, thresholds(index, k)))
    found = durable(candidates(index, tokens, k))
    others = tokens.where("not essential").select(*g, "rule_key", "band", "token", "wr")
    added = found.select(*g, "rule_key", "chunk_key", "band").join(others, [*g, "rule_key", "band"]).join(index.held, [*g, "chunk_key", "band", "token"])
    parts = found.select(*g, "rule_key", "chunk_key", F.col("partial").alias("part"))
    every = parts.unionByName(added.select(*g, "rule_key", "chunk_key", (F.col("wr") * F.col("wc")).alias("part")))
    return every.groupBy(*g, "rule_key", "chunk_key").agg(F.bround(F.sum("part"), decimals).alias("score")).where("score > 0")


def top_chunks(rules: DataFrame, chunks: DataFrame, k: int, group: list[str] | None = None, decimals: int = 6) -> DataFrame:
    """(group, rule_id, rank, chunk_id, score): the ``k`` best chunks of each rule, ties by chunk id.

    ``rules`` has (group, rule_id, text), ``chunks`` (group, chunk_id, text); both are documents of the frequencies. Pairs
    that cannot be among the first ``k`` are not made (``best_pairs``). A rule with fewer than ``k`` chunks of a common token
    is filled up by the first chunk ids at score 0, as a ranking of all pairs would.
    """
    group = group or []
    scored = best_pairs(postings(rules, chunks, group, decimals), k, decimals)
    kind = dict(chunks.dtypes)["chunk_id"]
    order = Window.partitionBy(*group, "rule_key").orderBy(F.col("score").desc(), "chunk_id")
    named = scored.withColumn("chunk_id", F.col("chunk_key").cast(kind)).drop("chunk_key")
    best = durable(named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    # A rule needs at most k fillers beyond its own hits, so the first 2k chunk ids of its group are enough.
    ids, rule_keys = chunks.select(*group, "chunk_id"), rules.select(*group, "rule_id", F.col("rule_id").cast("string").alias("rule_key"))
    if group:
        first = ids.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("chunk_id"))).where(F.col("__n") <= 2 * k).drop("__n")
    else:
        first = ids.orderBy("chunk_id").limit(2 * k)
    short = rule_keys.join(best.groupBy(*group, "rule_key").agg(F.count("*").alias("__have")), [*group, "rule_key"], "left").where(f"coalesce(__have, 0) < {k}")
    fill = short.select(*group, "rule_key")
    fill = fill.join(first, group) if group else fill.crossJoin(F.broadcast(first))  # at most 2k rows
    fill = fill.join(best.select(*group, "rule_key", "chunk_id"), [*group, "rule_key", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    every = best.drop("rank").unionByName(fill).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return every.join(rule_keys, [*group, "rule_key"]).select(*group, "rule_id", "rank", "chunk_id", "score")


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """n and r1, r3, ...: the share of gold (rule_id, chunk_id) rules whose gold chunk is within the first k."""
    rank = hits.join(gold, ["rule_id", "chunk_id"]).groupBy("rule_id").agg(F.min("rank").alias("rank"))
    asked = gold.select("rule_id").distinct().join(rank, "rule_id", "left")
    share = lambda k: F.bround(F.coalesce(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), F.lit(0.0)), 4).alias(f"r{k}")
    return asked.agg(F.count("*").alias("n"), *map(share, ks))


def gold_ranks(hits: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank): each query's best rank of a gold chunk, null where none was found. ``gold`` has (keys, rule_id, chunk_id)."""
    found = hits.join(gold, ["rule_id", "chunk_id"]).groupBy(*keys).agg(F.min("rank").alias("rank"))
    return gold.select(*keys).distinct().join(found, keys, "left")


def recall_by_category(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(category, n, r1, r3, ...): recall of each category, and of all as ``all``. ``ranks`` has (category, rank)."""
    share = lambda k: F.bround(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 4).alias(f"r{k}")
    sets = ranks.groupingSets([["category"], []], "category").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *map(share, ks))
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", *[f"r{k}" for k in ks])


def misses(ranks: DataFrame, order: list[str], k: int = 5, most: int = 15) -> DataFrame:
    """The first ``most`` queries whose gold chunk is not within the first ``k``."""
    return ranks.where(f"coalesce(rank, {k + 1}) > {k}").drop("rank").orderBy(*order).limit(most)


def constant_context(hits: DataFrame, chunks: DataFrame, most: int = 2, within: list[str] | None = None) -> DataFrame:
    """(within, group_id, rank, file, module_id): for ranked hits, the module chunks of the hits' files that define a constant
    which a hit names, at most ``most``, in the order of the hits and not among them.

    ``hits`` has (within, group_id, rank, chunk_id); ``chunks`` (within, chunk_id, file, qualname, source). ``within`` names
    the columns that tell workspaces apart: equal paths of others are other files.
    """
    within = within or []
    named = chunks.select(*within, "chunk_id", "file", F.explode(F.array_distinct(X.constants(F.col("source")))).alias("constant"))
    shown = hits.select(*within, "group_id", "rank", "chunk_id").join(named, [*within, "chunk_id"])
    modules = chunks.where("qualname = '<module>'").select(*within, "file", F.col("chunk_id").alias("module_id"), F.explode(F.array_distinct(X.defined_constants(F.col("source")))).alias("constant"))
    first = shown.join(modules, [*within, "file", "constant"]).groupBy(*within, "group_id", "file", "module_id").agg(F.min("rank").alias("rank"))
    fresh = first.join(hits.select(*within, "group_id", F.col("chunk_id").alias("module_id")), [*within, "group_id", "module_id"], "left_anti")
    order = Window.partitionBy(*within, "group_id").orderBy("rank", "module_id")
    return fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*within, "group_id", "rank", "file", "module_id")
