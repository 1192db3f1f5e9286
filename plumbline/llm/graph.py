"""Linked groups: candidate pairs from shared keys, verified links, connected components, and a bounded id sieve."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import discard, durable

#: The sieve's bitmap has 2**SIEVE_LOG2 bits, 2**(SIEVE_LOG2 - 6) rows when broadcast, whatever the number of ids.
SIEVE_LOG2 = 22
#: A key of more than CROWD ids is dealt in cells of two blocks of about BLOCK ids; the pairs of others come from a join.
CROWD, BLOCK = 64, 512


def sieve(rows: DataFrame, key: str, ids: DataFrame, id_name: str, keep: bool = True) -> DataFrame:
    """Rows whose key may be among ``ids`` (none of them lost), without shuffling ``rows``; or, with ``keep`` False, the
    rest, whose keys are surely not among them. The broadcast side is one bitmap of fixed size."""
    bits = 1 << SIEVE_LOG2

    def placed(df: DataFrame, column: str) -> DataFrame:
        at = F.pmod(F.xxhash64(column), F.lit(bits))
        return df.withColumn("__word", F.shiftright(at, 6)).withColumn("__bit", F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 64) as int))"))

    words = placed(ids, id_name).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return placed(rows, key).join(F.broadcast(words), "__word", "left").where(found == F.lit(keep)).drop("__word", "__bits", "__bit")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge: the smallest id that it reaches, by alternating large and small stars.

    Each round is a few joins and aggregations over the edges; a hub's edges are never gathered in one row.
    """
    links = durable(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        count, mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (count, mark) == before or not count:
            out = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out.durable_path = links.durable_path
            return out
        before = (count, mark)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where(F.col("u") != F.col("v"))
        older, links = links, durable(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct())
        discard(older)


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (id, component) after more links: what they join are components, so that only those are worked over."""
    at = {s: known.select(F.col("id").alias(f"{s}_id"), F.col("component").alias(f"{s}_of")) for s in "ab"}
    placed = links.join(at["a"], "a_id", "left").join(at["b"], "b_id", "left")
    heads = components(placed.select(F.coalesce("a_of", "a_id").alias("a"), F.coalesce("b_of", "b_id").alias("b")))
    # A component's name is the least of its ids, so the name that a head gets is no larger than it.
    moved = known.join(heads.select(F.col("id").alias("component"), F.col("component").alias("__new")), "component", "left")
    again = moved.select("id", F.coalesce("__new", "component").alias("component"))
    return durable(again.unionByName(heads.join(known.select("id"), "id", "left_anti")))


def crowded(rows: DataFrame, key: str, cell: Callable[[int, pa.Table, pa.Table], pa.Table], inside: DataFrame | None) -> DataFrame:
    """(a_id, b_id, n, need) of the crowded keys of ``rows``, by ``cell``. A block goes to as many cells as its key has
    blocks, so that a cell is bounded and two ids of a key meet in one of its cells."""
    crowd = F.col("__ids") > CROWD
    known = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(crowd, F.col(key)))).alias("crowds"), F.count(F.when(~crowd, 1)).alias("others"))
    known = known.where(F.size("crowds") > 0)
    if inside is not None:
        known = known.join(inside, "id")
    count = F.ceil(F.col("__ids") / BLOCK)
    dealt = rows.where(crowd).join(known, "id").withColumn("__own", F.pmod(F.xxhash64("id"), count))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    dealt = dealt.withColumn("__x", F.least("__own", "__other")).withColumn("__y", F.greatest("__own", "__other")).drop("__other", "score", "__ids")

    def run(at: tuple, table: pa.Table) -> pa.Table:
        name, x, y = (v.as_py() for v in at)
        own = table.column("__own").to_numpy()
        return cell(name, table.filter(pa.array(own == x)), table.filter(pa.array(own == y)))

    return dealt.groupBy(key, "__x", "__y").applyInArrow(run, "a_id long, b_id long, n int, need int")


def paired(a: pa.Table, b: pa.Table, mask: np.ndarray, n: np.ndarray, need: np.ndarray) -> pa.Table:
    """What a cell gives for the pairs of ``mask``; ``n`` and ``need`` have its shape."""
    i, j = np.nonzero(mask)
    x, y = a.column("id").to_numpy()[i], b.column("id").to_numpy()[j]
    flat = [np.minimum(x, y), np.maximum(x, y), n[i, j].astype(np.int32), need[i, j].astype(np.int32)]
    return pa.table([pa.array(v) for v in flat], ["a_id", "b_id", "n", "need"])


def apart(a: pa.Table, b: pa.Table) -> np.ndarray:
    """Which pairs of a cell are of different components; in a cell of one block with itself, each pair once."""
    out = a.column("component").to_numpy()[:, None] != b.column("component").to_numpy()[None, :]
    x, y = a.column("id").to_numpy(), b.column("id").to_numpy()
    return out & (x[:, None] < y[None, :]) if np.array_equal(x, y) else out


def shared_crowds(a: pa.Table, b: pa.Table, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many crowded keys each pair of a cell shares, whether ``key`` is the first of them), by products of 0/1
    matrices over some keys at a time. So a pair that meets in several keys counts in one cell only."""
    sides = []
    for t in (a, b):
        lists = t.column("crowds").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        sides.append((np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()))
    common = np.intersect1d(sides[0][1], sides[1][1])
    total, first = np.zeros((len(a), len(b)), np.float32), np.ones((len(a), len(b)), bool)
    before = int(np.searchsorted(common, key))
    for lo, hi in [*((k, min(k + BLOCK, before)) for k in range(0, before, BLOCK)), *((k, k + BLOCK) for k in range(before, len(common), BLOCK))]:
        some, marks = common[lo:hi], []
        for t, (owner, value) in zip((a, b), sides, strict=True):
            at = np.minimum(np.searchsorted(some, value), len(some) - 1)
            has = some[at] == value
            mark = np.zeros((len(t), len(some)), np.float32)
            mark[owner[has], at[has]] = 1
            marks.append(mark)
        found = marks[0] @ marks[1].T
        total += found
        if lo < before:
            first &= found == 0
    return total, first


def linked_groups(
    shared: DataFrame, key: str, screen: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame],
    need: Callable[[str, str], Column] = lambda a, b: F.lit(1), extra: DataFrame | None = None,
    strict: Callable[[str, str], Column] = lambda a, b: F.lit(True), given: DataFrame | None = None, stars: int = 2,
    each: DataFrame | None = None, cell: Callable[[int, pa.Table, pa.Table], pa.Table] | None = None, inside: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of all verified links among ids that share a key, without trying all pairs of a key.

    ``shared`` has a row for each key of an id: (key, id, met, further columns), met being the number of the key's ids.
    First every id is tried against one of each of its keys, the one that meets most others over all its keys: of a group
    of edited copies the least edited. A key whose ids are then all in one component is done, as no link among them can
    change a component, and so is a key of two ids, whose one pair has been tried. In the keys that are left the same is done for an id of the second component (and so on, ``stars``
    rounds in all), and then all pairs of different components are tried that pass ``screen(a, b)`` (over the two sides'
    columns) and ``strict(a, b)`` (over the columns of ``extra`` (id, ...)) for a key and share ``need(a, b)`` keys. So a
    group of copies costs its size and not its square, and no pair of different components is left untried. ``verify``
    turns pairs (a_id, b_id) into links (a_id, b_id); ``given`` has links that hold anyway, ``each`` further
    columns of every id.

    The pairs of a crowded key are not rows: its ids are dealt in blocks, and ``cell(key, left, right)`` gets each two
    blocks of it once, with the columns of ``shared`` and of ``inside`` (id, ...), component, crowds (the crowded keys of
    the id, ascending) and others (how many further keys it has). It gives (a_id, b_id, n, need) for the pairs of different
    components that may be links: how many crowded keys they share, and how many keys they have to.
    """
    score = shared.groupBy("id").agg(F.sum("met").alias("score"))
    if each is not None:
        score = score.join(each, "id")
    others = [c for c in (*shared.columns, *score.columns) if c not in (key, "id", "met", "score")]
    rows = durable(shared.join(score, "id"))
    whole = [F.col(c) for c in ("score", "id", *others)]
    sides = {s: [F.col(c).alias(f"{s}_{c}") for c in ("id", *others)] for s in "ab"}
    fields = lambda s, of: [F.col(f"{of}.{c}").alias(f"{s}_{c}") for c in ("id", *others)]
    ordered = [F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")]

    centers = rows.groupBy(key).agg(F.max(F.struct(*whole)).alias("center"))
    met = rows.join(centers, key).where(F.col("center.id") != F.col("id")).select(*fields("a", "center"), *sides["b"]).where(screen("a", "b"))
    tried = durable(met.select(*ordered).distinct())
    links = durable(verify(tried))
    known = components(links if given is None else links.unionByName(given), "a_id", "b_id")
    discard(links)
    parts, over = [tried], Window.partitionBy(key)

    def mixed_of(rows: DataFrame) -> DataFrame:
        tagged = rows.drop("component", "__ids").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ends = tagged.withColumn("__low", F.min("component").over(over)).withColumn("__high", F.max("component").over(over))
        return durable(ends.withColumn("__ids", F.count("*").over(over)).where("__low <> __high").drop("__low", "__high"))

    mixed = mixed_of(rows.where("met > 2").drop("met"))  # the one pair of a key of two ids has been tried
    discard(rows)
    for place in range(2, stars + 1):
        heads = mixed.groupBy(key, "component").agg(F.max(F.struct(*whole)).alias("center"))
        rank = F.row_number().over(over.orderBy(F.col("center").desc()))
        centers = heads.withColumn("__rank", rank).where(F.col("__rank") == place).select(key, "center", F.col("component").alias("__of"))
        met = mixed.join(centers, key).where(F.col("component") != F.col("__of")).select(*fields("a", "center"), *sides["b"]).where(screen("a", "b"))
        fresh = durable(met.select(*ordered).distinct().join(tried, ["a_id", "b_id"], "left_anti"))
        more = durable(verify(fresh))
        tried = tried.unionByName(fresh)
        parts.append(fresh)
        if not more.isEmpty():
            older, known = known, merged(known, more)
            before, mixed = mixed, mixed_of(mixed)
            discard(before, older)
        discard(more)
    rows = mixed
    if cell is not None:
        mixed = rows.where(F.col("__ids") <= CROWD)
    if extra is not None:
        mixed = mixed.join(extra, "id")
        sides = {s: [*sides[s], *(F.col(c).alias(f"{s}_{c}") for c in extra.columns if c != "id")] for s in "ab"}
    left = mixed.select(key, F.col("component").alias("__ca"), *sides["a"])
    right = mixed.select(key, F.col("component").alias("__cb"), *sides["b"])
    met = left.join(right, key).where((F.col("a_id") < F.col("b_id")) & (F.col("__ca") != F.col("__cb")) & screen("a", "b") & strict("a", "b"))
    met = met.select("a_id", "b_id", F.lit(1).alias("n"), need("a", "b").alias("need"))
    if cell is not None and not rows.where(F.col("__ids") > CROWD).isEmpty():
        met = met.unionByName(crowded(rows, key, cell, inside))
    counted = met.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a_id", "b_id")
    rest = durable(counted.join(tried, ["a_id", "b_id"], "left_anti"))
    discard(rows, *parts)
    more = durable(verify(rest))
    out = known if more.isEmpty() else merged(known, more)
    discard(rest, more, *([] if out is known else [known]))
    return out
