"""Near-duplicate groups by word-shingle Jaccard, joined on adaptive multi-match prefixes.

Every document is the set of its distinct five-word shingles. Equal sets collapse to one representative first. The
others are joined on prefixes: with the shingles in one global order, two sets of Jaccard 3/4 or more share at least
``l`` shingles among their first ``n - ceil(3n/4) + l``. The order puts rare shingles first; how frequent a shingle is
comes from counters of fixed size that all documents feed. Each document lengthens its own prefix (raises its ``l``)
while the estimated candidates of the longer prefix, divided by the more matches asked for, cost less. A pair is
verified when it shares at least the smaller of its two ``l``, if neither the places of a common shingle nor the parity
bitmaps of the sets rule it out; verification compares the whole sets.

Only documents that share a prefix shingle with a different set are read again for verification. Links are exact;
components are the smallest doc_id reachable.

Defined results: null and wordless texts have no shingles and are linked with nothing; fewer words than the width are
one shingle; equal texts share a component; a doc_id that occurs with several texts is one vertex with the links of
all of them; a null doc_id takes the component of its equal texts with an id, or null; an empty table gives an empty result; extra columns are not read.
Memory of a task follows the longest text and the fixed counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.blocks import SPACED, U64, Recent, blocks, distinct, find_words, hash_words, mix, per_batch, shingles, signed
from plumbline.llm.graph import apart, linked_groups, paired, shared_crowds, sieve
from plumbline.session import discard, durable

WIDTH = 5
#: Jaccard threshold NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Counters of the shingle frequencies, cut into slices for their sum; a task counts to 65535. (They only steer the order.)
COUNTERS, SLICES, MOST = 1 << 21, 64, 65535
LONGEST = 4
#: Words of 64 bits of a set's parity bitmap.
PARITY = 8
#: Sets of more than WIDE_FROM values have a second one of two to four bits a value, as theirs is full.
WIDE_FROM = 256
#: A prefix row has the place of its shingle, and in the last bits how many matches its set asks for.
MATCH_BITS = 3
#: Verifying a candidate costs about as much as so many entries of an inverted list.
VERIFY_COST = 16


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes, bounds) by blocks of whole texts."""
    for start, _, data, bounds in blocks(column):
        folded, a, b, firsts = find_words(data, bounds, SPACED)
        yield start, *distinct(*shingles(hash_words(folded, a, b), firsts, width))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def parity(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, PARITY): each value flips one bit. Two sets differ in at least as many values as their bitmaps do in bits."""
    rows, bits = len(bounds) - 1, 64 * PARITY
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    odd = np.bincount(owner * bits + ((values >> U64(32)) & U64(bits - 1)).astype(np.int64), minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def wide_parity(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """The parity bitmaps of large sets, by the same bits of a value: one half laid over the other makes the smaller one."""
    out: list[bytes | None] = []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = 1 << (2 * (y - x) - 1).bit_length() if y - x > WIDE_FROM else 0
        odd = np.bincount(((values[x:y] >> U64(32)) & U64(max(bits - 1, 0))).astype(np.int64), minlength=bits) & 1 if bits else None
        out.append(None if odd is None else np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def maybe_alike(pairs: DataFrame) -> DataFrame:
    """Pairs (..., a_n, b_n, a_wide, b_wide) without those whose wide bitmaps differ in too many bits; the names stay."""
    names = ["a_id", "b_id", "a_name", "b_name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            sizes = (batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()).tolist()
            for k, (x, y) in enumerate(zip(batch.column("a_wide").to_pylist(), batch.column("b_wide").to_pylist(), strict=True)):
                if x is not None and y is not None:
                    x, y = sorted((np.frombuffer(x, U64), np.frombuffer(y, U64)), key=len)
                    while len(y) > len(x):
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                    keep[k] = (NUMERATOR + DENOMINATOR) * int(np.bitwise_count(x ^ y).sum()) <= (DENOMINATOR - NUMERATOR) * sizes[k]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in names], names)

    return per_batch(pairs.select(*names, "a_n", "b_n", "a_wide", "b_wide"), run, pairs.select(*names).schema)


def crowd_pairs(key: int, a: pa.Table, b: pa.Table) -> pa.Table:
    """The pairs of two blocks of a crowded shingle that neither its places nor the parity bitmaps rule out
    (``graph.linked_groups``), each by the first crowded shingle that it shares."""
    n, form = ([t.column(c).to_numpy().astype(np.int64) for t in (a, b)] for c in ("n", "form"))
    cross = lambda f, x: f(x[0][:, None], x[1][None, :])
    place, need = [x >> MATCH_BITS for x in form], cross(np.minimum, [x & ((1 << MATCH_BITS) - 1) for x in form])
    size, most = cross(np.add, n), cross(np.minimum, place) + cross(np.minimum, [x - y for x, y in zip(n, place, strict=True)])
    bits = [t.column("parity").combine_chunks().flatten().to_numpy().view(U64).reshape(-1, PARITY) for t in (a, b)]
    differing = sum(np.bitwise_count(bits[0][:, k][:, None] ^ bits[1][:, k][None, :]).astype(np.int64) for k in range(PARITY))
    mask = apart(a, b) & ((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * size) & ((NUMERATOR + DENOMINATOR) * differing <= (DENOMINATOR - NUMERATOR) * size)
    total, first = shared_crowds(a, b, key)
    mask &= first & (total + cross(np.minimum, [t.column("others").to_numpy() for t in (a, b)]) >= need)
    return paired(a, b, mask, total, need)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """For each document its set's size, 128-bit sum and parity bitmaps; and the shingle counters of each task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(COUNTERS, np.int32), None
        for batch in batches:
            names, n, low, high = [*batch.schema.names[:1], "n", "low", "high", "parity", "wide", "slice", "counts"], [], [], []
            marks, wide = [], []
            for _, values, bounds in sets_of(batch.column(1), width):
                np.add.at(counts, (values & U64(COUNTERS - 1)).astype(np.int64), 1)
                n.append(np.diff(bounds))
                low.append(signed(sums(mix(values), bounds)))
                high.append(signed(sums(mix(values ^ U64(0x5851F42D4C957F2D)), bounds)))
                marks.append(parity(values, bounds))
                wide += wide_parity(values, bounds)
            rows = batch.num_rows
            bits = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(marks).ravel() if marks else np.zeros(0, np.int64)))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (n, low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *flat, bits, pa.array(wide, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if names:
            parts = counts.reshape(SLICES, -1)
            empty = [pa.nulls(SLICES, t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([np.minimum(p, MOST).astype(np.uint16).tobytes() for p in parts], pa.binary())], names)

    schema = docs.select("doc_id").schema.add("n", "long").add("low", "long").add("high", "long").add("parity", T.ArrayType(T.LongType())).add("wide", "binary").add("slice", "integer").add("counts", "binary")
    return per_batch(docs.select("doc_id", "text"), run, schema)


def counters(described: DataFrame) -> np.ndarray:
    """The summed counters: fixed size, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, np.int64(0)) + np.frombuffer(part, np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in totals.values()], pa.binary())], ["slice", "counts"])

    parts = per_batch(described.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice"), run, "slice int, counts binary").collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int32)
    for row in parts:
        out[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def taken(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets, with their bounds."""
    size = np.diff(bounds)[rows]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(ends[-1]) + np.repeat(bounds[:-1][rows] - ends[:-1], size)], ends


def prefixes(values: np.ndarray, bounds: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``values`` of all prefix shingles, prefix length of each set, its number of matches asked for)."""
    n = np.diff(bounds)
    frequency = counts[(values & U64(COUNTERS - 1)).astype(np.int64)]
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((frequency, owner))  # stable: equal frequencies stay in hash order
    excess = np.concatenate([[0.0], np.cumsum(np.maximum(frequency[order] - noise, 0))])
    overlap = -(-NUMERATOR * n // DENOMINATOR)
    best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for matches in range(1, LONGEST + 1):
        can = (overlap >= matches) & (n > 0)
        size = np.where(can, n - overlap + matches, 0)
        scanned = excess[bounds[:-1] + size] - excess[bounds[:-1]]
        price = np.where(can, scanned * (1 + VERIFY_COST / matches), np.inf)
        better = price < cost * (1 - 1e-9)
        best, cost = np.where(better, matches, best), np.where(better, price, cost)
    size = np.where(n > 0, n - overlap + best, 0)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[:-1], size)
    return order[at], size, best


def prefix_rows(docs: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """(token, id, form) for the prefix of every set; the id is half of its 128-bit sum, the form has place and matches. A task sends an equal
    set once, unless so many others came between that it was forgotten: copies fold before the shuffle."""
    mean = float(counts.mean())
    shared, noise = docs.sparkSession.sparkContext.broadcast(counts), mean + 3 * mean**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, values, bounds in sets_of(batch.column(0), width):
                low = signed(sums(mix(values), bounds))
                rows = np.flatnonzero(np.diff(bounds) > 0)
                rows = rows[recent.fresh(low[rows])]
                low, (values, bounds) = low[rows], taken(values, bounds, rows)
                at, size, best = prefixes(values, bounds, shared.value, noise)
                owner = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                form = (place << MATCH_BITS) + best[owner]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(values[at]), low[owner], form.astype(np.int32))], ["token", "id", "form"])

    return per_batch(docs.select("text"), run, "token long, id long, form int")


def alike(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a_id, b_id, a_name, b_name) to (a_id, b_id) of those whose whole sets reach the threshold. The names are
    documents, whose texts ``texts`` has (doc_id, text)."""

    def one(column: pa.Array) -> np.ndarray:
        return next(sets_of(column, width))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = np.zeros(batch.num_rows, bool), None, None
            for start, values, bounds in sets_of(batch.column(3), width):
                for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), start):
                    if last is None or not batch.column(0)[k].equals(last) or not batch.column(2)[k].equals(batch.column(2)[k - 1]):
                        last, left = batch.column(0)[k], one(batch.column(2).slice(k, 1))
                    both = np.concatenate([left, values[x:y]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[k] = common > 0 and DENOMINATOR * common >= NUMERATOR * (len(both) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a_id", "b_id"])

    a, b = (texts.select(F.col("doc_id").alias(f"{s}_name"), F.col("text").alias(f"{s}_text")) for s in "ab")
    return per_batch(pairs.join(b, "b_name").join(a, "a_name").select("a_id", "b_id", "a_text", "b_text"), run, pairs.select("a_id", "b_id").schema)


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, representative, component_id) of every document."""
    docs = docs.select("doc_id", "text")
    described = durable(describe(docs, width))
    counts = counters(described)
    rows = described.where("slice is null").drop("slice", "counts")
    equal = rows.where("n > 0").groupBy("n", "low", "high").agg(F.min("doc_id").alias("representative"), F.min("parity").alias("parity"), F.min("wide").alias("wide"))
    # A table of its own, so that the join can split a large group of copies over tasks.
    vertices = durable(equal.select(F.col("low").alias("id"), F.col("representative").alias("name"), "n", "high", "parity", "wide"))
    known = vertices.select("n", F.col("id").alias("low"), "high", F.col("name").alias("representative"))
    members = durable(rows.drop("parity", "wide").join(known, ["n", "low", "high"], "left").select("doc_id", "n", "low", F.coalesce("representative", "doc_id").alias("representative")))
    vertices = vertices.where("name is not null").drop("high")
    # One shuffle of the prefixes: equal sets fold, and single shingles go.
    folded = prefix_rows(docs, counts, width).repartition("token").groupBy("token", "id").agg(F.min("form").alias("form"))
    shared = durable(folded.withColumn("met", F.count("*").over(Window.partitionBy("token"))).where("met > 1"))
    # The sets of a doc_id that stands there with several texts.
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.collect_set("low").alias("lows")).where("size(lows) > 1")
    given = several.select(F.col("lows")[0].alias("a_id"), F.explode("lows").alias("b_id"))

    def possible(a: str, b: str):
        """Whatever precedes a common shingle in both sets and follows it in both must reach the threshold together."""
        n = {s: F.col(f"{s}_n") for s in (a, b)}
        place = {s: F.shiftright(f"{s}_form", MATCH_BITS) for s in (a, b)}
        most = F.least(place[a], place[b]) + F.least(n[a] - place[a], n[b] - place[b])
        return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n[a] + n[b])

    def differ(a: str, b: str):
        """The parity bitmaps differ in no more bits than sets at the threshold differ in values."""
        bits = sum((F.bit_count(F.col(f"{a}_parity")[k].bitwiseXOR(F.col(f"{b}_parity")[k])) for k in range(PARITY)), F.lit(0))
        return (NUMERATOR + DENOMINATOR) * bits <= (DENOMINATOR - NUMERATOR) * (F.col(f"{a}_n") + F.col(f"{b}_n"))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (vertices.select(*(F.col(c).alias(f"{s}_{c}") for c in vertices.columns)) for s in "ab")
        named = durable(maybe_alike(pairs.join(a, "a_id").join(b, "b_id").where(differ("a", "b"))))
        wanted = named.select(F.col("a_name").alias("id")).unionByName(named.select(F.col("b_name").alias("id"))).distinct()
        return alike(named, sieve(docs, "doc_id", wanted, "id"), width)

    def need(a: str, b: str):
        return F.least(*(F.col(f"{s}_form").bitwiseAND(F.lit((1 << MATCH_BITS) - 1)) for s in (a, b)))

    marks = vertices.select("id", "parity")
    groups = linked_groups(shared, "token", possible, verify, need, extra=marks, strict=differ, given=given, each=vertices.select("id", "n"), cell=crowd_pairs, inside=marks)
    grouped = groups.unionByName(groups.select(F.col("component").alias("id"), "component").distinct())
    placed = durable(grouped.join(vertices.select("id", "name"), "id"))
    heads = durable(placed.groupBy("component").agg(F.min("name").alias("component_id")))
    final = durable(placed.join(heads, "component").select("id", "component_id"))
    discard(described, shared, placed, heads, groups)
    found = members.join(final, F.col("low") == F.col("id"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "representative", F.coalesce("component_id", "representative").alias("component_id"))
