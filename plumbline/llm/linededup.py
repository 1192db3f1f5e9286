"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line a connected group.

Lines are normalised to their words (A-Z to a-z, every digit to 0, other ASCII characters to gaps). Equal normalised
lines collapse first, by a 128-bit hash and before anything is paired. Two lines are alike if their edit distance is at
most a tenth of the longer one; of each connected group the first occurrence, by (doc_id, line), stays and all others go.

The SimHash is sparse: a word votes in one of ``count`` blocks of 64 bits only, the one that its own hash names. So an
edited word moves two blocks at most and leaves the others as they are, bit for bit, where in a dense SimHash it moves
bits all over. By the pigeonhole principle lines that differ in fewer than ``count / 2`` words share a whole block. Blocks
per line and blocks per join key follow the length (``CLASSES``), so that a key stands for enough text to be rare
however many lines there are; lines near the end of a class have the keys of the next one too. Words of more than 30
characters, as in scripts without spaces, vote by their characters.

Lines of 9 to 59 characters hold too few words for that. There the pigeonhole is on the text, and exact: a line's
``n // 10 + 1`` segments are looked up at every place where at most ``n // 10`` edits can have moved one of them, so that
no pair of the similarity is missed. Below that no edit is allowed, and equal lines fold.

Defined results: lines of fewer than ``min_words`` words are never touched (by default only lines without any word, such
as empty ones); null text has no lines and stays null; a line of any length is whole; rows equal in doc_id and text count
as one document, and are treated alike; a null doc_id orders before all others; an empty table stays empty; extra
columns pass through, the output columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.blocks import ALNUM, MULTIPLIER, U64, Recent, _powers, blocks, byte_sums, find_words, hash_from, hash_words, mix, per_batch, signed
from plumbline.llm.graph import apart, linked_groups, paired, shared_crowds, sieve
from plumbline.session import discard, durable

MIN_WORDS = 1
#: Edits allowed: one in so many characters of the longer line.
EDIT_SHARE = 10
#: Below so many characters the pigeonhole is on the text, from there on on the blocks of the SimHash.
SHORT = 60
#: (first length, blocks of the SimHash, blocks of a key) of the length classes.
CLASSES = ((SHORT, 6, 2), (216, 8, 1), (400, 12, 1))
#: Characters fall into so many bins by the last bits of their first byte; four bins are a number of 64 bits.
BINS = 32
#: A key has to stand for so many bytes of words, or for this share of what it stands for on average in a line of few.
COVER, COVER_SHARE = 16, 0.6
#: Words of more bytes vote by their characters.
LONG_WORD = 30
FOLD = ALNUM.copy()
FOLD[0x30:0x3A] = 0x30
INDEXED, SOUGHT = 1, 2
#: A byte to its eight bits, a byte each.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).ravel()
#: Pairs are verified SIDE_BY_SIDE at a time, but for longer ones than LONG_PATTERN, FEW, and those of MANY_LETTERS.
SIDE_BY_SIDE, LONG_PATTERN, FEW, MANY_LETTERS = 2048, 1536, 28, 160
#: A task gathers pairs of so many characters, or so many of them, before it verifies them, so that many lie side by side.
GATHERED, GATHERED_PAIRS = 1 << 23, 1 << 15
#: Pairs are screened by counts of two neighbouring characters, in so many bins.
COUPLES = 512
#: Keys are dealt in packs: a row holds the keys of a task of one of 2**PACKS_LOG2 ranges, about PACKED of all ranges at a time.
PACKS_LOG2, PACKED = 12, 1 << 19
KEY_ROW = np.dtype([("key", "<u8"), ("id", "<i8"), ("form", "<i4")])
#: The bitmap that says of which lines the texts are needed has 2**BITS_LOG2 bits (2 MB).
BITS_LOG2 = 24


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of all lines, first line of each text and the total); an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(bounds, breaks - 1, "right") - 1
    per_text = np.bincount(owner, minlength=len(bounds) - 1) + 1
    firsts = np.concatenate([[0], np.cumsum(per_text)])
    starts = np.empty(firsts[-1], np.int64)
    rest = np.ones(firsts[-1], bool)
    rest[firsts[:-1]] = False
    starts[firsts[:-1]], starts[rest] = bounds[:-1], breaks
    return np.concatenate([starts, [len(data)]]), firsts


def line_sizes(folded: np.ndarray, a: np.ndarray, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Characters of each normalised line: those of its words and the spaces between."""
    if not len(a):
        return np.zeros(len(firsts) - 1, np.int64)
    size = b - a
    if folded.max() >= 0x80:
        inner = np.concatenate([[0], np.cumsum((folded & 0xC0) == 0x80)])
        size = size - (inner[b] - inner[a])
    total = np.concatenate([[0], np.cumsum(size)])
    words = np.diff(firsts)
    return total[firsts[1:]] - total[firsts[:-1]] + np.maximum(words - 1, 0)


def pick(firsts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words of some lines, bounds of those lines among them)."""
    counts = np.diff(firsts)[rows]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1] - firsts[:-1][rows], counts), bounds


def voters(folded: np.ndarray, a: np.ndarray, b: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) with long words cut into their characters."""
    wide = b - a > LONG_WORD
    if wide.any():  # count characters, not bytes
        inner = np.concatenate([[0], np.cumsum((folded & 0xC0) == 0x80)])
        wide &= b - a - (inner[b] - inner[a]) > LONG_WORD
    if not wide.any():
        return a, b, firsts
    size = b - a
    owner = np.repeat(np.arange(len(a)), np.where(wide, size, 1))
    step = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(wide, size, 1))])[:-1], np.where(wide, size, 1))
    start = a[owner] + step
    opens = ~wide[owner] | ((folded[start] & 0xC0) != 0x80)
    owner, start = owner[opens], start[opens]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    ends = np.where(last, b[owner], np.concatenate([start[1:], [0]]))
    return start, ends, np.searchsorted(owner, firsts)


def block_sums(words: np.ndarray, size: np.ndarray, bounds: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, count): each block's 64 bits, the majority of the hashes of its distinct words (a tie is 0); and the bytes
    of those words, 63 at most for one. (A word that a line repeats would else outvote all others of its block.)"""
    lines = len(bounds) - 1
    block = (words >> U64(48)) * U64(count) >> U64(16)
    group = np.repeat(np.arange(lines, dtype=U64) * U64(count), np.diff(bounds)) + block
    votes = np.sort((group << U64(38)) | ((words & U64(0xFFFFFFFF)) << U64(6)) | np.minimum(size, 63).astype(U64))
    votes = votes[np.concatenate([[True], votes[1:] != votes[:-1]])] if len(votes) else votes
    owner = (votes >> U64(38)).astype(np.int64)
    per_group = np.bincount(owner, minlength=lines * count)
    filled = np.flatnonzero(per_group)
    sums = np.zeros(lines * count, U64)
    if len(filled):
        # Eight counters of a byte in a number; beyond 255 words they wrap, alike for equal blocks.
        lanes = LANES[mix((votes >> U64(6)) & U64(0xFFFFFFFF)).view(np.uint8)].reshape(-1, 8)
        ones = np.add.reduceat(lanes, (np.cumsum(per_group) - per_group)[filled], axis=0).view(np.uint8).reshape(-1, 64)
        sums[filled] = np.packbits(2 * ones.astype(np.int32) > per_group[filled][:, None], axis=1, bitorder="little").view(U64).ravel()
    covered = np.bincount(owner, weights=(votes & U64(63)).astype(np.float64), minlength=lines * count)
    return sums.reshape(lines, count), covered.reshape(lines, count)


def block_keys(words: np.ndarray, size: np.ndarray, bounds: np.ndarray, count: int, chosen: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): all choices of ``chosen`` blocks that cover enough."""
    sums, covered = block_sums(words, size, bounds, count)
    least = np.minimum(COVER, covered.sum(axis=1) * (COVER_SHARE * chosen / count))
    rows, keys = [], []
    for number, some in enumerate(combinations(range(count), chosen)):
        stands = covered[:, some].sum(axis=1)
        row = np.flatnonzero((stands >= least) & (stands > 0))
        key = mix(np.full(len(row), count << 32 | number, U64))
        for k in some:
            key = mix(key ^ sums[row, k]) + U64(k)
        rows.append(row)
        keys.append(mix(key))
    return np.concatenate(rows), np.concatenate(keys)


@cache
def segments(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, width, salt, role) of the keys of a line of ``n`` characters: its own segments, which are indexed, and the
    places where it seeks the segments of lines that are as long or longer."""
    found: dict[tuple[int, int, int], int] = {}
    for other in range(max(n, EDIT_SHARE), SHORT):
        edits, apart = other // EDIT_SHARE, n - other
        if -apart > edits:
            break
        cuts = [k * other // (edits + 1) for k in range(edits + 2)]
        for k in range(edits + 1):
            left, right = cuts[k], cuts[k + 1]
            low = max(0, left - k, left + apart - (edits - k))
            high = min(n - (right - left), left + k, left + apart + (edits - k))
            for at in range(low, high + 1):
                found[at, right - left, other * 8 + k] = SOUGHT
            if other == n:
                found[left, right - left, other * 8 + k] = INDEXED | SOUGHT
    start, width, salt = (np.array(x, np.int64) for x in zip(*found, strict=True))
    return start, width, mix(salt.astype(U64) * MULTIPLIER), np.array(list(found.values()), np.int64)


def segment_keys(folded: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role) of short lines, whose words are given."""
    chars, ends = line_chars(folded, a, b, bounds)
    byte, up, down = _powers(len(chars))
    codes = byte[chars] if not len(chars) or chars.max() < 256 else mix((chars.astype(U64) + U64(1)) * MULTIPLIER)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(codes * up[: len(chars)], dtype=U64)])
    found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        start, width, salt, role = segments(int(n))
        at = ends[rows][:, None] + start[None, :]
        key = mix((sums[at + width] - sums[at]) * down[at] ^ salt)
        found.append((np.repeat(rows, len(start)), key.ravel(), np.tile(role, len(rows))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def line_chars(folded: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, bounds) of normalised lines, laid end to end: words with one space between."""
    size = b - a + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - a, size)
    kept = np.where(at == np.repeat(b, size), 32, folded[np.minimum(at, len(folded) - 1)]).astype(np.uint8)
    edges = np.concatenate([[0], ends])[bounds]
    last = np.zeros(len(kept), bool)
    last[edges[1:][np.diff(edges) > 0] - 1] = True
    kept, edges = kept[~last], edges - np.concatenate([[0], np.cumsum(np.diff(edges) > 0)])
    if not len(kept) or kept.max() < 0x80:
        return kept.astype(np.uint32), edges
    opens = np.concatenate([[0], np.cumsum((kept & 0xC0) != 0x80)])
    return np.frombuffer(kept.tobytes().decode().encode("utf-32-le"), np.uint32), opens[edges]


def line_keys(folded: np.ndarray, a: np.ndarray, b: np.ndarray, firsts: np.ndarray, hashes: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role) of the lines ``rows``; ``length`` has their characters, ``hashes`` those of all words."""
    found = []
    short = np.flatnonzero((length >= EDIT_SHARE - 1) & (length < SHORT))
    if len(short):
        words, bounds = pick(firsts, rows[short])
        line, key, role = segment_keys(folded, a[words], b[words], bounds, length[short])
        found.append((rows[short][line], key, role))
    longest = (length * EDIT_SHARE + EDIT_SHARE - 2) // (EDIT_SHARE - 1)
    froms = np.array([x[0] for x in CLASSES])
    own, other = np.searchsorted(froms, length, "right") - 1, np.searchsorted(froms, longest, "right") - 1
    sums = None
    for k, (_, count, chosen) in enumerate(CLASSES):
        some = rows[(own == k) | (other == k)]
        if not len(some):
            continue
        words, bounds = pick(firsts, some)
        start, end, cut = voters(folded, a[words], b[words], bounds)
        if len(start) == len(words):
            voted = hashes[words]
        else:
            sums = byte_sums(folded) if sums is None else sums
            voted = hash_from(sums, start, end)
        line, key = block_keys(voted, end - start, cut, count, chosen)
        found.append((some[line], key, np.full(len(line), INDEXED | SOUGHT)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def key_packs(docs: DataFrame, min_words: int) -> DataFrame:
    """(pack, rows): the keys of every line as ``KEY_ROW``s with the first half of its hash; ``form`` is four times its characters
    and the key's role. A task sends the keys of a line once, unless so many others came between that it was forgotten."""

    def packs(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        pack = (rows["key"] >> U64(64 - PACKS_LOG2)).astype(np.uint16)
        sizes = np.bincount(pack, minlength=1 << PACKS_LOG2)
        some = np.flatnonzero(sizes)
        edges = np.concatenate([[0], np.cumsum(sizes[some])]) * KEY_ROW.itemsize
        data = rows[np.argsort(pack, kind="stable")].tobytes()
        blobs = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs], ["pack", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, held = Recent(), []
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0)):
                lines, _ = line_bounds(data, bounds)
                folded, a, b, firsts = find_words(data, lines, FOLD)
                hashes = hash_words(folded, a, b)
                (low,) = line_sums(hashes, firsts, 1)
                length = line_sizes(folded, a, b, firsts)
                rows = np.flatnonzero((length >= EDIT_SHARE - 1) & (np.diff(firsts) >= min_words))
                rows = rows[recent.fresh(low[rows])]
                line, key, role = line_keys(folded, a, b, firsts, hashes, rows, length[rows])
                made = np.empty(len(key), KEY_ROW)
                made["key"], made["id"] = key, low[line]
                made["form"] = np.minimum(length[line], (1 << 28)) * 4 + role
                held.append(made)
                if sum(map(len, held)) >= PACKED:
                    yield packs(held)
                    held = []
        if any(map(len, held)):
            yield packs(held)

    return per_batch(docs.select("text"), run, "pack int, rows binary")


def met_keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, met): of the ``KEY_ROW``s of whole keys those at which two lines or more meet, one of them indexed, each line
    once; and how many lines meet there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    again = np.concatenate([[False], key[1:] == key[:-1], [False]])
    rows = rows[order[again[1:] | again[:-1]]]  # most keys have one row
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])]))
    form = np.bitwise_or.reduceat(rows["form"], heads)
    rows = rows[heads]
    rows["form"] = form
    heads = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    met = np.diff(np.concatenate([heads, [len(rows)]]))
    indexed = np.bitwise_or.reduceat(form & INDEXED, heads) != 0
    keep = np.repeat((met > 1) & indexed, met)
    return rows[keep], np.repeat(met, met)[keep]


def shared_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, id, form, met) of the keys at which lines meet. One shuffle of the keys, in packs by ranges of the key: copies
    fold, and keys that nobody can meet at go, which most do; so no row of Spark is made of them."""

    def run(table: pa.Table) -> pa.Table:
        rows, met = met_keys(np.frombuffer(b"".join(table.column("rows").to_pylist()), KEY_ROW))
        flat = [signed(np.ascontiguousarray(rows["key"])), rows["id"], rows["form"], met]
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in flat], ["key", "id", "form", "met"])

    return key_packs(docs, min_words).groupBy("pack").applyInArrow(run, "key long, id long, form int, met long")


def line_sums(words: np.ndarray, firsts: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """The two halves of the hash of each line, or the first."""
    head, tail = firsts[:-1], firsts[1:]
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    position = (np.arange(len(words)) - head[owner]).astype(U64)
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(words + position * U64(factor)), dtype=U64)]) for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:halves]]
    return [signed(s[tail] - s[head]) for s in sums]


def find_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, doc_id, line, low, high) of every line of enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, bounds in blocks(batch.column(2)):
                lines, first_line = line_bounds(data, bounds)
                folded, a, b, firsts = find_words(data, lines, FOLD)
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(first_line))
                number = np.arange(len(text)) - first_line[:-1][text]
                take = np.flatnonzero(np.diff(firsts) >= min_words)
                if not len(take):
                    continue
                low, high = (s[take] for s in line_sums(hash_words(folded, a, b), firsts))
                rows = pa.array(start + text[take])
                flat = [number[take].astype(np.int32), low, high]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, flat)], ["doc", "doc_id", "line", "low", "high"])

    schema = docs.select("doc", "doc_id").schema.add("line", "integer").add("low", "long").add("high", "long")
    return per_batch(docs.select("doc", "doc_id", "text"), run, schema)


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the column ``id``: at most 2**(BITS_LOG2 - 6) rows reach the driver."""
    at = F.pmod("id", F.lit(1 << BITS_LOG2))
    words = ids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(id, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS_LOG2 - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def character_counts(lines: list[bytes]) -> np.ndarray:
    """(lines, BINS / 4): how many characters of each bin a line has, 16 bits a bin, 65,535 at most."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    opens = (data & 0xC0) != 0x80
    found = np.bincount(owner[opens] * BINS + (data[opens] & (BINS - 1)), minlength=len(lines) * BINS)
    return np.minimum(found, 0xFFFF).astype("<u2").reshape(-1, BINS).view("<i8")


def line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, normal, bins): the normalised texts of all lines with an ``id``, and of some others, each once, with their counts of
    characters."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, bits = Recent(), shared.value
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0)):
                lines, _ = line_bounds(data, bounds)
                folded, a, b, firsts = find_words(data, lines, FOLD)
                (low,) = line_sums(hash_words(folded, a, b), firsts, 1)
                at = low & np.int64((1 << BITS_LOG2) - 1)
                rows = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                rows = rows[recent.fresh(low[rows])]
                folded[folded == 0] = 32
                normal = [b" ".join(folded[x:y].tobytes().split()) for x, y in zip(lines[rows].tolist(), lines[rows + 1].tolist(), strict=True)]
                bins = character_counts(normal)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * bins.shape[1], pa.int32()), pa.array(bins.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(low[rows]), pa.array(normal, pa.binary()).cast(pa.string()), lists], ["id", "normal", "bins"])

    return per_batch(docs.select("text"), run, "id long, normal string, bins array<long>").dropDuplicates(["id"])


def common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Without their common ends, the shorter one first."""
    cut = common_start(a, b)
    a, b = a[cut:], b[cut:]
    cut = common_start(a[::-1], b[::-1])
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    return (a, b) if len(a) <= len(b) else (b, a)


def one_within(a: str, b: str, edits: int) -> bool:
    """Whether so many edits turn ``a``, not empty and not longer, into ``b``: a column of the distance table is one number
    whose bits say where it rises and falls, so that a character of ``b`` takes a few operations."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = places.get(c, 0)
        across = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (full & ~(across | rises)), rises & across
        score += 1 if up & top else -1 if down & top else 0
        if score - left > edits:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        same |= falls
        rises, falls = down | (full & ~(same | up)), up & same
    return score <= edits


def all_within(a: list[str], b: list[str], edits: np.ndarray) -> np.ndarray:
    """``one_within`` for many pairs side by side, whose columns all take the same number of 64-bit words. A step takes a
    character of every ``b`` that still has one: the longest come first. Only the words that hold rows within the edits of
    the diagonal are kept up; what lies outside of them is above the edits anyway, and an upper bound stands in for it."""
    order = np.argsort([-len(x) for x in b], kind="stable")
    a, b, edits = [a[k] for k in order], [b[k] for k in order], edits[order]
    pairs, size, steps = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    letters = np.frombuffer("".join(a + b).encode("utf-32-le"), np.uint32)
    known, letter = np.unique(letters, return_inverse=True)
    words, kinds = int(-(-size.max() // 64)), len(known)
    in_a = letter[: size.sum()]
    place = np.arange(len(in_a)) - np.repeat(np.cumsum(size) - size, size)
    masks = np.zeros((words, pairs * kinds), U64)
    np.add.at(masks.reshape(-1), (place >> 6) * (pairs * kinds) + np.repeat(np.arange(pairs), size) * kinds + in_a, U64(1) << (place & 63).astype(U64))
    in_b, heads = letter[size.sum() :], np.cumsum(steps) - steps
    rises, falls = [np.full(pairs, ~U64(0)) for _ in range(words)], [np.zeros(pairs, U64) for _ in range(words)]
    bit, one, last, most = ((size - 1) & 63).astype(U64), U64(1), U64(63), int(edits.max())
    rows, bottom = np.arange(pairs) * kinds, min(words - 1, most // 64)
    score = size.copy() if bottom == words - 1 else np.full(pairs, 64 * (bottom + 1))  # of the last row that is kept up
    active = np.searchsorted(-steps, -np.arange(steps.max()) - 1, "right")  # pairs whose b has more characters than the step
    for step, k in enumerate(active.tolist()):
        at = rows[:k] + in_b[heads[:k] + step]
        if bottom < words - 1 and (step + most) // 64 > bottom:
            bottom += 1
            score += 64 if bottom < words - 1 else size - 64 * bottom
        into_up, into_down = one, U64(0)
        for w in range(max(0, (step - most) // 64), bottom + 1):
            rise, fall = rises[w][:k], falls[w][:k]
            same = masks[w][at]
            vertical = same | fall
            same |= into_down
            across = (((same & rise) + rise) ^ rise) | same
            up, down = fall | ~(across | rise), rise & across
            out_up, out_down = up >> last, down >> last
            if w == bottom:
                low_up, low_down = (up >> bit[:k] & one, down >> bit[:k] & one) if w == words - 1 else (out_up, out_down)
                score[:k] += low_up.astype(np.int64) - low_down.astype(np.int64)
            up, down = (up << one) | into_up, (down << one) | into_down
            rises[w][:k], falls[w][:k] = down | ~(vertical | up), up & vertical
            into_up, into_down = out_up, out_down
    out = np.zeros(pairs, bool)
    out[order] = score <= edits
    return out


def surely_within(a: str, b: str, edits: int) -> bool:
    """Whether a first try at an alignment gets by with so many edits: common runs are kept, and where they end, the next
    characters of ``a`` are looked for a little further on in ``b``. False says nothing."""
    i = j = cost = 0
    while cost <= edits:
        run = common_start(a[i:], b[j:])
        i, j = i + run, j + run
        if cost + max(len(a) - i, len(b) - j) <= edits:
            return True
        for skip in range(0, 48, 4):
            probe = a[i + skip : i + skip + 12]
            at = b.find(probe, j, j + skip + 48) if len(probe) == 12 else -1
            if at >= 0:
                back = min(skip, at - j)
                while back and a[i + skip - back : i + skip] != b[at - back : at]:
                    back -= 1
                i, cost, j = i + skip - back, cost + max(skip, at - j) - back, at - back
                break
        else:
            return False
    return False


def couples(texts: list[str]) -> np.ndarray:
    """(texts, COUPLES): how often each couple of neighbouring characters stands in each text, couples in bins."""
    size = np.array([len(x) for x in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    inner = owner[1:] == owner[:-1]
    pair = (chars[:-1] * np.uint32(0x9E3779B1) + chars[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(23)
    return np.bincount(owner[1:][inner] * COUPLES + pair[inner].astype(np.int32), minlength=len(texts) * COUPLES).reshape(-1, COUPLES)


def like(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs can be alike: an edit takes two couples of neighbouring characters away and brings two at most, so pairs
    whose counts differ by more than four an edit are not, and no pair is lost."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), SIDE_BY_SIDE // 8):
        x, y = a[at : at + SIDE_BY_SIDE // 8], b[at : at + SIDE_BY_SIDE // 8]
        most = np.array([max(len(v), len(w)) // EDIT_SHARE for v, w in zip(x, y, strict=True)])
        keep[at : at + len(x)] = np.abs(couples(x) - couples(y)).sum(axis=1) <= 4 * most
    return keep


def within(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair, whether its edit distance is at most a tenth of the longer one."""
    keep, side_by_side = np.zeros(len(a), bool), {}
    for k in np.flatnonzero(like(a, b)).tolist():
        x, y = a[k], b[k]
        edits = max(len(x), len(y)) // EDIT_SHARE
        if abs(len(x) - len(y)) > edits:
            continue
        x, y = trimmed(x, y)
        if not x or len(y) <= edits:
            keep[k] = len(y) <= edits
        elif surely_within(x, y, edits):
            keep[k] = True
        elif len(x) > LONG_PATTERN:
            keep[k] = one_within(x, y, edits)
        else:
            side_by_side.setdefault(-(-len(x) // 64), []).append((k, x, y, edits))
    for some in side_by_side.values():
        for at in range(0, len(some), SIDE_BY_SIDE):
            k, x, y, edits = (list(v) for v in zip(*some[at : at + SIDE_BY_SIDE], strict=True))
            if len(k) < FEW or len(set("".join(x))) > MANY_LETTERS:
                keep[k] = [one_within(*v) for v in zip(x, y, edits, strict=True)]
            else:
                keep[k] = all_within(x, y, np.array(edits))
    return keep


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id, a_normal, b_normal) to (a_id, b_id) of those that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], ([], []), 0
        for batch in batches:
            ids.append(pa.RecordBatch.from_arrays(batch.columns[:2], ["a_id", "b_id"]))
            for side, column in zip(texts, batch.columns[2:], strict=True):
                side += column.to_pylist()
                size += column.nbytes
            if size >= GATHERED or len(texts[0]) >= GATHERED_PAIRS:
                yield from pa.Table.from_batches(ids).filter(pa.array(within(*texts))).to_batches()
                ids, texts, size = [], ([], []), 0
        if ids:
            yield from pa.Table.from_batches(ids).filter(pa.array(within(*texts))).to_batches()

    return per_batch(pairs, run, pairs.select("a_id", "b_id").schema)


def crowd_links(key: int, a: pa.Table, b: pa.Table) -> pa.Table:
    """Links between the lines of two blocks of a crowded key, as many as join what is alike (``graph.linked_groups``).
    Pairs are screened as in the join, and verified in the order in which their counts of characters differ; a pair
    whose lines have been joined by others is not, as its link would change no component."""
    bins = [np.ascontiguousarray(t.column("bins").combine_chunks().flatten().to_numpy()).view("<u2").reshape(-1, BINS).astype(np.int32) for t in (a, b)]
    size = [t.column("form").to_numpy().astype(np.int64) >> 2 for t in (a, b)]
    longer, uneven = np.maximum(size[0][:, None], size[1][None, :]), np.abs(size[0][:, None] - size[1][None, :])
    counts = sum(np.abs(bins[0][:, k][:, None] - bins[1][:, k][None, :]) for k in range(BINS))
    mask = apart(a, b) & (uneven * EDIT_SHARE <= longer) & (EDIT_SHARE * (counts + uneven) <= 2 * longer + 2 * EDIT_SHARE - 2)
    _, first = shared_crowds(a, b, key)
    mask &= first
    i, j = np.nonzero(mask)
    order = np.argsort(counts[i, j], kind="stable")
    i, j = i[order], j[order]
    names, label = np.unique(np.concatenate([t.column("component").to_numpy() for t in (a, b)]), return_inverse=True)
    of, at, texts = np.arange(len(names)), [label[: len(a)], label[len(a) :]], [t.column("normal").to_pylist() for t in (a, b)]
    linked = np.zeros(mask.shape, bool)
    step = 32
    while len(i):
        keep = within([texts[0][k] for k in i[:step]], [texts[1][k] for k in j[:step]])
        for x, y in zip(i[:step][keep].tolist(), j[:step][keep].tolist(), strict=True):
            left, right = of[at[0][x]], of[at[1][y]]
            if left != right:
                linked[x, y] = True
                of[of == right] = left
        i, j = i[step:], j[step:]
        open_ = of[at[0][i]] != of[at[1][j]]
        i, j, step = i[open_], j[open_], min(2 * step, SIDE_BY_SIDE)
    return paired(a, b, linked, linked, linked)


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, doc_id, removed): for each document that has some, the numbers of its lines that go, ascending.

    ``docs`` has doc (a hash of the row's doc_id and text), doc_id and text. Lines are paired by the first half of their
    hashes, so as if no two different lines of the corpus had that in common."""
    lines = durable(find_lines(docs, min_words))
    place = F.struct("doc_id", "doc", "line")
    # Most lines stand once, so that adding them up before they are dealt would only sort them once more.
    distinct = durable(lines.repartition("low", "high").groupBy("low", "high").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    shared = durable(shared_keys(docs, min_words))
    texts = durable(line_texts(docs, shared.select("id")))

    def near(a: str, b: str):
        """The lengths allow it, and one of the two seeks what the other has indexed."""
        n, m = (F.shiftright(f"{s}_form", 2) for s in (a, b))
        has = lambda s, bit: F.col(f"{s}_form").bitwiseAND(F.lit(bit)) != 0
        meet = (has(a, INDEXED) & has(b, SOUGHT)) | (has(a, SOUGHT) & has(b, INDEXED))
        return (F.abs(n - m) * EDIT_SHARE <= F.greatest(n, m)) & meet

    def verify(found: DataFrame) -> DataFrame:
        a, b = (sieve(texts, "id", found, f"{s}_id").select(F.col("id").alias(f"{s}_id"), F.col("normal").alias(f"{s}_normal")) for s in "ab")
        return verified(found.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", "a_normal", "b_normal"))

    def close(a: str, b: str):
        """An edit changes the counts of two bins by one at most, or of one bin and the length: what differs in more is not
        alike, so that no pair is lost."""
        lane = lambda side, k: F.shiftrightunsigned(F.col(f"{side}_bins")[k // 4], 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
        apart = sum((F.abs(lane(a, k) - lane(b, k)) for k in range(BINS)), F.lit(0))
        n, m = (F.shiftright(f"{side}_form", 2) for side in (a, b))
        return EDIT_SHARE * (apart + F.abs(n - m)) <= 2 * F.greatest(n, m) + 2 * EDIT_SHARE - 2

    groups = linked_groups(shared, "key", near, verify, extra=texts.select("id", "bins"), strict=close, cell=crowd_links, inside=texts)
    grouped = durable(groups.unionByName(groups.select(F.col("component").alias("id"), "component").distinct()))
    discard(shared, texts, groups)
    members = grouped.join(distinct, F.col("id") == F.col("low")).select("component", "low", "high", "first", "n")
    heads = durable(members.groupBy("component").agg(F.min("first").alias("kept")))
    moved = members.join(heads, "component").where((F.col("n") > 1) | (F.col("kept") != F.col("first"))).select("low", "high", "kept")
    alone = distinct.where("n > 1").join(grouped, F.col("low") == F.col("id"), "left_anti").select("low", "high", F.col("first").alias("kept"))
    moved = durable(moved.unionByName(alone))
    discard(distinct, grouped, heads)
    gone = sieve(lines, "low", moved, "low").join(moved, ["low", "high"]).where(F.struct("doc_id", "doc", "line") != F.col("kept"))
    return gone.groupBy("doc", "doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.xxhash64("doc_id", "text"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its text without the repeated lines, and ``removed_lines`` (their numbers)."""
    docs = docs.drop("removed_lines")
    given = docs.withColumn("__doc", F.xxhash64("doc_id", "text"))
    gone = durable(repeated_lines(keyed(docs.select("doc_id", "text")), **options))
    untouched = sieve(given, "__doc", gone, "doc", keep=False).withColumn("removed_lines", F.array().cast("array<int>"))
    drops = gone.select(F.col("doc").alias("__doc"), F.col("doc_id").alias("__id"), "removed")
    rest = sieve(given, "__doc", gone, "doc")
    touched = rest.join(drops, (rest["__doc"] == drops["__doc"]) & rest["doc_id"].eqNullSafe(drops["__id"]), "left")
    touched = touched.select(*[rest[c] for c in docs.columns], F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, drop in zip(batch.column(at), batch.column(width), strict=True):
                text, drop = text.as_py(), set(drop.as_py())
                texts.append(text if not drop else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = T.StructType([*docs.schema.fields, T.StructField("removed_lines", T.ArrayType(T.IntegerType()))])
    return untouched.select(*docs.columns, "removed_lines").unionByName(per_batch(touched, run, schema))


def removals(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of every document."""
    docs = docs.select("doc_id", "text")
    gone = repeated_lines(keyed(docs), **options).select("doc", F.col("doc_id").alias("__id"), "removed")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    every = keyed(docs).select("doc", "doc_id", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    found = every.join(gone, (every["doc"] == gone["doc"]) & every["doc_id"].eqNullSafe(gone["__id"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
