"""SentencePiece encoding and decoding as weighted transduction.

Three machines are compiled from a model file: the normaliser as the file sets it (dummy prefix, spaces to the visible
space; a character map or another setting is refused), the piece lexicon with byte fallback for characters that no piece
has, and a bigram acceptor over pieces. Weights are of the tropical semiring, the least sum wins. The file's kind is BPE,
whose encoding is no best-scoring path of the lexicon; so the acceptor carries the kind's weights: two pieces that stay
apart when their joined string is merged weigh 0, all others infinity. A merge sequence never crosses a boundary of the
result, so a piece string is the model's encoding of an input if and only if each neighbouring pair encodes to itself,
and the shortest path through input, lexicon and acceptor is the encoding. ``path`` relaxes arcs of finite weight only; a
state is a place with the last piece. The same holds for every prefix of the input, so that a place has one state of
finite weight at most.

The composition falls apart at places that no piece spans (before a space after other text, around line breaks). These
segments are found for a block of texts at a time, and each distinct one is composed once and remembered in a memo of
bounded size that ends with the task.

Defined results: null and empty text have no ids; equal texts have equal ids, repeated rows repeat them; decoding gives
the text back with every visible space read as a space, whatever the text; texts of any length are whole; an empty table
stays empty; of extra columns the carried ones pass through and the output columns replace those of the same name. No
ties arise: the path of finite weight is the only one. (Segments of a block are told apart by 64-bit hashes.)
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.blocks import blocks, hash_words, per_batch
from plumbline.session import file_bytes

SPACE = "▁"
#: Entries of a memo's generation, of segments of REMEMBERED bytes or less; entries of the acceptor's compiled arcs.
MEMO, REMEMBERED = 100_000, 48
PAIRS = 200_000
#: Texts are encoded by so many bytes at a time. Codes of pieces are ids, those of characters without a piece come after
#: them, and all are below 2**CODE.
ENCODED, CODE = 1 << 19, 21
#: Segments of more characters are cut where no piece can join them, before they are composed.
WHOLE = 24
NEVER, INFINITE = float("-inf"), float("inf")
#: Fixed values of the model file: kinds of models, kinds of pieces.
BPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Transducer:
    """Normaliser, lexicon with byte fallback and bigram acceptor of one model file, given as bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        train, normal = spec.trainer_spec, spec.normalizer_spec
        refused = {
            "a kind other than BPE": train.model_type != BPE, "no byte fallback": not train.byte_fallback, "spaces as suffixes": train.treat_whitespace_as_suffix,
            "a character map": bool(normal.precompiled_charsmap), "removal of spaces": normal.remove_extra_whitespaces, "unescaped spaces": not normal.escape_whitespaces,
            "pieces of the user": any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in spec.pieces),
        }
        if any(refused.values()):
            raise ValueError("this model file has " + ", ".join(k for k, v in refused.items() if v))
        self.prefix = bool(normal.add_dummy_prefix)
        self.surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for k, piece in enumerate(spec.pieces):
            if piece.type == BYTE:
                self.bytes[int(piece.piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece.piece[3:5], 16)]))
            elif piece.type == NORMAL:
                self.ids[piece.piece], self.scores[piece.piece] = k, piece.score
                self.surface.append(piece.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(b"")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece of this model spans a segment boundary")
        #: Compiled arcs of the acceptor, by the codes of both pieces in one number: strings would take three times the memory.
        self.clear: dict[int, bool] = {}
        self.proper = {p for p in self.ids if self.merged(p) == [p]}
        #: Neighbouring characters of some piece; between any others the composition falls apart.
        self.joints = {p[k : k + 2] for p in self.proper for k in range(len(p) - 1)}
        #: All beginnings of pieces, the lexicon as a trie: the id of a beginning that is a piece itself, else -1.
        self.lexicon = {p[:k]: -1 for p in self.proper for k in range(1, len(p) + 1)} | {p: self.ids[p] for p in self.proper}
        #: Surfaces end to end, with their bounds.
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in self.surface])])

    def merged(self, text: str) -> list[str]:
        """Best-score-first merges of a short string, leftmost among equals; only for compiling weights."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b, NEVER) for a, b in pairwise(parts)]
        while gains and (best := max(gains)) > NEVER:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k < len(gains):
                gains[k] = score(parts[k] + parts[k + 1], NEVER)
            if k:
                gains[k - 1] = score(parts[k - 1] + parts[k], NEVER)
        return parts

    def weight(self, last: str, piece: str) -> float:
        """The acceptor's arc from one piece to the next."""
        return 0.0 if self.merged(last + piece) == [last, piece] else INFINITE

    def compile(self, pair: int, last: str, piece: str) -> bool:
        """Whether the acceptor's arc of two codes is finite; remembered."""
        if len(self.clear) >= PAIRS:
            self.clear.clear()
        apart = self.clear[pair] = self.weight(last, piece) == 0.0
        return apart

    def cut(self, segment: str) -> list[str]:
        at = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.joints]
        return [segment[a:b] for a, b in pairwise([0, *at, len(segment)])]

    def reach(self, segment: str, place: int) -> list[tuple[int, int]]:
        """The lexicon's arcs (end, code) that leave a place; of a character without a piece, its bytes as one arc."""
        find, out = self.lexicon.get, []
        for end in range(place + 1, len(segment) + 1):
            k = find(segment[place:end])
            if k is None:
                break
            if k >= 0:
                out.append((end, k))
        return out or [(place + 1, len(self.surface) + ord(segment[place]))]

    def arcs(self, segment: str, place: int) -> list[tuple[int, str]]:
        return [(end, segment[place:end]) for end, _ in self.reach(segment, place)]

    def path(self, segment: str) -> list[int]:
        """Ids on the shortest path through the composition with ``segment``. Weights are 0 or infinite, so an arc that turns out
        finite has the least weight that its end can have, and settles it; which arc is relaxed first changes no result. It is
        the one that reaches furthest from the place settled last; its acceptor weight is looked up only then."""
        size, clear = len(segment), self.clear.get
        #: The last piece of the places settled: its code and where it starts.
        last, start = [-1] * (size + 1), [0] * (size + 1)
        waiting = [(end, code, 0) for end, code in self.reach(segment, 0)]
        while last[size] < 0:
            end, code, place = waiting.pop()
            if last[end] >= 0:
                continue
            if place:
                apart = clear(pair := last[place] << CODE | code)
                if not (self.compile(pair, segment[start[place] : place], segment[place:end]) if apart is None else apart):
                    continue
            last[end], start[end] = code, place
            if end < size:
                waiting.extend((further, following, end) for further, following in self.reach(segment, end) if last[further] < 0)
        out: list[int] = []
        while size:
            code, place = last[size], start[size]
            out.extend([code] if code < len(self.surface) else [self.bytes[b] for b in reversed(segment[place:size].encode())])
            size = place
        out.reverse()
        return out

    def gives_back(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each segment (bytes of ``data``), whether the surfaces of its ids, ``sizes`` of them, end to end are its bytes."""
        width = np.diff(self.edges)[ids]
        place = np.concatenate([[0], np.cumsum(width)])
        stops = np.cumsum(sizes)
        made = place[stops] - place[stops - sizes]
        same = made == ends - starts
        held = np.repeat(same, sizes)
        ids, width, length = ids[held], width[held], made[same]
        said = self.surfaces[np.arange(width.sum()) + np.repeat(self.edges[ids] - (np.cumsum(width) - width), width)]
        stops = np.cumsum(length)
        given = data[np.arange(len(said)) + np.repeat(starts[same] - (stops - length), length)]
        wrong = np.concatenate([[0], np.cumsum(said != given)])
        same[same] = wrong[stops] == wrong[stops - length]
        return same

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes end to end, without the dummy prefix."""
        whole = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (whole.removeprefix(b" ") if self.prefix else whole).decode("utf-8", "replace")


class Memo:
    """Segments (bytes, with plain spaces) to their ids. Two bounded generations: what is in use moves to the younger."""

    def __init__(self, machine: Transducer):
        self.machine, self.young, self.old = machine, {}, {}

    def ids(self, segment: bytes) -> bytes:
        known = self.young.get(segment)
        if known is not None:
            return known
        known = self.old.get(segment)
        if known is None:
            text = segment.decode().replace(" ", SPACE)
            parts = self.machine.cut(text) if len(text) > WHOLE else [text]
            if len(parts) == 1:
                known = array("i", self.machine.path(text)).tobytes()
            else:
                known = b"".join(self.ids(x.replace(SPACE, " ").encode()) for x in parts)
        if len(segment) <= REMEMBERED:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[segment] = known
        return known


@cache
def machine(digest: str, model: bytes) -> Transducer:
    """One transducer a file; the driver's."""
    return Transducer(model)


def compiled(model: bytes) -> Transducer:
    return machine(hashlib.sha256(model).hexdigest(), model)


def packed(model: str) -> bytes:
    """The transducer of a file for the tasks: each unpacks one of its own, so that no worker keeps it after its task."""
    return pickle.dumps(compiled(file_bytes(model)), pickle.HIGHEST_PROTOCOL)


def padded(data: np.ndarray, bounds: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the dummy prefix, as the normaliser writes it: a space before each that is not empty."""
    if not prefix:
        return data, bounds
    held = (np.diff(bounds) > 0).astype(np.int64)
    edges = bounds + np.concatenate([[0], np.cumsum(held)])
    out = np.full(edges[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(held), np.diff(bounds))] = data
    return out, edges


def segment_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where segments start: at a text, at a line break and after it, at a space after other text."""
    start = np.zeros(len(data), bool)
    space, line = data == 32, data == 10
    start[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    start[edges[:-1][edges[:-1] < edges[1:]]] = True
    return np.flatnonzero(start)


def encode_block(memo: Memo, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of the texts among them, whether decoding gives each text back)."""
    text, edges = padded(data, bounds, memo.machine.prefix)
    starts = segment_starts(text, edges)
    if not len(starts):
        rows = len(bounds) - 1
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64), np.ones(rows, bool)
    ends = np.concatenate([starts[1:], [len(text)]])
    _, first, which = np.unique(hash_words(text, starts, ends), return_index=True, return_inverse=True)
    raw = text.tobytes()
    segments = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    found = [memo.ids(x) for x in segments]
    size = np.array([len(k) // 4 for k in found])
    every = np.frombuffer(b"".join(found), np.int32)
    same = memo.machine.gives_back(every, size, text, starts[first], ends[first])
    heads = np.cumsum(size) - size
    counts = size[which]
    ends_at = np.concatenate([[0], np.cumsum(counts)])
    ids = every[np.arange(ends_at[-1]) + np.repeat(heads[which] - ends_at[:-1], counts)]
    texts = np.searchsorted(starts, edges)
    wrong = np.concatenate([[0], np.cumsum(~same[which])])
    return ids, ends_at[texts], wrong[texts[1:]] == wrong[texts[:-1]]


def encode_documents(docs: DataFrame, model: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``ids``, ``n_tokens``, ``ids_sha256`` (of the ids as 32-bit numbers, low byte first)
    and ``round_trip`` (decoding the ids gives the text back, visible spaces read as spaces)."""
    given = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    width, shared = len(carry), docs.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(pickle.loads(shared.value))
        for batch in batches:
            column = pc.replace_substring(batch.column(width), SPACE, " ")
            for a, b, data, bounds in blocks(column, ENCODED):
                ids, edges, same = encode_block(memo, data, bounds)
                flat = ids.astype("<i4").tobytes()
                sums = [hashlib.sha256(flat[4 * x : 4 * y]).hexdigest() for x, y in pairwise(edges.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:width]), lists, pa.array(np.diff(edges)), pa.array(sums, pa.string()), pa.array(same)],
                    [*batch.schema.names[:width], "ids", "n_tokens", "ids_sha256", "round_trip"],
                )

    schema = given.select(*carry).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    return per_batch(given, run, schema)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``text`` read back from ids; null ids give an empty text."""
    given = encoded.select(*carry, F.col(ids).alias("__ids"))
    width, shared = len(carry), encoded.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(shared.value)
        for batch in batches:
            texts = [machine.decode(np.array(k.as_py() or [], np.int32)) for k in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], [*batch.schema.names[:width], "text"])

    return per_batch(given, run, given.select(*carry).schema.add("text", "string"))
