"""Token counts of byte-level BPE with a whole-token shortcut.

Offline, ``prove`` runs the merges on every vocabulary string and keeps those that come out as one token. A
pre-token found in that set counts one without any merging; only the rest is merged, and a bounded memo keeps what
was merged before. Special strings inside a text split it and count one each, as the library does by default.

Files whose settings are not followed here (normalisers, other pre-tokenizers, added tokens that are not special) are refused.

Defined results: null is empty and has 0 tokens; equal texts have equal counts, repeated rows one each; an empty table stays empty; a pre-token of any length is merged
with a heap in n log n steps; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import pairwise, repeat

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import per_batch
from plumbline.session import file_bytes

#: The pre-token pattern of byte-level BPE, white space spelled out as Unicode defines it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
MEMO = 400_000
NEVER = 1 << 60


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


#: The settings of a vocabulary file that are followed here; any other is refused.
FOLLOWED = {
    "normalizer": [None], "truncation": [None], "padding": [None],
    "pre_tokenizer": [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": t, "use_regex": True} for t in (True, False)],
}
FOLLOWED_MODEL = {
    "type": ["BPE", None], "dropout": [None], "unk_token": [None], "continuing_subword_prefix": [None, ""], "end_of_word_suffix": [None, ""],
    "byte_fallback": [False, None], "ignore_merges": [False, None],
}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def refused(spec: dict) -> str | None:
    """What a vocabulary file asks for that is not followed here."""
    for part, known in ((spec, FOLLOWED), (spec["model"], FOLLOWED_MODEL)):
        for name, values in known.items():
            if part.get(name) not in values:
                return f"{name} {part.get(name)!r}"
    odd = [t["content"] for t in spec.get("added_tokens") or [] if any(t.get(k, v) != v for k, v in PLAIN_TOKEN.items())]
    return f"added token {odd[0]!r}" if odd else None


class Merger:
    """Ranked merges of one vocabulary file, given by its bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        if why := refused(spec):
            raise ValueError(f"a vocabulary with {why} is not supported")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.vocabulary = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.letters = byte_letters()

    def spell(self, pretoken: str) -> str:
        return "".join(map(self.letters.__getitem__, pretoken.encode()))

    def count(self, spelled: str) -> int:
        """Tokens left when no ranked pair is left: the lowest rank first, then the leftmost."""
        ranks, size = self.ranks, len(spelled)
        if size < 2:
            return size
        if size <= 64:
            parts = list(spelled)
            order = list(map(ranks.get, pairwise(parts), repeat(NEVER)))
            while order and (best := min(order)) < NEVER:
                k = order.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del order[k]
                if k < len(order):
                    order[k] = ranks.get((parts[k], parts[k + 1]), NEVER)
                if k:
                    order[k - 1] = ranks.get((parts[k - 1], parts[k]), NEVER)
            return len(parts)
        parts, before, after = list(spelled), list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(size - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        left = size
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if parts[k] != a or n >= size or parts[n] != b:
                continue
            parts[k], parts[n] = a + b, ""
            after[k] = after[n]
            if after[n] < size:
                before[after[n]] = k
            left -= 1
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < size and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that encode alone as one token, as pre-tokens."""
        byte = {c: b for b, c in enumerate(self.letters)}
        whole = (s for s in self.vocabulary if self.count(s) == 1)
        found = set()
        for s in whole:
            try:
                found.add(bytes(map(byte.__getitem__, s)).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        return frozenset(found)


class Counts(dict):
    """Pre-token to number of tokens: ones for the proven strings, merged counts for a bounded number of others."""

    def __init__(self, merger: Merger, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merger, self.whole = merger, whole

    def __missing__(self, pretoken: str) -> int:
        n = self.merger.count(self.merger.spell(pretoken))
        if len(pretoken) <= 64:
            if len(self) > len(self.whole) + MEMO:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pretoken] = n
        return n


@lru_cache(maxsize=1)
def merger_of(digest: str, data: bytes) -> Merger:
    """One merger a worker, of the file that it met last."""
    return Merger(data)


def counter(data: bytes, whole: frozenset[str] | None = None) -> Callable[[str], int]:
    """A function from text to its number of tokens; its memo goes with it."""
    merger = merger_of(hashlib.sha256(data).hexdigest(), data)
    counts = Counts(merger, merger.prove() if whole is None else whole)
    split = regex.compile(PRETOKEN).findall
    special = regex.compile("|".join(map(regex.escape, merger.specials))) if merger.specials else None

    def count(text: str) -> int:
        if special is not None and special.search(text):
            parts = special.split(text)
            return len(parts) - 1 + sum(sum(map(counts.__getitem__, split(p))) for p in parts)
        return sum(map(counts.__getitem__, split(text)))

    return count


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``n_bytes`` and ``n_tokens`` of every whole text."""
    spark = docs.sparkSession
    data = file_bytes(vocabulary)  # read where the driver runs; executors need not see the file
    shared = spark.sparkContext.broadcast((data, Merger(data).prove()))  # the file and at most its vocabulary
    given = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*shared.value)
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column(width)]
            sizes = pc.binary_length(batch.column(width)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], sizes, pa.array(found, pa.int64())], [*batch.schema.names[:width], "n_bytes", "n_tokens"])

    return per_batch(given, run, given.select(*carry).schema.add("n_bytes", "long").add("n_tokens", "long"))
