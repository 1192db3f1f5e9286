"""Chat formatting by schema fingerprints; DataFrame functions only.

A record's layout is recognised by the hash of its nested field paths. Each known fingerprint selects a declarative
mapping to canonical turns (role, text): rows by turn, prompt and completion, instruction with optional input, lists of
messages under several names. ``canonical_turns`` does this for a DataFrame's own schema, ``canonical_records`` for JSON
records of mixed layouts, row by row.

The template frames a turn as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts (its own and
those of common templates) get an escape character after their first character; one more is added where some are
there already, so taking one away gives every text back. The loss mask lists, for each assistant turn, the piece of the
output (``formatted`` split before each ``<|turn|>``), and start and length in code points within that piece.

Defined results: null roles and texts are empty; turns are ordered by turn, then role, then text, nulls first; repeated
rows are repeated turns; a null conversation id is a conversation of its own; an empty table stays empty; unknown
layouts give a null list of turns in ``canonical_records`` and an error naming the paths in ``canonical_turns``; extra
columns are ignored in row layouts. One conversation is one row of output, and so has to fit into one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARK = "␛"
#: Control strings of common chat templates, as (first character, rest) patterns.
CONTROLS = r"(<)({m}*)(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|user\|>|\|assistant\|>|\|system\|>|/?s>|<SYS>>|</SYS>>)"
BRACKETS = r"(\[)({m}*)(/?INST\])"
TURNS = "array<struct<role:string,text:string>>"
LEARNED = "assistant"


def escape(value: Column) -> Column:
    for pattern in (CONTROLS, BRACKETS):
        value = F.regexp_replace(value, pattern.format(m=MARK), f"$1{MARK}$2$3")
    return value


def unescape(value: Column) -> Column:
    for pattern in (CONTROLS, BRACKETS):
        value = F.regexp_replace(value, pattern.format(m=MARK).replace(f"({MARK}*)", f"{MARK}({MARK}*)"), "$1$2$3")
    return value


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a type; list elements are written ``[]``."""
    if isinstance(kind, T.StructType):
        mark = lambda name: re.sub(r"([\\.\[\]\n])", r"\\\1", name)
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{mark(f.name)}" if prefix else mark(f.name))]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


#: Declarative mappings: the paths of a layout, and where its turns are. ``list`` names a list and its role and text
#: fields; ``fields`` gives (role, path) in the order of the turns; ``rows`` means one row a turn.
LAYOUTS: list[dict] = [
    {"name": "rows", "paths": ["conv_id", "turn", "role", "text"], "rows": ("role", "text")},
    {"name": "rows of content", "paths": ["conv_id", "turn", "role", "content"], "rows": ("role", "content")},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "turns", "paths": ["turns[].role", "turns[].text"], "list": ("turns", "role", "text")},
    {"name": "prompt", "paths": ["prompt", "completion"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "prompt and response", "paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    {"name": "system prompt", "paths": ["system", "prompt", "response"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "question", "paths": ["question", "answer"], "fields": [("user", "question"), ("assistant", "answer")]},
    {"name": "instruction", "paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    {"name": "instruction and input", "paths": ["instruction", "input", "output"], "fields": [("user", "instruction\ninput"), ("assistant", "output")]},
]
BY_FINGERPRINT: Mapping[str, dict] = {fingerprint(x["paths"]): x for x in LAYOUTS}
#: Names of the same role in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, role), role, F.lit(""))


def layout_of(schema: T.StructType, ignore: tuple[str, ...] = ()) -> dict:
    """The mapping for a DataFrame's schema: its own fingerprint, or the one row layout whose columns it contains."""
    own = [p for p in paths(schema) if p.split(".")[0].removesuffix("[]") not in ignore]
    if (found := BY_FINGERPRINT.get(fingerprint(own))) is not None:
        return found
    held = [x for x in LAYOUTS if "rows" in x and set(x["paths"]) <= set(own)]
    if len(held) != 1:
        raise ValueError(f"no mapping for the fields {sorted(own)}")
    return held[0]


def turns_from(layout: dict, at) -> Column:
    """A list or field layout's turns; ``at(path)`` gives a field as a string, or a list of structs of strings."""
    if "list" in layout:
        name, role, text = layout["list"]
        named = canonical_role if role == "from" else lambda r: F.coalesce(r, F.lit(""))
        return F.transform(at(name), lambda m: F.struct(named(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    turns = []
    for role, path in layout["fields"]:
        first, *more = path.split("\n")
        text = F.coalesce(at(first), F.lit(""))
        for other in more:  # an empty input adds nothing
            text = F.concat(text, F.when(F.coalesce(at(other), F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), at(other))))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical_turns(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, turns): canonical turns of a DataFrame of one layout, chosen by its fingerprint."""
    layout = layout_of(df.schema, (conversation,) if conversation not in ("conv_id",) or "turn" not in df.columns else ())
    if "rows" not in layout:
        return df.select(conversation, turns_from(layout, F.col).alias("turns"))
    role, text = layout["rows"]
    row = F.struct("turn", F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return df.groupBy(conversation).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(conversation, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def escaped(name: Column) -> Column:
    """A field's name as part of a path: what would read as structure is marked."""
    return F.regexp_replace(name, r"([\\.\[\]\n])", r"\\$1")


def kind_mark(variant: Column) -> Column:
    """Nothing for a plain value, ``[]`` for a list, ``{}`` for an object."""
    kind = F.schema_of_variant(variant)
    return F.when(kind.startswith("ARRAY"), "[]").when(kind.startswith("OBJECT"), "{}").otherwise("")


def fields_of(variant: Column) -> Column:
    """(key, value) of an object's fields; null for anything else."""
    return F.map_entries(F.try_variant_get(variant, "$", "map<string,variant>"))


def record_paths(variant: Column) -> Column:
    """The distinct nested field paths of a JSON record: fields, fields of objects and of objects in lists. What is nested
    deeper ends in a mark of its kind, so that it equals no path of a plain value."""

    def below(head: Column, inner: Column) -> Column:
        return F.transform(fields_of(inner), lambda f: F.concat(head, F.lit("."), escaped(f["key"]), kind_mark(f["value"])))

    def one(field: Column) -> Column:
        name, value = escaped(field["key"]), field["value"]
        items = F.try_variant_get(value, "$", "array<variant>")
        listed = F.concat(name, F.lit("[]"))
        in_list = F.flatten(F.transform(items, lambda x: F.coalesce(below(listed, x), F.array(F.concat(listed, kind_mark(x))))))
        return F.when(kind_mark(value) == "", F.array(name)).when(kind_mark(value) == "{}", below(name, value)).when(F.size(items) == 0, F.array(listed)).otherwise(in_list)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields_of(variant), one))))


def canonical_records(records: DataFrame, json: str = "record") -> DataFrame:
    """``records`` with ``layout`` (a mapping's name) and ``turns``; each JSON record by its own fingerprint. Numbers and
    booleans in the place of a text are its JSON; a record beyond Spark's limit of a variant (16 MB) has no layout."""
    mark = F.sha2(F.array_join(record_paths(F.try_parse_json(json)), "\n").cast("binary"), 256)
    given = records.withColumn("__mark", mark)
    known = [(m, x) for m, x in BY_FINGERPRINT.items() if "rows" not in x]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m, layout in known:
        if "list" in layout:
            field, role, text = layout["list"]
            kind = f"struct<`{field}`:array<struct<`{role}`:string,`{text}`:string>>>"
        else:
            kind = "struct<" + ",".join(f"`{p}`:string" for p in layout["paths"]) + ">"
        parsed = F.from_json(json, kind)
        turns = F.when(F.col("__mark") == m, turns_from(layout, lambda p, parsed=parsed: parsed[p])).otherwise(turns)
        name = F.when(F.col("__mark") == m, F.lit(layout["name"])).otherwise(name)
    return given.select(*records.columns, name.alias("layout"), turns.alias("turns"))


def format_turns(canonical: DataFrame, learned: str = LEARNED) -> DataFrame:
    """``canonical`` with ``formatted`` and ``loss_mask`` in the place of ``turns``."""
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    framed = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    placed = canonical.withColumn("__framed", framed)
    spans = F.transform("__framed", lambda t, k: F.struct((t["role"] == learned).alias("on"), k.alias("piece"), F.char_length(t["head"]).alias("start"), F.char_length(t["body"]).alias("length")))
    mask = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["piece"].alias("piece"), s["start"].alias("start"), s["length"].alias("length")))
    whole = F.array_join(F.transform("__framed", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return placed.select(*[c for c in canonical.columns if c != "turns"], whole.alias("formatted"), mask.alias("loss_mask"))


def pieces() -> Column:
    """``formatted``, cut before each turn."""
    return F.filter(F.split("formatted", r"(?=<\|turn\|>)"), lambda p: p != "")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` parsed from the output and ``learned``, the unescaped text under the loss mask."""
    body = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.char_length(p) - len(TURN) - len(END))
    parted = formatted.withColumn("__pieces", pieces())
    turns = F.transform("__pieces", lambda p: F.struct(unescape(F.substring_index(body(p), TEXT, 1)).alias("role"), unescape(F.substring(body(p), F.char_length(F.substring_index(body(p), TEXT, 1)) + len(TEXT) + 1, F.char_length(p))).alias("text")))
    learned = F.transform("loss_mask", lambda m: unescape(F.substring(F.element_at(F.col("__pieces"), m["piece"] + 1), m["start"] + 1, m["length"])))
    return parted.select(*formatted.columns, turns.alias("turns"), F.array_join(learned, "").alias("learned"))


def digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The contract's columns, read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        conversation, F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
