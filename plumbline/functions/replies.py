"""Judges' replies: tolerant JSON, normalised fields, and the bar of evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.schemas import VERDICT_VALUES
from plumbline.session import ship

FIELDS = (
    "rule_id string, verdict string, confidence string, violated_clause string, behaviour string, quote string, closest_rule string, "
    "evidence struct<file:string,start_line:string,end_line:string>, counterexample struct<input:string,expected:string,actual:string>"
)


def parsed_reply(reply: Column) -> Column:
    """The reply's JSON object as a variant: without code fences, or else the widest braces; null for anything else."""
    bare = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    direct = F.try_parse_json(bare)
    widest = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    found = F.coalesce(direct, widest)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def fields(variant: Column) -> Column:
    """The known fields of a parsed reply, all as strings."""
    return F.from_json(F.to_json(variant), FIELDS, {"mode": "PERMISSIVE"})


def verdict_of(raw: Column) -> Column:
    known = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(known.isin(*VERDICT_VALUES), known).otherwise("UNCERTAIN")


def clamped(raw: Column) -> Column:
    """A confidence within 0 and 1; anything that is no number is 0."""
    number = raw.try_cast("double")
    return F.when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def line_number(raw: Column) -> Column:
    """A number is cut to an integer of at least 0; a boolean is 0; of other text the first integer counts."""
    text = F.coalesce(raw, F.lit(""))
    number = text.try_cast("double")
    first = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(F.lower(text).isin("true", "false"), 0).when(number.isNotNull(), F.greatest(F.lit(0), number.cast("int"))).otherwise(F.coalesce(first, F.lit(0)))


def evidence_gate(reply: Column) -> Column:
    """(verdict, downgraded): a claim of drift needs a clause, and a counterexample with input and outcome."""
    said = verdict_of(reply["verdict"])
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    shown = full(reply["violated_clause"]) & full(reply["counterexample"]["input"]) & full(reply["counterexample"]["actual"])
    down = F.coalesce((said == "DRIFT") & ~F.coalesce(shown, F.lit(False)), F.lit(False))
    return F.struct(F.when(down, "UNCERTAIN").otherwise(said).alias("verdict"), down.alias("downgraded"))


def reverse_gate(reply: Column, located: Column) -> Column:
    """(verdict, downgraded, clause) of an audit in the other direction: a finding needs a behaviour and a located quote."""
    raw = F.upper(F.trim(F.coalesce(reply["verdict"], F.lit(""))))
    said = F.when(raw == "AUTHORISED", "COMPLIANT").when(raw == "UNAUTHORISED", "DRIFT").otherwise("UNCERTAIN")
    behaviour, closest = (F.trim(F.coalesce(reply[k], F.lit(""))) for k in ("behaviour", "closest_rule"))
    down = (said == "DRIFT") & ((behaviour == "") | located.isNull())
    final = F.when(down, "UNCERTAIN").otherwise(said)
    near = F.when((closest != "") & (F.lower(closest) != "none"), F.concat(F.lit(" (closest rule "), closest, F.lit(")"))).otherwise("")
    clause = F.when(final == "DRIFT", F.concat(F.lit("No rule authorises: "), behaviour, near)).otherwise("")
    return F.struct(final.alias("verdict"), down.alias("downgraded"), clause.alias("clause"))


#: What matters for nesting: strings, whole or cut off, and braces.
MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}]', re.DOTALL)


def complete_objects(text: str) -> Iterator[dict]:
    """Every whole outermost object of a text that may be cut off, in one pass over its strings and braces. What stands within
    an object that has no end is not told; a closing brace too many hides as many that open after it."""
    depth, start = 0, None
    for mark in MARKS.finditer(text):
        brace = mark.group()
        if brace == "{":
            start = mark.start() if depth == 0 else start
            depth += 1
        elif brace == "}":
            depth -= 1
            if depth == 0 and start is not None:
                with suppress(json.JSONDecodeError, RecursionError):
                    found = json.loads(text[start : mark.end()])
                    if isinstance(found, dict):
                        yield found
                start = None


class Salvaged:
    """Table function: a row for each whole object of a reply, its keys in order."""

    def eval(self, reply: str | None):
        for pos, found in enumerate(complete_objects(reply or "")):
            yield pos, json.dumps(found, sort_keys=True)


def salvage(replies: DataFrame, reply: str = "response") -> DataFrame:
    """``replies`` with ``pos`` and ``item``: a row for each whole object of a reply, by a lateral join."""
    ship(replies.sparkSession)
    return replies.lateralJoin(F.udtf(Salvaged, returnType="pos int, item string")(F.col(reply).outer()))


def indexed_replies(replies: DataFrame, key: str = "question_key", reply: str = "response") -> DataFrame:
    """(key, rule_id, item): a whole-project reply by rule, the last answer for a rule wins. Lists, lists under ``rules``
    or ``verdicts``, and single objects are read as they are; only what does not parse is searched for whole objects."""
    bare = F.regexp_replace(F.trim(F.coalesce(F.col(reply), F.lit(""))), r"^`+(?:json)?|`+$", "")
    inner = F.nullif(F.regexp_extract(F.col(reply), r"(?s)\[.*\]", 0), F.lit(""))
    value = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    shape = F.schema_of_variant(value)
    listed = F.when(shape.startswith("ARRAY"), value.cast("array<variant>"))
    for name in ("rules", "verdicts"):
        under = F.try_variant_get(value, f"$.{name}", "array<variant>")
        listed = F.coalesce(listed, F.when(shape.startswith("OBJECT") & (F.size(under) > 0), under))
    listed = F.coalesce(listed, F.when(shape.startswith("OBJECT"), F.array(value)))
    read = replies.withColumn("__items", listed)
    whole = read.where("size(__items) > 0").select(key, F.posexplode("__items").alias("pos", "item")).select(key, "pos", F.to_json("item").alias("item"))
    rest = salvage(read.where("coalesce(size(__items), 0) <= 0").select(key, reply), reply).select(key, "pos", "item")
    named = whole.unionByName(rest).withColumn("rule_id", F.get_json_object("item", "$.rule_id")).where("coalesce(rule_id, '') <> ''")
    return named.groupBy(key, "rule_id").agg(F.max_by("item", "pos").alias("item"))


