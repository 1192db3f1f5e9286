"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of identifiers and numbers, words that carry no signal, and words of obligation.
TOKEN = r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+(?:\.[0-9]+)?"
STOPWORDS = (
    "a an the and or of to in on at by for from with without is are be been being must shall should may can will would not no nor its it "
    "this that these those as if then than when while each every any all only also more most other another such same return returns "
    "returned when-ever per into out up down over under again"
).split()
MODALS = ["must", "shall", "should", "may", "mustnot", "required"]
#: Rule lines and headings of a specification, constants of a module, rule ids and how prose joins them.
RULE_LINE = r"^\s*[-*]\s+\*\*(R\d+)\*\*\s+(.+?)\s*$"
HEADING = r"^\s*#{2,}\s+(.+?)\s*$"
CONSTANT = r"\b[A-Z][A-Z0-9_]{2,}\b"
ID = r"R\d{2}"
IDS = rf"{ID}(?:\s*(?:/|,\s*and|,|and|to)\s*{ID})*"
#: Where rule ids stand in sources, and what their removal leaves, each with what takes its place.
STRIPPED = [
    (rf"(?m)[ \t]+#\s*{IDS}[ \t]*$", ""),
    (rf"(?m)\s*Enforces\s+{IDS}(?:\s+on\s+[^.\n]*)?\.", ""),
    (rf"{IDS}\s+[-–—]\s+", ""),
    (rf"\s+from\s+{IDS}", ""),
    (rf"\b{IDS}\b", ""),
    ('""" +', '"""'),
    (r"(?m)^[ \t]*#[ \t]*$", ""),
    (r"\n{3,}", "\n\n"),
]


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Lower-case identifier parts without one-letter words and stopwords; numbers whole."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    number = lambda t: F.substring(t, 1, 1).between("0", "9")
    return F.filter(parts, lambda t: number(t) | ((F.length(t) > 1) & ~F.array_contains(strings(STOPWORDS), t)))


def token_rows(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, n): the tokens of texts and how often each occurs, counted as they stand, in generated code."""
    parts = rows.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("part"))
    token = F.lower("part")
    kept = parts.where(is_number(F.col("part")) | ((F.length("part") > 1) & ~token.isin(STOPWORDS))).select(*keys, token.alias("token"))
    return kept.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def distinct_tokens(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token): the distinct tokens of each text, told apart where the text stands."""
    parts = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), F.lower))
    found = rows.select(*keys, F.explode(parts).alias("token"))
    return found.where(is_number(F.col("token")) | ((F.length("token") > 1) & ~F.col("token").isin(STOPWORDS)))


def is_number(token: Column) -> Column:
    return F.substring(token, 1, 1).between("0", "9")


def key_words(rule: Column) -> Column:
    return F.filter(tokens(rule), lambda t: ~is_number(t) & ~F.array_contains(strings(MODALS), t))


def key_numbers(rule: Column) -> Column:
    return F.filter(tokens(rule), is_number)


def constants(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(CONSTANT), F.lit(0)))


def defined_constants(source: Column) -> Column:
    """Constants that stand at the start of a line before a colon or an equals sign."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?m)^([A-Z][A-Z0-9_]{2,})\s*[:=]"), F.lit(1)))


def chunk_document(file: Column, qualname: Column, source: Column) -> Column:
    return F.concat_ws(" ", F.regexp_replace(file, "[/.]", " "), qualname, source)


def rule_document(section: Column, text: Column) -> Column:
    return F.concat_ws(" ", section, text)


def content_key(*parts: Column, run: Column | None = None) -> Column:
    """sha256 of the parts joined by NUL; only runs other than the first are salted with their number."""
    body = F.concat_ws("\0", *parts)
    if run is not None:
        body = F.when(run == 1, body).otherwise(F.concat(body, F.lit("\0run="), run.cast("string")))
    return F.sha2(body.cast("binary"), 256)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a lambda would work out what stands around it for each element anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def source_digest(source: Column) -> Column:
    return F.sha2(squeeze(source).cast("binary"), 256)


def occurrences(text: Column, find: Column) -> Column:
    """How often ``find`` occurs without overlap; null for an empty one."""
    return ((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.nullif(F.length(find), F.lit(0))).cast("int")


def patched(text: Column, find: Column, new: Column) -> Column:
    """The text with its one occurrence replaced; an empty ``find`` changes nothing; otherwise null unless there is exactly one."""
    return F.when(find == "", text).when(occurrences(text, find) == 1, F.replace(text, find, new))


def patch_error(text: Column, find: Column) -> Column:
    n = occurrences(text, find)
    return F.when((find == "") | (n == 1), F.lit(None).cast("string")).otherwise(F.concat(F.lit("pattern found "), n.cast("string"), F.lit(" times, expected 1")))


def strip_rule_ids(text: Column) -> Column:
    """Rule ids out of source text: id comments, then statements naming them, prefixes, provenance and whatever is left;
    then the empty comments and blank runs that this leaves."""
    return reduce(lambda x, step: F.regexp_replace(x, *step), STRIPPED, text)


def has_rule_id(text: Column) -> Column:
    return text.rlike(rf"\b{ID}\b")


def gutter(source: Column, first: Column) -> Column:
    """Lines with their numbers, right-aligned to four places."""
    number = lambda k: (first + k).cast("string")
    line = lambda x, k: F.concat(F.lpad(number(k), F.greatest(F.length(number(k)), F.lit(4)), " "), F.lit(" | "), x)
    return F.array_join(F.transform(F.split(source, "\n"), line), "\n")


def slug(name: Column, default: str = "project") -> Column:
    dashed = F.trim(F.left(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(40)), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(default))


def gold_match(chunk_id: Column, gold: Column) -> Column:
    """Is what follows the first ``::`` (or the whole id) the gold symbol?"""
    at = F.locate("::", chunk_id) if isinstance(chunk_id, str) else F.instr(chunk_id, "::")
    name = F.when(at > 0, F.substring(chunk_id, at + 2, F.length(chunk_id))).otherwise(chunk_id)
    return F.coalesce((F.coalesce(gold, F.lit("")) != "") & (name == gold), F.lit(False))


def fuzzy(text: Column, letters: str) -> Column:
    """Do the letters occur in this order?"""
    import re

    return F.lower(text).rlike("(?s)" + ".*".join(re.escape(c) for c in letters.lower()))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.format_string("%.1f", F.bround(value * 100, 1)), F.lit("%")))


def tone(value: Column, higher_is_better: bool = True) -> Column:
    good = value if higher_is_better else 1 - value
    return F.when(value.isNull(), "none").when(good >= 0.75, "good").when(good >= 0.4, "mid").otherwise("bad")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def locate_quote(source: Column, quote: Column) -> Column:
    """(first, last) line offsets of a quote: the first place where each of its squeezed lines is within the line of the
    source; else the whole source if the squeezed quote is within it; else null."""
    wanted = F.transform(F.filter(F.split(F.trim(quote), r"\r?\n"), lambda x: F.trim(x) != ""), squeeze)
    lines = F.transform(F.split(source, r"\r?\n"), squeeze)
    span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))

    def place(p: Column) -> Column:
        lines, wanted, last = p["lines"], p["wanted"], F.size(p["lines"]) - F.size(p["wanted"])
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(starts, lambda s: F.forall(F.sequence(F.lit(1), F.size(wanted)), lambda k: F.contains(F.element_at(lines, s + k), F.element_at(wanted, k))))
        # Of one line, which most quotes are, the places need no look-up by number.
        one = F.array_position(F.transform(lines, lambda x: F.contains(x, F.element_at(wanted, 1))), True) - 1
        first = F.when(F.size(wanted) == 1, F.nullif(one, F.lit(-1)).cast("int")).otherwise(F.try_element_at(fits, F.lit(1)))
        return once(first, lambda f: F.when(f.isNotNull(), span(f, f + F.size(wanted) - 1)).when(F.contains(squeeze(source), squeeze(quote)), span(F.lit(0), F.size(lines) - 1)))

    return F.when(F.size(wanted) > 0, once(F.struct(lines.alias("lines"), wanted.alias("wanted")), place))
