"""Detectors: from rules and sources to verdicts. Registered by name; each is a function of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import replies as R
from plumbline.functions import text as X
from plumbline.operators import retrieval
from plumbline.session import durable, ship
from plumbline.sources.stores import KeyedStore, looked_up

MATCH_THRESHOLD = 0.60
NUMBER = r"\b([0-9]+(?:\.[0-9]+)?)\b"


def keyword_verdicts(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """The keyword baseline: (project, rule_id, coverage, missing_numbers, verdict, confidence).

    ``rules`` has (project, rule_id, text), ``projects`` (project, text) with a row a file or document. A rule is met when
    at least 60 % of its words (a word counts as often as it stands there) and all its numbers, as written, occur. Only
    tokens of rules are kept of the sources, so what is grouped is bounded by the rules.
    """
    words = rules.select("project", "rule_id", F.explode(F.array_distinct(F.concat(X.key_words(F.col("text")), X.key_numbers(F.col("text"))))).alias("token"))
    asked = words.select("project", "token").distinct()
    held = X.token_rows(projects, ["project"]).join(asked, ["project", "token"], "left_semi").select("project", "token")
    found = words.join(held.withColumn("__has", F.lit(True)), ["project", "token"], "left").where("__has").groupBy("project", "rule_id").agg(F.collect_set("token").alias("__held"))
    joined = rules.join(found, ["project", "rule_id"], "left").withColumn("__held", F.coalesce("__held", F.array().cast("array<string>")))
    own, numbers = X.key_words(F.col("text")), X.key_numbers(F.col("text"))
    has = lambda t: F.array_contains(F.col("__held"), t)
    coverage = F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.filter(own, has)) / F.size(own))
    said = joined.withColumn("coverage", coverage).withColumn("missing_numbers", F.array_distinct(F.filter(numbers, lambda t: ~has(t))))
    met = (F.col("coverage") >= MATCH_THRESHOLD) & (F.size("missing_numbers") == 0)
    return said.select(
        "project", "rule_id", "coverage", "missing_numbers", F.when(met, "COMPLIANT").otherwise("DRIFT").alias("verdict"),
        F.bround(F.when(met, F.col("coverage")).otherwise(1 - F.col("coverage")), 3).alias("confidence"),
    )


def values(text: Column) -> Column:
    """The distinct numbers of a text, by value."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double")))


def behaviour(code: Column) -> Column:
    """Code without comments and docstrings; the line gutter goes where there is one."""
    lines = F.filter(F.split(code, "\n"), lambda x: F.contains(x, F.lit("|")))
    bare = F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[^|]*\|", "")), "\n")).otherwise(code)
    return F.regexp_replace(F.regexp_replace(bare, r"#[^\n]*", ""), r'(?s)""".*?"""', "")


def judged(rule: Column, code: Column) -> Column:
    """(verdict, confidence, reason): the stand-in judge. Numbers by value, without 0, 1 and 2; then exceptions that the
    rule names in backquotes; a rule with either that the code cannot settle is uncertain."""
    wanted = F.array_except(values(rule), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))
    named = F.regexp_extract_all(rule, F.lit("`([A-Z][A-Za-z]+)`"), F.lit(1))
    say = lambda verdict, confidence, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), reason.alias("reason"))

    def told(p: Column) -> Column:
        wanted, named, there, raises = p["wanted"], p["named"], p["there"], p["raises"]
        missing = F.when(F.size(there) > 0, F.array_except(wanted, there)).otherwise(F.array().cast("array<double>"))
        unraised = F.when(raises, F.filter(named, lambda n: ~F.contains(p["plain"], F.concat(F.lit("raise "), n)))).otherwise(F.array().cast("array<string>"))
        open_ = ((F.size(wanted) > 0) & (F.size(there) == 0)) | ((F.size(named) > 0) & ~raises)
        return (
            F.when(F.size(missing) > 0, say("DRIFT", 0.72, F.array_min(missing).cast("string")))
            .when(F.size(unraised) > 0, say("DRIFT", 0.68, F.try_element_at(unraised, F.lit(1))))
            .when(open_, say("UNCERTAIN", 0.3, F.lit("")))
            .otherwise(say("COMPLIANT", 0.6, F.lit("")))
        )

    facts = lambda plain: F.struct(plain.alias("plain"), wanted.alias("wanted"), named.alias("named"), values(plain).alias("there"), F.contains(plain, F.lit("raise ")).alias("raises"))
    return X.once(behaviour(code), lambda plain: X.once(facts(plain), told))


def reverse_judged(qualname: Column, rules_text: Column) -> Column:
    """UNAUTHORISED when no longer part of a function's name begins like anything in the rules."""
    name = F.regexp_replace(F.substring_index(qualname, ".", -1), "^_+", "")
    words = F.filter(F.split(F.lower(name), "_+"), lambda w: F.length(w) > 3)
    known = X.once(F.lower(rules_text), lambda text: (F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, F.left(w, F.lit(5)))))
    return F.when(known, "AUTHORISED").otherwise("UNAUTHORISED")


def reviewable(qualname: Column, kind: Column) -> Column:
    """Functions and methods, but no dunder methods."""
    return kind.isin("function", "method") & ~F.substring_index(qualname, ".", -1).startswith("__")


def accept_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose source digest was found in the pristine project as well become compliant. ``findings`` has (project,
    source, verdict), ``baseline`` (project, digest)."""
    known = baseline.select("project", "digest").distinct().withColumn("__known", F.lit(True))
    joined = findings.withColumn("digest", X.source_digest(F.col("source"))).join(known, ["project", "digest"], "left")
    accepted = F.coalesce(F.col("__known"), F.lit(False)) & (F.col("verdict") == "DRIFT")
    return joined.withColumn("accepted", accepted).withColumn("verdict", F.when(accepted, "COMPLIANT").otherwise(F.col("verdict"))).drop("__known")


class Completer(Protocol):
    """Anything that answers a prompt."""

    def complete(self, system: str, user: str) -> str: ...


def with_retries(ask: Callable[[], str], attempts: int = 3, pause: float = 1.5) -> str | None:
    for k in range(attempts):
        try:
            return ask()
        except Exception:  # noqa: BLE001  whatever a provider raises
            if k + 1 < attempts:
                time.sleep(pause * (k + 1))
    return None


def asked_once(missing: DataFrame, make: Callable[[], Completer]) -> DataFrame:
    """(key, response) of questions (key, system, user), by ``make()`` on the executors; null where all attempts failed."""
    ship(missing.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = None
        for frame in frames:
            if len(frame):
                judge = judge or make()
                said = [with_retries(lambda s=s, u=u: judge.complete(s, u)) for s, u in zip(frame["system"], frame["user"], strict=True)]
                yield pd.DataFrame({"key": frame["key"], "response": said})

    return missing.select("key", "system", "user").mapInPandas(run, "key string, response string")


def answered(questions: DataFrame, answers: DataFrame, make: Callable[[], Completer]) -> DataFrame:
    """(key, response, hit): stored answers for known keys; each other key is asked once. ``questions`` has (key, system,
    user), ``answers`` (key, response)."""
    asked = questions.dropDuplicates(["key"])
    missing = asked.join(answers.select("key"), "key", "left_anti")
    fresh = asked_once(missing, make).withColumn("hit", F.lit(False))
    stored = answers.select("key", "response").dropDuplicates(["key"]).join(asked.select("key"), "key", "left_semi").withColumn("hit", F.lit(True))
    return stored.unionByName(fresh)


@dataclass(frozen=True)
class Judge:
    """A model that detectors ask, behind a store of its answers. ``counts`` adds up what was stored and what was not."""

    make: Callable[[], Completer]
    store: KeyedStore
    counts: dict[str, int] = field(default_factory=dict)

    def replies(self, asked: DataFrame) -> DataFrame:
        """(key, response, hit) of questions (key, system, user)."""
        found = looked_up(self.store, asked.select("key", "system", "user"), lambda missing: asked_once(missing, self.make))
        self.counts.update(hits=self.counts.get("hits", 0) + found.hits, misses=self.counts.get("misses", 0) + found.misses)
        return found.rows


def rules_block(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules_text, rules_listed): the texts of a workspace's rules, and with their ids, in the order of the ids."""
    listed = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rule_id", "text"))).alias("r"))
    joined = lambda f: F.array_join(F.transform("r", f), "\n")
    return listed.select(*keys, joined(lambda r: r["text"]).alias("rules_text"), joined(lambda r: F.concat(r["rule_id"], F.lit(": "), r["text"])).alias("rules_listed"))


def rendered(chunk: Column) -> Column:
    """An excerpt as a prompt shows it: where it is from, and its lines with their numbers."""
    return F.concat(F.lit("["), chunk["file"], F.lit("] ("), chunk["qualname"], F.lit(")\n"), X.gutter(chunk["source"], chunk["start_line"]))


def questions(rules: DataFrame, chunks: DataFrame, k: int = 3, run: int = 1) -> DataFrame:
    """(workspace, rule_id, text, key, user, code, retrieved_chunks): one prompt a rule over its best chunks and the module
    constants that they name; ``key`` is the question's content, so equal questions are asked once."""
    documents = chunks.select("workspace", "chunk_id", X.chunk_document(F.col("file"), F.col("qualname"), F.col("source")).alias("text"))
    asked = rules.select("workspace", "rule_id", X.rule_document(F.col("section"), F.col("text")).alias("text"))
    hits = durable(retrieval.top_chunks(asked, documents, k, ["workspace"]).select("workspace", "rule_id", "rank", "chunk_id"))
    context = retrieval.constant_context(hits.withColumnRenamed("rule_id", "group_id"), chunks, within=["workspace"])
    added = context.select("workspace", F.col("group_id").alias("rule_id"), (F.col("rank") + k).alias("rank"), F.col("module_id").alias("chunk_id"))
    shown = hits.unionByName(added).join(chunks, ["workspace", "chunk_id"])
    excerpt = F.struct("rank", "chunk_id", "file", "qualname", "start_line", "source")
    listed = shown.groupBy("workspace", "rule_id").agg(F.array_sort(F.collect_list(excerpt)).alias("e"))
    every = rules.join(listed, ["workspace", "rule_id"], "left").withColumn("e", F.coalesce("e", F.array().cast(dict(listed.dtypes)["e"])))
    sources = F.transform("e", lambda x: x["source"])
    key = X.content_key(F.col("text"), F.array_join(sources, "\0"), F.lit(RULE_PROMPT), run=F.lit(run))
    user = F.concat(F.lit("Rule "), F.col("rule_id"), F.lit(": "), F.col("text"), F.lit("\n\nExcerpts:\n"), F.array_join(F.transform("e", rendered), "\n\n"))
    return every.select("workspace", "rule_id", "text", key.alias("key"), F.lit(RULE_SYSTEM).alias("system"), user.alias("user"), F.array_join(sources, "\n").alias("code"), F.transform("e", lambda x: x["chunk_id"]).alias("retrieved_chunks"))


#: What each kind of question asks for; the answers are read with tolerance all the same.
VERDICT_SHAPE = (
    '{"verdict": "COMPLIANT" | "DRIFT" | "UNCERTAIN", "confidence": 0 to 1, "violated_clause": words of the rule, '
    '"evidence": {"file", "start_line", "end_line"}, "counterexample": {"input", "expected", "actual"}}'
)
RULE_SYSTEM = (
    "You compare code with one numbered rule of its specification. Go by what the code does, not by its comments or names. Say DRIFT only "
    f"if you can name the clause and an input for which the outcome differs. Answer with one JSON object: {VERDICT_SHAPE}"
)
WHOLE_SYSTEM = (
    "You compare a project's code with all numbered rules of its specification. Answer with a JSON list that has one object a rule, each "
    f'with "rule_id" and, as for a single rule: {VERDICT_SHAPE}'
)
REVERSE_SYSTEM = (
    "You are shown one function and all rules of its specification. Say UNAUTHORISED if the function has an effect that callers can see and "
    "that no rule asks for or implies, else AUTHORISED. Answer with one JSON object: "
    '{"verdict", "confidence", "behaviour": what it does, "quote": a line of the code word for word, "closest_rule": an id or "none"}'
)

#: Versions of the prompts; part of a question's key, so that a new prompt asks anew.
RULE_PROMPT, WHOLE_PROMPT, REVERSE_PROMPT = "rule-1", "whole-1", "reverse-1"
NO_JSON, NO_ENTRY = "model did not return valid JSON", "model returned no entry for this rule"


def stand_in(rule: Column, code: Column) -> Column:
    """The stand-in judge's reply to one rule, as JSON."""

    def reply(j: Column) -> Column:
        told = lambda text: F.when(j["verdict"] == "DRIFT", text).otherwise("")
        shown = F.struct(told(F.concat(F.lit("a case with "), j["reason"])).alias("input"), F.lit("").alias("expected"), told(F.lit("not as stated")).alias("actual"))
        return F.to_json(F.struct(j["verdict"].alias("verdict"), j["confidence"].alias("confidence"), told(rule).alias("violated_clause"), shown.alias("counterexample")))

    return X.once(judged(rule, code), reply)


def settled(answered: DataFrame, missing: str = NO_JSON) -> DataFrame:
    """The columns of a verdict from ``reply`` (JSON): parsed with tolerance, held to the bar of evidence, uncertain with
    the reason where nothing can be read."""
    read = answered.withColumn("r", R.fields(R.parsed_reply(F.col("reply")))).withColumn("unread", R.parsed_reply(F.col("reply")).isNull())
    gate = read.withColumn("g", R.evidence_gate(F.col("r")))
    clause = F.when(F.col("unread"), missing).otherwise(F.trim(F.coalesce("r.violated_clause", F.lit(""))))
    return gate.select(
        *[c for c in answered.columns if c != "reply"], F.when(F.col("unread"), "UNCERTAIN").otherwise(F.col("g.verdict")).alias("verdict"), F.when(F.col("unread"), 0.0).otherwise(R.clamped(F.col("r.confidence"))).alias("confidence"),
        clause.alias("violated_clause"), (~F.col("unread") & F.col("g.downgraded")).alias("downgraded"), F.col("unread").alias("parse_error"),
    )


Replies = DataFrame | Judge | None


def with_replies(asked: DataFrame, replies: Replies, own: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``asked`` (key, system, user, ...) with ``reply`` and ``cache_hit``: what a ``Judge`` answers; or what a table (key,
    response) has for the key, else the stand-in's reply ``own``. Written, so that everything is judged once."""
    if isinstance(replies, Judge):
        asked = durable(asked)
        said = replies.replies(asked).withColumnRenamed("response", "reply").withColumnRenamed("hit", "cache_hit")
        return asked.join(said, "key", "left").select(*keep, "reply", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))
    if replies is None:
        return durable(asked.select(*keep, own.alias("reply"), F.lit(False).alias("cache_hit")))
    known = replies.select("key", F.col("response").alias("__stored")).dropDuplicates(["key"])
    joined = asked.join(known, "key", "left")
    return durable(joined.select(*keep, F.coalesce("__stored", own).alias("reply"), F.col("__stored").isNotNull().alias("cache_hit")))


VERDICT = ["workspace", "rule_id", "verdict", "confidence", "violated_clause", "downgraded", "parse_error", "cache_hit", "retrieved_chunks", "direction"]


def keyword(rules: DataFrame, chunks: DataFrame, replies: Replies = None) -> DataFrame:
    projects = chunks.select(F.col("workspace").alias("project"), F.col("source").alias("text"))
    said = keyword_verdicts(rules.select(F.col("workspace").alias("project"), "rule_id", "text"), projects)
    no = F.lit(False)
    return said.select(F.col("project").alias("workspace"), "rule_id", "verdict", "confidence", F.lit("").alias("violated_clause"), no.alias("downgraded"), no.alias("parse_error"), no.alias("cache_hit"), F.array().cast("array<string>").alias("retrieved_chunks"), F.lit("forward").alias("direction"))


def ranked(rules: DataFrame, chunks: DataFrame, replies: Replies = None, k: int = 3) -> DataFrame:
    """Retrieval with constant context, one question a rule, the reply parsed and held to the bar of evidence."""
    asked = with_replies(questions(rules, chunks, k), replies, stand_in(F.col("text"), F.col("code")), ["workspace", "rule_id", "retrieved_chunks"])
    return settled(asked).withColumn("direction", F.lit("forward")).select(*VERDICT)


def whole_project(rules: DataFrame, chunks: DataFrame, replies: Replies = None) -> DataFrame:
    """All rules of a workspace against all its sources, in path order, in one question, which by design holds the whole
    workspace. The reply is read by rule, the last entry of a rule wins; a rule without one is uncertain."""
    code = chunks.groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct("file", "start_line", "qualname", "source"))).alias("c"))
    code = code.select("workspace", F.transform("c", lambda x: x["source"]).alias("sources"), F.array_join(F.transform("c", rendered), "\n\n").alias("shown"))
    asked = rules_block(rules, ["workspace"]).join(code, "workspace", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    asked = asked.withColumn("key", X.content_key(F.col("rules_text"), F.array_join("sources", "\0"), F.lit(WHOLE_PROMPT))).withColumn("code", F.array_join("sources", "\n"))
    user = F.concat(F.lit("Rules:\n"), "rules_listed", F.lit("\n\nCode:\n"), F.coalesce("shown", F.lit("")))
    asked = asked.withColumn("system", F.lit(WHOLE_SYSTEM)).withColumn("user", user).drop("shown")
    own = rules.join(asked.select("workspace", "code"), "workspace").select("workspace", F.struct("rule_id", stand_in(F.col("text"), F.col("code")).alias("reply")).alias("one"))
    entry = F.transform(F.array_sort("all"), lambda x: F.concat(F.lit('{"rule_id": '), F.to_json(x["rule_id"].cast("variant")), F.lit(", "), F.substring(x["reply"], F.lit(2), F.length(x["reply"]))))
    listed = own.groupBy("workspace").agg(F.collect_list("one").alias("all")).select("workspace", F.concat(F.lit("["), F.array_join(entry, ", "), F.lit("]")).alias("own"))
    told = with_replies(asked.join(listed, "workspace"), replies, F.col("own"), ["workspace"])
    entries = R.indexed_replies(told, "workspace", "reply").withColumnRenamed("item", "reply")
    said = rules.select("workspace", "rule_id").join(entries, ["workspace", "rule_id"], "left").join(told.select("workspace", "cache_hit"), "workspace")
    return settled(said, NO_ENTRY).withColumn("retrieved_chunks", F.array().cast("array<string>")).withColumn("direction", F.lit("forward")).select(*VERDICT)


def reverse(rules: DataFrame, chunks: DataFrame, replies: Replies = None, pristine: DataFrame | None = None) -> DataFrame:
    """Every reviewable function against all rules of its workspace; a finding has to quote the code. ``pristine`` has the
    chunks (workspace, qualname, kind, source, ...) of the accepted state: what is found there as well is compliant."""

    def audited(chunks: DataFrame) -> DataFrame:
        asked = chunks.where(reviewable(F.col("qualname"), F.col("kind"))).join(rules_block(rules, ["workspace"]), "workspace")
        asked = asked.withColumn("key", X.content_key(F.col("rules_text"), F.col("source"), F.lit(REVERSE_PROMPT))).withColumn("system", F.lit(REVERSE_SYSTEM))
        excerpt = rendered(F.struct("file", "qualname", "start_line", "source"))
        asked = asked.withColumn("user", F.concat(F.lit("Rules:\n"), "rules_listed", F.lit("\n\nFunction:\n"), excerpt))
        head = F.coalesce(F.try_element_at(F.filter(F.split("source", "\n"), lambda x: x.rlike(r"^\s*(async )?def ")), F.lit(1)), F.try_element_at(F.split("source", "\n"), F.lit(1)))
        raw = reverse_judged(F.col("qualname"), F.col("rules_text"))
        found = raw == "UNAUTHORISED"
        own = F.to_json(F.struct(raw.alias("verdict"), F.lit(0.6).alias("confidence"), F.when(found, F.concat(F.lit("it has "), F.col("qualname"))).otherwise("").alias("behaviour"), F.when(found, head).otherwise("").alias("quote"), F.lit("none").alias("closest_rule")))
        read = with_replies(asked, replies, own, ["workspace", "chunk_id", "qualname", "source"]).withColumn("parsed", R.parsed_reply(F.col("reply"))).withColumn("r", F.from_json(F.to_json("parsed"), REVERSE_FIELDS))
        gate = read.withColumn("g", R.reverse_gate(F.col("r"), X.locate_quote(F.col("source"), F.coalesce("r.quote", F.lit("")))))
        unread = F.col("parsed").isNull()
        return gate.select(
            "workspace", F.concat(F.lit("CREEP:"), F.col("qualname")).alias("rule_id"), F.when(unread, "UNCERTAIN").otherwise(F.col("g.verdict")).alias("verdict"), F.when(unread, 0.0).otherwise(R.clamped(F.col("r.confidence"))).alias("confidence"),
            F.when(unread, NO_JSON).otherwise(F.col("g.clause")).alias("violated_clause"), (~unread & F.col("g.downgraded")).alias("downgraded"), unread.alias("parse_error"), "cache_hit", F.array("chunk_id").alias("retrieved_chunks"), F.lit("reverse").alias("direction"), "source",
        )

    said = audited(chunks)
    if pristine is None:
        return said.select(*VERDICT)
    known = audited(pristine).where("verdict = 'DRIFT'").select(F.col("workspace").alias("project"), X.source_digest(F.col("source")).alias("digest"))
    taken = accept_baseline(said.withColumnRenamed("workspace", "project"), known).withColumnRenamed("project", "workspace")
    return taken.withColumn("violated_clause", F.when(F.col("accepted"), "accepted: already reported on the pristine project").otherwise(F.col("violated_clause"))).select(*VERDICT)


REVERSE_FIELDS = "verdict string, confidence string, behaviour string, quote string, closest_rule string"


def both(rules: DataFrame, chunks: DataFrame, replies: Replies = None) -> DataFrame:
    return ranked(rules, chunks, replies).unionByName(reverse(rules, chunks, replies))


DETECTORS: dict[str, Callable[..., DataFrame]] = {"keyword": keyword, "ranked": ranked, "whole-project": whole_project, "reverse": reverse, "ranked-reverse": both}


def detect(name: str, rules: DataFrame, chunks: DataFrame, replies: Replies = None) -> DataFrame:
    """The verdicts of a registered detector. ``replies`` is a ``Judge`` to ask, or a table (key, response) of answers; what that does not
    have, and everything without one, the stand-in judge answers."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known are {', '.join(DETECTORS)}")
    return DETECTORS[name](rules, chunks, replies).withColumn("detector", F.lit(name))
