"""The registered queries: every operator on the driver's tables. Names of columns equal those of ``plans.oracles``.

The tables hold no specifications, so each operator works on a likeness: a rule is a benchmark item, a project a source,
a case a labelled document, a verdict a rule over its id, a client a user.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import replies as R
from plumbline.functions import text as X
from plumbline.operators import chunking, detectors, embedding, merge, progress, reports, retrieval, scoring, stability
from plumbline.schemas import CASES
from plumbline.session import durable, durable_folder, spread, table
from plumbline.sources import intake, specs
from plumbline.streaming import checks, limiter, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Judge replies in every shape: (key, rule_id, reply).
REPLIES = [
    (1, "R01", '{"verdict": "drift ", "confidence": "0.9", "violated_clause": "c", "evidence": {"file": "a.py", "start_line": "41-44", "end_line": 44}, "counterexample": {"input": "i", "expected": "e", "actual": "a"}}'),
    (2, "R02", '```json\n{"verdict": "COMPLIANT", "confidence": 1.7}\n```'),
    (3, "R03", 'I think so: {"verdict": "DRIFT", "confidence": -3, "violated_clause": "c"} done'),
    (4, "R04", "no json at all"), (5, "R05", ""), (6, "R06", '[{"verdict": "DRIFT"}]'), (7, "R07", '{"verdict": "MAYBE", "confidence": "high", "evidence": {"start_line": -4}}'),
    (8, "R08", '{"verdict": "DRIFT", "violated_clause": " ", "counterexample": {"input": "i", "actual": "a"}}'), (9, "R09", None),
]
#: Whole-project replies: (key, reply).
LISTED = [
    ("a", '[{"rule_id": "R1", "verdict": "DRIFT"}, {"rule_id": "R2", "verdict": "COMPLIANT"}, {"rule_id": "R1", "verdict": "UNCERTAIN"}]'),
    ("b", '{"rules": [{"rule_id": "R3", "verdict": "DRIFT"}]}'), ("c", '{"rule_id": "R4", "verdict": "DRIFT"}'), ("d", '{"verdicts": [{"rule_id": "R5", "verdict": "x"}, {"verdict": "none"}]}'),
]
SOURCE = '"""A module."""\nLIMIT = 3\n\n@wrap\ndef first(a):\n    return a\n\nclass Box:\n    """Holds."""\n    size: int = 0\n\n    @property\n    def inner(self):\n        return 1\n\n    def __len__(self):\n        return 2\n\nasync def last():\n    pass\n'
SPEC_FILES = [
    ("u1", "proj/spec.md", "- **R01** a"), ("u1", "proj/src/a.py", "x = 1"), ("u2", "docs/SPEC.md", "- **R1** x"), ("u2", "notes.md", "- **R1** x\n- **R2** y"), ("u2", "deep/er/specification.md", "z"),
    ("u3", "a.md", "- **R1** x\n* **R2** y"), ("u3", "b/c.md", "- **R1** x\n- **R2** y"), ("u3", "d.md", "none"), ("u4", "p/spec.md", "a"), ("u4", "q/spec.md", "b"), ("u5", "x.py", "y"),
]
IDS = [
    (1, "X = 3   # R06\ny = 2"), (2, '"""Enforces R04 to R12 on loans. Keeps it."""'), (3, "R04/R05 - add the fee from R13"), (4, "a\n# R01, R02 and R03\n\n\n\nb R99x R7"), (5, "no ids"),
]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, for a stream's input, state and output."""
    return f"{durable_folder(spark)}/{uuid.uuid4().hex}"


def rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("rule_id"), "text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def text_id(name: str, value: Column) -> Column:
    return F.concat(F.lit(name), value.cast("string"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """A case a labelled document; toxic ones are drift."""
    joined = documents(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    i, drift = F.col("doc_id"), F.col("toxic") == 1
    none = F.lit(None).cast("string")
    targets = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(text_id("R", i % 5), text_id("R", i % 7)))
    made = joined.select(
        text_id("c", i).alias("case_id"), F.col("source").alias("project"), F.when(drift, text_id("D", 1 + i % 9)).otherwise(text_id("N", 1 + i % 3)).alias("category"),
        F.when(drift, "drift").otherwise("no_drift").alias("label"), targets.alias("target_rules"), F.when(i % 3 == 0, "").otherwise(text_id("f", i % 6)).alias("gold_symbol"),
        F.concat(text_id("src/m", i % 4), F.lit(".py")).alias("file"), text_id("note ", i % 10).alias("note"), F.when(i % 11 == 0, "invalid").otherwise("valid").alias("status"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.col("quality") == 1).cast("boolean").alias("escapes_tests"), none.alias("oracle"), none.alias("error"), none.alias("workspace"),
    )
    assert made.columns == [c.split()[0] for c in CASES.split(", ")]
    return made


def verdicts(spark: SparkSession, d: str, run: int = 1, detector: str = "base") -> DataFrame:
    """Four verdicts a labelled document, by a rule over its id; ``run`` shifts the rule."""
    i, k = F.col("doc_id"), F.col("k")
    said = (i * 7 + k * 5 + (run - 1) * (i % 3)) % 6
    rows = table(spark, d, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where(i % 13 != 0)
    file = F.when((i + k) % 5 == 0, "").otherwise(F.concat(text_id("lib/m", (i + k) % 4), F.lit(".py")))
    shown = F.when(k % 2 == 0, F.array(F.concat(F.lit("a.py::"), text_id("f", (i + k) % 6)), F.lit("b.py::g"))).otherwise(F.array().cast("array<string>"))
    word = F.lit("").alias("x")
    return rows.select(
        text_id("c", i).alias("case_id"), text_id("R", (i * 3 + k) % 7).alias("rule_id"), F.lit(detector).alias("detector"), F.when(k == 3, "reverse").otherwise("forward").alias("direction"),
        F.when(said <= 1, "DRIFT").when(said == 2, "UNCERTAIN").otherwise("COMPLIANT").alias("verdict"), (((i + k) % 10) / 10).alias("confidence"), word.alias("violated_clause"),
        F.struct(file.alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line")).alias("evidence"), F.struct(word.alias("input"), word.alias("expected"), word.alias("actual")).alias("counterexample"),
        shown.alias("retrieved_chunks"), F.lit(run).alias("run"), F.lit(0).alias("latency_ms"), F.lit(False).alias("cache_hit"), F.lit(False).alias("parse_error"), F.lit(False).alias("downgraded"), k.cast("int").alias("verdict_pos"),
    )


def scored(spark: SparkSession, d: str, run: int = 1) -> DataFrame:
    return scoring.outcomes(cases(spark, d), verdicts(spark, d, run))


def runs(spark: SparkSession, d: str) -> DataFrame:
    parts = [scored(spark, d, r).withColumn("run", F.lit(r)) for r in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def event_verdicts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("verdict_pos"), "ts", F.when(kind == "error", "DRIFT").when(kind == "click", "UNCERTAIN").otherwise("COMPLIANT").alias("verdict"))


@query
def q01_tokens(spark, d):
    return retrieval.term_counts(documents(spark, d), []).select("token", "n")


@query
def q02_doc_frequency(spark, d):
    both = documents(spark, d).select(text_id("d", F.col("doc_id")).alias("doc"), "text").unionByName(rules(spark, d).select(text_id("r", F.col("rule_id")).alias("doc"), "text"))
    frequency = retrieval.document_frequency(retrieval.term_counts(both, ["doc"]), [])
    totals = both.agg(F.count("*").alias("total"))
    return frequency.crossJoin(F.broadcast(totals)).select("token", "df", F.bround(retrieval.idf(F.col("total"), F.col("df")), 4).alias("idf"))  # one row on the other side


@query
def q03_keyword_verdicts(spark, d):
    docs = documents(spark, d)
    named = docs.select(F.col("source").alias("project")).distinct()
    asked = rules(spark, d).crossJoin(F.broadcast(named))  # every project has the same rules; the rules are a stated set
    said = detectors.keyword_verdicts(asked, docs.select(F.col("source").alias("project"), "text"))
    return said.select("project", "rule_id", F.bround("coverage", 4).alias("coverage"), F.size("missing_numbers").cast("long").alias("n_missing"), "verdict", "confidence")


@query
def q04_tfidf_topk(spark, d):
    chunks = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    hits = retrieval.top_chunks(rules(spark, d), chunks, 3)
    return hits.select("rule_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.bround("score", 4).alias("score"))


def gold_chunks(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(rule_id, chunk_id): the first document that holds an item's text."""
    # A text with the passage has each of its inner words; the longest of them is sought by an equality, and the rest looked up.
    words = lambda text: F.split(text, " ")
    inner = lambda text: F.slice(words(text), 2, F.greatest(F.size(words(text)) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner(F.col("text")), lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    passages = asked.select("rule_id", F.col("text").alias("passage"), longest.alias("word"))
    held = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    maybe = held.join(passages.where("word is not null").select("rule_id", "word"), "word").select("doc_id", "rule_id")
    maybe = maybe.unionByName(docs.select("doc_id").crossJoin(passages.where("word is null").select("rule_id")))  # passages of one or two words
    gold = docs.join(maybe, "doc_id").join(passages, "rule_id").where(F.contains("text", "passage")).groupBy("rule_id").agg(F.min("doc_id").alias("chunk_id"))
    return gold


@query
def q05_recall_at_k(spark, d):
    docs, asked = documents(spark, d).select("doc_id", "text"), rules(spark, d)
    gold = gold_chunks(docs, asked)
    return retrieval.recall_at(retrieval.top_chunks(asked, docs.withColumnRenamed("doc_id", "chunk_id"), 5), gold)


@query
def q06_hash_bucket_norm(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = retrieval.dealt(docs, ["doc_id"], docs.count())  # texts move once, their tokens stay
    terms = retrieval.term_counts(docs, ["doc_id"]).withColumn("w", 1 + F.log("n"))
    vectors = retrieval.bucketed(terms, ["doc_id"], retrieval.md5_bucket(F.col("token")))
    return vectors.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.bround(F.sum(F.col("w") * F.col("w")), 4).alias("norm"), F.bround(F.max("w"), 4).alias("w_max"), F.bround(F.sum("w"), 3).alias("w_sum"))


@query
def q07_outcomes(spark, d):
    return scored(spark, d)


@query
def q08_overall_metrics(spark, d):
    return scoring.overall(scored(spark, d), verdicts(spark, d))


@query
def q09_per_category(spark, d):
    return scoring.per_category(scored(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query
def q10_attribution(spark, d):
    return scoring.attribution(scored(spark, d))


@query
def q11_strict_precision(spark, d):
    said = verdicts(spark, d).join(cases(spark, d).select("case_id", "project"), "case_id")
    return scoring.overall(scored(spark, d), said, ["project"]).select("project", "precision", "strict_precision", "spurious_rule_flags")


@query
def q12_summary_groupings(spark, d):
    return reports.dataset_summary(cases(spark, d))


@query
def q13_comparison_pivot(spark, d):
    parts = [scoring.per_category(scored(spark, d, r)).withColumn("detector", F.lit(f"run{r}")) for r in (1, 2, 3)]
    return reports.comparison(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["run1", "run2", "run3"])


@query
def q14_collapsed_verdict(spark, d):
    return scoring.collapsed(event_verdicts(spark, d), ["user_id"])


@query
def q15_live_status(spark, d):
    return scoring.live_status(event_verdicts(spark, d), ["user_id"])


@query
def q16_run_rates_std(spark, d):
    return stability.spread(stability.run_rates(runs(spark, d)))


@query
def q17_flip_rate(spark, d):
    return stability.flip_rate(runs(spark, d))


@query
def q18_nearest_rank_ci(spark, d):
    return stability.interval(documents(spark, d), ["lang"], "n_chars")


@query
def q19_bootstrap_hash(spark, d):
    pooled = scored(spark, d).select("case_id", *(F.when(F.col("outcome") == k, 1).otherwise(0).alias(k.lower()) for k in ("TP", "FN", "FP", "TN")))
    draws = stability.hashed_bootstrap(pooled, 200)
    return draws.select("draw", *(F.bround(m, 6).alias(m) for m in stability.METRICS))


@query
def q20_bootstrap_exact(spark, d):
    placed = runs(spark, d).withColumn("case_pos", F.substring("case_id", 2, 20).cast("long"))
    return stability.exact_intervals(spark, placed, draws=200)


@query
def q21_merge_anti_union(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fresh = orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    order = orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderkey") * 3).alias("ord"))
    return merge.merged(orders.where("o_orderkey % 3 <> 0"), fresh, ["o_orderkey"], order)


@query
def q22_cache_dedupe(spark, d):
    docs = documents(spark, d)
    asked = docs.select(X.content_key(F.lit("v1"), F.col("text"), run=(F.col("doc_id") % 2 + 1)).alias("key"))
    stored = docs.where("doc_id % 3 = 0").select(X.content_key(F.lit("v1"), F.col("text"), run=(F.col("doc_id") % 2 + 1)).alias("key")).distinct()
    marked = asked.distinct().join(stored.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return reports.cache_statistics(marked)


@query
def q23_accept_baseline(spark, d):
    docs = documents(spark, d)
    findings = docs.select("doc_id", F.col("lang").alias("project"), F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, "DRIFT").otherwise("UNCERTAIN").alias("verdict"))
    baseline = docs.where("doc_id % 4 = 1").select(F.col("lang").alias("project"), X.source_digest(F.col("text")).alias("digest"))
    return detectors.accept_baseline(findings, baseline).select("doc_id", "digest", "accepted", "verdict")


@query
def q24_target_join(spark, d):
    known = rules(spark, d).select(text_id("R", F.col("rule_id")).alias("rule_id"), F.col("text").alias("rule_text"))
    return cases(spark, d).select("case_id", F.explode(F.array_distinct("target_rules")).alias("rule_id")).join(known, "rule_id").select("case_id", "rule_id", F.length("rule_text").cast("long").alias("rule_chars"))


@query
def q25_flips_self_join(spark, d):
    return merge.flips(verdicts(spark, d, 1), verdicts(spark, d, 2), ["case_id", "rule_id", "verdict_pos"]).select("case_id", "rule_id", "was", "now")


@query
def q26_explorer_filter_page(spark, d):
    found = merge.explored(cases(spark, d), escapes=True, label="no_drift", q="R3")
    return merge.page(found, ["case_id"], 2, 5).select("case_id", "project", "category", "note")


@query
def q27_fuzzy_match(spark, d):
    part = table(spark, d, "part")
    return part.where(X.fuzzy(F.col("p_name"), "aen")).select("p_partkey", "p_name")


@query
def q28_representative_case(spark, d):
    return reports.representatives(cases(spark, d))


@query
def q29_example_picker(spark, d):
    held = scored(spark, d).join(cases(spark, d).select("case_id", "target_rules"), "case_id")
    return reports.examples(held, verdicts(spark, d).select("case_id", "rule_id", "verdict", "verdict_pos"))


@query
def q30_heading_carry(spark, d):
    """Lines of documents as a specification: every fourth line is a heading, every second other line a rule."""
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.lpad((F.col("pos") % 100).cast("string"), 2, "0")
    marked = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("## "), F.col("line"))).when(F.col("pos") % 2 == 1, F.concat(F.lit("- **R"), number, F.lit("** x"), F.col("line"))).otherwise(F.col("line"))
    joined = lines.select("doc_id", "pos", marked.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found = specs.rule_rows(joined, "doc_id")
    return found.select("doc_id", F.col("rule_pos").cast("long").alias("rule_pos"), "rule_id", F.md5(F.concat_ws("|", "text", "section")).alias("digest"))


def by_pattern(docs: DataFrame, patterns: DataFrame, size: int) -> DataFrame:
    """Each document with the pattern of its number; ``patterns`` are a stated few and have ``n``."""
    return docs.withColumn("n", F.col("doc_id") % size).join(F.broadcast(patterns), "n").drop("n")


def numbered(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n long, {schema}")


def replies_frame(spark: SparkSession, d: str) -> DataFrame:
    """A reply for each document, of one of the shapes of ``REPLIES``, whose clause is a digest of the document."""
    patterns = numbered(spark, [r[1:] for r in REPLIES], "rule_id string, pattern string")
    clause = F.concat(F.lit('"'), F.md5("text"), F.lit('"'))
    made = by_pattern(documents(spark, d), patterns, len(REPLIES)).withColumn("reply", F.replace("pattern", F.lit('"c"'), clause))
    return durable(made.select((F.col("doc_id") + 1).cast("int").alias("k"), "reply")).withColumn("r", R.fields(R.parsed_reply(F.col("reply"))))


@query
def q31_reply_parse(spark, d):
    said = replies_frame(spark, d).select("k", R.verdict_of(F.col("r.verdict")).alias("verdict"), R.clamped(F.col("r.confidence")).alias("confidence"), R.line_number(F.col("r.evidence.start_line")).cast("long").alias("start_line"))
    props = table(spark, d, "events").select(F.col("event_id").cast("int").alias("k"), F.lit("UNCERTAIN").alias("verdict"), R.clamped(F.get_json_object("props", "$.k")).alias("confidence"), R.line_number(F.get_json_object("props", "$.k")).cast("long").alias("start_line"))
    return said.withColumn("k", -F.col("k")).unionByName(props)


@query
def q32_evidence_gate(spark, d):
    return replies_frame(spark, d).select("k", R.evidence_gate(F.col("r")).alias("g")).select("k", "g.verdict", "g.downgraded")


def cut_replies(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, response): a list with an object for each line of a document, cut off after three quarters."""
    lines = F.split("text", "\n")
    entry = lambda line, k: F.concat(F.lit('{"n": {"k": '), k.cast("string"), F.lit('}, "rule_id": "R'), k.cast("string"), F.lit('", "t": "} '), F.md5(line), F.lit(' \\"{"}'))
    whole = F.concat(F.lit("["), F.array_join(F.transform(lines, entry), ", "), F.lit("]"))
    return documents(spark, d).select("doc_id", whole.alias("w")).select("doc_id", F.expr("left(w, cast(length(w) * 3 div 4 as int))").alias("response"))


@query
def q33_salvage_objects(spark, d):
    return R.salvage(cut_replies(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "item")


@query
def q34_reply_index_last_wins(spark, d):
    """A whole-project reply for each document, of one of four shapes, whose rule ids tell of the document."""
    patterns = numbered(spark, [r[1:] for r in LISTED], "pattern string")
    named = F.concat(F.lit('"rule_id": "'), (F.col("doc_id") % 10).cast("string"))
    given = by_pattern(documents(spark, d), patterns, len(LISTED)).select(F.col("doc_id").alias("question_key"), F.replace("pattern", F.lit('"rule_id": "'), named).alias("response"))
    return R.indexed_replies(given).select("question_key", "rule_id", F.get_json_object("item", "$.verdict").alias("verdict"))


@query
def q35_exact_once_patch(spark, d):
    docs, find = documents(spark, d), F.lit("the")
    return docs.select("doc_id", X.occurrences(F.col("text"), find).cast("long").alias("n"), F.md5(F.coalesce(X.patched(F.col("text"), find, F.lit("<the>")), F.lit("-"))).alias("digest"), X.patch_error(F.col("text"), find).alias("error"))


@query
def q36_strip_ids(spark, d):
    """Documents as sources with rule ids in comments, docstrings and prose."""
    patterns = numbered(spark, [r[1:] for r in IDS], "pattern string")
    source = by_pattern(documents(spark, d), patterns, len(IDS)).select("doc_id", F.concat("pattern", F.lit("\n"), "text").alias("source"))
    return source.select("doc_id", X.strip_rule_ids(F.col("source")).alias("s")).select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("n_chars"), X.has_rule_id(F.col("s")).alias("left_over"))


@query
def q37_gutter_render(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.gutter(F.col("text"), (F.col("doc_id") * 10).cast("int"))).alias("digest"))


def constant_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of a file a source: those of ids divisible by 7 are modules that define a constant."""
    i = F.col("doc_id")
    line = F.concat(F.lit("\nLIMIT_"), (i % 5).cast("string"), F.when(i % 7 == 0, " = 1\n").otherwise(" used\n"))
    return documents(spark, d).select(i.alias("chunk_id"), F.col("source").alias("file"), F.when(i % 7 == 0, "<module>").otherwise("f").alias("qualname"), F.concat("text", line).alias("source"))


@query
def q38_constant_context(spark, d):
    chunks = constant_chunks(spark, d)
    hits = chunks.where("qualname = 'f'").select((F.col("chunk_id") % 40).alias("group_id"), "chunk_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("chunk_id"))).where("rank <= 3")
    return retrieval.constant_context(hits, chunks).select("group_id", "module_id", F.col("rank").cast("long").alias("rank"))


@query
def q39_number_gap_judge(spark, d):
    """Each document against a rule that states two numbers and an exception."""
    i = F.col("doc_id")
    rule = F.concat(F.lit("At least "), (i % 9).cast("string"), F.lit(" and "), (i % 4 + 0.5).cast("string"), F.when(i % 3 == 0, " or raise `LimitError`").otherwise(""))
    code = F.concat(F.col("text"), F.lit("\nlimit = "), (i % 8).cast("string"), F.lit(".0 # 99\nstep = "), (i % 5 + 0.5).cast("string"), F.when(i % 2 == 0, "\nraise LimitError\n").when(i % 5 == 0, "\nraise Other\n").otherwise("\n"))
    return documents(spark, d).select("doc_id", detectors.judged(rule, code).alias("j")).select("doc_id", "j.verdict", "j.confidence", "j.reason")


@query
def q40_reverse_judge(spark, d):
    """A function named after a document's first line, against the texts of a slot's benchmark items; with its quote located."""
    i, lines = F.col("doc_id"), F.split("text", "\n")
    items = rules(spark, d).select((F.col("rule_id") % 40).alias("slot"), "text")
    asked = items.groupBy("slot").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("rules_text"))
    name = F.concat(F.lit("Box._"), F.regexp_replace(F.lower(F.element_at(lines, 1)), "[^a-z]+", "_"))
    quote = F.when(i % 3 == 0, F.element_at(lines, 1)).when(i % 3 == 1, F.lit("not there at all")).otherwise(F.concat(F.lit("  "), F.element_at(lines, -1)))
    docs = documents(spark, d).select("doc_id", (i % 40).alias("slot"), name.alias("name"), quote.alias("quote"), "text")
    said = docs.join(asked, "slot").withColumn("raw", detectors.reverse_judged(F.col("name"), F.col("rules_text")))
    said = said.withColumn("at", X.locate_quote(F.col("text"), F.col("quote")))
    reply = F.struct(F.col("raw").alias("verdict"), F.lit("b").alias("behaviour"), F.col("quote"), F.lit("none").alias("closest_rule"))
    gate = said.select("doc_id", "raw", R.reverse_gate(reply, F.col("at")).alias("g"), "at")
    place = [F.col("at.first").cast("long").alias("first_line"), F.col("at.last").cast("long").alias("last_line")]
    return gate.select("doc_id", "raw", "g.verdict", "g.downgraded", "g.clause", *place)


@query
def q41_gold_match(spark, d):
    chunk = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("::g::"), (F.col("page_id") % 3).cast("string")))
    gold = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("g::1"))
    return table(spark, d, "pages").select("page_id", X.gold_match(chunk, gold).alias("matches"))


@query
def q42_union_directions(spark, d):
    said = verdicts(spark, d)
    both = said.where("direction = 'forward'").unionByName(said.where("direction = 'reverse'")).withColumn("detector", F.lit("both"))
    return both.groupBy("detector", "direction", "verdict").agg(F.count("*").alias("n"))


@query
def q43_spec_pick(spark, d):
    """Runs of eleven documents as the files of five uploads."""
    patterns = numbered(spark, SPEC_FILES, "name string, path string, head string")
    given = by_pattern(documents(spark, d), patterns, len(SPEC_FILES))
    upload = F.concat("name", F.lit("-"), F.floor(F.col("doc_id") / len(SPEC_FILES)).cast("string"))
    files = given.select(upload.alias("upload"), "path", F.concat("head", F.lit("\n"), "text").alias("text"))
    return intake.picked_spec(durable(intake.without_common_root(files, "upload")), "upload")


@query
def q44_changed_lines(spark, d):
    pairs = documents(spark, d).select("doc_id", F.col("text").alias("before"), F.concat(F.lit("first\n"), F.regexp_replace("text", r"\n", "\n+\n")).alias("after"))
    return chunking.changed_lines(pairs, ["doc_id"])


def python_files(spark: SparkSession, d: str) -> DataFrame:
    """(workspace, path, source): a module for each document, with as many methods as its number says; every eleventh does not
    parse."""
    i, text = F.col("doc_id"), F.md5("text")
    method = lambda k: F.concat(F.lit("\n\n    def m"), k.cast("string"), F.lit("(self):\n        return "), k.cast("string"))
    methods = F.array_join(F.transform(F.sequence(F.lit(0), i % 5), method), "")
    body = F.concat(F.lit('"""Module '), text, F.lit('."""\nLIMIT = '), i.cast("string"), F.lit("\n\n\n@wrap\ndef first(a):\n    return a\n\n\nclass Box:\n    size = 0"), methods, F.lit("\n"))
    return documents(spark, d).select(text_id("w", i % 3).alias("workspace"), F.concat(F.lit("src/m"), i.cast("string"), F.lit(".py")).alias("path"), F.when(i % 11 == 0, "def (").otherwise(body).alias("source"))


@query
def q45_chunker(spark, d):
    return chunking.chunked(python_files(spark, d)).withColumn("source", F.md5("source"))


@query
def q46_retention(spark, d):
    return specs.retained(table(spark, d, "events"), "ts", "2024-01-20 00:00:00", 7 * 86_400).select("event_id", "user_id")


def slices(column: Column, low: int, high: int, n: int) -> list[Column]:
    """Conditions that part a column's range into ``n`` runs, in order."""
    edges = [low + (high + 1 - low) * k // n for k in range(n + 1)]
    return [(column >= a) & (column < b) for a, b in zip(edges, edges[1:], strict=False)]


def event_range(events: DataFrame) -> tuple[int, int]:
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    return (0, 0) if low is None else (low, high)


@query
def q47_rate_limit_stateful(spark, d):
    """Events as requests, fed to the stream in three runs; each goes on from the state that the one before has left."""
    events = table(spark, d, "events")
    hits = events.select(F.col("user_id").cast("string").alias("client"), (F.col("event_id") + 1).cast("double").alias("at"))
    folder = scratch(spark)
    out = "client string, at double, admitted boolean"

    def step(stream: DataFrame) -> None:
        writer = limiter.limited(stream, 2).writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
        writer.format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    checks.fed(hits, slices(F.col("at") - 1, *event_range(events), 3), f"{folder}/in", step, limiter.state_session(spark))
    return spark.read.schema(out).parquet(f"{folder}/rows")


@query
def q48_stream_verdict_counts(spark, d):
    given = table(spark, d, "events")
    root, _, name = given.inputFiles()[0].rpartition("/")  # a file, or one of a folder
    stream = spark.readStream.schema(given.schema).option("pathGlobFilter", name if name == "events.parquet" else "*.parquet").parquet(root)
    kind = F.col("event_type")
    events = stream.select((F.col("user_id") % 20).alias("check_id"), F.when(kind == "error", "DRIFT").when(kind == "click", "UNCERTAIN").otherwise("COMPLIANT").alias("verdict"))
    return checks.replayed(checks.verdict_counts(events), f"verdicts_{uuid.uuid4().hex}", "complete")


@query
def q49_confidence_clamp(spark, d):
    lines = table(spark, d, "lineitem")
    raw = F.when(F.col("l_linenumber") == 3, "about half").otherwise(F.bround(F.col("l_discount") * 10, 3).cast("string"))
    return lines.groupBy(F.bround(R.clamped(raw), 4).alias("confidence")).agg(F.count("*").alias("n"))


@query
def q50_oracle_status(spark, d):
    held = cases(spark, d)
    i = F.substring("case_id", 2, 20).cast("long")
    waived = held.where(i % 7 == 0).select("case_id", F.lit("unobservable").alias("reason"))
    ran = held.where(i % 3 != 0).select("case_id", (i % 10 != 1).alias("pristine_ok"), (i % 4 == 2).alias("drifted_ok"))
    return merge.oracle_status(held, waived, ran)


def detector_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Workspaces of twenty documents: one of seven is a module that defines a constant, the others are methods named after
    their first lines, whose code uses a constant and states a limit."""
    i = F.col("doc_id")
    module = i % 7 == 0
    name = F.concat(F.lit("Box._"), F.regexp_replace(F.lower(F.element_at(F.split("text", "\n"), 1)), "[^a-z]+", "_"))
    line = F.concat(F.lit("\nLIMIT_"), (i % 5).cast("string"), F.when(module, " = 1\n").otherwise(" used\n"), F.lit("limit = "), (i % 13).cast("string"), F.when(i % 2 == 0, "\nraise LimitError\n").otherwise("\n"))
    return documents(spark, d).select(
        F.floor(i / 20).alias("n"), text_id("w", F.floor(i / 20)).alias("workspace"), text_id("d", i).alias("chunk_id"), F.concat("source", F.lit(".py")).alias("file"), F.when(module, "<module>").otherwise(name).alias("qualname"),
        F.when(module, "module").otherwise("method").alias("kind"), F.lit(1).alias("start_line"), F.concat("text", line).alias("source"),
    )


def detector_rules(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Every workspace has the items of its slot as rules, each with a limit and every third with an exception."""
    i = F.col("rule_id")
    text = F.concat("text", F.lit(" at least "), (i % 9 + 3).cast("string"), F.when(i % 3 == 0, " or raise `LimitError`").otherwise(""))
    items = rules(spark, d).select(text_id("R", i).alias("rule_id"), text.alias("text"), F.lit("").alias("section"), (i % 40).alias("slot"))
    return chunks.select("workspace", (F.col("n") % 40).alias("slot")).distinct().join(items, "slot").drop("slot")


def detected(spark: SparkSession, d: str, name: str) -> DataFrame:
    chunks = detector_chunks(spark, d)
    said = detectors.detect(name, detector_rules(spark, d, chunks), chunks.drop("n"))
    return said.withColumn("chunks", F.array_join("retrieved_chunks", ","))


@query
def q51_ranked_detector(spark, d):
    return detected(spark, d, "ranked").select("workspace", "rule_id", "verdict", "confidence", "violated_clause", "downgraded", "chunks")


@query
def q52_whole_project_detector(spark, d):
    return detected(spark, d, "whole-project").select("workspace", "rule_id", "verdict", "confidence", "violated_clause", "parse_error")


@query
def q53_reverse_detector(spark, d):
    return detected(spark, d, "reverse").select("workspace", "rule_id", "verdict", "confidence", "violated_clause", "downgraded", "chunks")


@query
def q54_both_directions(spark, d):
    return detected(spark, d, "ranked-reverse").groupBy("detector", "direction", "verdict").agg(F.count("*").alias("n"))


def ranked_gold(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, category, rule_id, rank): the items of the documents that hold them, a category by id."""
    docs, asked = documents(spark, d).select("doc_id", "text"), rules(spark, d)
    gold = gold_chunks(docs, asked).withColumn("case_id", text_id("c", F.col("rule_id"))).withColumn("category", text_id("D", 1 + F.col("rule_id") % 9))
    hits = retrieval.top_chunks(asked, docs.withColumnRenamed("doc_id", "chunk_id"), 5)
    return retrieval.gold_ranks(hits, gold, ["case_id", "category", "rule_id"])


@query
def q55_recall_by_category(spark, d):
    return retrieval.recall_by_category(ranked_gold(spark, d))


@query
def q57_check_events(spark, d):
    chunks = detector_chunks(spark, d).drop("n")
    asked = detector_rules(spark, d, detector_chunks(spark, d))
    said = durable(detectors.ranked(asked, chunks))
    events = progress.check_events(asked, chunks, said)
    return events.groupBy("workspace", "event").agg(F.count("*").alias("n"), F.max(F.get_json_object("payload", "$.status")).alias("status"))


@query
def q58_sweep_events(spark, d):
    events = progress.sweep_events(cases(spark, d), verdicts(spark, d))
    return events.groupBy("event", F.get_json_object("payload", "$.caught").alias("caught")).agg(F.count("*").alias("n"))


@query
def q59_case_rows(spark, d):
    said = verdicts(spark, d, 1, "one").unionByName(verdicts(spark, d, 2, "two"))
    rows = merge.case_rows(cases(spark, d), said)
    shown = rows.select("case_id", F.col("verdicts")["one"].alias("one"), F.col("verdicts")["two"].alias("two"))
    return merge.counted_page(shown, ["case_id"], 2, 50)


@query
def q60_live_check(spark, d):
    """Events as verdicts of twenty checks, fed to a stream in three runs of which the second comes twice: where each check
    stands, how many events were told, and each rule's last verdict and detail."""
    events = table(spark, d, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    said = F.when(kind == "error", "DRIFT").when(kind == "click", "UNCERTAIN").otherwise("COMPLIANT")
    verdicts = events.select(
        (F.col("user_id") % 20).cast("string").alias("check_id"), i.alias("pos"), text_id("R", i % 7).alias("rule_id"), text_id("rule ", i % 7).alias("text"),
        said.alias("verdict"), ((i % 10) / 10).alias("confidence"), (i % 4).alias("retrieved"), (i % 3).alias("constant_context"), F.col("ts").cast("timestamp").alias("at"),
    )
    folder = scratch(spark)

    def step(stream: DataFrame) -> None:
        told = live.told_once(live.rule_events(stream))
        live.stored(told, f"{folder}/events", f"{folder}/state").awaitTermination()

    first, second, third = slices(F.col("pos"), *event_range(events), 3)
    n = events.count() * len(live.RULE_EVENTS)
    checks.fed(verdicts, [first, second, second, third], f"{folder}/in", step, live.keyed_session(spark, n // 3))
    told = live.upserted(spark, f"{folder}/events", live.EVENTS, ["check_id", "place"], live.parts_of(spark, n))
    last = durable(live.last_of_batch(told).drop("place"))
    field = lambda event, name: F.max(F.when(F.col("event") == event, F.get_json_object("payload", f"$.{name}"))).alias(name)
    rules = last.groupBy("check_id", F.col("key").alias("rule_id")).agg(field("verdict", "verdict"), field("verdict", "confidence"), field("rule_detail", "retrieved"))
    n = told.groupBy("check_id").agg(F.count("*").alias("n_events"))
    return rules.join(live.statuses(last).select("check_id", "status"), "check_id").join(n, "check_id")


@query
def q61_live_sweep(spark, d):
    """A sweep over cases that arrive in three runs, of which the second comes twice."""
    given, said = cases(spark, d), durable(verdicts(spark, d))
    given = given.withColumn("n", F.substring("case_id", 2, 20).cast("long"))
    low, high = given.agg(F.min("n"), F.max("n")).first()
    folder = scratch(spark)

    def step(stream: DataFrame) -> None:
        live.stored(stream.drop("n"), f"{folder}/events", f"{folder}/state", live.swept(said)).awaitTermination()

    first, second, third = slices(F.col("n"), low or 0, high or 0, 3)
    checks.fed(given, [first, second, second, third], f"{folder}/in", step)
    return live.sweep_summary(live.upserted(spark, f"{folder}/events", live.SWEEP, ["place"]))


@query
def q62_dense_topk(spark, d):
    """The best documents of each item by dense vectors; buckets by MD5, as SQL has no BLAKE2b."""
    embedder = embedding.HashingEmbedder(dimensions=256, bucket=retrieval.md5_bucket)
    chunks = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    hits = embedding.embedded_top(embedder, rules(spark, d), chunks, 3)
    return hits.select("rule_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.bround("score", 4).alias("score"))


@query
def q63_case_detail(spark, d):
    """Each case's page: its target rules and their texts, and its verdicts by detector."""
    held = cases(spark, d)
    known = rules(spark, d).select(text_id("R", F.col("rule_id")).alias("rule_id"), "text")
    projects = held.select("project").distinct()
    said = verdicts(spark, d, 1, "one").unionByName(verdicts(spark, d, 2, "two"))
    pages = merge.case_detail(held, projects.crossJoin(F.broadcast(known.where("rule_id in ('R0','R1','R2','R3','R4','R5','R6')"))), said)
    told = lambda b: F.concat(b["detector"], F.lit(":"), F.array_join(F.transform(b["v"], lambda v: F.concat(v["rule_id"], F.lit("="), v["verdict"])), ","))
    targets = lambda part: F.coalesce(F.array_join(F.transform(F.array_distinct("targets"), lambda t: t[part]), "|"), F.lit(""))
    return pages.select("case_id", targets("rule_id").alias("targets"), F.md5(targets("text")).alias("digest"), F.coalesce(F.array_join(F.transform("by_detector", told), ";"), F.lit("")).alias("said"))


@query
def q64_retrieval_misses(spark, d):
    """The first items whose document is not the best; a report of fifteen rows."""
    return retrieval.misses(ranked_gold(spark, d), ["case_id"], k=1)


@query
def q65_source_counts(spark, d):
    return progress.source_counts(python_files(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Keyword verdicts of all projects, counted beside the overall score."""
    said = q03_keyword_verdicts(spark, d).groupBy("project").agg(F.count_if(F.col("verdict") == "DRIFT").alias("drift"), F.count_if(F.col("verdict") == "COMPLIANT").alias("compliant"))
    total = q08_overall_metrics(spark, d).select("precision", "recall", "f1", "strict_precision", "false_alarm_rate")
    return said.crossJoin(F.broadcast(total))  # one row
