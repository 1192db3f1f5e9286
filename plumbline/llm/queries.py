"""One query per operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    centroids, chat, decontaminate, filteraudit, fingerprint, langid, linededup, ngramjoin, pieces, quality, rulesforest, tokencount, urllists,
)
from plumbline.llm.oracles import ORACLES
from plumbline.session import durable, spread, table

#: Where the public vocabulary files lie; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, folder, "benchmark"), carry=["doc_id"]), "doc_id")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.near_duplicates(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def dated_lists(pages: DataFrame) -> DataFrame:
    """The query's lists. The tables carry none, so a rule over the hosts dates them: a third of the hosts and a fifth of
    the domains are blocked, the ``/en`` part of half of the hosts allowed, each from its own day on, most of them
    removed again and some added once more."""
    number = lambda text: F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    hosts = pages.select(urllists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domain = F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1)
    row = lambda chosen, name, kind, value: hosts.where(chosen).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value")).distinct()
    named = row(number(F.concat(F.lit("h"), "host")) % 3 == 0, "block", "host", F.col("host"))
    named = named.unionByName(row(F.col("host").contains(".") & (number(F.concat(F.lit("d"), domain)) % 5 == 0), "block", "domain", domain))
    named = named.unionByName(row(number(F.concat(F.lit("p"), "host")) % 2 == 0, "allow", "prefix", F.concat("host", F.lit("/en"))))
    k = number(F.concat("list", "kind", "value"))
    event = lambda chosen, action, day: F.when(chosen, F.struct(F.lit(action).alias("action"), F.dateadd(F.lit("2023-12-01").cast("date"), day.cast("int")).cast("timestamp").alias("at")))
    events = F.array(event(F.lit(True), "add", k % 300), event(k % 4 != 0, "remove", k % 300 + 20 + k % 97), event(k % 8 == 1, "add", k % 300 + 150))
    return named.select("list", "kind", "value", F.explode(F.array_compact(events)).alias("e")).select("list", "kind", "value", "e.action", "e.at")


def op3_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a capture; its fetch time, which the table lacks, follows from page_id."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 8760 * 3600)
    said = urllists.filter_captures(pages.withColumn("fetched_at", at), dated_lists(pages))
    return said.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_pairs(documents(spark, folder))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: toxic 0, poor 1, good 2; selected are documents that are good with an even chance or better."""
    docs = documents(spark, folder).select("doc_id", "text")
    model = quality.fit(docs, quality.graded(table(spark, folder, "labels")))
    return quality.grade(docs, model, tail=2)


#: Conversations of more characters keep their row layout in op7: as records they could pass the limit of a JSON value.
LONG_RECORD = 2_000_000


def chat_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): the query's conversations in the layouts of four sources. A question with its answer is a prompt
    and a completion for every second conv_id; the others are lists of messages, turns or from and value."""
    named = lambda role, text: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    is_role = lambda k, role: F.coalesce(F.try_element_at(F.col("turns"), F.lit(k))["role"] == role, F.lit(False))
    pair = (F.size("turns") == 2) & is_role(1, "user") & is_role(2, "assistant") & (F.col("conv_id") % 2 == 0)
    plain = ~F.exists("turns", lambda t: t["role"].isin(list(chat.ROLES)))
    text = lambda k: F.try_element_at(F.col("turns"), F.lit(k))["text"]
    record = (
        F.when(pair, F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("completion"))))
        .when((F.col("conv_id") % 3 == 0) & plain, F.to_json(F.struct(named("from", "value").alias("conversations"))))
        .when(F.col("conv_id") % 3 == 1, F.to_json(F.struct(named("role", "text").alias("turns"))))
        .otherwise(F.to_json(F.struct(named("role", "content").alias("messages"))))
    )
    return turns.select("conv_id", record.alias("record"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by turn are gathered by their fingerprint, written as records of four layouts, and read by theirs."""
    rows = table(spark, folder, "conversations")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(own))
    long = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["role"]) + F.length(t["text"])) > LONG_RECORD
    read = chat.canonical_records(chat_records(turns.where(~long))).drop("record", "layout")
    return chat.digest(chat.format_turns(read.unionByName(turns.where(long))))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencount.token_counts(documents(spark, folder), vocabulary(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, folder), vocabulary(PIECES))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    said = langid.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.removals(documents(spark, folder))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(documents(spark, folder), table(spark, folder, "labels"))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counted = durable(rulesforest.statistics(documents(spark, folder).select("doc_id", "text")))
    forest = rulesforest.fit_counted(counted, table(spark, folder, "labels"))
    return rulesforest.judge_counted(counted, forest).select("doc_id", *rulesforest.BASE, "base_failed", "kept", "anomaly")


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(spread(table(spark, folder, "embeddings").select("vec_id", "embedding")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_jaccard_join, op3_url_lists, op4_fingerprints, op5_quality, op6_token_counts, op7_chat, op8_sentencepiece,
        op9_language_id, op10_line_dedup, op11_filter_audit, op12_quality_rules, op13_centroids,
    )
}
__all__ = ["ORACLES", "QUERIES"]
