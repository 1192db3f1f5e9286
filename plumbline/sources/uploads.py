"""Uploads as stored projects: pasted files and archives checked, written as one folder each, read back by id, and let go
after their time.

``root/files/id=<id>`` holds an upload's rows (path, source, lines), ``root/manifests/id=<id>`` its one row of facts. The
manifest comes last and goes first, so an upload is whole for readers or not there, whatever crashes between.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.session import durable, ship
from plumbline.sources import intake

FILES = "id string, path string, source string, lines int"
MANIFEST = "id string, name string, spec_path string, spec string, rules int, files int, warnings array<string>"
ID_DIGITS = 16
NOTHING_PARSES = "none of the Python files parse"
UNSAFE = "unsafe path"


class ParseErrors:
    """Table function: why a Python file does not parse; no message if it does."""

    def eval(self, source: str | None):
        try:
            ast.parse(source or "")
        except SyntaxError as error:
            yield (f"{error.msg}, line {error.lineno}",)
        except (ValueError, RecursionError, MemoryError) as error:
            yield (str(error) or "too deeply nested",)
        else:
            yield (None,)


def rule_count(spec: Column) -> Column:
    return F.size(F.regexp_extract_all(spec, F.lit("(?m)" + X.RULE_LINE), F.lit(1)))


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def pasted(uploads: DataFrame) -> DataFrame:
    """(upload, name, spec_path, spec, files, warnings, refused) of pasted uploads (upload, name, spec, files), ``files`` being
    a list of (path, source)."""
    safe = F.transform("files", lambda f: F.struct(intake.safe_path(f["path"]).alias("path"), f["source"].alias("source"), f["path"].alias("given")))
    made = uploads.select("upload", "name", "spec", F.coalesce(safe, F.array().cast("array<struct<path:string,source:string,given:string>>")).alias("f"))
    bad = F.try_element_at(F.filter("f", lambda f: f["path"].isNull()), F.lit(1))["given"]
    files = F.transform("f", lambda f: F.struct(f["path"].alias("path"), f["source"].alias("source")))
    refused = F.when(F.exists("f", lambda f: f["path"].isNull()), F.concat(F.lit(UNSAFE + " "), F.coalesce(bad, F.lit(""))))
    return made.select("upload", "name", F.lit("spec.md").alias("spec_path"), "spec", files.alias("files"), F.array().cast("array<string>").alias("warnings"), refused.alias("refused"))


def zipped(archives: DataFrame) -> DataFrame:
    """The same of archives (upload, name, content): unpacked, without the folder that wraps them, specification picked."""
    rows = durable(intake.unpacked(archives))
    whole = durable(intake.without_common_root(rows.where("path is not null").select("upload", "path", "text"), "upload"))
    spec = intake.picked_spec(whole, "upload").withColumnRenamed("path", "spec_path").withColumnRenamed("error", "twins")
    texts = spec.join(whole.select("upload", F.col("path").alias("spec_path"), F.col("text").alias("spec")), ["upload", "spec_path"])
    python = intake.preferred_sources(whole, "upload").groupBy("upload").agg(F.array_sort(F.collect_list(F.struct("path", F.col("text").alias("source")))).alias("files"))
    told = rows.groupBy("upload").agg(F.min("error").alias("error"), F.array_sort(F.collect_set("warning")).alias("warnings"))
    joined = archives.select("upload", "name").join(told, "upload", "left").join(texts, "upload", "left").join(python, "upload", "left")
    files = F.coalesce("files", F.array().cast("array<struct<path:string,source:string>>"))
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    return joined.select("upload", "name", "spec_path", "spec", files.alias("files"), warnings.alias("warnings"), F.coalesce("error", "twins").alias("refused"))


def checked(uploads: DataFrame) -> DataFrame:
    """``uploads`` (of ``pasted`` or ``zipped``) with ``error``, the first reason to refuse or null; files that do not parse are
    warned of, and an upload of which none does is refused. Sizes are looked at before anything is parsed."""
    ship(uploads.sparkSession)
    limits = intake.upload_error(F.col("spec"), rule_count(F.coalesce("spec", F.lit(""))), F.col("files"))
    sized = durable(uploads.withColumn("error", first_error(F.col("refused"), limits)).drop("refused"))
    parsed = sized.where("error is null").select("upload", F.explode("files").alias("f")).select("upload", "f.path", F.col("f.source").alias("__source"))
    parsed = parsed.lateralJoin(F.udtf(ParseErrors, returnType="why string")(F.col("__source").outer()))
    warning = F.when(F.col("why").isNotNull(), F.concat("path", F.lit(" does not parse ("), "why", F.lit(") and is skipped")))
    told = parsed.groupBy("upload").agg(F.array_sort(F.collect_list(warning)).alias("__why"), F.count_if(F.col("why").isNull()).alias("__readable"))
    joined = sized.join(told, "upload", "left")
    error = first_error(F.col("error"), F.when(F.col("__readable") == 0, NOTHING_PARSES))
    return joined.withColumn("error", error).withColumn("warnings", F.concat("warnings", F.coalesce("__why", F.array().cast("array<string>")))).drop("__why", "__readable")


def random_id() -> Column:
    return F.substring(F.sha2(F.uuid(), 256), 1, ID_DIGITS)


def materialised(spark: SparkSession, uploads: DataFrame, root: str, make_id: Callable[[], Column] = random_id) -> DataFrame:
    """Write the uploads of ``checked`` that have no error; (upload, id, error) of all. An id that is taken, or drawn twice,
    is drawn again."""
    left = durable(uploads.where("error is null"))
    drawn = None
    while not left.isEmpty():
        tried = durable(left.select("upload", make_id().alias("id")))
        once = tried.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("upload"))).where("__n = 1").drop("__n")
        fresh = once.join(stored_ids(spark, root), "id", "left_anti")
        fresh = durable(fresh if drawn is None else fresh.join(drawn.select("id"), "id", "left_anti"))
        drawn = fresh if drawn is None else drawn.unionByName(fresh)
        left = durable(left.join(fresh.select("upload"), "upload", "left_anti"))
    if drawn is None:
        return uploads.select("upload", F.lit(None).cast("string").alias("id"), "error")
    named = uploads.where("error is null").join(drawn, "upload")
    path = F.concat(F.lit("src/"), F.regexp_replace("f.path", "^src/", ""))
    lines = F.length("f.source") - F.length(F.replace("f.source", F.lit("\n"))) + 1
    files = named.select("id", F.explode("files").alias("f")).select("id", path.alias("path"), "f.source", lines.cast("int").alias("lines"))
    files.repartition("id").write.mode("append").partitionBy("id").parquet(f"{root}/files")
    name = X.slug(F.coalesce("name", F.lit("")))
    facts = named.select("id", name.alias("name"), "spec_path", "spec", rule_count(F.col("spec")).alias("rules"), F.size("files").alias("files"), "warnings")
    facts.repartition("id").write.mode("append").partitionBy("id").parquet(f"{root}/manifests")
    return uploads.select("upload", "error").join(drawn, "upload", "left").select("upload", "id", "error")


def _listed(spark: SparkSession, folder: str) -> list:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s for s in (files.listStatus(at) if files.exists(at) else []) if s.isDirectory() and s.getPath().getName().startswith("id=")]


def stored_ids(spark: SparkSession, root: str) -> DataFrame:
    """(id) of the folders of all uploads, whole or not."""
    names = {s.getPath().getName()[3:] for part in ("files", "manifests") for s in _listed(spark, f"{root}/{part}")}
    return spark.createDataFrame([(n,) for n in sorted(names)], "id string")


def reread(spark: SparkSession, root: str, upload_id: str) -> tuple[DataFrame, DataFrame] | None:
    """(manifest, files) of an upload; None for an id of another form, and for one that is not there as a whole."""
    import re

    if not re.fullmatch(intake.UPLOAD_ID.strip("^$"), upload_id or ""):
        return None
    if not any(s.getPath().getName() == f"id={upload_id}" for s in _listed(spark, f"{root}/manifests")):
        return None
    own = F.lit(upload_id).alias("id")
    read = lambda part, schema: spark.read.schema(schema.partition(", ")[2]).parquet(f"{root}/{part}/id={upload_id}").select(own, "*")
    return read("manifests", MANIFEST), read("files", FILES)


def pruned(spark: SparkSession, root: str, ttl_seconds: int, now_ms: int | None = None) -> list[str]:
    """Delete uploads whose folders were last changed longer ago than their time to live; their ids. 0 or less keeps all.

    A manifest goes before its files, so that who looks for the upload then does not find it half there; folders without a
    manifest, of a write that runs or has crashed, go by the age of their files."""
    if ttl_seconds <= 0:
        return []
    now = spark._jvm.java.lang.System.currentTimeMillis() if now_ms is None else now_ms
    manifests = {s.getPath().getName(): s for s in _listed(spark, f"{root}/manifests")}
    files = {s.getPath().getName(): s for s in _listed(spark, f"{root}/files")}
    gone = []
    for name in sorted(manifests.keys() | files.keys()):
        status = manifests.get(name) or files[name]
        if status.getModificationTime() >= now - ttl_seconds * 1000:
            continue
        for part in (manifests.get(name), files.get(name)):
            if part is not None:
                part.getPath().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(part.getPath(), True)
        gone.append(name[3:])
    return gone
