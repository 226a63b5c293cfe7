"""Sinks: one Markdown file a section, combined books, images out of Markdown, SRT, search indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section_files(sections: DataFrame, folder: str) -> None:
    """A folder a slug with one text file: the title as heading, then the text. Committed by Spark, so a file is whole or absent."""
    md = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.regexp_replace(F.coalesce("md", F.lit("")), r"\s+$", ""))
    sections.select("slug", md.alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)


def combined(sections: DataFrame, key: str = "path", rule: str = "\n\n---\n\n") -> DataFrame:
    """The sections of each book in one text."""
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "md"))), lambda z: z.md), rule).alias("md"))


def images(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name, data) of the base64 images in Markdown, numbered within the document, and the documents with links instead."""
    pattern = r"!\[[^]]*[]][(]data:image/([a-z]+);base64,([A-Za-z0-9+/=\s]+)[)]"
    found = docs.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("code"))).alias("pos", "x"))
    name = F.format_string("imagen-%02d.%s", F.col("pos") + 1, F.regexp_replace(F.col("x.kind"), "^jpeg$", "jpg"))
    table = found.select("doc_id", (F.col("pos") + 1).alias("n"), name.alias("name"), F.unbase64(F.regexp_replace("x.code", r"\s", "")).alias("data"))
    pieces = docs.select("doc_id", F.posexplode(F.split("text", pattern, -1)).alias("pos", "piece"), F.size(F.split("text", pattern, -1)).alias("total"))
    joined = pieces.join(table.select("doc_id", (F.col("n") - 1).alias("pos"), "n", "name"), ["doc_id", "pos"], "left")
    link = F.coalesce(F.concat(F.lit("![Imagen "), F.col("n").cast("string"), F.lit("]("), F.col("name"), F.lit(")")), F.lit(""))
    clear = joined.withColumn("s", F.concat("piece", link)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda z: z.s), "").alias("text"))
    return table, clear


def srt(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, srt: numbered cues in order of time; milliseconds are cut."""
    from quillspark.functions.rewrites import srt_time
    from quillspark.plans.dialect import column

    rows = segments.select(key, "s", F.concat(column(srt_time, "s"), F.lit(" --> "), column(srt_time, "e"), F.lit("\n"), F.trim("t")).alias("cue"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "cue"))).alias("c"))
    return listed.select(key, F.concat(F.array_join(F.transform("c", lambda z, i: F.concat((i + 1).cast("string"), F.lit("\n"), z.cue)), "\n\n"), F.lit("\n")).alias("srt"))


def write_index(postings: DataFrame, folder: str, fingerprint: str) -> None:
    """Postings by term, with the state of the folder they come from; replaces what was there."""
    postings.withColumn("fingerprint", F.lit(fingerprint)).repartitionByRange("term").write.mode("overwrite").parquet(folder)


def index_is_fresh(spark, folder: str, fingerprint: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    first = spark.read.parquet(folder).select("fingerprint").first()
    return first is not None and first[0] == fingerprint
