"""Sources: Markdown folders, EPUB packages, RTF, captions, plans, bibliographies, segment logs.

Containers are read as binaryFile rows and parsed in Arrow batches, one file a row, so a folder of any
number of books is read in parallel; what follows works on tables.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.folds import html_markdown, rows_map, text_map

PLAN = "source string, output_dir string, running_heads array<string>, ocr_fixes array<array<string>>, sections array<struct<slug string, title string, pages array<int>, start int, `end` int, files array<string>, heading string>>"
SEGMENT = "s double, e double, t string, _bad string"


def markdown(spark: SparkSession, folder: str, pattern: str = "*.{md,txt,markdown}") -> DataFrame:
    """path, text, modified, size of every file below the folder, in order of path."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size")).orderBy("path")


def folder_fingerprint(files: DataFrame) -> DataFrame:
    """One digest of paths, times and sizes: an index whose stored digest differs is stale."""
    part = F.concat_ws(":", "path", F.unix_micros("modified").cast("string"), F.col("size").cast("string"))
    return files.agg(F.md5(F.array_join(F.array_sort(F.collect_list(part)), "|")).alias("fingerprint"))


def binaries(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return normalize_plan(spark.read.schema(PLAN).json(path, multiLine=True))


def normalize_plan(plan: DataFrame, base: int = 1, width: int = 2) -> DataFrame:
    """source, sec_no, slug, title, first_page, last_page of each section.

    Pages come as a pair or as start and end, an open end stays null; a slug given is kept, otherwise it is made of the number and title.
    """
    from quillspark.functions.rewrites import slug
    from quillspark.plans.dialect import SPARK

    rows = plan.select("source", F.posexplode("sections").alias("pos", "x")).select("source", "pos", "x.*")
    made = F.concat(F.lpad((F.col("pos") + base).cast("string"), width, "0"), F.lit("_"), F.expr(slug(SPARK, "coalesce(title, '')")))
    return rows.select(
        "source", (F.col("pos") + base).alias("sec_no"), F.coalesce(F.when(F.trim("slug") != "", F.col("slug")), made).alias("slug"), "title",
        F.coalesce(F.get("pages", F.lit(0)), "start").alias("first_page"), F.coalesce(F.get("pages", F.lit(1)), "end").alias("last_page"), "files", "heading",
    )


# == EPUB ==


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _inside(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0]))).lstrip("./")


def epub_units(content: bytes) -> list[tuple[int, str, str, str]]:
    """(place, file, title, html) in spine order; without a readable package, HTML files by name. A title comes from the first label that names the file, labels of digits alone don't count."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return []
    names = set(book.namelist())
    titles: dict[str, str] = {}
    order: list[str] = []
    try:
        boxed = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in boxed.iter() if _local(x.tag) == "rootfile")
        base, root = posixpath.dirname(package), ElementTree.fromstring(book.read(package))
        items = {x.get("id"): x for x in root.iter() if _local(x.tag) == "item"}
        for x in root.iter():
            if _local(x.tag) == "itemref" and x.get("idref") in items:
                order.append(_inside(base, items[x.get("idref")].get("href", "")))
        for x in items.values():
            where = _inside(base, x.get("href", ""))
            if "nav" in (x.get("properties") or "").split() and where in names:
                for m in re.finditer(r"(?s)<a\b[^>]*?href=[\"']([^\"']+)[\"'].*?>(.*?)</a>", book.read(where).decode("utf-8", "replace")):
                    _name(titles, _inside(posixpath.dirname(where), m[1]), re.sub(r"<[^>]+>|\s+", " ", m[2]))
            elif x.get("media-type") == "application/x-dtbncx+xml" and where in names:
                for point in ElementTree.fromstring(book.read(where)).iter():
                    if _local(point.tag) == "navPoint":
                        label = next((t.text or "" for t in point.iter() if _local(t.tag) == "text"), "")
                        src = next((t.get("src", "") for t in point.iter() if _local(t.tag) == "content"), "")
                        _name(titles, _inside(posixpath.dirname(where), src), label)
    except (KeyError, StopIteration, ElementTree.ParseError):
        order = []
    order = [x for x in order if x in names] or sorted(x for x in names if x.lower().endswith((".html", ".xhtml", ".htm")))
    return [(k, x, titles.get(x, ""), book.read(x).decode("utf-8", "replace")) for k, x in enumerate(order)]


def _name(titles: dict[str, str], where: str, label: str) -> None:
    label = " ".join(label.split())
    if label and not label.isdigit():
        titles.setdefault(where, label)


def epubs(spark: SparkSession, folder: str) -> DataFrame:
    """path, pos, href, title, html of every unit of every book."""
    return rows_map(binaries(spark, folder, "*.epub"), epub_units, "path string, pos int, href string, title string, html string", "path", "content")


def epub_sections(units: DataFrame) -> DataFrame:
    """Units in sections: a titled unit opens one, untitled ones join the section before; those before the first title go."""
    own = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    from quillspark.functions.predicates import skippable_unit
    from quillspark.plans.dialect import column

    numbered = units.withColumn("sec_no", F.sum(F.when(F.col("title") != "", 1).otherwise(0)).over(own)).filter("sec_no > 0")
    return numbered.groupBy("path", "sec_no").agg(
        F.min_by("title", "pos").alias("title"), F.expr("transform(array_sort(collect_list(struct(pos, href))), z -> z.href)").alias("files"), F.expr("array_join(transform(array_sort(collect_list(struct(pos, html))), z -> z.html), '\n')").alias("html")
    ).withColumn("skip", column(skippable_unit, "title"))


def epub_markdown(sections: DataFrame) -> DataFrame:
    """path, sec_no, title, md of the sections that aren't front or back matter."""
    keyed = sections.filter("NOT skip").withColumn("key", F.struct("path", "sec_no", "title"))
    return text_map(keyed, html_markdown, key="key", text="html").select("key.*", F.col("html").alias("md"))


# == RTF, captions, bibliographies, glossaries ==

_RTF = re.compile(r"\\u(-?\d+) ?\??|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+", re.I)
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "listtable", "generator"}


def rtf_text(source: str) -> str:
    """The plain text of RTF: paragraphs, tabs, quotes and characters; destinations that hold no text are left out."""
    out, stack, skip, past = [], [], False, 0
    for m in _RTF.finditer(source):
        if not skip:
            out.append(source[past : m.start()])
        past = m.end()
        code, byte, word, _, sign, brace = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word and word in _RTF_SKIP or sign == "*":
            skip = True
        elif skip:
            continue
        elif code:
            out.append(chr(int(code) % 65536))
        elif byte:
            out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
            out.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[word])
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif sign == "~":
            out.append("\u00a0")
    return "".join([*out, "" if skip else source[past:]])


def cues(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, cue_no, text of WebVTT or SRT captions: cue numbers, times, headers and notes go, what is left is cleaned."""
    from quillspark.functions.rewrites import caption
    from quillspark.plans.dialect import column

    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("cue_no", "raw"))
    noise = F.col("raw").contains("-->") | F.col("raw").rlike(r"^\s*([0-9]+\s*$|WEBVTT|NOTE|STYLE|Kind:|Language:)")
    return lines.filter(~noise).select(key, "cue_no", column(caption, "raw").alias("text")).filter("text <> ''")


def bibliography_keys(text: Column, kind: str = "bibtex") -> Column:
    """Keys of BibTeX entries, or the ids of CSL-JSON."""
    if kind == "bibtex":
        return F.regexp_extract_all(text, F.lit(r"(?m)^\s*@(?!comment|string|preamble)[a-zA-Z]+\s*[{]\s*([^\s,]+)\s*,"), F.lit(1))
    return F.filter(F.transform(F.from_json(text, "array<struct<id string>>"), lambda x: x.id), lambda x: x.isNotNull())


def glossary(docs: DataFrame, text: str = "text") -> DataFrame:
    """src, dst of two-column Markdown table rows, without headers and rules."""
    rows = docs.select(F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike(r"^\s*\|[^|]+\|[^|]+\|\s*$"))
    cells = rows.select(F.trim(F.regexp_extract("line", r"^\s*\|([^|]+)\|", 1)).alias("src"), F.trim(F.regexp_extract("line", r"^\s*\|[^|]+\|([^|]+)\|", 1)).alias("dst"))
    return cells.filter(~F.col("src").rlike("^[-: ]+$") & ~F.lower("src").isin("origen", "source", "src", "término", "term"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """s, e, t of an append-only JSON log; broken lines are dropped."""
    rows = spark.read.schema(SEGMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and s is not null and e is not null").drop("_bad")


def pick_track(tracks: DataFrame, wanted: str | None = None) -> DataFrame:
    """Of each video's subtitle tracks (video, lang, manual), one: manual before automatic; the language wanted, its base, or the original's."""
    base = (wanted or "").split("-")[0]
    rank = (
        F.when(F.col("lang") == wanted, 0).when(F.split("lang", "-")[0] == base, 1) if wanted else F.when(F.col("lang").endswith("-orig"), 0).otherwise(1)
    )
    ranked = tracks.withColumn("_rank", rank).filter("_rank is not null")
    first = F.row_number().over(W.partitionBy("video").orderBy(F.desc("manual"), "_rank", "lang"))
    return ranked.withColumn("_i", first).filter("_i = 1").drop("_i", "_rank")


def expand_inputs(files: DataFrame, rounds: int = 3) -> DataFrame:
    """path, text of LaTeX files with \\input{...} replaced by the file's text, `rounds` deep; missing: names that no file has."""
    seek = r"\\input[{]([^}]+)[}]"
    name = F.regexp_replace("path", r"\.tex$", "")
    store = files.select(name.alias("name"), F.col("text").alias("body"))
    now = files.select("path", "text", F.array().cast("array<string>").alias("missing"))
    for _ in range(rounds):
        parts = now.select("path", "missing", F.posexplode(F.split("text", seek, -1)).alias("pos", "piece"), F.regexp_extract_all("text", F.lit(seek), F.lit(1)).alias("names"))
        parts = parts.withColumn("name", F.regexp_replace(F.get("names", F.col("pos")), r"\.tex$", ""))
        joined = parts.join(store, "name", "left")
        now = joined.groupBy("path", "missing").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, concat(piece, coalesce(body, '')) AS s))), z -> z.s), '')").alias("text"), F.array_sort(F.collect_set(F.when(F.col("name").isNotNull() & F.col("body").isNull(), F.col("name")))).alias("lost"))
        now = now.select("path", "text", F.array_distinct(F.concat("missing", "lost")).alias("missing"))
    return now
