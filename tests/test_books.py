"""Whole conversions, on texts whose result is written out."""

import pytest

from quillspark.operators import books as B
from quillspark.plans.dialect import SPARK


@pytest.fixture
def convert(spark):
    def run(builder, text, *how, **more):
        return spark.sql(builder(SPARK, f"SELECT 1 AS doc_id, {SPARK.lit(text)} AS text", *how, **more)).first().md

    return run


def test_book_section(convert):
    pages = (
        "The Running Head of it\n\n     Prefacio\n\n  12\n\nTbe first paragraph of the text was bro-\nken over the lines, and it goes on upon\f"
        "IV\nthe next page to its end.\n\n54facilitó la lectura de este libro\n\n• 47 •\n\nEL TÍTULO DE LA PARTE\n\nqX ZwK 0O1l ~~~ ###{}|\n\nA last paragraph is here for all to see.\n   And an indented one is here too."
    )
    want = (
        "# Prefacio\n\nThe first paragraph of the text was broken over the lines, and it goes on upon the next page to its end.\n\nfacilitó la lectura de este libro\n\n## El Título de la Parte\n\n"
        "A last paragraph is here for all to see.\n\nAnd an indented one is here too.\n"
    )
    assert convert(B.book_section, pages, "'Prefacio'", heads=("Running Head",), fixes=(("[Tt]be", "The"),)) == want
    assert convert(B.book_section, "", "'T'") == "# T\n\n\n"


def test_ocr_section(convert):
    text = "xii\nstray noise\n\nTHE FIRST HEADING\n\nThe para-\ngraph goes\non.\n12\n\nShort one.\nNOTES\n1. A note that\nruns on\n2. Second"
    assert convert(B.ocr_section, text, "'One'") == "# One\n\n## THE FIRST HEADING\n\nThe paragraph goes on.\n\nShort one.\n\n## Notes\n\n[^1]: A note that runs on\n[^2]: Second\n"
    assert convert(B.ocr_section, "THE HEADING", "'One'") == "# One\n\n## THE HEADING\n"


def test_docling_section(convert):
    assert convert(B.docling_section, "## Old title\nAcade ´mie\n|\n| |\n5 th ;\n", "'# Notes'") == "# Notes\n\nAcadémie\n5th;\n"
    assert convert(B.docling_section, "a\n||\nb") == "a\nb"


def test_translation_findings(spark):
    def kinds(o, t, **how):
        pair = f"SELECT 1 AS doc_id, {SPARK.lit(o)} AS o, {SPARK.lit(t)} AS t"
        return {r.kind for r in spark.sql(B.translation_findings(SPARK, pair, **how)).collect()}

    o = "# A\n\nSome words of prose[^1] from 1999.\n\n## B\n\nMore of [it](u).\n\n[^1]: note"
    assert kinds(o, o.replace("Some words", "Unas letras").replace("More of", "Más de")) == set()
    assert kinds(o, o.replace("[^1] from", " from")) == {"refs_missing", "notes_without_ref", "numbers_lost"}
    assert kinds(o, o.replace("[^1] from", "[^1][^2] from")) == {"refs_extra", "refs_without_note"}
    assert kinds(o, o.replace("## B", "# B")) == {"heading_levels"} and "heading_count" in kinds(o, o.replace("## B\n\n", ""))
    assert kinds(o, o.replace("(u)", "(v)")) == {"links"} and kinds(o, o.replace("1999", "l999")) == {"numbers_lost"}
    assert "short" in kinds("a b c d e f g h i j", "a b") and "long" in kinds("a b c", "a b c d e")
    assert kinds(o, o + "\n```\n# code [^9]\n```") - {"long"} == {"fences"}
    assert kinds("[a](u)[b](v)", "[a](u)[b](w)") == {"links"}
    long = "This paragraph is much longer than forty characters are."
    assert kinds(long, long) == {"left_as_it_was"} and kinds(o, o, glossary=("prose",)) == {"glossary_leak"}


def test_academic_clean(spark):
    fixes = "SELECT 'oYce' AS w, 'office' AS fixed UNION ALL SELECT 'Wnal', 'final'"
    text = "# T\nCHAPTER\nT he oYce, cafe´ and Wnal oYce of BWV oYces"
    got = spark.sql(B.clean_chapters(SPARK, f"SELECT 1 AS doc_id, {SPARK.lit(text)} AS text", fixes)).first().text
    assert got == "# T\n\nThe office, café and final office of BWV oYces"
