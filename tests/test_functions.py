"""Expectations of classifiers and rewrites, in both engines."""

import duckdb
import pytest

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R
from quillspark.operators import relations as O
from quillspark.plans.dialect import DUCK, SPARK


@pytest.fixture
def both(spark):
    con = duckdb.connect()

    def ask(function, value, **how):
        a = spark.sql("SELECT " + function(SPARK, "x", **how) + f" AS y FROM (SELECT {SPARK.lit(value)} AS x)").first()[0]
        b = con.execute("SELECT " + function(DUCK, "x", **how) + f" AS y FROM (SELECT {DUCK.lit(value)} AS x)").fetchone()[0]
        assert (list(a), list(b)) == (list(b), list(a)) if isinstance(a, list) else a == b or float(a) == float(b), (value, a, b)
        return a

    return ask


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (R.tex_escape, {"R&B 50% #2_try $y": r"R\&B 50\% \#2\_try \$y", r"a\b": r"a\textbackslash{}b", "{a}~b": r"\{a\}\textasciitilde{}b", "b^c": r"b\textasciicircum{}c", "El arte de la astrología": "El arte de la astrología"}),
        (P.ends_terminal, {"": True, "   ": True, "Una frase completa.": True, "¿Pregunta?": True, "una frase que continúa": False, "el planeta regente del": False}),
        (R.ordinals, {"the 4 lh house": "the 4th house", "the 12 ,h house": "the 12th house", "the 9' h house": "the 9th house", "Venus in the 4' v house": "Venus in the 4th house", "the ll' h house": "the 11th house", "the 12 th house": "the 12th house", "the 22 nd day": "the 22nd day", "9 15 00 AM CET": "9 15 00 AM CET", "Mar 12 1971": "Mar 12 1971", "He earned 500 dollars in 2015": "He earned 500 dollars in 2015", "all the still water": "all the still water", "in 2015 th": "in 2015 th", "on 31 th and 02 nd": "on 31st and 2nd", "32 th": "32 th", "0 th": "0 th", "the 4 lh and the 9' h houses": "the 4th and the 9th houses"}),
        (R.bracket_refs, {"nota[3] aquí": "nota[^3] aquí", "año[2024]": "año[2024]", "link[1](url)": "link[1](url)", "def[1]: x": "def[1]: x"}),
        (R.slug, {"Bhāva": "Bhāva", "Περὶ κράσεως": "Περὶ_κράσεως", "1. Judío de Galilea": "1_Judío_de_Galilea", "a   b": "a_b", "Kitāb al-Mawālīd": "Kitāb_al-Mawālīd", "♄♃♂": "section", "": "section"}),
        (R.title_case, {"LA VÍA DEL ORO": "La Vía del Oro", "JUDÍO DE GALILEA": "Judío de Galilea", "(EL SOL), Y SU «LUZ»": "(El Sol), y su «Luz»", "a  b": "A B", "ßa": "SSa"}),
        (R.pronoun, {"and T am the one who T think wrote it": "and I am the one who I think wrote it", "where T reads differently and B omits": "where T reads differently and B omits"}),
        (R.seconds, {"1:02:03": 3723, "12:30": 750, "45": 45}),
        (R.glyph, {"see _img_2644.gif": "♄"}),
        (R.caption, {"<00:00:01.000><c>a</c>  b &amp; c": "a b & c"}),
        (R.diacritics, {"cafe´ ni€o": "café niö", "Martı ´n": "Martín", "Caraı€be": "Caraïbe", "Wolfenb€ uttel": "Wolfenbüttel", "Franc ¸ois": "François", "Schu ¨rer": "Schürer", "cafe\u0301": "café", "plain": "plain"}),
        (R.docling, {"Acade ´mie": "Académie", "R itual": "Ritual", "R osy": "Rosy", "5 th": "5th", "1 -24": "1-24", "8 : 3": "8:3", "x ;": "x;", "( y )": "(y)", "O Y cina": "Officina", "Bu V y": "Buffy", "the W rst": "thefirst"}),
        (R.leading_number, {"54facilitó": "facilitó", "* facilitó": "facilitó", "comen- 2. 26 la": "comenla", "In 1999 he": "In 1999 he", "and page 12": "and page 12"}),
        (R.tex_symbols, {"in \\Aries{} the \\Sun": "in ♈ the ☉", "\\Ascendant{} and \\AscNode x": "Asc and ☊ x", "\\Sunny \\alpha": "\\Sunny \\alpha"}),
        (P.skippable_title, {"The Stockbroker": False, "Discovery": False, "Cover": True, "Índice general": True, "9780000000000 Copyright": True, "About the Author": True, "About time": False, "Indexing": False, "Also  by": True}),
        (P.garbled_cell, {"■ t?": True, "£": True, "a?": True, "♄ ?": False, "a+b": False, "": False, "long words ?": False, "seventeen chars ?": False}),
        (P.corruption_score, {"don't you don't": 0, "I.I.I a.b": 0, "Mr. Wrzk bcdf-ghjk qqqq": 0.3, "a b c d e f g": 0.4}),
        (R.join_lines, {"exam-\nple of\ntext": "example of text", "a\u00ad\nb": "ab"}),
        (R.star_first_chapter, {"x \\chapter{A {b} c} \\chapter{D}": "x \\chapter*{A {b} c}\\addcontentsline{toc}{chapter}{A {b} c} \\chapter{D}"}),
        (P.garbage_block, {"07 QX Ra zu Oel Ib wuuQX ru QX zo 7 XX FZ zu k": True, "**place** (*topos*): A word of old": False, "In the modern idiom, a sign is a place.": False}),
        (P.caps_heading, {"JUDÍO DE GALILEA": True, "Not a heading": False, "AB": False, "THE END.": False, "AND SO...": True}),
        (P.page_number, {"12": True, "• 47 •": True, "xiv": True, "1234": False, "a": False}),
        (P.garbage_line, {"": False, "ab": False, "######1234": True, "a clean line of prose here": False, "x" * 30: True}),
        (P.garbage_paragraph, {"": True, "Hemerología": False, "El sol en la casa de la luna es así.": False, "DKoreaXcJSIaN qZxWvT bNmKl": True}),
        (P.latin, {"12 abc": True, "λόγος": False, "": False}),
        (P.skippable_unit, {"9781234567890_cover": True, "chapter_1": False, "123": False, "Stockbroker": False, "discovery": False, "index_split_001": False, "index2": True, "about_the_author": True, "half-title": False, "halftitle": True}),
    ],
)
def test_expected(both, function, cases):
    for value, want in cases.items():
        got = both(function, value)
        assert (float(got) if isinstance(want, float) else got) == want, value


def test_tokens(both):
    assert both(R.tokens, "λόγος ῥητορική acción 123") == ["λόγος", "ῥητορική", "acción", "123"]
    assert both(R.tokens, "foo_bar") == ["foo", "bar"]


def test_slugs_with_parameters(both):
    assert both(R.slug, "a" * 200, most=10) == "a" * 10
    assert not both(R.slug, "Capítulo uno", most=9).endswith("_")
    assert both(R.slug, "Judío DE Galilea", lower=True) == "judío_de_galilea"
    assert both(R.slug, "♄", fallback="cap") == "cap"
    for title in ("2. Judía de Betania", "ANEXO  7 — Notas", "x - y"):
        once = both(R.slug, title)
        assert both(R.slug, once) == once


def test_corruption_score(both):
    assert both(P.corruption_score, "a clean line of ordinary prose") == 0
    assert float(both(P.corruption_score, "xcvbnm qwrtp l0ve m1x ~~~ ###")) >= 0.35
    assert both(P.corruption_score, "ab") == 0


def test_heads_and_numbers(both):
    assert both(P.running_head_folded, "THE RUNNING-HEAD") and not both(P.running_head_folded, "something else")
    assert both(R.index_key, "al-Birúni") == "biruni"
    assert both(R.resolve_href, "../a/./b.html#x", base="'OEBPS/text'") == "OEBPS/a/b.html"


def test_slugs_compose_and_fold(both):
    assert both(R.slug, "Do\u0308ser") == "Döser" and both(R.slug, "Döser Ñandú ♄", ascii_only=True) == "Doser_Nandu"


def kinds(spark, builder, text):
    rows = spark.sql(builder(SPARK, "SELECT 1 AS doc_id, {t} AS text".replace("{t}", SPARK.lit(text)))).collect()
    return sorted({r.kind for r in rows})


def test_artifacts(spark):
    show = lambda text: kinds(spark, O.artifacts, text)
    assert show("010 OQ Fo vio QX 7 ZK XX 4 RRR") == ["garbage"]
    assert show("of the old kings. house: oikos. A place") == ["glued"] and show("old kings' house: oikos. A place.") == []
    assert show("- such a manner of effects.") == ["dash"] and show("35 texto que sigue.") == ["pagenum"] and show("05 texto que sigue.") == []
    assert show("as said by Ptolemy. ] Bt") == ["stray"] and show("it ends with [") == ["bracket"]
    assert show("the paragraph was cut\n\nin the middle.") == ["split"] and show("# the title\n\nin the middle.") == []
    assert show("A clean paragraph.\n\nAnother one.") == []


def test_proofreading(spark):
    show = lambda text: kinds(spark, O.proofread, text)
    assert show("two  spaces") == ["double_space"] and show("end ") == ["trailing_space"] and show("so , there") == ["space_before_punctuation"]
    assert show("a 'quote'") == ["straight_quote"] and show("and so...") == ["three_dots"] and show("this - that") == ["hyphen_for_dash"]
    assert show("word [^1]") == ["space_before_note"] and show("¿por qué") == ["unclosed_opening"] and show("¿por qué?") == []
    assert show("of de de old") == ["repeated_word"] and show("muy muy bien") == [] and show("de, de") == [] and show("De de") == ["repeated_word"]
    assert show("a\n\n\n\n\nb") == ["third_blank"] and show("a\n\n\nb") == []
    assert show("```\ntwo  spaces\n```\nfine") == [] and show("https://x.y/a'b and [x](it's)`it's  so`.") == []


def test_roles(spark):
    def roles(*titles):
        heads = " UNION ALL ".join(f"SELECT 1 AS doc_id, {k} AS pos, {SPARK.lit(t)} AS title" for k, t in enumerate(titles))
        return [r.role for r in sorted(spark.sql(O.roles(SPARK, heads)).collect(), key=lambda r: r.pos)]

    assert roles("Prefacio", "Capítulo 1 — Uno", "Interludio", "2. Dos", "Apéndice") == ["front", "chapter", "appendix", "chapter", "appendix"]
    assert roles("", "Introduction", "Parte 1", "Prefacio") == ["front", "front", "appendix", "appendix"]


def test_openings(spark):
    def opened(text):
        return spark.sql(O.openings(SPARK, f"SELECT 1 AS doc_id, {SPARK.lit(text)} AS text")).first().text

    assert opened("# 1. Title\nAPTER ONE\nCH\nTHE TITLE\nT he history of,\n\nall of it.\n\nMore.") == "# 1. Title\n\nThe history of, all of it.\n\nMore."
    for same in ("# Title\nMuch has been said.\nT he end", "no title\nT he end", "# Title\nCAPS ONLY"):
        assert opened(same) == same
