"""Steps that Spark once evaluated several times over, or shuffled whole: their expressions, plans and odd inputs."""

import duckdb
import pyarrow as pa
import pytest

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R
from quillspark.operators import books as B
from quillspark.operators import folds
from quillspark.operators import relations as O
from quillspark.plans import registry
from quillspark.plans.dialect import DUCK, SPARK

DIR = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def alike(spark, function, values, **how):
    """Both engines over the same values."""
    con = duckdb.connect()
    for value in values:
        a = spark.sql("SELECT " + function(SPARK, "x", **how) + f" AS y FROM (SELECT {SPARK.lit(value)} AS x)").first()[0]
        b = con.execute("SELECT " + function(DUCK, "x", **how) + f" AS y FROM (SELECT {DUCK.lit(value)} AS x)").fetchone()[0]
        assert a == b or float(a) == float(b), (value, a, b)


def test_corruption_strips_a_line_once(spark):  # F2, F3
    assert P.corruption_score(SPARK, "x").count(SPARK.strip("x")) == 1
    odd = ["", "abc", "a b c d e f g h", "Ⅷ123 Ⅷbcd x y", "bcdf ghjk lmnp", "a1 b2 c3\td4", "\x01\x01 one two three four five six seven", "12 34 56 78 90 11 22 33", "#### #### ~~~~", "Ünd ärger über ös", "x" * 300, "mp3 l0ve  m1x h3re", "ἀρχή ψχφθ"]
    alike(spark, P.corruption_score, odd)


def test_docling_searches_what_is_there(spark):  # F1, F4
    assert R.docling(SPARK, "x").count("regexp_replace(") <= 10
    odd = ["", "a´´ e ´ E´´ e`´", "á ´ u ¨ C¸", "naı€ve ni€ os ı ´", "a V b V c V d V e", "x Z y W z", "R R R a aR b", "1 : 2 :3 4 - 5 -6", "a , ; ) b ]c", "( x [ y", "5 th 6 nd, 7 rdx", "a   b \t c"]
    alike(spark, R.docling, odd)


def test_section_is_converted_once(spark):  # F1
    plan = optimized(registry.QUERIES["c10_docling_clean"](spark, DIR))
    assert plan.count("(st|nd|rd|th)") == 1 and plan.count("(?m)^#+") == 1


def test_diacritics_evaluate_their_text_once(spark):  # F14
    assert R.diacritics(SPARK, "some(x)").count("some(x)") == 1
    alike(spark, R.diacritics, ["", "ı", "ı ´x", "€u € U €€o", "é́ ´", "ñ ı€ a ¨", "c ¸C¸"])


@pytest.mark.parametrize("how", [{}, {"most": 20, "lower": True}])
def test_slugs_are_cut_once(spark, how):  # F17, F18
    assert R.slug(SPARK, "x", **how).count("substr(") == 1
    alike(spark, R.slug, ["", "___", "-a-", "a" * 90, "é A_ b", "a\t\tb"], **how)


def test_blocks_are_judged_once(spark):  # F8, F15
    assert P.garbage_block(SPARK, "x").count("array_join(") == 1
    odd = ["", "a b c d e f", "Über Ünd über ß é ö", "1 2 3 4", "aB cD eF gH", "(x) [y] 'z' B' I' A'", "12\u000b34 a\u000bb 5 6 7", "I a A I a A", "X Y one two three four", "QX one ZB two, 7 three", "(Zu) «Ra» *oe* 7X", ". , ; :", "O'Neil's d'Or McX MacDonald"]
    alike(spark, P.garbage_block, odd)
    found = "([0-9]+ "
    glued = O._artifact_kinds(SPARK, "s", "f")["glued"]
    assert "AND" in glued and found not in glued


def test_paragraphs_are_merged_once(spark):  # F9
    assert optimized(registry.QUERIES["w3_merged_paragraphs"](spark, DIR)).count("coalesce(text") == 1
    con = duckdb.connect()
    for text in ("", "\n \n", "a\n\nb", "  one\n two\n \n\n three-\n\nfour.\n\nFive\n   ", "\n\nx\n"):
        got = spark.sql(O.local_merged(f"SELECT 1 AS doc_id, {SPARK.lit(text)} AS text")).collect()
        lines = O.lines(DUCK, f"SELECT 1 AS doc_id, {DUCK.lit(text)} AS text")
        want = con.execute(O.merged(DUCK, O.paragraphs(DUCK, lines))).fetchall()
        assert sorted(tuple(r) for r in got) == sorted(want), text


def test_translation_is_read_once(spark):  # F7
    plan = optimized(registry.QUERIES["g11_translation_verdicts"](spark, DIR))
    assert plan.count("```.*?") == 2


def test_citations_stay_within_the_row(spark):  # F5, F19
    plan = optimized(registry.QUERIES["p29_citations"](spark, DIR))
    assert "Window" not in plan and optimized(registry.QUERIES["j7_citation_keys"](spark, DIR)).count("Relation [doc_id") == 1
    con = duckdb.connect()
    for text in ("", "@a", "x@b.c @d\n```\n@e\n```\n@f", "```\n@g", "@h `@i\n```\n@j\n```\n@k` @l", "  ```x\n@m\n ``` \n-@n:o", "``` @p ```\n@q", "a\n```"):
        got = {tuple(r) for r in spark.sql(O.local_citations(f"SELECT 1 AS doc_id, {SPARK.lit(text)} AS text")).collect()}
        lines = O.lines(DUCK, f"SELECT 1 AS doc_id, {DUCK.lit(text)} AS text")
        assert got == set(con.execute(O.citations(DUCK, lines)).fetchall()), text


def test_postings_are_counted_within_the_row(spark):  # F12
    docs = "SELECT 1 AS doc_id, 'one Two two Éa 33 one one\n\n# h\nshort\n\nanother passage of words' AS text"
    rows = sorted(tuple(r) for r in spark.sql(O.local_postings(docs)).collect())
    assert rows == sorted([(1, 1, "one", 3), (1, 1, "two", 2), (1, 1, "ea", 1), (1, 1, "33", 1), (1, 3, "another", 1), (1, 3, "passage", 1), (1, 3, "of", 1), (1, 3, "words", 1)])
    again = sorted(tuple(r) for r in spark.sql(O.local_postings(f"{docs} UNION ALL {docs}")).collect())
    assert again == [(*r[:3], 2 * r[3]) for r in rows]
    # a shuffle is only there for tables with rows of one doc_id
    assert "sort_array" in optimized(registry.QUERIES["q1_postings"](spark, DIR))


def test_runs_of_documents_meet_the_passages_at_once(spark):  # F16
    plan = registry.QUERIES["l2_completeness"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [g" in plan and "LeftSemi" in plan


def test_ligature_tokens_are_counted_before_the_join(spark):  # F20, F13
    plan = optimized(registry.QUERIES["r3_ligature_map"](spark, DIR))
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_books_are_cleaned_by_the_tokens_in_question(spark):  # F13
    assert R.CAPITALS in B.clean_chapters(SPARK, "SELECT 1 AS doc_id, 'x' AS text", "SELECT 'Wx' AS w, 'fix' AS fixed")
    assert spark.sql(f"SELECT {SPARK.all(SPARK.lit('aWb cde Wnal2oYce xyz ZZ'), R.CAPITALS)}").first()[0] == ["aWb", "Wnal", "oYce", "ZZ"]


def test_spelling_counts_the_words_once(spark, tmp_path):  # F10
    names = ["house"] * 9 + ["horse"] * 4 + ["garden"] * 8 + ["wonder"] * 12 + ["thermometers"] * 8 + ["abcdefghijklmno"] * 8
    rare = "housf hosue hoose graden gradne wodners gaaarden wonedr hores thermometer abcdefghijkl thermomtersx gradenx xyz"
    spark.createDataFrame([(1, " ".join(names)), (2, rare), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["l6_spelling"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.word, r.fix) for r in df.collect())
    assert got == sorted(con.execute(registry.SQL["l6_spelling"]).fetchall()) and ("graden", "garden") in got and ("gradenx", "garden") in got
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 4


def test_sections_keep_an_array_while_they_search_it(spark):  # F11
    assert B.behind(SPARK, "made(x)", lambda p: f"{p} = 'a'").count("made(x)") == 1
    assert "regexp_extract_all" not in P.garbage_line(SPARK, "x")
    alike(spark, R.leading_number, ["", "foo- 1 a- 2 b", "foo- 1 abc- 2 d", "x- 12. 3 la y- 4 el", "word- 1. 22 1 a", "-- 12a", "12 - 3¡x", "a-\n1\n2 b", "é- 9 ñ"])
    alike(spark, P.garbage_line, ["", "abcdefghijkl", "abcdefghijklm", "abc12345678defg", "ab cd ef gh ij kl mn op", "a" * 25 + " bcd", "a" * 26 + " bcd", "abc\ndef ghi jkl", "ñandú ŝŝŝŝŝ ŝŝŝŝŝŝ", "  123 abc !!! "])


def test_folds_hold_few_texts_at_once(spark):  # F6
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["x"] * n}) for n in (200, 0, 64)]
    got = list(folds.slices(iter(batches)))
    assert [b.num_rows for b in got] == [64, 64, 64, 8, 64] and got[1].column(0)[0].as_py() == 64
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"a1234{k}b") for k in range(300)], "doc_id long, text string").coalesce(1)
    want = {k: None if k % 7 == 0 else f"A1234{k}B" for k in range(300)}
    assert {r.doc_id: r.text for r in folds.text_map(docs, str.upper).collect()} == want
    assert len(folds.rows_map(docs, lambda t: [(t,)], "doc_id long, t string").collect()) == sum(v is not None for v in want.values())
