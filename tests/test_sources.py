import base64
import io
import zipfile

from quillspark.sources import documents as D
from quillspark.sources import sinks


def book(nav=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="o"><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="c" href="t/cover.html"/><item id="a" href="t/a.html"/><item id="b" href="t/b.html"/></manifest><spine><itemref idref="c"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", '<nav><a href="t/cover.html">Cover</a><a href="t/a.html#x">12</a><a href="t/a.html">The <i>one</i></a></nav>')
        z.writestr("OEBPS/t/cover.html", "<p>front</p>")
        z.writestr("OEBPS/t/a.html", "<h1>One</h1><p>first</p>")
        z.writestr("OEBPS/t/b.html", "<p>second</p>")
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(book())
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    units = D.epubs(spark, str(tmp_path))
    assert [(r.pos, r.href, r.title) for r in units.orderBy("pos").collect()] == [(0, "OEBPS/t/cover.html", "Cover"), (1, "OEBPS/t/a.html", "The one"), (2, "OEBPS/t/b.html", "")]
    sections = D.epub_sections(units)
    got = {r.sec_no: r for r in sections.collect()}
    assert got[1].skip and got[2].files == ["OEBPS/t/a.html", "OEBPS/t/b.html"]
    md = D.epub_markdown(sections).collect()
    assert [(r.title, r.md) for r in md] == [("The one", "# One\n\nfirst\n\nsecond\n")]


def test_plan(spark, tmp_path):
    p = tmp_path / "plan.json"
    p.write_text('{"sections": [{"pages": [11, 20], "title": "T"}, {"title": "Bhāva", "start": 4}, {"slug": "01_Own", "title": "P", "pages": [9, null]}], "source": "x.pdf"}')
    got = D.read_plan(spark, str(p)).orderBy("sec_no").collect()
    assert [(r.slug, r.first_page, r.last_page) for r in got] == [("01_T", 11, 20), ("02_Bhāva", 4, None), ("01_Own", 9, None)]


def test_rtf():
    assert D.rtf_text(r"{\rtf1{\fonttbl{\f0 Times;}}\pard\tab Se\'f1or \u955?\par A \{b\}\emdash c}") == "\tSeñor λ\nA {b}—c"


def test_captions_glossary_and_keys(spark):
    df = spark.createDataFrame([(1, "WEBVTT\n\n1\n00:01.000 --> 00:02.000\nhello <c>there</c>\n\n2\n00:02.000 --> 00:03.000\nbye &amp; on")], "doc_id long, text string")
    assert [r.text for r in D.cues(df).orderBy("cue_no").collect()] == ["hello there", "bye & on"]
    g = spark.createDataFrame([("| origen | destino |\n|---|---|\n| house | casa |\nx",)], "text string")
    assert [tuple(r) for r in D.glossary(g).collect()] == [("house", "casa")]
    b = spark.createDataFrame([("@book{smith2001,\n title={x}}\n@comment{no,}\n  @article{ jones:99 ,", '[{"id": "a1"}, {"type": "x"}]')], "b string, c string")
    r = b.select(D.bibliography_keys(b.b).alias("x"), D.bibliography_keys(b.c, "csl").alias("y")).first()
    assert r.x == ["smith2001", "jones:99"] and r.y == ["a1"]


def test_folder_index_and_freshness(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/b.md").write_text("two")
    (tmp_path / "in/sub/a.md").write_text("one")
    (tmp_path / "in/c.bin").write_text("no")
    files = D.markdown(spark, str(tmp_path / "in"))
    assert [r.text for r in files.collect()] == ["two", "one"]
    mark = D.folder_fingerprint(files).first()[0]
    out = str(tmp_path / "index")
    assert not sinks.index_is_fresh(spark, out, mark)
    sinks.write_index(spark.createDataFrame([("a", 1)], "term string, tf int"), out, mark)
    assert sinks.index_is_fresh(spark, out, mark) and not sinks.index_is_fresh(spark, out, "other")


def test_segments_and_srt(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"s": 2.0, "e": 3723.4567, "t": " b "}\n{"s": 0.5, "e": 2.0, "t": "a"}\n{"s": 1.0, "e"\n')
    rows = D.segments(spark, str(tmp_path)).selectExpr("1 as doc_id", "*")
    assert sinks.srt(rows).first().srt == "1\n00:00:00,500 --> 00:00:02,000\na\n\n2\n00:00:02,000 --> 01:02:03,456\nb\n"


def test_images_and_files(spark, tmp_path):
    code = base64.b64encode(b"\x89PNG").decode()
    table, clear = sinks.images(spark.createDataFrame([(1, f"x ![a](data:image/png;base64,{code}) y ![](data:image/jpeg;base64,{code}) z"), (2, "none")], "doc_id long, text string"))
    assert [(r.doc_id, r.n, r.name, bytes(r.data)) for r in table.orderBy("n").collect()] == [(1, 1, "imagen-01.png", b"\x89PNG"), (1, 2, "imagen-02.jpg", b"\x89PNG")]
    assert {r.doc_id: r.text for r in clear.collect()} == {1: "x ![Imagen 1](imagen-01.png) y ![Imagen 2](imagen-02.jpg) z", 2: "none"}
    sections = spark.createDataFrame([("01_A", "A", "text\n", "p", 1), ("02_B", "B", None, "p", 2)], "slug string, title string, md string, path string, sec_no int")
    sinks.section_files(sections, str(tmp_path / "out"))
    assert next((tmp_path / "out/slug=01_A").glob("*.txt")).read_text() == "# A\n\ntext\n"
    assert sinks.combined(sections.fillna("end", ["md"])).first().md == "text\n\n\n---\n\nend"


def test_tracks_and_inputs(spark):
    t = spark.createDataFrame([("v", "en", False), ("v", "es-419", True), ("v", "es", True), ("w", "fr-orig", False), ("w", "en", False)], "video string, lang string, manual boolean")
    assert {r.video: r.lang for r in D.pick_track(t, "es").collect()} == {"v": "es"} and {r.video: r.lang for r in D.pick_track(t).collect()} == {"v": "es", "w": "fr-orig"}
    f = spark.createDataFrame([("main.tex", r"A \input{b} C \input{gone}"), ("b.tex", r"(\input{c})"), ("c.tex", "deep")], "path string, text string")
    got = {r.path: r for r in D.expand_inputs(f).collect()}
    assert got["main.tex"].text == "A (deep) C " and got["main.tex"].missing == ["gone"] and got["c.tex"].text == "deep"
