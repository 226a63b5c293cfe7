import os
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pieces
from tests.llm.helpers import awkward, empty, words

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_equals_the_library_on_whole_texts(texts):
    c = pieces.codec(pieces.MODEL)
    ids, same = c.encode(texts)
    assert ids == c.library.encode(texts) and all(same)
    assert c.decode(ids) == [x.replace(pieces.MARK, " ") for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.text("ab tionhe ▁éß", max_size=80))
def test_heap_and_side_by_side_agree(text):
    c = pieces.codec(pieces.MODEL)
    marked = c.prefix + text.replace(" ", pieces.MARK) if text else ""
    assert [list(c.by_heap(marked))] == c.encode([text])[0] == [c.library.encode(text)]


def test_round_trip_through_spark(spark, tmp_path):
    model = str(tmp_path / "copy.model")
    shutil.copy(pieces.MODEL, model)
    docs = spark.createDataFrame([(k, words(200, k) + "  né 漢字\n\t ") for k in range(30)], "doc_id long, text string")
    rows = pieces.encode(docs, model)
    got = rows.collect()
    assert all(r.matches and r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert sorted(map(tuple, pieces.decode(rows, model).collect())) == sorted(map(tuple, docs.collect()))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = pieces.encode(docs).collect()
    assert len(got) == docs.count() and all(r.matches and r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].ids == by[4].ids == [] and by[5].n_tokens > 0
    assert pieces.encode(empty(spark)).count() == 0 and pieces.decode(pieces.encode(empty(spark))).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text == ""


def test_the_library_is_compared_as_arrays(monkeypatch):
    c = pieces.codec(pieces.MODEL)
    library = c.library

    class Other:  # has no lists to give, and other ids for one text
        def encode_as_numpy(self, texts, num_threads):
            got = library.encode_as_numpy(texts, num_threads=num_threads)
            return [x[::-1].copy() if t == "other ids" else x for t, x in zip(texts, got)]

    monkeypatch.setattr(c, "library", Other())
    texts = ["one text", "", "né 漢字\n", "other ids"]
    ids, same = c.encode(texts)
    assert ids == library.encode(texts) and same == [True, True, True, False]
    assert c.encode(texts[:3])[1] == [True] * 3 and c.encode([]) == ([], [])
