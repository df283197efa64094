"""Word kernel against plain Python, and the SQL-expressible queries against DuckDB."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm import text as T
from churnlens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\u00a0,.", max_size=40)), max_size=8))
def test_words_and_shingles_follow_the_definition(texts):
    seen = {}
    for i, j, data, offsets in T.text_chunks(pa.array(texts, pa.string())):
        x = T.words_of(data, offsets)
        h = x.hashes()
        sh, off = T.shingles_of(h, x.first)
        for d in range(j - i):
            words = T.split_words(texts[i + d])
            a, b = x.first[d], x.first[d + 1]
            assert [bytes(x.data[s:e]).decode() for s, e in zip(x.start[a:b], x.end[a:b])] == words
            for word, value in zip(words, h[a:b].tolist()):
                assert seen.setdefault(word, value) == value
            grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
            for gram, value in zip(grams, sh[off[d] : off[d + 1]].tolist(), strict=True):
                assert seen.setdefault(gram, value) == value
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_long_and_empty_texts():
    texts = ["", None, "w " * 900_000, "a b", ""]
    total = sum(len(T.words_of(d, o).start) for _, _, d, o in T.text_chunks(pa.array(texts)))
    assert total == 900_002


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want


def test_numbers_are_stable():
    x = T.words_of(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))
    y = T.words_of(np.frombuffer(b"zz a b", np.uint8), np.array([0, 6]))
    assert x.hashes().tolist() == y.hashes()[1:].tolist()


def test_raw_text_ends_at_any_case_also_beside_letters_that_grow():
    from churnlens.llm.html_extract import Dom

    dom = Dom()
    dom.add("<body><p>İstanbul</p><SCRIPT>var a = '<p>';</SCRIPT><p>after</p><style>x</STYLE><p>end</p>")
    assert [t for _, _, t in dom.pieces] == ["İstanbul", "after", "end"]
