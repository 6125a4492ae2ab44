"""The SQL of the corpus queries says what the plain versions say."""

import brute
import pytest

from checks.parity import connect
from fieldcount.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows(con, name, *columns):
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in columns]
    return sorted(tuple(r[i] for i in at) for r in cursor.fetchall())


def texts(con, sql="SELECT doc_id, text FROM documents"):
    return con.execute(sql).fetchall()


def test_exact(con):
    got = rows(con, "op8_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact(texts(con))


def test_decontamination(con):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = brute.decontaminate(texts(con), texts(con, "SELECT item_id, text FROM benchmark"))
    assert rows(con, "op7_benchmark_decontamination", *columns) == wanted


def test_components(con):
    got = rows(con, "op3_ngram_jaccard_join", "doc_id", "n_shingles", "component_id", "n_equal", "n_links")
    assert [r[:3] for r in got] == brute.components(texts(con))
    assert [(r[0], r[4]) for r in got] == brute.links(texts(con))


def test_manifest(con):
    """Roots only: the SQL and the operator are compared row by row elsewhere."""
    got = con.execute("SELECT count(DISTINCT root), count(DISTINCT subroot) FROM (" + ORACLES["op11_merkle_manifest"] + ")").fetchone()
    assert got == (1, con.execute("SELECT count(DISTINCT source) FROM documents").fetchone()[0])


def test_substrings(con):
    wanted = [
        (key, len(w), len(gone), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        for key, w, gone in brute.repeats(texts(con), 20)
    ]
    assert rows(con, "op9_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == wanted
