"""Notices of rows that share an id, or have none."""

import pytest

pytest.importorskip("public_tokenizers")
from quire.llm import licenses  # noqa: E402


def test_texts_under_one_id_keep_their_own_notices(spark):
    mit, gpl, clean = "a\nReleased under the MIT License.", "b\nThis work is licensed under the GNU General Public License, version 3.", "clean"
    rows = [(1, mit), (1, gpl), (1, clean), (None, mit), (None, gpl), (None, clean), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), licenses.known_licenses(spark)).collect()
    assert sorted((str(r.doc_id), r.notices) for r in got) == sorted([("1", "MIT"), ("1", "GPL-3.0"), ("1", ""), ("None", "MIT"), ("None", "GPL-3.0"), ("None", ""), ("None", "")])
