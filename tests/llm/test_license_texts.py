"""Entire licence texts, as the system has them."""

import os

import pytest

pytest.importorskip("public_tokenizers")
from quire.llm import licenses  # noqa: E402

HOME = "/usr/share/common-licenses"
NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir(HOME), reason="the texts are absent")
def test_entire_texts(spark):
    rows = []
    for file, name in NAMES.items():
        with open(f"{HOME}/{file}", encoding="utf-8", errors="replace") as text:
            rows.append((name, text.read().upper()))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.all_known(spark)).collect()
    assert len(got) == len(NAMES) and all(r.license == r.doc_id for r in got)
