"""Canonical forms and digest lookup."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone.llm import licenses


def scan(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    return [(r["license_id"], list(r["notices"])) for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


def test_whole_texts_and_lines(spark):
    mit = licenses.TEXTS[0][1]
    texts = [
        "Released under the MIT License.", "released UNDER the mit licence", "Some text.\nLicensed under CC BY-NC 4.0.\nmore", f"Copyright (c) 2020 A. Person\n\n{mit}", mit.replace("\n", "  ").upper(),
        mit.replace("sublicense", "sub-licence"), mit + " And more.", "Released under the MIT License. Or not.", "", None, "   \n ", "All rights reserved.\nAll rights reserved.\nLicensed under the Apache License, v 2.0",
    ]
    got = scan(spark, texts)
    assert got[0] == ("MIT", ["MIT"]) and got[1] == ("MIT", ["MIT"])
    assert got[2] == (None, ["CC-BY-NC-4.0"])
    assert [x[0] for x in got[3:6]] == ["MIT", "MIT", "MIT"]
    assert got[6][0] is None and got[7] == (None, [])
    assert got[8:11] == [(None, [])] * 3
    assert got[11] == (None, ["Apache-2.0", "all-rights-reserved"])


def test_every_fixed_text_is_found(spark):
    every = [*licenses.NOTICES, *licenses.TEXTS]
    assert [x[0] for x in scan(spark, [t for _, t in every])] == [n for n, _ in every]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "q", "n"), (1, "All rights reserved.", "q", "n"), (None, "All rights reserved.", None, None), (1, None, "z", None)], "doc_id long, text string, license_id string, notices string")
    got = licenses.scan_licenses(docs)
    assert {"license_id_", "notices_"} <= set(got.columns)
    assert sorted((r["doc_id"] or 0, r["n_notices"]) for r in got.collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    own = spark.createDataFrame([("mine", "my words")], "license_id string, t string").select("license_id", F.sha2(licenses.canonical(F.col("t")), 256).alias("digest"))
    assert licenses.scan_licenses(spark.createDataFrame([(1, "My words!")], "doc_id int, text string"), licenses=own).first()["license_id"] == "mine"


def test_query_counts_lines_of_documents(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    known = {t for _, t in licenses.NOTICES}
    for r in licenses.op7(spark, small).collect():
        assert r["n_notices"] == len({n for n, t in licenses.NOTICES if t in set(texts[r["doc_id"]].split("\n")) & known})


def test_titles_and_copyright_lines(spark):
    mit, isc = licenses.TEXTS[0][1], licenses.TEXTS[1][1]
    heads = ["MIT License\n\nCopyright (c) 2020 Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright Jane Doe 2020\n\n", "Copyright Jane Doe\nAll rights reserved.\n\n", "Copyright: 2020, Jane Doe\n", "Copyright the Doe authors, 2020\n"]
    assert [x[0] for x in scan(spark, [h + mit for h in heads])] == ["MIT"] * len(heads)
    assert scan(spark, ["ISC License\n\nCopyright Jane Doe 2020\n\n" + isc])[0][0] == "ISC"
    # words of the licence itself stay wherever its lines break, and a title alone is no licence
    broken = [mit.replace(" ", "\n"), mit.replace("copyright notice", "\ncopyright notice"), "MIT License", mit.replace("copyright notice", "\ncopyright notice not")]
    assert [x[0] for x in scan(spark, broken)] == ["MIT", "MIT", None, None]


def test_whole_standard_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    here = [n for n in names if (folder / n).exists()]
    if not here:
        pytest.skip("no licence texts on this machine")
    texts = [(folder / n).read_text() for n in here]
    assert [x[0] for x in scan(spark, texts)] == [names[n] for n in here]
    assert [x[0] for x in scan(spark, [t + " and more" for t in texts])] == [None] * len(here)
