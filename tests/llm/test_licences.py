"""Licence texts are known by their canonical form alone."""

import textwrap

from pyspark.sql import functions as F

from riskloom.llm.base import OWN
from riskloom.llm.licences import LICENCES, known_texts, scan_licences


def test_variants_of_a_licence(spark):
    mit = LICENCES["MIT"]
    variant = "Copyright (c) 2020 A\n(C) 2021 B\n" + mit.replace('"', "“").replace(", ", " ,\n\t").replace("sublicense", "sub-licence").lower()
    texts = [mit, variant, mit + " more", None, "", mit[:-40], "MIT License\n\nCopyright 2020 X\n\n" + mit, mit]
    df = spark.createDataFrame([(i if i != 7 else None, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, licence string")
    got = {r["doc_id"]: (r[f"{OWN}licence"], r["licence"]) for r in scan_licences(df).collect()}
    want = {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "MIT", None: "MIT"}
    assert got == {k: (v, "own") for k, v in want.items()}
    assert scan_licences(df.limit(0)).count() == 0


def test_rows_of_any_kind(spark):
    """Nulls, empty and repeated texts, columns named as the operator's own, ties of names, empty tables."""
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, LICENCES["MIT"].upper(), "c"), (3, "word " * 50_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, licence string")
    out = scan_licences(docs)
    assert sorted((r["licence"], r[f"{OWN}licence"]) for r in out.collect() if r["licence"] == "c") == [("c", "MIT")]
    assert out.count() == 5 and out.where(F.col(f"{OWN}licence").isNotNull()).count() == 1
    known = spark.createDataFrame([("b", "word " * 50_000), ("a", "Word, " * 50_000), (None, "x"), ("none", None), ("bare", " ")], "licence string, text string")
    assert {(r["licence"], r[f"{OWN}licence"]) for r in scan_licences(docs, known).collect()} == {("a", None), ("b", None), ("c", None), ("d", "a")}
    assert scan_licences(docs.limit(0)).count() == 0 and scan_licences(docs, known.limit(0)).where(F.col(f"{OWN}licence").isNotNull()).count() == 0


def wrapped(text, width):
    paragraphs = [" ".join(p.split()) for p in text.replace("\r", "").split("\n\n")]
    return "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in paragraphs)


def test_every_known_text_at_every_width(spark):
    """All known licences, wrapped anew at 60 to 80 columns, under usual headings and claims."""
    known = known_texts()
    assert len(known) >= 17
    heads = {"MIT": "The MIT License (MIT)\n\nCopyright (c) 2014 A B <a@b.c>\n\n", "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n",
             "BSD-2-Clause": "Copyright 2001 by Y. All rights reserved.\n", "ISC": "ISC License\n\nCopyright 2004-2010 Z\n"}
    heads = {k: v.replace("<a@b.c>", "a@b.c") for k, v in heads.items()}
    rows = [(name, f"{heads.get(name, '')}{wrapped(text, width)}") for name, text in known.items() for width in (60, 64, 66, 69, 72, 76, 78, 80)]
    got = scan_licences(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [(r["name"], r[f"{OWN}licence"]) for r in got if r["name"] != r[f"{OWN}licence"]] == []


def test_near_misses_stay_null(spark):
    texts = [LICENCES["MIT"].replace("free of charge", "for a fee"), LICENCES["ISC"] + " See the notice.", "The MIT License (MIT)", "Copyright (c) 2020 A"]
    rows = [(t,) for t in texts] + [(t[: len(t) // 2],) for t in known_texts().values()]
    assert scan_licences(spark.createDataFrame(rows, "text string")).where(F.col(f"{OWN}licence").isNotNull()).count() == 0
