import math
from collections import Counter

import duckdb
import pytest

from sojourn.llm import licenses as k

from .helpers import docs_frame, odd_rows

MIT, GPL, APACHE = k.TEMPLATES["MIT"], k.TEMPLATES["GPL-3.0"], k.TEMPLATES["Apache-2.0"]


def files(spark, rows):
    return spark.createDataFrame([(i, p, t, 1, "x") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, key long, dir string")


def test_nearest_ancestor_gives_the_licence(spark):
    filler = "plain words about nothing in particular, line after line. " * 20
    rows = [("LICENSE", MIT), ("a/LICENSE.txt", f"Some project.\n{GPL}\n"), ("a/x.py", filler), ("a/b/c/y.py", filler), ("z.py", None),
            ("q/r/w.py", f"# {APACHE}\n{filler}"), ("q/r/v.py", ""), (None, filler), (None, APACHE), ("q/r/v.py", ""), ("ab/u.py", filler)]
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_path"]) for r in k.scan(files(spark, rows)).collect()}
    assert got == {
        0: ("MIT", "own", "LICENSE"), 1: ("GPL-3.0", "own", "a/LICENSE.txt"), 2: ("GPL-3.0", "inherited", "a/LICENSE.txt"),
        3: ("GPL-3.0", "inherited", "a/LICENSE.txt"), 4: ("MIT", "inherited", "LICENSE"), 5: ("Apache-2.0", "own", "q/r/w.py"),
        6: ("MIT", "inherited", "LICENSE"), 7: (None, None, None), 8: ("Apache-2.0", "own", None), 9: ("MIT", "inherited", "LICENSE"),
        10: ("MIT", "inherited", "LICENSE")}


def test_anchors_lose_nothing():
    w = k.Weights(k.TEMPLATES, 1000, {"the": 900, "under": 800, "this": 700, "is": 700, "version": 30, "work": 100})
    anchors = set(w.anchors(0.6))
    for name, vector in w.vector.items():
        rest = math.sqrt(sum(x * x for t, x in vector.items() if t not in anchors))
        assert rest < 0.6 * w.norm[name]
    assert "the" not in anchors


def test_same_as_sql_on_documents(spark, tmp_path):
    texts = [*odd_rows(), (30, f"Intro. {MIT} More words here."), (31, GPL), (32, GPL.replace("3", "2")), (33, f"words\n{APACHE} words and words and words"),
             (34, "the license of this work is free"), (1030, "no licence"), (31, GPL)]
    docs = docs_frame(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    sql = con.sql(k.documents_sql())
    names = sorted(sql.columns)
    want = [tuple(dict(zip(sql.columns, r))[n] for n in names) for r in sql.fetchall()]
    got = [tuple(r[n] for n in names) for r in k.scan(k.document_paths(docs)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_plan_is_native(spark):
    plan = k.scan(k.document_paths(docs_frame(spark, odd_rows())))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert k.scan(files(spark, [])).collect() == []


def test_tf_idf_cosine_by_hand():
    w = k.Weights({"X": "a b b"}, 9, {"a": 4, "b": 1})
    idf = {"a": math.log(10 / 5) + 1, "b": math.log(10 / 2) + 1}
    assert w.idf == pytest.approx(idf) and Counter(w.vector["X"]) == pytest.approx({"a": idf["a"], "b": 2 * idf["b"]})


def test_ordinary_words_beside_a_notice_weigh_little(spark):
    """A word that most files hold has its own document frequency, not that of an unseen word."""
    filler = [(f"d/f{i}.txt", f"it is and to the in that with on for a file numbered x{i}") for i in range(300)]
    apache = "It is and to the in that, licensed under the Apache License, Version 2.0 and that is it."
    mit = "and that is with on for it in Released under the MIT License."
    rows = [*filler, ("a/x.txt", apache), ("b/y.txt", mit), ("c/z.txt", "zq zr zs zt zu zv zw zx Released under the MIT License.")]
    got = {r["path"]: (r["licence"], r["score"]) for r in k.scan(files(spark, rows)).collect()}
    assert got["a/x.txt"][0] == "Apache-2.0" and got["b/y.txt"][0] == "MIT" and got["c/z.txt"] == (None, None)

    texts = [set(k.terms_of(t)) for _, t in rows]
    idf = lambda t: math.log((len(rows) + 1) / (sum(t in x for x in texts) + 1)) + 1
    vec = lambda text: {t: c * idf(t) for t, c in Counter(k.terms_of(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    u, v = vec(apache), vec(APACHE)
    assert got["a/x.txt"][1] == pytest.approx(sum(x * v.get(t, 0) for t, x in u.items()) / norm(u) / norm(v), abs=1e-6)


def test_headers_licence_texts_and_spdx(spark):
    code = "".join(f"x{i} = call{i}(y{i})\n" for i in range(40))
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance\n# with the License.\n'
    gpl = ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as "
           "published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n */\n")
    mit = ('Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated '
           'documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, '
           "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to "
           "do so, subject to the following conditions:\n\nThe above copyright notice shall be included.\n")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:\n{}")
    neither = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
               "   this software without specific prior written permission.\n")
    rows = [("a/x.py", apache + code), ("b/x.c", gpl.format("", 3) + code), ("c/x.c", gpl.format("", 2) + code), ("d/x.c", gpl.format("Lesser ", "2.1") + code),
            ("e/LICENSE", mit), ("e/y.py", code), ("f/LICENSE", bsd.format(neither)), ("g/LICENSE", bsd.format("")), ("h/x.py", "# SPDX-License-Identifier: ISC\n" + code),
            ("i/x.py", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + code), ("j/x.html", "<!-- SPDX-License-Identifier: GPL-2.0+ -->\n"), ("k/x.py", code)]
    got = {r["path"]: (r["licence"], r["origin"]) for r in k.scan(files(spark, rows)).collect()}
    want = {"a/x.py": "Apache-2.0", "b/x.c": "GPL-3.0", "c/x.c": "GPL-2.0", "d/x.c": "LGPL-2.1", "e/LICENSE": "MIT", "f/LICENSE": "BSD-3-Clause",
            "g/LICENSE": None, "h/x.py": "ISC", "i/x.py": "MIT OR Apache-2.0", "j/x.html": "GPL-2.0+", "k/x.py": None}
    assert got == {p: (x, x and "own") for p, x in want.items()} | {"e/y.py": ("MIT", "inherited")}
