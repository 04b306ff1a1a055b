"""Operators made of SQL functions: fingerprints, license scans, mixing."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ringside.llm import fingerprint, licenses, mixing


def shingles(text, size=5):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("rows_in_bucket", [1, 7, 1000])  # null and 77 fill many buckets, or one
def test_fingerprints(spark, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", rows_in_bucket)
    r = random.Random(rows_in_bucket)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本"]
    base = [r.choice(vocab) for _ in range(40)]
    texts = [None, "", " ", "one", "a b c d e"] + [" ".join(base[: r.randint(5, 40)]) for _ in range(30)] + [" ".join(r.choice(vocab) for _ in range(r.randint(1, 600))) for _ in range(20)]
    ids = r.sample(range(-50, 10_000), len(texts) - 1) + [None]
    rows = list(zip(ids, texts)) + [(ids[7], texts[8])] + [(r.choice([None, 77]), " ".join(r.choices(vocab, k=12))) for _ in range(60)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fingerprint string, bucket int").repartition(3)
    got = fingerprint.fingerprints(df).collect()
    hashes = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]], x[1]))
    assert len(got) == len(order)
    found = {(x["doc_id"], x["n_chars"], x["edited_sha256"]): x for x in got}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x = found[d, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        a, e, n = shingles(t), shingles(edited), shingles(following)
        if len(a | e) <= fingerprint.K:
            assert abs(x["near_edited"] - jaccard(a, e)) < 1e-9
        else:
            assert abs(x["near_edited"] - jaccard(a, e)) < 0.2
        assert abs(x["near_next"] - jaccard(a, n)) < (1e-9 if len(a | n) <= fingerprint.K else 0.2)
        assert abs(x["distinct_shingles"] - len(a)) <= 0.4 * len(a)
        assert abs(x["in_edited"] - (len(a & e) / len(a) if a else 1.0)) < (1e-9 if len(a | e) <= fingerprint.K else 0.4)
        assert len(x["fingerprint"]) == 16 * min(len(a), fingerprint.K)
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df.filter("text = 'one'")).first()["near_next"] == 1.0


def test_sketches_merge(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), " ".join(str(r.randint(0, 3000)) for _ in range(r.randint(0, 300)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("s", fingerprint.sketch(F.col("text")))
    for x in fingerprint.merge_parts(df, "k", "s").collect():
        own = sorted({h for y in df.filter(F.col("k").eqNullSafe(x["k"])).collect() for h in y["s"]})
        assert x["s"] == own[: fingerprint.K]
    pair = spark.createDataFrame([(" ".join(map(str, range(3000))), " ".join(map(str, range(1000))))], "a string, b string")
    c = pair.select(fingerprint.containment(fingerprint.sketch(F.col("b")), fingerprint.sketch(F.col("a"))), fingerprint.containment(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).first()
    assert c[0] > 0.75 and abs(c[1] - 1 / 3) < 0.15


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(None, None), ("", None), ("Released under the MIT License.", "MIT"), (f"x. {mit}\nother text here. {notice}", "MIT"), (f"{notice} {mit}", None), ("RELEASED under, the: MIT license", None),
            ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "Apache-2.0"), ("Text. Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"), ("été released under the MIT License", None)]
    df = spark.createDataFrame([(t, w, 1) for t, w in rows], "text string, want string, licenses int")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) and all(r["license"] == r["want"] for r in got)
    assert next(r["licenses"] for r in got if r["license"] == "GPL-3.0-only") == "CC-BY-NC-4.0 GPL-3.0-only"
    assert licenses.scan(df.limit(0)).count() == 0


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


def test_wrapped_licenses(spark):
    commented = "".join(f" * {line}".rstrip() + "\n" for line in BSD.splitlines())
    rows = [(MIT, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (BSD, "BSD-2-Clause"), (BSD + NAMES, "BSD-3-Clause"), (f"/*\n{commented} */", "BSD-2-Clause"), (GPL, "GPL-3.0-or-later"),
            (" ".join(GPL.split()), "GPL-3.0-or-later"), (GPL.replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0-or-later"),
            ("A line before\nReleased under the MIT License\nand a line after", "MIT"), ("A line before\n" + MIT.split("\n\n", 1)[1], "MIT"),
            ("Released under\n\nthe MIT License", None), ("Released under. The MIT License", None), ("not released under\nthe MIT License", None), (MIT.replace("charge", "no charge"), None)]
    df = spark.createDataFrame(rows, "text string, want string")
    got = licenses.scan(df).collect()
    assert [r["license"] for r in got] == [w for _, w in rows]
    assert got[3]["sentence_ids"] == "|bsd-grant||bsd-source||bsd-binary||bsd-names|"


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""

LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""


def test_license_variants(spark):
    hashes = lambda t: "".join(f"# {line}".rstrip() + "\n" for line in t.splitlines())
    rows = [
        ("This file is released under the MIT license.", "MIT"), ("This project is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This software is distributed under the\nterms of the MIT License.", "MIT"),
        ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("# spdx-license-identifier:   BSD-3-Clause", "BSD-3-Clause"),
        ("SPDX-License-Identifier: Unknown-1.0", None), (APACHE, "Apache-2.0"), (hashes(APACHE), "Apache-2.0"), (hashes(MIT), "MIT"), (LGPL, "LGPL-2.1-or-later"), (GPL.replace("General", "Affero General"), "AGPL-3.0-or-later"),
        (GPL.replace("either version 3 of the License, or\n(at your option) any later version", "version 3 of the License"), "GPL-3.0-only"), (BSD + NAMES.replace("the copyright holder", "Some Company, Inc"), "BSD-3-Clause"),
        (" ".join(MIT.split("\n\n", 1)[1].split()), "MIT"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0-only"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"), ("Apache License\nVersion 2.0, January 2004\n\nTerms", "Apache-2.0"),
        ("It was licensed under the MIT license", None), ("This file is not released under the MIT license", None),
    ]
    got = licenses.scan(spark.createDataFrame([(t, w) for t, w in rows], "text string, want string")).collect()
    assert [(r["text"], r["license"]) for r in got] == rows


def brute_scan(text):
    """The same by loops: pieces, one form, the longest known sentence at each piece, rules as subsequences."""
    low = re.sub(r"(spdx-license-identifier)[ \t]*:", r"\1", "".join(c.lower() if c.isascii() else c for c in text or ""))
    low = re.sub(r"([.!?;:])[\x20\x09-\x0d]+", r"\1\n\n", low)
    lines = [" ".join(re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", line).split(" ")).strip() for line in low.split("\n")]
    lines = [" ".join(x for x in line.split(" ") if x) for line in lines]
    paragraphs, n = [[]], 0
    for line in lines:
        if line:
            paragraphs[-1].append(line)
            n += 1
        else:
            paragraphs.append([])
    ids = []
    for par in paragraphs:
        i = 0
        while i < len(par):
            for j in range(len(par), i, -1):
                whole = " ".join(par[i:j])
                for varying, form in licenses.FORMS:
                    whole = re.sub("^" + varying.replace("_", " "), form.replace("$1", r"\1"), whole)
                known = [k for k, v in licenses.SENTENCES.items() if v == whole]
                if known:
                    ids.append(known[-1])
                    i = j
                    break
            else:
                i += 1
    hits = []
    for name, rule in licenses.RULES:
        rest = iter(ids)
        if all(x in rest for x in rule):
            hits.append(name)
    return n, "".join(f"|{i}|" for i in ids), hits[0] if hits else None, " ".join(sorted(set(hits)))


def test_scans_equal_brute_force(spark):
    r = random.Random(12)
    whole = [MIT, BSD, BSD + NAMES, GPL, LGPL, APACHE, None, "", "\n\n", "é. " * 40]
    parts = [s for s in licenses.SENTENCES.values()] + ["some other words", "Released under the MIT License", "SPDX-License-Identifier: ISC"]
    made = whole + [r.choice([" ", "\n", ". ", "\n\n", ";\n"]).join(r.choices(parts, k=r.randint(1, 9))) for _ in range(150)] + ["|".join(parts) * 3, ("\n".join(parts) + "\n") * 20]
    got = licenses.scan(spark.createDataFrame([(t, "x", i) for i, t in enumerate(made)], "text string, __scan string, i int")).orderBy("i").collect()
    for row, text in zip(got, made, strict=True):
        assert (row["n_sentences"], row["sentence_ids"], row["license"], row["licenses"]) == brute_scan(text)
        assert row["__scan"] == "x"


def test_every_rule_can_match(spark):
    """The sentences of each rule, in order, give its license among those found; alone they come first but for a more specific rule of their own."""
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert all(any(sign.replace("_", " ") in f" {s} " for sign in licenses._SIGNS) for s in licenses.SENTENCES.values())
    rows = [(name, ".\n".join(licenses.SENTENCES[i] for i in rule).replace("spdx license identifier", "SPDX-License-Identifier:"), "".join(f"|{i}|" for i in rule)) for name, rule in licenses.RULES]
    for r in licenses.scan(spark.createDataFrame(rows, "want string, text string, ids string")).collect():
        assert r["sentence_ids"] == r["ids"] and r["license"] == r["want"]
    assert {i for _, rule in licenses.RULES for i in rule} | {"apache-copy"} == set(licenses.SENTENCES)


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: float(cap * sizes[s]) for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 40, 41, 42]))), s) for i, s in enumerate(r.choices(["a", "b", "c", "d", "e", "é", None], [400, 3, 50, 1, 30, 20, 30], k=2000))]
    rows += [(5000, None, "zero"), (5001, "", "zero"), (None, "x y", "a"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, source string, size int").repartition(3)
    plan = mixing.plan(df).cache()
    assert plan.count() == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    taken = {}
    for x in plan.collect():
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6 and 0 <= x["copies"] <= 3
        taken[x["source"]] = taken.get(x["source"], 0) + x["size"] * x["copies"]
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] + 90 for s in sizes)
    assert sorted((x["doc_id"] or -1, x["copies"]) for x in plan.collect()) == sorted((x["doc_id"] or -1, x["copies"]) for x in mixing.plan(df.repartition(5)).collect())
    out = mixing.emit(plan)
    assert out.count() == plan.agg(F.sum("copies")).first()[0] and out.columns == ["doc_id", "text", "source"]
    assert mixing.plan(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", 5, 6, "x")], "doc_id long, text string, source string, size int, __size int, __copy string")
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and mixed.collect() == clash.collect()
