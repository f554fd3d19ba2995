import random
import re

from lanewright.llm import license_scan as scan
from lanewright.llm import queries

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(rows, templates):
    """Every window of every notice's step, by exact containment; then the best
    of those that share more than half of the lesser one's positions."""
    notices = {name: set(shingles(t)) for name, t in templates.items()}
    out = set()
    for i, t in rows:
        s = shingles(t)
        found = set()
        for name, want in notices.items():
            if want and any(x in want for x in s):
                step = 2
                while step < 1.5 * len(want):
                    step *= 2
                for a in range(0, len(s), step):
                    share = len(want & set(s[a : a + 2 * step])) / len(want)
                    if share >= 0.8:
                        found.add((len(want) * (2 * share - 1), share, name, frozenset(k for k in range(a, min(len(s), a + 2 * step)) if s[k] in want)))
        kept = []
        for one in sorted(found, key=lambda f: (-f[0], -f[1], min(f[3]), list(templates).index(f[2]))):
            if all(len(one[3] & k[3]) <= 0.5 * min(len(one[3]), len(k[3])) for k in kept):
                kept.append(one)
                out.add((i, one[2]))
    return out


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert {(r.doc_id, r.license) for r in scan.licences(documents).collect()} == brute(rows, scan.TEMPLATES)


def test_edited_notices_in_long_texts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        name = rng.choice(sorted(scan.TEMPLATES))
        words = scan.TEMPLATES[name].split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"edit{k}"
        noise = lambda: " ".join(f"n{rng.randrange(500)}" for _ in range(rng.randrange(0, 400)))
        rows.append((k, f"{noise()} {' '.join(words).upper() if k % 5 == 0 else ' '.join(words)} {noise()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = scan.licences(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == brute(rows, scan.TEMPLATES)
    texts = dict(rows)
    for r in got:
        part = WORD.findall(texts[r.doc_id].translate(LOWER))[r.start_word : r.end_word]
        want = set(shingles(scan.TEMPLATES[r.license]))
        assert abs(len(want & set(shingles(" ".join(part)))) / len(want) - r.containment) < 1e-9


# Openings of real files, with marks, line breaks and names that the templates do not have.
HEADERS = {
    "BSD-2-Clause": """ * Copyright (c) 2011, A. Writer
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
 * ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED""",
    "BSD-3-Clause": """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are met:
//   * Redistributions of source code must retain the above copyright notice,
//     this list of conditions and the following disclaimer.
//   * Redistributions in binary form must reproduce the above copyright notice,
//     this list of conditions and the following disclaimer in the documentation
//     and/or other materials provided with the distribution.
//   * Neither the name of Example Inc. nor the names of its contributors may be
//     used to endorse or promote products derived from this software without
//     specific prior written permission.
// THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS""",
    "GPL-2.0-or-later": """# mytool - does things. This program is free software; you can redistribute it
# and/or modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version 2
# of the License, or (at your option) any later version.
# This program is distributed in the hope that it will be useful,""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. This program is distributed in the hope""",
    "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. See the licence for more details""",
    "LGPL-2.1-or-later": """ This library is free software; you can redistribute it and/or
 modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either
 version 2.1 of the License, or (at your option) any later version.
 This library is distributed in the hope that it will be useful""",
    "GPL-2.0-only": """/* This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation. */""",
}


def test_versions_of_a_licence_are_told_apart(spark):
    names = sorted(HEADERS)
    noise = " ".join(f"n{k}" for k in range(150))
    rows = [(k, HEADERS[n]) for k, n in enumerate(names)] + [(100 + k, f"{noise} {HEADERS[n]} {noise}") for k, n in enumerate(names)]
    rows += [(200, HEADERS["BSD-2-Clause"] + noise + HEADERS["GPL-3.0-or-later"])]
    got = {}
    for r in scan.licences(spark.createDataFrame(rows, "doc_id long, text string"), phrases=scan.PHRASES).collect():
        got.setdefault(r.doc_id, []).append(re.sub(" (numbered )?(text|notice)$", "", r.license))
    assert {k: sorted(v) for k, v in got.items()} == {k: [n] for k, n in enumerate(names)} | {100 + k: [n] for k, n in enumerate(names)} | {200: ["BSD-2-Clause", "GPL-3.0-or-later"]}


def test_notice_with_words_put_in_between(spark):
    """At every offset; half a step of other words stand in the middle."""
    words = scan.TEMPLATES["ISC text"].split()
    rows = [(k, " ".join([f"a{j}" for j in range(k)] + words[:18] + [f"b{j}" for j in range(14)] + words[18:] + [f"c{j}" for j in range(90)])) for k in range(70)]
    assert {r.doc_id for r in scan.licences(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'ISC text'").collect()} == set(range(70))


def test_many_templates(spark):
    templates = {f"t{k}": " ".join(f"v{k}w{j}" for j in range(6 + k % 5)) for k in range(60)} | {"short": "too short"}
    rows = [(k, "x y z " + templates[f"t{k}"] + " x y z") for k in range(60)]
    got = scan.licences(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()
    assert {(r.doc_id, r.license) for r in got} == {(k, f"t{k}") for k in range(60)}


def test_edge_rows(edge):
    assert scan.licences(edge).count() == 0


def test_nothing(empty, edge):
    assert scan.licences(empty).count() == 0 and scan.licences(edge, templates={}).count() == 0


PLANTED = ("All rights reserved.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.")


def test_planted_lines_are_found(spark, sf_dir):
    """Against the lines themselves, not the operator's rule."""
    sf = sf_dir.replace("0.001", "0.01")
    names = dict(zip(PLANTED, ("All rights reserved line", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "GPL-3.0"), strict=True))
    want = {(r.doc_id, names[x]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in (r.text or "").split("\n") if x in names}
    assert {n for _, n in want} == set(names.values())
    assert {(r.doc_id, r.license) for r in queries.op9_license_scan(spark, sf).collect()} >= want


def test_phrases(spark):
    tag = "SPDX-License-Identifier: "
    rows = [
        (1, "All rights reserved."), (2, "x ALL RIGHTS\nRESERVED y all rights reserved"), (3, "all rights were reserved"), (4, "all rights"), (5, "reserved."), (6, f"// {tag}MIT"),
        (7, f"# {tag}GPL-2.0-or-later\n"), (8, f"{tag}Own-1.0 text"), (9, f"{tag}MIT a b {tag}Apache-2.0"), (10, "rights reserved All"), (11, "please read: too short"),
    ]
    got = scan.licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), templates={"short": "too short"}, phrases=scan.PHRASES).collect()
    assert {(r.doc_id, r.license, r.start_word, r.end_word) for r in got} == {
        (1, "All rights reserved line", 0, 3), (2, "All rights reserved line", 1, 4), (6, "MIT tag", 0, 4), (7, "GPL-2.0-or-later tag", 0, 8), (8, "SPDX tag", 0, 3),
        (9, "MIT tag", 0, 4), (9, "Apache-2.0 tag", 6, 12), (11, "short", 2, 4),
    }
    assert all(r.containment == 1 for r in got)
