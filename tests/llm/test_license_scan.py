import math
import re
from collections import Counter

from groundwork.llm.license_scan import TEMPLATES, scan_licenses

APACHE = "Licensed under the Apache License, Version 2.0."


def brute(files, threshold=0.6):
    token = lambda t: re.findall("[a-z0-9]+", t.lower())
    vocab = {w for _, t in TEMPLATES for w in token(t)}
    real = [(p, t or "") for p, t in files if p is not None]
    n, df = len(real), Counter(w for _, t in real for w in set(token(t)) & vocab)
    idf = lambda w: math.log((n + 1.0) / (df[w] + 1.0)) + 1.0
    vec = lambda t: {w: c * idf(w) for w, c in Counter(token(t)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    given = [(name, vec(t)) for name, t in TEMPLATES]

    def best(part, line=False):
        v = vec(part)
        out = {re.sub(r"(-only|-or-later|\+)$", "", t): 1.0 for t in re.findall(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)", part)[:1] if line}
        for name, g in given:
            s = round(sum(x * g.get(w, 0) for w, x in v.items()) / max(1e-12, length(v) * length(g)), 6)
            if s >= threshold:
                out[name] = max(s, out.get(name, 0))
        return out

    own, whole = {}, {}
    for p, t in real:
        lines = t.split("\n")
        for i, part in enumerate(lines + re.split(r"\n[ \t\r]*\n", t) + [t]):
            for name, s in best(part, i < len(lines)).items():
                own.setdefault(p, {})[name] = max(s, own.get(p, {}).get(name, 0))
        if best(t):
            whole[p] = True
    pick = {p: min((-s, name) for name, s in found.items()) for p, found in own.items()}
    folder = lambda p: p.rpartition("/")[0]
    law = {}
    for p, (s, name) in pick.items():
        if p in whole or re.search(r"(?i)^(licen[cs]e|copying|notice)(\.(txt|md|rst))?$", p.rpartition("/")[2]):
            law[folder(p)] = min(law.get(folder(p), (1, "", "")), (s, p, name))
    out = []
    for p, _ in files:
        if p in pick:
            out.append((p, pick[p][1], -pick[p][0], "own", p))
            continue
        at = folder(p) if p is not None else None
        while at and at not in law:
            at = folder(at)
        if p is not None and at in law:
            s, source, name = law[at]
            out.append((p, name, -s, "inherited", source))
        else:
            out.append((p, None, None, None, None))
    return out


def test_against_brute_force(spark):
    body = "one two three the of license\n"
    files = [
        ("a/LICENSE", TEMPLATES[16][1] + "\nThe above notice shall be included."),
        ("a/b/x.txt", body),
        ("a/b/c/y.txt", body + APACHE),
        ("a/b/c/z.txt", body),
        ("a/b/d/copy", APACHE),
        ("a/b/d/e/f", ""),
        ("a/b/d/e/g", None),
        ("top.txt", body),
        ("COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("q/r/s", body * 50),
        ("q/t", "Released under the MIT License.\n\n" + body * 40),
        ("ab/x", "x"),
        ("q/t2", "released under\tthe MIT license!"),
        ("q/t2", "released under\tthe MIT license!"),
        ("spdx/a.py", "# SPDX-License-Identifier: GPL-2.0-only\n" + body),
        ("spdx/b.rs", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nfn main() {}"),
        ("spdx/c.c", "SPDX-License-Identifier: \n Zlib and the spdx file"),
        ("spdx/d.c", "/* SPDX-License-Identifier: Zlib */"),
        (None, APACHE),
        ("w/long", ("word " * 20_000) + "\n" + TEMPLATES[3][1] + "\n" + ("word " * 20_000)),
    ]
    df = spark.createDataFrame([(p, t, "x", "y") for p, t in files], "path string, text string, folder string, score string")
    got = sorted((tuple(r) for r in scan_licenses(df).collect()), key=repr)
    assert got == sorted(brute(files), key=repr)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "path string, text string")
    found = scan_licenses(df)
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_versions_are_told_apart(spark):
    header = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    files = [("a/gpl2.c", header.format("program", "General Public License", "2")), ("a/gpl3.c", header.format("program", "General Public License", "3")), ("b/lgpl21.c", header.format("library", "Lesser General Public License", "2.1")), ("b/lgpl3.c", header.format("library", "Lesser General Public License", "3"))]
    found = {r["path"]: r["license_id"] for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {"a/gpl2.c": "GPL-2.0", "a/gpl3.c": "GPL-3.0", "b/lgpl21.c": "LGPL-2.1", "b/lgpl3.c": "LGPL-3.0"}


def test_families_are_told_apart(spark):
    """Headers and texts as they are written, each with the name that it should have."""
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    clauses = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
    )
    third = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.'
    copyright_ = "Copyright (c) 2024, Somebody Else\nAll rights reserved.\n\n"
    want = {
        "agpl/or-later.c": ("AGPL-3.0", header.format("Affero General Public License")),
        "lgpl/program.c": ("LGPL-3.0", header.format("Lesser General Public License")),
        "gpl/three.c": ("GPL-3.0", header.format("General Public License")),
        "gpl/two-only.c": ("GPL-2.0", gpl2),
        "bsd2/titled": ("BSD-2-Clause", "BSD 2-Clause License\n\n" + copyright_ + clauses + end),
        "bsd2/plain": ("BSD-2-Clause", copyright_ + clauses + end),
        "bsd3/titled": ("BSD-3-Clause", "BSD 3-Clause License\n\n" + copyright_ + clauses + third + end),
        "bsd3/plain": ("BSD-3-Clause", copyright_ + clauses + third + end),
        "cc/sa": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        "cc/by": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        "cc/short": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        "cc/nc": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        "tag/mit": ("MIT", "# SPDX-License-Identifier: MIT"),
        "tag/later": ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    }
    rows = [(p, t) for p, (_, t) in want.items()] + [(f"prose/{i}", f"A text number {i} about software, work and the terms of life.") for i in range(50)]
    found = {r["path"]: (r["license_id"], r["origin"]) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: found[p] for p in want} == {p: (name, "own") for p, (name, _) in want.items()}
    assert all(found[p] == (None, None) for p, _ in rows if p.startswith("prose"))
