import pytest

from penprint.llm import license_scan as L

INDEX = L.Templates(L.TEMPLATES)


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Copyright 2024 Someone. All rights reserved.", "Proprietary"),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("words before\nReleased under the MIT License.\nwords after, many of them, as in any text", "MIT"), ("", None), ("The driving licence of the man was old.", None), ("no such words", None),
    ("x " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n" + "y " * 50_000, "CC-BY-NC-4.0"), ("He went home. Released under the MIT License. She stayed there for many years and wrote letters.", "MIT"),
])
def test_scan(text, want):
    assert L.scan_text(INDEX, text, L.THRESHOLD)[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("Copyright 2024 Someone. All rights\nreserved.", "Proprietary"), ("Permission is\nhereby granted, free\nof charge, to any\nperson obtaining a\ncopy of this software", "MIT"),
    ("word here\n" * 600 + "Permission is\nhereby granted, free\nof charge, to any\nperson obtaining a\ncopy of this software\nand associated documentation\nfiles, to deal in the\nSoftware without restriction\n" + "more there\n" * 600, "MIT"),
    ("Redistribution and\nuse in source and\nbinary forms, with or\nwithout modification, are permitted", "BSD-3-Clause"),
])
def test_notices_broken_by_lines(text, want):
    assert L.scan_text(INDEX, text, L.THRESHOLD)[0] == want


def test_windows_hold_every_stretch_at_the_threshold():
    text = "one two mit license released under the mit license under the MIT License. " * 3 + "Permission is hereby granted, free of charge, to the mit mit mit person"
    low = text.lower()
    at = [(m.start(), m.end()) for m in L._TERM.finditer(low)]
    for i, n in enumerate(INDEX.words):
        n = min(n, len(at))
        got = set(INDEX.windows(text, L.THRESHOLD))
        for k in range(len(at) - n + 1):
            span = low[at[k][0]:at[k + n - 1][1]]
            c = L.Counter(L.terms(span))
            norm = sum((m * INDEX.idf.get(t, INDEX.rare)) ** 2 for t, m in c.items()) ** .5
            cosine = sum(m * INDEX.idf[t] * x for t, m in c.items() for j, x in INDEX.posts.get(t, ()) if j == i) / norm
            assert cosine < L.THRESHOLD or span in got


def brute(files):
    """Own licences by scanning; the nearest licence file above by walking up."""
    own = {}
    clean = {}
    for i, path, text in files:
        parts = [p for p in (path or "").split("/") if p not in ("", ".")]
        lic, score, share = L.scan_text(INDEX, text or "", L.THRESHOLD)
        speaks = bool(lic) and (share >= L.MOSTLY or bool(L._FILE.match(parts[-1] if parts else "")))
        own[i], clean[i] = (lic, score, speaks), parts[:-1]
    out = {}
    for i, _, _ in files:
        lic, score, speaks = own[i]
        if lic:
            out[i] = (lic, "file" if speaks else "header", "/".join(clean[i]))
            continue
        out[i] = (None, None, None)
        for n in range(len(clean[i]), -1, -1):
            here = [(-own[j][1], own[j][0]) for j in own if own[j][2] and clean[j] == clean[i][:n]]
            if here:
                out[i] = (min(here)[1], "inherited", "/".join(clean[i][:n]))
                break
    return out


@pytest.mark.parametrize("bound", [0, 1000])
def test_inheritance_equals_walking_up(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_DIRECTORIES", bound)
    mit, gpl, body = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "some text " * 20
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", body), (3, "a/b/COPYING.txt", body + "\n" + gpl), (4, "a/b/y.py", None), (5, "a/z.py", body + mit), (6, "q/x.py", body), (7, "/./a//b/c/d/e/f.py", ""), (8, None, body), (9, "ab/x", body),
        (10, "a/b/license-extra", mit + " and more words than that, so many that it is less alike"), (11, "t/LICENSE", gpl), (12, "t/COPYING", gpl), (13, "t/x", body), (14, "a/b", body),
    ]
    df = spark.createDataFrame([(*f, "n", 1) for f in files], "doc_id long, path string, text string, license string, dir int")
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in L.scan_licenses(df).collect()}
    assert got == brute(files)
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[14] == ("MIT", "inherited", "a")


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a/x", "Released under the MIT License.")] * 2 + [(3, "a/y", "w")], "doc_id long, path string, text string")
    assert sorted((r.doc_id or 0, r.license, r.family, r.origin) for r in L.scan_licenses(df).collect()) == [(0, "MIT", "permissive", "file")] * 2 + [(3, "MIT", "permissive", "inherited")]
    assert L.scan_licenses(df.limit(0)).collect() == []
