"""Notices and inheritance in a small tree."""

import re

from quillon.llm.licenses import TEMPLATES, Templates, scan_licenses, tokens

SCHEMA = "doc_id bigint, path string, text string, license int, dir string"
FILES = [
    (1, "a/LICENSE", "Some project\nReleased under the MIT License.\nAnd more words than that in this file, so that its share is small indeed"),
    (2, "a/b/x.c", "int main"),
    (3, "a/b/c/y.c", "// SPDX-License-Identifier: Apache-2.0\nint main of a file that has many more words than its notice"),
    (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (5, "a/b/c/d/z.c", None),
    (6, "other/q.c", ""),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "a/top.c", "a license of words that is nothing like a notice at all"),
    (8, "a/top.c", "a license of words that is nothing like a notice at all"),
    (9, "root.c", "x" * 50_000),
]


def test_tree(spark):
    df = spark.createDataFrame([(*f, 1, "d") for f in FILES], SCHEMA).repartition(3)
    got = sorted(((r.id, r.own_license, r.license, r.inherited_from, r.is_license_file) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "MIT", None, True), (2, None, "MIT", "a", False), (3, "Apache-2.0", "Apache-2.0", None, False), (4, "GPL-3.0", "GPL-3.0", None, True), (5, None, "GPL-3.0", "a/b/c", False),
        (6, None, None, None, False), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None, False), (8, None, "MIT", "a", False), (8, None, "MIT", "a", False), (9, None, None, None, False)], key=str)
    assert scan_licenses(df.limit(0)).collect() == []


def test_anchors_lose_nothing():
    t = Templates(TEMPLATES, 0.8)
    for _, v in t.vectors:
        assert sum(x * x for w, x in v.items() if w not in t.anchors) < 0.64
    for name, variants in TEMPLATES.items():
        for text in variants:
            assert t.notice(text)[0] == name, text
            assert re.search(t.filter, text)
    assert t.notice("nothing of the kind")[0] is None
    assert tokens("Version 2.0.") == ["version", "2.0"]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice shall be included."
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version."
WITHIN = [
    ("This project is licensed under the MIT License.", "MIT"),
    ("Copyright 2020 Jane Roe. Licensed under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0. See the LICENSE file.", "Apache-2.0"),
    ("many words that say nothing of it " * 9 + "Released under the MIT License. " + "and more of such words " * 9, "MIT"),
    ("prose " * 40 + MIT, "MIT"),
    ("int main\n" + GPL.format(2) + "\nint x", "GPL-2.0"),
    (GPL.format(3), "GPL-3.0"),
    (GPL.format(3).replace("GNU", "GNU Lesser"), "LGPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", "GPL-3.0"),
    ("Some words before it, this text is licensed under CC BY-SA 4.0, and words after it", "CC-BY-SA-4.0"),
    (GPL.format("2.1").replace("GNU", "GNU Lesser"), "LGPL-2.1"),
    ("It is not like the GNU General Public License.", None),
]


def test_notices_within_lines_and_over_them():
    t = Templates(TEMPLATES, 0.8)
    for text, want in WITHIN:
        assert t.notice(text)[0] == want, text


def test_windows_lose_nothing():
    """The windows found by prefix sums are all that have the threshold."""
    t = Templates(TEMPLATES, 0.8)
    for text, _ in WITHIN:
        words = tokens(text)
        got = {(round(s, 9), n, size) for s, n, size in t._windows(words, range(len(t.vectors)))}
        want = set()
        for k, (name, v) in enumerate(t.vectors):
            digits = {w for w in v if any(c.isdigit() for c in w)}
            for size in {min(x, len(words)) for x in t.lengths[k]}:
                for i in range(len(words) - size + 1):
                    window = words[i : i + size]
                    score = sum(x * t._unit(window).get(w, 0.0) for w, x in v.items())
                    if score >= 0.8 and digits <= set(window):
                        want.add((round(score, 9), name, size))
        assert got == want


def test_like_plain_tf_idf():
    """Cosines of whole notices against TF-IDF written out: idf = log((1 + n) / (1 + df)) + 1 over all variants."""
    import math
    from collections import Counter

    t = Templates(TEMPLATES, 0.8)
    variants = [(name, Counter(tokens(x))) for name in TEMPLATES for x in TEMPLATES[name]]
    n = len(variants)
    df = Counter(w for _, words in variants for w in words)
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 1))) + 1

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum((c * idf(w)) ** 2 for w, c in v.items()))
        return sum(c * b[w] * idf(w) ** 2 for w, c in a.items()) / norm(a) / norm(b)

    for text, _ in WITHIN:
        words = tokens(text)
        score, name = t.best(words)
        want = {x: max(cosine(Counter(words), v) for y, v in variants if y == x) for x in TEMPLATES}
        assert abs(score - max(want.values())) < 1e-9 and abs(want[name] - score) < 1e-9


CHANGED = [
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "GPL-3.0"),
    ("Redistribution and use in source and binary forms, with or without modifications, are permitted provided the following conditions are met", "BSD-3-Clause"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is granted", "ISC"),
    ("Licensed under the Apache Licence, Version 2.0 (the \"License\"); you may not use this code except in compliance with the License.", "Apache-2.0"),
]
UNLISTED = ["This work is licensed under the Eclipse Public License 2.0.", "Licensed under the Artistic License 2.0.", "All rights reserved. No part of this work may be copied without permission.", "SPDX-License-Identifier: EPL-2.0", "This is free and unencumbered software released into the public domain.", "Licensed under the Server Side Public License, version 1."]


def test_changed_notices_are_found_and_unlisted_licences_are_not():
    t = Templates(TEMPLATES, 0.8)
    for text, want in CHANGED:
        name, score, _ = t.notice(text)
        assert name == want and 0.8 <= score < 1 - 1e-6, (text, name, score)
    for text in UNLISTED:
        assert t.notice(text)[0] is None, (text, t.notice(text))
