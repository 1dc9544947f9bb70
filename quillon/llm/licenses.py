"""License scan: notices by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

*Notices.*  Each line of a file, each run of neighbouring lines that hold an
anchor word, and each window of words about as long as a template (``AROUND``)
anywhere in the file is a sparse TF-IDF vector over its words; its best cosine
to a template variant at or over ``threshold`` is a notice.  Windows find
notices within longer lines and over line breaks; a window must hold the
template's words with digits, which tell versions apart.  idf comes from the
templates; words that no template has weigh as words of one template, so that
text around a notice lowers the cosine.  Anchors are chosen so that the rest of
any template has a norm below the threshold: a line without any anchor can't
reach it, so that skipping such lines loses nothing.  Likewise a template can
only be reached if those of its words that the file has anywhere have a norm of
the threshold at least; windows are scored exactly where prefix sums allow it.

*Licence files.*  A file with a licence file's name, or of whose words a notice
makes up at least ``share``, speaks for its directory.  Of several in one
directory the best score counts, then the smaller path.

*Inheritance.*  Files without a notice take that of the nearest directory above
them that has one.  Only distinct directories are expanded into their ancestors
and joined by path; the answer is then joined to the files by directory.

Nulls and edges: null or empty texts have no notice; a null path has no
directory and inherits nothing.  Of equal cosines the licence that is first by
name counts.  Repeated rows give as many rows.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import materialise, ship

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def _gnu(kind: str, short: str, version: str, dated: str) -> list[str]:
    """Sentences, file headers and the title of one of the GNU licences."""
    full, exact = f"{kind} Public License", version if "." in version else f"{version}.0"
    return [f"This work is licensed under the GNU {full}, version {version}.", *(f"Licensed under the GNU {full} v{v}." for v in dict.fromkeys((version, exact))), *(f"Licensed under the {short}{v}." for v in (f"v{version}", f" v{version}", f"-{exact}")), _GNU.format(full, version), f"GNU {full} Version {version}, {dated}", f"SPDX-License-Identifier: {short}-{exact}-only", f"SPDX-License-Identifier: {short}-{exact}-or-later"]


def _cc(short: str, name: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Creative Commons {name} 4.0 International Public License", f"SPDX-License-Identifier: CC-{short}-4.0"]


# The customary short notices, file headers and openings of well-known licences.
TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General", "AGPL", "3", "19 November 2007"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": [_BSD.format("1. ", "2. ") + "THIS SOFTWARE IS PROVIDED BY", _BSD.format("", "") + "THIS SOFTWARE IS PROVIDED BY", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", _BSD.format("1. ", "2. ") + "3. " + _NEITHER, _BSD.format("", "") + _NEITHER, "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": _gnu("General", "GPL", "2", "June 1991"),
    "GPL-3.0": _gnu("General", "GPL", "3", "29 June 2007"),
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": _gnu("Lesser General", "LGPL", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser General", "LGPL", "3", "29 June 2007"),
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
# Lengths of the windows as parts of the template's.
AROUND = (0.8, 1.0, 1.25)
PREFERRED = ("license", "licensed", "spdx", "copyright", "gnu", "apache", "cc0", "mozilla", "redistribution", "permitted", "hereby", "granted")
NAMES = r"(?i)^(un)?licen[cs]e([._-].*)?$|^copying([._-].*)?$|^notice([._-].*)?$"
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of all variants, and the anchor words."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        variants = [(name, tokens(t)) for name in sorted(templates) for t in templates[name]]
        df: dict[str, int] = {}
        for _, words in variants:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        n = len(variants)
        self.idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
        self.other = math.log((1 + n) / 2) + 1
        self.vectors = [(name, self._unit(words)) for name, words in variants]
        self.at = {w: k for k, w in enumerate(df)}
        self.weight = np.array([*(self.idf[w] for w in df), self.other])  # by word's number; the last is any other word
        self.parts = np.zeros((len(variants), len(df) + 1))
        for row, (_, v) in zip(self.parts, self.vectors, strict=True):
            row[[self.at[w] for w in v]] = list(v.values())
        self.lengths = [sorted({max(1, round(len(words) * x)) for x in AROUND}) for _, words in variants]
        self.digits = [[self.at[w] for w in set(words) if any(c.isdigit() for c in w)] for _, words in variants]
        anchors: set[str] = set()
        for _, v in self.vectors:
            rest = 1.0 - sum(x * x for w, x in v.items() if w in anchors)
            for w, x in sorted(v.items(), key=lambda i: (i[0] not in PREFERRED, -i[1], i[0])):
                if rest < threshold**2 - 1e-9:
                    break
                if w not in anchors:
                    anchors.add(w)
                    rest -= x * x
        self.anchors = anchors
        words = "|".join(sorted(map(re.escape, anchors)))
        self.filter = rf"(?i)(^|[^a-zA-Z0-9])({words})([^a-zA-Z0-9]|$)"
        self.find = re.compile(rf"(?<![a-zA-Z0-9])(?:{words})(?![a-zA-Z0-9])", re.I)

    def _unit(self, words: list[str]) -> dict[str, float]:
        v: dict[str, float] = {}
        for w in words:
            v[w] = v.get(w, 0.0) + self.idf.get(w, self.other)
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def best(self, words: list[str]) -> tuple[float, str]:
        v = self._unit(words)
        return max(((sum(x * v.get(w, 0.0) for w, x in t.items()), name) for name, t in self.vectors), key=lambda s: (round(s[0], 12), [-ord(c) for c in s[1]]))

    def _windows(self, words: list[str], reach: np.ndarray):
        """(cosine, licence, words) of every window that has the threshold for one of the templates ``reach``."""
        ids = np.array([self.at.get(w, len(self.at)) for w in words])
        weight = self.weight[ids]
        size = np.concatenate([[0.0], np.cumsum(weight * weight)])  # at most the square of the norm, as repeated words add more
        for k in reach:
            part = np.concatenate([[0.0], np.cumsum(self.parts[k][ids] * weight)])
            held = [np.concatenate([[0], np.cumsum(ids == d)]) for d in self.digits[k]]
            name, template = self.vectors[k]
            seen: dict[tuple[str, ...], float] = {}
            for length in dict.fromkeys(min(x, len(words)) for x in self.lengths[k]):
                maybe = part[length:] - part[:-length] >= (self.threshold - 1e-9) * np.sqrt(size[length:] - size[:-length])
                for h in held:
                    maybe &= h[length:] > h[:-length]
                for i in np.flatnonzero(maybe):
                    window = tuple(words[i : i + length])
                    if window not in seen:
                        v = self._unit(list(window))
                        seen[window] = sum(x * v.get(w, 0.0) for w, x in template.items())
                        if seen[window] >= self.threshold:
                            yield seen[window], name, length

    def notice(self, text: str) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the text's words) of the best notice, or (None, 0, 0)."""
        every = tokens(text)
        there = np.zeros(len(self.weight))
        there[[self.at[w] for w in set(every) if w in self.at]] = 1.0
        reach = np.flatnonzero((self.parts**2) @ there >= self.threshold**2 - 1e-9)
        if not len(reach):
            return None, 0.0, 0.0
        lines = re.split(r"[\n\r\x0b\x0c]+", text)
        hit = [i for i, line in enumerate(lines) if self.find.search(line)]
        spans, k = {(i, i) for i in hit}, 0
        while k < len(hit):  # runs of neighbouring lines with anchors
            j = k
            while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1:
                j += 1
            spans.add((hit[k], hit[j]))
            k = j + 1
        found = [(*self.best(words), len(words)) for a, b in sorted(spans) if (words := tokens(" ".join(lines[a : b + 1])))]
        found = [x for x in found if x[0] >= self.threshold] + list(self._windows(every, reach))
        if not found:
            return None, 0.0, 0.0
        score, name, size = min(found, key=lambda x: (-round(x[0], 12), x[1], -x[2]))
        return name, score, size / len(every)


def _scan(templates: dict, threshold: float):
    def run(batches):
        known = Templates(templates, threshold)
        for b in batches:
            for part in tk.slices(b, "text"):
                maybe = pc.fill_null(pc.match_substring_regex(part.column("text"), known.filter), False).to_numpy(zero_copy_only=False)
                names: list = [None] * part.num_rows
                scores, shares = np.zeros(part.num_rows), np.zeros(part.num_rows)
                texts = part.column("text").filter(pa.array(maybe)).to_pylist()
                for i, text in zip(np.flatnonzero(maybe), texts, strict=True):
                    names[i], scores[i], shares[i] = known.notice(text)
                yield pa.record_batch([part.column("id"), part.column("path"), pa.array(names, pa.string()), pa.array(np.round(scores, 9)), pa.array(np.round(shares, 9))], names=["id", "path", "own_license", "own_score", "own_share"])

    return run


def scan_licenses(files: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8, share: float = 0.5, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, path, own_license, own_score, is_license_file, license and inherited_from of every row."""
    ship(files.sparkSession)
    rows = files.select(F.col(id_col).cast("bigint").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scan(templates, threshold), "id bigint, path string, own_license string, own_score double, own_share double")
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/+$", "")
    own = F.col("own_license").isNotNull() & F.col("path").isNotNull()
    found = materialise(found.withColumn("dir", folder).withColumn("is_license_file", F.coalesce(own & ((F.col("own_share") >= share) | name.rlike(NAMES)), F.lit(False))), "notices")
    best = F.min_by(F.struct("own_license", "path"), F.struct(-F.col("own_score"), F.col("path"))).alias("x")
    speaking = materialise(found.where("is_license_file").groupBy("dir").agg(best).select(F.col("dir").alias("up"), F.col("x.own_license").alias("up_license")), "licensed")
    folders = found.where("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = folders.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("up")).distinct()
    nearest = above.join(speaking, "up").groupBy("dir").agg(F.max_by(F.struct("up", "up_license"), F.length("up")).alias("y"))
    nearest = materialise(nearest.select(F.col("dir").alias("of"), F.col("y.up").alias("up"), F.col("y.up_license").alias("up_license")), "nearest")
    out = found.join(nearest, (F.col("dir") == F.col("of")) & F.col("own_license").isNull(), "left")
    return out.select("id", "path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "up_license").alias("license"), F.col("up").alias("inherited_from"))
