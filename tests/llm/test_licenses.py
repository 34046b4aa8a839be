"""Labels, places and scores of the license scan against plain loops over every word of every text."""

from __future__ import annotations

import math
import re

import pytest

from foragelake.llm import licenses as L

SF = "/root/testdata/sf0.01"
GPL3 = """/* This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
 * License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. */"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction ... Copyright Someone ...
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 3. Neither the name of Some Company nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
CRAFTED = [
    (GPL3, {"gpl", "gpl-3.0"}),
    (GPL3.replace("version 3", "version 2"), {"gpl", "gpl-2.0"}),
    (MIT, {"mit-text"}),
    ("\n".join(reversed(MIT.split("..."))), set()),
    (BSD3, {"bsd", "bsd-3-clause"}),
    (BSD3.split("3.")[0], {"bsd"}),
    ("Neither the name of X. contributors may be used to endorse or promote products", set()),
    ("under the Mozilla Public License, v. 2.0. See the MIT License, the Apache License and CC BY", {"mpl-2.0", "mit", "apache", "cc-by"}),
    ("CC BY-NC 4.0, CC BY-SA 4.0, CC BY 4.0", {"cc-by", "cc-by-nc", "cc-by-sa", "cc-by-4.0"}),
    ("MİT License, mit lIcense, Apache LiKense, apache license, gnu General-public_license", {"mit", "gpl"}),
    ("license mit mit license", {"mit"}),
    ("Copyright 2020 A. All rights reserved.", {"proprietary"}),
    (None, set()), ("", set()), (" -- ", set()), ("license", set()),
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts):
    """(n_words, base places, base labels, labels, score) of each text."""
    split = [words(t) for t in texts]
    count = {}
    for w in split:
        for x in set(w):
            count[x] = count.get(x, 0) + 1

    def idf(w):
        return math.log((1 + len(texts)) / (1 + count.get(w, 0))) + 1

    out = []
    for w in split:
        base, labels, score = [], {}, 0.0
        for notice in L.NOTICES:
            at, best, whole = -1, 0.0, 0.0
            for i in range(len(notice.parts)):
                part = notice.words(i)
                starts = [s for s in range(len(w)) if all(s + k < len(w) and w[s + k] == x for k, (x, m) in enumerate(part) if m)]
                # A part may begin before the text does, where only words that aren't mandatory would stand.
                lead = next(k for k, (_, m) in enumerate(part) if m)
                starts = [s for s in range(-lead, 0) if all(0 <= s + k < len(w) and w[s + k] == x for k, (x, m) in enumerate(part) if m)] + starts
                shares = {s: sum(idf(x) for k, (x, _) in enumerate(part) if 0 <= s + k < len(w) and w[s + k] == x) for s in starts}
                later = [s for s in starts if s > at] if i else starts
                if not later:
                    best = None
                    break
                at = min(later)
                best += max(shares.values())
                whole += sum(idf(x) for x, _ in part)
                if notice.base:
                    base += starts
            if best is not None:
                labels[notice.label] = labels.get(notice.label, False) or notice.base
                score = max(score, best / whole)
        out.append((len(w), sorted(base), ",".join(sorted(x for x, b in labels.items() if b)), ",".join(sorted(labels)), score))
    return out


def test_crafted_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CRAFTED)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    wanted = plain([t for t, _ in CRAFTED])
    for i, (_, labels) in enumerate(CRAFTED):
        assert set(filter(None, got[i]["labels"].split(","))) == labels
        n, base, base_labels, joined, score = wanted[i]
        assert (got[i]["n_words"], sorted(p["start"] for p in got[i]["base_places"]), got[i]["base_labels"], got[i]["labels"]) == (n, base, base_labels, joined)
        assert got[i]["score"] == pytest.approx(score)


def test_whole_table(spark):
    """Most files with a base phrase have a label beside it, which the index alone finds."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows]), strict=True))
    more = 0
    for r in L.op10_license_scan(spark, SF).collect():
        n, base, base_labels, labels, score = wanted[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["base_labels"], r["labels"]) == (n, len(base), base_labels, labels)
        assert (r["first_word"], r["last_word"]) == ((base[0], base[-1]) if base else (None, None))
        assert r["score"] == pytest.approx(score)
        more += labels != base_labels
    assert more > 10
