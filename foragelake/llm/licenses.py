"""License scans by a positional rare-token index, with DataFrame functions only.

Licence notices are templates: word sequences in parts, with mandatory key phrases. Every template word is in a positional
index (word -> template part and place in it), and the document frequencies of these words over the whole corpus give
each an IDF.

1. A file's licence words are put in order of IDF, the highest first, and looked up in the index.
2. For each template part whose mandatory words the file has, the postings are intersected by relative position, the
   file's rarest words first: every occurrence of a word proposes where the part would begin, and only beginnings that
   all its mandatory words propose are left.
3. There the mandatory key phrases are verified word for word. A notice counts when all its parts are found, in order,
   with any text between them; the IDF of the words that stand in place says how much of the notice is there.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import table

#: Everything that is no word character: words are runs of digits, ASCII letters and non-ASCII characters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The one character outside ASCII whose lower case is in it, and a word character that takes its place.
KELVIN, OHM = "\u212a", "\u2126"


@dataclass(frozen=True)
class Notice:
    """A label and the parts of a notice, in order; key phrases, all of them mandatory, stand in brackets.

    The notices with `base` are the fixed phrases.
    """

    label: str
    parts: tuple[str, ...]
    base: bool = False

    def words(self, part: int) -> list[tuple[str, bool]]:
        """(word, mandatory) of a part."""
        out, inside = [], False
        for w in self.parts[part].replace("[", " [ ").replace("]", " ] ").split():
            if w in "[]":
                inside = w == "["
            else:
                out.append((w, inside))
        return out


_GRANT = "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the software without restriction"
_FORMS = "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"
_GNU = "it under the terms of the [gnu {} public license] as published by the free software foundation"

NOTICES = (
    # The base phrases.
    Notice("gpl", ("[gnu general public license]",), base=True),
    Notice("apache", ("[apache license]",), base=True),
    Notice("cc-by", ("[cc by]",), base=True),
    Notice("mit", ("[mit license]",), base=True),
    # Short notices with a version, and the texts and headers that files carry.
    Notice("gpl-2.0", ("licensed under the [gnu general public license version 2]",)),
    Notice("gpl-3.0", ("licensed under the [gnu general public license version 3]",)),
    Notice("gpl-2.0", (_GNU.format("general"), "[version 2 of the license] or at your option any later version")),
    Notice("gpl-3.0", (_GNU.format("general"), "[version 3 of the license] or at your option any later version")),
    Notice("lgpl", (_GNU.format("lesser general"),)),
    Notice("agpl", (_GNU.format("affero general"),)),
    Notice("apache-2.0", ("licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license",)),
    Notice("mit-text", (_GRANT, "[the above copyright notice and this permission notice shall be included] in all copies or substantial portions of the software")),
    Notice("bsd", (_FORMS, "redistributions of source code must retain the [above copyright notice this list of conditions] and the following disclaimer")),
    Notice("bsd-3-clause", (_FORMS, "[neither the name of]", "[contributors may be used to endorse or promote products] derived from this software without specific prior written permission")),
    Notice("isc", ("[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted",)),
    Notice("mpl-2.0", ("this source code form is subject to the terms of the [mozilla public license v 2 0]",)),
    Notice("epl", ("made available under the terms of the [eclipse public license]",)),
    Notice("cc-by-nc", ("licensed under [cc by nc]",)),
    Notice("cc-by-nd", ("licensed under [cc by nd]",)),
    Notice("cc-by-sa", ("licensed under [cc by sa]",)),
    Notice("cc-by-4.0", ("licensed under [cc by 4 0]",)),
    Notice("cc-by", ("this work is licensed under the [creative commons attribution] 4 0 international license",)),
    Notice("cc0", ("[cc0 1 0] universal public domain dedication",)),
    Notice("unlicense", ("this is [free and unencumbered software released into the public domain]",)),
    Notice("proprietary", ("copyright [all rights reserved]",)),
)


def pieces(text: Column) -> Column:
    """The words of a text, with A-Z as a-z, and an empty piece before or behind them where a break stands there.

    Letters outside ASCII get their lower case too: no template word holds one, so this changes neither counts nor finds.
    """
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OHM))), BREAKS)


def _vocabulary(notices: tuple[Notice, ...]) -> list[str]:
    return sorted({w for n in notices for i in range(len(n.parts)) for w, _ in n.words(i)})


def _literal(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def word_idf(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> dict[str, float]:
    """IDF of every template word, counted over all documents. The result has one entry for each template word."""
    vocabulary = _vocabulary(notices)
    known = F.array_intersect(pieces(F.col("text")), _literal(vocabulary))
    # The outer form never sees an empty array here; the inner one would work the words out again to test for it.
    counted = docs.select(F.explode_outer(F.concat(known, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counted}
    total = found.get("", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1.0 for w in vocabulary}


@dataclass(frozen=True)
class Part:
    """A part of a notice in the index: its words, which are mandatory, and their IDF."""

    words: tuple[str, ...]
    mandatory: tuple[bool, ...]
    idf: tuple[float, ...]

    def rarest(self) -> list[str]:
        """Distinct mandatory words, the highest IDF first."""
        idf = dict(zip(self.words, self.idf, strict=True))
        return sorted({w for w, m in zip(self.words, self.mandatory, strict=True) if m}, key=lambda w: (-idf[w], w))


def indexed(notices: tuple[Notice, ...], idf: dict[str, float]) -> tuple[list[Part], list[list[int]]]:
    """The distinct parts of all notices, and the numbers of the parts of each notice."""
    parts: list[Part] = []
    numbers = []
    for n in notices:
        numbers.append([])
        for i in range(len(n.parts)):
            words = n.words(i)
            part = Part(tuple(w for w, _ in words), tuple(m for _, m in words), tuple(idf[w] for w, _ in words))
            if part not in parts:
                parts.append(part)
            numbers[-1].append(parts.index(part))
    return parts, numbers


#: The index as a literal. Built from JSON: one expression instead of thousands, and folded into a constant.
INDEX = "array<struct<part:int,needs:array<string>,postings:array<struct<word:string,at:array<int>>>,sequence:array<struct<word:string,mandatory:boolean,idf:double>>,weight:double>>"
LABELS = "array<struct<label:string,base:boolean,own:array<int>,weights:array<double>>>"


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _index(parts: list[Part]) -> Column:
    """The postings, by part: its mandatory words in order of IDF with their places, all its words, and their IDF."""

    def places(part: Part, word: str) -> list[int]:
        return [i for i, w in enumerate(part.words) if w == word and part.mandatory[i]]

    return _constant(
        [
            {
                "part": n,
                "needs": p.rarest(),
                "postings": [{"word": w, "at": places(p, w)} for w in p.rarest()],
                "sequence": [{"word": w, "mandatory": m, "idf": x} for w, m, x in zip(p.words, p.mandatory, p.idf, strict=True)],
                "weight": sum(p.idf),
            }
            for n, p in enumerate(parts)
        ],
        INDEX,
    )


def _labels(notices: tuple[Notice, ...], parts: list[Part], numbers: list[list[int]]) -> Column:
    """The notices: their parts, in order, and what share of the notice's IDF each one has."""

    def weights(own: list[int]) -> list[float]:
        return [sum(parts[p].idf) / sum(sum(parts[q].idf) for q in own) for p in own]

    return _constant([{"label": n.label, "base": n.base, "own": own, "weights": weights(own)} for n, own in zip(notices, numbers, strict=True)], LABELS)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, idf: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, places (part, start, share), base_places, base_labels, labels, score.

    Null and empty texts have no words, no place and score 0. Every place counts, also overlapping and repeated ones;
    share is the part of a template part's words, by IDF, that stand in place there, so 1 for a complete one. score is
    the largest, over the notices that are there, of the share of a whole notice (its parts' best shares by IDF).
    Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored. One row is
    handled at a time and nothing is shuffled, so no licence that many files share makes a large group.
    """
    idf = idf or word_idf(docs, notices)
    parts, numbers = indexed(notices, idf)
    by_idf = sorted({w for p in parts for w in p.rarest()}, key=lambda w: (-idf[w], w))
    # The rarest mandatory word of each part: a file without any of these has no notice, so it isn't looked at further.
    anchors = _literal(sorted({p.rarest()[0] for p in parts}))

    def candidates(p: Column) -> Column:
        """Where a part would begin, by all of its mandatory words; the rarest first."""

        def proposed(posting: Column) -> Column:
            places = F.filter("hits", lambda h: h["word"] == posting["word"])
            return F.flatten(F.transform(places, lambda h: F.transform(posting["at"], lambda a: h["at"] - a)))

        def met(starts: Column, posting: Column) -> Column:
            # array_intersect of a word with several places also drops repeats.
            return F.when(F.size(starts) == 0, starts).otherwise(F.array_intersect(starts, proposed(posting)))

        return F.aggregate(F.slice(p["postings"], 2, F.greatest(F.size(p["postings"]) - 1, F.lit(0))), F.array_distinct(proposed(F.get(p["postings"], F.lit(0)))), met)

    def stands(s: Column, w: Column, i: Column) -> Column:
        at = s + i
        return (at >= 0) & (at < F.col("n_words")) & F.coalesce(F.get(F.col("words"), at) == w["word"], F.lit(False))

    def verified(p: Column, s: Column) -> Column:
        return F.forall(F.transform(p["sequence"], lambda w, i: ~w["mandatory"] | stands(s, w, i)), lambda x: x)

    def share(p: Column, s: Column) -> Column:
        return F.aggregate(F.transform(p["sequence"], lambda w, i: F.when(stands(s, w, i), w["idf"]).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / p["weight"]

    def found(p: Column) -> Column:
        starts = F.array_sort(F.filter(candidates(p), lambda s: verified(p, s)))
        return F.transform(starts, lambda s: F.struct(p["part"].alias("part"), s.alias("start"), share(p, s).alias("share")))

    words = docs.select("doc_id", pieces(F.col("text")).alias("raw"))
    # Only the first and the last piece of a split can be empty.
    blanks = (F.get("raw", F.lit(0)) == "").cast("int") + ((F.element_at("raw", -1) == "") & (F.size("raw") > 1)).cast("int")
    rows = words.select("doc_id", "raw", (F.size("raw") - blanks).alias("n_words"), F.arrays_overlap("raw", anchors).alias("maybe"))
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "n_words", F.when(F.col("maybe"), F.filter("raw", lambda w: w != "")).otherwise(none).alias("words"))
    # The file's licence words by IDF, and where they stand.
    present = F.array_intersect(_literal(by_idf), F.col("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(by_idf))
    rows = rows.select("*", F.when(F.size("words") > 0, present).otherwise(none).alias("present"), hits.alias("hits"), F.when(F.size("words") > 0, _index(parts)).alias("index"))
    wanted = F.filter("index", lambda p: F.size(F.array_intersect(p["needs"], F.col("present"))) == F.size(p["needs"]))
    empty = F.array().cast("array<struct<part:int,start:int,share:double>>")
    rows = rows.select("doc_id", "n_words", F.when(F.size("present") > 0, F.flatten(F.transform(wanted, found))).otherwise(empty).alias("places"))

    def of(part: Column) -> Column:
        return F.filter("places", lambda c: c["part"] == part)

    def last(n: Column) -> Column:
        """Where the last part of a notice begins, each part behind the one before it; null unless all are there.

        A part begins before the text where only words that aren't mandatory are missing in front.
        """
        return F.aggregate(n["own"], F.lit(-(1 << 30)), lambda at, part: F.array_min(F.transform(F.filter(of(part), lambda c: c["start"] > at), lambda c: c["start"])))

    def whole(n: Column) -> Column:
        shares = F.transform(n["own"], lambda part, i: F.array_max(F.transform(of(part), lambda c: c["share"])) * F.get(n["weights"], i))
        return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)

    known = _labels(notices, parts, numbers)
    told = F.transform(F.filter(known, lambda n: last(n).isNotNull()), lambda n: F.struct(n["label"].alias("label"), n["base"].alias("base"), whole(n).alias("score")))
    rows = rows.select("*", F.when(F.size("places") > 0, told).otherwise(F.array().cast("array<struct<label:string,base:boolean,score:double>>")).alias("notices"))
    base = sorted({p for n, own in zip(notices, numbers, strict=True) if n.base for p in own})

    def named(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda n: n["label"]))), ",")

    # Base phrases are complete wherever they stand; how much of a notice there is, the others say.
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "places",
        F.filter("places", lambda c: c["part"].isin(base)).alias("base_places"),
        named(F.filter("notices", lambda n: n["base"])).alias("base_labels"),
        named(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["score"])), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("base_places", lambda c: c["start"].cast("long"))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )
