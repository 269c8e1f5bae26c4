"""License scans: Dice coefficient over word bigrams against templates, with size bounds."""

from __future__ import annotations

import re
from bisect import bisect_left
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices by which texts state their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Whole licences, numbered after TEMPLATES: the file's name is the licence's.
TEXTS = Path(__file__).parent / "licence_texts"
#: A word as `words` makes them.
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def words(text: Column) -> Column:
    """Normalised words: lower case, letters and digits with inner dots (version numbers), all else a blank."""
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.", " ")
    return F.filter(F.split(flat, " +"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct word bigrams in order of text; none for fewer than two words."""
    # Binding the words to a lambda's variable makes them once, not once an element.
    pairs = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda x, y: F.concat_ws(" ", x, y))
    made = lambda v: F.when(F.size(v) > 1, F.array_distinct(pairs(v))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(w), made)[0]


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    t = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(rows)], "template int, license string, __text string")
    return t.withColumn("t_grams", bigrams(words(F.col("__text")))).drop("__text")


def full_texts() -> list[tuple[int, str, str]]:
    return [(len(TEMPLATES) + i, f.name.removesuffix(".txt"), f.read_text()) for i, f in enumerate(sorted(TEXTS.glob("*.txt")))]


def _following(grams: list[tuple[str, str]]) -> np.ndarray:
    """The next place of each bigram, or their number where it doesn't come again."""
    out, seen = np.full(len(grams), len(grams)), {}
    for i in range(len(grams) - 1, -1, -1):
        out[i] = seen.get(grams[i], len(grams))
        seen[grams[i]] = i
    return out


def _bounds(grams: list[tuple[str, str]], t: set[tuple[str, str]], most: int) -> np.ndarray:
    """For each place, what the dice of no window that ends there exceeds; one pass, so its work follows the text.

    Of t's m bigrams, d different ones stand in the `most` places up to there, so dice is at most 2 d / (d + m). It is 1 only if the shortest
    window with all of them holds no others; else it is at most 2 m / (2 m + 1), the next ratio.
    """
    m, out = len(t), np.zeros(len(grams))
    reach, short = {}, {}  # places of t's bigrams in reach, and in the window from `first` on
    first, last_other = 0, -1
    for i, g in enumerate(grams):
        if i >= most and (old := grams[i - most]) in reach:
            reach[old] -= 1
            if not reach[old]:
                del reach[old]
        if g not in t:
            last_other = i
            continue
        reach[g] = reach.get(g, 0) + 1
        short[g] = short.get(g, 0) + 1
        while (count := short.get(grams[first], 2)) > 1:  # another bigram, or one that comes again
            if grams[first] in short:
                short[grams[first]] = count - 1
            first += 1
        d = len(reach)
        out[i] = 2 * d / (d + m)
        if d == m and last_other >= first:
            out[i] = 2 * m / (2 * m + 1)
    return out


def _windows(grams: list[tuple[str, str]], t: set[tuple[str, str]], places: int, threshold: float, following: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(dice, first, last) of the windows of bigrams that are like t; of overlapping ones the best stands, and others are sought beside it.

    A window begins and ends with one of t's bigrams (any other at its ends lowers dice), and is at most (2 - threshold) / threshold times as long as the template, of so many `places` with its repeated bigrams.
    Ends are tried in order of their bounds, so that those inside a window that stands, most of a licence's, aren't looked at.
    """
    m, most = len(t), int(places * (2 - threshold) / threshold + 1e-9)
    hit = np.array([g in t for g in grams])
    following = _following(grams) if following is None else following

    def best(end: int, floor: int) -> tuple[float, int]:
        lo = max(floor, end + 1 - most)
        # A bigram counts once: at its last place in the window.
        own, new = hit[lo : end + 1], following[lo : end + 1] > end
        n, both = np.cumsum(new[::-1])[::-1], np.cumsum((new & own)[::-1])[::-1]
        dice = np.where(own, 2 * both / (n + m), 0)
        first = len(dice) - 1 - int(dice[::-1].argmax())
        return float(dice[first]), lo + first

    bounds = _bounds(grams, t, most)
    # Bounds, marked by -1, come before windows of the same dice.
    heap = [(-bounds[end], -1, int(end), 0) for end in np.flatnonzero(bounds >= threshold - 1e-12)]
    heapify(heap)
    firsts, lasts = [], []  # of those that stand, in order
    while heap:
        d, first, end, floor = heappop(heap)
        at = bisect_left(lasts, end)
        if at < len(lasts) and firsts[at] <= end:
            continue
        if first < 0:
            d, first = best(end, 0)
            if d >= threshold:
                heappush(heap, (-d, first, end, 0))
            continue
        if at and lasts[at - 1] >= first:
            floor = lasts[at - 1] + 1
            d, first = best(end, floor)
            if d >= threshold:
                heappush(heap, (-d, first, end, floor))
            continue
        firsts.insert(at, first)
        lasts.insert(at, end)
    return [(best(end, first)[0], first, end) for first, end in zip(firsts, lasts)]


def notices(text: str, known: list[tuple[int, str, set[tuple[str, str]], int]], threshold: float) -> list[tuple[int, int, str, int, float]]:
    """(first line, last line, license, template, dice), lines from 1, of the windows of a whole text that are like a template."""
    low = text.lower()
    w = WORD.findall(low)
    here, out, grams = set(zip(w, w[1:])), [], None
    for k, name, t, places in known:
        if not t or len(here & t) < threshold / (2 - threshold) * len(t) - 1e-9:
            continue
        if grams is None:
            grams, starts = list(zip(w, w[1:])), [x.start() for x in WORD.finditer(low)]
            ends, following = [x.start() for x in re.finditer("\n", low)], _following(grams)
        line = lambda i: bisect_left(ends, starts[i]) + 1
        out += [(line(first), line(last + 1), name, k, d) for d, first, last in _windows(grams, t, places, threshold, following)]
    return out


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, line (from 1, the first), license, template and dice of every line, and every other window of words, that is like a template.

    Lines: see `scan_lines`. Windows: runs of words of the whole text, across lines and inside them, so that wrapped notices and
    ones among other words are found; of overlapping windows for one template the best counts, and none that touches a line which is itself like
    that template. Without `known`, windows are compared with whole licences too. Each text is scanned inside its task, and
    only templates that share enough bigrams with it are looked for. Null and empty texts match none; repeated rows each report.
    """
    t = (known if known is not None else templates(docs.sparkSession)).select("template", "license", F.array_distinct("t_grams").alias("g"))
    # Fixed values, or a table that the caller bounds.
    table = [(r.template, r.license, {tuple(g.split(" ")) for g in r.g}, len(r.g)) for r in t.collect() if r.g]
    if known is None:
        table += [(k, name, set(zip(w, w[1:])), len(w) - 1) for k, name, x in full_texts() for w in [WORD.findall(x.lower())]]

    by = {k: g for k, _, g, _ in table}

    def run(batches):
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                lines = None
                for first, last, name, k, d in notices(text or "", table, threshold):
                    lines = [set(zip(w, w[1:])) for w in (WORD.findall(x.lower()) for x in text.split("\n"))] if lines is None else lines
                    if all(2 * len(x & by[k]) < threshold * (len(x) + len(by[k])) for x in lines[first - 1 : last]):
                        rows.append((i, first, name, k, d))
            at, *rest = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, kind) for x, kind in zip(rest, kinds))], names=["doc_id", "line", "license", "template", "dice"])

    kinds = [pa.int32(), pa.string(), pa.int32(), pa.float64()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, license string, template int, dice double")
    return scan_lines(docs, known, threshold).unionByName(whole)


def scan_lines(docs: DataFrame, known: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, line (from 1), license, template and dice of every line that is like a template: 2 |A n B| / (|A| + |B|) >= threshold.

    A text is scanned line by line, whole, and each line is compared with the templates whose size its own allows: a pair
    can pass only if min / max of the sizes is at least threshold / (2 - threshold); and only with templates
    that share a bigram with it. So lines are joined with the templates' bigrams by an
    equi-join; what is broadcast is the template table (fixed values or a table that the caller bounds). A line may match several templates; null and
    empty texts match none; repeated rows each report; an empty table gives an empty result.
    """
    known = known if known is not None else templates(docs.sparkSession)
    grams = known.select("template", "license", F.size("t_grams").alias("t_n"), F.explode("t_grams").alias("gram"))
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), F.posexplode(F.split("text", r"\n")).alias("line", "__t"))
    # The outer explode of one element keeps the optimizer from making the bigrams again in each filter.
    lines = lines.withColumn("__grams", F.explode(F.array(bigrams(words(F.col("__t")))))).drop("__t").withColumn("n", F.size("__grams"))
    bound = threshold / (2 - threshold)
    sizes = known.agg(F.min(F.size("t_grams")), F.max(F.size("t_grams"))).first()
    if sizes[0] is None:
        lines = lines.limit(0)
    else:
        lines = lines.filter((F.col("n") >= bound * max(1, sizes[0])) & (F.col("n") <= sizes[1] / bound))
    hits = lines.select("doc_id", "__row", "line", "n", F.explode("__grams").alias("gram")).join(F.broadcast(grams), "gram")
    hits = hits.filter((F.least("n", "t_n") >= bound * F.greatest("n", "t_n")))
    hits = hits.groupBy("__row", "doc_id", "line", "license", "template", "n", "t_n").agg(F.count(F.lit(1)).alias("both"))
    dice = 2 * F.col("both") / (F.col("n") + F.col("t_n"))
    return hits.withColumn("dice", dice).filter(F.col("dice") >= threshold).select("doc_id", (F.col("line") + 1).alias("line"), "license", "template", "dice")
