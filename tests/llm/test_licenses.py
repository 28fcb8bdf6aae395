"""License scan against a plain version of the rules, and arrays scanned in blocks."""

import random
import re
import time

from pyspark.sql import functions as F

from viaduct.llm import arrays, licenses

RULES = licenses.rules()


def plain_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + "".join(w + " " for w in words)
    found = []
    for i, (label, _, pattern, rank) in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            found.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), rank, i, label))
    contains = lambda a, b: a is not b and a[0] <= b[0] and b[1] <= a[1] and (a[2] < b[2] or a[2] == b[2] and (a[:2] != b[:2] or a[3] < b[3]))
    kept = sorted(x for x in found if not any(contains(y, x) for y in found))
    base = {label for p, label in licenses.PHRASES if f" {p} " in line}
    score = 1.0 if base else max([0.0, *(licenses.STRENGTH[x[2]] for x in kept)])
    return len(words), [tuple(x) for x in kept], ",".join(sorted(base | {x[4] for x in kept})), score


def texts():
    draw = random.Random(11)
    names = [label for label, *_ in licenses.NAMES] + ["MIT License", "Apache License, Version 2.0", "GNU Lesser General Public License version 2.1", "GNU GPL v3", "BSD 3-Clause License", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "Mozilla Public License 2.0", "Affero General Public License"]
    starts = ["licensed under the ", "Released under ", "distributed under the terms of the ", "SPDX-License-Identifier: ", "see ", ""]
    out = [" ".join(draw.choice(starts) + draw.choice(names) + draw.choice([".", " and", ""]) for _ in range(draw.randint(1, 5))) for _ in range(60)]
    out += [f"SPDX-License-Identifier: {x.upper()}-only" for x in licenses.IDENTIFIERS[::9]]
    out += ["", None, "mit", "Under the MIT license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "https://creativecommons.org/licenses/by-sa/3.0/", "ÉK gpĺ GPL", "all rights reserved all rights reserved"]
    return out


def test_rules_by_hand(spark):
    want = {"MIT no attribution": "mit-0", "under the GPL v2": "gpl-2", "the new BSD license": "bsd-3-clause", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3", "Apache License 2.0 or MIT license": "apache-2,mit", "apache license": "apache", "licensing of apaches": "", "CC BY-NC-ND 4.0": "cc-by-nc,cc-by-nc-nd-4", "a copyleft": "copyleft"}
    rows = spark.createDataFrame(list(want.items()), "text string, want string")
    got = {r.text: r.labels for r in licenses.scan_licenses(rows).collect()}
    assert got == want


def test_against_plain_rules(spark):
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts())] * 2, "doc_id long, text string, SCORE int, words string")
    out = licenses.scan_licenses(rows)
    assert sorted(out.columns) == sorted(["doc_id", "text", *licenses.RESULTS])
    assert out.limit(0).count() == 0
    for r in out.collect():
        assert (r.n_words, [tuple(x) for x in r.detections], r.labels, r.score) == plain_scan(r.text), r.text


def sample(pattern, draw):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in pattern:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += chr(draw.choice(arg)[1])
            case "SUBPATTERN":
                out += sample(arg[3], draw)
            case "BRANCH":
                out += sample(draw.choice(arg[1]), draw)
            case "MAX_REPEAT":
                out += "".join(sample(arg[2], draw) for _ in range(draw.choice(arg[:2])))
    return out


def test_matches_hold_their_keyword():
    draw = random.Random(1)
    for _, keyword, pattern, _ in RULES:
        for _ in range(50):
            text = sample(re._parser.parse(pattern), draw)
            assert re.fullmatch(pattern, text) and keyword in f" {text} "


def test_scan_in_blocks(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(1, 1000)),), ([3, -1, 4] * 43,)], "x array<bigint>")
    for r in rows.select("x", arrays.running(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))]


def test_a_text_full_of_licenses(spark):
    text = "Licensed under the MIT License, " * 40_000
    began = time.time()
    (r,) = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).select("n_words", "n_base", "first_word", "last_word", "labels", F.size("detections").alias("n")).collect()
    assert tuple(r) == (200_000, 40_000, 1, 199_996, "mit", 40_000) and time.time() - began < 60
