import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm.license_scan import BASE, _strings, keywords, license_scan, rules
from quillspark.llm.quality_rules import _binomial_tail, cutoffs, metrics, quality_rules


def base(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_columns(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs, labels).collect())
    assert got == sorted((r.doc_id or -1, *base(r.text or "")) for r in docs.collect())


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 20, 1000, 5000) for k in (0, 1, 3, 20, 60) if k <= n]
    rows = spark.createDataFrame(cases, "n bigint, k bigint").select("n", "k", _binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in rows:
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_cutoffs_are_the_lowest_that_pass(spark):
    """3,000 good documents of one language with known shares of symbols."""
    text = F.concat(F.lit("word "), F.repeat(F.lit("plain text of ten words or more here and there "), 3), F.repeat(F.lit("#"), (F.col("id") % 40).cast("int")))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    # no two windows of a text are equal
    docs = docs.withColumn("text", F.array_join(F.transform(F.split("text", " "), lambda w, i: F.concat(w, i.cast("string"))), " "))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    measured = metrics(docs)
    row = cutoffs(measured, labels, alpha=0.2, delta=0.05).first()
    shares = sorted(min(1000, 1000 * r.n_symbols // max(r.word_chars, 1)) for r in measured.collect())
    level, p = 0.05 / 4, 0.2 / 4
    allowed = max(k for k in range(151) if sum(math.comb(3000, i) * p**i * (1 - p) ** (3000 - i) for i in range(k + 1)) <= level)
    want = min(v for v in set(shares) if sum(s > v for s in shares) <= allowed)
    assert row.max_symbol_share == want
    kept = quality_rules(docs, labels, alpha=0.2).where("kept").count()
    assert kept >= 3000 * 0.8


def test_few_labels_give_no_cutoff(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert cutoffs(metrics(odd), labels).collect() == []
    assert quality_rules(none, labels).collect() == [] and quality_rules(odd, labels).count() == 11
    assert {r.doc_id for r in quality_rules(odd, labels).where("kept").collect()} == {6, 7}


RULES = [(label, tier, weight, keys, re.compile(regex)) for label, tier, weight, keys, regex in rules()]


def scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(j, name) for phrase, name in BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
    norm, found = " " + " ".join(w) + " ", []
    # every rule is tried on a text of up to 2,000 characters: no trigger, no keyword; keywords have a test of their own
    for label, tier, weight, keys, regex in RULES:
        for m in regex.finditer(norm) if len(norm) < 2000 or all(f" {k} " in norm for k in keys) else ():
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, tier, weight, label))
    rank = lambda d: (-d[2], -d[3], d[4])
    kept = [d for d in found if not any(e[2] >= d[2] and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or rank(e) < rank(d)) for e in found)]
    own = sorted({n for _, n in places})
    at = [j for j, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(own), ",".join(sorted({*own, *(d[4] for d in kept)})), max([d[3] for d in kept] + [0.5 if own else 0.0])


TEXTS = [
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "This is free software under the GNU Lesser General Public License, version 2.1; see GPL v3.",
    "cc by cc by CC-BY-NC-SA 4.0 and Creative Commons Attribution-ShareAlike 3.0",
    "released under the MIT License. SPDX-License-Identifier: MIT license",
    "mit der Lizenz, all rights were reserved; General public. license",
    "Copyright (c) 2019 X. bsd-3-clause license, ISC License, in the public domain",
    "licensed under the terms of the Mozilla Public License v2.0 " * 3,
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "// SPDX-License-Identifier: Apache-2.0\n# SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-or-later",
    "Neither the name of the Example Project, Inc. nor the names of its contributors may be used to endorse or promote products",
    "© 2021 Beispiel GmbH, alle Rechte vorbehalten. Tous droits réservés.",
    "Copyright by no one",
]


def test_scan_matches_brute_force(spark, sf, docs_of, odd):
    assert len(rules()) >= 800 and all(keys for _, _, _, keys, _ in rules())
    docs = docs_of(list(enumerate(TEXTS)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(1000, None), (1001, "")])
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(docs).collect()}
    assert got == {r.doc_id: scan(r.text or "") for r in docs.collect()}
    ids = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in license_scan(odd).collect()), key=ids) == sorted(((r.doc_id, *scan(r.text or "")) for r in odd.collect()), key=ids)


def test_names_that_lack_a_keyword_of_other_names(docs_of):
    cases = {"MIT No Attribution": "mit-0", "FreeBSD license": "bsd-2-clause", "0BSD": "bsd-0-clause", "GNU Library General Public License version 2": "lgpl-2.0", "GPL2": "gpl-2.0", "GPL3": "gpl-3.0", "gnu gplversion 3": "gpl-3.0"}
    docs = list(enumerate(cases))
    got = {r.doc_id: r.labels.split(",") for r in license_scan(docs_of(docs)).collect()}
    for i, text in docs:
        assert cases[text] in got[i], text
        assert got[i] == scan(text)[5].split(","), text


def test_keywords_are_in_every_string_of_a_regex():
    assert keywords("(?:gnu )?gpl (?:version |v)?2(?: 0)?") == ["gpl"] and keywords("a b|b c") == ["b"] and keywords("licen[cs]e x.{1,8} y") == ["y"]
    for label, tier, weight, keys, regex in rules()[:400]:
        for text in _strings(regex.removeprefix("(?<= )").removesuffix("(?= )"))[:50]:
            if "\0" not in text:
                assert re.search(regex, f" {text} ") and set(keys) <= set(text.split(" ")), (label, text)


def test_scan_of_nothing(none):
    assert license_scan(none).collect() == []
