import random
import re
import time

import numpy as np

from tabwright.llm.license_rules import NAMES, rules
from tabwright.llm.license_scan import BASE_PHRASES, LOWER, Scanner, resolved, op8_license_scan, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(i, text):
    w, places, labels = words(text), [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for s in range(len(w) - len(p) + 1):
            if w[s : s + len(p)] == p:
                places.append(s)
                labels.add(label)
    return (i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def check(rows, df):
    got = df.collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str(brute(i, t)) for i, t in rows)
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and (r.score > 0) == bool(r.labels)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op8_license_scan(spark, sf_dir))


def test_awkward(spark, awkward, awkward_docs, no_docs):
    check([r[:2] for r in awkward], scan_licenses(awkward_docs))
    assert scan_licenses(no_docs).count() == 0
    rng = random.Random(4)
    parts = ["mit", "License", "apache", "General", "public", "-", "é", "licenses", "\0", "the", ", "]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for k in range(300)]
    rows += [(None, "MIT\nlicense"), (1, "mit license" * 3), (2, "permit license"), (3, "mit licensé"), (4, "\x7fMIT--LICENSE\x7f"), (5, "mit license " * 5000)]
    check(rows, scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))


def labels(text):
    found = Scanner(rules(), BASE_PHRASES).scan(text.encode().translate(LOWER))
    return found[3], found[4], [(d["label"], d["form"], d["matched"]) for d in found[6]], found[5]


def test_resolution():
    assert len(rules()) > 300
    base, every, found, score = labels("SPDX-License-Identifier: Apache-2.0")
    assert (base, every, score) == ("", "apache-2.0", 1.0) and found[0][:2] == ("apache-2.0", "identifier")
    # The longer name wins over the one within it, base phrases stay.
    base, every, found, _ = labels("under the GNU Lesser General Public License, version 2.1")
    assert base == "gpl" and "lgpl-2.1" in every and "gpl" in every.split(",")
    assert [f for f in found if f[0] == "gpl"] == []
    _, every, found, _ = labels("Distributed under the Apache License, Version 2.0. See the MIT License.")
    assert {"apache-2.0", "mit"} <= set(every.split(",")) and ("mit", "grant", "the mit license") not in found
    assert ("mit", "reference") in [f[:2] for f in found] and ("apache-2.0", "grant") in [f[:2] for f in found]
    assert labels("a permit licensed by apaches") == ("", "", [], 0.0)
    assert labels("") == ("", "", [], 0.0)


def test_identifiers_and_variants():
    """Identifiers, abbreviations and names of variants; a name of a family doesn't take the place of a variant's."""
    for text, want in [
        ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"), ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1+", "lgpl-2.1"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: BSL-1.0", "boost"),
        ("GPL v2 or later", "gpl-2.0"), ("GPL-3.0-only", "gpl-3.0"), ("AGPL-3.0-or-later", "agpl-3.0"), ("the GNU GPL version 3", "gpl-3.0"), ("gpl license", "gpl"),
        ("Simplified BSD License", "bsd-2-clause"), ("New BSD License", "bsd-3-clause"), ("the BSD 3-Clause License", "bsd-3-clause"), ("BSD License", "bsd"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("mit der lizenz isc und json", ""), ("Mozilla Public License, v. 2.0", "mpl-2.0"),
    ]:
        every = labels(text)[1]
        assert every == want, (text, every)


def test_resolved_as_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(0, 14)
        given = [(rng.randrange(3), s := rng.randrange(12), s + rng.randrange(1, 7)) for _ in range(n)]
        kept = []
        for k in sorted(range(n), key=lambda k: (-given[k][0], given[k][1], -given[k][2], k)):
            p, s, e = given[k]
            same = [given[j] for j in kept if given[j][0] == p and given[j][1] <= s and e <= given[j][2]]
            if not same:
                kept.append(k)
        # A level is resolved within itself before it is held against higher ones.
        final = []
        for k in kept:
            p, s, e = given[k]
            if not any(given[j][0] > p and (given[j][1] <= s and e <= given[j][2] or s <= given[j][1] and given[j][2] <= e) for j in final):
                final.append(k)
        got = resolved(*(np.array([g[i] for g in given], np.int64) for i in range(3)))
        assert sorted(got.tolist()) == sorted(final), given
        assert [given[k][1:] for k in got] == sorted(given[k][1:] for k in got)


def test_linear_time():
    """A megabyte of phrases: places and detections without a pass over the text for each."""
    scanner = Scanner(rules(), BASE_PHRASES)
    for phrase in ("mit license ", "licensed under the apache license version 2 0 ", "spdx license identifier mit "):
        text = (phrase * (1 + 1_000_000 // len(phrase))).encode()
        begin = time.process_time()
        found = scanner.scan(text)
        assert time.process_time() - begin < 8 and len(found[6]) > 10_000


def test_keywords_are_necessary():
    """A rule's keyword stands in whatever its pattern matches: names without options are such matches."""
    for label, names in NAMES.items():
        for keyword, pattern in names:
            plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?!\?)", r"\1", pattern)
            plain = re.sub(r"\(\?:[^()]*\)\?", "", plain)
            plain = re.sub(r" \?", "", re.sub(r"\[(.)[^]]*\]", r"\1", plain))
            if re.fullmatch(pattern, plain):
                assert keyword in plain, (label, pattern, plain)


def test_wording_without_names():
    """Texts and notices of licences are known without the licence's name."""
    for text, label, form in [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit", "body"),
        ("permission is hereby granted free of charge", "mit", "body"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit", "notice"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "boost", "body"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", "body"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause", "notice"),
        ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES', "bsd", "warranty"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc", "body"),
        ("This program is free software: you can redistribute it and/or modify it", "gpl", "header"),
        ("This library is free software; you can redistribute it and/or modify it", "lgpl", "header"),
        ("you may not use this file except in compliance with the License.", "apache-2.0", "header"),
        ("Altered source versions must be plainly marked as such", "zlib", "body"),
        ("This is free and unencumbered software released into the public domain.", "unlicense", "body"),
    ]:
        base, every, found, score = labels(text)
        assert base == "" and every == label and [f[:2] for f in found] == [(label, form)] and score >= 0.8, (text, every, found)


def test_signature_keywords():
    """A signature's keyword stands in its pattern word for word, so in whatever it matches."""
    from tabwright.llm.license_rules import SIGNATURES

    for label, _, keyword, pattern in SIGNATURES:
        assert keyword in pattern, (label, keyword)


def test_expressions_after_the_tag():
    """Identifiers of an expression of any length, others' identifiers and exceptions within it; none from prose."""
    many = "Apache-2.0 OR BSD-2-Clause OR BSD-3-Clause OR ISC OR MPL-2.0 OR EPL-2.0 OR GPL-2.0-only OR GPL-3.0-or-later OR LGPL-2.1-only OR Zlib OR BSL-1.0 OR Unlicense OR CC0-1.0 OR NCSA OR MIT"
    assert {"ncsa", "mit", "zlib", "apache-2.0", "gpl-3.0"} <= set(labels(f"// SPDX-License-Identifier: {many}")[1].split(","))
    assert labels("SPDX-License-Identifier: (LicenseRef-Acme-1.0 AND MIT) some text")[1] == "mit"
    assert labels("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR NCSA")[1].split(",") == ["gpl-2.0", "ncsa"]
    assert labels("SPDX-License-Identifier: ISC and then MIT said so")[1] == "isc"
    for prose in ("The SPDX license identifier is a tag that people from Harvard and MIT like", "an SPDX license identifier of Harvard and MIT", "the SPDX license identifier for X or MIT"):
        assert labels(prose)[1:] == ("", [], 0.0), prose


def test_denied_and_bare_names():
    plain, denied = labels("This project is released under the MIT license"), labels("This project is not released under the MIT license")
    assert plain[0] == denied[0] == "mit" and denied[3] < plain[3] and denied[2][0][1] == "denied"
    assert labels("we never used the ISC license")[3] < 0.2 and labels("License: MIT")[1] == "mit"
    assert labels("under a license MIT uses for its courses")[1] == ""
