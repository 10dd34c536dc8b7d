import re
import time

from pyspark.sql import functions as F

from strandline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, places, base, labels, best = words(text), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    blocks = [[]]
    for line in (text or "").split("\n"):
        blocks = [*blocks[:-1], blocks[-1] + words(line)] if words(line) else [*blocks, []]
    for own in map(set, blocks):
        for label, template, telling, other in licenses.TEMPLATES:
            t = set(words(template))
            share = len(t & own) / len(t)
            if share >= licenses.THRESHOLD - 1e-12 and set(telling.split()) <= own and not set(other.split()) & own:
                labels.add(label)
                best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best


def test_equals_brute_force(spark):
    texts = [
        None, "", "plain words here", "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0.\nUnder THE mit-license under the MIT license",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "General Public GNU License version 3 is this work licensed", "this work is licensed", "é under the mit licenses",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Software Foundation",
        "Permission is hereby granted to any person obtaining copy of this software and associated documentation files free charge",
        "under the mit\nlicense", "a " * 5000 + "cc by nc",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").withColumn("labels", F.lit(0))
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_wrapped_notices_are_found(spark):
    mit = licenses.TEMPLATES[2][1].split()
    wrapped = "\n".join(" ".join(mit[i : i + 5]) for i in range(0, len(mit), 5))
    texts = [
        "int main;\n\n" + wrapped, "\n".join("# " + line for line in wrapped.split("\n")), "/*\n * " + wrapped.replace("\n", "\n * ") + "\n */\nint x;",
        wrapped.replace("\n", "\n\n"), wrapped.replace("\n", "\n  ---\n"), "\n\n", None, "!!\n??",
    ]
    docs = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i].labels for i in (0, None, 2)] == ["mit"] * 3 and all(got[i].score == 1.0 and got[i].n_base == 0 for i in (0, None, 2))
    assert [(got[i].labels, got[i].score) for i in range(3, 8)] == [("", 0.0)] * 5


def test_many_hits_take_time_in_proportion(spark):
    n = 150_000
    docs = spark.createDataFrame([(1, "x cc by nc " * n)], "doc_id long, text string")
    begun = time.time()
    row = licenses.scan_licenses(docs).first()
    assert (row.n_base, row.first_word, row.last_word, row.n_words) == (n, 1, 4 * n - 3, 4 * n) and time.time() - begun < 30


#: Notices as projects write them, with the one label each should give.
NOTICES = {
    "released under the terms of the GPL license": "", "a film released under the terms of a driving license": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl-2",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software": "boost",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Released under the terms of the MIT License.": "mit", "Ich fahre mit dem Auto under the terms of the license": "",
}


def test_near_misses_get_the_right_label_only(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert {text: got[i] for i, text in enumerate(NOTICES)} == NOTICES


def test_large_templates_take_passes(spark):
    docs = spark.createDataFrame(list(enumerate([*NOTICES, None, "Under the MIT License; apache license version 2"])), "doc_id long, text string")
    want = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    assert sorted(map(tuple, licenses.scan_licenses(docs, most=900).collect())) == want
    large = (("x", "word " * 300_000), ("y", "only these three words"))
    assert [r.labels for r in licenses.scan_licenses(docs.limit(1), templates=large, phrases={}).collect()] == [""]
