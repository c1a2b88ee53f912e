"""Licence texts as they are usually set: wrapped, in comments, with blank lines."""

import textwrap

from mnemolake.llm import license_scan
from mnemolake.llm.license_scan import RULES, SENTENCES


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["sentence_ids"], r["licenses"]) for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()]


def test_wrapped_licences(spark):
    of = {}
    for s, i in SENTENCES.items():
        of[i] = max(of.get(i, ""), s, key=len)
    texts, wanted = [], []
    for name, _, ids in RULES:
        for width, mark in ((72, ""), (40, "# "), (60, " * ")):
            body = "\n".join("\n".join(mark + x for x in textwrap.wrap(of[i] + ".", width)) + "\n" + mark for i in ids)
            texts.append(f"Some words before.\n\n{body}\nand after")
            wanted.append((list(ids), [name] if name else []))
    got = scanned(spark, texts)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert all(set(w[1]) <= set(g[1]) for g, w in zip(got, wanted, strict=True))


def test_a_sentence_under_a_heading_and_reserved_rights(spark):
    grant = next(s for s, i in SENTENCES.items() if i == "mit-grant")
    got = scanned(spark, ["The MIT License\n" + textwrap.fill(grant, 70) + ":\n\nnothing else", "All rights  reserved.", "all rights-reserved", "all\nrights\nreserved", "no rights"])
    assert got[0][0] == ["mit-grant"]
    rights = [i for s, i in SENTENCES.items() if s == "all rights reserved"]
    assert [g[0] for g in got[1:]] == [rights, rights, rights, []] and rights


ISC = """Copyright (c) 2024, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GNU = """ * This {what} is free software; you can redistribute it and/or modify it
 * under the terms of the GNU {name}General Public License as published by
 * the Free Software Foundation; either version {n} of the License, or (at your
 * option) any later version.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licences_as_files_hold_them(spark):
    wanted = {
        ISC: "ISC",
        BSD: "BSD-2-Clause",
        BSD + THIRD: "BSD-3-Clause",
        APACHE: "Apache-2.0",
        GNU.format(what="program", name="", n="2"): "GPL-2.0-or-later",
        GNU.format(what="program", name="", n="3"): "GPL-3.0-or-later",
        GNU.format(what="library", name="Lesser ", n="2.1"): "LGPL-2.1-or-later",
        GNU.format(what="program", name="Affero ", n="3"): "AGPL-3.0-or-later",
        MPL: "MPL-2.0",
        "This project is licensed under the\nMIT License.": "MIT",
        "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause",
        "under cc0-1.0": "CC0-1.0",
        "provided under the Server Side Public License, version 1": "SSPL-1.0",
    }
    got = scanned(spark, [f"int x;\n\n{t}\n\nint y;" for t in wanted])
    assert [g[1] for g in got] == [[w] for w in wanted.values()]


def test_a_licence_in_a_long_text_and_every_name(spark):
    texts = ["word and word. " * 200_000 + "\n\n" + ISC] + [f"x.\nDistributed under the {name}." for name in license_scan.NAMES]
    got = scanned(spark, texts)
    assert got[0][1] == ["ISC"] and all(g[0] == [i] and len(g[1]) == 1 for g, i in zip(got[1:], license_scan.NAMES.values(), strict=True))
    assert len({name for name, _, _ in RULES}) >= 50 and {i for _, _, ids in RULES for i in ids} == set(SENTENCES.values())
