"""Licence recognition by sentences: normalised sentences become identifiers, ordered rules match runs of identifiers.

DataFrame functions only. The rules are a fixed table; no table of the corpus is joined or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import table

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software shall be used for good not evil": "json-good",
    "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium": "x11-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "this software is provided as is without any express or implied warranty": "zlib-asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "lgpl2-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation": "gfdl13-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl1-made",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-made",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-file",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-use",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copies",
    "you just do what the fuck you want to": "wtfpl-do",
    "as long as you retain this notice you can do whatever you want with this stuff": "beerware-do",
    "this font software is licensed under the sil open font license version 1 1": "ofl11-font",
    "all rights reserved": "all-rights",
}
# Names of licences as they stand behind "licensed under the" and the like, and their identifiers.
NAMES = {
    "mit license": "mit-name",
    "x11 license": "x11-license",
    "isc license": "isc-name",
    "zlib license": "zlib-name",
    "bsd 2 clause license": "bsd2-name",
    "simplified bsd license": "bsd2-name",
    "bsd 3 clause license": "bsd3-name",
    "new bsd license": "bsd3-name",
    "boost software license version 1 0": "boost-name",
    "apache license version 2 0": "apache2-name",
    "apache license version 2 0 the license": "apache2-name",
    "apache license 2 0": "apache2-name",
    "apache 2 0 license": "apache2-name",
    "artistic license 2 0": "artistic2-name",
    "postgresql license": "postgresql-name",
    "python software foundation license": "psf-name",
    "microsoft public license": "mspl-name",
    "university of illinois ncsa open source license": "ncsa-name",
    "gnu general public license version 2": "gpl2-name",
    "gnu general public license v2 0": "gpl2-name",
    "gnu general public license version 3": "gpl3-name",
    "gnu general public license v3 0": "gpl3-name",
    "gnu lesser general public license version 2 1": "lgpl21-name",
    "gnu lesser general public license version 3": "lgpl3-name",
    "gnu affero general public license version 3": "agpl3-name",
    "gnu affero general public license v3 0": "agpl3-name",
    "mozilla public license version 2 0": "mpl2-name",
    "mozilla public license 2 0": "mpl2-name",
    "eclipse public license version 1 0": "epl1-name",
    "eclipse public license 2 0": "epl2-name",
    "european union public license version 1 2": "eupl12-name",
    "common development and distribution license version 1 0": "cddl-name",
    "sil open font license version 1 1": "ofl11-name",
    "open database license": "odbl-name",
    "business source license 1 1": "busl11-name",
    "server side public license version 1": "sspl-name",
    "elastic license 2 0": "elastic2-name",
    "cc0 1 0": "cc0-name",
    "cc0 1 0 universal": "cc0-name",
    "cc by 3 0": "ccby3-name",
    "cc by 4 0": "ccby4-name",
    "creative commons attribution 4 0 international license": "ccby4-name",
    "cc by sa 3 0": "ccbysa3-name",
    "cc by sa 4 0": "ccbysa4-name",
    "creative commons attribution sharealike 4 0 international license": "ccbysa4-name",
    "cc by nd 4 0": "ccbynd4-name",
    "cc by nc 4 0": "ccbync4-name",
    "creative commons attribution noncommercial 4 0 international license": "ccbync4-name",
    "cc by nc sa 4 0": "ccbyncsa4-name",
    "creative commons attribution noncommercial sharealike 4 0 international license": "ccbyncsa4-name",
    "cc by nc nd 4 0": "ccbyncnd4-name",
}
#: What may stand before a name; it is normalised to "under".
FORM = "(?:(?:this (?:project|software|work|code|program|library|file|package|document) is )?(?:licensed|released|distributed|available|published|provided) )?under (?:(?:the|an?) )?"
SENTENCES |= {f"under {name}": i for name, i in NAMES.items()}
# Licence, its class, and the identifiers that must follow one another; earlier rules take their run first.
RULES = [
    ("JSON", "restricted", ["mit-grant", "mit-notice", "json-good"]),
    ("X11", "permissive", ["mit-grant", "mit-notice", "x11-name"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", "permissive", ["apache2-name", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", "permissive", ["apache2-name", "apache2-comply"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later", "gpl-copy"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later", "gpl-copy"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later", "lgpl-copy"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later", "lgpl-copy"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later", "agpl-copy"]),
    ("BSD-4-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", "permissive", ["bsd-grant", "bsd-source"]),
    ("MPL-2.0", "copyleft", ["mpl2-form", "mpl2-copy"]),
    ("Zlib", "permissive", ["zlib-asis", "zlib-grant"]),
    ("Unlicense", "public domain", ["unlicense-free", "unlicense-use"]),
    ("WTFPL", "permissive", ["wtfpl-copies", "wtfpl-do"]),
    ("MIT-0", "permissive", ["mit0-grant"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("0BSD", "permissive", ["bsd0-grant"]),
    ("PostgreSQL", "permissive", ["postgresql-grant"]),
    ("BSL-1.0", "permissive", ["boost-grant"]),
    ("Beerware", "permissive", ["beerware-do"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later"]),
    ("GPL-2.0-only", "copyleft", ["gpl2-only"]),
    ("LGPL-2.0-or-later", "copyleft", ["lgpl2-later"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-later"]),
    ("GFDL-1.3-or-later", "copyleft", ["gfdl13-later"]),
    ("MPL-2.0", "copyleft", ["mpl2-form"]),
    ("EPL-1.0", "copyleft", ["epl1-made"]),
    ("EPL-2.0", "copyleft", ["epl2-made"]),
    ("CDDL-1.0", "copyleft", ["cddl-file"]),
    ("Unlicense", "public domain", ["unlicense-free"]),
    ("WTFPL", "permissive", ["wtfpl-copies"]),
    ("OFL-1.1", "permissive", ["ofl11-font"]),
    ("MIT", "permissive", ["mit-name"]),
    ("X11", "permissive", ["x11-license"]),
    ("ISC", "permissive", ["isc-name"]),
    ("Zlib", "permissive", ["zlib-name"]),
    ("BSD-2-Clause", "permissive", ["bsd2-name"]),
    ("BSD-3-Clause", "permissive", ["bsd3-name"]),
    ("BSL-1.0", "permissive", ["boost-name"]),
    ("Apache-2.0", "permissive", ["apache2-name"]),
    ("Artistic-2.0", "permissive", ["artistic2-name"]),
    ("PostgreSQL", "permissive", ["postgresql-name"]),
    ("PSF-2.0", "permissive", ["psf-name"]),
    ("MS-PL", "permissive", ["mspl-name"]),
    ("NCSA", "permissive", ["ncsa-name"]),
    ("GPL-2.0-only", "copyleft", ["gpl2-name"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-name"]),
    ("LGPL-2.1-only", "copyleft", ["lgpl21-name"]),
    ("LGPL-3.0-only", "copyleft", ["lgpl3-name"]),
    ("AGPL-3.0-only", "copyleft", ["agpl3-name"]),
    ("MPL-2.0", "copyleft", ["mpl2-name"]),
    ("EPL-1.0", "copyleft", ["epl1-name"]),
    ("EPL-2.0", "copyleft", ["epl2-name"]),
    ("EUPL-1.2", "copyleft", ["eupl12-name"]),
    ("CDDL-1.0", "copyleft", ["cddl-name"]),
    ("OFL-1.1", "permissive", ["ofl11-name"]),
    ("ODbL-1.0", "copyleft", ["odbl-name"]),
    ("BUSL-1.1", "restricted", ["busl11-name"]),
    ("SSPL-1.0", "restricted", ["sspl-name"]),
    ("Elastic-2.0", "restricted", ["elastic2-name"]),
    ("CC0-1.0", "public domain", ["cc0-name"]),
    ("CC-BY-3.0", "permissive", ["ccby3-name"]),
    ("CC-BY-4.0", "permissive", ["ccby4-name"]),
    ("CC-BY-SA-3.0", "copyleft", ["ccbysa3-name"]),
    ("CC-BY-SA-4.0", "copyleft", ["ccbysa4-name"]),
    ("CC-BY-ND-4.0", "restricted", ["ccbynd4-name"]),
    ("CC-BY-NC-4.0", "noncommercial", ["ccbync4-name"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["ccbyncsa4-name"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["ccbyncnd4-name"]),
    ("proprietary", "restricted", ["all-rights"]),
]
#: Every sentence above holds one of these, so other texts need no splitting.
CUES = "(?i)licen[sc]e|permission|software|redistribution|retain|fuck|cc[^a-z0-9]*by|cc0|advertising|(?:^|[^a-z])mpl|rights[^a-z0-9]+reserved"


def sentences(text: Column) -> Column:
    """Known sentences in order, normalised: lower case, a-z and 0-9 kept.

    A sentence begins and ends at line breaks and . ! ? before white space or the end; within it single line breaks count
    as white space, so that wrapped texts match as well as one-line ones. Of sentences with one beginning the longest counts.
    """
    u = F.regexp_replace(F.translate(F.lower(text), "|;", "  "), "[.!?]([ \\t\\n\\r\\f]|$)", "|\n")
    u = F.regexp_replace(u, "\n[^a-z0-9|]*\n", "|")  # a blank line
    u = F.regexp_replace(F.regexp_replace(u, "\n", ";"), "[^a-z0-9|;]+", " ")
    u = F.regexp_replace(F.regexp_replace(u, "[ ;]*\\|[ |;]*", "|"), " ?;[ ;]*", ";")
    u = F.concat(F.lit("|"), F.trim(u), F.lit("|"))
    u = F.regexp_replace(u, "[|;]{2,}|[|;] | [|;]", "|")
    longest = sorted(SENTENCES, key=lambda x: (-len(x), x))
    whole, named = ("|".join(x for x in longest if x.startswith("under ") == k) for k in (False, True))
    known = f"{whole}|{FORM}(?:{named.replace('under ', '')})".replace(" ", "[ ;]")
    found = F.regexp_extract_all(u, F.lit(f"(?<=[|;])({known})(?=[|;])"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(F.translate(s, ";", " "), f"^{FORM}", "under "))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (known sentences in order), licenses (sorted), classes (sorted), unmatched (ids left over). No shuffle.

    Null and empty texts and texts without known sentences give empty arrays; repeated rows are scanned each;
    other columns aren't read; an empty table gives no rows; a very long text is scanned whole, as one string.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    cued = F.coalesce(F.col(text_col).rlike(CUES), F.lit(False))
    ids = F.when(cued, F.filter(F.transform(sentences(F.col(text_col)), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    # The run of identifiers is text; a rule's match leaves a bar, so what stood apart never becomes neighbours.
    run = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    rules = F.array(*[F.struct(F.lit("".join(f"<{w}>" for w in wanted)).alias("match"), F.lit(k).alias("k")) for k, (_, _, wanted) in enumerate(RULES)])
    none = F.array().cast("array<int>")

    def apply(state: Column, rule: Column) -> Column:
        left, match, hit = state.getField("left"), rule.getField("match"), state.getField("hit")
        hit = F.when(F.contains(left, match), F.array_append(hit, rule.getField("k"))).otherwise(hit)
        return F.struct(F.replace(left, match, F.lit("|")).alias("left"), hit.alias("hit"))

    ruled = F.aggregate(rules, F.struct(run.alias("left"), none.alias("hit")), apply)
    out = out.withColumn("ruled", F.when(F.size("sentence_ids") > 0, ruled).otherwise(F.struct(F.lit("").alias("left"), none.alias("hit"))))

    def of_rules(n: int) -> Column:
        values = F.array(*[F.lit(r[n]) for r in RULES])
        return F.array_sort(F.array_distinct(F.transform("ruled.hit", lambda k: F.element_at(values, k + 1))))

    left = F.filter(F.split(F.regexp_replace("ruled.left", "[|<>]+", " "), " "), lambda x: x != "")
    return out.select("doc_id", "sentence_ids", of_rules(0).alias("licenses"), of_rules(1).alias("classes"), left.alias("unmatched"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "classes", "unmatched")]
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), *joined)


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    steps, before = [], "r0"
    for k, (_, _, wanted) in enumerate(RULES):
        match = "".join(f"<{w}>" for w in wanted)
        steps.append(f"r{k + 1} AS (SELECT *, contains(run{k}, '{match}') AS rule{k}, replace(run{k}, '{match}', '|') AS run{k + 1} FROM {before})")
        before = f"r{k + 1}"

    def listed(n: int) -> str:
        cases = ", ".join(f"CASE WHEN rule{k} THEN '{r[n]}' END" for k, r in enumerate(RULES))
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',')"

    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '[.!?]([ \\t\\n\\r\\f]|$)', chr(10), 'g'), chr(10)),
    lambda x: ({known})[regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), '^{FORM}', 'under ')]), lambda x: x IS NOT NULL) AS ids
  FROM documents
), r0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS run0 FROM s),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  {listed(0)} AS licenses, {listed(1)} AS classes,
  trim(regexp_replace(regexp_replace(run{len(RULES)}, '[|<>]+', ' ', 'g'), ' +', ',', 'g'), ',') AS unmatched
FROM {before}
"""


ORACLE = _oracle()
