"""Operator 8: licence scan by sentence recognition and ordered rules.

Texts are cut into sentences in two ways: at line ends and sentence ends, and (for wrapped texts) at blank lines and sentence
ends; a line without a letter or digit, as in a block of comments, counts as blank.  Sentences in small letters, with other
than letters and digits as single spaces and without a leading list number, are looked up among known licence sentences.  A
rule is a sequence of sentence identifiers; it holds where the recognised sentences of a text, in order, contain its
sequence on end.  A rule that is part of a longer rule gives way to it: it only holds where its sequence stands apart
from those of the longer ones (in the way of cutting that finds a longer one), so the text of BSD-3-Clause is not BSD-2-Clause too.  Of the rules of one licence the
longest that holds is returned.  "All rights reserved" counts only where no licence is found.

The table knows notices, grants and first sentences of the licences in RULES and their SPDX tags; a licence that it does not know gives
no row.  Only texts with a word that every rule has one of are cut; the table is a constant of this module.
Null and empty texts, and texts without known sentences, give no row; rows without an id are left out; equal ids give their rows together; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sentences of published licences and of their usual notices.
SENTENCES = {
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-under-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-title-mit": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-preamble": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl2-contrast": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl3-preamble": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "lgpl21-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl21-applies": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it",
    "lgpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "agpl3-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "apache-license-means": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache-licensor-means": '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License',
    "apache-see-file": "Licensed under the Apache License 2.0",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2-under": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',
    "epl2-materials": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl-under": "Distributed under the Boost Software License, Version 1.0",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-name": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "all-rights": "All rights reserved",
}
#: (licence, ordered sentence identifiers)
RULES = (
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("apache-see-file",)),
    ("Apache-2.0", ("apache-under-the", "apache-comply")),
    ("Apache-2.0", ("apache-under-the", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-license-means", "apache-licensor-means")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-title-mit", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("GPL-2.0", ("gpl2-or-later",)),
    ("GPL-2.0", ("gpl2-or-later", "gpl-hope")),
    ("GPL-2.0", ("gpl2-only",)),
    ("GPL-2.0", ("gpl2-preamble", "gpl2-contrast")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-copyleft", "gpl3-preamble")),
    ("LGPL-2.1", ("lgpl21-or-later",)),
    ("LGPL-2.1", ("lgpl21-applies",)),
    ("LGPL-3.0", ("lgpl3-or-later",)),
    ("LGPL-3.0", ("lgpl3-incorporates",)),
    ("AGPL-3.0", ("agpl3-or-later",)),
    ("AGPL-3.0", ("agpl3-or-later", "gpl-hope")),
    ("AGPL-3.0", ("agpl3-copyleft", "gpl3-preamble")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-https")),
    ("EPL-2.0", ("epl2-under",)),
    ("EPL-2.0", ("epl2-materials",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-under",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("WTFPL", ("wtfpl-copies",)),
    ("all-rights-reserved", ("all-rights",)),
)
#: Holds only where no licence does: licences often follow a line of reserved rights.
RESERVED = "all-rights-reserved"
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Every rule has a sentence that contains one of these; each is part of one word, which no line break divides.
WORDS = ("licen", "permission", "redistribut", "warrant", "rights", "domain")
SENTENCE_END = r"([.!?;:])[ \t\r]+"
BLANK_LINE = r"(?m)^[^A-Za-z0-9\n]+$"


def table() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """(sentences, rules): those above, the Creative Commons notices and the SPDX tags."""
    sentences, more = dict(SENTENCES), []
    for short, name in CREATIVE.items():
        licence, low = f"CC-{short}-4.0", short.lower()
        sentences |= {f"cc-{low}": f"Licensed under CC {short} 4.0", f"cc-{low}-is": f"This work is licensed under CC {short} 4.0", f"cc-{low}-work": f"This work is licensed under a Creative Commons {name} 4.0 International License"}
        more += [(licence, (f"cc-{low}",)), (licence, (f"cc-{low}-is",)), (licence, (f"cc-{low}-work",))]
    every = [*RULES, *more]
    for licence in dict.fromkeys(x for x, _ in every):
        if licence != RESERVED:
            for tag in [licence, *[f"{licence}-{end}" for end in ("only", "or-later") if "GPL" in licence]]:
                sentences[f"spdx-{tag.lower()}"] = f"SPDX-License-Identifier: {tag}"
                more.append((licence, (f"spdx-{tag.lower()}",)))
    return sentences, (*RULES, *more)


def _plain(x: str) -> str:
    return re.sub(r"^[0-9]{1,2} ", "", re.sub(r"[^a-z0-9]+", " ", x.lower()).strip())


def _pieces(text: str) -> list[str]:
    """A sentence cut as texts are: one with inner ends is known by its pieces."""
    return [p for p in (_plain(x) for x in re.sub(SENTENCE_END, "\\1\n", text).split("\n")) if p]


def known() -> dict[str, str]:
    """Identifier of each known piece of a sentence; sentences share pieces of the same words."""
    found: dict[str, str] = {}
    for name, text in table()[0].items():
        for i, x in enumerate(_pieces(text)):
            found.setdefault(x, name if i == 0 else f"{name}+{i}")
    return found


def rules() -> list[tuple[str, str, str, list[str]]]:
    """(licence, name of the rule, its sequence as matched: ',a,b,', the longer sequences that contain it, longest first)."""
    ids, (sentences, every) = known(), table()
    found = [(x, " > ".join(names), "," + ",".join(ids[p] for n in names for p in _pieces(sentences[n])) + ",") for x, names in every]
    assert all(any(w in sentences[n].lower() for n in names for w in WORDS) for _, names in every)
    longer = sorted({seq for *_, seq in found}, key=lambda q: (-len(q), q))
    return [(x, name, seq, [q for q in longer if q != seq and seq in q]) for x, name, seq in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence: id, licence, rule (the longest that holds), sentences (in that rule)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    docs = docs.where(F.col("text").rlike("(?i)" + "|".join(WORDS)))
    ended = lambda c: F.regexp_replace(c, SENTENCE_END, "$1\n")
    unwrapped = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r", ""), "(?d)" + BLANK_LINE, ""), r"([^\n])\n([^\n])", "$1 $2")
    forms = docs.select("id", F.posexplode(F.array(ended(F.col("text")), ended(unwrapped))).alias("form", "text"))
    sentences = forms.select("id", "form", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    plain = F.regexp_replace(F.btrim(F.regexp_replace(F.lower("sentence"), "[^a-z0-9]+", " ")), "^[0-9]{1,2} ", "")
    table = F.broadcast(spark.createDataFrame(list(known().items()), "plain string, sid string"))  # a constant
    met = sentences.select("id", "form", "pos", plain.alias("plain")).join(table, "plain")
    order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sid"))), lambda x: x["sid"])
    texts = met.groupBy("id", "form").agg(F.concat(F.lit(","), F.array_join(order, ","), F.lit(",")).alias("seq"))
    def apart(longer: list[str]):
        rest = F.col("seq")
        for q in longer:
            rest = F.replace(rest, F.lit(q), F.lit(",,"))
        return rest

    def hit(licence: str, name: str, seq: str, longer: list[str]):
        own = F.contains(apart(longer), F.lit(seq))
        over = reduce(lambda x, q: x | F.contains("seq", F.lit(q)), longer, F.lit(False))
        return F.when(own | over, F.struct(F.lit(licence).alias("licence"), F.lit(seq.count(",") - 1).alias("n"), F.lit(name).alias("rule"), own.alias("own"), over.alias("over")))

    held = texts.select("id", F.explode(F.array_compact(F.array(*[hit(*r) for r in rules()]))).alias("h")).select("id", "h.*")
    # where a longer rule holds in one way of cutting, that way decides
    held = held.groupBy("id", "licence", "n", "rule").agg(F.bool_or("over").alias("over"), F.bool_or("own").alias("own"), F.bool_or(F.col("own") & F.col("over")).alias("both"))
    best = held.where("if(over, both, own)").groupBy("id", "licence").agg(F.max(F.struct("n", "rule")).alias("b"))
    granted = F.max((F.col("licence") != RESERVED).cast("int")).over(Window.partitionBy("id"))
    best = best.withColumn("granted", granted).where((F.col("licence") != RESERVED) | (F.col("granted") == 0))
    return best.select("id", "licence", "b.rule", F.col("b.n").cast("long").alias("sentences"))


def _sql() -> str:
    words = ", ".join(f"('{a}', '{b}')" for a, b in known().items())
    listed = lambda longer: "[" + ", ".join(f"'{q}'" for q in longer) + "]::VARCHAR[]"
    rule = ", ".join(f"('{a}', '{b}', '{c}', {c.count(',') - 1}, {listed(d)})" for a, b, c, d in rules())
    return rf"""
WITH known(plain, sid) AS (VALUES {words}), rules(licence, rule, seq, n, longer) AS (VALUES {rule}),
forms AS (
  SELECT doc_id, 0 AS form, text FROM documents UNION ALL
  SELECT doc_id, 1, regexp_replace(regexp_replace(replace(text, chr(13), ''), '{BLANK_LINE}', '', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g') FROM documents),
cut AS (SELECT doc_id, form, string_split(regexp_replace(text, '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)) AS s FROM forms),
each AS (SELECT doc_id, form, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM cut),
met AS (SELECT doc_id, form, pos, sid FROM each JOIN known ON regexp_replace(trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')), '^[0-9]{{1,2}} ', '') = plain),
texts AS (SELECT doc_id, form, ',' || string_agg(sid, ',' ORDER BY pos) || ',' AS seq FROM met GROUP BY doc_id, form),
each_rule AS (
  SELECT doc_id, licence, rule, n, contains(list_reduce(list_prepend(t.seq, r.longer), lambda a, q: replace(a, q, ',,')), r.seq) AS own, len(list_filter(r.longer, lambda q: contains(t.seq, q))) > 0 AS over FROM texts t, rules r),
held AS (SELECT doc_id, licence, rule, n FROM each_rule GROUP BY ALL HAVING CASE WHEN bool_or(over) THEN bool_or(own AND over) ELSE bool_or(own) END)
SELECT doc_id, licence, rule, n::BIGINT AS sentences FROM held
QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY n DESC, rule DESC) = 1 AND (licence <> '{RESERVED}' OR NOT bool_or(licence <> '{RESERVED}') OVER (PARTITION BY doc_id))
"""


ORACLE_SQL = _sql()
