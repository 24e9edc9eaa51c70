"""Licence scans by sentence rules, by DataFrame functions alone.

A text is normalised: A-Z lowered, words of a-z and 0-9 with one space between, and ``|`` where a sentence ends.
Sentences end at . ! ? : ; before white space or the end and at blank lines; a line end alone ends none, nor does the
stop of "v." before a number. Known licence sentences are recognised wherever their words stand within a text's, under
a heading, in a comment or before "see LICENSE" as well, the longest of those that begin at a word. The sequence of
their identifiers is matched against ordered licence rules, longest first; each match uses up its sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Sentences of public licences and of usual licence notices, by identifier.
SENTENCES = {
    "mit_short": ["Released under the MIT License", "Licensed under the MIT License", "Distributed under the MIT License", "Available under the MIT License", "Licensed under the terms of the MIT License"],
    "mit_grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit0_grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit_as_is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "bsd_redist": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd_endorse": ["nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_short_2": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", 'Licensed under the BSD 2-Clause "Simplified" License'],
    "bsd_short_3": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", 'Licensed under the BSD 3-Clause "New" or "Revised" License'],
    "apache_short": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Distributed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "Released under the Apache License 2.0", "Licensed under the Apache 2.0 License"],
    "apache_terms": ["you may not use this file except in compliance with the License", "you may not use these files except in compliance with the License"],
    "apache_copy": ["You may obtain a copy of the License at"],
    "apache_as_is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache_title": ["Apache License\nVersion 2.0, January 2004"],
    "gpl3_short": ["Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "Released under the GNU General Public License v3.0"],
    "gpl2_short": ["Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "Licensed under the GNU General Public License v2.0", "Released under the GNU General Public License v2.0"],
    "gpl_terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl_terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl_terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "later_2": ["either version 2 of the License, or (at your option) any later version"],
    "later_21": ["either version 2.1 of the License, or (at your option) any later version"],
    "later_3": ["either version 3 of the License, or (at your option) any later version"],
    "gpl3_title": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "gpl2_title": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"],
    "lgpl3_title": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "lgpl21_title": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"],
    "agpl3_title": ["GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl_short": ["Licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License v3.0"],
    "lgpl21_short": ["Licensed under the GNU Lesser General Public License, version 2.1", "Licensed under the GNU Lesser General Public License v2.1"],
    "agpl_short": ["Licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License v3.0"],
    "mpl_short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "mpl_title": ["Mozilla Public License Version 2.0"],
    "epl_short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_as_is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "isc_short": ["Licensed under the ISC License", "Released under the ISC License"],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost_short": ["Distributed under the Boost Software License, Version 1.0"],
    "boost_title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by_nc_sa": ["Licensed under CC BY-NC-SA 4.0", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc_by_nc_nd": ["Licensed under CC BY-NC-ND 4.0", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc_by_nd": ["Licensed under CC BY-ND 4.0", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc_by": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["Licensed under CC0 1.0", "dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
#: Ordered rules, the licence and its sentences in their order.
RULES = [
    ("BSD-4-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("Apache-2.0", ["apache_short", "apache_terms", "apache_copy", "apache_as_is"]),
    ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is"]),
    ("GPL-3.0-or-later", ["gpl_terms", "later_3", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl_terms", "later_2", "gpl_hope"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "later_3", "gpl_hope"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "later_21", "gpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "later_3", "gpl_hope"]),
    ("MIT-0", ["mit0_grant", "mit_as_is"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("GPL-3.0-or-later", ["gpl_terms", "later_3"]),
    ("GPL-2.0-or-later", ["gpl_terms", "later_2"]),
    ("LGPL-3.0-or-later", ["lgpl_terms", "later_3"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "later_21"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "later_3"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_short"]),
    ("BSD-2-Clause", ["bsd_short_2"]),
    ("BSD-3-Clause", ["bsd_short_3"]),
    ("Apache-2.0", ["apache_short"]),
    ("Apache-2.0", ["apache_title"]),
    ("GPL-3.0-only", ["gpl3_short"]),
    ("GPL-2.0-only", ["gpl2_short"]),
    ("LGPL-3.0-only", ["lgpl_short"]),
    ("LGPL-2.1-only", ["lgpl21_short"]),
    ("AGPL-3.0-only", ["agpl_short"]),
    ("GPL-3.0-only", ["gpl3_title"]),
    ("GPL-2.0-only", ["gpl2_title"]),
    ("LGPL-3.0-only", ["lgpl3_title"]),
    ("LGPL-2.1-only", ["lgpl21_title"]),
    ("AGPL-3.0-only", ["agpl3_title"]),
    ("MPL-2.0", ["mpl_short"]),
    ("MPL-2.0", ["mpl_title"]),
    ("EPL-2.0", ["epl_short"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_short"]),
    ("BSL-1.0", ["boost_short"]),
    ("BSL-1.0", ["boost_title"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa"]),
    ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd"]),
    ("CC-BY-ND-4.0", ["cc_by_nd"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("LicenseRef-All-Rights-Reserved", ["reserved"]),
]
#: A full stop that ends no sentence: of "v." before a number.
VERSION_STOP = "(?<![a-z0-9])v\\.(?=[^a-z0-9]+[0-9])"
ENDS = "[.!?:;]+(?:[\\x20\\x09-\\x0D]+|$)|\\x0A[\\x20\\x09\\x0D]*\\x0A"


def normal(text: str) -> str:
    """What ``normalised`` makes of a text, in Python."""
    t = re.sub(ENDS, "|", re.sub(VERSION_STOP, "v", text.lower().replace("|", " ")))
    return re.sub(" ?[|][| ]*", " | ", re.sub("[^a-z0-9|]+", " ", t)).strip(" |")


KNOWN = {normal(s): name for name, texts in SENTENCES.items() for s in texts}
#: One word of every known sentence: a text without any of them has none of the sentences, so that it is not looked at.
#: Most have one of the stems, the others give their longest word.
STEMS = "licen|permi|redistrib|warrant|copyright|software|public"
HINTS = "|".join([STEMS, *sorted({max(re.findall("[a-z0-9]+", s), key=len) for s in KNOWN if not re.search(STEMS, s)})])
#: The longest sentence that begins at a word.
ANY_KNOWN = "\\b(?:" + "|".join(re.escape(s).replace("\\ ", " ") for s in sorted(KNOWN, key=lambda s: (-len(s), s))) + ")\\b"
PATTERNS = [(name, "".join(f" {s} " for s in ids)) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]


def normalised(text):
    lowered = F.regexp_replace(F.translate(F.lower(text), "|", " "), VERSION_STOP, "v")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, ENDS, "|"), "[^a-z0-9|]+", " "), " ?[|][| ]*", " | ")


def _licences(sequence):
    """Licences whose rules the sequence meets, in rule order; a match uses up its sentences."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in PATTERNS])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        met = F.contains(acc["left"], rule["pattern"])
        return F.struct(
            F.when(met, F.replace(acc["left"], rule["pattern"], F.lit(" # "))).otherwise(acc["left"]).alias("left"),
            F.when(met, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    return F.when(sequence == "", F.array().cast("array<string>")).otherwise(F.aggregate(rules, start, step, lambda acc: acc["found"]))


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, sentences (array: identifiers of the known sentences, in text order), licenses (array, sorted, distinct)
    for each row.

    Null and empty texts have none; whole texts count, however long. Repeated rows come out alike; an empty table gives
    an empty result; other columns are not looked at. There is no shuffle: every row is judged where it is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    found = F.transform(F.regexp_extract_all(normalised(text), F.lit(ANY_KNOWN), F.lit(0)), lambda x: F.element_at(table, x))
    some = docs.select(F.col(id_col).alias("doc_id"), F.when(F.lower(text).rlike(HINTS), found).otherwise(F.array().cast("array<string>")).alias("sentences"))
    # Identifiers, each between two spaces.
    sequence = F.array_join(F.transform("sentences", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    seqs = some.select("doc_id", "sentences", sequence.alias("sequence"))
    return seqs.select("doc_id", "sentences", F.array_sort(F.array_distinct(_licences(F.col("sequence")))).alias("licenses"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same by DuckDB SQL, from the two tables: every known sentence is looked for in every text by its words, of
    those that begin at one place the longest stays, and what stands within one found before it goes."""
    # Spaces are doubled, so that of two sentences side by side each has its own.
    known = ", ".join(f"({_quoted(' ' + s.replace(' ', '  ') + ' ')}, {_quoted(name)})" for s, name in KNOWN.items())
    # In DuckDB, without look-behind: a "v." is preceded by what is no word character.
    words = "regexp_replace(' ' || replace(lower(coalesce(text, '')), '|', ' '), '([^a-z0-9])v\\.([^a-z0-9]+[0-9])', '\\1v\\2', 'g')"
    ends = f"regexp_replace({words}, '{ENDS}', '|', 'g')"
    plain = f"regexp_replace(regexp_replace({ends}, '[^a-z0-9|]+', ' ', 'g'), ' ?[|][| ]*', ' | ', 'g')"
    sql = f"""WITH known(words, name) AS (VALUES {known}),
 d AS (SELECT row_number() OVER () AS row, doc_id, replace({plain} || ' ', ' ', '  ') AS t FROM documents),
 hits AS (SELECT row, name, length(words) AS n, unnest(list_transform(range(1, len(string_split(t, words))), lambda k: (k - 1) * length(words) + list_sum(list_transform(string_split(t, words)[1:k], lambda x: length(x))))) AS place
  FROM d JOIN known ON contains(t, words)),
 longest AS (SELECT row, place, max(n) AS n, arg_max(name, n) AS name FROM hits GROUP BY row, place),
 apart AS (SELECT *, max(place + n) OVER (PARTITION BY row ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM longest),
 s AS (SELECT row, array_to_string(list(name ORDER BY place), ',') AS sentences, array_to_string(list(' ' || name || ' ' ORDER BY place), '') AS q0 FROM apart WHERE busy IS NULL OR place >= busy GROUP BY row)"""
    previous, parts = "s", []
    for k, (name, pattern) in enumerate(PATTERNS):
        parts.append(f"CASE WHEN contains(q{k}, {_quoted(pattern)}) THEN {_quoted(name)} END")
        sql += f", s{k} AS (SELECT *, replace(q{k}, {_quoted(pattern)}, ' # ') AS q{k + 1} FROM {previous})"
        previous = f"s{k}"
    every = ", ".join(parts)
    return sql + f" SELECT d.doc_id, coalesce(sentences, '') AS sentences, coalesce(array_to_string(list_sort(list_distinct(list_filter([{every}], lambda x: x IS NOT NULL))), ','), '') AS licenses FROM d LEFT JOIN {previous} USING (row)"
