"""License recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences, each normalised (lower case, runs of other characters than letters and
digits as one space) and mapped to the identifier of a known licence sentence, or ``?``. The sequence
of identifiers is matched against ordered rules, the most specific first: a rule's identifiers must
follow in order with at most ``GAP`` unknown sentences between two of them; what a rule has matched
is taken out before the next one looks. Texts are read by lines and with wrapped lines joined; the
reading with more known sentences counts, by lines if equal. Where the other reading knows sentences
besides, they are put in their places: a joined sentence that is known counts as one, and a joined
sentence that is not is read by lines if it has a known line.

Edge cases: a null or empty text has one empty sentence and no licence. Sentences of any length are
normalised before they are looked up, so filling around or inside a known one does not hide it.
Repeated rows are scanned each. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2
UNKNOWN = "?"
#: Only texts that hold one of these are cut into sentences; every known sentence holds one, wrapped or not.
CUES = r"(?i)licen[cs]|copyright|warrant|redistribut|permission|public[^a-z0-9]+domain|all[^a-z0-9]+rights[^a-z0-9]+reserved|copy[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+mpl|held[^a-z0-9]+liable"

#: Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "all-rights": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-line": "Licensed under the BSD 3-Clause License.",
    "bsd2-line": "Licensed under the BSD 2-Clause License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-line": "This work has been dedicated to the public domain under CC0 1.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0.",
    "isc-line": "Licensed under the ISC License.",
    "mpl-line": "Licensed under the Mozilla Public License 2.0.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-line": "Licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-line": "Licensed under the GNU Affero General Public License, version 3.",
    "epl2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-line": "Licensed under the Eclipse Public License 2.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-line": "Licensed under the zlib License.",
    "boost-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
#: Identifiers of the public licence list, which files name in a line of their own.
SPDX = (
    "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
)
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}

#: Rules in the order they are tried: licence, identifiers in order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-line",)),
    ("BSD-2-Clause", ("bsd2-line",)),
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-head",)),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-head",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-line",)),
    ("ISC", ("isc-line",)),
    ("MPL-2.0", ("mpl-line",)),
    ("LGPL-3.0-only", ("lgpl3-line",)),
    ("AGPL-3.0-only", ("agpl3-line",)),
    ("EPL-2.0", ("epl2-head",)),
    ("EPL-2.0", ("epl2-line",)),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-line",)),
    ("BSL-1.0", ("boost-line",)),
    ("BSL-1.0", ("boost-grant",)),
    *((x, (f"spdx-{x}",)) for x in SPDX),
    ("proprietary", ("all-rights",)),
)

#: A sentence ends at a line's end and at a blank after . ! or ?
BREAK = r"(?<=[.!?])[ \t]+|[\r\n]+"
#: A line's end inside a paragraph, for texts that are wrapped.
WRAP = r"(?<![\r\n])\r?\n(?![\r\n])"

#: Where a text breaks with wrapped lines joined: a blank or wrap after . ! or ?, and line ends that are no wrap.
PARAGRAPH_BREAK = r"(?<=[.!?])(?:[ \t]|(?<![\r\n])\r?\n(?![\r\n]))+|(?<![\r\n])(?!\r?\n(?![\r\n]))[\r\n]+"


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def normalised_text(sentence: str) -> str:
    """``normalised`` for the table's own sentences."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def table() -> dict[str, str]:
    """Normalised sentence to identifier. A known sentence that ``BREAK`` would cut is known by its parts' first."""
    import re

    out: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        out.setdefault(normalised_text(re.split(BREAK, sentence)[0]), name)
    return out


def sentence_ids(text: Column) -> Column:
    known = table()
    names = F.array(*[F.lit(x) for x in known])
    ids = F.array(*[F.lit(x) for x in known.values()])
    at = F.transform(F.split(text, BREAK), lambda s: F.array_position(names, normalised(s)))
    return F.transform(at, lambda k: F.when(k > 0, F.element_at(ids, k.cast("int"))).otherwise(F.lit(UNKNOWN)))


def both_readings(text: Column, by_lines: Column) -> Column:
    """Identifiers of the joined sentences, and of the lines of those that are unknown and have a known line (of all unknown ones if ``by_lines``)."""
    known = lambda c: F.exists(c, lambda x: x != UNKNOWN)
    pieces = F.transform(F.split(text, PARAGRAPH_BREAK), lambda p: F.struct(sentence_ids(F.regexp_replace(p, WRAP, " ")).alias("joined"), sentence_ids(p).alias("lines")))
    return F.flatten(F.transform(pieces, lambda p: F.when(~known(p["joined"]) & (by_lines | known(p["lines"])), p["lines"]).otherwise(p["joined"])))


def rule_pattern(ids: tuple[str, ...], gap: int) -> str:
    return "(?<= )" + (r" (?:\? ){0,%d}" % gap).join(ids) + "(?= )"


def scan_licenses(docs: DataFrame, text: str = "text", gap: int = GAP) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses (in rule order, joined by commas), license (the first)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    read = docs.select("doc_id", whole.alias("whole"), F.when(whole.rlike(CUES), sentence_ids(whole)).otherwise(none).alias("lines"), F.when(whole.rlike(CUES), sentence_ids(F.regexp_replace(whole, WRAP, " "))).otherwise(none).alias("joined"))
    known = lambda c: F.size(F.filter(c, lambda x: x != UNKNOWN))
    more = known("joined") > known("lines")
    names_of = lambda c: F.filter(c, lambda x: x != UNKNOWN)
    differ = (known("joined") > 0) & (known("lines") > 0) & (names_of("joined") != names_of("lines"))
    found = read.select("doc_id", "whole", F.when(more, F.col("joined")).otherwise(F.col("lines")).alias("one"), F.when(differ, both_readings(F.col("whole"), ~more)).alias("both"))
    found = found.select("doc_id", "whole", F.when(F.col("both").isNotNull() & (known("both") > known("one")), F.col("both")).otherwise(F.col("one")).alias("ids"))
    found = found.select("doc_id", F.when(F.size("ids") > 0, F.size("ids")).otherwise(F.size(F.split("whole", BREAK))).cast("long").alias("n_sentences"), F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")).alias("line"), F.array_join(F.filter("ids", lambda x: x != UNKNOWN), ",").alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(ids, gap)).alias("pattern")) for name, ids in RULES])
    start = F.struct(F.col("line").alias("line"), F.array().cast("array<string>").alias("names"))
    step = lambda s, r: F.when(F.regexp_like(s["line"], r["pattern"]), F.struct(F.regexp_replace(s["line"], r["pattern"], "-").alias("line"), F.array_union(s["names"], F.array(r["name"])).alias("names"))).otherwise(s)
    names = F.when(F.col("sentence_ids") != "", F.aggregate(rules, start, step)["names"]).otherwise(F.array().cast("array<string>"))
    out = found.withColumn("names", names)
    return out.select("doc_id", "n_sentences", "sentence_ids", F.array_join("names", ",").alias("licenses"), F.get("names", F.lit(0)).alias("license"))
