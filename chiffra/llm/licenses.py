"""Operator 3, licence scans by sentence rules.

A text is cut into sentences at blank lines and after . : ; ! ? before white space, once marks of comments at the start
of lines are gone; a sentence is normalised (A-Z lowered, anything but a-z and 0-9 to one blank) and looked up among
known licence sentences. A line end is a cut only where that finds more: the longest tail of a sentence that starts at a
line and is known counts as a sentence of its own, and each line before it, or each line where no tail is known, is
looked up by itself. So wrapped licence texts are found as well as notices of one line without a full stop. ``HOLES`` come
before that: whoever stands where a licence names its holder is replaced by the words of the licence, a copyright line
and the openings of some licences are cuts, and an SPDX tag or a "License:" line becomes a sentence of its own.

The identifiers found, in order, are matched against ordered licence rules: a rule names successive identifiers, some of
them optional; it claims every such run, and what it has claimed is closed to the rules after it. Identifiers with more
than ``GAP`` unknown sentences between them aren't successive. Identifiers that no rule claims are "unmatched".

All of it is built-in expressions. Every known sentence holds one of ``ANCHORS``, so texts without any are skipped
without being cut; that loses nothing. A known sentence has at most ``MOST_WORDS`` words, so longer tails need no look;
apart from that texts are read whole, however long. Null and empty texts have no sentences; every row comes back,
repeated rows too, and an empty table gives an empty result. A sentence has one identifier, so there are no ties.
Columns may have any names: they travel in one struct.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents

#: Known sentences, normalised, by identifier: fixed values, the words of the licences themselves and of their notices.
SENTENCES = {
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice-kept": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2-file": ["licensed under the apache license version 2 0 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache2-title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "apache2-terms": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "gpl-free": ["this program is free software", "this file is free software", "this software is free software", "this library is free software"],
    "gpl-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3-terms-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl3-terms-only": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license", "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"],
    "gpl2-terms-only": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl3-terms-later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-terms-later": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "v2-later": ["either version 2 of the license or at your option any later version", "either version 2 or at your option any later version of the license"],
    "v2-1-later": ["either version 2 1 of the license or at your option any later version"],
    "v3-later": ["either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "gpl-fitness": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu lesser general public license along with this program", "you should have received a copy of the gnu affero general public license along with this program"],
    "gpl-verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl3-is": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "gpl2-title": ["gnu general public license version 2 june 1991"],
    "lgpl3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "agpl3-title": ["gnu affero general public license version 3 19 november 2007"],
    "gpl-freedom": ["the licenses for most software are designed to take away your freedom to share and change it"],
    "mpl2-terms": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-obtain": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "mpl2-title": ["mozilla public license version 2 0"],
    "epl2-terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services", "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0-waived": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["all rights reserved"],
}

#: Names that notices of one line use, by identifier: fixed values.
NAMES = {
    "mit-notice": ["the mit license"],
    "apache2-notice": ["the apache license version 2 0", "the apache license 2 0", "apache 2 0"],
    "gpl3-notice": ["the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl v3", "gpl 3 0"],
    "gpl2-notice": ["the gnu general public license version 2", "the gnu general public license v2", "the gnu gpl v2", "gpl 2 0"],
    "lgpl3-notice": ["the gnu lesser general public license version 3", "the gnu lesser general public license v3"],
    "lgpl21-notice": ["the gnu lesser general public license version 2 1", "the gnu lesser general public license v2 1"],
    "agpl3-notice": ["the gnu affero general public license version 3", "the gnu affero general public license v3"],
    "mpl2-notice": ["the mozilla public license 2 0", "the mozilla public license version 2 0"],
    "bsd3-notice": ["the bsd 3 clause license"],
    "bsd2-notice": ["the bsd 2 clause license"],
    "isc-notice": ["the isc license"],
    "ccby4-notice": ["cc by 4 0", "a creative commons attribution 4 0 international license", "the creative commons attribution 4 0 international license"],
    "ccbysa4-notice": ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "the creative commons attribution sharealike 4 0 international license"],
    "ccbync4-notice": ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "the creative commons attribution noncommercial 4 0 international license"],
    "ccbyncsa4-notice": ["cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"],
    "ccbyncnd4-notice": ["cc by nc nd 4 0", "a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "ccbynd4-notice": ["cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"],
    "cc0-notice": ["cc0 1 0"],
}
_VERBS = ["licensed under", "released under", "distributed under", "available under"]
FRAMES = [*_VERBS, *(f"{v} the terms of" for v in _VERBS), *(f"this {x} is {y} under" for x in ("work", "project", "software", "code", "file", "text", "document") for y in ("licensed", "released", "distributed"))]
SENTENCES |= {k: [f"{f} {n}" for f in FRAMES for n in names] for k, names in NAMES.items()}

#: What a tag or a "License:" line may call a licence, by identifier: fixed values.
SHORT = {
    "mit-notice": ["mit"],
    "apache2-notice": ["apache 2 0", "apache2", "apache license 2 0", "apache license version 2 0"],
    "gpl3-notice": ["gplv3", "gpl v3", "gpl 3 0", "gpl 3 0 only", "gnu gplv3"],
    "gpl3-terms-later": ["gplv3+", "gpl 3 0 or later", "gpl 3 0+"],
    "gpl2-notice": ["gplv2", "gpl v2", "gpl 2 0", "gpl 2 0 only", "gnu gplv2"],
    "gpl2-later": ["gplv2+", "gpl 2 0 or later", "gpl 2 0+"],
    "lgpl3-notice": ["lgplv3", "lgpl 3 0", "lgpl 3 0 only"],
    "lgpl21-notice": ["lgplv2 1", "lgpl 2 1", "lgpl 2 1 only"],
    "agpl3-notice": ["agplv3", "agpl 3 0", "agpl 3 0 only"],
    "mpl2-notice": ["mpl 2 0", "mplv2"],
    "bsd3-notice": ["bsd 3 clause"],
    "bsd2-notice": ["bsd 2 clause"],
    "isc-notice": ["isc"],
    "ccby4-notice": ["cc by 4 0"],
    "ccbysa4-notice": ["cc by sa 4 0"],
    "cc0-notice": ["cc0 1 0"],
    "unlicense-domain": ["unlicense"],
    "0bsd-notice": ["0bsd"],
    "zlib-notice": ["zlib"],
}
SENTENCES |= {k: [*SENTENCES.get(k, []), *(f"license is {n[:-1]} or newer" if n.endswith("+") else f"license is {n}" for n in names)] for k, names in SHORT.items()}

#: Ordered rules: (licence, the successive identifiers it claims; ``?`` marks optional ones). Longer forms come before the
#: forms they contain.
_GPL = ["gpl-hope?", "gpl-fitness?", "gpl-see?", "gpl-received?"]
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is?", "bsd-liability?"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "bsd-liability?"]),
    ("MIT", ["mit-notice?", "mit-title?", "mit-grant", "mit-notice-kept", "mit-as-is?", "mit-liability?"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms?"]),
    ("Apache-2.0", ["apache2-file", "apache2-use?", "apache2-copy?", "apache2-as-is?", "apache2-see?"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("GPL-3.0-or-later", ["gpl-free?", "gpl3-terms-later", *_GPL]),
    ("GPL-3.0-or-later", ["gpl-free?", "gpl-terms", "v3-later", *_GPL]),
    ("GPL-2.0-or-later", ["gpl-free?", "gpl-terms", "v2-later", *_GPL]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-only", ["gpl-free?", "gpl3-terms-only", *_GPL]),
    ("GPL-2.0-only", ["gpl-free?", "gpl2-terms-only", *_GPL]),
    ("LGPL-3.0-or-later", ["gpl-free?", "lgpl3-terms-later", *_GPL]),
    ("LGPL-3.0-or-later", ["gpl-free?", "lgpl-terms", "v3-later", *_GPL]),
    ("LGPL-2.1-or-later", ["gpl-free?", "lgpl-terms", "v2-1-later", *_GPL]),
    ("AGPL-3.0-or-later", ["gpl-free?", "agpl3-terms-later", *_GPL]),
    ("GPL-3.0-only", ["gpl3-title", "gpl-verbatim?", "gpl3-is?", "gpl-freedom?"]),
    ("GPL-2.0-only", ["gpl2-title", "gpl-verbatim?", "gpl-freedom?"]),
    ("LGPL-3.0-only", ["lgpl3-title", "gpl-verbatim?"]),
    ("LGPL-2.1-only", ["lgpl21-title", "gpl-verbatim?", "gpl-freedom?"]),
    ("AGPL-3.0-only", ["agpl3-title", "gpl-verbatim?", "gpl-freedom?"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("LGPL-3.0-only", ["lgpl3-notice"]),
    ("LGPL-2.1-only", ["lgpl21-notice"]),
    ("AGPL-3.0-only", ["agpl3-notice"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-obtain?"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("ISC", ["isc-notice?", "isc-grant", "isc-as-is?"]),
    ("ISC", ["isc-notice"]),
    ("0BSD", ["0bsd-grant", "isc-as-is?"]),
    ("0BSD", ["0bsd-notice"]),
    ("Zlib", ["zlib-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("BSL-1.0", ["bsl-grant", "mit-as-is?"]),
    ("Unlicense", ["unlicense-domain", "unlicense-grant?", "mit-as-is?", "mit-liability?"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-notice"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-ND-4.0", ["ccbynd4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("LicenseRef-AllRightsReserved", ["reserved"]),
]
#: Words of which every known sentence holds one.
ANCHORS = ("licens", "permi", "redistribut", "warrant", "rights", "neither", "liable", "software", "distributed", "released", "available")
#: Unknown sentences that may stand between successive identifiers.
GAP = 3
#: At the start of a line: what marks a comment.
COMMENT = r"(^|\n)[ \t]*(?:<!--|-->|//+|/\*+|\*+/?|#+|;+|--+|%+|>+)?[ \t]*"
_GAP = "[ \\t\\r\\n]+"
#: Replaced in the lower-cased text, in this order: (pattern, replacement), where {cut} ends a sentence and {1} is a group.
HOLES = [
    (f"neither{_GAP}the{_GAP}names?{_GAP}of{_GAP}.{{1,200}}?{_GAP}nor{_GAP}the{_GAP}names{_GAP}of{_GAP}(?:its|their|any|the){_GAP}contributors", "{cut}neither the name of the copyright holder nor the names of its contributors"),
    (r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)\)?(?:[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?)?", "{cut}license is {1}{cut}license is {2}{cut}"),
    (r"(^|\n)[ \t]*licen[sc]e[ \t]*:[ \t]*([a-z0-9])", "{cut}license is {2}"),
    (r"(license is [a-z0-9. -]+)\+", "{1} or newer"),
    (r"(copyright[ \t]+(?:\(c\)|©)?[ \t]*[12][0-9]{3})", "{cut}{1}"),
    (f"(permission{_GAP}is{_GAP}hereby{_GAP}granted|permission{_GAP}to{_GAP}use,{_GAP}copy|redistribution{_GAP}and{_GAP}use{_GAP}in{_GAP}source)", "{cut}{1}"),
]
BLANK_LINES, STOPS = r"\n(?:[ \t\r]*\n)+", r"[.:;!?]+(?:[ \t\r\n]+|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(s: str) -> str:
    out = "".join(c if c in LOWER or c.isascii() and c.isdigit() else " " for c in s.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(out.split())


KNOWN = {s: k for k, v in SENTENCES.items() for s in v}
MOST_WORDS = max(len(s.split()) for s in KNOWN)
assert all(s == normal(s) and any(a in s for a in ANCHORS) for s in KNOWN)
assert {x.rstrip("?") for _, seq in RULES for x in seq} <= set(SENTENCES)
_IDS = "array<struct<sentence:int,id:string>>"


def sentence_ids(text: Column) -> Column:
    """array<struct<sentence int, id string>>: the known sentences of a text, by the number, from 0, of the sentence they lie in."""
    low = F.translate(text, UPPER, LOWER)
    maybe = F.lit(False)
    for word in ANCHORS:
        maybe = maybe | F.contains(low, F.lit(word))
    known = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    marked = F.regexp_replace(low, COMMENT, "$1")
    for pattern, by in HOLES:
        marked = F.regexp_replace(marked, f"(?s){pattern}", by.replace("{cut}", "\x01").replace("{1}", "$1").replace("{2}", "$2"))
    marked = F.regexp_replace(F.regexp_replace(marked, BLANK_LINES, "\x01"), STOPS, "\x01")
    marked = F.regexp_replace(F.translate(marked, "\n", "\x02"), "[^a-z0-9\x01\x02]+", " ")
    lines = lambda cut: F.filter(F.transform(F.split(cut, "\x02"), lambda x: F.trim(x)), lambda x: x != "")
    look = lambda s: F.try_element_at(known, s)

    def found(part: Column) -> Column:
        n = F.size(part["lines"])
        tail = lambda k: look(F.array_join(F.slice(part["lines"], k, n - k + 1), " "))
        starts = F.sequence(F.greatest(F.lit(1), n - MOST_WORDS + 1), n)
        first = F.coalesce(F.array_min(F.filter(starts, lambda k: tail(k).isNotNull())), n + 1)
        single = F.filter(F.transform(F.slice(part["lines"], F.lit(1), first - 1), look), lambda x: x.isNotNull())
        ids = F.concat(single, F.when(first <= n, F.array(tail(first))).otherwise(F.array().cast("array<string>")))
        return F.transform(ids, lambda x: F.struct(part["sentence"].alias("sentence"), x.alias("id")))

    some = F.filter(F.transform(F.split(marked, "\x01"), lambda c: lines(c)), lambda p: F.size(p) > 0)
    parts = F.transform(some, lambda p, i: F.struct(i.alias("sentence"), p.alias("lines")))
    return F.when(maybe, F.flatten(F.transform(parts, found))).otherwise(F.array().cast(_IDS))


def in_a_row(sentences: Column) -> Column:
    """The identifiers, each between blanks, with ``|`` where too many unknown sentences lie between two."""
    gap = lambda x, i: F.when((i > 0) & (x["sentence"] - F.get(sentences, i - 1)["sentence"] > GAP + 1), "|").otherwise("")
    return F.array_join(F.transform(sentences, lambda x, i: F.concat(gap(x, i), F.lit(" "), x["id"], F.lit(" "))), "")


def _pattern(rule: list[str]) -> str:
    return "".join(f"(?: {x[:-1]} )?" if x.endswith("?") else f" {x} " for x in rule)


def licences_of(ids: Column) -> tuple[Column, Column]:
    """(licences in the order of the rules, identifiers no rule claimed) of what ``in_a_row`` gives."""
    left, found = ids, []
    for name, rule in RULES:
        found.append(F.when(left.rlike(_pattern(rule)), name))
        left = F.regexp_replace(left, _pattern(rule), "|")
    return F.array_distinct(F.array_compact(F.array(*found))), F.trim(F.regexp_replace(left, "[| ]+", " "))


def scan(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``sentences``, ``licenses`` and ``unmatched``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("sentences", F.coalesce(sentence_ids(F.col("row.text")), F.array().cast(_IDS)))
    # Nearly all rows stop here: the rules are tried on rows with identifiers only.
    some = F.size("sentences") > 0
    rows = rows.withColumn("ids", F.when(some, in_a_row(F.col("sentences"))).otherwise(""))
    found, rest = licences_of(F.col("ids"))
    return rows.select("row", "sentences", F.when(some, found).otherwise(F.array().cast("array<string>")).alias("licenses"), F.when(some, rest).otherwise("").alias("unmatched"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))
    ids = F.array_join(F.transform("sentences", lambda x: F.concat(x["sentence"].cast("string"), F.lit(":"), x["id"])), " ")
    return out.select("row.doc_id", F.size("sentences").cast("long").alias("n_sentences"), ids.alias("sentence_ids"), F.array_join("licenses", ", ").alias("licenses"), "unmatched")


def _sql() -> str:
    rows = ", ".join(f"('{s}', '{k}')" for s, k in KNOWN.items())
    bare = f"regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '{COMMENT}', '\\1', 'g')"
    for pattern, by in HOLES:
        new = by.replace("{cut}", "' || chr(1) || '").replace("{1}", "\\1").replace("{2}", "\\2")
        bare = f"regexp_replace({bare}, '(?s){pattern}', '{new}', 'g')"
    steps, prev = [], "m0"
    for k, (name, rule) in enumerate(RULES):
        p = _pattern(rule)
        steps.append(f"m{k + 1} as (select doc_id, n, ids, regexp_replace(rest, '{p}', '|', 'g') rest, case when regexp_matches(rest, '{p}') and not list_contains(found, '{name}') then list_append(found, '{name}') else found end found from {prev})")
        prev = f"m{k + 1}"
    return f"""
with known(s, id) as (values {rows}),
d as (select row_number() over () r, doc_id, text from documents),
marked as (select r, translate(regexp_replace(regexp_replace({bare}, '{BLANK_LINES}', chr(1), 'g'), '{STOPS}', chr(1), 'g'), chr(10), chr(2)) t from d),
cut as (select r, unnest(parts) part, unnest(range(len(parts))) pos from (select r, string_split(regexp_replace(t, '[^a-z0-9' || chr(1) || chr(2) || ']+', ' ', 'g'), chr(1)) parts from marked)),
l as (select r, row_number() over (partition by r order by pos) - 1 pos, ls from (select r, pos, list_filter(list_transform(string_split(part, chr(2)), lambda x: trim(x)), lambda x: x <> '') ls from cut) where len(ls) > 0),
tails as (select r, pos, k, array_to_string(list_slice(ls, k, len(ls)), ' ') s from (select r, pos, ls, unnest(range(1, len(ls) + 1)) k from l)),
t as (select r, pos, min(k) k from tails join known using (s) group by 1, 2),
tailed as (select r, pos, k, id from t join tails using (r, pos, k) join known using (s)),
singles as (select r, pos, k, ls[k] s from (select l.r, l.pos, ls, unnest(range(1, coalesce(t.k, len(ls) + 1))) k from l left join t using (r, pos))),
hits as (select r, pos, k, id from tailed union all select r, pos, k, id from singles join known using (s)),
ordered as (select *, lag(pos) over (partition by r order by pos, k) prev from hits),
per as (select r, count(*) n, string_agg(pos || ':' || id, ' ' order by pos, k) ids, string_agg(case when pos - prev > {GAP + 1} then '|' else '' end || ' ' || id || ' ', '' order by pos, k) seq from ordered group by r),
m0 as (select doc_id, coalesce(n, 0) n, coalesce(ids, '') ids, coalesce(seq, '') rest, []::varchar[] found from d left join per using (r)),
{", ".join(steps)}
select doc_id, n n_sentences, ids sentence_ids, array_to_string(found, ', ') licenses, trim(regexp_replace(rest, '[| ]+', ' ', 'g')) unmatched from {prev}"""


SQL = {"op3_license_scan": _sql()}
