"""Licence recognition by sentences and ordered rules.

A text is normalised (lower case, words and digits only) with its breaks kept: line ends, and
blanks after sentence stops.  A known sentence is found from break to break, the longest
first, and may have breaks inside, so wrapped lines, comment marks and the colon of an SPDX
line do not hide it.  Names may stand in the slots of SLOTTED.  The identifiers of a text's known sentences, in order, form a
sequence, on which rules are tried in their order: longer and more special ones come first,
and what a rule has taken is not matched again.  Known sentences that no rule takes are left
over and listed as such.  n_sentences counts the pieces between breaks.

The SQL twin knows sentences without breaks inside, and of the tables SENTENCES and RULES;
tests hold the rest against notices in full.

Cases: null and empty texts have no sentences; repeated rows give equal results; an empty
table gives an empty table; columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, text_or_empty, without

# Identifier of a sentence → the sentence, normalised.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"],
    "mit-title": ["the mit license", "mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-notice": ["licensed under the apache license version 2 0", "this work is licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache2-warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "gpl3-title": ["gnu general public license version 3"],
    "gpl-any": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "ccbync4-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby4-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "reserved": ["all rights reserved"],
}

# Ordered rules, licence ← sequence of sentence identifiers.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-keep", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-warranty"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-any", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-any"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("NOASSERTION", ["reserved"]),
]

def _notices(*names: str) -> list[str]:
    return [f"{by}licensed under the {n}" for n in names for by in ("", "this work is ", "this project is ", "this software is ")] + [f"released under the {n}" for n in names]


_PROGRAM = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} public license"
_LATER = _PROGRAM + " as published by the free software foundation either version {} of the license or at your option any later version"

# Further sentences.  No identifier is the end of another one.
MORE_SENTENCES = {
    "apache2-copy": ["you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2-title": ["apache license version 2 0", "apache license version 2 0 january 2004"],
    "mit-or-apache2": ["licensed under either of apache license version 2 0 or mit license at your option"],
    "gnu-version3": ["gnu general public license version 3 29 june 2007"],
    "gnu-version2": ["gnu general public license version 2", "gnu general public license version 2 june 1991", *_notices("gnu general public license version 2")],
    "gnu-two": [_LATER.format("program", "general", 2)],
    "gnu-two-only": [(_PROGRAM + " version 2 as published by the free software foundation").format("program", "general"), (_PROGRAM + " as published by the free software foundation version 2").format("program", "general")],
    "gnu-lesser-two": [_LATER.format("library", "lesser general", "2 1")],
    "gnu-lesser-three": [_LATER.format(what, "lesser general", 3) for what in ("library", "program")],
    "gnu-lesser-title3": ["gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007"],
    "gnu-lesser-title2": ["gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1 february 1999"],
    "gnu-library-lack": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gnu-affero": [_LATER.format("program", "affero general", 3)],
    "gnu-affero-title": ["gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007"],
    "mpl2-header": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-where": [f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0" for h in ("http", "https")],
    "mpl2-name": ["mozilla public license version 2 0", *_notices("mozilla public license 2 0", "mozilla public license version 2 0")],
    "isc-name": ["isc license", *_notices("isc license")],
    "isc-permit": [f"permission to use copy modify and {o}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for o in ("", "or ")],
    "zlib-permit": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "unlicense-public": ["this is free and unencumbered software released into the public domain"],
    "boost-name": ["boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0", *_notices("boost software license version 1 0")],
    "epl2-terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "eclipse public license v 2 0"],
    "cc0-name": ["cc0 1 0 universal", "licensed under cc0 1 0", "this work is licensed under cc0 1 0"],
    "ccbysa4-name": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "bsd3-name": ["bsd 3 clause license", *_notices("bsd 3 clause license")],
    "bsd2-name": ["bsd 2 clause license", *_notices("bsd 2 clause license")],
}

# Sentences in which ... stands for a name of up to ten words.
SLOTTED = {
    "bsd-names": [
        "neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of ... may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
}

# SPDX identifiers, for lines that name them.
SPDX = (
    "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib BSL-1.0 Unlicense MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 Artistic-2.0 PostgreSQL Python-2.0 WTFPL "
    "CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 CC-BY-3.0 CC-BY-SA-3.0 OFL-1.1 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()

# Ordered rules, tried after RULES.
MORE_RULES = [
    ("GPL-2.0-or-later", ["gnu-two", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gnu-two"]),
    ("GPL-2.0-only", ["gnu-two-only", "gpl-warranty"]),
    ("GPL-2.0-only", ["gnu-two-only"]),
    ("AGPL-3.0-or-later", ["gnu-affero", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["gnu-affero"]),
    *((name, [first, *more]) for name, first in (("LGPL-2.1-or-later", "gnu-lesser-two"), ("LGPL-3.0-or-later", "gnu-lesser-three")) for more in (["gnu-library-lack"], ["gpl-warranty"], [])),
    ("MPL-2.0", ["mpl2-header", "mpl2-where"]),
    ("MPL-2.0", ["mpl2-header"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("ISC", ["isc-name", "isc-permit"]),
    ("ISC", ["isc-permit"]),
    ("ISC", ["isc-name"]),
    ("Zlib", ["zlib-permit"]),
    ("Unlicense", ["unlicense-public"]),
    ("BSL-1.0", ["boost-name"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("CC0-1.0", ["cc0-name"]),
    ("CC-BY-SA-4.0", ["ccbysa4-name"]),
    ("MIT OR Apache-2.0", ["mit-or-apache2"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0-only", ["gnu-version3"]),
    ("GPL-2.0-only", ["gnu-version2"]),
    ("LGPL-3.0-only", ["gnu-lesser-title3"]),
    ("LGPL-2.1-only", ["gnu-lesser-title2"]),
    ("AGPL-3.0-only", ["gnu-affero-title"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    *((name, [f"spdx-{name.lower()}-line"]) for name in SPDX),
]

KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
_IDENTIFIER = "spdx license identifier "
_LINES = {_IDENTIFIER + old.lower().replace("-", " ").replace(".", " "): f"spdx-{name.lower()}-line" for name in SPDX for old in {name, name.removesuffix("-only")}}
EVERY = {**_LINES, **{text: name for name, texts in SLOTTED.items() for text in texts}, **{text: name for name, texts in MORE_SENTENCES.items() for text in texts}, **KNOWN}
BREAK = r"[\r\n]+|(?<=[.!?;:])[\x20\t-\r]+"  # between sentences
_NAME = "[^ \x01]+(?:(?: \x01)? [^ \x01]+){0,9}?"


def _pattern(sentence: str) -> str:
    return sentence.replace(" ", "(?: \x01)? ").replace("...", _NAME)


#: Every known sentence from break (\x01) to break, with or without breaks inside.
SENTENCE = "(?<=\x01 )(?:" + "|".join(_pattern(t) for t in sorted(EVERY, key=lambda t: (-len(t), t))) + ")(?= \x01)"


def normalised(text: Column) -> Column:
    """Words and digits of a text with its breaks; licences of one SPDX line get one each."""
    spdx = text.rlike("(?i)spdx-license")
    low = F.lower(F.translate(text, "\x01", "\x02"))
    low = F.when(spdx, F.regexp_replace(low, r"(gpl-[0-9.]+)\+", "$1-or-later")).otherwise(low)
    words = F.regexp_replace(F.regexp_replace(low, BREAK, "\x01"), "[^\\p{L}\\p{N}\x01]+", " ")
    words = F.regexp_replace(F.concat(F.lit("\x01"), words, F.lit("\x01")), "\x20?\x01[\x20\x01]*+", " \x01 ")
    each = F.regexp_replace(words, f" (?:or|and|with) (?!later )(?<={_IDENTIFIER}(?:\x01 )?[a-z0-9 ]{{1,200}})", f" \x01 {_IDENTIFIER}")
    return F.when(spdx, F.replace(each, F.lit(_IDENTIFIER), F.lit("\x01 " + _IDENTIFIER))).otherwise(words)


def _unnamed(sentence: Column) -> Column:
    """The sentence as it is known: names go back to their slot."""
    for text in (t for texts in SLOTTED.values() for t in texts):
        sentence = F.regexp_replace(sentence, "^" + text.replace("...", "[^ ]+(?: [^ ]+){0,9}?") + "$", text)
    return sentence


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_sentences, sentences (identifiers in order), licenses (in order of first rule)
    and unmatched (known sentences no rule took).  ``carry``: columns kept (all, if absent)."""
    docs = ship(without(docs, "n_sentences", "sentences", "licenses", "unmatched"))
    kept = [c for c in docs.columns if carry is None or c in carry]
    known = F.create_map(*[F.lit(x) for pair in EVERY.items() for x in pair])
    body = text_or_empty(text)
    cut = F.filter(F.split(body, BREAK, -1), lambda s: s.rlike("[\\p{L}\\p{N}]"))
    hits = F.when(F.lower(body).rlike(HINT), F.regexp_extract_all(normalised(body), F.lit(SENTENCE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*kept, F.size(cut).cast("long").alias("n_sentences"), hits.alias("__hits"))
    rows = rows.select(*kept, "n_sentences", F.transform("__hits", lambda s: F.element_at(known, _unnamed(F.replace(s, F.lit("\x01 "), F.lit(""))))).alias("sentences"))
    # every identifier is followed by a blank, taken ones become their rule's number
    rows = rows.withColumn("__left", F.array_join(F.transform("sentences", lambda s: F.concat(s, F.lit(" "))), ""))
    left = F.col("__left")
    for i, (_, wanted) in enumerate(RULES + MORE_RULES):
        left = F.replace(left, F.lit("".join(f"{w} " for w in wanted)), F.lit(f"#{i} "))
    rows = rows.withColumn("__done", F.split(F.trim(F.when(F.size("sentences") > 0, left).otherwise("")), " "))
    taken = F.filter("__done", lambda s: s.startswith("#"))
    of = F.array(*[F.lit(name) for name, _ in RULES + MORE_RULES])
    licences = F.array_distinct(F.transform(taken, lambda s: F.element_at(of, F.substring(s, F.lit(2), F.lit(9)).cast("int") + 1)))
    return rows.select(*kept, "n_sentences", "sentences", licences.alias("licenses"), F.filter("__done", lambda s: (s != "") & ~s.startswith("#")).alias("unmatched"))


#: A word that every known sentence has: texts without one are not normalised.
HINT = "license|cc by|permission|copyright|warrant|redistribut|free software|endorse|comply|compliance|reserved|cc.by|cc0|unencumbered|mpl"


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "n_sentences", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))


def _values(pairs) -> str:
    return ", ".join("('" + "', '".join(p) + "')" for p in pairs)


def _sql() -> str:
    left = "given"
    for i, (_, wanted) in enumerate(RULES):
        left = f"replace({left}, '{''.join(w + ' ' for w in wanted)}', '#{i} ')"
    rules = _values((f"#{i}", name) for i, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {_values(KNOWN.items())}),
rules(mark, licence) AS (VALUES {rules}),
-- sentence ends become line ends; blanks after them go with them
lines AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;:])[\\x20\\t-\\r]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS cut FROM documents),
cut AS (SELECT doc_id, list_filter(cut, lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]')) AS cut FROM lines),
each AS (SELECT doc_id, len(cut) AS n, cut, generate_subscripts(cut, 1) AS i FROM cut),
named AS (
  SELECT e.doc_id, string_agg(k.name, ',' ORDER BY i) AS sentences, string_agg(k.name || ' ', '' ORDER BY i) AS given
  FROM each e JOIN known k ON k.sentence = trim(regexp_replace(lower(e.cut[i]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) GROUP BY e.doc_id),
done AS (SELECT doc_id, string_split(trim({left}), ' ') AS done FROM named),
licences AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY first) AS licenses FROM (
    SELECT d.doc_id, r.licence, min(d.i) AS first FROM (SELECT doc_id, done[generate_subscripts(done, 1)] AS mark, generate_subscripts(done, 1) AS i FROM done) d
    JOIN rules r USING (mark) GROUP BY ALL) GROUP BY doc_id)
SELECT c.doc_id, len(c.cut)::BIGINT AS n_sentences, coalesce(n.sentences, '') AS sentences, coalesce(l.licenses, '') AS licenses,
  coalesce(array_to_string(list_filter(d.done, lambda s: s NOT LIKE '#%'), ','), '') AS unmatched
FROM cut c LEFT JOIN named n USING (doc_id) LEFT JOIN licences l USING (doc_id) LEFT JOIN done d USING (doc_id)"""


SQL = _sql()
