"""License scans by sentence rules.

A text is cut into pieces at sentence signs and line ends; a piece is lower-cased and everything but letters and digits becomes
one space, which takes the leaders of comments away.  Openings that vary (this file is released under the terms of the ...) and names
of holders become one form.  A known license sentence is a piece, or several lines of a paragraph one after the other, as texts are
wrapped; it ends at a sentence sign, an empty line or a line end, and the longest that begins at a piece counts.  Known sentences
become their identifiers, all others are dropped, and the sequence of identifiers is matched against the licenses' rules: a rule is an
ordered list of identifiers that must appear one after the other, whatever stands between.  The first rule that matches in the
order below gives the document's license; all that match are listed too.  n_sentences counts pieces.

Known are the notices and the grants of the licenses below, the heads of their full texts, and SPDX-License-Identifier lines of one
license.

Everything is made of SQL functions.  Null and empty texts have no sentences and no license; very long texts are scanned whole;
repeated rows give equal results; other columns stay, but for the four that the scan adds.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import free_name

#: Normalised license sentences and their identifiers.
SENTENCES = {
    "apache-note": "licensed under the apache license version 2 0",
    "apache-note-the": "licensed under the apache license version 2 0 the license",
    "apache-note-short": "licensed under the apache license 2 0",
    "apache-note-2": "licensed under the apache 2 0 license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-title": "apache license version 2 0 january 2004",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-note": "licensed under the bsd license",
    "bsd-2-note": "licensed under the bsd 2 clause license",
    "bsd-3-note": "licensed under the bsd 3 clause license",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "boost-note": "licensed under the boost software license version 1 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "cc0-note": "licensed under cc0 1 0",
    "cc0-title": "cc0 1 0 universal",
    "cc-by-note": "licensed under cc by 4 0",
    "cc-by-work": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-note": "licensed under cc by nc 4 0",
    "cc-by-nc-work": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-nd-note": "licensed under cc by nc nd 4 0",
    "cc-by-nc-sa-note": "licensed under cc by nc sa 4 0",
    "cc-by-nd-note": "licensed under cc by nd 4 0",
    "cc-by-sa-note": "licensed under cc by sa 4 0",
    "cc-by-sa-work": "licensed under a creative commons attribution sharealike 4 0 international license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-note": "licensed under the isc license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-note": "licensed under the mit license",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-note": "licensed under the mozilla public license version 2 0",
    "mpl-2-title": "mozilla public license version 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "unlicense-note": "licensed under the unlicense",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-note": "licensed under the zlib license",
}

#: License rules, the most specific first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Apache-2.0", ["apache-note-the", "apache-comply"]),
    ("Apache-2.0", ["apache-note", "apache-comply"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("Unlicense", ["unlicense-grant"]),
    ("0BSD", ["zero-bsd-grant"]),
    ("Apache-2.0", ["apache-note"]),
    ("Apache-2.0", ["apache-note-the"]),
    ("Apache-2.0", ["apache-note-short"]),
    ("Apache-2.0", ["apache-note-2"]),
    ("MIT", ["mit-note"]),
    ("ISC", ["isc-note"]),
    ("BSD-3-Clause", ["bsd-note"]),
    ("BSD-2-Clause", ["bsd-2-note"]),
    ("BSD-3-Clause", ["bsd-3-note"]),
    ("BSL-1.0", ["boost-note"]),
    ("MPL-2.0", ["mpl-2-note"]),
    ("Unlicense", ["unlicense-note"]),
    ("Zlib", ["zlib-note"]),
    ("CC0-1.0", ["cc0-note"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-note"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-note"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-note"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-note"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-note"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-4.0", ["cc-by-note"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("Apache-2.0", ["apache-title"]),
    ("BSL-1.0", ["boost-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("MPL-2.0", ["mpl-2-title"]),
]

#: The GNU licenses: name, what a notice calls it, its versions, and the date at the head of its text.
GNU = [
    ("AGPL", "gnu affero general public license", {"3": "19 november 2007"}),
    ("LGPL", "gnu lesser general public license", {"2 1": "february 1999", "3": "29 june 2007"}),
    ("GPL", "gnu general public license", {"2": "june 1991", "3": "29 june 2007"}),
]


def _add_families() -> None:
    """The sentences and rules that follow one form: notices of the GNU licenses, and SPDX lines of all licenses above."""
    joined, plain, heads = [], [], []
    for name, title, versions in GNU:
        free = f"you can redistribute it and or modify it under the terms of the {title} as published by the free software foundation"
        for version, date in versions.items():
            key, number = f"{name.lower()}-{version.replace(' ', '-')}", version.replace(" ", ".") if " " in version else f"{version}.0"
            own = {
                f"{name.lower()}-free": free,
                f"later-{version.replace(' ', '-')}": f"either version {version} of the license or at your option any later version",
                f"{key}-free-later": f"{free} either version {version} of the license or at your option any later version",
                f"{key}-free-only": f"{free} version {version} of the license",
                f"{key}-free-version": f"{free.removesuffix(' as published by the free software foundation')} version {version} as published by the free software foundation",
                f"{key}-note-later": f"licensed under the {title} version {version} or later",
                f"{key}-work": f"licensed under the {title} version {version}",
                f"{key}-title": f"{title} version {version} {date}",
            }
            SENTENCES.update(own)
            joined += [(f"{name}-{number}-or-later", ids) for ids in ([f"{key}-free-later"], [f"{name.lower()}-free", f"later-{version.replace(' ', '-')}"])]
            joined += [(f"{name}-{number}-only", [f"{key}-free-only"]), (f"{name}-{number}-only", [f"{key}-free-version"])]
            plain += [(f"{name}-{number}-or-later", [f"{key}-note-later"]), (f"{name}-{number}-only", [f"{key}-work"])]
            heads.append((f"{name}-{number}-only", [f"{key}-title"]))
    at = RULES.index(("MIT", ["mit-note"]))  # the first of the short notices
    RULES[at:at] = plain
    RULES[0:0] = joined
    RULES.extend(heads)
    for name in dict.fromkeys(n for n, _ in list(RULES)):
        words = re.sub("[^a-z0-9]+", " ", name.lower())
        SENTENCES[f"spdx-{name.lower()}"] = f"spdx license identifier {words}"
        RULES.append((name, [f"spdx-{name.lower()}"]))


_add_families()

_SUBJECT = "(?:(?:this|the|our)_(?:file|project|software|program|work|code|source_code|library|package|module|repository|document|site|content)_(?:is|are)_)?"
_VERB = "(?:released|licensed|distributed|published|provided|made_available|available)_under_"
#: What varies at the beginning of a sentence, and its one form; _ is a space, or the end of a line.
FORMS = [
    (f"{_SUBJECT}{_VERB}(?:the_terms_of_)?(?:the_)?(apache|bsd|boost|gnu|isc|mit|mozilla|unlicense|zlib)", "licensed under the $1"),
    (f"{_SUBJECT}{_VERB}(a_creative|cc)", "licensed under $1"),
    ("(?:[1-9]_|i+_|[a-d]_)?neither_the_name_of_(?:[^ \n]+_){1,12}?nor_the_names_of_(?:its|their|any)_contributors", "neither the name of the copyright holder nor the names of its contributors"),
]

ADDED = ["n_sentences", "sentence_ids", "license", "licenses"]

#: A sentence ends with one of these signs before white space, or with a line; the sign of an SPDX line is no such sign.
_ENDS = r"([.!?;:])[\x20\x09-\x0D]+"
_OTHER = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
_SPDX = "(spdx-license-identifier)[ \t]*:"


def pieces(text: Column) -> Column:
    """The normalised pieces of a text: a line feed between the lines of a paragraph, two or more at sentence signs and empty lines."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SPDX, "$1"), _ENDS, "$1\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, _OTHER, " "), " ?\n ?", "\n"))


#: Every known sentence and every form has one of these in it: texts without them aren't searched.
_SIGNS = ["licens", "permi", "redistribut", "neither", "notice", "unencumbered", "cc0", "_under_", "later_version"]


def in_one_form(pieces: Column) -> Column:
    """The pieces with the openings of FORMS in their one form."""
    for varying, form in FORMS:
        pieces = F.regexp_replace(pieces, "(?md)^" + varying.replace("_", "[ \n]"), form)
    return pieces


def _known() -> str:
    """Matches a known sentence over one or more lines of a paragraph, the longest first."""
    return "(?md)^(?:" + "|".join(s.replace(" ", "[ \n]") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + ")$"


def _may_match(pieces: Column) -> Column:
    return reduce(or_, [pieces.contains(x) for sign in _SIGNS for x in ([sign] if "_" not in sign else [sign.replace("_", a, 1).replace("_", b, 1) for a in " \n" for b in " \n"])])


def _follows(found: Column, ids: list[str]) -> Column:
    """Whether the ids are among those found, one after the other: a fold over what is found, without going back."""
    if len(ids) == 1:
        return F.array_contains(found, ids[0])
    rule = F.array(*map(F.lit, ids))
    return F.aggregate(found, F.lit(0), lambda n, x: F.when(F.get(rule, n) == x, n + 1).otherwise(n)) == len(ids)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_sentences, sentence_ids (|a||b|..., in order), license and licenses (sorted, joined by a space)."""
    own = free_name("__scan", docs)
    by_sentence = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    rest = docs.drop(*[c for c in ADDED if c != text_col])
    found = rest.withColumn(own, pieces(F.col(f"`{text_col}`")))
    matched = F.when(_may_match(F.col(own)), F.regexp_extract_all(in_one_form(F.col(own)), F.lit(_known()), F.lit(0))).otherwise(F.array().cast("array<string>"))
    ids = F.transform(matched, lambda s: F.element_at(by_sentence, F.translate(s, "\n", " ")))
    n_pieces = F.size(F.array_remove(F.split(own, "\n+"), "")).cast("long")
    found = found.withColumn(own, F.struct(n_pieces.alias("n"), ids.alias("ids")))
    ids = F.col(own)["ids"]
    hits = F.array_compact(F.array(*[F.when(_follows(ids, rule), F.lit(name)) for name, rule in RULES]))
    found = found.withColumn(own, F.struct(f"{own}.n", f"{own}.ids", F.when(F.size(ids) > 0, hits).otherwise(F.array().cast("array<string>")).alias("hits")))
    columns = [
        F.col(own)["n"].alias("n_sentences"),
        F.concat(F.lit(""), F.array_join(F.transform(F.col(own)["ids"], lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")).alias("sentence_ids"),
        F.get(F.col(own)["hits"], 0).alias("license"),
        F.array_join(F.sort_array(F.array_distinct(F.col(own)["hits"])), " ").alias("licenses"),
    ]
    kept = [F.col(f"`{c}`") for c in rest.columns if c not in ADDED]  # the text may have one of these names
    return found.select(*kept, *columns)


def _pattern(ids: list[str]) -> str:
    """Matches the ids, each between bars, in order within the sequence."""
    return ".*".join(rf"\|{i}\|" for i in ids)


def sql() -> str:
    """DuckDB SQL for the scan of ``documents``; it knows no sentences that are wrapped over lines."""
    pairs = ", ".join(f"'{s}'" for s in SENTENCES.values())
    ids = ", ".join(f"'{i}'" for i in SENTENCES)
    hits = [f"CASE WHEN regexp_matches(sentence_ids, '{_pattern(r)}') THEN '{name}' END" for name, r in RULES]
    form = "x"
    for varying, to in FORMS:
        form = f"regexp_replace({form}, '^{varying.replace('_', ' ')}', '{to.replace('$1', chr(92) + '1')}')"
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{_SPDX}', '\\1', 'g'), '{_ENDS}', '\\1' || chr(10), 'g'), '{_OTHER}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents
), f AS (
  SELECT doc_id, CAST(len(l) AS BIGINT) AS n_sentences, list_transform(l, lambda x: {form}) AS l FROM s
), m AS (
  SELECT doc_id, n_sentences,
    coalesce(array_to_string(list_transform(list_filter(l, lambda x: list_contains([{pairs}], x)), lambda x: '|' || [{ids}][list_position([{pairs}], x)] || '|'), ''), '') AS sentence_ids
  FROM f
)
SELECT doc_id, n_sentences, sentence_ids, coalesce({', '.join(hits)}) AS license,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))), ' '), '') AS licenses
FROM m
"""
