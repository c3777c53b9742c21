"""License scans by sentence rules.

A text is cut into sentences, over line ends and behind comment leaders; those that may speak of licensing are normalised
(case, punctuation, opening phrases, defined terms) and looked up among known licence sentences, which gives each document a
sequence of sentence identifiers, those of SPDX lines first; `unknown` marks a licensing sentence that isn't known. Ordered
licence rules then match the sequence, the more specific first; what a rule has matched is taken out before the next is tried. Sentences
that name a holder are known with a slot for the name; titles and definitions stand for the full texts of licences; a third condition
that isn't known keeps the licence of two conditions from being named.
One scan of built-in expressions, no shuffle.

`scan` is the operator; `scan_lines` is its simpler form, in which every line end ends a sentence and only sentences with a
word of SPEAKS are looked up.

Defined results: a null or empty text has no sentences and no licences (empty strings, zeros); a repeated sentence is
counted each time, its licence is named once; a text is read whole, however long; of rules that match the same place the first
counts; repeated rows give repeated results; an empty table gives none; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import documents

SPEAKS = "(?i)licen[cs]|copyright|redistribut|warrant|permission|public domain"
OPENING = "^(?:(?:this|the|all) [a-z]+ (?:is|are) )?(?:licensed|released|distributed|available|published|provided|covered) under (?:the terms of )?(?:the )?"

#: What a known sentence holds at least: a word of SPEAKS, or one of the forms that do without.
MAY_SPEAK = SPEAKS.replace("public domain", r"public\W+domain") + r"|rights\W+reserved|be\W+liable|(?:licensed|released|distributed|available|published|provided|covered)\W+under"

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "under apache license version 2.0": "apache2",
    "under apache license 2.0": "apache2",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "asf_grant",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_basis",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache_copy",
    "you may not use this file except in compliance with the license": "apache_compliance",
    "under mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "under gnu general public license version 3": "gpl3",
    "under gnu general public license version 3 or any later version": "gpl3plus",
    "under gnu general public license version 2": "gpl2",
    "under gnu general public license version 2 or any later version": "gpl2plus",
    "under gnu lesser general public license version 2.1": "lgpl21",
    "under gnu lesser general public license version 3": "lgpl3",
    "under gnu affero general public license version 3": "agpl3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus_head",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus_head",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_useful",
    "see the gnu general public license for more details": "gpl_see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "bsd_as_is",
    "under bsd 2 clause license": "bsd2",
    "under bsd 3 clause license": "bsd3",
    "under bsd license": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2",
    "under mozilla public license version 2.0": "mpl2",
    "under cc by 4.0": "cc_by4",
    "under cc by sa 4.0": "cc_by_sa4",
    "under cc by nc 4.0": "cc_by_nc4",
    "under cc by nc nd 4.0": "cc_by_nc_nd4",
    "under cc0 1.0": "cc0",
    "under creative commons attribution 4.0 international license": "cc_by4",
    "under creative commons attribution sharealike 4.0 international license": "cc_by_sa4",
    "under creative commons attribution noncommercial 4.0 international license": "cc_by_nc4",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "all rights reserved": "reserved",
}
# Ordered licence rules over the identifiers, the first that match take what they match.
RULES = (
    ("BSD-3-Clause", "bsd_head bsd_source bsd_binary bsd_names(?: bsd_as_is)?"),
    ("BSD-2-Clause", "bsd_head bsd_source bsd_binary(?: bsd_as_is)?"),
    ("MIT", "(?:mit )?mit_grant mit_notice(?: as_is)?"),
    ("ISC", "isc_grant(?: as_is)?"),
    ("GPL-3.0-or-later", "gpl3plus_head(?: gpl_useful)?(?: gpl_see)?"),
    ("GPL-2.0-or-later", "gpl2plus_head(?: gpl_useful)?(?: gpl_see)?"),
    ("Apache-2.0", "(?:asf_grant )?apache2(?: apache_compliance)?(?: apache_copy)?(?: apache_basis)?"),
    ("MIT", "mit"),
    ("GPL-3.0-or-later", "gpl3plus"),
    ("GPL-3.0-only", "gpl3"),
    ("GPL-2.0-or-later", "gpl2plus"),
    ("GPL-2.0-only", "gpl2"),
    ("LGPL-2.1-only", "lgpl21"),
    ("LGPL-3.0-only", "lgpl3"),
    ("AGPL-3.0-only", "agpl3"),
    ("BSD-3-Clause", "bsd3"),
    ("BSD-2-Clause", "bsd2"),
    ("BSD", "bsd"),
    ("MPL-2.0", "mpl2"),
    ("CC-BY-4.0", "cc_by4"),
    ("CC-BY-SA-4.0", "cc_by_sa4"),
    ("CC-BY-NC-4.0", "cc_by_nc4"),
    ("CC-BY-NC-ND-4.0", "cc_by_nc_nd4"),
    ("CC0-1.0", "cc0"),
    ("Unlicense", "unlicense"),
)


SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+|\n[^\p{L}\p{N}]*\n"
CLAUSE_END = r"(?<=[;:])[\x20\x09\n]+"
DEFINED = r"(?i)\((?:[^\p{L}\p{N}()]*the)?[^\p{L}\p{N}()]*license[^\p{L}\p{N}()]*\)"
SPDX = r"(?i)SPDX-License-Identifier:[\x20\x09]*([^\n]*)"
#: Done to the whole text first: line ends, leaders that are words, "v. 2", and the address that the Apache header has in a paragraph of its own.
PREPARE = (
    (r"\r\n?", "\n"),
    (r"(?im)^[\x20\x09]*(?:dnl|rem)\b", ""),
    (r"(?i)\bv\.[\x20\x09-\x0D]+([0-9])", "v $1"),
    (r"(?i)(copy\W+of\W+the\W+license\W+at):?[^\p{L}\p{N}]+(https?://)", "$1 $2"),
)
# What the canonical texts say besides, as they say it.
TEXT_SENTENCES = {k: v for k, v in SENTENCES.items() if "www." not in k} | {
    "under apache license version 2.0 the license": "apache2",
    "you may obtain a copy of the license at http wwwapacheorg licenses license 2.0": "apache_copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "no_event",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "no_event",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "no_event",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "you should have received a copy of the gnu general public license along with this program": "gpl_copy",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache_text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_bsd",
    "public license fallback": "cc0",
    "python software foundation license version 2": "psf2",
    "gnu general public license version 1 february 1989": "gpl1",
    "gnu general public license version 2 june 1991": "gpl2_text",
    "gnu general public license version 3 29 june 2007": "gpl3_text",
    "gnu library general public license version 2 june 1991": "lgpl2",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21_text",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3",
    "gnu free documentation license version 1.2 november 2002": "gfdl12",
    "gnu free documentation license version 1.3 3 november 2008": "gfdl13",
    "mozilla public license version 1.1": "mpl11",
    "the artistic license preamble": "artistic1",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3plus",
}
#: Known sentences with a slot for a holder's name, of 160 characters at most, or a lead: what they are looked up as. On normalised sentences.
_NAMES = "may be used to endorse or promote products derived from this (?:software|library|package|program) without (?:specific )?prior written permission"
_LIABLE = "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damages?"
SLOTS = (
    (f"^(?:[0-9a-z] )?(?:neither the names? .{{1,160}} )?nor the names of (?:its |their |the |any |other )?contributors {_NAMES}$", "bsd_names"),
    (f"^(?:[0-9a-z] )?the names? .{{1,160}} (?:may|must) not {_NAMES.removeprefix('may ')}$", "bsd_names"),
    ("^redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [0-9a-z]$", "bsd_head"),
    ("^this software is provided (?:by .{1,160} )?as is and any express(?:ed)? or implied warranties including but not limited to (?:the )?implied warranties of merchantability and fitness for a particular purpose are disclaimed$", "bsd_as_is"),
    (f"^in no event shall .{{1,160}} {_LIABLE}$", "no_event"),
    ("^begin license block this source code form is subject to the terms of the mozilla public license v 2.0$", "mpl2"),
    ("^(?:the )?apache 2.0 license https? www.?apache.?org licenses license 2.0$", "apache2"),
    ("^(?:the )?mit license https? (?:www)?.?opensource.?org licenses mit$", "mit"),
)
TEXT_RULES = (
    ("GPL-3.0-or-later", "gpl3_text(?: unknown)* gpl3plus_head(?: gpl_useful)?(?: gpl_see)?(?: gpl_copy)?"),
    ("GPL-2.0-or-later", "gpl2_text(?: unknown)* gpl2plus_head(?: gpl_useful)?(?: gpl_see)?(?: gpl_copy)?"),
    ("LGPL-2.1-or-later", "lgpl21_text(?: unknown)* lgpl21plus"),
    ("GPL-3.0-only", "gpl3_text"),
    ("GPL-2.0-only", "gpl2_text"),
    ("LGPL-2.1-only", "lgpl21_text"),
    ("Apache-2.0", "apache_text"),
    ("0BSD", "zero_bsd(?: isc_as_is)?(?: no_event)?"),
    *((name, rule.replace("(?: as_is)?", "(?: as_is| isc_as_is)?(?: no_event)?" if name == "ISC" else "(?: as_is)?(?: no_event)?").replace("(?: bsd_as_is)?", "(?: bsd_as_is)?(?: no_event)?").replace("(?: gpl_see)?", "(?: gpl_see)?(?: gpl_copy)?").replace("(?: apache_basis)?", "(?: apache_basis)?(?: apache_see)?")) for name, rule in RULES[:1]),
    # A third condition that isn't known is no permission to call it the licence of two: taken out, without a name.
    ("", "bsd_head bsd_source bsd_binary unknown"),
    *((name, rule.replace("(?: as_is)?", "(?: as_is| isc_as_is)?(?: no_event)?" if name == "ISC" else "(?: as_is)?(?: no_event)?").replace("(?: bsd_as_is)?", "(?: bsd_as_is)?(?: no_event)?").replace("(?: gpl_see)?", "(?: gpl_see)?(?: gpl_copy)?").replace("(?: apache_basis)?", "(?: apache_basis)?(?: apache_see)?")) for name, rule in RULES[1:]),
    ("ISC", "isc"),
    ("LGPL-2.0-only", "lgpl2"),
    ("GPL-1.0-only", "gpl1"),
    ("MPL-1.1", "mpl11"),
    ("GFDL-1.2-only", "gfdl12"),
    ("GFDL-1.3-only", "gfdl13"),
    ("Artistic-1.0", "artistic1"),
    ("PSF-2.0", "psf2"),
    ("LGPL-2.1-or-later", "lgpl21plus"),
    ("LGPL-3.0-or-later", "lgpl3plus"),
    ("AGPL-3.0-or-later", "agpl3plus"),
)
#: SPDX names in lower case, from the rules of one identifier, and the older short ones.
NAMES = {name.lower(): rule for name, rule in TEXT_RULES if rule.isidentifier()} | {"apache-2.0": "apache2", "gpl-2.0": "gpl2", "gpl-2.0+": "gpl2plus", "gpl-3.0": "gpl3", "gpl-3.0+": "gpl3plus", "lgpl-2.1": "lgpl21", "lgpl-2.1+": "lgpl21plus", "lgpl-3.0": "lgpl3", "lgpl-3.0+": "lgpl3plus", "agpl-3.0": "agpl3"}


def normalise(sentence: Column) -> Column:
    """Lower case, one space for all between words, no dots but those before digits, one opening for all grants."""
    s = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}.+]+", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\.([^0-9])", "$1"), r"\.$", ""))
    return F.regexp_replace(s, OPENING, "under ")


def line_ids(text: Column) -> Column:
    """Identifiers of the licensing sentences of a text, in order; every line end ends a sentence."""
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[\x20\x09]+", "$1\n"), r"[\r\n]+", -1)
    said = F.filter(cut, lambda x: x.rlike(SPEAKS))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.transform(said, lambda x: F.coalesce(F.try_element_at(known, normalise(x)), F.lit("unknown")))


def prepared(text: Column) -> Column:
    for pattern, by in PREPARE:
        text = F.regexp_replace(text, pattern, by)
    return text


def spdx_ids(whole: Column) -> Column:
    """Identifiers of the licences that SPDX lines name; a line that names none of the known is unknown."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    said = lambda line: F.array_compact(F.transform(F.split(F.lower(line), "[^a-z0-9.+-]+", -1), lambda x: F.try_element_at(names, x)))
    return F.flatten(F.transform(F.regexp_extract_all(whole, F.lit(SPDX), F.lit(1)), lambda line: F.when(F.size(said(line)) > 0, said(line)).otherwise(F.array(F.lit("unknown")))))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known and of the other licensing sentences of a text, SPDX lines first, the others in order.

    A sentence goes on over line ends; it ends with a full stop before a space or at a line without letters and digits. One that
    isn't known is looked up by its clauses, and a clause that isn't by its lines; what is left unknown counts if it speaks of licensing.
    """
    known = F.create_map(*[F.lit(x) for pair in (TEXT_SENTENCES | {f"slot {by}": by for _, by in SLOTS}).items() for x in pair])
    plain = lambda x: normalise(F.regexp_replace(F.regexp_replace(x, DEFINED, " "), "(?i)https://", "http://"))

    def slotted(x: Column) -> Column:
        for pattern, by in SLOTS:
            x = F.regexp_replace(x, pattern, f"slot {by}")
        return x

    look = lambda x: F.try_element_at(known, slotted(plain(x)))
    looked = lambda xs: F.transform(F.filter(xs, lambda x: x.rlike(MAY_SPEAK)), lambda x: F.struct(x.alias("x"), look(x).alias("id")))
    other = lambda x: F.when(x["x"].rlike(SPEAKS), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))

    def ids(xs: Column, *finer: str) -> Column:
        def parts(x: Column) -> Column:
            if not finer:
                return other(x)
            inner = ids(F.split(x["x"], finer[0], -1), *finer[1:])
            return F.when(F.exists(inner, lambda i: i != "unknown"), inner).otherwise(other(x))

        return F.flatten(F.transform(looked(xs), lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(parts(x))))

    whole = prepared(text)
    return F.concat(spdx_ids(whole), ids(F.split(F.regexp_replace(whole, SPDX, "\n\n"), SENTENCE_END, -1), CLAUSE_END, r"\n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence_ids, licenses, n_known, n_unknown for every document."""
    text = F.col(text_col)
    return _matched(docs.select(F.col(id_col), F.when(text.rlike(MAY_SPEAK), sentence_ids(text)).alias("ids")), id_col, TEXT_RULES)


def scan_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As scan, by lines and for sentences with a word of SPEAKS alone."""
    text = F.col(text_col)
    return _matched(docs.select(F.col(id_col), F.when(text.rlike(SPEAKS), line_ids(text)).alias("ids")), id_col, RULES)


def _matched(d: DataFrame, id_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    d = d.select(id_col, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    d = d.withColumn("sequence", F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")))
    left, names = F.col("sequence"), []
    for name, rule in rules:
        if name:
            names.append(F.when(left.rlike(f" {rule} "), F.lit(name)))
        left = F.regexp_replace(left, f" {rule}(?= )", " taken")
    licenses = F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ",")
    plain = F.size("ids") > 0
    n_unknown = F.size(F.filter("ids", lambda x: x == "unknown"))
    return d.select(id_col, F.array_join("ids", " ").alias("sentence_ids"), F.when(plain, licenses).otherwise("").alias("licenses"), (F.size("ids") - n_unknown).cast("long").alias("n_known"), n_unknown.cast("long").alias("n_unknown"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op8_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(documents(spark, sf_dir))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by.replace('$', chr(92)))}, 'g')"


def _normalised(x: str) -> str:
    x = f"trim({_replaced(_replaced(f'lower({x})', r'[^\p{L}\p{N}.+]+', ' '), r'\.([^0-9])', '$1')})"
    return f"regexp_replace(regexp_replace({x}, '\\.$', ''), {_quoted(OPENING)}, 'under ')"


def _rules_sql(rules: Sequence[tuple[str, str]], ctes: str) -> str:
    """The licences from CTEs that end in q (doc_id, sentence_ids, sequence, n_known, n_unknown)."""
    steps, part = [], "SELECT *, sequence AS s0 FROM q"
    for k, (name, rule) in enumerate(rules):
        if name:
            steps.append(f"CASE WHEN regexp_matches(s{k}, {_quoted(f' {rule} ')}) THEN {_quoted(name)} END")
        # RE2 has no lookahead: every space is doubled first, so that neighbours don't share one
        part = f"SELECT *, replace(regexp_replace(replace(s{k}, ' ', '  '), {_quoted(' ' + rule.replace(' ', '  ') + ' ')}, ' taken ', 'g'), '  ', ' ') AS s{k + 1} FROM ({part})"
    return f"""
WITH {ctes},
z AS ({part})
SELECT doc_id, sentence_ids, array_to_string(list_filter([x FOR x, i IN l IF i = list_position(l, x)], lambda x: x IS NOT NULL), ',') AS licenses, n_known, n_unknown
FROM (SELECT *, list_filter([{", ".join(steps)}], lambda x: x IS NOT NULL) AS l FROM z)
"""


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in table.items())


def lines_oracle() -> str:
    cut = r"string_split_regex(regexp_replace(text, '([.!?;:])[\x20\x09]+', '\1' || chr(10), 'g'), '[\r\n]+')"
    ctes = f"""d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
s AS (SELECT r, unnest({cut}) AS x, generate_subscripts({cut}, 1) AS i FROM d),
n AS (SELECT r, i, {_normalised("x")} AS k FROM s WHERE regexp_matches(x, {_quoted(SPEAKS)})),
known(k, sid) AS (VALUES {_values(SENTENCES)}),
a AS (SELECT r, string_agg(coalesce(sid, 'unknown'), ' ' ORDER BY i) AS ids, count(sid) AS n_known, count(*) - count(sid) AS n_unknown FROM n LEFT JOIN known USING (k) GROUP BY r),
q AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS sequence, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown FROM d LEFT JOIN a USING (r))"""
    return _rules_sql(RULES, ctes)


def oracle() -> str:
    whole = "text"
    for pattern, by in PREPARE:
        whole = _replaced(whole, pattern, by)
    look = _normalised(_replaced(_replaced("x", DEFINED, " "), "(?i)https://", "http://"))
    for pattern, by in SLOTS:
        look = f"regexp_replace({look}, {_quoted(pattern)}, {_quoted(f'slot {by}')})"
    may, speaks = (f"regexp_matches(x, {_quoted(p)})" for p in (MAY_SPEAK, SPEAKS))
    # RE2 has no lookbehind: the mark stays before a control character at which the text is cut.
    cut = lambda x, pattern: f"string_split({_replaced(x, pattern, '$1' + chr(1))}, chr(1))"
    sentences = cut(f"regexp_replace(t, {_quoted(SPDX)}, chr(10) || chr(10), 'g')", r"([.!?])[\x20\x09-\x0D]+|\n[^\p{L}\p{N}]*\n")
    clauses = cut("x", r"([;:])[\x20\x09\n]+")

    def level(n: int, keys: str, source: str, parts: str) -> str:
        own = f"{keys}, k{n}"
        return f"""c{n} AS (SELECT {keys}, unnest({parts}) AS x, generate_subscripts({parts}, 1) AS k{n} FROM {source}),
l{n} AS (SELECT {own}, c.x, sid FROM (SELECT {own}, x, {look} AS k FROM c{n} WHERE {may}) c LEFT JOIN known USING (k))"""

    def gathered(n: int, keys: str) -> str:
        """What each sentence of level n comes to, from the lists of the next level."""
        if n == 3:
            return f"e3 AS (SELECT {keys}, k3, CASE WHEN sid IS NOT NULL THEN [sid] WHEN {speaks} THEN ['unknown'] ELSE [] END AS l FROM l3), g3 AS (SELECT {keys}, flatten(list(l ORDER BY k3)) AS l FROM e3 GROUP BY {keys})"
        found = "len(list_filter(g.l, lambda i: i <> 'unknown')) > 0"
        return f"""e{n} AS (SELECT {keys}, k{n}, CASE WHEN sid IS NOT NULL THEN [sid] WHEN {found} THEN g.l WHEN {speaks} THEN ['unknown'] ELSE [] END AS l FROM l{n} LEFT JOIN g{n + 1} g USING ({keys}, k{n})), g{n} AS (SELECT {keys}, flatten(list(l ORDER BY k{n})) AS l FROM e{n} GROUP BY {keys})"""

    ctes = f"""d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
p AS (SELECT r, {whole} AS t FROM d WHERE regexp_matches(text, {_quoted(MAY_SPEAK)})),
known(k, sid) AS (VALUES {_values(TEXT_SENTENCES | {f'slot {by}': by for _, by in SLOTS})}),
names(k, sid) AS (VALUES {_values(NAMES)}),
sl AS (SELECT r, unnest(regexp_extract_all(t, {_quoted(SPDX)}, 1)) AS line, generate_subscripts(regexp_extract_all(t, {_quoted(SPDX)}, 1), 1) AS i FROM p),
st AS (SELECT r, i, unnest(string_split_regex(lower(line), '[^a-z0-9.+-]+')) AS k, generate_subscripts(string_split_regex(lower(line), '[^a-z0-9.+-]+'), 1) AS j FROM sl),
sg AS (SELECT r, i, coalesce(list(sid ORDER BY j) FILTER (sid IS NOT NULL), ['unknown']) AS l FROM st LEFT JOIN names USING (k) GROUP BY r, i),
sx AS (SELECT r, flatten(list(l ORDER BY i)) AS l FROM sg GROUP BY r),
{level(1, "r", "p", sentences)},
{level(2, "r, k1", "(SELECT * FROM l1 WHERE sid IS NULL)", clauses)},
{level(3, "r, k1, k2", "(SELECT * FROM l2 WHERE sid IS NULL)", "string_split(x, chr(10))")},
{gathered(3, "r, k1, k2")},
{gathered(2, "r, k1")},
{gathered(1, "r")},
a AS (SELECT r, list_concat(coalesce(sx.l, []), coalesce(g1.l, [])) AS l FROM p LEFT JOIN sx USING (r) LEFT JOIN g1 USING (r)),
q AS (SELECT doc_id, coalesce(array_to_string(l, ' '), '') AS sentence_ids, ' ' || coalesce(array_to_string(l, ' '), '') || ' ' AS sequence, CAST(coalesce(len(list_filter(l, lambda i: i <> 'unknown')), 0) AS BIGINT) AS n_known,
 CAST(coalesce(len(list_filter(l, lambda i: i = 'unknown')), 0) AS BIGINT) AS n_unknown FROM d LEFT JOIN a USING (r))"""
    return _rules_sql(TEXT_RULES, ctes)


OP8_SQL = oracle()
OP8_LINES_SQL = lines_oracle()
