"""License scans by ordered signature rules, in Spark expressions only.

A text becomes its lower-cased words with one space between them. A signature is a label, a priority, a keyword that must be in the text before the regex is tried, and a regex over whole words. Every place of every signature is an interval of words; an interval inside another one of higher priority (or of the same priority and longer, or equal and earlier in the list) is suppressed. Only texts that pass one cheap expression over all keywords are looked at so.

The signatures of one keyword are scanned together, as one alternation that marks its matches; what a match is, its own text then tells. Lists of places are built in blocks of BLOCK, so a text with very many of them isn't copied over and over.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, A-Z not yet lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted whatever the rules say, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

V = "(?: (?:version|v))? "
LATER = "(?: or (?:any )?later(?: version)?| or newer)?"
#: Licenses: label, keyword, regex of the name over words (a version included where the label has one).
NAMES = (
    ("gpl-1.0", "gpl", f"(?:gnu )?gpl{V}1(?: 0)?"), ("gpl-2.0", "gpl", f"(?:gnu )?gpl{V}2(?: 0)?{LATER}"), ("gpl-3.0", "gpl", f"(?:gnu )?gpl{V}3(?: 0)?{LATER}"), ("gpl-2.0", "gplv2", f"gplv2{LATER}"), ("gpl-3.0", "gplv3", f"gplv3{LATER}"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public licen[cs]e{V}1(?: 0)?"), ("gpl-2.0", "general public", f"(?:gnu )?general public licen[cs]e{V}2(?: 0)?{LATER}"), ("gpl-3.0", "general public", f"(?:gnu )?general public licen[cs]e{V}3(?: 0)?{LATER}"), ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("lgpl-2.0", "general public", f"(?:gnu )?(?:lesser|library) general public licen[cs]e{V}2(?: 0)?{LATER}"), ("lgpl-2.1", "general public", f"(?:gnu )?(?:lesser|library) general public licen[cs]e{V}2 1{LATER}"), ("lgpl-3.0", "lesser", f"(?:gnu )?lesser general public licen[cs]e{V}3(?: 0)?{LATER}"), ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"), ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{V}2 1{LATER}"), ("lgpl-3.0", "lgpl", f"(?:gnu )?lgpl{V}3(?: 0)?{LATER}"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public licen[cs]e{V}3(?: 0)?{LATER}"), ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"), ("agpl-3.0", "agpl", f"(?:gnu )?agpl{V}3(?: 0)?{LATER}"), ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("apache-1.0", "apache", f"apache(?: software)? licen[cs]e{V}1(?: 0)?"), ("apache-1.1", "apache", f"apache(?: software)? licen[cs]e{V}1 1"), ("apache-2.0", "apache", f"apache(?: software)? licen[cs]e{V}2(?: 0)?"), ("apache", "apache", "apache(?: software)? licen[cs]e"), ("apache-2.0", "apache", "apache 2(?: 0)?(?: licen[cs]e)?"),
    ("mit", "mit", "(?:the )?mit licen[cs]e"), ("mit", "mit", "mit style licen[cs]e"), ("mit", "expat", "expat licen[cs]e"), ("x11", "x11", "x11 licen[cs]e"), ("isc", "isc", "isc licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|2 clause bsd|bsd 2 clause)(?: licen[cs]e)?"), ("bsd-2-clause", "freebsd", "freebsd(?: licen[cs]e)?"), ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)(?: licen[cs]e)?"), ("bsd-4-clause", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)(?: licen[cs]e)?"), ("bsd", "bsd", "bsd(?: style)? licen[cs]e"), ("0bsd", "0bsd", "0bsd"),
    ("mpl-1.0", "mozilla", f"mozilla public licen[cs]e{V}1(?: 0)?"), ("mpl-1.1", "mozilla", f"mozilla public licen[cs]e{V}1 1"), ("mpl-2.0", "mozilla", f"mozilla public licen[cs]e{V}2(?: 0)?"), ("mpl", "mozilla", "mozilla public licen[cs]e"), ("mpl-2.0", "mpl", "mpl 2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public licen[cs]e{V}1(?: 0)?"), ("epl-2.0", "eclipse", f"eclipse public licen[cs]e{V}2(?: 0)?"), ("epl", "eclipse", "eclipse public licen[cs]e"), ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e"), ("cddl-1.0", "common development", "common development and distribution licen[cs]e"), ("cpl-1.0", "common public", "common public licen[cs]e"), ("eupl", "european union", "european union public licen[cs]e"),
    ("artistic-1.0", "artistic", f"artistic licen[cs]e{V}1(?: 0)?"), ("artistic-2.0", "artistic", f"artistic licen[cs]e{V}2(?: 0)?"), ("artistic", "artistic", "artistic licen[cs]e"), ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"), ("bsl-1.0", "boost", "boost software licen[cs]e"), ("python-2.0", "python software", "python software foundation licen[cs]e"), ("psf", "psf", "psf licen[cs]e"), ("php-3.01", "php", "php licen[cs]e"), ("ruby", "ruby", "ruby licen[cs]e"), ("openssl", "openssl", "openssl licen[cs]e"), ("wtfpl", "wtfpl", "wtfpl"), ("unlicense", "unlicense", "the unlicense"), ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e"), ("odbl-1.0", "open database", "open database licen[cs]e"), ("odc-by", "open data commons", "open data commons attribution licen[cs]e"), ("ms-pl", "microsoft public", "microsoft public licen[cs]e"), ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e"), ("ogl-uk", "open government", "open government licen[cs]e"), ("bsl-1.1", "business source", "business source licen[cs]e"), ("sspl-1.0", "server side", "server side public licen[cs]e"), ("elastic-2.0", "elastic", "elastic licen[cs]e"), ("openrail", "openrail", "openrail(?: m)?"), ("postgresql", "postgresql", "postgresql licen[cs]e"), ("ncsa", "ncsa", "ncsa(?: open source)? licen[cs]e"), ("lppl", "latex", "latex project public licen[cs]e"), ("proprietary", "proprietary", "proprietary licen[cs]e"),
)
#: Creative Commons: suffix of the label, short and long form of its conditions.
CONDITIONS = (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?derivat(?:ive)?s?(?: works)?"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?derivat(?:ive)?s?(?: works)?"))
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of license texts, notices and headers, which tell the license without naming it in full: label, keyword, regex.
TEXTS = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation(?: files)?"), ("mit", "permission notice shall", "the above copyright notice and this permission notice shall be included in all copies or substantial portions(?: of the software)?"), ("bsl-1.0", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"), ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"), ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"), ("bsd", "redistributions", "redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors may be used"), ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display"), ("x11", "except as contained", "except as contained in this notice the name of (?:[^ ]+ ){1,6}shall not be used"), ("zlib", "no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software"), ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the licen[cs]e"), ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"), ("apache-2.0", "unless required by", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"), ("apache", "licensed to the apache", "licensed to the apache software foundation(?: asf)? under one or more contributor licen[cs]e agreements"),
    ("gpl", "free software you can", "this program is free software you can redistribute it and or modify it"), ("gpl", "useful but without any", "in the hope that it will be useful but without any warranty"), ("gpl", "received a copy of the gnu general", "you should have received a copy of the gnu general public licen[cs]e along with"), ("gpl", "gnu org licenses", "gnu org licenses(?: gpl)?(?: html)?"), ("lgpl", "this library is free", "this library is free software you can redistribute it and or modify it"), ("lgpl", "received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public licen[cs]e along with"), ("agpl", "received a copy of the gnu affero", "you should have received a copy of the gnu affero general public licen[cs]e along with"), ("gpl", "either version", "either version [23](?: 0)? of the licen[cs]e or at your option any later version"), ("gfdl", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document"),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public licen[cs]e"), ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public licen[cs]e"), ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"), ("cddl-1.0", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"), ("epl-1.0", "eclipse org legal", "eclipse org legal epl v10(?: html)?"), ("epl-2.0", "eclipse org legal", "eclipse org legal epl 2 0"), ("epl", "accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("perl", "terms as perl", "under the same terms as perl itself"), ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"), ("wtfpl", "what the fuck you want", "do what the fuck you want to(?: public licen[cs]e)?"), ("beerware", "beer", "buy me a beer in return"), ("json", "good not evil", "shall be used for good not evil"), ("python-2.0", "psf hereby grants", "psf hereby grants licensee a non ?exclusive royalty free world wide licen[cs]e"), ("openssl", "openssl project", "developed by the openssl project for use in the openssl toolkit"), ("php-3.01", "includes php software", "includes php software freely available from"), ("ofl-1.1", "scripts sil org", "scripts sil org ofl"), ("curl", "daniel stenberg", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})? daniel stenberg"), ("vim", "vim licen", "vim licen[cs]e"), ("imagemagick", "imagemagick", "imagemagick studio llc"), ("ijg", "independent jpeg", "based in part on the work of the independent jpeg group"), ("libpng", "png reference library", "png reference library"), ("unicode", "unicode data files", "unicode data files and software"), ("w3c", "w3c software", "w3c software(?: and document)? notice"), ("afl-3.0", "academic free", "academic free licen[cs]e"), ("osl-3.0", "open software licen", "open software licen[cs]e"), ("ecl-2.0", "educational community", "educational community licen[cs]e"), ("upl-1.0", "universal permissive", "universal permissive licen[cs]e"), ("cecill", "cecill", "cecill(?: [0-9](?: [0-9])?)?"), ("blueoak-1.0.0", "blue oak", "blue oak model licen[cs]e"), ("mulan-psl-2.0", "mulan", "mulan psl v2"), ("hippocratic", "hippocratic", "hippocratic licen[cs]e"), ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter)(?: licen[cs]e)?"), ("commons-clause", "commons clause", "commons clause(?: licen[cs]e condition)?"), ("llama", "llama", "llama [234](?: [0-9])? community licen[cs]e"), ("gemma", "gemma terms", "gemma terms of use"),
    ("cc", "creativecommons org", "creativecommons org licenses by(?: nc)?(?: sa| nd)?(?: [1-4] [05])?"), ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"), ("cc", "this work is licensed", "this work is licensed under (?:a|the) creative commons"), ("cc", "copy of this licen", "to view a copy of this licen[cs]e visit"), ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"), ("public-domain", "no known copyright", "no known copyright restrictions"), ("public-domain", "no rights reserved", "no rights reserved"), ("some-rights-reserved", "some rights", "some rights reserved"),
    ("mit", "opensource org licenses", "opensource org licenses mit"), ("bsd", "opensource org licenses", "opensource org licenses bsd(?: [23] clause)?"), ("notice", "opensource org licenses", "opensource org licenses [^ ]+"), ("spdx", "spdx", "spdx licen[cs]e identifier [^ ]+"), ("notice", "no event shall", "in no event shall the (?:authors or copyright holders|copyright (?:holder|owner)s?|contributors) (?:or contributors )?be liable"), ("notice", "merchantability", "implied warranties of merchantability and fitness for a particular purpose"), ("notice", "as is without", "(?:is )?provided as is without (?:any )?warranty(?: of any kind)?"), ("notice", "copyleft", "copyleft"), ("patent-grant", "patent licen", "(?:grants? (?:to )?you a )?(?:perpetual worldwide )?non exclusive (?:no charge )?royalty free (?:irrevocable )?patent licen[cs]e"), ("cla", "contributor licen", "contributor licen[cs]e agreement"), ("dco", "developer certificate", "developer certificate of origin"), ("eula", "end user licen", "end user licen[cs]e agreement"), ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"), ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) (?:of this (?:file|software|document)|is (?:strictly )?prohibited)"), ("proprietary", "trade secret", "(?:contains|are|is) trade secrets? of"), ("proprietary", "internal use only", "for internal use only"), ("proprietary", "prior written", "may not be (?:copied|reproduced|redistributed|distributed) (?:or transmitted )?(?:in any form )?without (?:the |our )?prior written (?:permission|consent)"), ("non-commercial", "personal use only", "for personal use only"), ("non-commercial", "and educational", "for (?:research|academic) and educational (?:use|purposes) only"), ("crown", "crown copyright", "crown copyright"), ("press", "reprinted with", "reprinted with (?:the )?permission of"), ("press", "fair use", "fair use (?:doctrine|notice|policy)"), ("terms-of-service", "you agree to", "by using this (?:site|service|software) you agree to (?:the|our|these) terms of (?:service|use)"),
)
#: Phrases that tell of a licence without naming one: label, keyword, regex.
HINTS = (("public-domain", "public domain", "(?:in|into|to) the public domain"), ("public-domain", "cc0", "cc0(?: 1 0)?"), ("all-rights-reserved", "all rights", "all rights reserved"), ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"), ("spdx", "spdx", "spdx licen[cs]e identifier"), ("notice", "permission is hereby", "permission is hereby granted free of charge"), ("notice", "redistribution and use", "redistribution and use in source and binary forms"), ("notice", "without warranty", "without warranty of any kind"), ("notice", "provided as is", "provided as is"), ("non-commercial", "use only", "(?:for|non) (?:non ?)?commercial use only"), ("see-license", "licen", "see (?:the )?licen[cs]e"), ("licensed", "licen", "licen[cs]ed under"))

#: What stands before a name: as a grant (priority 3), as a reference (2).
GRANT = "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"
REFERENCE = "(?:see|covered by|subject to|governed by|under) (?:the )?"
#: Places in one block of a list.
BLOCK = 256


def names() -> list[tuple[str, str, str]]:
    """Label, keyword and regex of every license's names."""
    found = list(NAMES)
    for suffix, short, long in CONDITIONS:
        for version in VERSIONS:
            found.append((f"cc-{suffix}-{version.replace(' ', '.')}", f"cc {short}", f"cc {short} {version}"))
            found.append((f"cc-{suffix}-{version.replace(' ', '.')}", "creative commons", f"creative commons {long}{V}{version}"))
        found.append((f"cc-{suffix}", f"cc {short}", f"cc {short}"))
        found.append((f"cc-{suffix}", "creative commons", f"creative commons {long}"))
    return found


def signatures() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword and regex: each name as a grant (3), with what surrounds it as a reference (2), and bare (1); sentences of license texts (2); hints (0)."""
    found = [(label, priority, keyword, before + name) for priority, before in ((3, GRANT), (2, REFERENCE), (1, "")) for label, keyword, name in names()]
    return found + [(label, 2, keyword, regex) for label, keyword, regex in TEXTS] + [(label, 0, keyword, regex) for label, keyword, regex in HINTS]


def least_words(regex: str) -> int:
    """How many words a match has, at least."""
    while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", regex)) != regex:
        regex = shorter
    return regex.count(" ")


def together() -> list[tuple[str, str, list[tuple[str, int, int, str]]]]:
    """Keyword, one regex for all signatures of the keyword, and what a match can be, in order of the list: label, priority (-1: by what stands before the name), number and the regex of the whole match. Of the alternatives at one place those of more words come first."""
    groups: dict[tuple[str, int], list[tuple[str, int, int, str]]] = {}
    for number, (label, keyword, regex) in enumerate(names()):
        groups.setdefault((keyword, 0), []).append((label, -1, number, regex))
    for number, (label, priority, keyword, regex) in enumerate([(x, 2, k, r) for x, k, r in TEXTS] + [(x, 0, k, r) for x, k, r in HINTS]):
        groups.setdefault((keyword, 1 + priority), []).append((label, priority, 10_000 + number, regex))
    out = []
    for (keyword, kind), members in groups.items():
        before = f"(?:{GRANT}|{REFERENCE})?" if kind == 0 else ""
        alternatives = sorted((m[3] for m in members), key=lambda r: (-least_words(r), -len(r)))
        out.append((keyword, f"(?<= ){before}(?:{'|'.join(alternatives)})(?= )", [(label, priority, number, f"^{before}(?:{regex})$") for label, priority, number, regex in members]))
    return out


#: How sure a detection is, by priority.
SURE = (0.3, 0.6, 0.8, 1.0)


def anchors() -> list[str]:
    """A few strings of which every signature's match has one: "licen" where the regex can't match without it, else its keyword after a space."""

    def required(regex: str) -> str:
        while (shorter := re.sub(r"\(\?:[^()]*\)\??", "", regex)) != regex:
            regex = shorter
        return regex

    found = {"licen" if "licen[cs]e" in required(regex) else f" {keyword}" for _, _, keyword, regex in signatures()} | {f" {phrase}" for phrase, _ in BASE}
    return sorted(x for x in found if not any(o != x and o in x for o in found))


def _gate(lowered: Column) -> Column:
    return reduce(Column.__or__, [F.contains(lowered, F.lit(x)) for x in anchors()])


def _n_spaces(x: str) -> str:
    return f"(octet_length({x}) - octet_length(replace({x}, ' ', '')))"


PLACE = "struct<first: int, last: int, priority: int, number: int, label: string>"


def _blocks(items: str) -> str:
    """An array as arrays of BLOCK items."""
    return f"IF(size({items}) = 0, slice(array({items}), 1, 0), transform(sequence(0, (size({items}) - 1) div {BLOCK}), block -> slice({items}, block * {BLOCK} + 1, {BLOCK})))"


def _what(found: str) -> str:
    """Label, priority and number of a match."""
    by_words = f"CASE WHEN {found} RLIKE '^{GRANT}' THEN 3 WHEN {found} RLIKE '^{REFERENCE}' THEN 2 ELSE 1 END"
    return f"transform(slice(filter(rule.kinds, kind -> {found} RLIKE kind.regex), 1, 1), kind -> struct(IF(kind.priority < 0, {by_words}, kind.priority) AS priority, kind.number AS number, kind.label AS label))[0]"


def _marked() -> str:
    """The text's parts by one scan of a rule: what stands between its matches, and the matches, in turn."""
    return "split(regexp_replace(norm, rule.regex, concat(chr(1), '$0', chr(1))), chr(1))"


#: All intervals of one rule from its parts: the words of each match, counted from what stands before it.
_PLACES = f"""transform(array({_marked()}), parts -> transform(array(IF(size(parts) < 2, slice(array(struct(0 AS gap, 0 AS inside, '' AS found)), 1, 0), transform(sequence(1, size(parts) div 2), k -> struct({_n_spaces('parts[2 * k - 2]')} AS gap, {_n_spaces('parts[2 * k - 1]')} AS inside, parts[2 * k - 1] AS found)))),
    pairs -> flatten(aggregate({_blocks('pairs')}, struct(-1 AS at, cast(array() AS array<array<{PLACE}>>) AS done),
        (acc, some) -> struct(acc.at + aggregate(some, 0, (n, x) -> n + x.gap + x.inside) AS at, array_append(acc.done, aggregate(some, struct(acc.at AS at, cast(array() AS array<{PLACE}>) AS out),
            (a, x) -> struct(a.at + x.gap + x.inside AS at, array_append(a.out, transform(array({_what('x.found')}), w -> struct(a.at + x.gap AS first, a.at + x.gap + x.inside AS last, w.priority AS priority, w.number AS number, w.label AS label))[0]) AS out), a -> a.out)) AS done),
        acc -> acc.done)))[0])[0]"""

#: Places in order, the outer before the inner ones; reach: the furthest end so far of each priority.
_ORDERED = "array_sort(places, (a, b) -> CASE WHEN a.first <> b.first THEN a.first - b.first WHEN a.last <> b.last THEN b.last - a.last WHEN a.priority <> b.priority THEN b.priority - a.priority ELSE a.number - b.number END)"
_SUPPRESSED = f"""transform(array({_ORDERED}), ordered -> flatten(aggregate({_blocks('ordered')},
    struct(array(-1, -1, -1, -1) AS reach, slice(array(ordered), 1, 0) AS done),
    (acc, some) -> transform(array(aggregate(some, struct(acc.reach AS reach, slice(ordered, 1, 0) AS kept),
        (a, x) -> IF(array_max(slice(a.reach, x.priority + 1, 4)) >= x.last, a, struct(transform(a.reach, (r, i) -> IF(i = x.priority, greatest(r, x.last), r)) AS reach, array_append(a.kept, x) AS kept)))), now -> struct(now.reach AS reach, array_append(acc.done, now.kept) AS done))[0],
    acc -> acc.done)))[0]"""


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, base (array of phrase number, places, first and last start) and detections (array of first and last word, priority, number and label of the signatures that stay). Null texts are empty; texts without words have no detection; repeated rows and other columns change nothing."""
    kinds = [F.array(*[F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(number).alias("number"), F.lit(regex).alias("regex")) for label, priority, number, regex in members]) for _, _, members in together()]
    rules = F.array(*[F.struct(F.lit(f" {keyword}").alias("keyword"), F.lit(regex).alias("regex"), kind.alias("kinds")) for (keyword, regex, _), kind in zip(together(), kinds, strict=True)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(text, GAP, " ")).alias("words"))
    rows = rows.select("doc_id", "words", F.lower(F.concat(F.lit(" "), "words")).alias("lowered"))
    ascii_lowered = F.translate("words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select(
        "doc_id",
        F.when(F.col("words") == "", F.lit(0)).otherwise(F.expr(_n_spaces("words")) + 1).cast("long").alias("n_words"),
        F.when(_gate(F.col("lowered")), F.concat(F.lit(" "), ascii_lowered, F.lit(" "))).alias("norm"),
    )
    base = []
    for number, (phrase, _) in enumerate(BASE):
        parts = F.split("norm", f"(?<= ){phrase}(?= )")
        base.append((f"parts{number}", parts, len(phrase.split())))
    rows = rows.withColumns({name: parts for name, parts, _ in base})
    found = [
        F.struct(
            F.lit(number).alias("number"),
            (F.size(name) - 1).cast("long").alias("n"),
            (F.expr(_n_spaces(f"element_at({name}, 1)")) - 1).cast("long").alias("first"),
            (F.col("n_words") - F.expr(_n_spaces(f"element_at({name}, -1)")) + 1 - length).cast("long").alias("last"),
        )
        for number, (name, _, length) in enumerate(base)
    ]
    rows = rows.withColumn("base", F.when(F.col("norm").isNotNull(), F.filter(F.array(*found), lambda x: x["n"] > 0)))
    rows = rows.withColumn("rules", F.when(F.col("norm").isNotNull(), F.filter(rules, lambda r: F.contains(F.col("norm"), r["keyword"]))))
    rows = rows.withColumn("places", F.expr(f"flatten(transform(rules, rule -> {_PLACES}))"))
    return rows.select("doc_id", "n_words", F.coalesce("base", F.array().cast("array<struct<number: int, n: bigint, first: bigint, last: bigint>>")).alias("base"), F.when(F.size("places") > 0, F.expr(_SUPPRESSED)).alias("detections"))


def digest(scan: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_detections, score (how sure the surest detection is; a base place counts as a bare name)."""
    names = F.array(*[F.lit(label) for _, label in BASE])
    base_labels = F.transform("base", lambda x: F.get(names, x["number"]))
    detected = F.coalesce(F.expr("transform(detections, x -> x.label)"), F.array().cast("array<string>"))
    sure = F.array(*[F.lit(x) for x in SURE])
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: F.get(sure, x["priority"]))), F.lit(0.0))
    return scan.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(base, 0L, (a, x) -> a + x.n)").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, detected)), ",").alias("labels"),
        F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n_detections"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(SURE[1])).otherwise(0.0)).alias("score"),
    )
