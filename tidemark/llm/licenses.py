"""Operator 9: licence scans by ordered signature rules (native).

A text becomes words (ASCII letters lower-cased; a word is a run of 0-9, a-z and characters
beyond ASCII), joined by single blanks. Texts without any of the words that a rule needs around
its name (GATE, made from the rules) stop there. The others meet the rule table: each rule has a priority, a label, a keyword that the text must hold before
its regex is tried, and a confidence. A detection that lies inside one of a rule with higher
priority (or inside a longer one of the same priority) is suppressed.

Three base phrases (BASE) are always counted, whatever the rules say.

Defined cases: a null text counts as empty; no words give zero counts, empty labels, null
first and last word and score 0; repeated rows give repeated results; other columns are
kept, but ones called n_words, base or detections are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name
from .spans import bound, in_runs, match_spans

# Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword, regex of the name in normalised words.
FAMILIES = (
    ("mit", "mit", "(?:the )?mit"),
    ("mit-0", "attribution", "mit no attribution"),
    ("x11", "x11", "x11"),
    ("expat", "expat", "expat"),
    ("isc", "isc", "(?:the )?isc"),
    ("apache-1.1", "apache", "apache(?: software)? (?:v|version )?1 1"),
    ("apache-2.0", "apache", "apache(?: software)? (?:v|version )?2(?: 0)?"),
    ("apache", "apache", "(?:the )?apache(?: software)?"),
    ("bsd-0-clause", "bsd", "(?:zero clause bsd|bsd zero clause)"),
    ("bsd-0-clause", "0bsd", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause(?: simplified)?|2 clause bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:(?:new|modified|revised) bsd|bsd 3 clause(?: (?:new|modified|revised|new or revised))?|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", "(?:the )?bsd(?: style)?"),
    ("gpl-1.0", "public", "(?:gnu )?general public license (?:v|version )?1(?: 0)?"),
    ("gpl-2.0", "public", "(?:gnu )?general public license (?:v|version )?2(?: 0)?"),
    ("gpl-3.0", "public", "(?:gnu )?general public license (?:v|version )?3(?: 0)?"),
    ("gpl", "public", "(?:gnu )?general public"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: ?v?[123])?"),
    ("lgpl-2.1", "public", "(?:gnu )?(?:lesser|library) general public license (?:v|version )?2(?: [01])?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license (?:v|version )?3(?: 0)?"),
    ("lgpl", "public", "(?:gnu )?(?:lesser|library) general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license (?:v|version )?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: ?v?3)?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:v|version )?1 [01]"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:v|version )?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public license (?:v|version )?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license (?:v|version )?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("edl", "eclipse", "eclipse distribution"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("cpal", "attribution", "common public attribution"),
    ("eupl", "european", "european union public"),
    ("artistic-2.0", "artistic", "artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("boost", "boost", "boost software"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl"),
    ("cc0", "creative", "creative commons (?:zero|cc0|0)(?: 1 0)?(?: universal)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?"),
    ("odbl", "database", "open database"),
    ("openssl", "openssl", "openssl"),
    ("php", "php", "php"),
    ("python", "python", "python(?: software foundation)?"),
    ("ruby", "ruby", "ruby"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("afl", "academic", "academic free"),
    ("osl", "open", "open software"),
    ("ofl", "font", "(?:sil )?open font"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("mulan", "mulan", "mulan (?:psl|permissive software)"),
    ("bsl", "business", "business source"),
    ("sspl", "server", "server side public"),
    ("elastic", "elastic", "elastic"),
    ("proprietary", "proprietary", "proprietary"),
)
#: confidence and shape around a name; the order gives the priority within a family.
GRANT = "(?:licen[sc]ed|released|distributed|available|provided)(?: to you)? under"
SHAPES = (
    (0.99, "spdx license identifier {}(?: or later| only)?"),
    (0.95, f"{GRANT} (?:the )?(?:terms of )?(?:the )?{{}}(?: licen[sc]e)?"),
    (0.9, "{} licen[sc]ed?(?: (?:v|version )?[0-9](?: [0-9])?)?"),
    (0.8, "licen[sc]e {}"),
)
# Identifiers of licences as their registry writes them, with the versions they come in.
IDENTIFIERS = {
    "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "apache": "1.0 1.1 2.0", "mpl": "1.0 1.1 2.0",
    "epl": "1.0 2.0", "cddl": "1.0 1.1", "cpl": "1.0", "cpal": "1.0", "eupl": "1.0 1.1 1.2", "ofl": "1.0 1.1", "bsl": "1.0", "busl": "1.1",
    "afl": "1.1 1.2 2.0 2.1 3.0", "osl": "1.0 2.0 2.1 3.0", "artistic": "1.0 2.0", "ecl": "1.0 2.0", "zpl": "2.0 2.1", "sspl": "1.0",
    "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc-by-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0", "odbl": "1.0", "mulanpsl": "1.0 2.0",
}
UNVERSIONED = ("ms-pl", "ms-rl")
#: labels of identifiers that have another name elsewhere in the table.
ALIASES = {"bsl-1.0": "boost", "busl-1.1": "bsl"}
#: a word of a holder's or product's name.
NAME = r"[0-9a-z\x80-\uffff]+"
GNU = "you can redistribute it and or modify it under the terms of the gnu"
LATER = "of the license or (?:at your option )?any later version"
#: passages of notices and full licences: label, words that every match holds, confidence, regex. They rank before names.
HEADERS = (
    ("mit", "permission is hereby granted", 0.98, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "this permission notice", 0.95, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("boost", "permission is hereby granted", 0.97, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "with or without fee", 0.95, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0-clause", "with or without fee", 0.9, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software"),
    ("hpnd", "without fee is hereby granted", 0.85, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("postgresql", "without a written agreement", 0.9, "without fee and without a written agreement is hereby granted"),
    ("bsd", "redistributions of source code must retain", 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "to endorse or promote products", 0.95, f"neither the names? of (?:{NAME} ){{1,12}}(?:nor the names of (?:its|the|their) contributors )?may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "may not be used to endorse or promote", 0.93, f"the names? of (?:{NAME} ){{1,12}}may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features", 0.97, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-1.1", "must include the following acknowledgment", 0.9, "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("apache-2.0", "except in compliance with the license", 0.85, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed", 0.85, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache license version 2 0", 0.97, "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "licensed to the apache software foundation", 0.97, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-2.0", "either version 2 of the license", 0.97, f"{GNU} general public license as published by the free software foundation either version 2 {LATER}"),
    ("gpl-3.0", "either version 3 of the license", 0.97, f"{GNU} general public license as published by the free software foundation either version 3 {LATER}"),
    ("gpl-2.0", "as published by the free software foundation", 0.95, f"{GNU} general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3.0", "as published by the free software foundation", 0.95, f"{GNU} general public license version 3 (?:only )?as published by the free software foundation"),
    ("gpl", "general public license along with this program", 0.85, "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-2.0", "either version 2 of the license", 0.97, f"{GNU} (?:lesser|library) general public license as published by the free software foundation either version 2 {LATER}"),
    ("lgpl-2.1", "either version 2 1 of the license", 0.97, f"{GNU} lesser general public license as published by the free software foundation either version 2 1 {LATER}"),
    ("lgpl-3.0", "either version 3 of the license", 0.97, f"{GNU} lesser general public license as published by the free software foundation either version 3 {LATER}"),
    ("lgpl", "you should have received a copy of the gnu", 0.85, "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "either version 3 of the license", 0.97, f"{GNU} affero general public license as published by the free software foundation either version 3 {LATER}"),
    ("agpl", "you should have received a copy of the gnu", 0.85, "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "copy distribute and or modify this document", 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "this is free software and you are welcome", 0.6, "this is free software and you are welcome to redistribute it under certain conditions"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 0.99, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 0.99, "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 0.99, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 0.99, "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 0.99, "gnu affero general public license version 3 19 november 2007"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla", 0.97, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms", 0.97, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed", 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("npl", "the contents of this file are subject to the netscape", 0.97, "the contents of this file are subject to the netscape public license"),
    ("epl-1.0", "this program and the accompanying materials", 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", "this program and the accompanying materials", 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0"),
    ("edl", "this program and the accompanying materials", 0.95, "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cddl", "the contents of this file are subject to the terms of the common", 0.97, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "in no event will the authors be held liable", 0.9, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions must be plainly marked", 0.97, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "free and unencumbered software", 0.98, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to", 0.97, "do what the fuck you want to(?: public license)?"),
    ("beerware", "you can buy me a beer", 0.95, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("cc0", "waived all copyright and related", 0.95, "waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons", 0.95, "this work is licensed under a creative commons attribution(?: [1-4] 0)? (?:international|unported|generic) license"),
    ("cc-by-sa", "this work is licensed under a creative commons", 0.95, "this work is licensed under a creative commons attribution share ?alike(?: [1-4] 0)? (?:international|unported|generic) license"),
    ("artistic", "under the same terms as perl itself", 0.9, "(?:it|redistribute it) (?:and or modify it )?under the same terms as perl itself"),
    ("ofl", "this font software is licensed under", 0.97, "this font software is licensed under the sil open font license version 1 1"),
    ("openssl", "developed by the openssl project", 0.9, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "this source file is subject to version 3", 0.95, "this source file is subject to version 3 0?1? ?of the php license"),
    ("python", "psf is making python", 0.95, "psf is making python available to licensee on an as is basis"),
    ("ms-pl", "if you use the software you accept this license", 0.8, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("public-domain", "dedicate any and all copyright interest", 0.9, "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "copyright to this source code", 0.9, "the authors? disclaims? copyright to this source code"),
    ("public-domain", "has been put in the public domain", 0.85, "has been put in the public domain"),
    ("proprietary", "unauthorized copying of this file", 0.9, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", 0.8, "proprietary and confidential"),
    ("proprietary", "may not be reproduced", 0.7, "may not be reproduced (?:or )?(?:distributed )?(?:or transmitted )?in any form"),
    ("proprietary", "trade secret", 0.6, "contains (?:confidential information and )?trade secrets?"),
    ("classpath-exception", "classpath", 0.9, "classpath exception(?: 2 0)?"),
    ("classpath-exception", "linking this library statically or dynamically", 0.95, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", "gcc runtime library exception", 0.95, "gcc runtime library exception(?: version 3 1)?"),
    ("llvm-exception", "llvm exception", 0.95, "(?:with )?llvm exceptions?"),
    ("font-exception", "font exception", 0.9, "(?:with )?font exception(?: 2 0)?"),
    ("autoconf-exception", "autoconf", 0.9, "autoconf (?:configure script )?exception"),
    ("bison-exception", "bison", 0.9, "bison (?:parser )?exception"),
    ("openssl-exception", "openssl", 0.9, "openssl (?:linking )?exception"),
    ("linking-exception", "linking exception", 0.85, "(?:static )?linking exception"),
    ("gpl-exception", "as a special exception", 0.8, "as a special exception (?:to the gnu general public license|the copyright holders|the free software foundation|if you)"),
    ("commons-clause", "commons clause", 0.9, "commons clause(?: license)? condition"),
)
DUAL = "dual(?:ly)? (?:licen[sc]ed? )?(?:under )?(?:the )?"
#: further signatures: label, keyword, confidence, regex.
NOTICES = (
    ("notice", "reserved", 0.7, "all rights reserved"),
    ("notice", "copyright", 0.6, "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("permission", "permission", 0.75, "permission is hereby granted free of charge"),
    ("redistribution", "redistribution", 0.75, "redistribution and use in source and binary forms"),
    ("warranty", "warrant", 0.7, "(?:provided )?as is without warrant(?:y|ies)"),
    ("public-domain", "domain", 0.7, "(?:in|into|to) the public domain"),
    ("mit", "dual", 0.8, f"{DUAL}mit"),
    ("apache-2.0", "dual", 0.8, f"{DUAL}(?:mit (?:or |and )?)?apache(?: 2 0)?"),
    ("mit", "dual", 0.8, f"{DUAL}apache(?: 2 0)? (?:or |and )?mit"),
)


def _by_first_letter(words: list[str]) -> str:
    """A pattern of any of the words that tells by the first letter which of them are tried."""
    letters = {w[0]: sorted(x[1:] for x in words if x[0] == w[0]) for w in sorted(words)}
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items())


_NUMBERED = _by_first_letter([name for name in IDENTIFIERS if not name.startswith("cc")])
#: what every rule's match holds, in words of any case: the other shapes and the base phrases hold the first. All begin a word.
GATE = "(?i)(?:^| )(?:" + "|".join([
    "licen[sc]e", GRANT, *sorted({words for _, words, *_ in HEADERS if "license" not in words}), *(rx for *_, rx in NOTICES), f"(?:{_NUMBERED}) (?:v ?|version )?[0-9]", "cc by", *(x.replace("-", " ") for x in UNVERSIONED),
]) + ")"
#: characters of a piece of text in which blanks are counted at once.
PIECE = 16384
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def identifiers() -> list[tuple[str, str, float, str]]:
    """label, keyword, confidence and regex of each identifier and version: "gpl 2 0 only", "gpl version 2", "gpl v2"."""
    out = []
    for name, versions in IDENTIFIERS.items():
        words = name.replace("-", " ")
        for version in versions.split():
            major, minor = version.split(".")
            number = f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?(?= (?:[^0-9]|$))"
            if name.startswith("cc"):
                number = f"{major} {minor}"
            label = f"{name}-{version}"
            out.append((ALIASES.get(label, label), words, 0.95, f"(?:gnu )?{words} (?:v ?|version )?{number}(?: only| or later| plus)?"))
    return out + [(name, name.replace("-", " "), 0.95, f"{name.replace('-', ' ')}") for name in UNVERSIONED]


def rules() -> list[dict]:
    """The rule table: headers, identifiers, every family in every shape, then the notices; the smaller p, the higher the priority."""
    named = [
        (label, word, weight, shape.format(f"(?:{name})"))
        for label, word, name in FAMILIES
        for weight, shape in SHAPES
    ]
    return [
        {"p": p, "label": label, "kw": f" {word}" if word != "unlicense" else word, "w": weight, "rx": f"(?<= ){rx}(?= )"}
        for p, (label, word, weight, rx) in enumerate([*HEADERS, *identifiers(), *named, *NOTICES])
    ]


def _rule_table() -> Column:
    return F.from_json(F.lit(json.dumps(rules())), "array<struct<p:int,label:string,kw:string,w:double,rx:string>>")


def _words(padded: Column) -> Column:
    """Number of words in a piece of normalised text."""
    bare = F.trim(padded)
    return F.when(bare == "", F.lit(0)).otherwise(_blanks(bare) + 1)


def _blanks(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _cuts(norm: Column) -> Column:
    """array<struct<t, n>>: the text in pieces of PIECE characters, each with the number of blanks before it."""
    return bound(
        F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)),
        lambda t: bound(
            F.transform(t, _blanks),
            lambda n: F.zip_with(
                t,
                F.transform(n, lambda _, i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda acc, x: acc + x)),
                lambda piece, before: F.struct(piece.alias("t"), before.alias("n")),
            ),
        ),
    )


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, base (places of each base phrase) and detections (label, word_start, word_end, score, priority)."""
    norm_name, found_name, cuts_name = fresh_name(df, "_norm"), fresh_name(df, "_found"), fresh_name(df, "_cuts")
    words = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SEPARATOR, " ")
    df = df.withColumn(norm_name, words)
    gate = F.col(norm_name).rlike(GATE)
    df = df.withColumn("n_words", _words(F.col(norm_name)).cast("long"))
    # beyond the gate only; others carry no text further
    df = df.withColumn(norm_name, F.when(gate, F.concat(F.lit(" "), F.trim(_lower(F.col(norm_name))), F.lit(" "))))
    norm = F.col(norm_name)

    def at(upto: Column) -> Column:
        """The number of the word that begins after so many characters."""
        i = F.floor((upto - 1) / PIECE).cast("int")
        cut = F.get(F.col(cuts_name), i)
        return cut["n"] + _blanks(F.substring(cut["t"], F.lit(1), upto - i * PIECE)) - 1

    places = []
    for phrase, label in BASE:
        parts = F.split(norm, f" (?={phrase} )", -1)
        places.append(
            F.when(
                F.instr(norm, f" {phrase} ") > 0,
                F.struct(
                    F.lit(label).alias("label"),
                    (F.size(parts) - 1).cast("long").alias("n"),
                    _words(parts[0]).cast("long").alias("first"),
                    (F.col("n_words") - _words(F.element_at(parts, -1))).cast("long").alias("last"),
                ),
            )
        )
    df = df.withColumn("base", F.when(norm.isNotNull(), F.array_compact(F.array(*places))))

    live = F.filter(_rule_table(), lambda r: F.instr(norm, r["kw"]) > 0)
    found = F.flatten(
        F.transform(
            live,
            lambda r: F.transform(
                match_spans(norm, r["rx"]),
                lambda x: F.struct(
                    x["s"].alias("s"), x["e"].alias("e"), r["p"].alias("p"), r["label"].alias("label"), r["w"].alias("w")
                ),
            ),
        )
    )
    # in runs by start, each with its first start and its last end: only runs that reach over a detection are searched
    runs = F.transform(
        in_runs(F.array_sort(found)),
        lambda run: F.struct(F.get(run, F.lit(0))["s"].alias("lo"), F.array_max(F.transform(run, lambda x: x["e"])).alias("hi"), run.alias("run")),
    )
    df = df.withColumn(found_name, F.when(norm.isNotNull(), runs))
    df = df.withColumn(cuts_name, F.when(F.exists(found_name, lambda r: F.size(r["run"]) > 0), _cuts(norm)))
    inside = lambda x, y: (
        (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & ((y["p"] < x["p"]) | ((y["p"] == x["p"]) & (y["e"] - y["s"] > x["e"] - x["s"])))
    )
    # a longer span of a later rule wins over a shorter one inside it only where the rule ranks higher
    covered = lambda x: F.exists(
        found_name, lambda r: (r["lo"] <= x["s"]) & (r["hi"] >= x["e"]) & F.exists(r["run"], lambda y: inside(x, y))
    )
    kept = F.flatten(F.transform(found_name, lambda r: F.filter(r["run"], lambda x: ~covered(x))))
    df = df.withColumn(
        "detections",
        F.transform(
            kept,
            lambda x: F.struct(
                x["label"].alias("label"),
                at(x["s"]).cast("long").alias("word_start"),
                at(x["e"] + 1).cast("long").alias("word_end"),
                x["w"].alias("score"),
                x["p"].alias("priority"),
            ),
        ),
    )
    return df.drop(norm_name, found_name, cuts_name)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts, places and labels."""
    base = F.coalesce("base", F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
    hits = F.coalesce(
        "detections",
        F.array().cast("array<struct<label:string,word_start:bigint,word_end:bigint,score:double,priority:int>>"),
    )
    labels = F.transform(base, lambda b: b["label"])
    total = F.aggregate(base, F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
    best = F.aggregate(hits, F.lit(0.0), lambda acc, d: F.greatest(acc, d["score"]))
    return scanned.select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_distinct(F.concat(labels, F.transform(hits, lambda d: d["label"])))), ","
        ).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )
