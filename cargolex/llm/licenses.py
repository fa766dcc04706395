"""License scans by sentence rules.

A text's sentences are normalised (letters and digits of ASCII, lower case, single spaces) and looked up among known
sentences of licenses; the identifiers found, in order, are matched against ordered rules. Sentences are taken twice: with every line
end as a sentence end, and with lines joined, so that both one-line notices and wrapped license texts are found. What differs from notice to
notice (the subject, the holder's name, where the text stands, lists of licenses) is brought to one form before the lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# Names of licenses as they stand in notices.
NAMES = {
    "MIT": ["mit license", "mit licence", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gnu general public license v2 0"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gnu general public license v3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl v2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "ISC": ["isc license"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license v 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license version 1 0 august 17th 2003"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "CC0-1.0": ["cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international license", "creative commons attribution 4 0 license", "cc by 4 0"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license", "cc by sa 4 0"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 license", "cc by nc 4 0"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0 license", "cc by nd 4 0"],
    "CC-BY-NC-SA-4.0": ["creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike 4 0 license", "cc by nc sa 4 0"],
    "CC-BY-NC-ND-4.0": ["creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives 4 0 license", "cc by nc nd 4 0"],
    "Unlicense": ["unlicense"],
}
# Short names that stand for licenses in notices, but not by themselves.
SHORT = {
    "MIT": ["mit"], "Apache-2.0": ["apache 2 0", "apache 2", "apache v2", "apache license v2 0", "apache license 2"], "GPL-2.0": ["gplv2", "gnu gplv2", "gpl 2 0", "gpl version 2", "gnu gpl v2"],
    "GPL-3.0": ["gplv3", "gnu gplv3", "gpl 3 0", "gpl version 3", "gnu gpl v3"], "LGPL-2.1": ["lgplv2 1", "lgpl 2 1"], "LGPL-3.0": ["lgplv3", "lgpl 3 0"], "AGPL-3.0": ["agplv3", "agpl 3 0"],
    "BSD-2-Clause": ["bsd 2 clause"], "BSD-3-Clause": ["bsd 3 clause"], "MPL-2.0": ["mpl 2 0"], "ISC": ["isc"], "CC0-1.0": ["cc0", "cc0 1 0"], "BSL-1.0": ["boost license"], "Zlib": ["zlib"],
}
# Heads of whole license texts, a line with the title and one with the version.
HEADS = [
    ("Apache-2.0", "apache license", "version 2 0 january 2004"), ("GPL-2.0", "gnu general public license", "version 2 june 1991"), ("GPL-3.0", "gnu general public license", "version 3 29 june 2007"),
    ("LGPL-2.1", "gnu lesser general public license", "version 2 1 february 1999"), ("LGPL-3.0", "gnu lesser general public license", "version 3 29 june 2007"), ("AGPL-3.0", "gnu affero general public license", "version 3 19 november 2007"),
]
#: Identifiers of licenses with later versions.
LATER = {"GPL-2.0": "gpl2-or-later", "GPL-3.0": "gpl3-or-later", "LGPL-2.1": "lgpl21-or-later", "LGPL-3.0": "lgpl3-or-later", "AGPL-3.0": "agpl3-or-later"}
# How notices begin and end around a name.
OPENINGS = ["licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "this file is licensed under", "this program is licensed under", "this software is released under", "this code is licensed under"]
ARTICLES = ["the ", "a ", "", "the terms of the "]
# GNU licenses with later versions: word before "general", version, identifier; their headers have a subject of their own before "you can".
GNU = [("", "2", "gpl2-or-later"), ("", "3", "gpl3-or-later"), ("lesser ", "2 1", "lgpl21-or-later"), ("lesser ", "3", "lgpl3-or-later"), ("affero ", "3", "agpl3-or-later")]
# Sentences of license texts.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "you may not use this file except in compliance with the license": "apache-use",
    "http www apache org licenses license 2 0": "apache-url",
    "https www apache org licenses license 2 0": "apache-url",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-url",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-url",
    "the asf licenses this file to you under the apache license version 2 0": "named:Apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    **{f"you can redistribute it and or modify it under the terms of the gnu {gnu}general public license as published by the free software foundation either version {v} of the license or at your option any later version": known for gnu, v, known in GNU},
    **{f"you can redistribute it and or modify it under the terms of the gnu general public license version {v} as published by the free software foundation": f"named:GPL-{v}.0" for v in (2, 3)},
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}
#: Ordered rules: a license and the identifiers that have to follow each other, others between them or not.
RULES = [
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("Apache-2.0", ["apache-use", "apache-url"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-grant"]),
    *((name, [f"named:{name}"]) for name in NAMES),
    *((name, [f"title:{title}", f"version:{version}"]) for name, title, version in HEADS),
]
#: A longer rule's license stands for the shorter one's.
INSTEAD = {"BSD-2-Clause": "BSD-3-Clause"}
#: Only texts with one of these are cut into sentences; every known sentence has one.
HINT = r"licens|licence|gpl|copyright|permission|redistribut|warrant|cc0|cc by|cc-by|public domain"


def known_sentences() -> dict[str, str]:
    notices = {f"{o} {a}{n}": f"named:{name}" for table in (NAMES, SHORT) for name, names in table.items() for n in names for o in OPENINGS for a in ARTICLES}
    notices |= {f"{o} {a}{n}{later}": known for table in (NAMES, SHORT) for name, known in LATER.items() for n in table[name] for o in OPENINGS for a in ARTICLES for later in (" orlater", "orlater")}
    titles = {f"{a}{n}": f"named:{name}" for name, names in NAMES.items() for n in names for a in ("", "the ")}
    heads = {x: f"{kind}:{x}" for _, title, version in HEADS for kind, x in (("title", title), ("version", version))}
    tags = {f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}": f"named:{name}" for name in NAMES}
    for name, known in LATER.items():
        tag = f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}"
        tags |= {f"{tag} only": f"named:{name}", f"{tag} or later": known}
    return notices | titles | heads | tags | SENTENCES


# What varies in notices. Patterns know no look-around, so that SQL can say them too.
SUBJECT = r"^(?:[a-z0-9]+ ){1,12}(?:is|are) (?:dual |also |hereby )?(licensed|released|distributed|available|published) under "
#: Sentences that begin so say nothing of what they stand in.
NO_SUBJECT = r"^(?:if|when|unless|whether|not|nothing|no|none|neither) "
OPENED = r"^(?:licensed|released|distributed|available|published) under "
#: Replacements in a sentence that opens so, in this order: a list's items get openings of their own, on lines of their own.
VARIANTS = [
    (r" see (?:the )?(?:[a-z0-9]+ ){0,4}(?:license|licence|copying|notice|readme)(?: [a-z0-9]+){0,8}$", ""), (r" terms and conditions ", " terms "), (r" under (?:either of|either|both) ", " under "),
    (r" or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?", " orlater"), (r" at your option$", ""), (r" (?:and or|or|and)(?: at your option)? ", "\nlicensed under "),
]
HOLDER = r"^(?:[0-9a-d] )?(?:neither the names? of .+ may|the names? of .+ may not) be used to endorse or promote products derived from this software without (?:specific )?prior written permission(?: of .+| from .+)?$"
HELD = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"


#: A version and those after it, outside of tags.
PLUS = r"(gpl ?v?[0-9](?:\.[0-9])?)\+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES, _END = r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*", r"[.!?;:]+[ \t\r\n]+|[.!?;:]+$|\n"
#: A license tag: each license of its expression is a sentence (group 1), whatever stands around it. An exception goes with its license.
_TAG = r"(?:spdx-license-identifier:[ \t]*|\G(?!^)[ \t]+(?:and|or)[ \t]+)[(]*([a-z0-9.+-]*[a-z0-9+-])[)]*(?:[ \t]+with[ \t]+[a-z0-9.+-]*[a-z0-9+-][)]*)?"
#: Characters inside of known sentences that would cut them, and the name that notices give the license.
_INSIDE = r"(?<=\bv)\.(?=[ \t\r\n*#/]+[0-9])|(?<=software foundation)[;:](?=[ \t\r\n*#/]+either )|\(the [\"“”']*licen[sc]e[\"“”']*\)"


def _uncut(text: Column) -> Column:
    """A text whose known sentences the cut leaves whole."""
    later = F.regexp_replace(F.regexp_replace(text, r"(?<=gpl-[0-9]\.[0-9])\+", "-or-later"), PLUS, "$1 or later")
    return F.regexp_replace(F.regexp_replace(later, _TAG, ". spdx-license-identifier $1. "), _INSIDE, "")


def _sentences(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, _END, "\n"), "\n", -1), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def _one_form(sentences: Column) -> Column:
    """Sentences without what varies from notice to notice; a list of licenses is a sentence for each."""
    own = F.transform(sentences, lambda s: F.when(s.rlike(NO_SUBJECT), s).otherwise(F.regexp_replace(s, SUBJECT, "$1 under ")))
    plain = lambda s: reduce(lambda acc, v: F.regexp_replace(acc, v[0], v[1]), VARIANTS, s)
    return F.flatten(F.transform(own, lambda s: F.when(s.rlike(OPENED), F.split(plain(s), "\n", -1)).when(s.rlike(HOLDER), F.array(F.lit(HELD))).otherwise(F.array(s))))


def _followed(ids: Column, wanted: list[str]) -> Column:
    """Whether the identifiers follow each other in ids."""
    start = F.lit(0)
    at = reduce(lambda acc, w: F.when(acc >= 0, _next(ids, w, acc)).otherwise(-1), wanted, start)
    return at >= 0


def _next(ids: Column, wanted: str, after: Column) -> Column:
    found = F.array_position(F.slice(ids, after + 1, F.greatest(F.size(ids) - after, F.lit(0))), wanted)
    return F.when(found > 0, after + found).otherwise(F.lit(-1)).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (license sentences known, in the reading that knows more), sentence_ids (comma-joined) and licenses
    (those of both readings, comma-joined, in the order of the rules; empty if none).

    Null, empty and other texts without license words have none; a sentence that is repeated counts each time; repeated rows are scanned alike;
    an empty table gives an empty one; other columns are not looked at.
    """
    known = F.map_from_arrays(F.array(*map(F.lit, known_sentences())), F.array(*map(F.lit, known_sentences().values())))
    df = texts(docs).select("doc_id", F.translate(F.coalesce("text", F.lit("")), _UPPER, _SMALL).alias("t"))
    df = df.select("doc_id", F.when(F.col("t").rlike(HINT), _uncut(F.col("t"))).alias("t"))
    joined = F.replace(F.regexp_replace("t", _LINES, ". "), F.lit("\n"), F.lit(" "))
    df = df.select("doc_id", _one_form(_sentences(F.col("t"))).alias("a"), _one_form(_sentences(joined)).alias("b"))
    ids = lambda c: F.coalesce(F.filter(F.transform(c, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    df = df.select("doc_id", ids("a").alias("a"), ids("b").alias("b"))
    df = df.select("doc_id", F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")).alias("ids"), F.array("a", "b").alias("readings"))
    has = lambda wanted: lambda ids: _followed(ids, wanted)
    hits = F.array_compact(F.array(*(F.when(F.exists("readings", has(wanted)), F.lit(name)) for name, wanted in RULES)))
    out = df.select("doc_id", "ids", F.array_distinct(F.when(F.size("ids") > 0, hits).otherwise(F.array().cast("array<string>"))).alias("found"))
    for short, long in INSTEAD.items():
        out = out.withColumn("found", F.when(F.array_contains("found", long), F.array_remove("found", short)).otherwise(F.col("found")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"))
