"""License scans: MinHash bands over overlapping word windows retrieve templates, containment decides.

Texts and templates are words ``[a-z0-9]+`` in lower case, and sets of 3-word shingles. A template of n words is looked
for in windows of the least power of two W with n <= W / 2 + 1, one every W / 2 words, so that it lies wholly in one of
them; such a window has at most W - 2 shingles, of which at least n - 2 are the template's. Every band is one MinHash
value; with ``BANDS`` bands a window that holds a whole template is missed with probability
(1 - (n - 2) / (W - 2)) ** BANDS at most (``miss_probability``): 4e-15 for the shortest and 5e-6 or less for any.

Only a window with enough shingles of templates of its size can be found, so signatures are made for those windows alone.

``TEMPLATES`` are the usual phrasings of short notices, the headers, and the texts of short licenses. Containment cannot
tell long texts that differ in a word, so of those only the parts are templates in which kinds and versions differ: a
GPL-2.0 notice holds under 0.8 of every GPL-3.0 template. Long licenses (GPL, MPL and others) are found by title, notice
and a sentence of their own, not by any of their sections. ``BSD`` is the opening that all BSD licenses share. A license
that is only mentioned in another's text is found too, and the SPDX tag of MIT-0 also counts as that of MIT. All of it is DataFrame expressions; the table of templates is a parameter of at most ``MOST_TEMPLATES`` rows and broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import let, text_of

BANDS = 48
SHINGLE = 3
MOST_TEMPLATES = 5000
# Words of licenses whose text is short, and the parts of others that stand in no other license.
_TEXTS = {
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
        """to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""],
    "MIT-0": ["to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED", "SPDX-License-Identifier: MIT-0"],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "0BSD": ["for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"],
    "BSD-2-Clause": ["other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"],
    "BSD-3-Clause": ["provided with the distribution. Neither the name of", "provided with the distribution. 3. Neither the name of",
        "provided with the distribution. c. Neither the name of", "provided with the distribution. iii. Neither the name of"],
    "BSD-4-Clause": ["""All advertising materials mentioning features or use of this software must display the following
        acknowledgement"""],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
        """The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSL-1.0": ["""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software"""],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
        through 9 of this document."""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "GPL-3.0": ["is intended to guarantee your freedom to share and change all versions of a program"],
    "GPL-2.0": ["This General Public License applies to most of the Free Software Foundation's software"],
    "LGPL-3.0": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3"],
}
# Usual phrasings of short notices. Those of at most four shingles must be there whole, so versions and kinds stay apart.
_NAMED = {"MIT": "MIT", "ISC": "ISC", "Zlib": "zlib", "Unlicense": "Unlicense", "0BSD": "0BSD", "WTFPL": "WTFPL"}
_GNU = {"GPL": ("GNU General Public License", ["1", "2", "3"]), "LGPL": ("Lesser General Public License", ["2.1", "3"]),
        "AGPL": ("Affero General Public License", ["3"])}
_OTHERS = {"MPL": ("Mozilla Public License", ["1.1", "2.0"]), "EPL": ("Eclipse Public License", ["1.0", "2.0"])}
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-NC": "Attribution NonCommercial", "BY-ND": "Attribution NoDerivatives",
             "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}


def _phrasings() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, word in _NAMED.items():
        out[name] = [f"the {word} license", f"under {word} license", f"an {word} license", f"a {word} license", f"is {word} licensed",
                     f"{word} license copyright", f"SPDX-License-Identifier: {word}"]
    for kind, (title, versions) in _GNU.items():
        for v in versions:
            full = f"GNU {title}" if "." in v else title
            phrases = [f"{full}, version {v}", f"{full} v{v}", f"{full} {v}", f"{kind} version {v}"]
            phrases += [f"{lead} {kind} v{v}" for lead in ("the", "GNU", "under")] + [f"{kind} v{v} {tail}" for tail in ("license", "or later", "only")]
            phrases += [f"the {kind}v{v} license", f"under the {kind}v{v}", f"licensed under {kind}v{v}", f"released under {kind}v{v}",
                        f"{kind}v{v} or later", f"public license {kind}v{v}"]
            phrases.append(f"{kind}-{v}" if "." in v else f"{kind}-{v}.0")
            out[f"{kind}-{v}" if "." in v else f"{kind}-{v}.0"] = phrases
    out["LGPL-2.0"] = ["Library General Public License, version 2", "LGPL version 2.0", "LGPL-2.0"]
    for kind, (title, versions) in _OTHERS.items():
        for v in versions:
            out[f"{kind}-{v}"] = [f"{title} version {v}", f"{title} v. {v}", f"{title} v{v}", f"{title} {v}", f"{kind} {v}"]
    out["Apache-2.0"] = ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 license", "Apache License 2",
                         "under Apache 2.0", "under the Apache 2.0", "under the Apache 2 license", "SPDX-License-Identifier: Apache-2.0"]
    out["BSL-1.0"] = ["Boost Software License version 1.0", "Boost Software License 1.0", "BSL-1.0"]
    out["CC0-1.0"] = ["CC0 1.0", "creativecommons.org/publicdomain/zero/1.0"]
    for n, words in {"2": ["two", "simplified"], "3": ["three", "new", "revised", "modified"], "4": ["four"]}.items():
        out[f"BSD-{n}-Clause"] = [f"BSD {n} clause", f"{n} clause BSD"] + [x for w in words for x in (
            (f"{w} clause BSD", f"BSD {w} clause") if w in ("two", "three", "four") else (f"the {w} BSD license", f"under {w} BSD license"))]
    for kind, title in _CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"Creative Commons {title} {v}", f"licenses/{kind}/{v}"]
    return out


def _notices() -> dict[str, list[str]]:
    """The notices of the GNU licenses, by the words that name the kind and those that name the version.

    What stands between is the same in all and would make them alike. The two shingles across the join are in no text:
    with 10 to 14 shingles a containment of 0.8 then asks for all the others, and a whole notice has 0.8 to 0.86.
    """
    out: dict[str, list[str]] = {}
    for kind, (start, versions) in {"GPL": ("the GNU", ["2", "3"]), "LGPL": ("GNU Lesser", ["2.1", "3"]), "AGPL": ("GNU Affero", ["3"])}.items():
        for v in versions:
            end = "of" if "." in v else "of the"
            first = f"{start} General Public License as published"
            first += "" if kind == "GPL" else " by"
            name = f"{kind}-{v}" if "." in v else f"{kind}-{v}.0"
            out[name] = [f"{first} either version {v} {end}", f"{first} Foundation version {v} {end}"]
            if kind == "GPL":
                out[name] += [f"the terms of version {v} of the GNU the GNU General Public License",
                              f"licensed under version {v} of the GNU the GNU General Public License"]
    out["LGPL-2.0"] = [f"GNU Library General Public License as published by {w} version 2 of the" for w in ("either", "Foundation")]
    out["GPL-1.0"] = ["the GNU General Public License as published either version 1 or at"]
    return out


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _templates() -> dict[str, str]:
    """Each text under the name of its license; the second and later ones of a license have "/2", "/3" and so on."""
    out: dict[str, str] = {}
    named: dict[str, list[str]] = {}
    for group in (_phrasings(), _notices(), _TEXTS):
        for name, texts in group.items():
            named.setdefault(name, []).extend(texts)
    for name, texts in named.items():
        distinct = dict.fromkeys(" ".join(template_words(t)) for t in texts)
        out |= {name if k == 0 else f"{name}/{k + 1}": text for k, text in enumerate(distinct)}
    return out


TEMPLATES = _templates()


def window_size(n: int) -> int:
    """Words of the windows in which a template of ``n`` words is looked for."""
    size = 4
    while n > size // 2 + 1:
        size *= 2
    return size


def miss_probability(n: int, containment: float = 1.0) -> float:
    """At most this chance that a window with that share of a template's shingles collides in no band."""
    return (1 - containment * (n - SHINGLE + 1) / (window_size(n) - SHINGLE + 1)) ** BANDS


def _shingles(words: Column) -> Column:
    """Distinct runs of three words, as strings."""
    return let(words, lambda w: F.when(F.size(w) >= SHINGLE, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))).otherwise(
        F.array().cast("array<string>")))


def _bands(shingles: Column) -> Column:
    """One MinHash value per band; null for no shingles."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return let(hashed, lambda h: F.array(*[F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(k)))) for k in range(BANDS)]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """``doc_id, license, containment, first_word, n_windows``: one row per document and template found in it.

    ``license`` is the name of the template: in ``TEMPLATES`` what stands before "/" is the license.

    ``containment`` is the largest share of the template's shingles in one window, ``first_word`` where the first such
    window begins (in words, from 0), ``n_windows`` the windows that hold enough of it. Texts without three words, null
    and empty ones have no rows; rows that repeat an id count as one document, and so do those without an id. No
    documents: no rows. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    words = {name: template_words(t) for name, t in templates.items()}
    if not words or len(words) > MOST_TEMPLATES or min(map(len, words.values())) < SHINGLE:
        raise ValueError(f"templates must be 1 to {MOST_TEMPLATES} texts of {SHINGLE} words or more")
    rows = [F.struct(F.lit(n).alias("license"), F.split(F.lit(" ".join(w)), " ").alias("words"), F.lit(window_size(len(w))).alias("size"))
            for n, w in words.items()]
    known = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    known = known.select("license", "size", _shingles(F.col("words")).alias("template"))
    keys = known.select("license", "size", "template", F.posexplode(_bands(F.col("template"))).alias("band", "key"))
    some: dict[int, set[str]] = {}
    least: dict[int, int] = {}  # shingles of the shortest template of each size
    for w in words.values():
        size, shingles = window_size(len(w)), {" ".join(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        some.setdefault(size, set()).update(shingles)
        least[size] = min(least.get(size, len(shingles)), len(shingles))
    any_size = sorted(set().union(*some.values()))

    text = F.lower(text_of(docs))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1).alias("w"))

    def places(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: _at(w, i).isin(any_size))
        return F.struct(w.alias("w"), F.when(F.size(w) >= SHINGLE, at).otherwise(F.array().cast("array<int>")).alias("at"))

    rows = rows.select("doc_id", let(F.col("w"), places).alias("r")).where(F.size("r.at") > 0)
    # A place lies in two windows of each size: the one that begins in its half window, and the one before.
    def windows_of(size: int) -> Column:
        own = F.filter("r.at", lambda i: _at(F.col("r.w"), i).isin(sorted(some[size])))
        return let(own, lambda at: F.flatten(F.array(*[F.transform(at, _window(size // 2, back)) for back in (0, 1)])))

    def n_known(size: int) -> Column:
        return F.size(F.filter("shingles", lambda x: x.isin(sorted(some[size]))))

    found = [windows_of(size) for size in sorted(some)]
    found = F.filter(F.array_distinct(F.flatten(F.array(*found))), lambda x: x["start"] >= 0)
    cut = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.slice(F.col("r.w"), x["start"] + 1, x["size"]).alias("w")))
    windows = rows.select("doc_id", F.explode(cut).alias("window"))
    windows = windows.select("doc_id", "window.start", "window.size", _shingles(F.col("window.w")).alias("shingles"))
    enough = F.lit(False)
    for size in sorted(some):
        enough = F.when(F.col("size") == size, n_known(size) / least[size] >= containment).otherwise(enough)
    banded = windows.where(F.size("shingles") > 0).where(enough).select("*", F.posexplode(_bands(F.col("shingles"))).alias("band", "key"))
    candidates = banded.join(F.broadcast(keys), ["size", "band", "key"])
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    verified = candidates.withColumn("share", share).where(F.col("share") >= containment)
    return verified.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"),
        F.count_distinct("start").alias("n_windows"))


def _at(words: Column, i: Column) -> Column:
    """The shingle that begins at word ``i``."""
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _window(half: int, back: int):
    return lambda p: F.struct(((F.floor(p / half) - back) * half).cast("int").alias("start"), F.lit(2 * half).alias("size"))
