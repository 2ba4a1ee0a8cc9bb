"""Licences of files from TF-IDF cosines to templates, and from the nearest directory above.

Texts are cut into sentences, lines and paragraphs, of which a header is one; these, and the whole
text of files named like a licence, become sparse vectors over the templates' words, weighted by
the words' document frequency in the whole corpus. The best cosine to a template, which is a short
or a whole notice, decides. Only pieces without a word that every piece near enough to a template
holds are passed over. A file without a licence of its own takes that of the nearest directory
above it that holds a licence file, by joins on paths.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsieve.functions.columns import fresh

from .scratch import Scratch
from .spans import let

# Notices as their licences word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("proprietary", "Copyright, all rights reserved."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of"
        " merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability,"
        " whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis,"
        " without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the"
        " implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details. You should have received a copy of the GNU General"
        " Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this"
        " list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the"
        " names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
        " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
    ),
)
# What has a word at all, and so can be compared.
HINT = r"(?i)[a-z0-9]"
SENTENCE_END, PARAGRAPH_END = r"\n|(?<=[.!?])\x20", r"\n[\x20\t\r]*\n"
SALTS = 8
FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"


@dataclass(frozen=True)
class LicenseOptions:
    """threshold: least cosine; templates: (licence, text) pairs, whose words bound all that is gathered."""

    threshold: float = 0.7
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def document_frequencies(files: DataFrame, o: LicenseOptions, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many hold each word of the templates."""
    vocabulary = sorted({w for _, t in o.templates for w in words(t)})
    held = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in vocabulary]))
    # The empty word stands for the text itself; there are as many rows at most as the templates have words, and one.
    counts = files.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), {w: found.get(w, 0) for w in vocabulary}


def template_weights(n: int, df: dict[str, int], o: LicenseOptions) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies, and the templates as unit vectors."""
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    out = []
    for name, text in o.templates:
        tf: dict[str, int] = {}
        for w in words(text):
            tf[w] = tf.get(w, 0) + 1
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        out.append((name, {w: c * idf[w] / norm for w, c in tf.items()}))
    return idf, out


def gate(df: dict[str, int], templates: list[tuple[str, dict[str, float]]], threshold: float) -> str:
    """A pattern in every lower-case piece whose cosine to a template reaches the threshold.

    By Cauchy and Schwarz a cosine is at most the length of the template's part over the words that
    the piece holds. The commonest words are left out as long as no template's part over all words
    left out is as long as the threshold: what reaches it holds one of the others.
    """
    if threshold <= 0:
        return HINT
    # Scores are rounded to nine digits before they are compared.
    most = (threshold - 1e-8) ** 2
    left, needed = [0.0] * len(templates), []
    for w in sorted(df, key=lambda w: (-df[w], w)):
        more = [a + v.get(w, 0.0) ** 2 for a, (_, v) in zip(left, templates, strict=True)]
        if max(more) < most:
            left = more
        else:
            needed.append(w)
    if not needed:
        return HINT
    # Grouped by their first character, few words are tried at each place.
    heads = sorted({w[0] for w in needed})
    groups = "|".join(f"{h}(?:{'|'.join(sorted(w[1:] for w in needed if w[0] == h))})" for h in heads)
    return rf"(?<![a-z0-9])(?:{groups})(?![a-z0-9])"


def _map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for p in sorted(d.items()) for v in p])


def _best(tokens: Column, idf: dict[str, float], templates: list[tuple[str, dict[str, float]]]) -> Column:
    """(score, licence) of the template with the largest cosine; ties go to the smaller name."""
    known = F.filter(tokens, lambda w: w.isin(*sorted(idf)))

    def scored(k: Column) -> Column:
        # A word's weight in the vector is its count times its idf; the sums run over distinct words.
        # Each word stands between blanks of its own: what its removal shortens tells how often it is there.
        text = F.concat(F.lit(" "), F.array_join(k, "  "), F.lit(" "))
        return let(F.struct(k.alias("k"), text.alias("t")), counted)

    def counted(z: Column) -> Column:
        times = lambda w: (F.length(z["t"]) - F.length(F.replace(z["t"], F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)
        return let(F.transform(F.array_distinct(z["k"]), lambda w: F.struct(w.alias("w"), (times(w) * F.element_at(_map(idf), w)).alias("x"))), cosines)

    def cosines(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"] * p["x"]))

        def one(name: str, vector: dict[str, float]) -> Column:
            dot = F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"] * F.coalesce(F.try_element_at(_map(vector), p["w"]), F.lit(0.0)))
            return F.struct((-F.round(dot / F.greatest(norm, F.lit(1e-9)), 9)).alias("less"), F.lit(name).alias("licence"))

        return F.array_min(F.array(*[one(n, v) for n, v in templates]))

    return let(known, scored)


def scan_licenses(files: DataFrame, options: LicenseOptions | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files with licence, score, scope and from_path.

    scope is `own` for a licence found in the file, `inherited` for that of a licence file in the
    nearest directory above or in the file's own, `none` where there is neither (licence null, score
    0). from_path is the file that says so. Of several licence files in one directory the one with
    the higher score counts, of equals the one with the smaller licence and path. Null and empty
    texts have no licence of their own; a null path is in no directory. Every row gives one row,
    repeated rows too; other columns stay, except that columns under the four names are replaced.
    An empty table gives an empty result.
    """
    o = options or LicenseOptions()
    n, df = document_frequencies(files, o, text_col)
    idf, templates = template_weights(n, df, o)
    needed = gate(df, templates, o.threshold)
    text = F.coalesce(F.col(text_col), F.lit(""))
    is_file = F.coalesce(F.col(path_col).rlike(FILE), F.lit(False))
    cuts = F.array_distinct(F.concat(F.split(text, SENTENCE_END, -1), F.split(text, PARAGRAPH_END, -1)))
    parts = F.filter(cuts, lambda s: F.lower(s).rlike(needed))
    pieces = F.when(is_file, F.concat(parts, F.array(text))).otherwise(parts)
    judged = F.transform(pieces, lambda s: _best(_words(s), idf, templates))
    best = F.array_min(F.filter(judged, lambda b: -b["less"] >= o.threshold))
    kept = [c for c in files.columns if c not in ("licence", "score", "scope", "from_path")]
    mine, folder, given, asks, salt = (fresh(files, c) for c in ("mine", "folder", "given", "asks", "salt"))
    own = files.select(*[F.col(f"`{c}`") for c in kept]).withColumn(mine, F.when(is_file | F.lower(text).rlike(needed), best))
    parent = F.regexp_replace(F.col(path_col), "/?[^/]*$", "")
    said = F.col(mine).isNotNull()
    folders = (
        own.where(is_file & said).groupBy(parent.alias(folder))
        .agg(F.min(F.struct(F.col(mine)["less"].alias("less"), F.col(mine)["licence"].alias("licence"), F.col(path_col).alias("at"))).alias(given))
    )
    scratch = Scratch(files.sparkSession, "licences")
    folders = scratch.keep(folders, "folders")
    direct = own.select(
        *[F.col(f"`{c}`") for c in kept], F.col(mine)["licence"].alias("licence"), F.when(said, -F.col(mine)["less"]).otherwise(F.lit(0.0)).alias("score"),
        F.when(said, "own").otherwise("none").alias("scope"), F.when(said, F.col(path_col)).alias("from_path"),
    )
    # Directories that ask: all distinct ones, which need no look at a text; each asks all above it.
    steps = F.split(asks, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    asking = files.where(F.col(path_col).isNotNull()).select(parent.alias(asks)).distinct().select(asks, F.explode(F.array_distinct(above)).alias(folder))
    nearest = asking.join(folders, folder).groupBy(asks).agg(F.max_by(given, F.length(folder)).alias(given))
    # A directory may hold a large part of all files: they are dealt by a salt beside its name.
    nearest = nearest.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = direct.withColumns({asks: F.when(F.col("scope") == "none", parent), salt: F.pmod(F.xxhash64(path_col, text_col), F.lit(SALTS)).cast("int")})
    out = dealt.join(nearest, [asks, salt], "left")
    found = F.col(given).isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce("licence", F.col(given)["licence"]).alias("licence"),
        F.when(found, -F.col(given)["less"]).otherwise(F.col("score")).alias("score"),
        F.when(found, "inherited").otherwise(F.col("scope")).alias("scope"), F.coalesce("from_path", F.col(given)["at"]).alias("from_path"),
    )
