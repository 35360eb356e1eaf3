"""Licence scans by sparse TF-IDF cosine and directory inheritance (operator 10).

A file is compared with the templates as a whole, by its paragraphs and by its lines, so that a
licence file, a header of several lines and a tag are all found.

Everything here is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

# The words of public licences, by SPDX identifier. First what names a licence in one
# line, then the paragraphs of its heading and notice; "whole" licences are all there.
NAMED = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License", "Apache License 2.0", "Apache License, Version 2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License (MIT)", "This file is licensed under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License v3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License v2.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"],
    "ISC": ["Released under the ISC License.", "ISC License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
WHOLE = {
    "MIT": ["MIT License", MIT_GRANT, MIT_NOTICE, MIT_AS_IS],
    "BSD-3-Clause": ["BSD 3-Clause License", BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_AS_IS],
    "BSD-2-Clause": ["BSD 2-Clause License", BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_AS_IS],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
}
PARTS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GNU.format("", "3")],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", GNU.format("", "2")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GNU.format("Lesser", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", GNU.format("Lesser", "2.1")],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", GNU.format("Affero", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every template: names, tags, paragraphs and whole licences.

    A paragraph that several licences share is no template; it counts in the whole ones.
    """
    out = [(k, t) for k, texts in NAMED.items() for t in texts]
    for k in NAMED:
        kinds = [k, f"{k}-only", f"{k}-or-later"] if "GPL" in k else [k]
        out += [(k, f"SPDX-License-Identifier: {x}") for x in kinds]
    out += [(k, t) for k, texts in PARTS.items() for t in texts]
    shared = Counter(t for texts in WHOLE.values() for t in texts)
    out += [(k, t) for k, texts in WHOLE.items() for t in texts if shared[t] == 1 and t not in NAMED[k]]
    return out + [(k, " ".join(texts)) for k, texts in WHOLE.items()]


WORD = r"[a-z0-9]+"
#: Words of any English text.
COMMON = frozenset("a all an and any are as at be by can do for from has have if in is it no not of on only or other that the this to was with you your".split())
#: Between paragraphs: lines without a letter a-z or a digit. Possessive, as many blank lines would
#: otherwise take the stack of the JVM.
GAP = r"\n(?:[^a-z0-9\n]*+\n)++"
#: Names of files that are there to state a licence.
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"
#: Words that deny what follows them ("isn't" is the words "isn" and "t").
DENIALS = ["not", "never", "neither", "nor", "cannot", "longer", "isn", "aren", "wasn", "weren"]
#: A tag's expression of several identifiers. Possessive, as a long one would otherwise take the stack of the JVM.
EXPRESSION = r"(?i)spdx-license-identifier:[ \t]*+([(]*+[ \t]*+{0}(?:[ \t)]++(?:and|or|with)[ \t(]++{0})++[ \t)]*+)".format("[a-z0-9][a-z0-9.+:-]*+")


def identifiers() -> dict[str, str]:
    """Licence by lower-case SPDX identifier, with the spellings of "only" and "or later"."""
    ends = lambda k: ("", "-only", "-or-later", "+") if "GPL" in k else ("",)
    return {f"{k}{end}".lower(): k for k in NAMED for end in ends(k)}


def denies(words: list[str]) -> bool:
    """Whether a word that denies stands before a word of licensing."""
    first = min((words.index(x) for x in DENIALS if x in words), default=len(words))
    return any(x.startswith("licen") for x in words[first:])


def denied(words: Column) -> Column:
    """``denies`` of an array of words in their order."""
    first = F.array_min(F.filter(F.array(*[F.array_position(words, x) for x in DENIALS]), lambda k: k > 0))
    return F.coalesce(F.exists(F.slice(words, first.cast("int"), F.size(words)), lambda x: x.startswith("licen")), F.lit(False))


def expression(text: Column) -> Column:
    """The first SPDX expression of a text that joins several identifiers, one at least of a known
    licence: licences by their names, other identifiers as written, without outer brackets. Null
    if there is none."""
    known = F.create_map(*[F.lit(x) for pair in identifiers().items() for x in pair])
    operator = lambda x: F.lower(x).isin("and", "or", "with")
    name = lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), F.when(operator(x), F.upper(x)).otherwise(x))
    parts = lambda x: F.regexp_extract_all(x, F.lit("([()]|[A-Za-z0-9.+:-]+)"), 1)
    said = F.transform(F.regexp_extract_all(text, F.lit(EXPRESSION), 1), lambda x: parts(x))
    some = F.filter(said, lambda x: F.exists(x, lambda y: F.lower(y).isin(list(identifiers()))))
    whole = F.array_join(F.transform(F.get(some, 0), name), " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "[(] ", "("), " [)]", ")"), "^[(]([^()]*)[)]$", "$1")


class Model:
    """Weights of a fixed set of (licence, text) templates; its size is that of the set."""

    def __init__(self, texts: list[tuple[str, str]], threshold: float):
        words = [re.findall(WORD, t.lower()) for _, t in texts]
        df = Counter(x for w in words for x in set(w))
        self.names = [k for k, _ in texts]
        self.tags = [t.startswith("SPDX-License-Identifier:") for _, t in texts]
        self.denies = [denies(w) for w in words]
        self.unseen = math.log(1 + len(words)) + 1
        self.idf = {x: math.log((1 + len(words)) / (1 + n)) + 1 for x, n in sorted(df.items())}
        self.weights: dict[str, list[tuple[int, float]]] = {}
        needed: set[str] = set()
        for k, w in enumerate(words):
            weight = {x: n * self.idf[x] for x, n in sorted(Counter(w).items())}
            norm = math.sqrt(sum(v * v for v in weight.values()))
            for x, v in weight.items():
                self.weights.setdefault(x, []).append((k, v / norm))
            left = 1.0
            # a text without any of these words cannot reach the threshold: the rest is too light; long
            # words come first and common ones last, as few texts have those
            for x in sorted(weight, key=lambda x: (x in COMMON, -len(x), x)):
                if left < threshold**2:
                    break
                needed.add(x)
                left -= (weight[x] / norm) ** 2
        self.needed = sorted(needed)


def headers(files: DataFrame, threshold: float = 0.8, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``files`` (file_id, path, text) -> row, file_id, path, own_license, own_score, licence_file.

    The whole text, each of its paragraphs and each line names the licence of the template with
    the largest TF-IDF cosine, if that is at least ``threshold``; a file has the licence of the
    best of these (ties: the smaller name). What denies a licence ("not released under ...")
    does not name it, unless the template denies as well. A tag with an SPDX expression of
    several identifiers comes first, with that expression as the licence and a score of 1.
    It is a licence file if it has a licence and either its name says so, or at least nine in ten of
    its lines that are not blank are in what named one; lines that SPDX tags named do not
    count, as a header speaks for its own file only.
    Null and empty texts name nothing; repeated rows each give one row.
    """
    m = Model(texts or templates(), threshold)
    file = ["row", "file_id", "path", "n_lines", "said"]
    tagged = F.when(F.lower("text").contains("spdx-license-identifier:"), expression(F.col("text"))).alias("said")
    low = files.select(F.monotonically_increasing_id().alias("row"), "file_id", "path", F.lower(F.coalesce("text", F.lit(""))).alias("low"), tagged)
    split = lambda c: F.split(c, "[^a-z0-9]+")
    some = lambda words: F.exists(words, lambda x: x.isin(m.needed))
    filled = lambda c: F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)
    unit = lambda p, l, low, n: F.struct(p.alias("p"), l.alias("l"), low.alias("low"), n.alias("held"))  # noqa: E731, E741
    none = F.lit(-1)
    # a text's units: itself, its paragraphs of several lines, its lines
    line_of = lambda p: lambda x, k: unit(p, k, x, F.lit(1))
    paragraph = lambda x, p: F.concat(F.array(unit(p, none, x, F.size(filled(x)))), F.transform(F.split(x, "\n"), line_of(p)))
    units = F.concat(F.array(unit(none, none, F.col("low"), F.size(filled("low")))), F.flatten(F.transform(F.split("low", GAP), paragraph)))
    lines = F.size(filled("low"))
    rows = low.select("row", "file_id", "path", lines.alias("n_lines"), "said", F.when(some(split("low")), units).alias("units"))
    rows = rows.select(*file, F.explode_outer("units").alias("u")).select(*file, "u.p", "u.l", "u.held", split("u.low").alias("words"))
    named = some(F.col("words"))
    rows = rows.select("*", F.when(named, F.sort_array(F.filter("words", lambda x: x != ""))).alias("sorted"), F.when(named, denied(F.col("words"))).alias("denies"))
    first = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)))
    rows = rows.select(*file, "p", "l", "held", "denies", "sorted", F.when(F.col("sorted").isNotNull(), first).alias("first"))
    tf = F.transform("first", lambda i, k: F.struct(F.get("sorted", i).alias("word"), (F.coalesce(F.get("first", k + 1), F.size("sorted")) - i).alias("tf")))
    rows = rows.select(*file, "p", "l", "held", "denies", tf.alias("tf"))
    known = list(m.idf)
    squares = lambda c, idf: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.pow(x["tf"] * idf(x["word"]), F.lit(2)))

    def idf(word):  # the words of one weight are one set
        out = F.lit(m.unseen)
        for value in sorted(set(m.idf.values()), reverse=True):
            out = F.when(word.isin([x for x in known if m.idf[x] == value]), value).otherwise(out)
        return out

    other = squares(F.filter("tf", lambda x: ~x["word"].isin(known)), lambda _: F.lit(m.unseen))
    rows = rows.select(*file, "p", "l", "held", "denies", F.filter("tf", lambda x: x["word"].isin(known)).alias("tf"), other.alias("other"))
    rows = rows.select(*file, "p", "l", "held", "denies", "tf", "other", squares("tf", idf).alias("own"))
    # the cosine is at most the share of known words in the norm
    may = F.col("own") * (1 + 1e-9) >= threshold**2 * (F.col("own") + F.col("other"))
    unit = [*file, "p", "l", "held", "denies", "norm"]
    rows = rows.select(*file, "p", "l", "held", "denies", F.sqrt(F.col("own") + F.col("other")).alias("norm"), F.explode_outer(F.when(may, F.col("tf"))).alias("tf")).select(*unit, "tf.*")
    weights = files.sparkSession.createDataFrame([(x, m.idf[x], m.weights[x]) for x in known], "word string, idf double, w array<struct<t:int,w:double>>")
    met = rows.join(F.broadcast(weights), "word", "left")
    met = met.select(*unit, (F.col("tf") * F.col("idf")).alias("x"), F.explode_outer("w").alias("w"))
    dots = met.groupBy(*unit, F.col("w.t").alias("t")).agg(F.sum(F.col("x") * F.col("w.w")).alias("dot")).repartition("row")
    order = {k: -i for i, k in enumerate(sorted(set(m.names)))}
    names = files.sparkSession.createDataFrame([(t, order[k], m.tags[t], m.denies[t], k) for t, k in enumerate(m.names)], "t int, rank int, tag boolean, may_deny boolean, name string")
    named = dots.join(F.broadcast(names), "t", "left")
    score = F.round(F.col("dot") / F.col("norm"), 6)
    best = F.max(F.when((score >= threshold) & (~F.col("denies") | F.col("may_deny")), F.struct(score.alias("score"), "rank", "tag", "name")))
    good = named.groupBy(*file, "p", "l", "held").agg(best.alias("own"))
    # a tag names the licence of its own file only
    holds = F.coalesce(~F.col("own.tag"), F.lit(False))
    # lines that a paragraph, or the whole text, accounts for
    whole, single = F.max(F.when(holds & (F.col("l") < 0), F.col("held"))), F.count_if(holds & (F.col("l") >= 0))
    by_part = good.groupBy(*file, "p").agg(F.max("own").alias("own"), F.greatest(F.coalesce(whole, F.lit(0)), single).alias("lines"))
    all_lines = F.greatest(F.sum(F.when(F.col("p") >= 0, F.col("lines")).otherwise(0)), F.max(F.when(F.col("p") < 0, F.col("lines")).otherwise(0)))
    of_file = by_part.groupBy(*file).agg(F.max("own").alias("own"), all_lines.alias("lines"))
    states = ((F.col("lines") > 0) & (F.col("lines") * 10 >= F.col("n_lines") * 9)) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    return of_file.select(
        "row", "file_id", "path", F.coalesce("said", "own.name").alias("own_license"),
        F.when(F.col("said").isNotNull(), 1.0).otherwise(F.col("own.score")).alias("own_score"),
        ((F.col("said").isNotNull() | F.col("own").isNotNull()) & states).alias("licence_file"),
    )


def scan(files: DataFrame, threshold: float = 0.8, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``headers`` without row, with the licence that holds for each file and where it is from.

    A file with no licence of its own takes that of the nearest directory above it that holds
    a licence file (of several: the best score, then the smaller name). ``licensed_by`` is that
    directory ('' is the root), null for a file's own licence. Every directory above a file is
    one row of an equi-join, so no directory's files are gathered. A null path has none above.
    """
    own = checkpoint(headers(files, threshold, texts))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    holds = own.where("licence_file and path is not null").groupBy(folder.alias("folder")).agg(
        F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("folder_license")
    )
    steps = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    need = own.where("own_license is null and path is not null").select("row", F.posexplode(F.array_distinct(above)).alias("depth", "folder"))
    nearest = need.join(holds, "folder").groupBy("row").agg(F.max(F.struct("depth", "folder", "folder_license")).alias("near"))
    return own.join(nearest, "row", "left").select(
        "file_id", "path", "own_license", "own_score", "licence_file",
        F.coalesce("own_license", "near.folder_license").alias("license"),
        F.col("near.folder").alias("licensed_by"),
    )
