"""Licence scans: TF-IDF cosine of notices to templates, then the nearest ancestor directory; DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise, spread

#: Fixed texts: what the GNU licences' headers have in common, and the disclaimers of the MIT and BSD licences.
_GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_GNU_ONLY = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation."
_GNU_REST = " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
_GNU_COPY = " You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
_MIT_REST = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: SPDX name, title, version, what it is called, and the two signs of its first sentence.
_GNU_FAMILY = (
    ("GPL-2.0", "GNU General Public License", "2", "program", ";", ";"),
    ("GPL-3.0", "GNU General Public License", "3", "program", ":", ","),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library", ";", ";"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "program", ":", ","),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "library", ";", ";"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "program", ":", ","),
)


def _gnu_templates():
    """First paragraph alone, with the second, and with the third; and the form without later versions."""
    for spdx, name, version, what, sep, comma in _GNU_FAMILY:
        fill = lambda text: text.format(name=name, version=version, what=what, sep=sep, comma=comma)
        for text in (_GNU, _GNU + _GNU_REST, _GNU + _GNU_REST + _GNU_COPY, _GNU_ONLY, _GNU_ONLY + _GNU_REST):
            yield spdx, fill(text)


#: Fixed texts: notices and headers of public licences, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD-3-Clause", _BSD + _BSD_THIRD),
    ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-2-Clause", _BSD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *_gnu_templates(),
)
_MIT_WHOLE = next(text for name, text in TEMPLATES if name == "MIT" and text.startswith("Permission")) + _MIT_REST
TEMPLATES = (*TEMPLATES, ("MIT", _MIT_WHOLE))
#: Terms that tell a licence from its kin: where a template has one, so must a stretch that is given its name.
TELLING = {"AGPL-3.0": ("affero", "agpl"), "LGPL-3.0": ("lesser", "lgpl", "3"), "LGPL-2.1": ("lesser", "lgpl", "2", "1"), "GPL-3.0": ("3",), "GPL-2.0": ("2",), "BSD-3-Clause": ("3", "neither"), "BSD-2-Clause": ("2",)}
#: Names of licence files, whose licence holds for their directory and all below without a nearer one.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
THRESHOLD = 0.75
#: Notices may be wrapped: runs of so many lines are looked at besides lines, paragraphs, comments and whole texts.
RUNS = (2, 3)
#: Fixed: how a line of a comment begins in common languages.
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|\.\.|dnl\b|rem\b|')"
_TERMS = "[^a-z0-9]+"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(_TERMS, text.lower()) if t]


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms_of(text)})


#: Fixed: the two characters beyond ASCII whose lower case has an ASCII letter.
_FOLDING = ("\u0130", "\u212a")


def _split(text):
    """Lower-case terms and empty strings; of the folded letters only A-Z count, so that both sides of a comparison agree."""
    for c in _FOLDING:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(F.lower(text), _TERMS)


def inverse_frequencies(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequency of every template term over all texts, and that of a term in none.

    The vocabulary is that of the templates, so the counts that reach the driver do not grow with the files.
    """
    n = files.where("text is not null").count()
    known = F.array_intersect(_split(F.col("text")), F.array(*[F.lit(t) for t in VOCABULARY]))  # no empty ones
    df = dict(spread(files).select(F.explode(known).alias("term")).groupBy("term").count().collect())
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}, math.log(1 + n) + 1


def template_weights(idf: dict[str, float]) -> list[tuple[int, str, float]]:
    """(template, term, weight) with weights of length one for each template."""
    rows = []
    for i, (_, text) in enumerate(TEMPLATES):
        w = {t: c * idf[t] for t, c in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, t, x / norm) for t, x in sorted(w.items())]
    return rows


def needed_terms(weights: list[tuple[int, str, float]], idf: dict[str, float]) -> list[str]:
    """Terms of which every stretch near enough to a template has one.

    A cosine is at most the length of the template's weights on the terms that both have. So a template's most common
    terms, as long as their weights together stay shorter than THRESHOLD, are not enough without one of the others.
    """
    need: set[str] = set()
    by: dict[int, list[tuple[float, str, float]]] = {}
    for i, term, w in weights:
        by.setdefault(i, []).append((idf[term], term, w))
    for terms in by.values():
        rest = 0.0
        for _, term, w in sorted(terms):
            if rest + w * w < (THRESHOLD - 1e-5) ** 2:
                rest += w * w
            else:
                need.add(term)
    return sorted(need)


def lines_near(files: DataFrame, needed: list[str]) -> DataFrame:
    """copy (a row, since paths may repeat), path, place, block, part, note, line: lines of texts that have one of the needed terms.

    Blocks are parted by blank lines, parts by lines without letters and digits (as between the paragraphs of a comment), and notes where
    comment lines begin or end.
    """
    near = spread(files).where(F.col("path").isNotNull() & F.arrays_overlap(_split(F.col("text")), F.array(*[F.lit(t) for t in needed])))
    near = near.withColumn("copy", F.monotonically_increasing_id())  # before lines are rows
    near = near.select("copy", "path", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    blank = (F.translate("line", " \t\r", "") == "").cast("int")
    bare = (~F.col("line").rlike("[A-Za-z0-9]")).cast("int")
    comment = F.lower("line").rlike(COMMENT)
    order = Window.partitionBy("copy").orderBy("place")
    turn = F.coalesce((comment != F.lag(comment).over(order)).cast("int"), F.lit(0))
    near = near.withColumn("block", F.sum(blank).over(order).cast("int")).withColumn("part", F.sum(bare).over(order).cast("int")).withColumn("turn", turn)
    return near.withColumn("note", F.sum("turn").over(order).cast("int")).drop("turn")


def stretches():
    """A line's stretches: itself, the runs that it lies in, its paragraph (by blank or by bare lines), its comment and the whole text.

    Runs over either end of a text are shorter runs or lines, so they add nothing.
    """
    at = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"))
    runs = [at(f"run{n}", F.col("place") - back) for n in RUNS for back in range(n)]
    return F.array(at("line", F.col("place")), *runs, at("block", F.col("block")), at("part", F.col("part")), at("note", F.col("note")), at("whole", F.lit(0)))


def own_licences(files: DataFrame) -> DataFrame:
    """path, licence, cosine, whole: the best template of any notice of a file, if its cosine is THRESHOLD or more.

    Lines, runs of lines, paragraphs, comments and whole texts are looked at. A stretch must have the terms of TELLING that a template
    has, so that kin with nearly the same words are told apart. Terms are counted once for each line and summed
    over its stretches. Terms of no template are all of one weight, so of them only the sum of squared counts is
    wanted. It is at least their number, which bounds a stretch's norm from below; stretches whose cosine could
    still reach THRESHOLD get the sum itself. ``whole`` says that the file's text as a whole is that near to some
    template. Ties go to the earlier template.
    """
    spark = files.sparkSession
    idf, other = inverse_frequencies(files)
    rows = template_weights(idf)
    needed = needed_terms(rows, idf)
    telling = [set(TELLING.get(name, ())) & set(terms_of(text)) for name, text in TEMPLATES]
    weights = F.broadcast(spark.createDataFrame([(i, t, w, t in telling[i], len(telling[i])) for i, t, w in rows], "template int, term string, tw double, tells boolean, wanted int"))
    scale = F.broadcast(spark.createDataFrame([(t, x, t in set(needed)) for t, x in sorted(idf.items())], "term string, idf double, need boolean"))
    key = ["copy", "kind", "place"]
    least = (THRESHOLD - 1e-5) ** 2
    lines = materialise(lines_near(files, needed), "lines")
    tokens = lines.select("copy", "place", "block", "part", "note", F.explode(_split(F.col("line"))).alias("term")).where("term <> ''")
    by_line = tokens.join(scale, "term", "left").groupBy("copy", "place", "block", "part", "note", F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), "idf", "need").count()
    tf = by_line.select("copy", F.explode(stretches()).alias("s"), "term", "idf", "need", "count").select("copy", "s.*", "term", "idf", "need", "count")
    tf = materialise(tf.groupBy(*key, "term", "idf", "need").agg(F.sum("count").alias("count")), "terms")
    square = F.pow(F.col("count") * F.col("idf"), 2)
    norms = tf.groupBy(*key).agg(F.sum(square).alias("known"), F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("count"))), F.lit(0)).alias("others"), F.max("need").alias("need"))
    norms = norms.where(F.col("need") & (F.col("known") >= least * (F.col("known") + other * other * F.col("others")))).drop("need")
    dots = tf.where("term is not null").join(norms, key).join(weights, "term")
    dots = dots.groupBy(*key, "template", "known", "others", "wanted").agg(F.sum(F.col("count") * F.col("idf") * F.col("tw")).alias("dot"), F.sum(F.col("tells").cast("int")).alias("told"))
    dots = dots.where("told = wanted").drop("told", "wanted")
    close = materialise(dots.where(F.col("dot") * F.col("dot") >= least * (F.col("known") + other * other * F.col("others"))), "close")
    # the stretches that are left, each with its lines
    parts = lines.select("copy", F.col("place").alias("at"), F.explode(stretches()).alias("s")).select("copy", "at", "s.*")
    parts = parts.join(close.where("others > 0").select(*key).distinct(), key)
    words = parts.join(lines.select("copy", F.col("place").alias("at"), "line"), ["copy", "at"]).select(*key, F.explode(_split(F.col("line"))).alias("term"))
    words = words.where("term <> ''").join(scale, "term", "left_anti").groupBy(*key, "term").count()
    squares = words.groupBy(*key).agg(F.sum(F.col("count") * F.col("count")).alias("squares"))
    norm = F.sqrt(F.col("known") + other * other * F.coalesce("squares", F.lit(0)))
    near = close.join(squares, key, "left").withColumn("cosine", F.round(F.col("dot") / norm, 6)).where(F.col("cosine") >= THRESHOLD)
    best = near.groupBy("copy").agg(F.max(F.struct("cosine", (-F.col("template")).alias("t"))).alias("b"), F.max(F.col("kind") == "whole").alias("whole"))
    best = best.join(lines.where("place = 0").select("copy", "path"), "copy").groupBy("path").agg(F.max("b").alias("b"), F.max("whole").alias("whole"))
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    return best.select("path", F.get(names, -F.col("b.t")).alias("licence"), F.col("b.cosine").alias("cosine"), "whole")


def _directory(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, whole_texts: bool = False) -> DataFrame:
    """Licence of every file: its own, or that of the nearest ancestor directory with a licence file.

    ``files`` has path (segments parted by slashes) and text. Returns path, licence, cosine, origin ("own",
    "inherited" or null) and licence_file (where an inherited licence stands). A licence file has such a name; with
    ``whole_texts``, for files without telling names, it may also have a text that as a whole is near to a template. Directories are joined, not files, so that a directory with most of the files
    is one row. Rows that share a path have one licence, the best of their notices; null and empty texts have none
    of their own; rows without path have none; other columns are ignored; an empty table gives an
    empty result.
    """
    files = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = materialise(own_licences(files), "own")
    holds = F.col("path").rlike(LICENCE_FILE)
    holders = own.where(F.col("whole") | holds if whole_texts else holds).select(_directory("path").alias("holder"), F.struct("cosine", "licence", F.col("path").alias("licence_file")).alias("h"))
    holders = holders.groupBy("holder").agg(F.max("h").alias("h"))
    dirs = files.where("path is not null").select(_directory("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = dirs.select("dir", F.posexplode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(up))).alias("depth", "holder"))
    nearest = above.join(holders, "holder").groupBy("dir").agg(F.max(F.struct("depth", "h")).alias("n")).select("dir", "n.h.*")
    out = files.select("path", _directory("path").alias("dir")).join(own.select("path", F.col("licence").alias("own"), F.col("cosine").alias("own_cosine")), "path", "left").join(nearest, "dir", "left")
    return out.select(
        "path",
        F.coalesce("own", "licence").alias("licence"),
        F.coalesce("own_cosine", "cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("licence").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("licence_file")).alias("licence_file"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", name("source"), name("lang"), F.col("doc_id").cast("string")))
    return docs.select(path.alias("path"), "text")
