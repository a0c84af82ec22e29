"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Everything is DataFrame expressions.  A text's lines, its paragraphs (between
blank lines) and the whole of it are compared with every template inside its
row, so texts are neither exploded for that nor shuffled.  A unit is looked at
only if it holds a heavy term of some template (without one its cosine can't
reach the threshold) and only if its tokens, each counted once, leave it a
chance; its norm is then a fold over its sorted tokens.  Document frequencies are
counted over all lines of all documents.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, table
from quern.llm.urlrules import LOWER, UPPER

THRESHOLD = 0.75
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, version: str) -> str:
    """The notice that the GNU licences ask for."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {what} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"{what} for more details. You should have received a copy of the {what} along with this program. If not, see https://www.gnu.org/licenses/."
    )


#: (licence, one-line header, notice or whole text); fixed values, from the licences themselves
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _BSD_END,
    ),
    ("GPL", _gnu("GNU General Public License", "3")),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", _gnu("GNU Lesser General Public License", "2.1")),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL", _gnu("GNU Affero General Public License", "3")),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
#: Names of files that hold the licence of their directory.
LICENSE_FILE = "^(licen[sc]e|copying|unlicense)([.-].*)?$"
#: What parts paragraphs: lines without anything but blanks.
BLANK = "\\n[ \\t\\r\\n]*\\n"


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, UPPER, LOWER), "[^a-z0-9]+"), "")


def line_frequencies(docs: DataFrame, vocabulary: list[str], text: str) -> tuple[int, dict[str, int]]:
    """The number of lines with a word, and for each term of the vocabulary the lines that hold it."""
    vocab = F.array(*map(F.lit, vocabulary))
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(tokens(F.col("line")).alias("t"))
    found = lines.where(F.size("t") > 0).select(F.array_append(F.array_intersect("t", vocab), F.lit("")).alias("t"))
    rows = found.select(F.explode("t").alias("t")).groupBy("t").count().collect()  # a row per term at most
    df = {r["t"]: r["count"] for r in rows}
    return df.pop("", 0), df


class Weights:
    """idf of the vocabulary, templates as unit vectors, and the heavy terms of which a match needs one."""

    def __init__(self, templates, n: int, df: dict[str, int], threshold: float):
        idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
        self.unknown = math.log(1 + n) + 1
        self.threshold = threshold
        self.names, self.idf, self.heavy, self.parts = [], {}, set(), {}
        for k, (name, body) in enumerate(templates):
            weight = {t: tf * idf(t) for t, tf in Counter(words(body)).items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            self.names.append(name)
            light = 0.0
            for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                self.idf[t] = idf(t)
                #: what one token adds to the cosines with all templates, but for its unit's norm
                self.parts.setdefault(t, [0.0] * len(templates))[k] = idf(t) * w / norm
                light += (w / norm) ** 2
                if light >= threshold**2 - 1e-9:
                    self.heavy.add(t)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def constant(value, kind: str) -> Column:
    """A literal of any type that JSON can say (folded to one before the query runs)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scored(units: Column, weights: Weights) -> Column:
    """Of units (kind, t: tokens) struct(kind, best: struct(score, license)); best is null where no template can reach the threshold."""
    known = sorted(weights.idf)
    idf = constant(weights.idf, "map<string,double>")
    parts = constant(weights.parts, "map<string,array<double>>")
    names = constant(weights.names, "array<string>")
    of = lambda t: F.coalesce(F.element_at(idf, t), F.lit(weights.unknown))

    def squares(unit: Column) -> Column:
        """Sum over distinct tokens of (count x idf) squared, by runs of the sorted tokens."""
        start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
        done = lambda a: a["s"] + F.pow(a["n"] * of(a["t"]), F.lit(2.0))
        step = lambda a, t: F.when(
            t == a["t"], F.struct(a["t"].alias("t"), (a["n"] + 1).alias("n"), a["s"].alias("s"))
        ).otherwise(F.struct(t.alias("t"), F.lit(1.0).alias("n"), done(a).alias("s")))
        return F.aggregate(F.array_sort(unit), start, step, done)

    def score(unit: Column) -> Column:
        def of_known(own: Column) -> Column:
            zeros = F.array_repeat(F.lit(0.0), len(weights.names))
            dots = F.aggregate(own, zeros, lambda a, t: F.zip_with(a, F.element_at(parts, t), lambda x, y: x + y))
            # every token counts at least once in the norm
            least = F.aggregate(own, F.lit(0.0), lambda a, t: a + F.pow(F.element_at(idf, t), F.lit(2.0)))
            least = least + (F.size(unit) - F.size(own)) * F.lit(weights.unknown**2)

            def of_dots(d: Column) -> Column:
                norm = F.sqrt(squares(unit))
                each = F.zip_with(d, names, lambda x, name: F.struct(F.round(x / norm, 9).alias("score"), name.alias("license")))
                return F.when(F.array_max(d) >= (weights.threshold - 1e-8) * F.sqrt(least), F.array_max(each))

            return let(dots, of_dots)

        return let(F.filter(unit, lambda t: t.isin(known)), of_known)

    return F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), score(u["t"]).alias("best")))


def best_match(text: Column, weights: Weights) -> Column:
    """struct(own: best of all units that reach the threshold, whole: whether the whole text does, matching: lines that do, lines: lines with a word)."""
    heavy = constant(sorted(weights.heavy), "array<string>")
    as_units = lambda kind, of: F.transform(of, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))

    def of_lines(lines: Column) -> Column:
        def of_all(every: Column) -> Column:
            units = F.concat(as_units("w", F.array(every)), as_units("l", lines), as_units("p", F.transform(F.split(text, BLANK), tokens)))
            good = F.filter(scored(F.filter(units, lambda u: F.arrays_overlap(u["t"], heavy)), weights), lambda s: s["best"]["score"] >= weights.threshold)
            return F.when(F.arrays_overlap(every, heavy), good)

        return F.struct(let(F.flatten(lines), of_all).alias("good"), F.size(lines).alias("lines"))

    found = let(F.filter(F.transform(F.split(text, "\n"), tokens), lambda t: F.size(t) > 0), of_lines)
    return let(
        found,
        lambda f: F.struct(
            F.array_max(F.transform(f["good"], lambda s: s["best"])).alias("own"),
            F.coalesce(F.exists(f["good"], lambda s: s["kind"] == "w"), F.lit(False)).alias("whole"),
            F.size(F.filter(f["good"], lambda s: s["kind"] == "l")).alias("matching"),
            f["lines"].alias("lines"),
        ),
    )


def ancestors(directory: Column) -> Column:
    """The directory and those above it with their depths; the root is the empty text."""
    parts = F.array_remove(F.split(directory, "/"), "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")),
    )


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``files``: keep columns, path, own_license, own_score, license, origin, from_dir.

    A file's own license is that of its line, paragraph or whole text of the highest
    cosine, if that reaches the threshold (ties: the later name).  A file is a licence
    file if its whole text reaches the threshold, if at least half of its lines do,
    or if its name says so (LICENSE_FILE) and it has an own license: it gives its
    license to its directory (of several the one of the highest score, then the later
    name).  Files without a license inherit from the nearest directory upwards that
    has one.  ``origin`` is own, inherited or none.  Null and empty texts have no own
    license; a null path is in the root directory; rows that repeat are judged each;
    long texts and long lines cost in proportion to their tokens; no files give no
    rows; other columns are ignored.
    """
    vocabulary = sorted({t for _, body in templates for t in words(body)})
    n, df = line_frequencies(files, vocabulary, text)
    weights = Weights(templates, n, df, threshold)
    place = F.coalesce(F.col(path), F.lit(""))
    directory = F.array_join(F.array_remove(F.split(F.regexp_replace(place, "[^/]*$", ""), "/"), ""), "/")
    named = F.rlike(F.lower(F.regexp_extract(place, "[^/]*$", 0)), F.lit(LICENSE_FILE))
    m = F.col("m")
    whole = m["whole"] | (m["matching"] * 2 >= m["lines"]) | F.col("named")
    found = files.select(
        *keep, F.col(path).alias("path"), directory.alias("dir"), named.alias("named"), best_match(F.coalesce(F.col(text), F.lit("")), weights).alias("m")
    )
    found = cut(found.select(*keep, "path", "dir", m["own"].alias("own"), whole.alias("whole")))
    given = found.where(F.col("own").isNotNull() & F.col("whole")).groupBy("dir").agg(F.max("own").alias("given"))
    dirs = found.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a"))
    above = dirs.select(F.col("dir").alias("of"), F.col("a")["depth"].alias("depth"), F.col("a")["dir"].alias("dir"))
    near = above.join(given, "dir").groupBy("of").agg(
        F.max(F.struct("depth", F.col("given")["license"].alias("license"), "dir")).alias("near")
    )
    own = F.col("own").isNotNull()
    return found.join(near.withColumnRenamed("of", "dir"), "dir", "left").select(
        *keep,
        "path",
        F.col("own")["license"].alias("own_license"),
        F.col("own")["score"].alias("own_score"),
        F.when(own, F.col("own")["license"]).otherwise(F.col("near")["license"]).alias("license"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near")["dir"]).alias("from_dir"),
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files: in the directory of their source, and mostly in deeper ones of their language and of a tenth of that."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.concat_ws(
        "/",
        "source",
        F.when(i % 50 != 0, F.col("lang")),
        F.when((i % 50 != 0) & (i % 3 != 0), F.concat(F.lit("d"), (i % 10).cast("string"))),
        F.concat(i.cast("string"), F.lit(".txt")),
    )
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))
