"""Licence scan: word-bigram Dice coefficient against licence templates.

A text is normalised (lower case, everything but letters and digits one
blank) and every run of its words is a candidate, wherever it begins and however lines
and paragraphs are cut. A run matches a template if the Dice coefficient of their sets of word
bigrams reaches ``THRESHOLD``. Taking a neighbouring bigram of the template into a run never lowers its
score, so a best run begins at a *head*: a shared bigram that follows none. Each head and
template has one candidate, its best run (the shortest of equal ones). Candidates of all licences compete for their
place: the highest score wins (then the larger run, the earlier one, the earlier template), runs
that share a word with a winner are out, and so on until every place has one licence.

Two bounds prune, and both are exact. Sizes: sets of ``a`` and ``b`` bigrams reach ``t`` only if
``a`` lies between ``t/(2-t) b`` and ``(2-t)/t b``, and then share at least ``t/(2-t) b``: a text that shares fewer with a
template is left at once, and a run is followed until it has more distinct bigrams than the upper
bound. Anchors: a match holds at least one of any ``b - ceil(t/(2-t) b) + 1`` bigrams of the template;
the scan picks those with the longest words and looks for the words.

Everything is DataFrame functions; the template side of the joins is the
fixed table below (or the one given), broadcast."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, broadcast_if_small, checkpointed

THRESHOLD = 0.8
#: Bytes that a head takes in a broadcast, at most.
HEAD_BYTES = 64

# Licence notices as their authors publish them (short notes, standard headers, short licences).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details."""),
    ("LGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
more details."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _bounds(size: int, threshold: float) -> tuple[int, int, int]:
    """(fewest, most) bigrams of a candidate, and fewest shared, for a template of ``size`` bigrams."""
    least = math.ceil(threshold * size / (2 - threshold) - 1e-9)
    return least, math.floor((2 - threshold) * size / threshold + 1e-9), least


def anchors(templates: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every match holds at least one: long ones first, of equal
    length those that serve most templates, so that the list stays short."""
    word = {b: max(b.split(), key=lambda w: (len(w), w)) for _, bigrams in templates for b in bigrams}
    serves = Counter(w for _, bigrams in templates for w in {word[b] for b in bigrams})
    found = set()
    for _, bigrams in templates:
        n = len(bigrams) - _bounds(len(bigrams), threshold)[2] + 1
        found.update(word[b] for b in sorted(bigrams, key=lambda b: (-len(word[b]), -serves[word[b]], b))[:n])
    return sorted(found)


def normalised(text: Column) -> Column:
    """Lower case; all but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams_of(text: Column) -> Column:
    """The bigrams of a normalised text in order, repeats included; fewer than two words have none."""
    w = F.split(text, " ")
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _best_runs(texts: DataFrame, heads: DataFrame, side: DataFrame, threshold: float) -> DataFrame:
    """``row, template, start, score, n, last``: the best run of each of
    ``heads(row, template, size, most, start)`` that matches, with its number of distinct
    bigrams and its last bigram.

    A run is cut from twice as many bigrams as it may have distinct ones; heads behind
    which these repeat too much for that are taken again with twice as many, until all are done."""
    found, reach = None, 2
    while True:
        grouped = heads.groupBy("row").agg(F.collect_list(F.struct("template", "size", "most", "start")).alias("h"))
        behind = F.slice("g", F.col("h.start") + 1, F.col("h.most") * reach)
        if heads.count() * HEAD_BYTES <= BROADCAST_BYTES:  # mostly so after the first turn: the texts then stay where they are
            grouped = F.broadcast(grouped)
        runs = texts.select("row", "g").join(grouped, "row").select("row", "g", F.explode("h").alias("h")) \
            .select("row", "h.*", F.array_distinct(behind).alias("x"), (F.col("h.start") + F.col("h.most") * reach < F.size("g")).alias("more"))
        left = F.col("more") & (F.size("x") <= F.col("most"))
        bigrams = runs.where(~left).select("row", "template", "size", "start", F.posexplode(F.slice("x", F.lit(1), F.col("most"))).alias("k", "bigram"))
        both = F.row_number().over(Window.partitionBy("row", "template", "start").orderBy("k"))
        n = F.col("k") + 1
        scored = bigrams.join(F.broadcast(side.select("template", "bigram")), ["template", "bigram"]) \
            .withColumn("both", both).withColumn("score", 2 * F.col("both") / (n + F.col("size"))).where(F.col("score") >= threshold)
        best = scored.groupBy("row", "template", "start").agg(F.max_by(F.struct("score", n.alias("n"), F.col("bigram").alias("last")),
                                                                      F.struct("score", -F.col("k"))).alias("b")) \
            .select("row", "template", "start", "b.*")
        found = best if found is None else found.unionByName(best)
        heads = checkpointed(runs.where(left).select("row", "template", "size", "most", "start"))
        if heads.isEmpty():
            return found
        reach *= 2


def _winners(candidates: Column) -> Column:
    """Candidates, best first, without those that share a word with one before that stayed."""
    none = F.slice(candidates, 1, 0)
    return F.aggregate(F.array_sort(candidates), none, lambda kept, x: F.when(
        F.exists(kept, lambda a: (a["start"] <= x["stop"]) & (x["start"] <= a["stop"])), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each licence found at a place: ``id_col, license, place,
    n_words, score`` (``place`` counts words of the normalised text from 0).

    Null and empty texts and those of fewer than two words match nothing. Repeated rows are
    scanned each on its own; of templates with equal bigrams the first wins. Every run of the whole text is a
    candidate, whatever the text's length; a text's own candidates (one a head) are weighed in one row, and
    a text in which a template's bigrams begin ``m`` runs costs ``m`` times the template's length. ``templates``
    (pairs of licence and text) replaces the built-in table; it is broadcast and must stay small."""
    spark = docs.sparkSession
    known = [(name, template_bigrams(text)) for name, text in (TEMPLATES if templates is None else templates)]
    known = [(name, b) for name, b in known if b]
    side = spark.createDataFrame([(k, g) for k, (_, b) in enumerate(known) for g in b], "template int, bigram string")
    limits = spark.createDataFrame([(k, name, len(b), *_bounds(len(b), threshold)[:2]) for k, (name, b) in enumerate(known)],
                                   "template int, license string, size int, least int, most int")

    needed = F.array(*[F.lit(a) for a in anchors(known, threshold)] or [F.lit("")])
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("row"))
    # a text without any anchor word has no match
    rows = checkpointed(rows.where(F.arrays_overlap(F.split("text", " "), needed)))
    cut = rows.select("row", bigrams_of(F.col("text")).alias("g"))
    # templates of which a text holds enough distinct bigrams
    pairs = cut.select("row", F.explode(F.array_distinct("g")).alias("bigram")).join(F.broadcast(side), "bigram") \
        .groupBy("row", "template").agg(F.count(F.lit(1)).alias("both")).join(F.broadcast(limits), "template").where("both >= least")
    pairs = checkpointed(pairs.select("row", "template", "size", "most"))
    # the few texts with such a template are stored with their bigrams: every later step reads only these
    texts = checkpointed(rows.join(broadcast_if_small(checkpointed(pairs.select("row").distinct())), "row")
                         .select("row", "id", bigrams_of(F.col("text")).alias("g")))
    hits = texts.select("row", F.posexplode("g").alias("start", "bigram")).join(F.broadcast(side), "bigram") \
        .join(broadcast_if_small(pairs), ["row", "template"])
    before = F.lag("start").over(Window.partitionBy("row", "template").orderBy("start"))
    heads = checkpointed(hits.withColumn("before", before).where("before IS NULL OR before < start - 1")
                         .select("row", "template", "size", "most", "start"))
    runs = checkpointed(_best_runs(texts, heads, side, threshold)).join(F.broadcast(limits.select("template", "license")), "template")
    # array_sort puts the best first: higher score, larger run, earlier start, earlier template
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("score", "n", "start", "template", "license", "last")).alias("c"))
    end = F.transform("c", lambda x: F.struct(
        (-x["score"]).alias("s"), (-x["n"]).alias("n"), x["start"].alias("start"), x["template"].alias("template"), x["license"].alias("license"),
        # a bigram is two words: the last word of the run
        (x["start"] + F.array_position(F.slice("g", x["start"] + 1, F.size("g")), x["last"]).cast("int")).alias("stop")))
    placed = texts.join(runs, "row").select("id", F.explode(_winners(end)).alias("w"))
    return placed.select(
        F.col("id").alias(id_col), "w.license", F.col("w.start").cast("bigint").alias("place"),
        (F.col("w.stop") - F.col("w.start") + 1).cast("bigint").alias("n_words"), (-F.col("w.s")).alias("score"))
