"""License scans by a trained paragraph classifier, in DataFrame functions and MLlib only.

Texts are cut into paragraphs (lines, and sentences of longer lines). All are looked at, with or without
words like license: only one that a template can confirm can be a license's, and of these none
is passed over (hit). They are classified by a multinomial logistic regression over hashed word
one- and two-grams, trained here on phrases of each family, on variants of them with words
left out, and, for the unknown class, on other uses of the same words and on at most
UNKNOWN paragraphs each of the documents' anchored ones that hold no template, of those that have most words in
common with templates and hold none, and of their other first lines. The cutoff of the unknown class is calibrated on the held-out quarter of the
first two sorts, the stricter one: it is the lowest chance of
any family, from 0.5 on, that at most FALSE of them reach; a paragraph that names a license needs 0.5. In a corpus whose anchored paragraphs all
name licenses the first sort holds only the built-in uses (OTHERS), some eighty rows.

A prediction is confirmed by template, the likeliest family that can be: the paragraph holds what names this family and no other (MARKS: so
ShareAlike is not taken for Attribution, nor Lesser for General), or it and a published paragraph of the
family (BODIES) cover each other, or it is a line of one. What says that something is not licensed so
(DENIED) is not confirmed. A paragraph that several licenses share names the likeliest, and only in a text in
which no other paragraph is of one alone.

Cases: null text counts as empty; texts of any length are searched whole; repeated rows are
kept apart by a row number; documents without a license have no families and n_paragraphs 0; of
paragraphs of equal probability the first names the license;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_sample, once, table, text_or_empty, written

UNKNOWN, FALSE, SEED, SIZE, COVER = 3000, 0.01, 11, 1 << 13, 0.5
ANCHORS = r"(?i)licen[sc]|copyright|©|warrant|permission|redistribut|rights reserved|public domain|\bGNU\b|SPDX|creative commons|\bCC[ -]BY|\bCC0\b|proprietary|unauthori[sz]ed copying|free to copy"
#: What a text in lower case must hold for any anchor to stand in it.
NEEDLES = ["licen", "copyright", "©", "warrant", "permission", "redistribut", "rights reserved", "public domain", "gnu", "spdx", "creative commons", "cc by", "cc-by", "cc0", "proprietary", "ed copying", "free to copy"]
#: What it must hold, where no anchor does, for MARKS to name a license.
SHORT_NEEDLES = ["gpl", "apache", "bsd-", "mpl", "epl", "bsl-1", "attribution"]
#: The same, more closely: not the "mpl" of an example.
SHORT_NAMES = r"\b(?:[al]?gpl|apache\b|bsd-[234]|mpl|epl|bsl-1)|attribution[ -]"
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

#: Short phrases by which licenses are commonly named.
NAMINGS: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license.", "License: MIT", "Distributed under an MIT-style license."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "License: Apache 2.0", "The code is available under the Apache 2 license."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License version 2", "License: GPLv3", "Licensed under the GPL version 2 or later."],
    "lgpl": ["GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "License: LGPL"],
    "agpl": ["GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3.", "License: AGPLv3"],
    "bsd": ["SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "License: BSD"],
    "isc": ["SPDX-License-Identifier: ISC", "Released under the ISC License.", "License: ISC", "This package is available under the terms of the ISC license."],
    "mpl-2.0": ["SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License, v. 2.0.", "License: MPL 2.0"],
    "epl-2.0": ["SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License 2.0.", "License: EPL 2.0"],
    "bsl-1.0": ["SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Shared under a CC-BY license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "public-domain": ["This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright (c) Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying is strictly prohibited."],
}
#: Short names by which package files and headers call them, and the places where they stand.
SHORT: dict[str, str] = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-or-later GPLv2 GPLv3 GPL", "lgpl": "LGPL-2.1 LGPL-2.1-or-later LGPL-3.0-only LGPLv3 LGPL", "agpl": "AGPL-3.0 AGPL-3.0-only AGPLv3",
    "bsd": "BSD-2-Clause BSD-3-Clause BSD", "isc": "ISC", "mpl-2.0": "MPL-2.0", "epl-2.0": "EPL-2.0", "bsl-1.0": "BSL-1.0", "cc-by": "CC-BY-4.0 CC-BY-3.0", "cc-by-sa": "CC-BY-SA-4.0 CC-BY-SA-3.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0", "public-domain": "CC0-1.0 CC0 Unlicense",
}
PLACES = ["SPDX-License-Identifier: {}", "SPDX: {}", "License: {}", "Licensed under {}.", "Released under a {} license."]
#: Paragraphs of the licenses, as published.
BODIES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"],
    "public-domain": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
}
FAMILIES = {name: [*phrases, *[place.format(x) for x in SHORT.get(name, "").split() for place in PLACES], *BODIES.get(name, [])] for name, phrases in NAMINGS.items()}
#: What a paragraph that names a license must hold (in lower case) to name this one and no other, by family.
MARKS: dict[str, str] = {
    "mit": r"\bmit\b.{0,12}licen[sc]e|licen[sc]e[sd]?\b.{0,30}\bmit\b|spdx\S*\s*mit\b",
    "apache-2.0": r"\bapache\b(?:.{0,30}\b(?:licen[sc]e|2(?:\.0)?)|-2\.0)",
    "gpl": r"(?<!lesser )(?<!affero )(?<!library )\bgeneral public licen[sc]e|\bgpl(?:v?-?\d|\b)",
    "lgpl": r"\b(?:lesser|library) general public licen[sc]e|\blgpl",
    "agpl": r"\baffero general public licen[sc]e|\bagpl",
    "bsd": r"\bbsd\b[\w /-]{0,12}licen[sc]e|licen[sc]e[sd]?\b.{0,30}\bbsd\b|\bbsd-[234]-clause",
    "isc": r"\bisc\b.{0,12}licen[sc]e|licen[sc]e\S*.{0,20}\bisc\b",
    "mpl-2.0": r"\bmozilla public licen[sc]e|\bmpl(?:\b|-?2)",
    "epl-2.0": r"\beclipse public licen[sc]e|\bepl(?:\b|-?2)",
    "bsl-1.0": r"\bboost software licen[sc]e|\bbsl-1",
    "cc-by": r"\bcc[ -]by\b(?!-(?:sa|nd|nc))(?! (?:sa|nd|nc)\b)|creative commons attribution(?![ -](?:share|no))",
    "cc-by-sa": r"\bcc[ -]by[ -]sa\b|attribution[ -]share ?-?alike",
    "cc-by-nd": r"\bcc[ -]by[ -]nd\b|attribution[ -]no ?-?derivatives",
    "cc-by-nc": r"\bcc[ -]by[ -]nc\b|attribution[ -]non ?-?commercial",
    "public-domain": r"\bcc0\b|\bunlicense\b|(?:dedicat|releas|plac|put)\w*\b.{0,24}public domain",
    "proprietary": r"all rights reserved|prior written permission of|proprietary and confidential|unauthori[sz]ed copying|free to copy",
}
#: What a short name that has other meanings must hold where no anchor stands beside it.
VERSIONED: dict[str, str] = {"apache-2.0": r"\bapache[ -](?:version )?v?2\.0", "mpl-2.0": r"\bmpl[ -]?v?[12]\b|mozilla", "epl-2.0": r"\bepl[ -]?v?[12]\b|eclipse"}
#: A paragraph that says that something is not licensed so.
DENIED = r"\b(?:not|never|no longer|n't)\s+(?:\w+\s+){0,3}(?:licensed|released|distributed|covered|available|governed|published|under|part of)\b"
#: Other uses of the anchors' words.
OTHERS = ["He lost his driving license last year.", "The license plate of the car was stolen.", "She asked for permission to leave the room.", "A search warrant was issued by the judge.", "The warranty of the washing machine has ended.", "Copyright law is taught in the second term.", "The pub has a license to sell beer.", "The redistribution of income was debated.", "Fishing without a licence is an offence.", "The government granted a mining license.", "Permission to land was denied by the tower.", "The court lifted the copyright claim against the singer.", "All visitors need a fishing permit or license.", "Warranty repairs are done in the second workshop.", "He studied the history of copyright and of the free press.", "This car is sold without warranty.", "An Apache helicopter and 2 planes flew over the town.", "The Apache rode 20 miles to the river.", "The EPL season begins in August.", "Two EPL clubs spent more than all others.", "The MPL of the crop is one unit a year.", "MPL levels were measured twice.", "The GPL station closes at ten.", "Attribution shares of the donors are listed below."]
NAMES = [*FAMILIES, "unknown"]
#: Of the words of a body that a paragraph holds, and of its own that stand in the body: half and most of them, or nearly all its own where it is a line of some words.
BACK, LINE, LINE_WORDS = 0.6, 0.85, 6
#: What chance a family that a template confirms must have, where the likeliest one is another.
LEAST = 0.02


def variants(phrase: str, draw: random.Random, n: int = 12) -> list[str]:
    """The phrase, and shorter ones with up to a quarter of its words left out."""
    words = phrase.split()
    return [phrase, *[" ".join(w for k, w in enumerate(words) if k not in left) for left in (set(draw.sample(range(len(words)), draw.randint(0, len(words) // 4))) for _ in range(n))]]


def pieces(body: str, draw: random.Random, n: int = 10) -> list[str]:
    """Lines of a body, as it is wrapped at some width."""
    words = body.split()
    if len(words) <= 12:
        return []
    at = [draw.randint(0, len(words) - 8) for _ in range(n)]
    return [" ".join(words[k : k + draw.randint(8, 14)]) for k in at]


def words(column: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(column) if isinstance(column, str) else column), F.lit(WORD), F.lit(0))


def vectors(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with features: hashed one- and two-grams of paragraph, and the letters in its words."""
    split = paragraphs.withColumn("words", words("paragraph"))
    grams = NGram(n=2, inputCol="words", outputCol="pairs").transform(split).withColumn("terms", F.concat("words", "pairs", F.regexp_extract_all(F.lower("paragraph"), F.lit(r"\p{L}+"), F.lit(0))))
    return HashingTF(numFeatures=SIZE, binary=True, inputCol="terms", outputCol="features").transform(grams).drop("words", "pairs", "terms")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, hits, line, plain: the hit of each paragraph of each text that has one, its first line, and whether that as a whole is none."""
    held = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    parts = F.split("text", r"\n|(?<=[.!?])[ \t]+(?=\p{Lu})", -1)
    low = held.withColumn("low", F.lower("text")).withColumn("line", F.substring_index("text", "\n", 1))
    # The gates are of the whole text, so they are not to be evaluated for each paragraph.
    gates = F.struct(any_within(F.col("low"), NEEDLES).alias("some"), any_within(F.col("low"), SHORT_NEEDLES).alias("short"))
    hits = lambda g: F.filter(F.transform(parts, lambda x, k: hit(x, k, g)), lambda h: h.isNotNull())
    seen = once(gates, lambda g: F.struct(hits(g).alias("hits"), hit(F.col("line"), F.lit(0), g).isNull().alias("plain")))
    return low.select("doc_id", "row", "line", seen.alias("seen")).select("doc_id", "row", "seen.hits", "line", "seen.plain")


def hit(paragraph: Column, number: Column, gates: Column) -> Column:
    """number, paragraph, anchored, named, bodies of a paragraph with an anchor, or that a template may confirm; else null.

    named and bodies are the families that it names and those that have such a body, looked for here alone, as this is
    most of the work. A paragraph names none without an anchor or a short name. Every body that confirms one has BACK of
    its words, LINE of a line's, so all bodies together have as many, and LEAST_KNOWN at least.
    """
    isin = lambda own: F.filter(own, lambda w: w.isin(KNOWN))
    none = F.array().cast("array<string>")

    def judged(w: Column) -> Column:
        mostly = (w["n"] > 0) & (F.size(w["known"]) >= BACK * w["n"])
        bodies = F.when(mostly & (F.size(w["known"]) >= LEAST_KNOWN), by_body(w["known"], w["n"])).otherwise(none)
        kept = lambda named: F.struct(number.alias("number"), paragraph.alias("paragraph"), w["anchored"].alias("anchored"), named.alias("named"), bodies.alias("bodies"))
        return once(F.when(w["anchored"] | w["short"], by_name(paragraph)).otherwise(none), lambda named: F.when(w["anchored"] | (F.size(named) > 0) | mostly, kept(named)))

    # The needles first: a pattern costs several times as much.
    anchored = gates["some"] & any_within(F.lower(paragraph), NEEDLES) & paragraph.rlike(ANCHORS)
    short = gates["short"] & any_within(F.lower(paragraph), SHORT_NEEDLES) & F.lower(paragraph).rlike(SHORT_NAMES)
    counted = lambda own: F.struct(anchored.alias("anchored"), short.alias("short"), F.size(own).alias("n"), isin(own).alias("known"))
    return once(F.array_distinct(words(paragraph)), lambda own: once(counted(own), judged))


def any_within(text: Column, needles: list[str]) -> Column:
    return once(text, lambda t: reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in needles]))


def unknown(found: DataFrame, n: int) -> DataFrame:
    """At most n anchored paragraphs that no family's template confirms, n others of most of their words, and n further first lines, drawn by a hash of their words."""
    draw = F.xxhash64(F.lit(SEED), "paragraph").alias("draw")
    hits = found.select(F.explode("hits").alias("h")).select("h.*")
    alike = hits.where((F.size("named") == 0) & (F.size("bodies") == 0)).select("paragraph", "anchored", draw)
    lines = found.where("plain").select(F.col("line").alias("paragraph")).select("paragraph", draw)
    sorts = {"anchored": alike.where("anchored"), "alike": alike.where("not anchored"), "other": lines}
    return reduce(DataFrame.unionByName, [bounded_sample(x.select("paragraph", "draw"), "draw", n, x.count()).withColumn("sort", F.lit(k)) for k, x in sorts.items()])


def trained(found: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the cutoff of the unknown class, from the result of paragraphs."""
    spark, draw = found.sparkSession, random.Random(SEED)
    none = float(len(FAMILIES))
    rows = [(v, float(k), j % 4 == 3, "anchored") for k, (_, phrases) in enumerate(FAMILIES.items()) for p in phrases for j, v in enumerate([*variants(p, draw), *pieces(p, draw)])]
    rows += [(v, none, j % 4 == 3, "anchored") for p in OTHERS for j, v in enumerate(variants(p, draw))]
    made = spark.createDataFrame(rows, "paragraph string, label double, held boolean, sort string")
    drawn = unknown(found, UNKNOWN).select("paragraph", F.lit(none).alias("label"), (F.pmod("draw", F.lit(4)) == 3).alias("held"), "sort")
    sample = written(made.unionByName(drawn), "license-sample")
    ready = vectors(sample)
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60).fit(ready.where("not held"))
    held = model.transform(ready.where(F.col("held") & (F.col("sort") != "other") & (F.col("label") == none)))
    known = 1 - F.element_at(vector_to_array("probability"), len(NAMES))
    bounds = held.groupBy("sort").agg(F.percentile(known, F.lit(1 - FALSE)).alias("p")).collect()  # a row for each of two sorts
    return model, max([0.5, *[r.p for r in bounds]])


def template_words(phrase: str) -> list[str]:
    return sorted(set(re.findall(r"\w+(?:[.-]\w+)*", phrase.lower())))


#: All words of bodies, and the least number of them with which a body can confirm a paragraph: half of the shortest body's, or a line's share.
KNOWN = sorted({w for texts in BODIES.values() for p in texts for w in template_words(p)})
LEAST_KNOWN = min([LINE * LINE_WORDS, *[COVER * len(template_words(p)) for texts in BODIES.values() for p in texts]])


def by_name(paragraph: Column) -> Column:
    """The families of which the paragraph holds what names this one and no other."""
    sure = lambda name, low: paragraph.rlike(ANCHORS) | low.rlike(VERSIONED[name]) if name in VERSIONED else F.lit(True)
    each = lambda low: F.array(*[F.when(low.rlike(mark) & sure(name, low), F.lit(name)) for name, mark in MARKS.items()])
    return F.filter(once(F.lower(paragraph), each), lambda x: x.isNotNull())


def by_body(known: Column, n: Column) -> Column:
    """The families of which a body covers the words and is covered by them, or has nearly all of a line's; known: those of the n distinct words that are in KNOWN."""
    bodies = F.array(*[F.struct(F.lit(name).alias("family"), F.array(*[F.lit(w) for w in template_words(p)]).alias("words")) for name, texts in BODIES.items() for p in texts])
    shared = F.transform(bodies, lambda t: F.struct(t["family"].alias("family"), F.size(t["words"]).alias("size"), F.size(F.array_intersect(known, t["words"])).alias("shared")))
    both = lambda t: (t["shared"] >= COVER * t["size"]) & (t["shared"] >= BACK * n)
    line = lambda t: (n >= LINE_WORDS) & (t["shared"] >= LINE * n)
    return F.array_distinct(F.transform(F.filter(shared, lambda t: both(t) | line(t)), lambda t: t["family"]))


def classified(hits: DataFrame, model: LogisticRegressionModel, cutoff: float) -> DataFrame:
    """hits (row, number, paragraph, named, bodies) that a template confirms, with family, probability, and alone: whether no other family has the same template.

    A paragraph is a license's if the chance of all families together reaches the cutoff, or a half where it
    names one. It is of the
    likeliest family that a template confirms, which must have a probability of LEAST: of those that it
    names if it names any, else of those with such a body; unknown if there is none.
    """
    # Whatever the model says, only what a template confirms is a license's.
    fits = hits.where((F.size("named") > 0) | (F.size("bodies") > 0))
    scored = model.transform(vectors(fits)).withColumn("p", vector_to_array("probability"))
    best = F.array_max(F.slice("p", 1, len(FAMILIES)))
    fitting = scored.withColumn("fit", F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("bodies")))
    chances = F.array(*[F.struct(F.element_at("p", k + 1).alias("chance"), F.lit(name).alias("name")) for k, name in enumerate(FAMILIES)])
    first = F.array_max(F.filter(chances, lambda x: F.array_contains("fit", x["name"]) & (x["chance"] >= LEAST)))
    is_license = (1 - F.element_at("p", len(NAMES)) >= F.when(F.size("named") > 0, 0.5).otherwise(cutoff)) & ~F.lower("paragraph").rlike(DENIED)
    told = fitting.withColumn("first", F.when(is_license, first))
    return told.select("row", "number", "paragraph", F.coalesce("first.name", F.lit("unknown")).alias("family"), F.coalesce("first.chance", best).alias("probability"), ((F.size("named") > 0) | (F.size("bodies") == 1)).alias("alone"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_anchored, n_paragraphs, families and license of every document."""
    found = written(paragraphs(docs), "license-paragraphs")
    model, cutoff = trained(found)
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    sure = classified(hits, model, cutoff).where("family <> 'unknown'")
    per_row = sure.groupBy(F.col("row").alias("hit_row")).agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.array_join(F.array_sort(F.when(F.bool_or("alone"), F.collect_set(F.when(F.col("alone"), F.col("family")))).otherwise(F.collect_set("family"))), ",").alias("families"),
        F.max_by("family", F.struct("alone", "probability", -F.col("number"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set("number")), ",").alias("at"),
    )
    joined = found.select("doc_id", "row", F.size(F.filter("hits", lambda h: h["anchored"])).cast("long").alias("n_anchored")).join(per_row, F.col("row") == F.col("hit_row"), "left")
    return joined.select("doc_id", "row", "n_anchored", F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("license", F.lit("none")).alias("license"), F.coalesce("at", F.lit("")).alias("paragraph_numbers"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    return scanned(table(spark, sf_dir, "documents")).drop("row")
