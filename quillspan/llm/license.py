"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only, and no shuffle. A text's bigrams that some template has are its hits; a template is looked for
only where enough of its bigrams are hit to reach the least coefficient, and there in windows whose size can reach it.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paragraphs that several templates share.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version."
)
_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_NAMES = [("GPL-3.0", "General Public License"), ("LGPL-3.0", "Lesser General Public License"), ("AGPL-3.0", "Affero General Public License")]
_CC_NAMES = [("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives")]
#: Notices and bodies in the words their licences ask for, as (licence, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin "
        "of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(name, f"This work is licensed under the GNU {title}, version 3.") for name, title in _GNU_NAMES],
    *[(name, _GNU.format(title)) for name, title in _GNU_NAMES],
    *[(name, (_GNU + _GNU_REST).format(title)) for name, title in _GNU_NAMES],
    *[(name, f"Licensed under CC {short} 4.0.") for name, short, _ in _CC_NAMES],
    *[(name, f"This work is licensed under a Creative Commons {title} 4.0 International License.") for name, _, title in _CC_NAMES],
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
]
MIN_DICE = 0.8


def normalise(text: str) -> str:
    """The driver's form of the rule that ``_plain`` applies to a column."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(text: str) -> list[str]:
    """The word bigrams of a normalised text in order, repeats included."""
    w = text.split()
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def band(n: int, least: float) -> tuple[int, int]:
    """The least and the most m with 2 min(m, n) / (m + n) >= least, in whole numbers: least is the fraction that its digits say."""
    p, q = (x := Fraction(str(least))).numerator, x.denominator
    return -(-n * p // (2 * q - p)), n * (2 * q - p) // p


def best_window(have: list[str], grams: list[str], least: float = MIN_DICE) -> float:
    """The largest coefficient of a template's bigrams with a window of a text's, as ``scan_licenses`` defines it; for a small text."""
    own = set(have)
    longest, top = band(len(own), least)[1] + len(have) - len(own), 0.0
    for a, g in enumerate(grams):
        if g in own:
            seen, repeats = set(), 0
            for b in range(a, min(len(grams), a + longest)):
                if grams[b] in own:
                    repeats += grams[b] in seen
                    seen.add(grams[b])
                    top = max(top, 2.0 * len(seen) / (b - a + 1 - repeats + len(own)))
    return top


def prepared(templates, least: float) -> list[dict]:
    """Templates of two words or more: licence, distinct bigrams, how many must be hit, the longest window, and the others that may be meant where it is found."""
    known = [{"name": name, "all": (g := bigrams(normalise(body))), "grams": sorted(set(g))} for name, body in templates if len(normalise(body).split()) > 1]
    for t in known:
        low, high = band(len(t["grams"]), least)
        t |= {"least": low, "longest": high + len(t["all"]) - len(t["grams"])}
        t["rivals"] = [i for i, u in enumerate(known) if u["name"] != t["name"] and best_window(t["all"], u["all"], least) >= least]
    return known


def _list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=tuple(TEMPLATES), least: float = MIN_DICE) -> DataFrame:
    """(key, n_templates, licenses, best_dice) for every row of ``docs``.

    Normalised: lower case, runs of anything but a-z and 0-9 to one space; so lines, comment signs and punctuation don't
    count. A window is a run of consecutive word bigrams of the normalised text. A template with m distinct bigrams and a
    window with c of them, each counted once, and f other bigrams have the Dice coefficient 2 c / (c + f + m). A template is
    found if some window reaches ``least``; sizes bound the search: c must reach m least / (2 - least), and a window has
    m (2 - least) / least bigrams at most, and as many more as the template has repeats. Where the words of one licence's template come near those of another's, it counts only if
    that one's best coefficient isn't larger.

    n_templates: how many templates count; licenses: their distinct names, sorted, joined by commas ('' if none);
    best_dice: the largest coefficient of those, 0 if none. Null and empty texts have no windows. The work is linear in
    a text's length, however long. Ties: equal templates of two licences both count. Only the two named columns are read;
    null and repeated keys get a row each; an empty table gives an empty result. Templates of one word are ignored.
    """
    known = prepared(templates, least)
    none = [F.lit(0).cast("long").alias("n_templates"), F.lit("").alias("licenses"), F.lit(0.0).alias("best_dice")]
    if not known:
        return docs.select(key, *none)
    every = sorted({g for t in known for g in t["grams"]})
    first = _list(sorted({g.split()[0] for g in every}))
    fewest = min(t["least"] for t in known)
    df = docs.select(F.col(key), F.split(_plain(F.coalesce(F.col(text), F.lit(""))), " ").alias("_w"))
    gram = "concat(x, ' ', get(_w, i + 1))"
    df = df.withColumn("_hit", F.expr(f"array_compact(transform(_w, (x, i) -> if(x IN ({first}), if({gram} IN ({_list(every)}), named_struct('g', {gram}, 'p', i), NULL), NULL)))"))
    # Sorted by bigram, equal ones are neighbours: each hit learns where its bigram stood before.
    df = df.withColumn("_hit", F.expr(f"if(size(_hit) >= {fewest}, sort_array(_hit), array())"))
    df = df.withColumn("_hit", F.expr("sort_array(transform(_hit, (x, i) -> named_struct('p', x.p, 'g', x.g, 'before', if(i > 0 AND _hit[greatest(i - 1, 0)].g = x.g, _hit[greatest(i - 1, 0)].p, -1))))"))
    own = {f"_own{i}": F.expr(f"if(size(_hit) >= {t['least']}, filter(_hit, x -> x.g IN ({_list(t['grams'])})), array())") for i, t in enumerate(known)}
    df = df.withColumns(own)
    best = {}
    for i, t in enumerate(known):
        new = "cast(x.before < s.p AS int)"
        count, repeats = f"(a.c + {new})", f"(a.r + 1 - {new})"
        step = f"named_struct('c', {count}, 'r', {repeats}, 'd', greatest(a.d, 2.0D * {count} / (x.p - s.p + 1 - {repeats} + {len(t['grams'])})))"
        from_start = f"aggregate(slice(_own{i}, k + 1, {t['longest']}), named_struct('c', 0, 'r', 0, 'd', 0.0D), (a, x) -> if(x.p - s.p < {t['longest']}, {step}, a)).d"
        enough = f"size(_own{i}) >= {t['least']} AND size(array_distinct(transform(_own{i}, x -> x.g))) >= {t['least']}"
        best[f"_best{i}"] = F.expr(f"if({enough}, array_max(transform(_own{i}, (s, k) -> {from_start})), 0.0D)")
    df = df.select(key, "_hit", *[v.alias(k) for k, v in best.items()])
    counts = []
    for i, t in enumerate(known):
        ok = F.col(f"_best{i}") >= least
        for u in t["rivals"]:
            ok &= F.col(f"_best{u}") <= F.col(f"_best{i}")
        counts.append(F.when(ok, F.struct(F.lit(t["name"]).alias("name"), F.col(f"_best{i}").alias("d"))))
    df = df.select(key, F.array_compact(F.array(*counts)).alias("_found"))
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("_found", lambda x: x["name"]))), ",")
    top = F.coalesce(F.array_max(F.transform("_found", lambda x: x["d"])), F.lit(0.0))
    return df.select(key, F.size("_found").cast("long").alias("n_templates"), names.alias("licenses"), F.round(top, 6).alias("best_dice"))


def _sql() -> str:
    known = prepared(TEMPLATES, MIN_DICE)
    rows = ", ".join(f"({i}, '{t['name']}', {len(t['grams'])}, {t['least']}, {t['longest']}, [{_list(t['grams'])}])" for i, t in enumerate(known))
    rivals = ", ".join(f"({i}, {u})" for i, t in enumerate(known) for u in t["rivals"])
    return f"""
WITH templates(t, name, m, least, longest, grams) AS (VALUES {rows}),
rivals(t, u) AS (VALUES {rivals}),
words AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)
), pairs AS (
  SELECT doc_id, p, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM words
), grams AS (
  SELECT t, m, least, longest, unnest(grams) AS g FROM templates
), hits AS (
  SELECT t, doc_id, p, m, least, longest, g, coalesce(lag(p) OVER (PARTITION BY doc_id, t, g ORDER BY p), -1) AS before FROM pairs JOIN grams USING (g)
), likely AS (
  SELECT hits.* FROM hits JOIN (SELECT doc_id, t FROM hits GROUP BY doc_id, t HAVING count(DISTINCT g) >= any_value(least)) USING (doc_id, t)
), windows AS (
  SELECT a.doc_id, a.t, a.m, b.p - a.p + 1 AS n, count(*) FILTER (b.before < a.p) OVER w AS c, count(*) FILTER (b.before >= a.p) OVER w AS r
  FROM likely a JOIN likely b ON a.doc_id = b.doc_id AND a.t = b.t AND b.p >= a.p AND b.p - a.p < a.longest
  WINDOW w AS (PARTITION BY a.doc_id, a.t, a.p ORDER BY b.p)
), best AS (
  SELECT doc_id, t, max(2.0::DOUBLE * c / (n - r + m)) AS d FROM windows GROUP BY doc_id, t
), counted AS (
  SELECT * FROM best x JOIN templates USING (t) WHERE d >= {MIN_DICE}::DOUBLE
  AND NOT EXISTS (SELECT 1 FROM rivals r JOIN best y ON y.t = r.u WHERE r.t = x.t AND y.doc_id = x.doc_id AND y.d > x.d)
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(d) AS d FROM counted GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_templates, coalesce(f.licenses, '') AS licenses, round(coalesce(f.d, 0), 6)::DOUBLE AS best_dice
FROM documents d LEFT JOIN found f USING (doc_id)
"""


OP3_SQL = _sql()


def op3(spark, sf_dir: str) -> DataFrame:
    """The query: the licences found in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
