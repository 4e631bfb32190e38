"""License scans in DataFrame functions alone.

Overlapping windows of a text's shingles meet the templates by MinHash bands, and the templates found are
then verified by exact containment of their shingles in the whole text.

Windows hold four shingles and start at every one, as do a template's own: a run of four of its shingles
is one of its windows, so their similarity is 1 and every band collides. A window that shares three of
four (similarity 0.6) is still found by one of two one-row bands with probability 0.84. All templates are
also met by windows of one shingle, whose one band always collides, so none that is contained is missed,
however its shingles are scattered.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, text_of, written

WIDTH, LEAST_PERCENT = 5, 80
WINDOW, BLOCK, BANDS = 4, 8, 2
#: Candidates that may be broadcast, at most (a few dozen bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000

#: Public licence notices, short and whole ones, and the names they stand for.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)


def words_in(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def shingles_in(text: str, width: int) -> list[str]:
    """The text's distinct shingles, in order; fewer words than width make one."""
    w = words_in(text)
    return list(dict.fromkeys(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))) if w else []


def words(text: Column) -> Column:
    """The words of a text: runs of a-z and 0-9 after lower-casing A-Z; all else separates."""
    return F.array_remove(F.split(ascii_lower(text), "[^a-z0-9]+"), "")


def hashed(at: int, width: int) -> Column:
    """The hash of the shingle of ``width`` words that starts at column w<at>; null past the text's end."""
    return F.when(F.col(f"w{at + width - 1}").isNotNull(), F.xxhash64(*[f"w{at + k}" for k in range(width)]))


def seeds() -> list[int]:
    """A permutation of the hashes for each band: exclusive or with a random number."""
    rng = random.Random(11)
    return [rng.getrandbits(63) for _ in range(BANDS)]


def band_values(hashes: Sequence[Column], at: int) -> list[Column]:
    """The window's least hash under each band's permutation; null where it has no shingle."""
    return [F.least(*[h.bitwiseXOR(F.lit(s)) for h in hashes[at : at + WINDOW]]) for s in seeds()]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, width: int = WIDTH, percent: int = LEAST_PERCENT, key: str = "doc_id") -> DataFrame:
    """key, license, template (number), n_shingles, n_shared, containment for each template found.

    A template is found where at least ``percent`` of its distinct shingles (``width`` words; all its words
    if it has fewer) occur in the whole text. Null, empty and short texts hold none; a text of any length
    is scanned in blocks. Rows that repeat a key give one row per template, with the most that one of them
    shares; null keys count as one key. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    sets = [(i, name, shingles_in(text, width)) for i, (name, text) in enumerate(templates)]
    sets = [(i, name, s, len(s[0].split())) for i, name, s in sets if s]
    short = sorted({w for _, _, s, w in sets if w != width})
    table = spark.createDataFrame([(i, name, s) for i, name, s, _ in sets], "template int, license string, shingles array<string>")
    # The templates' own hashes, by the same functions; a bounded number of literals.
    pairs = spark.createDataFrame([(i, j, w.split()) for i, _, s, _ in sets for j, w in enumerate(s)], "template int, at int, w array<string>")
    pairs = pairs.select("template", "at", F.size("w").alias("n"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    sized = pairs.select("template", "at", F.coalesce(*[F.when(F.col("n") == n, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(n)])) for n in sorted({width, *short})]).alias("h"))
    known = {(r["template"], r["at"]): r["h"] for r in sized.collect()}
    single: dict[int, set[tuple[int, int]]] = {w: set() for w in (width, *short)}  # width: (hash, template)
    bands: list[set[tuple[int, int]]] = [set() for _ in range(BANDS)]
    for i, _, s, w in sets:
        h = [known[i, j] for j in range(len(s))]
        single[w] |= {(x, i) for x in h}
        if len(h) >= WINDOW:
            for at in range(len(h) - WINDOW + 1):
                for b, seed in enumerate(seeds()):
                    bands[b].add((min(x ^ seed for x in h[at : at + WINDOW]), i))
    reach = BLOCK - 1 + WINDOW
    ws = F.transform(words(text_of(docs)), lambda w: F.xxhash64(w))
    blocks = docs.select(F.col(key), ws.alias("w"))
    blocks = blocks.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(BLOCK)), lambda p: F.slice("w", p + 1, reach + width - 1))).alias("b"))
    # Generators keep each step's columns apart from what reads them, so that each is computed once.
    step = lambda df, columns: df.select(key, F.inline(F.array(F.struct(*columns))))
    blocks = step(blocks, [F.get("b", F.lit(k)).alias(f"w{k}") for k in range(reach + width - 1)])
    blocks = step(blocks, [hashed(k, width).alias(f"h{k}") for k in range(reach)] + [hashed(k, w).alias(f"s{w}_{k}") for w in short for k in range(BLOCK)])
    probes = [v for at in range(BLOCK) for v in band_values([F.col(f"h{k}") for k in range(reach)], at)]
    probes += [F.col(f"h{k}") for k in range(BLOCK)] + [F.col(f"s{w}_{k}") for w in short for k in range(BLOCK)]
    # Bands differ by 64 random bits, so values of all bands and windows can share one set and one join.
    values = sorted({x for s in (*bands, *single.values()) for x in s})
    index = spark.createDataFrame(values, "value long, template int")
    found = blocks.select(key, F.explode(F.array(*probes)).alias("value")).where(F.col("value").isin(sorted({x for x, _ in values})))
    candidates = written(found.join(F.broadcast(index), "value").select(key, "template").distinct())
    side = candidates.withColumnRenamed(key, "k")
    side = F.broadcast(side) if candidates.count() <= BROADCAST_ROWS else side
    near = docs.select(key, text_of(docs).alias("text")).join(side, F.col(key).eqNullSafe(F.col("k"))).join(F.broadcast(table), "template")
    joined = near.select(key, "template", "license", "shingles", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("line"))
    shared = F.size(F.filter("shingles", lambda s: F.contains("line", F.concat(F.lit(" "), s, F.lit(" ")))))
    out = joined.select(key, "license", "template", F.size("shingles").alias("n_shingles"), shared.alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    out = out.groupBy(key, "license", "template", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def oracle() -> str:
    """The same by plain containment, for DuckDB."""
    rows = ", ".join(f"({i}, '{name}', '{s}', {len(x)})" for i, (name, text) in enumerate(TEMPLATES) for x in [shingles_in(text, WIDTH)] for s in x)
    return f"""
WITH t(template, license, shingle, n) AS (VALUES {rows}),
d AS (SELECT doc_id, ' ' || regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g') || ' ' AS line FROM documents)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n AS containment
FROM d JOIN t ON contains(line, ' ' || shingle || ' ')
GROUP BY doc_id, license, template, n HAVING count(*) * 100 >= n * {LEAST_PERCENT}"""
