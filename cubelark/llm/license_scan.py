"""License scans by MinHash bands over overlapping windows; DataFrame operations only.

A text is its words' 5-word shingles in order. For a template of n shingles,
windows of 2n shingles start every n, so each run of n lies whole in one of them.
A window that holds 80 % of a template has at least a Jaccard similarity of
0.8 / 2.2 = 0.36 with it; with 24 bands of one MinHash the chance that none
collides is (1 - 0.36) ** 24, under 3 in 100 000. Windows that collide with a
template are verified by the exact share of its shingles that they hold.

A band collides only if both sides have their least hash at the same shingle. So a
window can collide with a template only if it holds one of the template's band
minima, of which there are at most 24, however long the template is. Only windows
with such a shingle are signed; the others could collide in no band.

A template of fewer than five words is one shingle, its whole word sequence, and
is looked for among the texts' sequences of that length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, share of a template that a window must hold, MinHash bands (of one row each).
SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 24

#: Texts of public licences and their usual notices.
TEMPLATES = {
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Fixed value: what separates words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Hashes of a text's words."""
    flat = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR, " "))
    return F.transform(F.split(flat, " "), lambda w: F.xxhash64(w))


def _sequences(length: int) -> str:
    """Hashes of all runs of that many words of `_w`, in order."""
    parts = ", ".join(f"_w[i + {k}]" for k in range(length))
    return f"case when size(_w) >= {length} then transform(sequence(0, size(_w) - {length}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end"


def _with_shingles(df: DataFrame, short: list[int]) -> DataFrame:
    """Replace the column `text` by `sh`, and by `sh1` and so on for shorter sequences."""
    # explode(array(x)) keeps x from being computed again inside each later expression.
    hashed = df.withColumn("_w", F.explode(F.array(_words(F.col("text"))))).drop("text")
    for length in short:
        hashed = hashed.withColumn(f"sh{length}", F.expr(_sequences(length)))
    return hashed.withColumn("sh", F.explode(F.array(F.expr(_sequences(SHINGLE))))).drop("_w")


def _bands(sh: Column) -> Column:
    """A MinHash for each band."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(sh, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[least(b) for b in range(BANDS)])


def library_in(spark: SparkSession, path: str) -> dict[str, str]:
    """A library from text files, whole licences of any length, by file name; its size is the caller's."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.collect()}


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license_id, n (shingles in order), tsh (distinct shingles) and minima (each band's shingle) of a library given by the caller.

    A template of fewer than SHINGLE words has one shingle, and n is the negative number of its words.
    """
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    rows = rows.select("license_id", _words(F.col("text")).alias("_w"), F.regexp_replace("text", SEPARATOR, "").alias("letters")).where("letters <> ''")
    whole = " ".join(f"when {k} then array(xxhash64({', '.join(f'_w[{i}]' for i in range(k))}))" for k in range(1, SHINGLE))
    out = rows.select("license_id", "_w", F.expr(f"case size(_w) {whole} else {_sequences(SHINGLE)} end").alias("sh"))
    least = [F.array_min(F.transform("sh", lambda h, band=b: F.struct(F.xxhash64(h, F.lit(band)).alias("v"), h.alias("h"))))["h"] for b in range(BANDS)]
    return out.select("license_id", F.expr(f"if(size(_w) < {SHINGLE}, -size(_w), size(sh))").alias("n"), F.array_distinct("sh").alias("tsh"), F.array_distinct(F.array(*least)).alias("minima"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document and licence found: doc_id, license_id, containment, start.

    containment is the largest share of the template's shingles in one window;
    start is the first word of the first window that holds it. Null and empty texts
    have no row; null doc_ids count as one document, and so do rows that repeat a doc_id. Of equal
    containments the first window's start is given. Other columns are ignored, whatever their
    names. An empty table gives no rows. The library is part of the call, a few
    hundred templates at most, so it is broadcast; documents are not shuffled before they match.
    """
    library = templates(docs.sparkSession, texts)
    held = library.select("n", "minima").collect()  # the library's size is the caller's; at most BANDS values a template
    if not held:
        return docs.sparkSession.createDataFrame([], "doc_id long, license_id string, containment double, start long")
    among = {n: ", ".join(f"bigint('{h}')" for h in sorted({h for row in held if row["n"] == n for h in row["minima"]})) for n in sorted({row["n"] for row in held})}
    short = {-n: among[n] for n in among if n < 0}
    own = _with_shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), list(short))
    for length, hashes in short.items():  # the first place of each sequence is enough
        places = f"filter(transform(sh{length}, (h, i) -> struct(h, i)), x -> x.h in ({hashes}))"
        first = f"transform(array_distinct({places}.h), h -> struct({-length} as n, greatest(array_position(sh{length}, h) - 2, 0) as start, array(h) as win))"
        own = own.withColumn(f"sh{length}", F.expr(f"if(exists(sh{length}, h -> h in ({hashes})), {first}, null)"))
    long = {n: among[n] for n in among if n > 0}
    every = ", ".join(long.values()) or "null"
    own = own.where(" or ".join([f"exists(sh, h -> h in ({every}))", *(f"sh{x} is not null" for x in short)]))
    own = own.withColumn("hits", F.expr(f"filter(sequence(0, greatest(size(sh) - 1, 0)), i -> get(sh, i) in ({every}))"))
    # Windows with a template's band minimum, cut before rows multiply, so that no row repeats a whole text.
    cuts = [
        f"transform(filter(array_distinct(flatten(transform(filter(hits, p -> sh[p] in ({hashes})), p -> array(p div {n} * {n}, p div {n} * {n} - {n})))), s -> s >= 0), s -> struct({n} as n, s as start, slice(sh, cast(s as int) + 1, 2 * {n}) as win))"
        for n, hashes in long.items()
    ]
    cuts += [f"coalesce(sh{x}, array())" for x in short]
    windows = own.select("doc_id", F.explode(F.expr(f"flatten(array({', '.join(cuts)}))")).alias("x")).select("doc_id", "x.n", "x.start", "x.win")
    signed = windows.select("doc_id", "n", "start", "win", F.posexplode(_bands(F.col("win"))).alias("band", "value"))
    targets = library.select("license_id", F.col("n").alias("tn"), "tsh", F.posexplode(_bands(F.col("tsh"))).alias("tband", "tvalue"))
    hits = signed.join(F.broadcast(targets), (F.col("n") == F.col("tn")) & (F.col("band") == F.col("tband")) & (F.col("value") == F.col("tvalue")))
    share = F.size(F.array_intersect("win", "tsh")) / F.size("tsh")
    found = hits.select("doc_id", "license_id", "start", share.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "license_id", F.round("b.containment", 6).alias("containment"), (-F.col("b.back")).cast("long").alias("start"))


def miss_probability(containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    """The chance that a window holding that share of its template collides in no band."""
    return math.pow(1 - containment / (3 - containment), bands)
