"""License scans: TF-IDF cosines of header units and license files to templates, and inheritance from the nearest directory.

Header units are blocks of neighbouring lines that name licensing, and the lines and sentences in them that do; files called
LICENSE, COPYING and the like also count as a whole. Copyright statements are left out, as names of holders say nothing about the
license. Term weights use document frequencies of all terms over all files. Each distinct unit is scored once. A license file's
finding holds for its directory and all below; a file without a header takes that of the nearest directory above it. DataFrame
functions only; directories, not files, are joined to their ancestors.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

# Templates by SPDX identifier: notices as their licenses recommend them, openings of license files, common phrases.
GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
LIBRARY = GNU.replace("this program", "this library")
NO_WARRANTY = "is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("AGPL-3.0", GNU.format("affero general public license", "3")),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("BSD-2-Clause", BSD),
    ("BSD-2-Clause", "bsd 2 clause license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted neither the name of the copyright holder"),
    ("BSD-3-Clause", BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "bsd 3 clause license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "licensed under cc0 1.0 universal public domain dedication"),
    ("CC0-1.0", "cc0 1.0 universal"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-2.0", GNU.format("general public license", "2")),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", GNU.format("general public license", "3")),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "isc license"),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1"),
    ("LGPL-2.1", LIBRARY.format("lesser general public license", "2.1")),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("LGPL-3.0", GNU.format("lesser general public license", "3")),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "the mit license mit"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software " + NO_WARRANTY),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Lines that can be headers; statements of holders; names of license files; least cosine of a finding.
ANCHOR = r"(?i)licen[sc]|copyright|spdx|public domain|redistribut|permission (is|to)|free software"
HOLDER = r"(?i)(copyright[ \t]*(\(c\)|©)?[ \t]*(©|[0-9]{4})|\(c\)[ \t]*(copyright[ \t]*)?[0-9]{4}|copyright[ \t]*\(c\))[^\n.]*\.?"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([._-][^/]*)?$"
SIMILAR = 0.6
#: What lies between terms, with full stops that end a term or stand before it; what lies between blocks and sentences.
BETWEEN, BLANK, STOP = r"\.*[^a-z0-9.]+\.*", r"\n[^\p{L}\p{N}]*\n", r"([.;!?]) "


def templates() -> list[tuple[str, str]]:
    """The texts above, and a tag line for each identifier, those of GNU licenses with their two endings too."""
    names = sorted({name for name, _ in TEMPLATES})
    tags = [(n, n + end) for n in names for end in ("", "-only", "-or-later") if not end or "GPL" in n]
    return [*TEMPLATES, *((n, "spdx license identifier " + " ".join(re.split(r"[^a-z0-9.]+", tag.lower()))) for n, tag in tags)]


def _terms(text: Column) -> Column:
    """Lower-case terms without full stops at their ends."""
    return F.filter(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), BETWEEN), lambda w: w != "")


def _units(text: Column, is_file: Column) -> Column:
    """Header units of a text, without statements of holders; of a license file also all of it."""
    named = lambda parts: F.filter(parts, lambda x: x.rlike(ANCHOR))
    own = F.regexp_replace(text, HOLDER, "")
    blocks = named(F.split(own, BLANK))
    lines = named(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))))
    sentences = named(F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, STOP, "$1\n"), "\n"))))
    return F.array_distinct(F.concat(blocks, lines, sentences, F.when(is_file, F.array(own)).otherwise(F.array().cast("array<string>"))))


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "key") -> DataFrame:
    """(key, path, own_license, own_score, license, inherited_from) for each row of files; other columns are left out.

    license is the row's own finding, or else that of the nearest directory with a license file (inherited_from: its path, ''
    for the root), or null. Null texts and paths find nothing and inherit nothing; ties go to the first identifier; repeated
    rows stay, and rows of one key and path with other texts have findings of their own; an empty table gives no rows.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    known = templates()
    n = rows.count()
    idf = F.ln(F.lit(float(n + 1)) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
    models = spark.createDataFrame([(i, name, t, float(c)) for i, (name, s) in enumerate(known) for t, c in Counter(s.split()).items()], "template int, name string, term string, tf double")
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    # Each unit is a row with the place of its file; distinct units are counted and scored once.
    whose = ("key", "path", "th")
    found = rows.where(F.col("text").rlike(ANCHOR) | is_file).select("key", "path", F.xxhash64("text").alias("th"), F.explode(_units(F.col("text"), is_file)).alias("unit"))
    placed = written(found.select(*whose, F.xxhash64("unit").alias("h"), "unit"))
    distinct = placed.select("h", "unit").distinct()
    counted = written(distinct.select("h", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("h", "term").agg(F.count("*").cast("double").alias("tf")))
    # Files that each term of a unit or a template stands in, of all files.
    wanted = counted.select("term").union(models.select("term")).distinct()
    files_with = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    frequencies = written(files_with.join(wanted, "term", "left_semi"))
    weighted = models.join(frequencies, "term", "left").withColumn("w", F.col("tf") * idf)
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit_vectors = F.broadcast(weighted.join(norms, "template").select("template", "name", "term", (F.col("w") / F.col("norm")).alias("u")))  # a few thousand rows: the templates'
    vectors = counted.join(frequencies, "term", "left").withColumn("w", F.col("tf") * idf)
    size = vectors.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = vectors.join(unit_vectors, "term").groupBy("h", "template", "name").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(size, "h").withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).where(F.col("score") >= SIMILAR)
    best = scored.groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("neg"), "name")).alias("best"))
    own = written(placed.select(*whose, "h").join(best, "h").groupBy(*whose).agg(F.min("best").alias("best")).select(*whose, F.col("best.name").alias("own_license"), (-F.col("best.neg")).alias("own_score")))
    directory = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    declared = own.where(F.col("path").rlike(LICENSE_FILE)).groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("neg"), "own_license")).alias("d")).select("dir", F.col("d.own_license").alias("dir_license"))
    # Ancestors of each distinct directory, deepest first; the nearest that declares a license is the longest.
    below = rows.where("path is not null").select(directory(F.col("path")).alias("at")).distinct()
    steps = F.expr("transform(sequence(0, size(split(at, '/'))), i -> array_join(slice(split(at, '/'), 1, i), '/'))")
    up = below.select("at", F.explode(F.array_distinct(F.concat(steps, F.array(F.lit(""))))).alias("dir"))
    nearest = up.join(declared, "dir").groupBy("at").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license")).alias("x")).select("at", F.col("x.dir").alias("from"), F.col("x.dir_license").alias("dir_license"))
    slim = rows.select("key", "path", F.xxhash64("text").alias("th"))
    theirs = own.select(*(F.col(c).alias(f"own_{c}") for c in whose), "own_license", "own_score")
    same = F.col("key").eqNullSafe(F.col("own_key")) & F.col("path").eqNullSafe(F.col("own_path")) & (F.col("th") == F.col("own_th"))
    out = slim.join(theirs, same, "left").withColumn("at", directory(F.col("path"))).join(nearest, "at", "left")
    inherits = F.col("own_license").isNull()
    return out.select("key", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(inherits, F.col("from")).alias("inherited_from"))
