"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (lower case, equivalent spellings, no copyright lines, no punctuation, single
spaces) and hashed; the digest is joined to those of known licences. Both a whole text and each of its
paragraph lines count as an entire text, so that a licence notice inside a longer document is found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_room, table

# Licence notices in general use, each with its SPDX name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Released under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
# Whole licence texts in general use.
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
)
# Digests of the canonical forms of whole standard texts, with and without the appendix on how to apply them, and with the usual list marks.
DIGESTS = (
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Apache-2.0", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("GPL-2.0-only", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0-only", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0-only", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("GPL-3.0-only", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("BSD-2-Clause", "9e8e685a22885928da8466dad47189c1cc34d405eeac0f64542df1757d1c78ae"),
    ("BSD-2-Clause", "f3bbacbd62c8a914736791598ebd063abd69fbde8171fd06341b5ceb6671c7c6"),
    ("BSD-3-Clause", "80e928d346053a16374bd8965df8b724bde7813286c7acf4e9c041e405fcddc8"),
    ("BSD-3-Clause", "3d44d567fe62733cb1cbee6bd753f72560d3e9db0900d03fe8c0eb8fe50ef1af"),
    ("BSD-3-Clause", "ab899150d08a3ccf837f742a20fbd8dd108031100312f3224aa5e2d14e0d60f1"),
    ("BSD-3-Clause", "89f1f757b2876f2bf5151cdafc4c5a51c7efed4105bca6756a2c7d06aa519016"),
)
# Spellings that count as one, in lower case and without punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("wilful", "willful"),
    ("favour", "favor"),
    ("v", "version"),
    ("https", "http"),
)
#: A line of copyright, with the "all rights reserved" that ends or follows it: the word before a sign, a year or a holder's name, or
#: the sign alone. Lines of a licence's own text that happen to begin with the word go on with one of the words left out here.
COPYRIGHT = (
    r"(?m)^[^\S\n]*+(?:(?:portions )?copyright:?[^\S\n]+(?:\(c\)|©|[0-9]|(?:by|the)\b[^\n]*\b(?:19|20)[0-9]{2}\b"
    r"|(?!(?:holders?|owners?|ownership|notices?|licen[cs]\w*|laws?|interests?|statements?|treat(?:y|ies)|protection|permission|disclaimers?|rights?|status|material|works?"
    r"|and|or|on|in|of|to|is|as|are|for|with|under|that|by|the|this|doctrines?|infringement|resulting)\b)\w)|\(c\)|©)[^\n]*+(?:\n\s*+all rights reserved\.?[^\S\n]*+$)?"
)
#: The usual titles of short licences, whose standard text has none.
TITLE = r"\A[\s#=*]*+(?:the )?(?:mit|isc|expat|0bsd|bsd|(?:new|simplified|modified|revised) bsd|zero-clause bsd|bsd zero[- ]clause|bsd [23]-clause|[23]-clause bsd)(?: \"(?:simplified|new)\"(?: or \"revised\")?)?(?: licen[cs]e)?(?: \((?:mit|isc|0bsd|bsd-[23]-clause)\))?[\s:=*-]*?(?:\n|\z)"


def canonical(text: Column) -> Column:
    """The canonical form of a text: the same for texts that differ only where licences may."""
    t = F.lower(text)
    # a copyright line names holders and years, or is the sign alone; the words of a licence itself stay
    holds = text.rlike(r"(?i)copyright|\(c\)|©")
    t = F.when(holds, F.regexp_replace(t, COPYRIGHT, "")).otherwise(t)
    t = F.regexp_replace(t, TITLE, "")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[!-/:-@\[-`{-~‘’“”«»–—…\s]++", " ")
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def known(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the notices and texts above: a fixed, small table."""
    raw = spark.createDataFrame([*NOTICES, *TEXTS], "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return raw.union(spark.createDataFrame(DIGESTS, "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", licenses: DataFrame | None = None) -> DataFrame:
    """``docs`` with license_id (of the whole text, or null), notices (names of lines, by code point) and n_notices.

    ``licenses`` has one row per digest (license_id, digest); the built-in table is broadcast, being fixed and under
    100 rows, any other is left to the planner. Null and empty texts match nothing; ties between names of
    one digest go to the smallest name. Repeated rows get equal results. Lines of 12 to 20,000 characters need no
    special case: every line of every text is looked up. Columns already named like a result get an underscore. Names that begin with ``__qs_`` are the operator's own.
    """
    docs = make_room(docs, "license_id", "notices", "n_notices", "digest")
    table_ = F.broadcast(known(docs.sparkSession)) if licenses is None else licenses
    lines = docs.select(F.col(key).alias("__qs_k"), F.xxhash64(text).alias("__qs_h"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("__qs_line"))
    # never null, so that the join adds no filter on it, which would work out the digest a second time
    digest = lambda c: F.coalesce(F.sha2(canonical(F.col(c)), 256), F.lit(""))
    hits = lines.where(F.trim("__qs_line") != "").withColumn("digest", digest("__qs_line")).join(table_, "digest")
    hits = hits.groupBy("__qs_k", "__qs_h").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    whole = docs.withColumn("digest", F.when(F.trim(text) != "", digest(text))).join(table_, "digest", "left").drop("digest")
    found = whole.withColumn("__qs_h", F.xxhash64(text)).alias("d").join(hits.withColumnRenamed("__qs_h", "__qs_h2"), F.col(key).eqNullSafe(F.col("__qs_k")) & (F.col("__qs_h") == F.col("__qs_h2")), "left").drop("__qs_k", "__qs_h", "__qs_h2")
    return found.withColumn("notices", F.coalesce("notices", F.array().cast("array<string>"))).withColumn("n_notices", F.size("notices").cast("long"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_id", F.array_join("notices", ",").alias("notices"), "n_notices")
