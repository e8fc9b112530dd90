"""License tags and license texts of files, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_license_path(path: Column) -> Column:
    """Whether a segment of the path is named like a license file."""
    return F.lower(path).rlike(r"(?:^|/)(?:(?:license|licence|copying|notice|copyright|unlicense|eula)(?:\.[^/]*)?|[^/]*\.license)(?:/|$)")


def spdx_tags(text: Column) -> Column:
    """Distinct expressions of the SPDX tags in a text, up to 128 characters long."""
    found = F.regexp_extract_all(text, F.lit(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9 .+():_\-]+)"), 1)
    trimmed = F.transform(found, lambda e: F.rtrim(e))
    return F.array_distinct(F.filter(trimmed, lambda e: (e != "") & (F.length(e) <= 128)))


def text_markers(text: Column) -> Column:
    """License ids told by marker sentences of a license text."""
    has = lambda *m: F.coalesce(_any([text.contains(x) for x in m]), F.lit(False))
    affero, lesser = has("GNU AFFERO GENERAL PUBLIC LICENSE", "GNU Affero"), has("GNU LESSER GENERAL PUBLIC LICENSE", "Lesser General Public")
    library, ncsa = has("GNU LIBRARY GENERAL PUBLIC LICENSE"), has("University of Illinois") & has("NCSA")
    alike, four = has("ShareAlike", "Share Alike"), has("4.0")
    bsd = ~ncsa & has("Redistribution and use in source and binary forms")
    clauses = F.when(has("All advertising materials mentioning"), "BSD-4-Clause").when(has("Neither the name"), "BSD-3-Clause").otherwise("BSD-2-Clause")
    # Markers of each license.
    ids = [
        F.when(has("Version 3, 29 June 2007"), F.when(affero, "AGPL-3.0").when(lesser, "LGPL-3.0").otherwise("GPL-3.0")),
        F.when(has("Version 2.1, February 1999"), "LGPL-2.1"),
        F.when(has("Version 2, June 1991"), F.when(library, "LGPL-2.0").when(~lesser, "GPL-2.0")),
        F.when(has("Version 1, February 1989"), "GPL-1.0"),
        F.when(has("Apache License") & has("Version 2.0"), "Apache-2.0"),
        F.when(has("Mozilla Public License Version 2.0"), "MPL-2.0"),
        F.when(has("Mozilla Public License Version 1.1", "Mozilla Public License, version 1.1"), "MPL-1.1"),
        F.when(has("Eclipse Public License"), F.when(has("v 2.0", "v. 2.0", "Version 2.0"), "EPL-2.0").otherwise("EPL-1.0")),
        F.when(has("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE"), "CDDL-1.0"),
        F.when(has("Artistic License"), F.when(has("Version 2"), "Artistic-2.0").otherwise("Artistic-1.0")),
        F.when(has("PYTHON SOFTWARE FOUNDATION LICENSE"), "Python-2.0"),
        F.when(has("OpenSSL License", "Original SSLeay License"), "OpenSSL"),
        F.when(has("Boost Software License"), "BSL-1.0"),
        F.when(has("SIL Open Font License", "SIL OPEN FONT LICENSE"), "OFL-1.1"),
        F.when(has("PNG Reference Library", "libpng license", "This code is released under the libpng"), "Libpng"),
        F.when(has("Sleepycat"), "Sleepycat"),
        F.when(has("X Consortium"), "X11"),
        F.when(has("Creative Commons Attribution"), F.concat(F.when(alike, "CC-BY-SA-").otherwise("CC-BY-"), F.when(four, "4.0").otherwise("3.0"))),
        F.when(ncsa, "NCSA"),
        F.when(has("COPYRIGHT AND PERMISSION NOTICE") & has("curl"), "curl"),
        F.when(has("Permission is hereby granted, free of charge"), "MIT"),
        F.when(has("Permission to use, copy, modify, and/or distribute this software"), "ISC"),
        F.when(bsd, clauses),
        F.when(has("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"), "PostgreSQL"),
        F.when(has("altered source versions must be plainly marked"), "Zlib"),
        F.when(has("This is free and unencumbered software released into the public domain"), "Unlicense"),
        F.when(has("DO WHAT THE F"), "WTFPL"),
        F.when(has("CC0 1.0 Universal"), "CC0-1.0"),
    ]
    return F.array_compact(F.array(*ids))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def file_licenses(files: DataFrame) -> DataFrame:
    """(path, license, confidence): tags of any file (95), markers of files on a license path (80).

    Each license stands once per path, the tag before the marker; markers are sought in the whole
    content, as by ``license_docs``. Null content gives none.
    """
    tags = files.select("path", F.explode(spdx_tags(F.col("content"))).alias("license"), F.lit(95).alias("confidence"))
    texts = files.where(is_license_path(F.col("path"))).select("path", F.explode(text_markers(F.col("content"))).alias("license"), F.lit(80).alias("confidence"))
    return tags.unionByName(texts).groupBy("path", "license").agg(F.max("confidence").alias("confidence"))


def license_summary(licenses: DataFrame) -> DataFrame:
    """(license, n, confidence, first_path) of each license, the most frequent first."""
    ranked = licenses.groupBy("license").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("path").alias("first_path"))
    return ranked.orderBy(F.desc("n"), "license")


def license_paths(licenses: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` paths of each license in order, with how many there are in all.

    Ranks are counted within 64 parts of each license before they are merged, so one license may hold any
    share of the rows.
    """
    part = Window.partitionBy("license", F.pmod(F.xxhash64("path"), F.lit(64)))
    first = licenses.withColumn("k", F.row_number().over(part.orderBy("path"))).where(F.col("k") <= most)
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("license").orderBy("path"))).where(F.col("k") <= most)
    totals = licenses.groupBy("license").agg(F.count("*").alias("n"))
    return top.join(totals, "license").select("license", "path", "k", "n")
