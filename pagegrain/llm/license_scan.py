"""Licence scan by canonical digests.

Known texts and the scanned ones pass the same normal form: A-Z lower-cased, copyright lines
dropped, everything but digits, letters a-z and non-ASCII characters turned into one space, and
equivalent spellings unified.  The SHA-256 of the normal form of an *entire* text is hash-joined
to the digests of known licences.  Units are the whole document and each of its lines (a licence
notice is commonly a line of its own), never a part of a line.

One equi-join does both: each text gives its own digest and those of its lines, and what meets a known digest is
added up by the text (its MD5, with a row for each place of a hit, so copies of a text count once) and joined back.
A row of the result is found again by its text's MD5; that join shuffles the columns asked for unless the hits
are few enough to be broadcast at run time.  The table of known licences is a parameter of any size: while it has at most
``MAX_BROADCAST_ROWS`` texts it is broadcast, beyond that the join shuffles.

Edge cases: null and empty texts, and such with nothing left, match nothing.  Repeated rows are
judged one by one.  Digests of two licences that are equal after normalisation: the smallest name wins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts, workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_ROWS = 10_000
#: Equivalent spellings, applied in this order to the normal form; words there stand between two blanks.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("merchantibility", "merchantability"), ("whilst", "while"), ("http", "https"))
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "BSD": ["Released under the BSD License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
for _name, _texts in license_texts.variants().items():
    KNOWN[_name] = [*KNOWN.get(_name, []), *_texts]
KNOWN["MIT"] += [f"{head}\n{KNOWN['MIT'][1]}" for head in ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)")]
KNOWN["ISC"] += [f"{head}\n{KNOWN['ISC'][0]}" for head in ("ISC License", "The ISC License", "ISC License (ISC)")]


def _canonical_line(line: Column) -> Column:
    low = F.translate(line, UPPER, LOWER)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^0-9a-z\x{80}-\x{10FFFF}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    spaced = F.replace(F.trim(out), F.lit("  "), F.lit(" "))
    return F.when(low.rlike(r"^[^0-9a-z\x{80}-\x{10FFFF}(]*(copyright[^0-9a-z]|\(c\)|\x{A9})"), F.lit("")).otherwise(spaced)


def canonical_lines(text: Column) -> Column:
    """Normal forms of the \\n-split lines; empty for copyright lines."""
    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), _canonical_line)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known: Mapping[str, list[str]] = KNOWN) -> DataFrame:
    """(digest, license) of every known text."""
    df = spark.createDataFrame([(name, t) for name, texts in known.items() for t in texts], "license string, text string")
    df = df.withColumn("digest", F.sha2(_whole(canonical_lines(F.col("text"))), 256))
    return df.groupBy("digest").agg(F.min("license").alias("license"))


def hits(docs: DataFrame, known: DataFrame, *, text: str, broadcast: bool) -> DataFrame:
    """(__key, license, n_license_lines, line_licenses) of the texts that have any; __key: MD5 of the text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = docs.select(F.md5(body).alias("__key"), canonical_lines(body).alias("lines"))
    digests = F.concat(F.array(F.sha2(_whole(F.col("lines")), 256)), F.transform("lines", lambda x: F.when(x != "", F.sha2(x, 256))))
    units = lines.select("__key", F.posexplode(digests).alias("place", "digest")).where("digest is not null")
    found = units.join(F.broadcast(known) if broadcast else known, "digest").groupBy("__key", "place").agg(F.min("license").alias("license"))
    names, line = F.col("license"), F.col("place") > 0
    return found.groupBy("__key").agg(F.min(F.when(~line, names)).alias("license"), F.count(F.when(line, names)).alias("n_license_lines"), F.array_sort(F.collect_set(F.when(line, names))).alias("line_licenses"))


def scan(docs: DataFrame, known: Mapping[str, list[str]] = KNOWN, *, text: str = "text") -> DataFrame:
    """``docs`` with license (of the entire text, or null), n_license_lines and line_licenses (sorted names)."""
    own = {"license", "n_license_lines", "line_licenses"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    found = hits(docs, known_digests(docs.sparkSession, known), text=text, broadcast=sum(map(len, known.values())) <= MAX_BROADCAST_ROWS)
    keyed = docs.select(*kept, F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__key"))
    none = F.array().cast("array<string>")
    return keyed.join(found, "__key", "left").select(*kept, "license", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("line_licenses", none).alias("line_licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document, as a whole and line by line."""
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", "n_license_lines", F.array_join("line_licenses", ",").alias("line_licenses"))


def oracle_sql() -> str:
    """Words are mapped one by one through a table of spellings, instead of replaced in the text."""
    final = dict(SPELLINGS)
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in final.items())
    low = f"translate(x, '{UPPER}', '{LOWER}')"
    words = rf"list_filter(string_split(regexp_replace({low}, '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    mine = rf"regexp_matches({low}, '^[^0-9a-z\x{{80}}-\x{{10FFFF}}(]*(copyright[^0-9a-z]|\(c\)|\x{{A9}})')"
    line = f"CASE WHEN {mine} THEN '' ELSE array_to_string(list_transform({words}, lambda w: coalesce(MAP {{{pairs}}}[w], w)), ' ') END"
    found = f"list_filter(list_transform(string_split(coalesce(t, ''), chr(10)), lambda x: {line}), lambda x: x <> '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(t)})" for name, texts in KNOWN.items() for t in texts)
    return f"""
WITH k AS (SELECT name, {found} AS lines FROM (VALUES {values}) AS v(name, t)),
known AS (SELECT array_to_string(lines, ' ') AS body, min(name) AS license FROM k GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {found} AS lines FROM (SELECT doc_id, text AS t FROM documents)),
u AS (SELECT rid, known.license FROM (SELECT rid, unnest(lines) AS line FROM d) JOIN known ON line = known.body),
g AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM u GROUP BY rid)
SELECT doc_id, known.license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM d LEFT JOIN known ON array_to_string(lines, ' ') = known.body LEFT JOIN g USING (rid)
"""
