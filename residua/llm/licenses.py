"""Licence scans by sentence rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import read, without

#: Normalised sentences of public licence texts and notices, with an identifier for each.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache_notice",
    "licensed under the apache license version 2 0 the license": "apache_header",
    "you may not use this file except in compliance with the license": "apache_compliance",
    "you may obtain a copy of the license at": "apache_copy_at",
    "distributed under the apache license version 2 0": "apache_notice",
    "spdx license identifier apache 2 0": "spdx_apache",
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "this project is licensed under the mit license": "mit_notice",
    "distributed under the mit license": "mit_notice",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_condition",
    "spdx license identifier mit": "spdx_mit",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 3": "gpl3_notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_details",
    "spdx license identifier gpl 3 0 or later": "spdx_gpl3",
    "spdx license identifier gpl 3 0 only": "spdx_gpl3",
    "licensed under cc by nc 4 0": "cc_by_nc_notice",
    "this work is licensed under cc by nc 4 0": "cc_by_nc_notice",
    "licensed under cc by 4 0": "cc_by_notice",
    "this work is licensed under cc by 4 0": "cc_by_notice",
    "licensed under cc by sa 4 0": "cc_by_sa_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advertising",
    "spdx license identifier bsd 2 clause": "spdx_bsd2",
    "spdx license identifier bsd 3 clause": "spdx_bsd3",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_notice",
    "spdx license identifier mpl 2 0": "spdx_mpl2",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl_warranty",
    "see the gnu lesser general public license for more details": "lgpl_details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_grant",
    "see the gnu affero general public license for more details": "agpl_details",
    "spdx license identifier gpl 2 0 only": "spdx_gpl2",
    "spdx license identifier gpl 2 0 or later": "spdx_gpl2",
    "spdx license identifier lgpl 2 1 or later": "spdx_lgpl21",
    "spdx license identifier agpl 3 0 or later": "spdx_agpl3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "spdx license identifier isc": "spdx_isc",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "distributed under the boost software license version 1 0": "boost_notice",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_notice",
    "spdx license identifier epl 2 0": "spdx_epl2",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under the cc0 1 0 license": "cc0_notice",
    "licensed under cc0 1 0": "cc0_notice",
    "spdx license identifier cc0 1 0": "spdx_cc0",
    "spdx license identifier unlicense": "spdx_unlicense",
    "all rights reserved": "all_rights_reserved",
}
#: Licence, then sentence identifiers that occur in this order, perhaps with others between. The longest rule goes first, equally long
#: ones in this order; a rule that matches uses its sentences up.
RULES = (
    ("Apache-2.0", ("apache_header", "apache_compliance", "apache_copy_at", "apache_warranty", "apache_see")),
    ("Apache-2.0", ("apache_header", "apache_compliance", "apache_copy_at")),
    ("Apache-2.0", ("apache_header",)),
    ("Apache-2.0", ("apache_notice",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("mit_title", "mit_grant", "mit_condition")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_title", "mit_grant")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("spdx_mit",)),
    ("GPL-3.0", ("gpl3_grant", "gpl_warranty", "gpl_details")),
    ("GPL-3.0", ("gpl3_grant",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-2.0", ("gpl2_grant", "gpl_warranty", "gpl_details")),
    ("GPL-2.0", ("gpl2_grant",)),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("LGPL-2.1", ("lgpl21_grant", "lgpl_warranty", "lgpl_details")),
    ("LGPL-2.1", ("lgpl21_grant",)),
    ("LGPL-2.1", ("spdx_lgpl21",)),
    ("LGPL-3.0", ("lgpl3_grant", "lgpl_warranty", "lgpl_details")),
    ("LGPL-3.0", ("lgpl3_grant",)),
    ("AGPL-3.0", ("agpl3_grant", "gpl_warranty", "agpl_details")),
    ("AGPL-3.0", ("agpl3_grant",)),
    ("AGPL-3.0", ("spdx_agpl3",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("CC0-1.0", ("spdx_cc0",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source")),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("spdx_isc",)),
    ("0BSD", ("bsd0_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_notice",)),
    ("Zlib", ("zlib_grant",)),
    ("Unlicense", ("unlicense_grant",)),
    ("Unlicense", ("spdx_unlicense",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-2.0", ("spdx_epl2",)),
)
#: What a document without any of these licences but with this sentence has.
RESERVED = ("Proprietary", "all_rights_reserved")
#: Each known sentence has one of these in it; texts without any aren't cut into sentences.
KEYS = ("licen", "permission", "redistribution", "warranty", "all rights", "unencumbered", "advertising materials", "neither the name")
#: Replaced in turn, in lower case: comment marks and letters or numbers of lists at the start of a line, then what ends a sentence (|: . ! ? before white space or the end, and a line
#: without letters or digits), then what may end or go on within one (a line feed: line breaks and , ; :), then spaces about them.
STEPS = (
    (r"(?m)^[^a-z0-9\n.!?]{0,40}(?:(?:rem|dnl)(?=\s|$)[^a-z0-9\n.!?]{0,40})?(?:[0-9a-z]\)(?=\s))?", " "),
    (r"[^a-z0-9\n.!?,;:]+", " "),
    (r"(?<![.!?])[.!?]++(?:\s+|$)", "|"),
    (r"[.!?]+", " "),
    (r"\n[ ,;:]*+(?=\n)", "|"),
    (r" +", " "),
    (r"[\n,;:][ \n,;:]*", "\n"),
    (r" \n", "\n"),
    (r"[ \n]?\|[ \n|]*", "|"),
    (r"^[ \n]+|[ \n]+$", ""),
)
#: A known sentence, perhaps over several lines, from where one may begin to where one may end; the longest first.
KNOWN = r"(?<![^|\n])(?:" + "|".join(x.replace(" ", r"[ \n]") for x in sorted(SENTENCES, key=len, reverse=True)) + r")(?![^|\n])"


def in_turn() -> list[tuple[str, str, int]]:
    """(licence, pattern, gaps) of each rule, longest first. A line of identifiers is each of them between commas of its own."""
    between = "((?:,[^,]+,)*?)"
    return [(name, between.join(f",{x}," for x in ids), len(ids) - 1) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]


def scan(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with n_license_sentences, sentence_ids (comma-joined, in text order) and licenses (comma-joined, in the order of their rules).

    Sentences end at . ! ? and at blank lines; line breaks within them, with comment marks, are joined. A known sentence may also begin
    or end at a line break or at , ; : so that one-line notices and headings are found. Case, and each run outside a-z 0-9, don't count.
    Identifiers in text order are matched against the rules, longest first, each using up what it matches; a reservation of all rights counts
    where there is no licence. It is one projection: no shuffle, no join, whatever a document's length.
    Columns of those names are replaced. Null or empty text: 0 and empty strings. Repeated rows: a row each. Empty table: empty result.
    """
    clean = F.lower(F.coalesce(text, F.lit("")))
    some = clean.rlike("|".join(KEYS))
    for old, new in STEPS:
        clean = F.regexp_replace(clean, old, new)
    known = F.when(some, F.transform(F.regexp_extract_all(clean, F.lit(KNOWN), F.lit(0)), lambda s: F.translate(s, "\n", " "))).otherwise(F.array().cast("array<string>"))
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    t = without(docs, ["n_license_sentences", "sentence_ids", "licenses", "_ids", "_found"]).withColumn("_ids", F.transform(known, lambda s: F.element_at(table, s)))
    t = t.withColumn("n_license_sentences", F.size("_ids").cast("long")).withColumn("sentence_ids", F.array_join("_ids", ","))
    line = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(old).alias("old"), F.lit("".join(f"${k + 1}" for k in range(gaps))).alias("new")) for name, old, gaps in in_turn()])

    def step(acc: Column, rule: Column) -> Column:
        left = F.regexp_replace(acc["left"], rule["old"], rule["new"])
        return F.struct(left.alias("left"), F.when(left != acc["left"], F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"))

    found = F.array_distinct(F.aggregate(rules, F.struct(line.alias("left"), F.array().cast("array<string>").alias("found")), step)["found"])
    t = t.withColumn("_found", F.when(F.size("_ids") > 0, found).otherwise(F.array().cast("array<string>")))
    reserved = F.when((F.size("_found") == 0) & F.array_contains("_ids", RESERVED[1]), F.lit(RESERVED[0]))
    return t.withColumn("licenses", F.coalesce(reserved, F.array_join("_found", ","))).drop("_ids", "_found")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_license_sentences, sentence_ids, licenses of all documents.

    Null or empty text: 0 and empty strings. Repeated rows: a row each. Empty table: empty result. Other columns don't matter.
    """
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "n_license_sentences", "sentence_ids", "licenses")


def _sql() -> str:
    case = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    known = ", ".join(f"'{s}'" for s in SENTENCES)
    turns = in_turn()
    steps, hits = "", []
    for k, (name, old, gaps) in enumerate(turns):
        new = "".join(f"\\{j + 1}" for j in range(gaps))
        steps += f"r{k + 1} AS (SELECT *, regexp_replace(line{k}, '{old}', '{new}', 'g') AS line{k + 1} FROM r{k}),\n"
        hits.append(f"CASE WHEN line{k + 1} <> line{k} THEN '{name}' END")
    return f"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '[.!?]+\\s+|\\n+|[.!?]+$') AS parts FROM documents),
e AS (SELECT r, doc_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x IN ({known})) AS k FROM s),
i AS (SELECT doc_id, list_transform(k, lambda x: CASE x {case} END) AS ids FROM e),
r0 AS (SELECT doc_id, ids, len(ids)::BIGINT AS n_license_sentences, array_to_string(ids, ',') AS sentence_ids, ',' || array_to_string(ids, ',,') || ',' AS line0 FROM i),
{steps}f AS (SELECT *, list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL) AS f FROM r{len(turns)}),
g AS (SELECT *, list_filter(f, lambda x, j: list_position(f, x) = j) AS found FROM f)
SELECT doc_id, n_license_sentences, sentence_ids, CASE WHEN len(found) = 0 AND list_contains(ids, '{RESERVED[1]}') THEN '{RESERVED[0]}' ELSE array_to_string(found, ',') END AS licenses FROM g
"""


OP9_SQL = _sql()
