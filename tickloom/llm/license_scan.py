"""Licence recognition by sentences.

A text is cut into sentences and each is normalised.  Sentences that the catalogue knows
become identifiers, in text order.  Ordered rules then look for sequences of identifiers,
full texts before short notices.  Everything is computed inside a row with DataFrame
functions; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import let, table, text_of

# Identifier -> normalised sentence (lower case, runs of other characters than letters, digits and '+' as one space).
SENTENCES = {
    "AllRights": "all rights reserved",
    "ApacheLicensedUnder": "licensed under the apache license version 2 0",
    "ApacheLicensedUnderLong": "licensed under the apache license version 2 0 the license",
    "ApacheMayNotUse": "you may not use this file except in compliance with the license",
    "ApacheObtainCopy": "you may obtain a copy of the license at",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitReleased": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "MitTitle": "the mit license mit",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitCondition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "GplWork3": "this work is licensed under the gnu general public license version 3",
    "GplLicensed3": "licensed under the gnu general public license version 3",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplFree2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "CcByNc4": "licensed under cc by nc 4 0",
    "CcBy4": "licensed under cc by 4 0",
    "CcBySa4": "licensed under cc by sa 4 0",
    "CcByWork4": "this work is licensed under a creative commons attribution 4 0 international license",
    "CcBySaWork4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CcByNcWork4": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "BsdRedistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "MplSubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "PublicDomain": "this is free and unencumbered software released into the public domain",
}

# Fixed values, tried in this order: licence, identifiers that must appear in this order with any text between them; a match uses its identifiers up.
RULES = [
    ("MIT", ["MitGrant", "MitCondition", "MitAsIs"]),
    ("MIT", ["MitGrant", "MitCondition"]),
    ("BSD-3-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheLicensedUnderLong", "ApacheMayNotUse", "ApacheObtainCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheLicensedUnderLong", "ApacheMayNotUse"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplSee"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplHope", "GplSee"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("Apache-2.0", ["ApacheLicensedUnder"]),
    ("Apache-2.0", ["ApacheLicensedUnderLong"]),
    ("MIT", ["MitTitle"]),
    ("MIT", ["MitReleased"]),
    ("MIT", ["MitLicensed"]),
    ("GPL-3.0-only", ["GplWork3"]),
    ("GPL-3.0-only", ["GplLicensed3"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-NC-4.0", ["CcByNcWork4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-SA-4.0", ["CcBySaWork4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC-BY-4.0", ["CcByWork4"]),
    ("MPL-2.0", ["MplSubject"]),
    ("Unlicense", ["PublicDomain"]),
    ("All-Rights-Reserved", ["AllRights"]),
]


#: Blanks and a comment mark at the start of a line.
MARK = "^[ \t]*(?:(?:#+|//+|/?[*]+)[ \t]*)?"


def sentences(text: Column) -> Column:
    """Normalised sentences in text order; they end at a line end, or at . ! ? : ; before white space or the end.

    Wrapped sentences are joined in the second reading of ``sentence_ids``.
    """
    cut = F.split(F.regexp_replace(text, "[.!?:;]+(\\s|$)", "\n"), "\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}+]+", " ")))


def sentence_ids(text: Column, catalogue: dict[str, str]) -> Column:
    """Identifiers of the known sentences, in text order.

    Two readings are merged: line ends as sentence ends, and lines joined without their
    comment marks and ended by blank lines only (licence headers).  A sentence's place is the
    number of letters, digits and '+' before it, which both readings share, so what both find
    stands once.
    """
    known = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in catalogue.items()) for x in pair])
    none = F.array().cast("array<struct<start:long,end:long,id:string>>")

    def read(t: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            end = acc["at"] + F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("long")
            hit = F.struct(acc["at"].alias("start"), end.alias("end"), F.try_element_at(known, s).alias("id"))
            return F.struct(end.alias("at"), F.when(F.map_contains_key(known, s), F.array_append(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

        return F.aggregate(sentences(t), F.struct(F.lit(0).cast("long").alias("at"), none.alias("hits")), step, lambda acc: acc["hits"])

    def line(x: Column) -> Column:
        return let(F.regexp_replace(x, MARK, ""), lambda y: F.when(y == "", F.lit(".")).otherwise(y))

    wrapped = F.array_join(F.transform(F.split(text, "\n"), line), " ")
    return F.transform(F.array_sort(F.array_union(read(text), read(wrapped))), lambda x: x["id"])


def rule_pattern(sequence: list[str]) -> str:
    return "\\|" + "\\|(.*\\|)?".join(sequence) + "\\|"


def notice_pattern(sequence: list[str]) -> str:
    """One notice in a '|A|B|' string, each identifier at its nearest place; the groups hold what lies between."""
    return f"(?<=\\|){sequence[0]}\\|" + "".join(f"(?>((?:.*?\\|)??){i}\\|)" for i in sequence[1:])


def licences(ids: Column, rules) -> Column:
    """Licences that the rules find in an array of identifiers, in the order of their rules.

    A rule takes the identifiers of all its notices away before the next rule is tried.
    """
    table_of = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(notice_pattern(q)).alias("pattern"), F.lit("".join(f"${k}" for k in range(1, len(q)))).alias("between"),
                                  F.lit(len(q)).alias("n")) for name, q in rules])
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("found"))

    def take(acc: Column, rule: Column) -> Column:
        # Interleaved notices need a pass each; a pass takes all others.
        passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(ids) / rule["n"]).cast("int")))
        rest = F.aggregate(passes, acc["left"], lambda left, _: F.regexp_replace(left, rule["pattern"], rule["between"]))
        rest = F.when(rule["n"] == 1, F.regexp_replace(acc["left"], rule["pattern"], rule["between"])).otherwise(rest)
        return F.when(F.rlike(acc["left"], rule["pattern"]), F.struct(rest.alias("left"), F.array_append(acc["found"], rule["name"]).alias("found"))).otherwise(acc)

    return F.array_distinct(F.aggregate(table_of, start, take, lambda acc: acc["found"]))


def scan(docs: DataFrame, *keep: Column, catalogue=SENTENCES, rules=RULES) -> DataFrame:
    """``keep`` columns plus sentence_ids (comma-joined) and licences (comma-joined, strongest rule first).

    No known sentence: both empty.  A null text counts as empty.
    """
    rows = docs.select(*keep, sentence_ids(text_of(), catalogue).alias("ids"))
    return rows.select(*[c for c in rows.columns if c != "ids"], F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                       F.when(F.size("ids") > 0, F.array_join(licences(F.col("ids"), rules), ",")).otherwise(F.lit("")).alias("licences"))


def op6_sentence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    return scan(table(spark, folder, "documents"), F.col("doc_id"))


def license_sql(catalogue=SENTENCES, rules=RULES) -> str:
    keys = ", ".join(f"'{s}'" for s in catalogue.values())
    values = ", ".join(f"'{i}'" for i in catalogue)
    rule = ", ".join(f"CASE WHEN regexp_matches(joined, '{rule_pattern(q)}') THEN '{name}' END" for name, q in rules)

    def read(t: str) -> str:
        cut = f"string_split(regexp_replace({t}, '[.!?:;]+(\\s|$)', chr(10), 'g'), chr(10))"
        return (f"list_filter(list_transform({cut}, lambda s: MAP([{keys}], [{values}])[trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}+]+', ' ', 'g'))]), "
                "lambda i: i IS NOT NULL)")

    return f"""
WITH d AS (
 SELECT doc_id, coalesce(text, '') AS t,
        array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: coalesce(nullif(regexp_replace(l, '{MARK}', ''), ''), '.')), ' ') AS u
 FROM documents),
r AS (SELECT doc_id, {read("t")} AS a, {read("u")} AS b FROM d),
i AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM r),
j AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '|') || '|' ELSE '' END AS joined FROM i),
k AS (SELECT doc_id, ids, list_filter([{rule}], lambda x: x IS NOT NULL) AS found FROM j)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, n: list_position(found, x) = n), ','), '') AS licences
FROM k
"""
