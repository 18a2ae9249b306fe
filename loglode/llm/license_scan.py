"""Operator 10: licence scans by sentence rules.

Texts are cut into pieces at line ends and at punctuation before a blank; pieces are normalised (lower case, runs of
other characters than a-z and 0-9 as one space).  A run of whole neighbouring pieces that reads as a known licence
sentence becomes its identifier, the longest run first, so that wrapped lines, 'v. 2.0' and 'SPDX-License-Identifier: MIT'
are met as well as a sentence on a line of its own; a blank line ends a run.  The identifiers of a document, in order, are matched
against the ordered licence rules: a rule whose identifiers stand next to each other reports its licence and uses
them up, so that earlier (more specific) rules win.  Identifiers that no rule uses are reported as unknown.

Null and empty texts give no identifiers.  Every document has a row; rows that share a doc_id keep a row each.  A text
without any of the trigger words cannot hold a known sentence and is not cut; every known sentence has a trigger.
The SQL meets sentences of one piece only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifiers and normalised sentences of common licence notices.
SENTENCES = [
    ("apache-2-notice", "licensed under the apache license version 2 0"),
    ("apache-2-the-license", "licensed under the apache license version 2 0 the license"),
    ("apache-2-compliance", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at"),
    ("apache-2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-notice", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-condition", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is-software", "the software is provided as is without warranty of any kind express or implied"),
    ("gpl-3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2-notice", "this work is licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-notice", "this library is licensed under the gnu lesser general public license"),
    ("agpl-notice", "licensed under the gnu affero general public license version 3"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-nc-4-work", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4-work", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-4-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-no-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"),
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache-2", "spdx license identifier apache 2 0"),
    ("spdx-gpl-3", "spdx license identifier gpl 3 0 or later"),
    ("spdx-bsd-3", "spdx license identifier bsd 3 clause"),
    ("rights-reserved", "copyright all rights reserved"),
]

# The same sentences as the usual notices go on; not in the SQL.
LONGER = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is-software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache-2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
]

# Licences and the identifiers that show them, the most specific first.
RULES = [
    ("Apache-2.0", ["apache-2-the-license", "apache-2-compliance", "apache-2-copy", "apache-2-as-is"]),
    ("Apache-2.0", ["apache-2-the-license", "apache-2-compliance"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is-software"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-no-endorsement", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-2-the-license"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0", ["gpl-3-notice"]),
    ("GPL-2.0", ["gpl-2-notice"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("LGPL", ["lgpl-notice"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache-2"]),
    ("GPL-3.0-or-later", ["spdx-gpl-3"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
]

TRIGGERS = "licen[cs]e|permission|redistribut|as is|as-is|copyright|free software"
ENDS = "[.!?;:]+[ \\t]|[.!?;:]*\\r?\\n"
WRAPPED_TRIGGERS = "licen[cs]e|permission|redistribut|as[^a-z0-9]+is|copyright|free[^a-z0-9]+software"
PIECE_ENDS = "[.!?;:]+[ \\t]++(?:\\r?\\n)?|[.!?;:]*\\r?\\n"  # blanks and the line end after punctuation end one piece


def known_identifiers(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES + LONGER) -> DataFrame:
    """doc_id and ids, the identifiers of the document's known sentences in order."""
    table = F.create_map(*[F.lit(x) for name, sentence in sentences for x in (sentence, name)])
    any_of = "|".join(s.replace(" ", "[ \n]") for s in sorted((s for _, s in sentences), key=len, reverse=True))
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), PIECE_ENDS, "\n"), "[^a-z0-9\n]+", " ")
    plain = F.concat(F.lit("\n"), F.regexp_replace(plain, " ?\n ?", "\n"), F.lit("\n"))
    plain = F.regexp_replace(plain, "^\n | \n$", "\n")
    found = F.regexp_extract_all(plain, F.lit(f"\n({any_of})(?=\n)"), F.lit(1))
    names = F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    none = F.array().cast("array<string>")
    return docs.select("doc_id", F.when(F.coalesce("text", F.lit("")).rlike(f"(?i){WRAPPED_TRIGGERS}"), names).otherwise(none).alias("ids"))


def scan_licenses(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES + LONGER, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses (in rule order) and unknown_ids, joined by commas."""
    d = known_identifiers(docs, sentences)
    d = d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    # Identifiers stand as ';a;;b;' so that neighbours share no separator and a rule's text is theirs alone.
    left, found = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.concat(F.lit(";"), F.regexp_replace("sentence_ids", ",", ";;"), F.lit(";"))), []
    d = d.withColumn("rest0", left)
    for i, (name, ids) in enumerate(rules):
        text = "".join(f";{x};" for x in ids)
        found.append(F.when(F.contains(f"rest{i}", F.lit(text)), F.lit(name)))
        d = d.withColumn(f"rest{i + 1}", F.replace(F.col(f"rest{i}"), F.lit(text), F.lit("|")))
    rest = F.regexp_replace(F.trim(F.regexp_replace(f"rest{len(rules)}", "[|;]+", " ")), " ", ",")
    return d.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",").alias("licenses"), rest.alias("unknown_ids"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    known = ", ".join(f"('{name}', '{sentence}')" for name, sentence in SENTENCES)
    rest = "CASE WHEN sentence_ids = '' THEN '' ELSE ';' || replace(sentence_ids, ',', ';;') || ';' END"
    steps, last = [], "s0"
    for i, (_, ids) in enumerate(RULES):
        text = "".join(f";{x};" for x in ids)
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (rest), replace(rest, '{text}', '|') AS rest, contains(rest, '{text}') AS f{i} FROM s{i})")
        last = f"s{i + 1}"
    names = list(dict.fromkeys(n for n, _ in RULES))
    hits = {n: " OR ".join(f"f{i}" for i, r in enumerate(RULES) if r[0] == n) for n in names}
    at = {n: "least(" + ", ".join(f"CASE WHEN f{i} THEN {i} ELSE 999 END" for i, r in enumerate(RULES) if r[0] == n) + ", 999)" for n in names}
    rows = " UNION ALL ".join(f"SELECT doc_id, k, '{n}' AS name, {at[n]} AS place FROM {last} WHERE {hits[n]}" for n in names)
    return f"""
WITH known(name, sentence) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS k, text FROM documents),
parts AS (
  SELECT k, generate_subscripts(p, 1) AS i, unnest(p) AS s
  FROM (SELECT k, string_split_regex(text, '{ENDS}') AS p FROM d WHERE regexp_matches(text, '(?i){TRIGGERS}'))),
hits AS (
  SELECT k, i, name FROM parts JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence),
ids AS (SELECT k, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids FROM hits GROUP BY k),
s AS (SELECT doc_id, k, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids FROM d LEFT JOIN ids USING (k)),
s0 AS (SELECT *, {rest} AS rest FROM s),
{", ".join(steps)},
found AS ({rows}),
named AS (SELECT k, string_agg(name, ',' ORDER BY place) AS licenses FROM found GROUP BY k)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids, coalesce(licenses, '') AS licenses,
  replace(trim(regexp_replace(rest, '[|;]+', ' ', 'g')), ' ', ',') AS unknown_ids
FROM {last} LEFT JOIN named USING (k)
"""
