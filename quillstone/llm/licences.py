"""Licence scan: normalised sentences become identifiers, and identifier sequences are matched by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What licences and their notices say, by identifier, and the rules in order of precedence.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "apache-2-ref": [
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
    ],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "gpl-2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ],
    "gpl-3-ref": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Licensed under the GPLv3.",
    ],
    "gpl-2-ref": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "Licensed under the GPLv2.",
    ],
    "lgpl-3-ref": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "agpl-3-ref": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "mpl-2-ref": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "mit-ref": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This work is licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-ref": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "reserved": ["All rights reserved."],
}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        SENTENCES[f"cc-{_kind.lower()}-{_version}-ref"] = [
            f"{lead} CC {_kind} {_version}." for lead in ("Licensed under", "Released under", "This work is licensed under")
        ]
for _name in ("MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"):
    SENTENCES[f"spdx-{_name.lower()}"] = [f"SPDX-License-Identifier: {_name}"]

RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-2-ref", "apache-comply", "apache-obtain"]),
    ("Apache-2.0", ["apache-2-ref"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("GPL-3.0-only", ["gpl-3-ref"]),
    ("GPL-2.0-only", ["gpl-2-ref"]),
    ("LGPL-3.0-only", ["lgpl-3-ref"]),
    ("AGPL-3.0-only", ["agpl-3-ref"]),
    ("MPL-2.0", ["mpl-2-ref"]),
    ("MIT", ["mit-ref"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-ref"]),
    *[
        (f"CC-{kind}-{version}", [f"cc-{kind.lower()}-{version}-ref"])
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
        for version in ("3.0", "4.0")
    ],
    *[(name, [f"spdx-{name.lower()}"]) for name in ("MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")],
    ("all-rights-reserved", ["copyright", "reserved"]),
    ("all-rights-reserved", ["reserved"]),
]
# Every known sentence holds one of these words, so texts without any of them have no identifiers.
ANCHORS = ["licen", "permission", "redistribution", "copyright", "warrant", "reserved", "software", "gpl", "domain", "compliance", "released"]
# End of fixed values.


def normal(sentence: str) -> str:
    """Lower case, one spelling, letters and digits only."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower().replace("licence", "license")).strip()


def known() -> dict[str, str]:
    return {normal(s): name for name, variants in SENTENCES.items() for s in variants}


def pieces(sentence: str) -> list[str]:
    """The normal forms that :func:`sentences` cuts one known sentence into: more than one where a mark stands inside it."""
    import re

    return [normal(p) for p in re.split(r"(?<=[.!?;:])[ \t\r]+", sentence)]


def sentences(text: Column) -> Column:
    """Normalised sentences: cut at line ends and after sentence marks before a space.

    Known sentences with a mark inside, such as a colon or ``v.``, are put together again where all their pieces follow
    one another; other pieces stay as they are cut.
    """
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[ \t\r]+", "$1\n"), "\n")
    clean = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), "licence", "license"), "[^a-z0-9]+", " ")))
    whole = F.concat(F.lit("|"), F.array_join(F.filter(clean, lambda s: s != ""), "||"), F.lit("|"))
    several = [p for variants in SENTENCES.values() for p in map(pieces, variants) if len(p) > 1]
    for parts in sorted(several, key=len, reverse=True):
        whole = F.replace(whole, F.lit(f"|{'||'.join(parts)}|"), F.lit(f"|{' '.join(parts)}|"))
    return F.filter(F.split(whole, r"\|+"), lambda s: s != "")


def unwrapped(text: Column) -> Column:
    """Lines of a paragraph joined, so that a sentence may run over several lines."""
    marked = F.regexp_replace(text, r"\n[ \t\r]*\n[ \t\r\n]*", "\u0001")
    return F.translate(F.translate(marked, "\n", " "), "\u0001", "\n")


def identifiers(list_of: Column) -> Column:
    """Identifiers of known sentences in order, ``copyright`` for notices, and ``unknown`` for others about licences."""
    table = known()
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def one(s: Column) -> Column:
        return (
            F.when(s.isin(list(table)), names[s])
            .when(s.startswith("copyright "), F.lit("copyright"))
            .when(s.contains("license"), F.lit("unknown"))
        )

    return F.filter(F.transform(list_of, one), lambda x: x.isNotNull())


def match_rules(ids: Column) -> Column:
    """struct(left, found): rules in order, each takes its identifiers out of the sequence wherever they stand in a row."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq")) for name, seq in RULES])
    start = F.struct(
        F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(state: Column, rule: Column) -> Column:
        there = F.contains(state["left"], rule["seq"])
        return F.struct(
            F.when(there, F.replace(state["left"], rule["seq"], F.lit(""))).otherwise(state["left"]).alias("left"),
            F.when(there, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(rules, start, step)


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: (doc_id, sentence_ids, licences, n_unknown).

    Sentences are read twice, line by line and with the lines of a paragraph joined; sentence_ids is the sequence of the
    reading that knows more of them (the first where equal), joined by spaces, and licences has the names found in it,
    sorted and joined by spaces. n_unknown counts sentences about licences that are not known. Null and empty texts have
    empty results. Repeated rows get equal rows; other columns are not looked at; an empty table gives an empty result.
    All is computed within the row, nothing is shuffled, and texts without an anchor word are not cut up.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    about = F.lit(False)
    for word in ANCHORS:
        about = about | F.contains(low, F.lit(word))
    none = F.array().cast("array<string>")
    known_names = F.col("_lines"), F.col("_joined")
    counted = [F.size(F.filter(c, lambda x: x != "unknown")) for c in known_names]
    rows = docs.select("doc_id", F.when(about, text).alias("_text"))
    rows = rows.select(
        "doc_id",
        F.when(F.col("_text").isNotNull(), identifiers(sentences(F.col("_text")))).otherwise(none).alias("_lines"),
        F.when(F.col("_text").isNotNull(), identifiers(sentences(unwrapped(F.col("_text"))))).otherwise(none).alias("_joined"),
    )
    rows = rows.select("doc_id", F.when(counted[1] > counted[0], known_names[1]).otherwise(known_names[0]).alias("_ids"))
    rows = rows.withColumn("_match", F.when(F.size("_ids") > 0, match_rules(F.col("_ids"))))
    return rows.select(
        "doc_id",
        F.array_join("_ids", " ").alias("sentence_ids"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("_match.found")), " "), F.lit("")).alias("licences"),
        F.size(F.filter("_ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def cut(x: str) -> str:
        parts = f"string_split(regexp_replace({x}, '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))"
        clean = f"list_transform({parts}, lambda s: trim(regexp_replace(replace(lower(s), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g')))"
        names = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in known().items()) + "}"
        one = f"CASE WHEN {names}[s] IS NOT NULL THEN {names}[s] WHEN starts_with(s, 'copyright ') THEN 'copyright' WHEN contains(s, 'license') THEN 'unknown' END"
        return f"list_filter(list_transform(list_filter({clean}, lambda s: s <> ''), lambda s: {one}), lambda x: x IS NOT NULL)"

    joined = "replace(replace(regexp_replace(text, '\\n[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(1), 'g'), chr(10), ' '), chr(1), chr(10))"
    about = " OR ".join(f"contains(lower(text), {text(a)})" for a in ANCHORS)
    count = "len(list_filter({}, lambda x: x <> 'unknown'))"
    steps = f"""
    WITH d AS (SELECT doc_id, text FROM documents WHERE {about}),
    i AS (SELECT doc_id, {cut('text')} AS a, {cut(joined)} AS b FROM d),
    s0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS found
           FROM (SELECT doc_id, CASE WHEN {count.format('b')} > {count.format('a')} THEN b ELSE a END AS ids FROM i))"""
    for k, (name, seq) in enumerate(RULES):
        pattern = text("".join(f"<{x}>" for x in seq))
        steps += f""",
    s{k + 1} AS (SELECT doc_id, ids, replace(rest, {pattern}, '') AS rest,
            CASE WHEN contains(rest, {pattern}) THEN list_append(found, {text(name)}) ELSE found END AS found FROM s{k})"""
    return f"""{steps}
    SELECT o.doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
           coalesce(array_to_string(list_sort(list_distinct(found)), ' '), '') AS licences,
           coalesce(CAST(len(list_filter(ids, lambda x: x = 'unknown')) AS BIGINT), 0) AS n_unknown
    FROM documents o LEFT JOIN s{len(RULES)} USING (doc_id)"""
