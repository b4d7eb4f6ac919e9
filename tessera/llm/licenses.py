"""Licence recognition by sentence rules.

Texts are cut into sentences, which may be wrapped over lines, normalised and mapped to
known licence-sentence identifiers by a small fixed table (literals of the plan), by
sentences with a slot, and by notices that name a licence. A rule is an ordered sequence of
identifiers; a document has the licence of a rule whose identifiers are met one after
the other in the sequence of its recognised sentences.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

# Known licence sentences (normalised) by identifier.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "ccbync4-ref": "licensed under cc by nc 4 0",
    "ccby4-ref": "licensed under cc by 4 0",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache2-marks": "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl2-only-version": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "agpl3-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "gpl3-verbatim": "you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice keep intact all notices stating that this license and any non permissive terms added in accord with section 7 apply to the code keep intact all notices of the absence of any warranty and give all recipients a copy of this license along with the program",
    "gpl2-verbatim": "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and give any other recipients of the program a copy of this license along with the program",
    "lgpl21-verbatim": "you may copy and distribute verbatim copies of the library s complete source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and distribute a copy of this license along with the library",
    "lgpl3-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-warranty": "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or non infringing",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "cc0-deed": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "ccbyncsa4-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "ccbyncnd4-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
}

# Other wordings of sentences above in real licence texts, by the same identifiers.
FULL = {
    "bsd-neither": "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
}

# Sentences with a slot for a holder, as a pattern of the normalised sentence; another
# sentence that begins so is told apart, as it may be a clause that isn't known.
BEGIN = "neither the name"
NEITHER = "^neither the names? of .+ nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission$"

# Names of licences in short notices, normalised.
NAMES = {
    "MIT": ["mit"],
    "Apache-2.0": ["apache 2 0", "apache license 2 0", "apache license version 2 0", "apache software license 2 0", "apache v2"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "revised bsd"],
    "ISC": ["isc"],
    "GPL-2.0": ["gpl 2 0", "gplv2", "gpl v2", "gnu gpl v2", "gnu general public license v2", "gnu general public license version 2"],
    "GPL-3.0": ["gpl 3 0", "gplv3", "gpl v3", "gnu gpl v3", "gnu general public license v3", "gnu general public license version 3"],
    "LGPL-3.0": ["lgplv3", "lgpl v3", "gnu lgpl v3", "gnu lesser general public license v3"],
    "AGPL-3.0": ["agplv3", "agpl v3", "gnu agpl v3", "gnu affero general public license v3"],
    "MPL-2.0": ["mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license 1 0", "boost software license version 1 0"],
}
NOTICE = (
    "^(?:this|the) [a-z0-9 ]{1,80} (?:is|are) (?:licensed|released|distributed|provided|available|made available|open sourced) under (?:the terms of )?(?:the )?("
    + "|".join(sorted((n for names in NAMES.values() for n in names), key=lambda n: (-len(n), n)))
    + ")(?: license)?(?: see .*| a copy .*)?$"
)
#: Longest sentence that a slot or a notice is looked for in.
SLOTTED = 400

# Identifiers of the machine-readable line.
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]


def _plain(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


# Ordered rules as (licence, identifiers that follow each other).
RULES = [
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache-2.0", ["apache2-use", "apache2-copy"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy"]),
    ("Apache-2.0", ["apache2-grant", "apache2-marks"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("GPL-3.0", ["gpl3-preamble", "gpl3-verbatim"]),
    ("AGPL-3.0", ["agpl3-preamble", "gpl3-verbatim"]),
    ("GPL-2.0", ["gpl2-verbatim"]),
    ("LGPL-2.1", ["lgpl21-verbatim"]),
    ("LGPL-3.0", ["lgpl3-incorporates"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-warranty"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-work"]),
    ("CC-BY-NC-4.0", ["ccbync4-work"]),
    ("CC-BY-ND-4.0", ["ccbynd4-work"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-work"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-work"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-version"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    # A third clause in unknown words: neither of the two licences.
    ("", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-neither-like"]),
]
SENTENCES |= {f"spdx-{n.lower()}": f"spdx license identifier {_plain(n)}" for n in SPDX}
RULES += [(n, [f"spdx-{n.lower()}"]) for n in SPDX] + [(n, [f"notice-{n.lower()}"]) for n in NAMES]


def _chain(ids: list[str]) -> str:
    return ">" + ">".join(ids) + ">"


def _longer(rules: list[tuple[str, list[str]]], ids: list[str]) -> list[str]:
    """The chains of the rules that begin with these ids and go on, longest first; their occurrences are theirs only."""
    found = [r for _, r in rules if len(r) > len(ids) and r[: len(ids)] == ids]
    return [_chain(r) for r in sorted(found, key=lambda r: (-len(r), r))]


def normalised(sentence: Column) -> Column:
    """Lower-case, with runs of other characters than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences: paragraphs (between lines without letters and digits) cut after . ! or ? before white space."""
    return F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+|(?<=[.!?])(?:[ \t]+|[ \t\r]*\n)")


def _identified(normal: Column, pairs: list[tuple[str, str]]) -> Column:
    """The identifier of a normalised sentence: of the table, of a sentence with a slot, or of a notice with a licence's name; else null."""
    by_sentence = F.create_map(*[F.lit(x) for k, v in pairs for x in (v, k)])
    by_name = F.create_map(*[F.lit(x) for k, names in NAMES.items() for n in names for x in (n, f"notice-{k.lower()}")])
    texts = [v for _, v in pairs]
    table = F.when((F.length(normal) <= max(map(len, texts))) & normal.isin(texts), F.element_at(by_sentence, normal))
    short = F.length(normal) <= SLOTTED
    slot = F.when(F.startswith(normal, F.lit(BEGIN)), F.when(short & normal.rlike(NEITHER), "bsd-neither").otherwise("bsd-neither-like"))
    notice = F.when(short & F.contains(normal, F.lit(" under ")) & normal.rlike(NOTICE), F.element_at(by_name, F.regexp_extract(normal, NOTICE, 1)))
    return F.coalesce(table, slot, notice)


def _known(part: Column, pairs: list[tuple[str, str]], cuts: tuple[str, ...]) -> Column:
    """The identifier of the part as an array if it is known; else those of its pieces, cut at the first of `cuts`."""
    # The outer transform binds the normalised part to a name, so that it is made once.
    own = F.filter(F.transform(F.array(normalised(part)), lambda n: _identified(n, pairs)), lambda i: i.isNotNull())
    if not cuts:
        return own
    pieces = F.flatten(F.transform(F.split(part, cuts[0]), lambda p: _known(p, pairs, cuts[1:])))
    whole = lambda found: F.when((F.size(found) > 0) & ~F.endswith(F.coalesce(F.get(found, F.lit(0)), F.lit("")), F.lit("-like")), found).when(F.contains(part, F.lit("\n")), pieces).otherwise(found)
    return F.flatten(F.transform(F.array(own), whole))


def recognise(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, text: str = "text") -> DataFrame:
    """Add licenses array<string> (sorted, distinct) and license_sentences (ids in order) to every row.

    Null or empty text and an empty table have none, texts of any length are read whole; rows are never merged, so repeated rows keep their own
    result. A sentence wrapped over lines is taken whole where it is known, else after a
    colon at a line's end, else by lines. Sentences with other holders' names, notices of
    one sentence with a licence's name, and machine-readable lines count too. Columns of docs with these names are replaced.
    """
    pairs = list(known.items()) if known else [*SENTENCES.items(), *FULL.items()]
    rules = rules or RULES
    cuts = (r":[ \t\r]*\n", r"\n+")
    ids = F.flatten(F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: _known(s, pairs, cuts)))
    out = docs.drop("licenses", "license_sentences").withColumn("license_sentences", ids)
    chain = F.concat(F.lit(">"), F.array_join("license_sentences", ">"), F.lit(">"))
    found = []
    for name, seq in rules:
        if not name:
            continue
        left = chain
        for longer in _longer(rules, seq):
            left = F.replace(left, F.lit(longer), F.lit(">"))
        found.append(F.when(F.contains(left, F.lit(_chain(seq))), F.lit(name)))
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recognise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"('{v}', '{k}')" for k, v in [*SENTENCES.items(), *FULL.items()])
    names = ", ".join(f"('{n}', 'notice-{k.lower()}')" for k, own in NAMES.items() for n in own)

    def chains(seq: list[str]) -> str:
        two = [*_longer(RULES, seq), "|", "|", "|"]
        if two[2] != "|":
            raise ValueError("the SQL form takes two longer rules at most")
        return f"'{two[0]}', '{two[1]}'"

    rules = ", ".join(f"('{name}', '{_chain(seq)}', {chains(seq)})" for name, seq in RULES if name)
    return rf"""
WITH known(s, id) AS (VALUES {known}), names(s, id) AS (VALUES {names}), rules(license, chain, first, second) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
l AS (SELECT k, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT k, string_split_regex(coalesce(text, ''), '\n+') AS a FROM d)),
s AS (SELECT k, i, generate_subscripts(a, 1) AS j, unnest(a) AS s
      FROM (SELECT k, i, string_split(regexp_replace(line, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS a FROM l)),
n AS (SELECT k, i, j, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM s),
c AS (SELECT k, i, j, coalesce(known.id, CASE WHEN starts_with(n.s, '{BEGIN}') THEN CASE WHEN length(n.s) <= {SLOTTED} AND regexp_matches(n.s, '{NEITHER}') THEN 'bsd-neither' ELSE 'bsd-neither-like' END END, names.id) AS id
      FROM n LEFT JOIN known ON n.s = known.s LEFT JOIN names ON length(n.s) <= {SLOTTED} AND contains(n.s, ' under ') AND names.s = regexp_extract(n.s, '{NOTICE}', 1)),
h AS (SELECT k, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids FROM c WHERE id IS NOT NULL GROUP BY k),
r AS (SELECT k, string_agg(license, ',' ORDER BY license) AS licenses
      FROM (SELECT DISTINCT k, license FROM h JOIN rules ON contains(replace(replace('>' || replace(ids, ',', '>') || '>', first, '>'), second, '>'), chain)) GROUP BY k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentences, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN h USING (k) LEFT JOIN r USING (k)
"""


OP4_SQL = _sql()
