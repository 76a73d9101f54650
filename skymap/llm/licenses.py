"""Licence scans by sentence rules (native DataFrame functions only).

A text is cut into pieces at sentence marks and line ends, and each is normalised (letters and
digits of ASCII only, lower case, single spaces). A known licence sentence is found where it is one
piece or several that follow each other, so hard-wrapped texts and comment leaders do not matter; a
blank line ends a sentence. Of several that start at a piece the longest counts. The identifiers found, in the order
of the text, are matched against ordered rules: a licence is reported when its sentences occur in
the rule's order, with any other licence sentences between them. ``n_sentences`` counts pieces.

The SQL knows the sentences of ``SENTENCES`` that are one piece; ``MORE_SENTENCES`` and wrapped
ones are beyond it.

No shuffle and no join: the sentence table is a constant of the plan, its size fixed by this file.

Cases: a null or empty text has no sentences and no licence. Repeated rows get equal results. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as published, normalised as above.
SENTENCES = {
    "n-apache-1": "licensed under the apache license version 2 0",
    "n-mit": "released under the mit license",
    "n-gpl-3": "this work is licensed under the gnu general public license version 3",
    "n-ccbync-4": "licensed under cc by nc 4 0",
    "n-ccby-4": "licensed under cc by 4 0",
    "n-ccbysa-4": "licensed under cc by sa 4 0",
    "rights": "all rights reserved",
    "n-apache-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
# Licence and its rules: sentence identifiers in order.
RULES = {
    "Apache-2.0": [["n-apache-1"], ["n-apache-2", "apache-use", "apache-copy", "apache-basis"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]],
    "CC-BY-4.0": [["n-ccby-4"]],
    "CC-BY-NC-4.0": [["n-ccbync-4"]],
    "CC-BY-SA-4.0": [["n-ccbysa-4"]],
    "GPL-2.0-or-later": [["gpl-free-2", "gpl-hope"]],
    "GPL-3.0": [["n-gpl-3"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope"]],
    "ISC": [["isc-grant"]],
    "MIT": [["n-mit"], ["mit-grant", "mit-notice"]],
    "Unlicense": [["unlicense-1", "unlicense-2"]],
    "all-rights-reserved": [["rights"]],
}
# Names of licences as they stand in one-line notices, normalised.
NAMES = {
    "AGPL-3.0": ["the gnu affero general public license version 3", "the gnu affero general public license v3 0", "the gnu agpl v3", "agpl 3 0", "agpl 3 0 only"],
    "AGPL-3.0-or-later": ["agpl 3 0 or later"],
    "Apache-2.0": ["the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license", "apache license 2 0", "apache 2 0"],
    "BSD-2-Clause": ["the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", "bsd 3 clause"],
    "BSL-1.0": ["the boost software license version 1 0", "the boost software license 1 0", "bsl 1 0"],
    "CC-BY-4.0": ["cc by 4 0", "a creative commons attribution 4 0 international license", "the creative commons attribution 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "the creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "the creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license"],
    "EPL-2.0": ["the eclipse public license 2 0", "the eclipse public license version 2 0", "the eclipse public license v2 0", "epl 2 0"],
    "GPL-2.0": ["the gnu general public license version 2", "the gnu general public license v2 0", "the gnu gpl v2", "gpl 2 0", "gpl 2 0 only"],
    "GPL-2.0-or-later": ["gpl 2 0 or later"],
    "GPL-3.0": ["the gnu general public license version 3", "the gnu general public license v3 0", "the gnu gpl v3", "gpl 3 0", "gpl 3 0 only"],
    "GPL-3.0-or-later": ["gpl 3 0 or later"],
    "ISC": ["the isc license", "isc"],
    "LGPL-2.1": ["the gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl 2 1 only"],
    "LGPL-2.1-or-later": ["lgpl 2 1 or later"],
    "LGPL-3.0": ["the gnu lesser general public license version 3", "the gnu lesser general public license v3 0", "lgpl 3 0", "lgpl 3 0 only"],
    "LGPL-3.0-or-later": ["lgpl 3 0 or later"],
    "MIT": ["the mit license", "mit license", "mit"],
    "MPL-2.0": ["the mozilla public license version 2 0", "the mozilla public license 2 0", "the mozilla public license v 2 0", "mpl 2 0"],
    "Unlicense": ["the unlicense", "unlicense"],
}
_SUBJECTS = ["", "this work is ", "this project is ", "this software is "]
NOTICES = [f"{subject}{verb} under" for subject in _SUBJECTS for verb in ("licensed", "released", "distributed")]
NOTICES += ["available under", "spdx license identifier", "license"]
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
MORE_SENTENCES = {
    **{f"o-{x.lower()}-{i}-{k}": f"{notice} {name}" for x, names in NAMES.items() for i, name in enumerate(names) for k, notice in enumerate(NOTICES)},
    "lgpl-21": "this library is free software " + _GNU.format("lesser general public license", "2 1"),
    "lgpl-3": "this library is free software " + _GNU.format("lesser general public license", "3"),
    "lgpl-21-program": "this program is free software " + _GNU.format("lesser general public license", "2 1"),
    "lgpl-3-program": "this program is free software " + _GNU.format("lesser general public license", "3"),
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-3": "this program is free software " + _GNU.format("affero general public license", "3"),
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-short": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc0-waiver": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}
MORE_RULES = {
    **{x: [[f"o-{x.lower()}-[0-9]+-[0-9]+"]] for x in NAMES},
    "AGPL-3.0-or-later": [["agpl-3", "gpl-hope"], ["o-agpl-3.0-or-later-[0-9]+-[0-9]+"]],
    "BSL-1.0": [["bsl-grant"], ["o-bsl-1.0-[0-9]+-[0-9]+"]],
    "CC0-1.0": [["cc0-waiver"], ["o-cc0-1.0-[0-9]+-[0-9]+"]],
    "EPL-2.0": [["epl-2"], ["epl-2-short"], ["o-epl-2.0-[0-9]+-[0-9]+"]],
    "LGPL-2.1-or-later": [["lgpl-21", "lgpl-hope"], ["lgpl-21-program", "gpl-hope"], ["o-lgpl-2.1-or-later-[0-9]+-[0-9]+"]],
    "LGPL-3.0-or-later": [["lgpl-3", "lgpl-hope"], ["lgpl-3-program", "gpl-hope"], ["o-lgpl-3.0-or-later-[0-9]+-[0-9]+"]],
    "MPL-2.0": [["mpl-2"], ["o-mpl-2.0-[0-9]+-[0-9]+"]],
}
# A piece ends at a line end, or at one of these marks before white space.
ENDS = "([.;:!?])[\\x20\\x09-\\x0D]+"
NOT_PLAIN = "[^A-Za-z0-9]+"


def rule_pattern(rule: list[str]) -> str:
    """Pattern of the identifiers in this order within '|a|b|c|'."""
    return "\\|" + "\\|([^|]+\\|)*".join(rule) + "\\|"


def _normal(sentence: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(sentence, NOT_PLAIN, " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses), one row per row of ``docs``; sentence_ids
    are joined by '|' in the order of the text, licenses by ',' in the order of their names."""
    names = {t: n for n, t in MORE_SENTENCES.items()} | {t: n for n, t in SENTENCES.items()}
    by_word: dict[str, list[str]] = {}
    for t in sorted(names, key=len, reverse=True):
        by_word.setdefault(t.split()[0], []).append(t)
    table = json.dumps({w: [{"t": t, "id": names[t]} for t in ts] for w, ts in by_word.items()})
    # Parsed once, when the plan is made; as an expression for each sentence it would be slow to plan.
    starts = F.from_json(F.lit(table), "map<string, array<struct<t: string, id: string>>>")
    # A piece that is not empty has a word at least.
    most = max(len(t.split()) for t in names)
    pieces = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ENDS, "$1\n"), "\n")
    base = docs.select(F.col(id_col).alias("doc_id"), F.transform(pieces, _normal).alias("s"))

    def sentence_at(x: Column, i: Column) -> Column:
        """Identifier of the longest known sentence that starts with piece ``x`` at ``i`` and ends with a piece."""
        run = F.concat(F.array_join(F.slice("s", i + 1, most), "\n"), F.lit("\n"))

        def fits(k: Column) -> Column:
            return F.startswith(k["t"], x) & F.startswith(F.translate(run, "\n", " "), k["t"]) & (F.substr(run, F.length(k["t"]) + 1, F.lit(1)) == "\n")

        return F.get(F.filter(F.element_at(starts, F.substring_index(x, " ", 1)), fits), F.lit(0))["id"]

    found = F.filter(F.transform("s", sentence_at), lambda x: x.isNotNull())
    n_pieces = F.size(F.array_remove("s", "")).cast("long")
    base = base.select("doc_id", n_pieces.alias("n_sentences"), F.array_join(found, "|").alias("sentence_ids"))
    ids = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    hits = []
    for license_id in sorted({*RULES, *MORE_RULES}):
        matches = [ids.rlike(rule_pattern(rule)) for rule in RULES.get(license_id, []) + MORE_RULES.get(license_id, [])]
        any_rule = matches[0]
        for m in matches[1:]:
            any_rule = any_rule | m
        hits.append(F.when(any_rule, F.lit(license_id)))
    return base.withColumn("licenses", F.concat_ws(",", *hits))
