"""Licence recognition by sentence rules (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of well-known licence sentences, and the rules over them.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT_GRANT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "MIT_NOTICE": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "MIT_REF": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"),
    "AS_IS": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "APACHE2_REF": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0."),
    "APACHE2_OBEY": ("you may not use this file except in compliance with the License.",),
    "APACHE2_COPY": ("You may obtain a copy of the License at",),
    "APACHE2_UNLESS": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "GPL3_REF": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."),
    "GPL2_REF": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."),
    "GPL3_TERMS": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPL2_TERMS": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL_HOPE": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "LGPL_REF": ("Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL_REF": ("Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3."),
    "BSD_REDIST": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD_SOURCE": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "BSD_BINARY": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD_ENDORSE": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSD3_REF": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "BSD2_REF": ("Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."),
    "MPL2_REF": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "CC_BY_NC4_REF": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC_BY4_REF": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC_BY_SA4_REF": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0_REF": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "UNLICENSE_REF": ("This is free and unencumbered software released into the public domain.",),
}
# (licence, identifiers in order); unknown sentences may stand between. Earlier rules win over later ones.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_OBEY", "APACHE2_COPY", "APACHE2_UNLESS")),
    ("BSD-3-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY")),
    ("GPL-3.0-or-later", ("GPL3_TERMS", "GPL_HOPE")),
    ("GPL-2.0-or-later", ("GPL2_TERMS", "GPL_HOPE")),
    ("GPL-3.0-or-later", ("GPL3_TERMS",)),
    ("GPL-2.0-or-later", ("GPL2_TERMS",)),
    ("AGPL-3.0", ("AGPL_REF",)),
    ("LGPL-3.0", ("LGPL_REF",)),
    ("GPL-3.0", ("GPL3_REF",)),
    ("GPL-2.0", ("GPL2_REF",)),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("MIT", ("MIT_REF",)),
    ("BSD-3-Clause", ("BSD3_REF",)),
    ("BSD-2-Clause", ("BSD2_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC4_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA4_REF",)),
    ("CC-BY-4.0", ("CC_BY4_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("Unlicense", ("UNLICENSE_REF",)),
)
# end of the fixed values

# A sentence ends at . ; : ! ? before white space, or at a line without a letter or digit.
SENTENCE_END = r"(?<=[.;:!?])[\x20\x09-\x0D]+|\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
END = "\x01"


def normalised(sentence: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).strip()


def known(sentences: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Normalised text of each known sentence, with END where the splitter cuts it, to its identifier.

    All parts of a cut sentence must follow each other; those before the longest one, which only
    name the program, may be missing or worded otherwise.
    """
    import re

    out: dict[str, str] = {}
    for name, forms in sentences.items():
        for form in forms:
            parts = [p for p in map(normalised, re.split(SENTENCE_END, form)) if p]
            for first in range(parts.index(max(parts, key=len)) + 1):
                out[END.join(parts[first:])] = name
    return out


def licence_scan(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    sentences: dict[str, tuple[str, ...]] = SENTENCES,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
) -> DataFrame:
    """Licences of every text: ``key``, ``n_sentences``, ``sentence_ids`` (known ones, in text order), ``licenses`` (all whose rule matches, in rule order) and ``license`` (the first, or null).

    A sentence is lower-cased (A-Z), and runs of other characters than a-z and 0-9 become
    one space; so do single line breaks with the comment marks (without letters) after them.
    A known sentence is found between sentence ends or line breaks, on however many lines
    it stands.  A rule matches if its identifiers occur in this order, with any others
    between.  Null and empty texts have no sentences and no licence; a sentence without a
    letter or digit does not count.  Repeated rows give repeated results; other columns are ignored.
    """
    table = known(sentences)
    names = {t.replace(END, " "): name for t, name in table.items()}
    forms = F.map_from_arrays(F.split(F.lit("\n".join(names)), "\n"), F.split(F.lit("\n".join(names.values())), "\n"))
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + END, "abcdefghijklmnopqrstuvwxyz ")
    plain = F.concat(F.lit(END), F.regexp_replace(plain, SENTENCE_END, END), F.lit(END))
    # words are parted by one space, line break or END, whichever is the strongest between them
    for run, one in ((f"[^a-z0-9\n{END}]+", " "), (" ?\n[ \n]*", "\n"), (f"[ \n]?{END}[ \n{END}]*", END)):
        plain = F.regexp_replace(plain, run, one)
    rows = docs.select(F.col(key).alias("_key"), plain.alias("_plain"))
    n_sentences = F.length("_plain") - F.length(F.translate("_plain", END, "")) - 1
    found = F.transform(F.regexp_extract_all("_plain", F.lit(_pattern(table)), F.lit(0)), lambda x: F.element_at(forms, F.translate(x, "\n" + END, "  ")))
    rows = rows.select("_key", n_sentences.cast("long").alias("n_sentences"), found.alias("sentence_ids"))
    joined = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    hits: list[Column] = [F.when(joined.rlike(".*".join(f" {i} " for i in order)), F.lit(name)) for name, order in rules]
    licences = F.when(F.size("sentence_ids") > 0, F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("licenses", licences)
    return rows.select(F.col("_key").alias(key), "n_sentences", "sentence_ids", "licenses", F.get("licenses", F.lit(0)).alias("license"))


def _pattern(table: dict[str, str]) -> str:
    """Pattern of all known sentences, longer ones first, over any line breaks; a sentence end may stand where the known one has it."""
    forms = sorted(table, key=lambda t: (-len(t), t))
    return "(?<![a-z0-9 ])(?:" + "|".join(t.replace(" ", "[ \n]").replace(END, f"[ \n{END}]") for t in forms) + ")(?![a-z0-9 ])"
