"""Licence scans by sentence rules: sentences become identifiers, sequences of identifiers become licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import let

# Known licence sentences, as normalised by normalise_sentence, and their identifiers. First whole sentences of the licences and of their usual notices.
SENTENCES = {
    "apache license version 2 0 january 2004": "apache2.title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2.title",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2.notice",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache2.notice",
    "you may obtain a copy of the license at": "apache2.copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2.limits",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "gnu general public license version 3 29 june 2007": "gpl3.title",
    "gnu general public license version 2 june 1991": "gpl2.title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3.title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21.title",
    "gnu affero general public license version 3 19 november 2007": "agpl3.title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3.only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl2.only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3.later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.named",
    "mozilla public license version 2 0": "mpl2.title",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.named",
    "this work is licensed under the creative commons attribution 4 0 international license": "ccby4.named",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4.named",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "ccbysa4.named",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4.named",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "ccbync4.named",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    # clauses of them, and short forms
    "licensed under the apache license version 2 0": "apache2.named",
    "you may not use this file except in compliance with the license": "apache2.compliance",
    "released under the mit license": "mit.named",
    "licensed under the mit license": "mit.named",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit.grant",
    "this work is licensed under the gnu general public license version 3": "gpl3.named",
    "this work is licensed under the gnu general public license version 2": "gpl2.named",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl.grant",
    "either version 2 of the license or at your option any later version": "gpl.2plus",
    "either version 3 of the license or at your option any later version": "gpl.3plus",
    "licensed under cc by 4 0": "ccby4.named",
    "licensed under cc by sa 4 0": "ccbysa4.named",
    "licensed under cc by nc 4 0": "ccbync4.named",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd.grant",
    "redistributions of source code must retain the above copyright notice": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd.endorse",
    "all rights reserved": "rights.reserved",
}
# Licence rules in order of precedence; a rule's identifiers must come in its order, other sentences may lie between.
RULES = (
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("AGPL-3.0-or-later", ("agpl3.later",)),
    ("AGPL-3.0-only", ("agpl3.title",)),
    ("LGPL-3.0-or-later", ("lgpl3.later",)),
    ("LGPL-2.1-or-later", ("lgpl21.later",)),
    ("LGPL-3.0-only", ("lgpl3.title",)),
    ("LGPL-2.1-only", ("lgpl21.title",)),
    ("GPL-3.0-or-later", ("gpl3.later",)),
    ("GPL-2.0-or-later", ("gpl2.later",)),
    ("GPL-3.0-or-later", ("gpl.grant", "gpl.3plus")),
    ("GPL-2.0-or-later", ("gpl.grant", "gpl.2plus")),
    ("GPL-3.0-only", ("gpl3.only",)),
    ("GPL-2.0-only", ("gpl2.only",)),
    ("GPL-3.0-only", ("gpl3.title",)),
    ("GPL-2.0-only", ("gpl2.title",)),
    ("Apache-2.0", ("apache2.title",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("Apache-2.0", ("apache2.named", "apache2.compliance", "apache2.copy")),
    ("Apache-2.0", ("apache2.named",)),
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.named",)),
    ("ISC", ("isc.grant",)),
    ("GPL-3.0-only", ("gpl3.named",)),
    ("GPL-2.0-only", ("gpl2.named",)),
    ("CC-BY-4.0", ("ccby4.named",)),
    ("CC-BY-SA-4.0", ("ccbysa4.named",)),
    ("CC-BY-NC-4.0", ("ccbync4.named",)),
    ("MPL-2.0", ("mpl2.named",)),
    ("MPL-2.0", ("mpl2.title",)),
    ("Unlicense", ("unlicense.grant",)),
    ("Proprietary", ("rights.reserved",)),
)
#: The version sign of names such as "License, v. 2.0", which ends no sentence.
VERSION = r"\b([vV])\.[^\p{L}\p{N}]+([0-9])"
#: Sentences end at . ! ? before a space or at the end (so "2.0" stays whole), at a colon before a line break, and at lines without letters and digits. Other line breaks only wrap.
BREAK = r"[.!?]+[\x22\x27)\]]*(?:[\x20\x09-\x0D]+|$)|:[\x20\x09\x0D]*\n|\n[^\p{L}\p{N}\n]*\n"
#: Of a sentence that is not known as a whole, clauses and lines are looked up.
CLAUSE = r"\n|[;:]+(?:[\x20\x09-\x0D]+|$)"
#: Whoever is named takes the place of the one in the known sentence.
HOLDER, HOLDER_KNOWN = r"^neither the name of .* nor the names of (its|his|their) contributors", "neither the name of the copyright holder nor the names of its contributors"


def hint_words(sentences) -> list[str]:
    """Words of which every one of the sentences has one: the word that most of those left have (the longest of several), again and again."""
    left, out = [set(x.split(" ")) for x in sentences], []
    while left:
        words = sorted({w for x in left for w in x})
        out.append(max(words, key=lambda w: (sum(w in x for x in left), len(w), w)))
        left = [x for x in left if out[-1] not in x]
    return out


def normalise_sentence(c: Column) -> Column:
    """Lower case; whatever is no letter or digit becomes one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), HOLDER, HOLDER_KNOWN)


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, sentence_ids (array, in the text's order), licenses (array of those of the rules that match, by precedence).

    A sentence is known as a whole, or without its first line or two (a heading, a copyright line); else its clauses and lines are looked up one by one.
    A rule matches if its identifiers come in its order, with others between them or not. It takes the identifiers that it matches: a later rule made of identifiers that an
    earlier matching rule has is passed over. A null or empty text has no sentences, an empty table no rows; rows stay as they are, repeated ones too; other columns are
    ignored. Work grows in proportion to a text.
    """
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    none = F.array().cast("array<string>")
    of = lambda s: F.try_element_at(known, normalise_sentence(s))

    def ids_of(sentence: Column) -> Column:
        whole = F.coalesce(of(sentence), of(F.regexp_replace(sentence, r"^[^\n]*\n", "")), of(F.regexp_replace(sentence, r"^[^\n]*\n[^\n]*\n", "")))
        return let(whole, lambda one: F.when(one.isNotNull(), F.array(one)).otherwise(F.array_compact(F.transform(F.split(sentence, CLAUSE), of))))

    ids = F.flatten(F.transform(F.split(F.regexp_replace("text", VERSION, "$1 $2"), BREAK), ids_of))
    hinted = F.lower("text").rlike("|".join(hint_words(sentences))) if sentences else F.lit(False)
    found = docs.select("doc_id", F.when(hinted, ids).otherwise(none).alias("sentence_ids"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, parts)).alias("ids")) for name, parts in rules])

    def step(acc: Column, rule: Column) -> Column:
        # the next part that the rule waits for moves on when it comes
        parts = F.aggregate("sentence_ids", F.lit(0), lambda k, x: F.when(F.get(rule["ids"], k) == x, k + 1).otherwise(k))
        match = (F.size(F.array_except(rule["ids"], acc["used"])) > 0) & (parts == F.size(rule["ids"]))
        return F.struct(
            F.when(match, F.array_union(acc["licenses"], F.array(rule["name"]))).otherwise(acc["licenses"]).alias("licenses"),
            F.when(match, F.array_union(acc["used"], rule["ids"])).otherwise(acc["used"]).alias("used"))

    matched = F.aggregate(ordered, F.struct(none.alias("licenses"), none.alias("used")), step, lambda acc: acc["licenses"])
    return found.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, matched).otherwise(none).alias("licenses"))
