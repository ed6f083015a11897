"""License scan: ordered signature rules over a text's words, gated by keywords, with suppression of what others contain."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, documents, rows

#: Every byte that parts words becomes a space, A-Z become lower case; what is left is 0-9, a-z and all above ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases whose places are all reported, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses: label, names as patterns over words (joined by one space), the words of the SPDX identifier, a keyword that
#: every mention holds. A name stands for itself without the word license after it.
_LICENSES = (
    ("mit", "mit|expat|x11", "mit", ""),
    ("mit-0", "mit no attribution|mit 0", "mit 0", "mit"),
    ("apache-1", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1(?: [01])?", "apache 1 [01]", "apache"),
    ("apache-2", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd|one clause bsd)", "bsd 1 clause", "clause"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd 4 clause", "bsd"),
    ("bsd", "bsd(?: style)?", "bsd", "bsd"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", "bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc", ""),
    ("gpl-1", "gnu general public licen[sc]e(?: version| v) ?1|(?:gnu )?gpl ?(?:version |v ?)?1(?: 0)?", "gpl 1 0", ""),
    ("gpl-2", "gnu general public licen[sc]e(?: version| v) ?2|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?", "gpl 2 0", ""),
    ("gpl-3", "gnu general public licen[sc]e(?: version| v) ?3|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?", "gpl 3 0", ""),
    ("gpl", "gnu general public licen[sc]e|gnu gpl|gpl", "gpl", ""),
    ("lgpl-2", "gnu (?:library|lesser) general public licen[sc]e(?: version| v) ?2(?: [01])?|(?:gnu )?lgpl ?(?:version |v ?)?2(?: [01])?", "lgpl 2 [01]", ""),
    ("lgpl-3", "gnu lesser general public licen[sc]e(?: version| v) ?3|(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?", "lgpl 3 0", ""),
    ("lgpl", "gnu (?:library|lesser) general public licen[sc]e|gnu lgpl|lgpl", "lgpl", ""),
    ("agpl-3", "gnu affero general public licen[sc]e(?:(?: version| v) ?3)?|agpl ?v?3?(?: 0)?|gnu agpl", "agpl 3 0", ""),
    ("gfdl", "gnu free documentation licen[sc]e|gfdl", "gfdl 1 [123]", ""),
    ("mpl-1", "(?:mozilla public licen[sc]e(?: version| v)?|mpl) ?1 [01]", "mpl 1 [01]", ""),
    ("mpl-2", "(?:mozilla public licen[sc]e(?: version| v)?|mpl) ?2(?: 0)?", "mpl 2 0", ""),
    ("epl-1", "(?:eclipse public licen[sc]e(?: version| v)?|epl) ?1(?: 0)?", "epl 1 0", ""),
    ("epl-2", "(?:eclipse public licen[sc]e(?: version| v)?|epl) ?2(?: 0)?", "epl 2 0", ""),
    ("cddl", "common development and distribution licen[sc]e|cddl", "cddl 1 [01]", ""),
    ("cpl", "common public licen[sc]e", "cpl 1 0", ""),
    ("eupl", "european union public licen[sc]e|eupl", "eupl 1 [12]", ""),
    ("artistic", "(?:perl )?artistic(?: 2 0)?", "artistic [12] 0", "artistic"),
    ("boost", "boost software|boost", "bsl 1 0", ""),
    ("zlib", "zlib(?: libpng)?", "zlib", "zlib"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl", ""),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("cc0", "cc0(?: 1 0)?|cc zero|creative commons zero", "cc0 1 0", ""),
    ("cc-by", "cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?", "cc by [1-4] [05]", ""),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa [1-4] [05]", ""),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?", "cc by nd [1-4] [05]", ""),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc [1-4] [05]", ""),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc sa [1-4] [05]", ""),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?", "cc by nc nd [1-4] [05]", ""),
    ("odbl", "open (?:data commons open )?database licen[sc]e|odbl", "odbl 1 0", ""),
    ("odc-by", "open data commons attribution|odc by", "odc by 1 0", ""),
    ("pddl", "public domain dedication and licen[sc]e|pddl", "pddl 1 0", ""),
    ("ofl", "sil open font|open font|ofl(?: 1 1)?", "ofl 1 1", ""),
    ("python", "python software foundation|psf", "psf 2 0", ""),
    ("openssl", "openssl", "openssl", "openssl"),
    ("openrail", "(?:creativeml |bigscience )?open ?rail(?: m)?", "openrail", ""),
    ("upl", "universal permissive", "upl 1 0", ""),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("sspl", "server side public|sspl", "sspl 1 0", ""),
    ("busl", "business source|busl", "busl 1 1", ""),
)

#: How a license is mentioned: pattern around its name {n}, its SPDX words {s}, any name {a} or any SPDX words {i}, keyword,
#: priority, score. Of a list of licenses the first one is found as any other, the next ones by the rules of lists; of
#: these only what comes after @ counts as the place, so that they don't suppress each other.
_UNDER = "(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|offered|dual licen[sc]ed)"
_MENTIONS = (
    ("spdx licen[sc]e identifier {s}(?: only| or later)?", "spdx", 100, 1.0),
    ("spdx licen[sc]e identifier (?:{i})(?: only| or later)?(?:(?: and| or| with)+ (?:{i})(?: only| or later)?){{0,6}}(?: and| or| with)+ @ {s}(?: only| or later)?", "spdx", 99, 1.0),
    ("(?:opensource org|spdx org|choosealicense com) licen[sc]es {s}", "licenses", 95, 0.95),
    (_UNDER + " under (?:either )?(?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[sc]es?)?", "under", 90, 0.95),
    (_UNDER + " under (?:either )?(?:both )?(?:the )?(?:terms of )?(?:the )?(?:{a})(?: licen[sc]es?)?(?:(?: and| or| the| either)* (?:{a})(?: licen[sc]es?)?){{0,4}}(?: and| or| the)* @ (?:{n})(?: licen[sc]es?)?", "under", 89, 0.9),
    ("(?:terms|conditions) of (?:the )?(?:{n})(?: licen[sc]e)?", "of", 70, 0.8),
    ("(?:{n}) licen[sc]e", "licen", 60, 0.8),
    ("licen[sc]es? (?:is |are |type |the )?(?:{n})", "licen", 50, 0.6),
    ("licen[sc]es? (?:is |are |type |the )?(?:{a})(?:(?: and| or| the)+ (?:{a})){{0,4}}(?: and| or| the)+ @ (?:{n})", "licen", 49, 0.6),
    ("(?:see|read|refer to) (?:the )?(?:{n})(?: licen[sc]e)? (?:for|file|text|terms)", "", 40, 0.5),
)
#: An identifier with a number or a clause says enough by itself.
_ALONE = ("(?:{n})(?: only| or later| or any later version)?", 30, 0.5)
_ALONE_FOR = ("gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-3", "agpl-3", "mpl-1", "mpl-2", "epl-1", "epl-2", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "cc0", "mit-0")
_VERSIONED = {"agpl-3": "(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?", "mit-0": "mit 0", "0bsd": "0bsd", "cc0": "cc0 1 0", "bsd-2-clause": "bsd 2 clause|2 clause bsd", "bsd-3-clause": "bsd 3 clause|3 clause bsd", "bsd-4-clause": "bsd 4 clause|4 clause bsd"}

#: Words of the licenses' own texts and notices: label, pattern, keyword, priority, score.
_TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 80, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted", 80, 0.95),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification)?", "redistribution and use", 80, 0.9),
    ("bsd-3-clause", "neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors", "neither the name", 81, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials", 82, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "free software", 80, 0.9),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "gnu", 81, 0.9),
    ("agpl-3", "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", "affero", 82, 0.9),
    ("apache-2", "licen[sc]ed under the apache licen[sc]e version 2(?: 0)?", "apache", 92, 0.98),
    ("apache-2", "www apache org licenses license 2 0", "apache org", 95, 0.95),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla", 92, 0.98),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 80, 0.95),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted", 81, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "as is", 80, 0.9),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 70, 0.8),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons", 95, 0.95),
    ("cc-by", "creativecommons org licenses by(?: [1-4] [05])?", "creativecommons", 94, 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons", 95, 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons", 95, 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons", 95, 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons", 96, 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons", 96, 0.95),
    ("gpl-2", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2", "free software foundation", 93, 0.98),
    ("gpl-3", "gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3", "free software foundation", 93, 0.98),
    ("lgpl-2", "gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation (?:either )?version 2", "free software foundation", 94, 0.98),
    ("lgpl-3", "gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3", "free software foundation", 94, 0.98),
    ("agpl-3", "gnu affero general public licen[sc]e as published by the free software foundation", "free software foundation", 94, 0.98),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e", "received a copy", 79, 0.9),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "received a copy", 79, 0.9),
    ("agpl-3", "you should have received a copy of the gnu affero general public licen[sc]e", "received a copy", 79, 0.9),
    ("gpl", "gnu org licen[sc]es gpl", "gnu org", 78, 0.8),
    ("lgpl", "gnu org licen[sc]es lgpl", "gnu org", 78, 0.8),
    ("agpl-3", "gnu org licen[sc]es agpl", "gnu org", 78, 0.8),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "free documentation", 92, 0.98),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at", "in compliance with the licen", 77, 0.7),
    ("apache-1", "this product includes software developed by the apache (?:software foundation|group)", "apache", 76, 0.7),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice", 79, 0.9),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "as is", 60, 0.6),
    ("mit", "opensource org licen[sc]es mit", "opensource org", 95, 0.95),
    ("bsd", "opensource org licen[sc]es bsd", "opensource org", 94, 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source", 79, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary", 79, 0.9),
    ("bsd", "use of this source code is governed by a bsd style licen[sc]e", "governed by", 80, 0.9),
    ("mit", "use of this source code is governed by an mit style licen[sc]e", "governed by", 80, 0.9),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "hereby granted", 80, 0.95),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 92, 0.95),
    ("mpl-2", "mozilla org mpl 2 0", "mozilla org", 93, 0.95),
    ("mpl-1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]", "mozilla", 92, 0.95),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0", "accompanying materials", 92, 0.98),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v ?)?2(?: 0)?", "accompanying materials", 92, 0.98),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common development", 92, 0.98),
    ("eupl", "licen[sc]ed under the eupl", "eupl", 92, 0.95),
    ("artistic", "this package is free software you can redistribute it and or modify it under the same terms as perl itself", "perl itself", 80, 0.8),
    ("artistic", "under the terms of the artistic licen[sc]e", "artistic", 92, 0.95),
    ("boost", "distributed under the boost software licen[sc]e version 1 0", "boost", 92, 0.98),
    ("boost", "boost org licen[sc]e 1 0", "boost org", 93, 0.95),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "granted to anyone", 80, 0.95),
    ("zlib", "altered source versions must be plainly marked as such", "altered source", 79, 0.9),
    ("wtfpl", "you just do what the fuck you want to", "do what the", 80, 0.95),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 80, 0.95),
    ("cc0", "to the extent possible under law [^ ]+(?: [^ ]+){0,12} has waived all copyright and related (?:or|and) neighbou?ring rights", "under law", 80, 0.95),
    ("cc-by", "this work is licen[sc]ed under a creative commons attribution [1-4] [05] international licen[sc]e", "creative commons", 92, 0.98),
    ("cc-by-sa", "this work is licen[sc]ed under a creative commons attribution share ?alike [1-4] [05] international licen[sc]e", "creative commons", 92, 0.98),
    ("cc-by-nc", "this work is licen[sc]ed under a creative commons attribution non ?commercial [1-4] [05] international licen[sc]e", "creative commons", 92, 0.98),
    ("cc-by-nd", "this work is licen[sc]ed under a creative commons attribution no ?deriv(?:s|atives) [1-4] [05] international licen[sc]e", "creative commons", 92, 0.98),
    ("ofl", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", "font software", 92, 0.98),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl project", 80, 0.9),
    ("python", "python software foundation licen[sc]e version 2", "python software", 92, 0.95),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement", 81, 0.95),
    ("odbl", "this [^ ]+(?: [^ ]+){0,8} is made available under the open database licen[sc]e", "open database", 92, 0.95),
    ("pddl", "opendatacommons org licen[sc]es pddl", "opendatacommons", 95, 0.95),
    ("odc-by", "opendatacommons org licen[sc]es by", "opendatacommons", 95, 0.95),
    ("odbl", "opendatacommons org licen[sc]es odbl", "opendatacommons", 95, 0.95),
    ("public-domain", "this (?:work|file|software|document) is (?:in|hereby placed in) the public domain", "public domain", 72, 0.85),
    ("public-domain", "no copyright is claimed", "no copyright", 60, 0.6),
    ("public-domain", "copyright has expired", "copyright has", 60, 0.5),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: [^ ]+){0,12} (?:is )?(?:strictly )?prohibited", "unauthori", 46, 0.6),
    ("proprietary", "may not be (?:copied|reproduced|distributed|used)(?: [^ ]+){0,10} without (?:the )?(?:prior |express |written )*permission", "may not be", 45, 0.6),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", "no part of this", 46, 0.6),
    ("proprietary", "proprietary and confidential|confidential and proprietary", "proprietary", 45, 0.6),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 10, 0.3),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    priority: int
    score: float


def _compiled(pattern: str) -> re.Pattern[bytes]:
    """A pattern over words with a space before each and after the last; its group is what comes before the place."""
    before, at, own = pattern.rpartition(" @ ")
    return re.compile(f" ({before + at[:1]})(?:{own})(?= )".encode())


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules: each license in each kind of mention, and the licenses' texts; first those of the highest priority."""
    made = []
    # Longer names first: of two that fit a place in a list the longer one is passed over as a whole.
    some = sorted((name for _, name, _, _ in _LICENSES), key=len, reverse=True)
    any_name, any_id = "|".join(some), "|".join(sorted((spdx for _, _, spdx, _ in _LICENSES), key=len, reverse=True))
    for label, name, spdx, keyword in _LICENSES:
        for mention, gate, priority, score in _MENTIONS:
            # Of two names that fit the same place the longer one counts, so it needs no priority of its own.
            made.append((label, mention.format(n=name, s=spdx, a=any_name, i=any_id), (gate, keyword), priority, score))
        if label in _ALONE_FOR:
            pattern, priority, score = _ALONE
            made.append((label, pattern.format(n=_VERSIONED.get(label, name)), (keyword or label.partition("-")[0],), priority, score))
    made += [(label, pattern, (keyword,), priority, score) for label, pattern, keyword, priority, score in _TEXTS]
    out = [Rule(label, _compiled(pattern), tuple(k.encode() for k in keywords if k), priority, score) for label, pattern, keywords, priority, score in made]
    return sorted(out, key=lambda r: -r.priority)


#: Without one of these no rule can match: the text isn't searched.
GATES = tuple(x.encode() for x in ("licen", "spdx", "under the", "under ", "terms of", "conditions of", "see ", "read ", "refer to", "hereby granted", "redistribut", "advertising materials", "neither the name", "apache org", "unencumbered", "as is", "public domain", "creativecommons", "proprietary", "all rights reserved", "gpl", "mpl", "epl", "bsd", "cc0", "mit 0", "gnu org", "mozilla org", "boost org", "opensource org", "opendatacommons", "altered source", "granted to anyone", "anyone is free", "do what the", "under law", "received a copy", "permission notice", "perl itself", "no copyright", "copyright has", "unauthori", "may not be", "no part of this", "accompanying materials", "includes software", "common development", "governed by"))


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    label: str
    priority: int
    score: float


def normalize(text: bytes | None) -> tuple[bytes, int]:
    """The words of a text, lower-cased, with a space before, between and after them; and their number."""
    words = (text or b"").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def suppress(found: list[Match]) -> list[Match]:
    """Matches in order of priority, then length; one whose interval lies in a kept one's is left out."""
    starts = {x: i + 1 for i, x in enumerate(sorted({m.start for m in found}))}
    reach = [-1] * (len(starts) + 1)  # a Fenwick tree: the farthest end of kept matches by their start
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.priority, m.start - m.end, m.start, m.label)):
        at, farthest = starts[m.start], -1
        while at:
            farthest, at = max(farthest, reach[at]), at & (at - 1)
        if farthest < m.end:
            kept.append(m)
            at = starts[m.start]
            while at <= len(starts):
                reach[at], at = max(reach[at], m.end), at + (at & -at)
    return sorted(kept, key=lambda m: (m.start, m.end, m.label))


def scan(text: bytes | None) -> tuple[int, list[tuple[int, str]], list[Match]]:
    """(number of words, base places as (first word, label), matches of the rules that aren't suppressed).

    Words are those of the lower-cased text: runs of digits, letters and all characters above ASCII.
    """
    joined, n = normalize(text)
    places = []
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at, word, last = joined.find(needle), 0, 0
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            places.append((word, label))
            at = joined.find(needle, at + 1)
    found = []
    if any(g in joined for g in GATES):
        held: dict[bytes, bool] = {}

        def holds(k: bytes) -> bool:
            if k not in held:
                held[k] = k in joined
            return held[k]

        for r in rules():
            if all(holds(k) for k in r.keywords):
                start = last = 0
                for m in r.pattern.finditer(joined):
                    start, last = start + joined.count(b" ", last, m.start()), m.start()
                    found.append(Match(start + m[1].count(b" "), start + m[0].count(b" "), r.label, r.priority, r.score))
    return n, sorted(places), suppress(found)


def scan_licenses(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(__row, id, n_words, places, matches, score): places of the base phrases as (word, label), matches of the rules
    as (start, end, label, priority, score) in words, end exclusive, and the best score of all (1 for a base phrase).

    Each rule runs only on texts that hold its keywords. Of overlapping detections one that lies within another of
    higher priority, or of the same and longer, is suppressed; base phrases never are. A text is scanned alone, so
    nothing is shuffled. Null texts have no words; repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scan(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            places = pa.array([[{"word": w, "label": x} for w, x in p] for _, p, _ in made], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])))
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("score", pa.float64())]))
            matches = pa.array([[m.__dict__ for m in ms] for _, _, ms in made], kinds)
            score = pa.array([max([1.0 if p else 0.0, *(m.score for m in ms)]) for _, p, ms in made], pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([n for n, _, _ in made], pa.int64()), places, matches, score], names=[ROW, "id", "n_words", "places", "matches", "score"])

    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return by_batches(of, work, f"{ROW} long, id {df.schema[id].dataType.simpleString()}, n_words long, places array<struct<word:long,label:string>>, matches array<struct<start:long,end:long,label:string,priority:int,score:double>>, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    out = scan_licenses(documents(spark, sf_dir))
    word = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("matches", lambda m: m["label"]))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"), listed(base).alias("base_labels"), listed(every).alias("labels"), "score")


def _sql_pattern(r: Rule) -> str:
    """A rule's pattern for RE2, which can't look ahead: words have two spaces between them there, and a match takes one
    on either side."""
    held = r.pattern.pattern.decode().removeprefix(" ").removesuffix("(?= )").replace("[^ ]", "\1").replace(" ?", "\2").replace(" ", "  ")
    return " " + held.replace("\1", "[^ ]").replace("\2", "(?:  )?") + " "


def sql() -> str:
    """All rules in DuckDB's SQL. A match is left out if one that comes before it, by priority and length, holds it: what
    holds that one holds both, so it needn't be known which are kept."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    made = [(i, r.label, r.priority, r.score, _sql_pattern(r)) for i, r in enumerate(rules())]
    made += [(len(made) + i, label, -1, 1.0, " ()" + phrase.replace(" ", "  ") + " ") for i, (phrase, label) in enumerate(BASE)]
    listed = ", ".join(f"({i}, {q(label)}, {priority}, {score}::double, {q(pattern)})" for i, label, priority, score, pattern in made)
    hits = " union all ".join(f"select r, {i} as rule from docs where regexp_matches(j, {q(pattern)})" for i, _, _, _, pattern in made)
    return f"""with words as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
docs as (select *, '  ' || array_to_string(w, '  ') || '  ' as j from words),
rules(rule, label, priority, score, pattern) as (values {listed}),
hits as ({hits}),
parts as (select r, rule, label, priority, score, regexp_extract_all(j, pattern) as ms, regexp_extract_all(j, pattern, 1) as gs, string_split_regex(j, pattern) as ps from hits join rules using (rule) join docs using (r)),
found as (select r, label, priority, score, len(regexp_extract_all(array_to_string(list_transform(range(1, n), lambda i: ps[i] || ms[i]), '') || ps[n] || gs[n], '[^ ]+')) as a, len(regexp_extract_all(ms[n], '[^ ]+')) - len(regexp_extract_all(gs[n], '[^ ]+')) as size from (select *, unnest(range(1, len(ms) + 1)) as n from parts)),
kept as (select * from found m where priority < 0 or not exists (select 1 from found k where k.r = m.r and k.priority >= 0 and k.a <= m.a and m.a + m.size <= k.a + k.size
  and (k.priority > m.priority or (k.priority = m.priority and (k.size > m.size or (k.size = m.size and (k.a < m.a or (k.a = m.a and k.label < m.label)))))))),
told as (select r, count(*) filter (where priority < 0) as n_base, min(a) filter (where priority < 0) as first_word, max(a) filter (where priority < 0) as last_word, string_agg(distinct label, ',' order by label) filter (where priority < 0) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score from kept group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from docs left join told using (r)"""
