"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a hand-written regular expression over the lower-cased bytes of a text, with a label, a
priority, a relevance and the keywords without which it cannot match. One multi-string automaton
pass finds the keywords; only rules whose keywords all occur are run. Detections then go in order
of priority, and one whose byte interval lies within an accepted interval is suppressed, so that
"bsd 3 clause" wins over the bare "bsd" inside it. Base rules are never suppressed.

Cases: a null or empty text has no words, no detections and score 0; rows are independent, so
repeated rows give repeated results; a null doc_id is passed through; an empty table gives no rows; of rules
that tie in priority and length the one listed first goes first; very long texts are read whole, in time that grows with their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockweave.llm.common import map_slices

_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_LEFT, _RIGHT = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
#: Bytes of words stay, all others become spaces.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

# Phrase and label of the base rules.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Hand-written names by label. In a pattern a blank stands for any run of non-word characters,
# a word in brackets may be missing, and {v} stands for a version such as 2, 2.0 or "version 2".
NAMES: dict[str, list[str]] = {
    "mit": ["mit license", "expat license", "license mit", "mit x11 license"],
    "mit-0": ["mit no attribution", "mit 0 license"],
    "apache-2": ["apache license {2}", "apache {2}", "asl {2}", "apache software license {2}"],
    "apache-1.1": ["apache license {1 1}", "apache software license {1 1}"],
    "gpl-2": ["gnu general public license {2}", "gnu gpl {2}", "gpl {2}", "gplv2"],
    "gpl-3": ["gnu general public license {3}", "gnu gpl {3}", "gpl {3}", "gplv3"],
    "lgpl-2.1": ["gnu lesser general public license {2 1}", "lgpl {2 1}", "lgplv2 1"],
    "lgpl-3": ["gnu lesser general public license {3}", "lgpl {3}", "lgplv3"],
    "agpl-3": ["gnu affero general public license {3}", "agpl {3}", "agplv3"],
    "gfdl-1.3": ["gnu free documentation license {1 3}", "gfdl {1 3}"],
    "bsd-2": ["bsd 2 clause [license]", "2 clause bsd", "simplified bsd license", "freebsd license"],
    "bsd-3": ["bsd 3 clause [license]", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license"],
    "bsd-4": ["bsd 4 clause [license]", "4 clause bsd", "original bsd license"],
    "0bsd": ["zero clause bsd", "bsd zero clause", "0bsd license"],
    "bsd": ["bsd license", "bsd style license", "berkeley software distribution license"],
    "mpl-2": ["mozilla public license {2}", "mpl {2}"],
    "mpl-1.1": ["mozilla public license {1 1}", "mpl {1 1}"],
    "epl-2": ["eclipse public license {2}", "epl {2}"],
    "epl-1": ["eclipse public license {1}", "epl {1}"],
    "cddl": ["common development and distribution license", "cddl license", "cddl {1}"],
    "cpl-1": ["common public license {1}"],
    "eupl-1.2": ["european union public licen[cs]e {1 2}", "eupl {1 2}"],
    "artistic-2": ["artistic license {2}"],
    "artistic-1": ["artistic license {1}", "perl artistic license"],
    "isc": ["isc license", "internet systems consortium license"],
    "zlib": ["zlib license", "zlib libpng license"],
    "boost-1": ["boost software license", "bsl 1 0 boost"],
    "unlicense": ["the unlicense", "released into the public domain under the unlicense"],
    "wtfpl": ["wtfpl license", "do what the fuck you want to public license", "wtfpl {2}"],
    "postgresql": ["postgresql license"],
    "python-2": ["python software foundation license", "psf license"],
    "ruby": ["ruby license"],
    "php-3": ["php license {3}"],
    "openssl": ["openssl license", "ssleay license"],
    "vim": ["vim license"],
    "beerware": ["beerware license", "beer ware license"],
    "json": ["json license", "shall be used for good not evil"],
    "ofl-1.1": ["sil open font license", "open font license {1 1}"],
    "ms-pl": ["microsoft public license", "ms pl license"],
    "ms-rl": ["microsoft reciprocal license", "ms rl license"],
    "ncsa": ["university of illinois ncsa open source license", "ncsa license"],
    "upl-1": ["universal permissive license"],
    "bsl-1.1": ["business source license {1 1}", "busl {1 1}"],
    "sspl-1": ["server side public license", "sspl {1}"],
    "elastic-2": ["elastic license {2}"],
    "odbl": ["open database license", "odc odbl"],
    "odc-by": ["open data commons attribution license", "odc by"],
    "pddl": ["public domain dedication and license", "odc pddl"],
    "cc0": ["cc0 1 0", "cc0 license", "creative commons zero"],
    "cc-by": ["cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0", "creative commons attribution {4}", "creative commons attribution {3}"],
    "cc-by-sa": ["cc by sa", "creative commons attribution share ?alike", "attribution sharealike {4}"],
    "cc-by-nd": ["cc by nd", "creative commons attribution no ?deriv(?:ative)?s", "attribution noderivatives {4}"],
    "cc-by-nc": ["creative commons attribution non ?commercial", "attribution noncommercial {4}", "cc by nc [4 0]"],
    "cc-by-nc-sa": ["cc by nc sa", "attribution non ?commercial share ?alike"],
    "cc-by-nc-nd": ["cc by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"],
    "llama": ["llama 2 community license", "llama 3 community license"],
    "openrail": ["openrail m license", "creativeml open rail m", "bigscience rail license"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "licensed material property of", "no part of this work may be reproduced"],
    "public-domain": ["in the public domain", "public domain dedication", "released to the public domain"],
    "gpl": ["gnu general public license", "gnu gpl", "under the gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "apache": ["apache license", "apache software license"],
    "cc": ["creative commons license", "creative commons public license"],
}
# Openings that make a mention a grant: they raise relevance and priority.
GRANTS = ["licensed under [the]", "released under [the]", "distributed under [the terms of the]", "available under [the]", "published under [the]", "spdx license identifier"]
# Texts of licences that never name themselves, and links to the texts.
BODIES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "opensource org licenses mit"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3", "neither the name of [the] [^ ]* nor the names of its contributors"),
    ("bsd-4", "all advertising materials mentioning features or use of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("apache-2", "www apache org licenses license 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("gpl", "www gnu org licenses gpl"),
    ("lgpl", "this library is free software you can redistribute it and or modify"),
    ("lgpl", "www gnu org licenses lgpl"),
    ("agpl", "www gnu org licenses agpl"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", "mozilla org mpl 2 0"),
    ("boost-1", "www boost org license 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creativecommons org licenses by [1-4]"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc0", "creativecommons org publicdomain zero"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("cc0", "has waived all copyright and related or neighboring rights to"),
    ("cc", "this work is licensed under a creative commons"),
    ("python-2", "psf is making python available to licensee on an as is basis"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("public-domain", "this work has been identified as being free of known restrictions under copyright law"),
]
# Identifiers by label, as they stand after "SPDX-License-Identifier:"; a blank stands for any run of non-word characters.
IDENTIFIERS: dict[str, list[str]] = {
    "mit": ["mit", "x11"],
    "mit-0": ["mit 0"],
    "apache-2": ["apache 2 0"],
    "apache-1.1": ["apache 1 1"],
    "gpl-2": ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "gpl-3": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "lgpl-2.1": ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    "lgpl-3": ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "agpl-3": ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "gfdl-1.3": ["gfdl 1 3", "gfdl 1 3 only", "gfdl 1 3 or later"],
    "bsd-2": ["bsd 2 clause"],
    "bsd-3": ["bsd 3 clause"],
    "bsd-4": ["bsd 4 clause"],
    "0bsd": ["0bsd"],
    "mpl-2": ["mpl 2 0"],
    "mpl-1.1": ["mpl 1 1"],
    "epl-2": ["epl 2 0"],
    "epl-1": ["epl 1 0"],
    "cddl": ["cddl 1 0", "cddl 1 1"],
    "cpl-1": ["cpl 1 0"],
    "eupl-1.2": ["eupl 1 2"],
    "artistic-2": ["artistic 2 0"],
    "artistic-1": ["artistic 1 0"],
    "isc": ["isc"],
    "zlib": ["zlib"],
    "boost-1": ["bsl 1 0"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl"],
    "postgresql": ["postgresql"],
    "python-2": ["psf 2 0", "python 2 0"],
    "ruby": ["ruby"],
    "php-3": ["php 3 0", "php 3 01"],
    "openssl": ["openssl"],
    "vim": ["vim"],
    "beerware": ["beerware"],
    "json": ["json"],
    "ofl-1.1": ["ofl 1 1"],
    "ms-pl": ["ms pl"],
    "ms-rl": ["ms rl"],
    "ncsa": ["ncsa"],
    "upl-1": ["upl 1 0"],
    "bsl-1.1": ["busl 1 1"],
    "sspl-1": ["sspl 1 0"],
    "elastic-2": ["elastic 2 0"],
    "odbl": ["odbl 1 0"],
    "odc-by": ["odc by 1 0"],
    "pddl": ["pddl 1 0"],
    "cc0": ["cc0 1 0"],
    "cc-by": ["cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0"],
    "cc-by-sa": ["cc by sa 1 0", "cc by sa 2 0", "cc by sa 2 5", "cc by sa 3 0", "cc by sa 4 0"],
    "cc-by-nd": ["cc by nd 1 0", "cc by nd 2 0", "cc by nd 2 5", "cc by nd 3 0", "cc by nd 4 0"],
    "cc-by-nc": ["cc by nc 1 0", "cc by nc 2 0", "cc by nc 2 5", "cc by nc 3 0", "cc by nc 4 0"],
    "cc-by-nc-sa": ["cc by nc sa 1 0", "cc by nc sa 2 0", "cc by nc sa 2 5", "cc by nc sa 3 0", "cc by nc sa 4 0"],
    "cc-by-nc-nd": ["cc by nc nd 1 0", "cc by nc nd 2 0", "cc by nc nd 2 5", "cc by nc nd 3 0", "cc by nc nd 4 0"],
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: bytes
    keywords: tuple[bytes, ...]
    priority: int
    relevance: float
    base: bool = False


def _compile(words: str) -> tuple[bytes, tuple[bytes, ...]]:
    """A phrase in the notation above as a pattern and the plain words that it cannot do without."""
    spelled = re.sub(r"\{([^}]*)\}", lambda m: r"(?:v|version )?" + m[1] + ("" if " " in m[1] else r"(?: 0)?"), words)
    parts, keys = [], []
    for word in re.split(r" (?![?0)])", spelled):
        if re.fullmatch(r"\[[a-z 0-9]+\]", word):
            parts.append(("(?:" + word[1:-1] + " )?", True))
            continue
        parts.append((word, False))
        keys += [word] if re.fullmatch(r"[a-z0-9]{2,}", word) else []
    text = ""
    for part, optional in parts:
        text += part if optional else part + " "
    text = text.rstrip().replace(" ?", "\x00")
    body = text.encode().replace(b"\x00", b"(?:" + _SEP + b")?").replace(b" ", _SEP)
    return _LEFT + body + _RIGHT, tuple(dict.fromkeys(k.encode() for k in keys))


def rules() -> list[Rule]:
    """All rules in order: base, grants of named licences, bodies and links, then bare names."""
    out = [Rule(label, _LEFT + _SEP.join(p.encode().split()) + _RIGHT, tuple(p.encode().split()), 0, 1.0, True) for p, label in BASE.items()]

    def add(label: str, phrase: str, priority: int, relevance: float) -> None:
        # optional words are written out, one rule each
        if m := re.search(r"\[([a-z0-9 ]{3,})\]", phrase):
            for inner in (m[1] + " ", ""):
                add(label, (phrase[: m.start()] + inner + phrase[m.end() :].lstrip()).strip(), priority, relevance)
            return
        pattern, keys = _compile(phrase)
        out.append(Rule(label, pattern, keys, priority, relevance))

    for label, names in NAMES.items():
        for name in names:
            for grant in GRANTS:
                add(label, f"{grant} {name}", 1, 0.99)
            add(label, name, 3, 0.8)
    for label, names in IDENTIFIERS.items():
        for name in names:
            add(label, f"spdx license identifier {name}", 1, 0.99)
            # the second identifier of an expression, "MIT OR Apache-2.0", is a detection of its own: the group
            body = b"spdx" + _SEP + b"license" + _SEP + rb"identifier[: \t(]+[0-9a-z.+-]+[ \t]+(?:or|and)[ \t]+(" + _SEP.join(name.encode().split()) + b")"
            out.append(Rule(label, _LEFT + body + _RIGHT, tuple(dict.fromkeys([b"spdx", b"identifier", *(w.encode() for w in name.split() if len(w) > 1)])), 1, 0.99))
    for label, phrase in BODIES:
        add(label, phrase, 2, 0.95)
    return sorted(dict.fromkeys(out), key=lambda r: (r.priority, -len(r.pattern)))


class Scanner:
    """Keyword automaton plus compiled rules, built once a task."""

    def __init__(self, ordered: list[Rule] | None = None):
        import ahocorasick

        self.rules = ordered or rules()
        # Every rule needs one word that is rare in prose; the longest of its keywords is its trigger.
        self.trigger: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.trigger.setdefault(max(r.keywords, key=len) if r.keywords else b"", []).append(i)
        self.always = self.trigger.pop(b"", [])
        self.automaton = ahocorasick.Automaton()
        for w in self.trigger:
            self.automaton.add_word(w.decode("latin-1"), w)
        self.automaton.make_automaton()
        self.compiled: dict[int, re.Pattern] = {}

    def detections(self, raw: bytes) -> list[tuple[int, int, Rule]]:
        """Accepted detections of a lower-cased text as (start byte, end byte, rule)."""
        hit = {w for _, w in self.automaton.iter(raw.decode("latin-1"))}
        picked = sorted({i for w in hit for i in self.trigger[w]} | set(self.always))
        found: list[tuple[int, int, int]] = []
        for i in picked:
            if all(k in hit or k in raw for k in self.rules[i].keywords):
                pattern = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(self.rules[i].pattern))
                found += [(i, *m.span(m.lastindex or 0)) for m in pattern.finditer(raw)]
        found.sort(key=lambda d: (self.rules[d[0]].priority, d[1] - d[2], d[0]))
        kept: list[tuple[int, int, Rule]] = []
        reach = _Reach([a for _, a, _ in found])
        for i, a, b in found:
            rule = self.rules[i]
            if rule.base or reach.of(a) < b:
                kept.append((a, b, rule))
                reach.add(a, b)
        return kept


class _Reach:
    """How far intervals that begin at or before a place reach: prefix maxima in a tree over the sorted starts."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.most = [0] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start) + 1
        while k < len(self.most):
            self.most[k] = max(self.most[k], end)
            k += k & -k

    def of(self, start: int) -> int:
        k, out = bisect_left(self.starts, start) + 1, 0
        while k:
            out = max(out, self.most[k])
            k -= k & -k
        return out


def scan_text(scanner: Scanner, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    kept = scanner.detections(raw)
    if not kept:
        return len(raw.translate(_WORDS).split()), 0, None, None, "", "", 0.0, []
    # starts of words; a place's word is the number of starts before it
    word = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    order = sorted(kept, key=lambda k: k[:2])
    first, after = (np.searchsorted(begins, [k[j] for k in order]).tolist() for j in (0, 1))
    starts = [w for (_, _, r), w in zip(order, first, strict=True) if r.base]
    miss = 1.0
    for _, _, r in kept:
        miss *= 1 - r.relevance
    spans = [{"label": r.label, "start_word": w, "n_words": e - w, "relevance": r.relevance} for (_, _, r), w, e in zip(order, first, after, strict=True)]
    base = ",".join(sorted({r.label for _, _, r in kept if r.base}))
    return len(begins), len(starts), min(starts, default=None), max(starts, default=None), base, ",".join(sorted({r.label for _, _, r in kept})), 1 - miss, spans


class _Scan:
    def start(self):
        scanner = Scanner()

        def run(cols: dict[str, list]) -> dict[str, list]:
            got = [scan_text(scanner, t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {n: [g[i] for g in got] for i, n in enumerate(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"))}

        return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Detections of every whole text. Narrow: one pass, no shuffle; memory is one slice of rows."""
    spans = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("relevance", pa.float64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", spans)])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start_word:long,n_words:long,relevance:double>>"
    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), _Scan(), schema, arrow)
