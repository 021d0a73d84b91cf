"""License scan by ordered signature rules.

A text is read as lower-case words. Some hundreds of regular expressions over the words, each with a keyword that any
of its matches contains, are tried in their order of priority; a rule runs only where its keyword stands in the text.
A detection that lies within the words of one of higher priority is suppressed. The base phrases are found besides,
and no detection suppresses them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Phrase (its words in a row) to label (fixed values).
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Signature:
    """``regex`` is over words with one space between them; ``keyword`` is part of each match; ``weight`` is how sure a match is.

    If ``regex`` has a group ``id``, the detection is that group's words.
    """

    label: str
    regex: str
    keyword: str
    weight: float


#: Whole clauses that only one license has: first in priority.
CLAUSES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice shall", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "distribute this software", 1.0),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose is hereby granted", "distribute this software", 0.9),
    ("bsd-3-clause", r"neither the name of (?:\w+ ){1,12}?nor the names of (?:its|the) contributors may be used to endorse", "neither the name", 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials", 1.0),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice", "redistributions of source", 0.8),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 0.8),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "provided as is", 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software", 1.0),
    ("wtfpl", r"do what the fuck you want to", "what the fuck you", 1.0),
    ("gpl-any", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can", 0.9),
    ("lgpl-any", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "free software you can", 0.9),
    ("agpl-3", r"if you modify the program your modified version must prominently offer all users interacting with it remotely", "interacting with it remotely", 1.0),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", "source code form", 1.0),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache license", 1.0),
    ("boost-1", r"distributed under the boost software license version 1 0", "boost software license", 1.0),
    ("eclipse-1", r"made available under the terms of the eclipse public license v(?:ersion)? 1 0", "eclipse public license", 1.0),
    ("eclipse-2", r"made available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0", "eclipse public license", 1.0),
    ("artistic-2", r"artistic license 2 0", "artistic license", 1.0),
    ("python-2", r"python software foundation license version 2", "python software foundation", 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "software and its documentation", 0.9),
    ("cc0-1", r"to the extent possible under law (?:\w+ ){1,12}?has waived all copyright", "waived all copyright", 1.0),
    ("ofl-1-1", r"this font software is licensed under the sil open font license version 1 1", "open font license", 1.0),
    ("all-rights-reserved", r"all rights reserved(?: worldwide)?", "all rights reserved", 0.5),
    ("public-domain", r"(?:dedicated to|released into|placed in|is in) the public domain", "the public domain", 0.8),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 0.7),
    ("non-commercial", r"for (?:personal and )?non commercial (?:use|purposes) only", "non commercial", 0.6),
)

#: Families: label stem, names, versions ("" for any version) (fixed values). Rules for each name, version and wording follow from them.
FAMILIES = (
    ("apache", ("apache license", "apache software license", "apache public license"), ("1 0", "1 1", "2 0", "2", "")),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1 0", "2 0", "3 0", "1", "2", "3", "")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2 0", "2 1", "3 0", "2", "3", "")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1 0", "3 0", "3", "")),
    ("fdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3", "")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0", "2", "")),
    ("eclipse", ("eclipse public license", "epl"), ("1 0", "2 0", "")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1", "")),
    ("cpl", ("common public license",), ("1 0", "")),
    ("boost", ("boost software license",), ("1 0", "")),
    ("artistic", ("artistic license",), ("1 0", "2 0", "")),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1", "")),
    ("osl", ("open software license",), ("1 0", "2 0", "2 1", "3 0", "")),
    ("afl", ("academic free license",), ("1 1", "1 2", "2 0", "2 1", "3 0", "")),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2", "")),
    ("odbl", ("open database license", "odbl"), ("1 0", "")),
    ("mit", ("mit license", "mit licence", "expat license"), ("",)),
    ("bsd", ("bsd license", "bsd licence", "bsd style license"), ("",)),
    ("bsd-2-clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license"), ("",)),
    ("bsd-3-clause", ("bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license"), ("",)),
    ("isc", ("isc license", "isc licence"), ("",)),
    ("zlib", ("zlib license", "zlib libpng license"), ("",)),
    ("unlicense", ("the unlicense", "unlicense org"), ("",)),
    ("cecill", ("cecill",), ("1", "1 1", "2", "2 1", "b", "c", "")),
    ("ms-pl", ("microsoft public license", "ms pl"), ("",)),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), ("",)),
    ("psf", ("python software foundation license",), ("2", "")),
    ("w3c", ("w3c software notice and license", "w3c license"), ("",)),
    ("ecl", ("educational community license",), ("1 0", "2 0", "")),
    ("upl", ("universal permissive license",), ("1 0", "")),
    ("rail", ("responsible ai license", "openrail m", "openrail"), ("",)),
)
#: The SPDX ids of families without their versions, as words (fixed values); "rail" and the unnumbered "bsd" have none.
SPDX_IDS = {
    "apache": ("apache",), "gpl": ("gpl",), "lgpl": ("lgpl",), "agpl": ("agpl",), "fdl": ("gfdl",), "mpl": ("mpl",), "eclipse": ("epl",),
    "cddl": ("cddl",), "cpl": ("cpl",), "boost": ("bsl",), "artistic": ("artistic",), "ofl": ("ofl",), "osl": ("osl",), "afl": ("afl",), "eupl": ("eupl",),
    "odbl": ("odbl",), "mit": ("mit",), "bsd-2-clause": ("bsd 2 clause",), "bsd-3-clause": ("bsd 3 clause",), "isc": ("isc",), "zlib": ("zlib",),
    "unlicense": ("unlicense",), "cecill": ("cecill",), "ms-pl": ("ms pl",), "ms-rl": ("ms rl",), "psf": ("psf",), "w3c": ("w3c",), "ecl": ("ecl",), "upl": ("upl",),
}
#: SPDX ids of licenses that are no family: label, id.
SPDX_SINGLE = (("mit-0", "mit 0"), ("0bsd", "0bsd"), ("bsd-1-clause", "bsd 1 clause"), ("bsd-4-clause", "bsd 4 clause"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("cc0-1", "cc0 1 0"), ("python-2", "python 2 0"))
#: Further words of SPDX expressions, such as "(GPL-2.0-only WITH Classpath-exception-2.0 OR MIT)".
SPDX_WORDS = ("and", "or", "only", "later", "with", "exception", "classpath", "linux", "syscall", "note", "llvm", "gcc", "cc", "by", "nc", "nd", "sa")
CREATIVE, CREATIVE_VERSIONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0", "")
CREATIVE_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}


def signatures() -> tuple[Signature, ...]:
    """All rules in order of priority: whole clauses, tag lines, grants of a named license, then bare names; longer names and exact versions first."""
    grant = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"
    vocabulary = {w for ids in SPDX_IDS.values() for i in ids for w in i.split()} | {w for _, i in SPDX_SINGLE for w in i.split()} | set(SPDX_WORDS)
    in_expression = rf"spdx license identifier (?:(?:(?:{'|'.join(sorted(vocabulary))}|\d+) ){{1,24}}?(?:and|or) )??"
    tags, grants, bare = [], [], []
    for label, name in SPDX_SINGLE:
        tags.append(Signature(label, rf"{in_expression}(?P<id>{name}(?: or later)?)", "spdx license", 1.0))
    for stem, names, versions in FAMILIES:
        for name in SPDX_IDS.get(stem, ()):
            for v in versions:
                label = "-".join([stem, *v.split()]).removesuffix("-0") if v else stem
                tags.append(Signature(label, rf"{in_expression}(?P<id>{f'{name} {v}'.strip()}(?: or later)?)", "spdx license", 1.0))
        for name in names:
            for v in versions:
                label = "-".join([stem, *v.split()]).removesuffix("-0") if v else stem
                tail = rf",? ?(?:v(?:ersion)? ?)?{v}(?: or (?:any )?later(?: version)?)?" if v else ""
                body = f"{name}{tail}"
                tags.append(Signature(label, rf"spdx license identifier {body}", "spdx license", 1.0))
                grants.append(Signature(label, grant + body, name, 0.95))
                bare.append(Signature(label, body, name, 0.8 if v else 0.6))
    for kind in CREATIVE:
        for v in CREATIVE_VERSIONS:
            label, parts = "-".join(["cc", *kind.split(), *v.split()]).removesuffix("-0"), kind.split()
            tail = f" (?:international )?{v}" if v else ""
            words = " ".join(CREATIVE_WORDS[p] for p in parts)
            tags.append(Signature(label, rf"spdx license identifier cc {kind}{tail}", "spdx license", 1.0))
            tags.append(Signature(label, rf"creativecommons org licenses {kind}" + (f" {v}" if v else ""), "creativecommons org", 1.0))
            grants.append(Signature(label, rf"{grant}(?:a )?(?:creative commons )?cc {kind}{tail}", "cc by", 0.95))
            bare.append(Signature(label, rf"creative commons {words}(?: license)?{tail}", "creative commons attribution", 0.85))
            bare.append(Signature(label, rf"cc {kind}{tail}", "cc by", 0.8 if v else 0.6))
    for name in ("cc0 1 0 universal", "creative commons zero", "cc0"):
        bare.append(Signature("cc0", name, name, 0.8))
    longest = lambda s: (-len(s.regex), s.label)
    return tuple([Signature(*c) for c in CLAUSES] + [s for part in (tags, grants, bare) for s in sorted(part, key=longest)])


#: Bytes of words (of UTF-8, lowered); any other byte parts words.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
TO_SPACE = bytes(c + 32 if 65 <= c < 91 else c if IS_WORD[c] else 32 for c in range(256))


class Scanner:
    def __init__(self, rules: tuple[Signature, ...] | None = None) -> None:
        rules = signatures() if rules is None else rules
        self.rules = [(s.label, re.compile(rf"(?<= ){s.regex}(?= )".encode()), s.weight) for s in rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for n, s in enumerate(rules):
            self.by_keyword.setdefault(f" {s.keyword}".encode(), []).append(n)
        self.base = [(f" {p} ".encode(), label) for p, label in BASE_PHRASES.items()]

    def scan(self, data: bytes) -> tuple:
        """What SCANNED says after doc_id, for UTF-8 bytes."""
        words = data.translate(TO_SPACE).split()
        text = b" " + b" ".join(words) + b" "
        spots, base_labels = [], set()
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                spots.append(at)
                base_labels.add(label)
                at = text.find(phrase, at + 1)
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) if spots else np.empty(0, np.int64)
        starts = np.searchsorted(spaces, spots)  # a word's number is that of the space before it
        found = Detections()
        for n in sorted({n for k, rules in self.by_keyword.items() if k in text for n in rules}):
            label, regex, weight = self.rules[n]
            group = "id" if "id" in regex.groupindex else 0
            found.add([m.span(group) for m in regex.finditer(text)], label, weight)
        labels = base_labels | set(found.labels)
        score = max([*found.labels.values(), 1.0 * bool(spots)])
        least, most = (int(starts.min()), int(starts.max())) if spots else (None, None)
        return len(words), len(spots), least, most, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


class Detections:
    """The detections that stand, each rule's in turn: one that lies within another of a rule before is suppressed.

    Spans are kept by start with the greatest end so far, so a rule's matches cost a search each and one merge.
    """

    def __init__(self) -> None:
        self.starts, self.ends = np.empty(0, np.int64), np.empty(0, np.int64)
        self.reach = self.ends  # the greatest end of the spans up to each
        self.labels: dict[str, float] = {}  # label: greatest weight

    def add(self, spans: list[tuple[int, int]], label: str, weight: float) -> None:
        if not spans:
            return
        start, end = np.array(spans, np.int64).T
        before = np.searchsorted(self.starts, start, side="right") - 1
        stands = (before < 0) | (self.reach[before] < end) if len(self.reach) else np.ones(len(start), bool)
        if stands.any():
            self.labels[label] = max(weight, self.labels.get(label, 0.0))
            starts, ends = np.concatenate([self.starts, start[stands]]), np.concatenate([self.ends, end[stands]])
            order = np.argsort(starts, kind="stable")
            self.starts, self.ends = starts[order], ends[order]
            self.reach = np.maximum.accumulate(self.ends)


def scan(docs: DataFrame, rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the words, the base phrases' places and labels, all labels and a score.

    The score is the greatest weight among the detections that stand (a base phrase weighs 1), 0 without any. A null
    text has no words; without a base phrase first_word and last_word are null and base_labels is empty. A text is
    scanned whole, whatever its length, in time linear in its words and detections for each rule. Rows that repeat are scanned each for itself; no row is moved to another task. Other columns don't matter; an empty table
    gives an empty result.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scanner = Scanner(rules)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scanner.scan(t or b"") for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in SCANNED.split(", ")])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), make, SCANNED)
