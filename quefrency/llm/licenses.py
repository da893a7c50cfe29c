"""License scans by ordered signature rules: hundreds of regexes over normalised words, gated by keywords, with priority
and interval containment deciding between overlapping detections.

A rule is one form of words (a tag, a grant, a URL, ...) around one license, or the wording of a license's own text. It
runs only on texts that hold all its keywords. A detection inside another one's interval goes, unless its form has the
higher priority: `GNU Lesser General Public License` is no detection of a license that is named by its last three words.
Base phrases are always reported, whatever contains them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.kernels import slices

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A-Z in lower case, every other ASCII character but digits and letters blank, all else as it is.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: A version behind a name, as words.
VERSION = r"(?: (?:public )?licen[cs]e)?(?:(?: version| ver| v)? v?\d+(?: \d+){0,2})?(?: or (?:\w+ )?(?:any )?(?:later|newer)(?: version)?| only)?"

# Label, keywords (each match holds all words of one of them), pattern of its identifiers, pattern of its names; all over words parted by one blank.
FAMILIES = (
    ("gpl", "general public|gpl", "gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)"),
    ("lgpl", "lesser general|library general|lgpl", "lgpl", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)"),
    ("agpl", "affero|agpl", "agpl", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)"),
    ("gfdl", "free documentation|gfdl|fdl", "gfdl", r"(?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)"),
    ("apache", "apache", "apache", r"apache(?: software)?(?: licen[cs]e)?"),
    ("mit", "mit", "mit", r"(?:the )?mit(?: expat| x11)?"),
    ("mit-0", "mit", "mit 0", r"mit (?:0|no attribution|zero)"),
    ("expat", "expat", "expat", r"expat"),
    ("x11", "x11", "x11", r"x11|mit x11|x consortium"),
    ("bsd-2-clause", "bsd|freebsd", "bsd 2 clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause"),
    ("0bsd", "bsd|0bsd", "0bsd", r"(?:zero|0) clause bsd|0bsd|bsd (?:0|zero) clause"),
    ("bsd", "bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc|internet systems", "isc", r"isc|internet systems consortium"),
    ("mpl", "mozilla|mpl", "mpl", r"mozilla public licen[cs]e|mpl"),
    ("epl", "eclipse|epl", "epl", r"eclipse public licen[cs]e|epl"),
    ("edl", "eclipse", "edl", r"eclipse distribution licen[cs]e"),
    ("cpl", "common public|cpl", "cpl", r"common public licen[cs]e|cpl"),
    ("cddl", "common development|cddl", "cddl", r"common development and distribution licen[cs]e|cddl"),
    ("cpal", "common public|cpal", "cpal", r"common public attribution licen[cs]e|cpal"),
    ("ipl", "ibm public|ipl", "ipl", r"ibm public licen[cs]e"),
    ("eupl", "european union|eupl", "eupl", r"european union public licen[cs]e|eupl"),
    ("artistic", "artistic", "artistic", r"(?:perl )?artistic(?: licen[cs]e)?"),
    ("bsl", "boost|bsl", "bsl", r"boost software licen[cs]e|bsl"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng(?: 2 0)?", r"libpng"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck|wtfpl", "wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl"),
    ("cc0", "creative commons|cc0|cc zero", "cc0", r"creative commons zero|cc0|cc zero"),
    ("cc-by", "creative commons|cc by|cc attribution|creativecommons org", "cc by", r"(?:creative commons|cc) (?:by|attribution)"),
    ("cc-by-sa", "creative commons|cc by|cc attribution|creativecommons org", "cc by sa", r"(?:creative commons|cc) (?:by sa|attribution share ?alike)"),
    ("cc-by-nd", "creative commons|cc by|cc attribution|creativecommons org", "cc by nd", r"(?:creative commons|cc) (?:by nd|attribution no ?deriv(?:ative|ative work)?s)"),
    ("cc-by-nc", "creative commons|cc by|cc attribution|creativecommons org", "cc by nc", r"(?:creative commons|cc) (?:by nc|attribution non ?commercial)"),
    ("cc-by-nc-sa", "creative commons|cc by|cc attribution|creativecommons org", "cc by nc sa", r"(?:creative commons|cc) (?:by nc sa|attribution non ?commercial share ?alike)"),
    ("cc-by-nc-nd", "creative commons|cc by|cc attribution|creativecommons org", "cc by nc nd", r"(?:creative commons|cc) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative|ative work)?s)"),
    ("odbl", "open database|odbl", "odbl", r"open database licen[cs]e|open data commons open database|odbl"),
    ("pddl", "public domain|pddl", "pddl", r"public domain dedication and licen[cs]e|pddl"),
    ("odc-by", "open data commons|odc by", "odc by", r"open data commons attribution|odc by"),
    ("ogl", "open government|ogl", "ogl(?: uk)?", r"open government licen[cs]e|ogl"),
    ("osl", "open software|osl", "osl", r"open software licen[cs]e|osl"),
    ("afl", "academic free|afl", "afl", r"academic free licen[cs]e|afl"),
    ("ecl", "educational community|ecl", "ecl", r"educational community licen[cs]e"),
    ("ms-pl", "microsoft|ms", "ms pl", r"(?:microsoft|ms) public licen[cs]e|ms pl"),
    ("ms-rl", "microsoft|ms", "ms rl", r"(?:microsoft|ms) reciprocal licen[cs]e|ms rl"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("psf", "python|psf", "(?:psf|python)(?: 2 0)?", r"python(?: software foundation)? licen[cs]e|psf licen[cs]e"),
    ("php", "php", "php", r"php licen[cs]e"),
    ("ruby", "ruby", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("w3c", "w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e"),
    ("icu", "icu", "icu", r"icu licen[cs]e"),
    ("unicode", "unicode", "unicode(?: dfs 20\\d\\d| 3 0)?", r"unicode(?: data files and software)? licen[cs]e"),
    ("ofl", "open font|ofl", "ofl", r"(?:sil )?open font licen[cs]e|ofl"),
    ("lppl", "latex|lppl", "lppl", r"latex project public licen[cs]e|lppl"),
    ("upl", "universal permissive|upl", "upl", r"universal permissive licen[cs]e|upl"),
    ("apsl", "apple|apsl", "apsl", r"apple public source licen[cs]e|apsl"),
    ("sspl", "server side|sspl", "sspl", r"server side public licen[cs]e|sspl"),
    ("busl", "business source|busl", "busl", r"business source licen[cs]e|busl"),
    ("elastic", "elastic", "elastic", r"elastic licen[cs]e"),
    ("polyform", "polyform", "polyform(?: \\w+)?", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use)"),
    ("commons-clause", "commons clause", "commons clause", r"commons clause"),
    ("cecill", "cecill", "cecill(?: [abc])?", r"cecill(?: [abc])?"),
    ("mulan", "mulan|mulanpsl", "mulanpsl", r"mulan (?:psl|permissive software licen[cs]e)|mulanpsl"),
    ("blueoak", "blue oak|blueoak", "blueoak", r"blue oak model licen[cs]e|blueoak"),
    ("vim", "vim", "vim", r"vim licen[cs]e"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("qpl", "q public|qpl", "qpl", r"q public licen[cs]e|qpl"),
    ("npl", "netscape|npl", "npl", r"netscape public licen[cs]e"),
    ("spl", "sun public|spl", "spl", r"sun public licen[cs]e"),
    ("zpl", "zope|zpl", "zpl", r"zope public licen[cs]e|zpl"),
    ("jython", "jython", "jython", r"jython licen[cs]e"),
    ("openrail", "openrail|rail", "(?:open ?rail|bigscience bloom rail)(?: m)?", r"open ?rail(?: m)?|(?:creativeml|bigscience)(?: bloom)? (?:open )?rail(?: m)?"),
    ("llama", "llama|llama2|llama3", "llama[23]?(?: \\d)?", r"llama[23]?(?: \d){0,2} community licen[cs]e"),
)

# Name, priority (lower decides), confidence, further keywords, pattern around the identifier {i} or name {n}, with the version {v}.
FORMS = (
    ("tag", 0, 1.0, "spdx", r"spdx(?: \w+)? license(?: \w+)? identifier (?:{i}){v}"),
    ("grant", 2, 0.95, "under|by|according|subject|accordance|terms", r"(?:licen[cs]ed|released|distributed|redistributed?|available|published|provided|offered|covered|governed|shared|modify it) (?:\w+ ){{0,3}}?(?:under|by|according to|subject to|in accordance with|the terms of)(?: the)?(?: (?:following )?terms(?: and conditions)? of)?(?: the| a| an)? (?:{n}){v}"),
    ("url", 3, 0.9, "org|choosealicense", r"(?:opensource org|spdx org|choosealicense com|creativecommons org|gnu org|apache org|mozilla org|eclipse org) (?:licen[cs]es?|legal|publicdomain|org documents)(?: licen[cs]e)? (?:{i}){v}"),
    ("field", 4, 0.85, "license|licence|licenses|licences", r"licen[cs]es?(?: name| type| id| text| is| under)? (?:the )?(?:{n}){v}"),
    ("name", 5, 0.8, "license|licence", r"(?:{n})(?:(?<= licen[cs]e)|(?: v?\d+(?: \d+){{0,2}}| version(?: \d+)+)?(?: international| unported| generic| public| style| software| open source)? licen[cs]e)(?:{v})"),
)

# Label, keyword, wording of a license's own text.
TEXTS = (
    ("mit", "granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification(?:s)? are permitted"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache", "apache org", r"(?:www )?apache org licenses license 2 0"),
    ("apache", "perpetual worldwide", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "free software you can redistribute", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general public", r"under the terms of the gnu lesser general public license"),
    ("agpl", "affero general public", r"under the terms of the gnu affero general public license"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", "boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("cc0", "waives all", r"waives all copyright and related or neighboring rights"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d \d)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: \d \d)?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d \d)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d \d)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d \d)?"),
    ("wtfpl", "want to", r"you just do what the fuck you want to"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation"),
    ("ncsa", "dealing with the software", r"to deal with the software without restriction including without limitation the rights"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution)(?: or (?:copying|reproduction|distribution))? of this (?:file|software|document|material)"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    gate: tuple[tuple[frozenset[bytes], ...], ...]  # of each of these, a text must hold all words of one
    pattern: re.Pattern


def _compiled(pattern: str) -> re.Pattern:
    # Over words with a blank on either side; the blank behind belongs to the next word.
    return re.compile(rf" (?:{pattern})(?= )".encode())


def _gate(keywords: str) -> tuple[frozenset[bytes], ...]:
    return tuple(frozenset(k.encode().split()) for k in keywords.split("|"))


def rules() -> list[Rule]:
    """All signature rules in order: of equal priority, the earlier one decides."""
    out = []
    for name, priority, confidence, word, form in FORMS:
        for label, keyword, ids, names in FAMILIES:
            gate = _gate(keyword), _gate(word)
            out.append(Rule(f"{name}:{label}", label, priority, confidence, gate, _compiled(form.format(i=ids, n=names, v=VERSION))))
    for n, (label, keyword, wording) in enumerate(TEXTS):
        out.append(Rule(f"text{n}:{label}", label, 1, 0.4 if label == "proprietary" else 0.95, (_gate(keyword),), _compiled(wording)))
    return sorted(out, key=lambda r: r.priority)


BASE_PRIORITY, BASE_CONFIDENCE = 6, 0.7


def places(words: bytes, phrase: bytes) -> list[int]:
    """Bytes before each place of a phrase in words that have a blank on either side; places may overlap."""
    out, at = [], words.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(at)
        at = words.find(b" " + phrase + b" ", at + 1)
    return out


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (start, end, priority, order), those that no better one contains: one of lower priority, or of equal
    priority and longer, or of the same interval by an earlier rule."""
    reach: dict[int, int] = {}  # by priority, how far the detections go that start no later
    out = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], d[2], d[3])):  # whatever contains another one comes before it
        if not any(end >= d[1] for priority, end in reach.items() if priority <= d[2]):
            out.append(d)
        reach[d[2]] = max(reach.get(d[2], 0), d[1])
    return out


class Scanner:
    """Rules with their keywords, made once for each Python worker."""

    def __init__(self, signatures: list[Rule]):
        self.rules, self.chosen = signatures, {}
        self.base = [(p.encode(), label) for p, label in BASE.items()]
        self.keywords = {w for r in signatures for one in r.gate for k in one for w in k} | {w for p in BASE for w in p.encode().split()}

    def candidates(self, held: frozenset[bytes]) -> list[int]:
        """Rules that can match a text with these keywords; remembered, since few sets of keywords recur over and over."""
        if held not in self.chosen:
            if len(self.chosen) >= 1 << 16:
                self.chosen.clear()
            self.chosen[held] = [n for n, r in enumerate(self.rules) if all(any(k <= held for k in one) for one in r.gate)]
        return self.chosen[held]

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int, str, str, float]], list[tuple[int, str]]]:
        """Of a text's words: detections (first word, word behind, label, rule, confidence) that stay, and base places (word, label)."""
        held = self.keywords.intersection(own)
        tried = self.candidates(frozenset(held))
        phrases = [(p, label) for p, label in self.base if held.issuperset(p.split())]
        if not tried and not phrases:
            return [], []
        words = b" " + b" ".join(own) + b" "
        base = [(at, len(p), label) for p, label in phrases for at in places(words, p)]
        found = [(m.start(), m.end(), self.rules[n].priority, n) for n in tried for m in self.rules[n].pattern.finditer(words)]
        found += [(at, at + 1 + n, BASE_PRIORITY, len(self.rules)) for at, n, _ in base]
        if not found:
            return [], []
        blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(blanks, at))
        kept = [(word(a), word(b), self.rules[n].label, self.rules[n].name, self.rules[n].confidence) for a, b, _, n in outermost(found) if n < len(self.rules)]
        return kept, [(word(at), label) for at, _, label in sorted(base)]


_scanner: list[Scanner] = []
FOUND = "array<struct<start:int,end:int,label:string,rule:string,confidence:double>>"
SCHEMA = f"doc_id string, n_words long, detections {FOUND}, base array<struct<start:int,label:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, detections (array of start, end, label, rule, confidence, by start; words from 0, end behind the
    last) and base (array of start, label) for each document row.

    Null and empty texts have no words and no detections. Repeated rows and null ids keep a row each; an empty table gives
    none. Whole texts are scanned, whatever their length. Other columns are ignored, so clashing names do no harm.
    """
    types = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.string()), ("confidence", pa.float64())]))
    bases = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner(rules()))
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                n, found, base = [], [], []
                for text in pc.fill_null(part.column(1).cast(pa.large_binary()), b"").to_pylist():
                    own = text.translate(WORD).split()
                    n.append(len(own))
                    kept, at = _scanner[0].scan(own)
                    found.append([dict(zip(("start", "end", "label", "rule", "confidence"), k, strict=True)) for k in kept])
                    base.append([{"start": a, "label": label} for a, label in at])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(found, types), pa.array(base, bases)], ["doc_id", "n_words", "detections", "base"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, SCHEMA.replace("doc_id string", f"doc_id {kind}"))


def labelled(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scan()'s rows: labels are distinct, sorted
    and joined by commas, the base ones among them; the score is the largest confidence of a detection, or 0."""
    starts = F.transform("base", lambda b: b["start"])
    of_base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    own = F.transform("detections", lambda d: d["label"])
    sure = F.array_max(F.concat(F.transform("detections", lambda d: d["confidence"]), F.when(F.size("base") > 0, F.array(F.lit(BASE_CONFIDENCE))).otherwise(F.array(F.lit(0.0)))))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(of_base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(of_base, own)), ",").alias("labels"), sure.alias("score"), F.size("detections").alias("n_detections"),
    )
