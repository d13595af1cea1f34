"""License scan with ordered signature rules, in DataFrame functions only.

A text's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased.
Rules are regular expressions over words joined by single spaces.  Rules
are written by hand (names, identifiers, notices, sentences of license bodies) or made from families of
licenses and templates.  Each has one anchor word, marked @, and a keyword:

1. texts without any anchor are done (one scan of the raw text);
2. each anchor word gets a window of the words around it;
3. the rules of that anchor whose keyword is in the window are matched there,
   so a place is found by exactly one window;
4. detections are swept by start: one that lies within a detection of the same
   or a smaller priority number is suppressed.

The base phrases are rules of priority 0, which nothing suppresses.  Every
step works within its row: no join, no shuffle, no Python.

Defined cases: a null or empty text has no words, no detections, null first
and last words, empty label strings and score 0; repeated rows are scanned
each; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words before and after an anchor in its window; no rule is wider.
BEFORE, AFTER = 18, 18

# The base phrases, as rules (label, anchored phrase).
BASE = [
    ("mit", "under the mit @license"),
    ("apache-2", "apache @license version 2"),
    ("cc-by-nc", "@cc by nc"),
]

# Label, name in prose, version, SPDX identifier; each as a pattern over normalised words.
FAMILIES = [
    ("mit", "(?:mit|expat)", "", "mit(?: 0)?"),
    ("x11", "x11", "", "x11"),
    ("isc", "isc", "", "isc"),
    ("zlib", "zlib(?: libpng)?", "", "zlib"),
    ("apache-1", "apache(?: software)?", "1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache(?: software)?", "2(?: 0)?", "apache 2 0"),
    ("bsd-2", "(?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause|freebsd)", "", "bsd 2 clause"),
    ("bsd-3", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|three clause bsd|bsd 3 clause)", "", "bsd 3 clause"),
    ("bsd-4", "(?:original bsd|4 clause bsd|bsd 4 clause)", "", "bsd 4 clause"),
    ("bsd", "bsd(?: style)?", "", "0bsd"),
    ("gpl-1", "(?:gnu )?(?:general public|gpl)", "v?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "(?:gnu )?(?:general public|gpl)", "v?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?(?:general public|gpl)", "v?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "(?:gnu )?(?:(?:library|lesser) general public|lgpl)", "v?2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "(?:gnu )?(?:(?:library|lesser) general public|lgpl)", "v?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu )?(?:affero general public|agpl)", "v?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("fdl", "(?:gnu )?(?:free documentation|gfdl)", "1(?: [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "mozilla public", "1(?: [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla public", "2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse public", "1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse public", "2(?: 0)?", "epl 2 0"),
    ("cddl", "common development and distribution", "1(?: [01])?", "cddl 1 [01]"),
    ("cpl", "common public", "1(?: 0)?", "cpl 1 0"),
    ("eupl", "european union public", "1(?: [12])?", "eupl 1 [12]"),
    ("artistic", "(?:perl )?artistic", "2(?: 0)?", "artistic [12] 0"),
    ("boost", "boost(?: software)?", "1(?: 0)?", "bsl 1 0"),
    ("psf", "python(?: software foundation)?", "2(?: 0)?", "(?:psf|python) 2 0"),
    ("ruby", "ruby", "", "ruby"),
    ("php", "php", "3(?: 0| 01)?", "php 3 0 ?1?"),
    ("w3c", "w3c(?: software)?", "", "w3c"),
    ("openssl", "openssl", "", "openssl"),
    ("unlicense", "un", "", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "2", "wtfpl"),
    ("ofl", "(?:sil )?open font", "1(?: 1)?", "ofl 1 [01]"),
    ("odbl", "open database", "1(?: 0)?", "odbl 1 0"),
    ("odc-by", "open data commons attribution", "1(?: 0)?", "odc by 1 0"),
    ("ogl", "open government", "[123](?: 0)?", "ogl uk [123] 0"),
    ("cc0", "(?:cc0|creative commons zero|public domain dedication)", "1(?: 0)?", "cc0 1 0"),
    ("cc-by", "(?:creative commons|cc) (?:attribution|by)", "[1234](?: [05])?", "cc by [1234] [05]"),
    ("cc-by-sa", "(?:creative commons|cc) (?:attribution share ?alike|by sa)", "[1234](?: [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "(?:creative commons|cc) (?:attribution no ?deriv(?:ative)?s|by nd)", "[1234](?: [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "(?:creative commons|cc) (?:attribution non ?commercial|by nc)", "[1234](?: [05])?", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "(?:creative commons|cc) (?:attribution non ?commercial share ?alike|by nc sa)", "[1234](?: [05])?",
     "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "(?:creative commons|cc) (?:attribution non ?commercial no ?deriv(?:ative)?s|by nc nd)",
     "[1234](?: [05])?", "cc by nc nd [1234] [05]"),
    ("proprietary", "(?:proprietary|commercial)", "", "proprietary"),
    ("ms-pl", "microsoft public", "", "ms pl"),
    ("qpl", "q public", "1(?: 0)?", "qpl 1 0"),
    ("sleepycat", "sleepycat", "", "sleepycat"),
    ("upl", "universal permissive", "1(?: 0)?", "upl 1 0"),
    ("vim", "vim", "", "vim"),
]

# Priority, confidence, anchor, pattern with {name}, {version}, {spdx}; a family without a version takes those without.
TEMPLATES = [
    (1, 1.0, "spdx", "@spdx license identifier {spdx}"),
    (2, 0.98, "license", "under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name} @license version {version}"),
    (2, 0.98, "licence", "under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name} @licence version {version}"),
    (3, 0.95, "license", "under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name} @license"),
    (3, 0.95, "licence", "under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name} @licence"),
    (3, 0.95, "licensed", "@licensed under (?:the )?(?:terms of )?(?:the )?{name}(?: license)?(?: version)? {version}"),
    (4, 0.9, "license", "{name} @license(?: version)? {version}"),
    (5, 0.8, "licensed", "@licensed under (?:the )?{name}"),
    (6, 0.7, "license", "{name} @license"),
    (7, 0.6, "license", "@license {spdx}"),
]
#: Families that share a name differ in their version alone: only templates with a version, or the identifier, tell them.
_SHARED = {n for n in (f[1] for f in FAMILIES) if sum(f[1] == n for f in FAMILIES) > 1}
#: Their names without a version, for the templates without one.
GENERIC = [("gpl", "(?:gnu )?(?:general public|gpl)"), ("lgpl", "(?:gnu )?(?:(?:library|lesser) general public|lgpl)"),
           ("apache", "apache(?: software)?"), ("mpl", "mozilla public"), ("epl", "eclipse public")]

_LATER = "(?: only| or later| or newer| or any later version)?"
_CC_VERSION = "(?: [1234](?: [05])?)?"

# Priority, confidence, label, pattern.
WRITTEN = [
    # sentences of license bodies
    (3, 0.95, "mit", "permission is @hereby granted free of charge to any person obtaining a copy of this software"),
    (3, 0.95, "boost", "permission is @hereby granted free of charge to any person or organi[sz]ation obtaining a copy"),
    (3, 0.95, "ofl", "permission is @hereby granted free of charge to any person obtaining a copy of the font software"),
    (3, 0.95, "unicode", "permission is @hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    (3, 0.95, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is @hereby granted"),
    (3, 0.95, "hpnd", "modify and distribute this software and its documentation for any purpose"
                      "(?:(?: and)? without fee)? is @hereby granted"),
    (3, 0.9, "postgresql", "distribute this software and its documentation for any purpose without fee and without a written agreement is @hereby granted"),
    (3, 0.9, "upl", "subject to the condition set forth below permission is @hereby granted to any person"),
    (3, 0.85, "mit", "the above copyright notice and this permission notice shall be included in all copies or @substantial portions"),
    (4, 0.8, "mit", "merchantability fitness for a particular purpose and @noninfringement"),
    (3, 0.95, "bsd", "@redistribution and use in source and binary forms with or without modification are permitted"),
    (4, 0.9, "bsd", "@redistributions of source code must retain the (?:above )?copyright notice"),
    (4, 0.9, "bsd", "@redistributions in binary form must reproduce the (?:above )?copyright notice"),
    (3, 0.9, "bsd-3", "used to @endorse or promote products derived from this software"),
    (3, 0.9, "bsd-4", "all @advertising materials mentioning features or use of this software must display"),
    (3, 0.9, "zlib", "@altered source versions must be plainly marked as such"),
    (4, 0.85, "zlib", "the origin of this software must not be @misrepresented"),
    (3, 0.9, "apache-2", "you may not use this file except in @compliance with the license"),
    (4, 0.85, "apache-2", "(?:distributed )?on an as is basis without @warranties or conditions of any kind"),
    (3, 0.9, "apache-1", "this product includes software developed by the @apache (?:software foundation|group)"),
    (3, 0.95, "gpl", "you can @redistribute it and or modify it under the terms of the gnu general public license"),
    (3, 0.95, "lgpl", "you can @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (3, 0.95, "agpl", "you can @redistribute it and or modify it under the terms of the gnu affero general public license"),
    (3, 0.85, "gpl-2", "either version 2 of the @license or at your option any later version"),
    (3, 0.85, "gpl-3", "either version 3 of the @license or at your option any later version"),
    (4, 0.8, "gpl", "the licenses for most software are designed to take away your @freedom to share and change it"),
    (3, 0.95, "mpl-2", "this source code form is subject to the terms of the mozilla public @license v(?:ersion)? ?2 0"),
    (3, 0.9, "mpl-1", "the contents of this file are subject to the mozilla public @license version 1 [01]"),
    (3, 0.9, "cddl", "the terms of the common development and distribution @license"),
    (3, 0.9, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public @license"),
    (3, 0.95, "unlicense", "this is free and @unencumbered software released into the public domain"),
    (3, 0.9, "wtfpl", "permitted to copy and distribute @verbatim or modified copies of this license"),
    (3, 0.9, "beerware", "you can buy me a @beer in return"),
    (3, 0.9, "json", "the software shall be used for good not @evil"),
    (3, 0.9, "psf", "the python software foundation psf and the individual or organi[sz]ation @licensee"),
    (3, 0.9, "cc0", "waives all of his or her rights to the work @worldwide under copyright law"),
    (4, 0.8, "public-domain", "(?:dedicated|released|placed|put) (?:in|to|into) the public @domain"),
    (5, 0.7, "public-domain", "(?:is|are) in the public @domain"),
    (4, 0.8, "proprietary", "@proprietary and confidential"),
    (4, 0.8, "proprietary", "confidential and @proprietary"),
    (4, 0.75, "proprietary", "unauthori[sz]ed copying of this file via any medium is @strictly prohibited"),
    # notices
    (5, 0.85, "apache-2", "@licensed to the apache software foundation asf under one or more contributor license agreements"),
    (5, 0.8, "bsd", "governed by a bsd style @license"),
    (5, 0.8, "same-as-perl", "under the same terms as @perl itself"),
    (5, 0.8, "ruby", "under the same terms as @ruby"),
    (5, 0.8, "dual-mit-gpl", "dual @licensed under the mit and gpl(?: licenses)?"),
    (5, 0.8, "dual-mit-apache", "@licensed under either of (?:the )?apache"),
    # names and identifiers that stand without the word license
    *[(8, 0.6, f"{name}-{v}", f"@{name} (?:v|version )?{v}(?: [01])?{_LATER}")
      for name in ("gpl", "lgpl", "agpl") for v in (1, 2, 3) if (name, v) not in (("lgpl", 1), ("agpl", 2))],
    *[(8, 0.6, f"{name}-{v}", f"@{name}{form}{v}(?: [01])?{_LATER}")
      for name, v in (("gpl", 2), ("gpl", 3), ("lgpl", 2), ("lgpl", 3), ("agpl", 3)) for form in ("v", "")],
    (8, 0.6, "lgpl-2", "@lgplv21"),
    (9, 0.5, "gpl", "@gpl"),
    (9, 0.5, "lgpl", "@lgpl"),
    (9, 0.5, "agpl", "@agpl"),
    (9, 0.5, "fdl", "@gfdl"),
    (8, 0.6, "apache-2", "@apache(?: software)? 2 0"),
    (8, 0.6, "apache-2", "@asl 2 0"),
    (8, 0.6, "mpl-2", "@mpl 2 0"),
    (8, 0.6, "mpl-1", "@mpl 1 [01]"),
    (8, 0.6, "epl-1", "@epl 1 0"),
    (8, 0.6, "epl-2", "@epl 2 0"),
    (8, 0.6, "eupl", "@eupl(?: v?1 [12])?"),
    (8, 0.6, "cddl", "@cddl(?: 1 [01])?"),
    (8, 0.6, "ofl", "@ofl 1 [01]"),
    (8, 0.6, "afl", "@afl [123] [01]"),
    (8, 0.6, "osl", "@osl [123] [01]"),
    (8, 0.6, "odbl", "@odbl(?: 1 0)?"),
    (8, 0.6, "boost", "@bsl 1 0"),
    (8, 0.6, "bsd-0", "@0bsd"),
    (8, 0.6, "bsd-2", "@bsd 2 clause"),
    (8, 0.6, "bsd-3", "@bsd 3 clause"),
    (8, 0.6, "bsd-4", "@bsd 4 clause"),
    (8, 0.6, "bsd-2", "(?:2|two) clause @bsd"),
    (8, 0.6, "bsd-3", "(?:3|three) clause @bsd"),
    (8, 0.6, "bsd-4", "(?:4|four) clause @bsd"),
    (8, 0.6, "unlicense", "@unlicense"),
    (8, 0.6, "wtfpl", "@wtfpl"),
    (8, 0.7, "cc0", "@cc0(?: 1 0)?(?: universal)?"),
    (8, 0.7, "cc0", "creative @commons zero(?: 1 0)?"),
    (8, 0.7, "cc-by", f"@cc by{_CC_VERSION}"),
    (8, 0.7, "cc-by-sa", f"@cc by sa{_CC_VERSION}"),
    (8, 0.7, "cc-by-nd", f"@cc by nd{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc", f"@cc by nc{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc-sa", f"@cc by nc sa{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc-nd", f"@cc by nc nd{_CC_VERSION}"),
    (8, 0.7, "cc-by", f"creative @commons attribution{_CC_VERSION}"),
    (8, 0.7, "cc-by-sa", f"creative @commons attribution share ?alike{_CC_VERSION}"),
    (8, 0.7, "cc-by-nd", f"creative @commons attribution no ?deriv(?:ative)?s{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc", f"creative @commons attribution non ?commercial{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc-sa", f"creative @commons attribution non ?commercial share ?alike{_CC_VERSION}"),
    (8, 0.7, "cc-by-nc-nd", f"creative @commons attribution non ?commercial no ?deriv(?:ative)?s{_CC_VERSION}"),
]


def rules() -> list[dict]:
    """The signature rules, in order of priority."""
    out = [{"label": label, "priority": 0, "conf": 1.0, "base": True, **_anchored(phrase)} for label, phrase in BASE]
    for priority, conf, _, template in TEMPLATES:
        for label, name, version, spdx in FAMILIES:
            if "{version}" in template and not version:
                continue
            if "{name}" in template and "{version}" not in template and name in _SHARED:
                continue
            pattern = template.format(name=name, version=version, spdx=spdx)
            out.append({"label": label, "priority": priority, "conf": conf, "base": False, **_anchored(pattern)})
        if "{name}" in template and "{version}" not in template:
            out += [{"label": label, "priority": priority, "conf": conf, "base": False, **_anchored(template.format(name=name))}
                    for label, name in GENERIC]
    out += [{"label": label, "priority": priority, "conf": conf, "base": False, **_anchored(pattern)}
            for priority, conf, label, pattern in WRITTEN]
    return sorted(out, key=lambda r: r["priority"])


def _bare(pattern: str) -> str:
    """A pattern with | for each group and class."""
    while (inner := re.sub(r"\([^()]*\)\??", "|", pattern)) != pattern:
        pattern = inner
    return re.sub(r"\[[^\]]*\]", "|", pattern)


def _anchored(pattern: str) -> dict:
    """A rule's anchor, and its longest word that every match must hold."""
    anchor = re.search("@([a-z0-9]+)", pattern)[1]
    literal = [w for w in _bare(pattern).split(" ") if re.fullmatch("[a-z0-9]+", w)]
    return {"anchor": anchor, "keyword": max(literal, key=len, default=""), "pattern": f" ({pattern}) "}


RULES = rules()
ANCHORS = sorted({r["anchor"] for r in RULES})
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_SIGN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def _gate() -> str:
    """Each anchor as a whole word of raw text, in any case, with the words that all its rules have beside it."""
    spelled = []
    for anchor in ANCHORS:
        beside = [_beside(r["pattern"]) for r in RULES if r["anchor"] == anchor]
        left, right = ({b[i] for b in beside} for i in (0, 1))
        before = left.pop() + _GAP if len(left) == 1 and "" not in left else ""
        after = _GAP + right.pop() if len(right) == 1 and "" not in right else ""
        spelled.append(f"{before}{anchor}{after}")
    return f"(?i)(?<!{_SIGN})(?:{'|'.join(spelled)})(?!{_SIGN})"


def _beside(pattern: str) -> tuple[str, str]:
    """The literal words right before and after a rule's anchor; empty if they vary."""
    left, right = _bare(pattern.strip()[1:-1]).split("@")
    near = (left.split(" ")[-2] if left.endswith(" ") else "", (right.split(" ") + [""])[1].rstrip("|"))
    return tuple(w if re.fullmatch("[a-z0-9]+", w) else "" for w in near)


GATE = _gate()
TIERS = 1 + max(r["priority"] for r in RULES)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<label:string,priority:int,conf:double,base:boolean,anchor:string,keyword:string,pattern:string>>"


def words(text: Column) -> Column:
    """The words of a text as an array."""
    flat = F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _detections(w: Column) -> Column:
    """All matches of all rules in an array of words, ordered for the sweep; a match may come twice."""
    rule_list = F.from_json(F.lit(json.dumps(RULES)), _RULE)
    places = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))),
                      lambda p: p["word"].isin(ANCHORS))

    def window(p: Column) -> Column:
        lo = F.greatest(p["at"] - BEFORE, F.lit(0))
        left = F.array_join(F.slice(w, lo + 1, p["at"] - lo), " ")
        right = F.array_join(F.slice(w, p["at"] + 2, F.lit(AFTER)), " ")
        return F.struct(p["word"].alias("word"), p["at"].alias("at"),
                        F.concat(F.lit(" "), left, F.lit(" @"), p["word"], F.lit(" "), right, F.lit(" ")).alias("win"))

    def matches(p: Column) -> Column:
        mine = F.filter(rule_list, lambda r: (r["anchor"] == p["word"]) & F.contains(p["win"], r["keyword"]))
        found = F.transform(mine, lambda r: F.struct(
            r.alias("r"), F.call_function("regexp_extract", p["win"], r["pattern"], F.lit(1)).alias("m")))

        def detection(x: Column) -> Column:
            before = F.size(F.split(F.substring_index(x["m"], "@", 1), " ")) - 1
            start = p["at"] - before
            end = start + F.size(F.split(x["m"], " "))
            return F.struct(start.alias("start"), (-end).alias("neg_end"), x["r"]["priority"].alias("priority"),
                            x["r"]["label"].alias("label"), x["r"]["conf"].alias("conf"), x["r"]["base"].alias("base"))

        return F.transform(F.filter(found, lambda x: x["m"] != ""), detection)

    return F.array_sort(F.flatten(F.transform(F.transform(places, window), matches)))


def _distinct(name: str) -> Column:
    """A column of ordered structs without repeats (``array_distinct`` compares all pairs of structs)."""
    return F.filter(name, lambda d, i: (i == 0) | (d != F.get(F.col(name), i - 1)))


_ENDS = "array<int>"
_KEPT = "array<struct<label:string,start:int,end:int,priority:int,conf:double>>"
_STATE = f"struct<ends:{_ENDS},kept:{_KEPT}>"
#: Detections a block of the sweep: what it keeps grows by copies, so no long array may.
SWEEP_BLOCK = 64


def _sweep(found: Column) -> Column:
    """The detections that no other one suppresses.

    In order of start (longest first), a detection lies within an earlier one
    exactly if an earlier end reaches its own; one largest end is kept per
    priority.  The detections are cut into blocks: the ends before each block are
    added up over the blocks' own largest ends, then each block is swept from there.
    """
    size = F.lit(SWEEP_BLOCK)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")),
                         lambda i: F.slice(found, i * size + 1, size))
    none = F.array_repeat(F.lit(-1), TIERS)

    def reach(block: Column, tier: int) -> Column:
        own = F.filter(block, lambda d: d["priority"] == tier)
        return F.coalesce(F.array_max(F.transform(own, lambda d: -d["neg_end"])), F.lit(-1))

    def later(ends: Column, block: Column) -> Column:
        return F.zip_with(F.element_at(ends, -1), F.array(*[reach(block, t) for t in range(TIERS)]), lambda a, b: F.greatest(a, b))

    before = F.aggregate(blocks, F.array(none.cast(_ENDS)), lambda ends, block: F.array_append(ends, later(ends, block)))

    def step(state: Column, d: Column) -> Column:
        end = -d["neg_end"]
        inside = F.array_max(F.slice(state["ends"], F.lit(1), d["priority"] + 1)) >= end
        ends = F.transform(state["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e))
        one = F.struct(d["label"].alias("label"), d["start"].alias("start"), end.alias("end"),
                       d["priority"].alias("priority"), d["conf"].alias("conf"))
        return F.struct(ends.alias("ends"), F.when(inside, state["kept"]).otherwise(
            F.array_append(state["kept"], one)).alias("kept"))

    def swept(block: Column, ends: Column) -> Column:
        start = F.struct(ends.alias("ends"), F.from_json(F.lit("[]"), _KEPT).alias("kept")).cast(_STATE)
        return F.aggregate(block, start, lambda s, d: step(s, d).cast(_STATE), lambda s: s["kept"])

    # one entry of ``before`` more than blocks: the ends after the last one
    pairs = F.arrays_zip(blocks.alias("block"), F.slice(before, F.lit(1), F.size(before) - 1).alias("ends"))
    return F.when(F.size(found) > 0, F.flatten(F.transform(pairs, lambda p: swept(p["block"], p["ends"]))))


def scan_licenses(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_words, base_places and detections (label, start, end, priority, conf).

    Input columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = t.rlike(GATE)
    new = {"n_words": F.regexp_count(t, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")}
    out = docs.withColumn("__words", F.when(has, words(t)))
    out = out.withColumn("__matches", F.when(F.col("__words").isNotNull(), _detections(F.col("__words"))))
    out = out.withColumn("__found", _distinct("__matches"))
    new["base_places"] = F.coalesce(F.filter("__found", lambda d: d["base"]), F.array().cast(
        "array<struct<start:int,neg_end:int,priority:int,label:string,conf:double,base:boolean>>"))
    new["detections"] = F.coalesce(F.when(F.col("__words").isNotNull(), _sweep(F.col("__found"))), F.array().cast(
        "array<struct<label:string,start:int,end:int,priority:int,conf:double>>"))
    return out.withColumns(new).drop("__words", "__matches", "__found")


def _labels(places: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda d: d["label"]))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: per document, its number of words, base phrases and license labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    starts = F.transform("base_places", lambda d: d["start"].cast("long"))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels("base_places").alias("base_labels"),
        _labels("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["conf"])), F.lit(0.0)).alias("score"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(r['label'])}, {r['priority']}, {r['conf']}::DOUBLE, {str(r['base']).lower()}, "
                        f"{quote(r['anchor'])}, {quote(r['pattern'])})" for r in RULES)
    anchors = ", ".join(map(quote, ANCHORS))
    return rf"""
WITH rules(label, priority, conf, base, anchor, pattern) AS (VALUES
{values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
win AS (SELECT r, word, pos, concat(' ', array_to_string(w[greatest(pos - {BEFORE}, 0) + 1:pos], ' '), ' @', word, ' ',
          array_to_string(w[pos + 2:pos + 1 + {AFTER}], ' '), ' ') AS win FROM p WHERE word IN ({anchors})),
m AS (SELECT r, pos, label, priority, conf, base, regexp_extract(win, pattern, 1) AS m
      FROM win JOIN rules ON word = anchor),
det AS (SELECT DISTINCT r, pos - len(string_split(string_split(m, '@')[1], ' ')) + 1 AS s,
          pos - len(string_split(string_split(m, '@')[1], ' ')) + 1 + len(string_split(m, ' ')) AS e,
          priority, label, conf, base FROM m WHERE m <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s, -e, priority, label, conf, base) AS k FROM det),
kept AS (SELECT * FROM o a WHERE NOT EXISTS (
  SELECT 1 FROM o b WHERE b.r = a.r AND b.k < a.k AND b.priority <= a.priority AND b.e >= a.e)),
bb AS (SELECT r, count(*) AS n, min(s) AS f, max(s) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM o WHERE base GROUP BY r),
kk AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(conf) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(bb.n, 0) AS BIGINT) AS n_base,
       CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word, coalesce(bb.labels, '') AS base_labels,
       coalesce(kk.labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN kk USING (r)
"""


ORACLE = _oracle()
