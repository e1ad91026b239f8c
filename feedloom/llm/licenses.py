"""License scans: ordered signature rules over words, in Catalyst expressions only.

A text becomes lower-case words. A rule is a keyword, the one or two words that it begins with, and a pattern for
the words behind it. Rules are tried only where the text has their keyword, on the words from there on. Detections that overlap are settled by priority and containment: one
that lies within another of at least its priority goes.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a rule can reach over, its keyword included.
REACH = 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a detection of each priority weighs: an identifier, a title with its version, a title, a phrase.
WEIGHTS = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.4}
#: Phrases that count wherever they stand, whatever overlaps them, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Keyword, then its rules: label, priority, pattern of the words behind the keyword (none: the keyword alone).
RULES = r"""
cc by
 cc-by 2
 cc-by-4.0 3 4 0
 cc-by-3.0 3 3 0
 cc-by-2.0 3 2 [05]
 cc-by-sa 2 sa
 cc-by-sa-4.0 3 sa 4 0
 cc-by-sa-3.0 3 sa 3 0
 cc-by-nc 2 nc
 cc-by-nc-4.0 3 nc 4 0
 cc-by-nc-3.0 3 nc 3 0
 cc-by-nc-sa 2 nc sa
 cc-by-nc-sa-4.0 3 nc sa 4 0
 cc-by-nc-sa-3.0 3 nc sa 3 0
 cc-by-nc-nd 2 nc nd
 cc-by-nc-nd-4.0 3 nc nd 4 0
 cc-by-nc-nd-3.0 3 nc nd 3 0
 cc-by-nd 2 nd
 cc-by-nd-4.0 3 nd 4 0
 cc-by-nd-3.0 3 nd 3 0
cc0
 cc0-1.0 2
 cc0-1.0 3 1 0(?: universal)?
cc zero
 cc0-1.0 2
creative commons
 creative-commons 1
 creative-commons 2 licen[sc]es?
 cc0-1.0 3 (?:public domain dedication|zero|cc0)(?: 1 0)?(?: universal)?
 cc-by 2 attribution(?: licen[sc]e)?
 cc-by-4.0 3 attribution 4 0(?: international)?(?: licen[sc]e)?
 cc-by-3.0 3 attribution 3 0(?: unported)?(?: licen[sc]e)?
 cc-by-sa 2 attribution share ?alike(?: licen[sc]e)?
 cc-by-sa-4.0 3 attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
 cc-by-sa-3.0 3 attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
 cc-by-nd 2 attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?
 cc-by-nd-4.0 3 attribution no ?deriv(?:ative)?s? 4 0(?: international)?
 cc-by-nc 2 attribution non ?commercial(?: licen[sc]e)?
 cc-by-nc-4.0 3 attribution non ?commercial 4 0(?: international)?
 cc-by-nc-3.0 3 attribution non ?commercial 3 0(?: unported)?
 cc-by-nc-sa 2 attribution non ?commercial share ?alike(?: licen[sc]e)?
 cc-by-nc-sa-4.0 3 attribution non ?commercial share ?alike 4 0(?: international)?
 cc-by-nc-nd 2 attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
 cc-by-nc-nd-4.0 3 attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?
creativecommons org
 cc-by 4 licenses by 4 0
 cc-by-sa 4 licenses by sa [1-4] [05]
 cc-by-nc 4 licenses by nc [1-4] [05]
 cc-by-nd 4 licenses by nd [1-4] [05]
 cc-by-nc-sa 4 licenses by nc sa [1-4] [05]
 cc-by-nc-nd 4 licenses by nc nd [1-4] [05]
 cc0-1.0 4 publicdomain zero 1 0
 public-domain 4 publicdomain mark 1 0
general public
 gpl 2 licen[sc]e
 gpl-1.0 3 licen[sc]e (?:as published by the free software foundation )?(?:version |v )?1(?: 0)?
 gpl-2.0 3 licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?
 gpl-3.0 3 licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
 gpl-2.0-or-later 3 licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)? or (?:at your option )?any later version
 gpl-3.0-or-later 3 licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)? or (?:at your option )?any later version
 gpl-2.0 3 licen[sc]e v2(?: 0)?
 gpl-3.0 3 licen[sc]e v3(?: 0)?
gnu general
 gpl 2 public licen[sc]e
 gpl-1.0 3 public licen[sc]e (?:version |v )?1(?: 0)?
 gpl-2.0 3 public licen[sc]e (?:version |v )?2(?: 0)?
 gpl-3.0 3 public licen[sc]e (?:version |v )?3(?: 0)?
 gpl-2.0-or-later 3 public licen[sc]e (?:version |v )?2(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
 gpl-3.0-or-later 3 public licen[sc]e (?:version |v )?3(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gnu gpl
 gpl 2
 gpl-2.0 3 (?:version |v )?2(?: 0)?
 gpl-3.0 3 (?:version |v )?3(?: 0)?
 gpl-2.0 3 v2(?: 0)?
 gpl-3.0 3 v3(?: 0)?
gpl v2
 gpl-2.0 3(?: 0)?
gpl v3
 gpl-3.0 3(?: 0)?
gpl 2
 gpl-2.0 3 0
 gpl-2.0-only 4 0 only
 gpl-2.0-or-later 4 0 or later
gpl 3
 gpl-3.0 3 0
 gpl-3.0-only 4 0 only
 gpl-3.0-or-later 4 0 or later
gplv2
 gpl-2.0 3
gplv3
 gpl-3.0 3
gnu lesser
 lgpl 2 general public licen[sc]e
 lgpl-2.1 3 general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?2 1
 lgpl-3.0 3 general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
gnu library
 lgpl 2 general public licen[sc]e
 lgpl-2.0 3 general public licen[sc]e (?:version |v )?2(?: 0)?
lesser general
 lgpl 2 public licen[sc]e
 lgpl-2.1 3 public licen[sc]e (?:version |v )?2 1
 lgpl-3.0 3 public licen[sc]e (?:version |v )?3(?: 0)?
library general
 lgpl-2.0 2 public licen[sc]e
lgpl 2
 lgpl-2.1 3 1
 lgpl-2.1-only 4 1 only
 lgpl-2.1-or-later 4 1 or later
lgpl 3
 lgpl-3.0 3 0
 lgpl-3.0-only 4 0 only
 lgpl-3.0-or-later 4 0 or later
lgplv2
 lgpl-2.0 3
 lgpl-2.1 3 1
lgplv3
 lgpl-3.0 3
gnu affero
 agpl 2 general public licen[sc]e
 agpl-3.0 3 general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
affero general
 agpl 2 public licen[sc]e
 agpl-1.0 3 public licen[sc]e (?:version |v )?1(?: 0)?
 agpl-3.0 3 public licen[sc]e (?:version |v )?3(?: 0)?
agpl 3
 agpl-3.0 3 0
 agpl-3.0-only 4 0 only
 agpl-3.0-or-later 4 0 or later
agplv3
 agpl-3.0 3
gnu free
 gfdl 2 documentation licen[sc]e
 gfdl-1.1 3 documentation licen[sc]e (?:version )?1 1
 gfdl-1.2 3 documentation licen[sc]e (?:version )?1 2
 gfdl-1.3 3 documentation licen[sc]e (?:version )?1 3
gfdl
 gfdl 2
apache license
 apache 2
 apache-1.0 3 (?:version |v )?1 0
 apache-1.1 3 (?:version |v )?1 1
 apache-2.0 3 (?:version |v )?2(?: 0)?
apache software
 apache 2 licen[sc]e
 apache-1.1 3 licen[sc]e (?:version |v )?1 1
 apache-2.0 3 licen[sc]e (?:version |v )?2(?: 0)?
apache 2
 apache-2.0 3 0(?: licen[sc]ed?)?
 apache-2.0 2 licen[sc]ed?
apache org
 apache-2.0 4 licenses license 2 0
mit license
 mit 3
mit licence
 mit 3
mit licensed
 mit 3
expat license
 mit 3
permission is
 mit 3 hereby granted free of charge to any person obtaining a copy
 x11 2 hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
 mit 1 hereby granted without written agreement
permission to
 isc 3 use copy modify and or distribute this software for any purpose with or without fee is hereby granted
 isc 3 use copy modify and distribute this software for any purpose with or without fee is hereby granted
 hpnd 3 use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted
the software
 warranty-disclaimer 1 is provided as is without warranty of any kind
this software
 warranty-disclaimer 1 is provided as is
 zlib 3 is provided as is without any express or implied warranty in no event will the authors
 bsd 2 is provided by the copyright holders and contributors as is
 bsd 2 is provided by the (?:regents|authors?) and contributors as is
redistribution and
 bsd 3 use in source and binary forms with or without modification are permitted
neither the
 bsd-3-clause 3 names? of (?:the )?(?:copyright holders?|authors?|university|regents|company|project) nor the names of (?:its|their|any) contributors may be used to endorse
all advertising
 bsd-4-clause 3 materials mentioning features or use of this software must display
bsd license
 bsd 2
bsd licence
 bsd 2
bsd style
 bsd 1(?: licen[sc]e)?
bsd 0
 0bsd 3 clause
bsd 2
 bsd-2-clause 3 clause(?: licen[sc]e)?
bsd 3
 bsd-3-clause 3 clause(?: licen[sc]e)?
bsd 4
 bsd-4-clause 3 clause(?: licen[sc]e)?
2 clause
 bsd-2-clause 3 bsd
3 clause
 bsd-3-clause 3 bsd
simplified bsd
 bsd-2-clause 3(?: licen[sc]e)?
modified bsd
 bsd-3-clause 3(?: licen[sc]e)?
new bsd
 bsd-3-clause 3(?: licen[sc]e)?
isc license
 isc 3
isc licence
 isc 3
mozilla public
 mpl 2 licen[sc]e
 mpl-1.0 3 licen[sc]e (?:version |v )?1 0
 mpl-1.1 3 licen[sc]e (?:version |v )?1 1
 mpl-2.0 3 licen[sc]e (?:version |v )?2(?: 0)?
mozilla org
 mpl-2.0 4 mpl 2 0
mpl 1
 mpl-1.1 3 1
mpl 2
 mpl-2.0 3 0
eclipse public
 epl 2 licen[sc]e
 epl-1.0 3 licen[sc]e (?:version |v )?1(?: 0)?
 epl-2.0 3 licen[sc]e (?:version |v )?2(?: 0)?
eclipse distribution
 bsd-3-clause 2 licen[sc]e(?: version| v)?(?: 1 0)?
epl 2
 epl-2.0 3 0
common development
 cddl 2 and distribution licen[sc]e
 cddl-1.0 3 and distribution licen[sc]e (?:version |v )?1 0
 cddl-1.1 3 and distribution licen[sc]e (?:version |v )?1 1
common public
 cpl-1.0 2 licen[sc]e
 cpl-1.0 3 licen[sc]e (?:version |v )?1 0
 cpal-1.0 3 attribution licen[sc]e
ibm public
 ipl-1.0 2 licen[sc]e
netscape public
 npl 2 licen[sc]e
sun public
 spl-1.0 2 licen[sc]e
sun industry
 sissl 2 standards source licen[sc]e
q public
 qpl-1.0 2 licen[sc]e
apple public
 apsl 2 source licen[sc]e
 apsl-2.0 3 source licen[sc]e (?:version |v )?2(?: 0)?
artistic license
 artistic 2
 artistic-1.0 3 (?:version |v )?1(?: 0)?
 artistic-2.0 3 (?:version |v )?2(?: 0)?
boost software
 bsl-1.0 2 licen[sc]e
 bsl-1.0 3 licen[sc]e (?:version |v )?1 0
zlib license
 zlib 3
zlib libpng
 zlib 3 licen[sc]e
unlicense
 unlicense 2
the unlicense
 unlicense 3
this is
 unlicense 3 free and unencumbered software released into the public domain
wtfpl
 wtfpl 3
do what
 wtfpl 3 the fuck you want to public licen[sc]e
beerware
 beerware 2
beer ware
 beerware 3 licen[sc]e
sil open
 ofl 2 font licen[sc]e
 ofl-1.0 3 font licen[sc]e (?:version |v )?1 0
 ofl-1.1 3 font licen[sc]e (?:version |v )?1 1
open font
 ofl 2 licen[sc]e
open software
 osl 2 licen[sc]e
 osl-3.0 3 licen[sc]e (?:version |v )?3(?: 0)?
academic free
 afl 2 licen[sc]e
 afl-3.0 3 licen[sc]e (?:version |v )?3(?: 0)?
educational community
 ecl-2.0 2 licen[sc]e
open data
 odbl 2 commons open database licen[sc]e
 odc-by 2 commons attribution licen[sc]e
 pddl 2 commons public domain dedication
open database
 odbl 2 licen[sc]e
odbl
 odbl 2
european union
 eupl 2 public licen[sc]e
 eupl-1.1 3 public licen[sc]e (?:version |v )?1 1
 eupl-1.2 3 public licen[sc]e (?:version |v )?1 2
eupl
 eupl 2
microsoft public
 ms-pl 2 licen[sc]e
microsoft reciprocal
 ms-rl 2 licen[sc]e
cecill
 cecill 2
 cecill-2.1 3 (?:version )?2 1
python software
 psf-2.0 2 foundation licen[sc]e
 psf-2.0 3 foundation licen[sc]e (?:version |v )?2
php license
 php 2
 php-3.01 3 (?:version |v )?3 01
ruby license
 ruby 2
postgresql license
 postgresql 3
openssl license
 openssl 3
perl license
 perl 2
ncsa open
 ncsa 3 source licen[sc]e
university of
 ncsa 3 illinois ncsa open source licen[sc]e
w3c software
 w3c 2(?: notice and)?(?: document)? licen[sc]e
zope public
 zpl 2 licen[sc]e
vim license
 vim 3
sleepycat license
 sleepycat 3
latex project
 lppl 2 public licen[sc]e
 lppl-1.3 3 public licen[sc]e (?:version |v )?1 3c?
universal permissive
 upl-1.0 2 licen[sc]e
mulan psl
 mulanpsl-2.0 2
mulan permissive
 mulanpsl-2.0 2 software licen[sc]e
unicode license
 unicode 3
icu license
 icu 3
json license
 json 2
the software
 json 3 shall be used for good not evil
fair license
 fair 2
blue oak
 blueoak-1.0.0 3 model licen[sc]e
elastic license
 elastic 2
 elastic-2.0 3 2 0
server side
 sspl-1.0 3 public licen[sc]e
business source
 busl-1.1 2 licen[sc]e
 busl-1.1 3 licen[sc]e (?:version )?1 1
commons clause
 commons-clause 2
polyform noncommercial
 polyform-noncommercial 3(?: licen[sc]e)?
polyform shield
 polyform-shield 3(?: licen[sc]e)?
openrail
 openrail 2
open rail
 openrail 2
responsible ai
 openrail 2 licen[sc]es?
community data
 cdla 2 licen[sc]e agreement
 cdla-permissive 3 licen[sc]e agreement permissive
 cdla-sharing 3 licen[sc]e agreement sharing
open government
 ogl 2 licen[sc]e
 ogl-3.0 3 licen[sc]e (?:version |v )?3(?: 0)?
open publication
 opl 2 licen[sc]e
public domain
 public-domain 1
 public-domain 2 (?:dedication|mark|work|declaration)
spdx license
 spdx 1 identifier
 apache-2.0 4 identifier apache 2 0
 mit 4 identifier mit
 mit-0 4 identifier mit 0
 isc 4 identifier isc
 zlib 4 identifier zlib
 unlicense 4 identifier unlicense
 bsl-1.0 4 identifier bsl 1 0
 bsd-2-clause 4 identifier bsd 2 clause
 bsd-3-clause 4 identifier bsd 3 clause
 0bsd 4 identifier 0bsd
 mpl-2.0 4 identifier mpl 2 0
 epl-2.0 4 identifier epl 2 0
 gpl-2.0 4 identifier gpl 2 0
 gpl-2.0-only 4 identifier gpl 2 0 only
 gpl-2.0-or-later 4 identifier gpl 2 0 or later
 gpl-3.0 4 identifier gpl 3 0
 gpl-3.0-only 4 identifier gpl 3 0 only
 gpl-3.0-or-later 4 identifier gpl 3 0 or later
 lgpl-2.1 4 identifier lgpl 2 1(?: only| or later)?
 lgpl-3.0 4 identifier lgpl 3 0(?: only| or later)?
 agpl-3.0 4 identifier agpl 3 0(?: only| or later)?
 cc0-1.0 4 identifier cc0 1 0
 cc-by-4.0 4 identifier cc by 4 0
 cc-by-sa-4.0 4 identifier cc by sa 4 0
 wtfpl 4 identifier wtfpl
 ofl-1.1 4 identifier ofl 1 1
 eupl-1.2 4 identifier eupl 1 2
 proprietary 4 identifier licenseref proprietary
all rights
 reserved 2 reserved
 reserved 3 reserved (?:no part of this|reproduction (?:is )?prohibited|unauthori[sz]ed)
some rights
 some-rights-reserved 2 reserved
no rights
 public-domain 2 reserved
no part
 reserved 3 of this (?:publication|book|document|work) may be reproduced
alle rechte
 reserved 2 vorbehalten
tous droits
 reserved 2 réservés
todos los
 reserved 2 derechos reservados
used by
 by-permission 1 permission
reprinted with
 by-permission 2 permission
proprietary and
 proprietary 2 confidential
for internal
 proprietary 1 use only
unauthorized copying
 proprietary 3 of this file
dual licensed
 dual-license 1 under
dual license
 dual-license 1
free software
 free-software 1 you can redistribute it and or modify it
 free-software 1 foundation
licensed under
 license-reference 1 (?:the|a|an)
released under
 license-reference 1 (?:the|a|an)
distributed under
 license-reference 1 (?:the|a|an)
available under
 license-reference 1 the terms of
under the
 license-reference 1 terms of the
 license-reference 1 same terms as
see the
 license-reference 1 licen[sc]e(?: file)? for (?:the )?(?:details|specific language governing permissions)
license file
 license-reference 1
copyright notice
 copyright-notice 1
copyright c
 copyright-notice 1(?: [0-9]{4})?
copyright ©
 copyright-notice 1(?: [0-9]{4})?
"""


class Rule(NamedTuple):
    rule: int
    keyword: str
    label: str
    priority: int
    pattern: str
    phrase: str


@cache
def rules() -> tuple[Rule, ...]:
    """RULES in their order. Where a rule is a phrase of BASE, it carries that phrase."""
    out, keyword = [], ""
    for line in RULES.strip("\n").split("\n"):
        if not line.startswith(" "):
            keyword = line
            continue
        label, rest = line[1:].split(" ", 1)
        behind = rest[1:]
        plain = keyword + behind.replace("licen[sc]e", "license")
        phrase = next((p for p in BASE if plain == p and BASE[p] == label), "")
        # a phrase is exact, so its rule is too
        out.append(Rule(len(out), keyword, label, int(rest[0]), f"^{phrase or keyword + behind} ", phrase))
    return tuple(out)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def table_of_rules() -> Column:
    """Keyword to its rules, a literal of fixed size."""
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    row = lambda r: F.struct(F.lit(r.rule).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern"), F.lit(r.phrase != "").alias("base"))
    return F.create_map(*[x for k, own in by.items() for x in (F.lit(k), F.array(*[row(r) for r in own]))])


def detections(words: Column) -> Column:
    """An array of (first, last, rule, label, priority, base), by first word, of every rule that matches anywhere."""
    keywords = {r.keyword for r in rules()}
    heads, single, double = sorted({k.split()[0] for k in keywords}), sorted(k for k in keywords if " " not in k), sorted(k for k in keywords if " " in k)
    table = table_of_rules()
    none = F.array().cast("array<struct<rule:int,label:string,priority:int,pattern:string,base:boolean>>")

    def at(word: Column, i: Column) -> Column:
        window = F.concat(F.array_join(F.slice(words, i + 1, REACH), " "), F.lit(" "))
        pair = F.concat(word, F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit("")))
        own = F.concat(*[F.when(k.isin(known), F.try_element_at(table, k)).otherwise(none) for k, known in ((pair, double), (word, single))])
        tried = F.transform(own, lambda r: F.struct(F.call_function("regexp_extract", window, r["pattern"], F.lit(0)).alias("hit"), r.alias("r")))
        last = lambda hit: i + F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit(""))) - 1
        return F.transform(
            F.filter(tried, lambda t: t["hit"] != ""),
            lambda t: F.struct(i.alias("first"), last(t["hit"]).alias("last"), t["r"]["rule"].alias("rule"), t["r"]["label"].alias("label"), t["r"]["priority"].alias("priority"), t["r"]["base"].alias("base")),
        )

    hits = F.transform(words, lambda w, i: F.when(w.isin(heads), at(w, i)))
    return F.flatten(F.filter(hits, lambda h: h.isNotNull() & (F.size(h) > 0)))


def settled(found: Column) -> Column:
    """Of detections in the order of their first words, those that no other one of at least their priority contains.

    Of two of the same words and priority the earlier rule stays. What contains a detection begins less than REACH words before
    it, so only its neighbours are compared, and a text of any length takes time in proportion.
    """
    deepest = max(sum(r.keyword == k for r in rules()) + sum(r.keyword == k.split()[0] for r in rules()) for k in {r.keyword for r in rules()})
    near = REACH * deepest

    def inside(a: Column, b: Column) -> Column:
        """Whether b makes a go."""
        wider = (b["first"] < a["first"]) | (b["last"] > a["last"])
        better = (b["priority"] > a["priority"]) | (b["priority"] == a["priority"]) & (wider | (b["rule"] < a["rule"]))
        return (b["first"] <= a["first"]) & (b["last"] >= a["last"]) & better

    def stays(a: Column, k: Column) -> Column:
        start = F.greatest(k + 1 - near, F.lit(1))
        return ~F.exists(F.slice(found, start, k - start + 1 + deepest), lambda b: inside(a, b))

    return F.filter(found, stays)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, found, kept): every whole text's detections, and those that stay.

    Each row is answered by itself, repeated ones too, in one pass without a shuffle. A null or empty text has no words and no detections;
    texts of any length are read whole. Further columns aren't read.
    """
    words = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    found = words.select("doc_id", F.size("words").cast("long").alias("n_words"), detections(F.col("words")).alias("found"))
    return found.select("doc_id", "n_words", "found", settled(F.col("found")).alias("kept"))


def summary(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of scanned rows.

    ``score`` is the chance that one of the labels that stay is right, by the weight of the best detection of each.
    """
    base = F.filter("found", lambda d: d["base"])
    firsts = F.transform(base, lambda d: d["first"].cast("long"))
    own = F.transform(base, lambda d: d["label"])
    every = F.array_union(own, F.transform("kept", lambda d: d["label"]))
    weight = F.create_map(*[x for p, w in WEIGHTS.items() for x in (F.lit(p), F.lit(w))])
    best = F.transform(F.array_distinct(F.transform("kept", lambda d: d["label"])), lambda one: F.array_max(F.transform(F.filter("kept", lambda d: d["label"] == one), lambda d: d["priority"])))
    score = 1 - F.aggregate(best, F.lit(1.0), lambda left, p: left * (1 - F.element_at(weight, p)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), joined(own).alias("base_labels"), joined(every).alias("labels"), F.round(score, 6).alias("score"))
