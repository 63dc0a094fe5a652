"""Signature rules of the licence scan: label, tier and pattern, in order of priority.

Patterns are written for normalised text: lower-case words with one space between them, so ``Version 2.0`` reads
``version 2 0`` and ``CC-BY`` reads ``cc by``. Tiers, best first: 1 a sentence of the licence itself, 2 a notice or
identifier with its version, 3 a name without version, 4 a hint that some licence is meant. A pattern begins and
ends at words. Each needs a plain word outside of groups and options: the rarest serves as keyword of the prefilter.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    tier: int
    keyword: str
    pattern: str


#: Words too common to gate a rule, if it has another one.
COMMON = frozenset(
    "a an and any are as at be by for from in is it its of on or that the this to under with without you your all not no may use used work what want only software "
    "license licence licensed licenses version source code rights permission notice public general".split()
)

# Single rules: label | tier | pattern.
SINGLE = r"""
mit | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 2 | spdx license identifier mit
mit | 2 | licen[cs]e mit
mit | 3 | (?:the )?mit licen[cs]e
mit | 3 | (?:the )?expat licen[cs]e
x11 | 3 | (?:the )?x11 licen[cs]e
mit | 3 | opensource org licenses mit(?: license)?(?: php)?
mit-0 | 2 | mit no attribution(?: licen[cs]e)?
mit-0 | 2 | spdx license identifier mit 0
isc | 1 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
isc | 3 | (?:the )?isc licen[cs]e
isc | 2 | spdx license identifier isc
bsd | 1 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 1 | neither the name of (?:\S+ ){1,12}nor the names of (?:its|his|their) contributors may be used to endorse or promote products
bsd-4-clause | 1 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 3 | (?:the )?bsd (?:style )?licen[cs]e
bsd | 3 | bsd licensed
bsd-2-clause | 3 | (?:simplified|freebsd) bsd licen[cs]e
bsd-3-clause | 3 | (?:new|revised|modified) bsd licen[cs]e
bsd-3-clause | 3 | opensource org licenses bsd 3 clause
bsd-2-clause | 3 | opensource org licenses bsd 2 clause
0bsd | 3 | zero clause bsd(?: licen[cs]e)?
0bsd | 3 | bsd zero clause(?: licen[cs]e)?
0bsd | 2 | spdx license identifier 0bsd
apache-2.0 | 1 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | 1 | terms and conditions for use reproduction and distribution
apache-2.0 | 2 | (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[cs]e(?: version)? 2(?: 0)?
apache-2.0 | 2 | apache (?:software )?licen[cs]e(?: version)? 2(?: 0)?
apache-2.0 | 2 | apache 2(?: 0)?(?: licen[cs]e)?
apache-1.1 | 2 | apache (?:software )?licen[cs]e(?: version)? 1 1
apache-1.0 | 2 | apache (?:software )?licen[cs]e(?: version)? 1 0
apache-2.0 | 3 | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache | 3 | (?:the )?apache (?:software )?licen[cs]e
apache | 3 | apache licensed
asl | 4 | apache software foundation
gpl | 1 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl | 1 | this program is distributed in the hope that it will be useful but without any warranty
gpl | 1 | you should have received a copy of the gnu general public license
gpl | 1 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl | 1 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 1 | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | 1 | you should have received a copy of the gnu affero general public license
gpl | 3 | (?:the )?gnu general public licen[cs]e
gpl | 3 | (?:the )?gnu gpl
lgpl | 3 | (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
agpl | 3 | (?:the )?(?:gnu )?affero general public licen[cs]e
gpl | 4 | gpl (?:compatible|licensed|licen[cs]e)
lgpl | 4 | lgpl (?:compatible|licensed|licen[cs]e)
agpl | 4 | agpl (?:compatible|licensed|licen[cs]e)
gpl | 4 | free software foundation
gpl | 3 | (?:www )?gnu org licenses(?: gpl(?: html| txt)?)?
lgpl | 3 | (?:www )?gnu org licenses lgpl(?: html| txt)?
agpl | 3 | (?:www )?gnu org licenses agpl(?: html| txt)?
gfdl | 2 | gnu free documentation licen[cs]e version 1 [123]
gfdl | 3 | gnu free documentation licen[cs]e
gfdl | 1 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl-classpath | 1 | as a special exception the copyright holders of this library give you permission to link this library with independent modules
mpl | 1 | this source code form is subject to the terms of the mozilla public license
mpl | 1 | the contents of this file are subject to the mozilla public license
mpl | 3 | (?:the )?mozilla public licen[cs]e
mpl-2.0 | 3 | mozilla org mpl 2 0
mpl | 3 | mozilla org mpl
epl | 3 | (?:the )?eclipse public licen[cs]e
epl | 1 | this program and the accompanying materials are made available under the terms of the eclipse public license
edl-1.0 | 2 | eclipse distribution licen[cs]e (?:v ?|version )?1 0
cpl-1.0 | 2 | common public licen[cs]e (?:v ?|version )?1 0
cpl | 3 | (?:the )?common public licen[cs]e
ipl-1.0 | 3 | ibm public licen[cs]e
cddl | 3 | (?:the )?common development and distribution licen[cs]e
cddl | 1 | the contents of this file are subject to the terms of the common development and distribution license
eupl | 3 | (?:the )?european union public licen[cs]e
ms-pl | 3 | (?:the )?microsoft public licen[cs]e
ms-rl | 3 | (?:the )?microsoft reciprocal licen[cs]e
ms-pl | 2 | spdx license identifier ms pl
artistic | 3 | (?:the )?artistic licen[cs]e
artistic-2.0 | 2 | (?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-1.0 | 2 | (?:the )?artistic licen[cs]e(?: version)? 1(?: 0)?
perl | 3 | same terms as perl(?: itself)?
bsl-1.0 | 1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | 3 | (?:the )?boost software licen[cs]e
bsl-1.0 | 2 | (?:the )?boost software licen[cs]e(?: version)? 1 0
zlib | 1 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | 1 | altered source versions must be plainly marked as such
zlib | 3 | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 3 | (?:the )?libpng licen[cs]e
unlicense | 1 | this is free and unencumbered software released into the public domain
unlicense | 3 | (?:the )?unlicense
wtfpl | 3 | (?:the )?wtfpl
wtfpl | 3 | do what the fuck you want to public licen[cs]e
beerware | 3 | (?:the )?beer ?ware license
postgresql | 3 | (?:the )?postgresql licen[cs]e
python-2.0 | 3 | (?:the )?python software foundation licen[cs]e
python-2.0 | 2 | psf licen[cs]e(?: agreement)?(?: version)? 2
python | 4 | python software foundation
php-3.01 | 2 | php licen[cs]e(?: version)? 3 01
php-3.0 | 2 | php licen[cs]e(?: version)? 3 0
php | 3 | (?:the )?php licen[cs]e
ruby | 3 | (?:the )?ruby licen[cs]e
ruby | 3 | same terms as ruby(?: itself)?
w3c | 3 | w3c software(?: notice)?(?: and)? licen[cs]e
ncsa | 3 | university of illinois ncsa open source licen[cs]e
ncsa | 3 | ncsa open source licen[cs]e
openssl | 3 | (?:the )?openssl licen[cs]e
openssl | 1 | this product includes software developed by the openssl project
curl | 3 | (?:the )?curl licen[cs]e
icu | 3 | (?:the )?icu licen[cs]e
unicode | 3 | unicode licen[cs]e agreement
x11 | 1 | except as contained in this notice the name of the x consortium shall not be used
hpnd | 3 | historical permission notice and disclaimer
ofl-1.1 | 2 | sil open font licen[cs]e(?: version)? 1 1
ofl-1.0 | 2 | sil open font licen[cs]e(?: version)? 1 0
ofl | 3 | (?:the )?(?:sil )?open font licen[cs]e
ofl | 3 | scripts sil org ofl
vim | 3 | (?:the )?vim licen[cs]e
tcl | 3 | (?:the )?tcl tk licen[cs]e
qpl-1.0 | 3 | (?:the )?q public licen[cs]e
sleepycat | 3 | (?:the )?sleepycat licen[cs]e
sgi-b-2.0 | 3 | sgi free software licen[cs]e b
apsl | 3 | apple public source licen[cs]e
nasa | 3 | nasa open source agreement
osl | 3 | (?:the )?open software licen[cs]e
afl | 3 | (?:the )?academic free licen[cs]e
upl-1.0 | 3 | universal permissive licen[cs]e
blueoak-1.0.0 | 3 | blue oak model licen[cs]e
mulanpsl | 3 | mulan permissive software licen[cs]e
cecill | 3 | cecill(?: free software)? licen[cs]e
cecill | 3 | licence cecill
json | 1 | the software shall be used for good not evil
sspl | 3 | (?:the )?server side public licen[cs]e
busl | 3 | (?:the )?business source licen[cs]e
elastic | 3 | (?:the )?elastic licen[cs]e
commons-clause | 3 | (?:the )?commons clause(?: license condition)?
polyform | 3 | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[cs]e
openrail | 3 | (?:bigcode )?openrail(?: m| s)?(?: licen[cs]e)?
openrail | 3 | creativeml open ?rail m
llama | 3 | llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)?
odbl-1.0 | 2 | open data commons open database licen[cs]e(?: v1 0)?
odbl | 3 | (?:the )?open database licen[cs]e
odc-by | 3 | open data commons attribution licen[cs]e
pddl-1.0 | 3 | public domain dedication and licen[cs]e
ogl-uk | 3 | (?:the )?open government licen[cs]e
cc0-1.0 | 1 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 2 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | creative commons zero
cc0-1.0 | 3 | creativecommons org publicdomain zero(?: 1 0)?
public-domain | 2 | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | 4 | (?:in|into) the public domain
public-domain | 3 | creative commons public domain(?: mark)?
creative-commons | 3 | creative commons(?: licen[cs]e)?
creative-commons | 3 | creativecommons org licenses
reserved | 2 | copyright (?:c )?(?:19|20)[0-9]{2} (?:\S+ ){0,8}all rights reserved
reserved | 3 | all rights reserved
reserved | 3 | todos los derechos reservados
reserved | 3 | tous droits réservés
reserved | 3 | alle rechte vorbehalten
no-redistribution | 2 | (?:may|must) not be (?:reproduced|redistributed|copied)(?: distributed)?(?: or transmitted)?(?: in any form)? without (?:the )?(?:prior )?(?:written )?permission
no-redistribution | 2 | redistribution (?:is )?(?:strictly )?prohibited
proprietary | 2 | proprietary and confidential
proprietary | 2 | confidential and proprietary
proprietary | 3 | company confidential
proprietary | 2 | this software is (?:the )?proprietary
proprietary | 4 | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this file)? via any medium
proprietary | 4 | commercial licen[cs]e required
personal-use | 3 | for personal use only
non-commercial | 3 | for noncommercial use only
non-commercial | 3 | for non commercial use only
non-commercial | 4 | non commercial purposes(?: only)?
research-only | 3 | for research (?:purposes|use) only
evaluation-only | 3 | for evaluation purposes only
permission-required | 4 | used with permission
dual-license | 4 | dual licensed
warranty-disclaimer | 4 | the software is provided as is without warranty of any kind
warranty-disclaimer | 4 | without warranties or conditions of any kind
warranty-disclaimer | 4 | implied warranties of merchantability and fitness for a particular purpose
copyright | 4 | copyright (?:c )?(?:19|20)[0-9]{2}
copyright | 4 | copyright notice
copyright | 4 | copyrighted material
license-ref | 4 | spdx license identifier licenseref \S+
license-hint | 4 | released under (?:the )?(?:terms of )?(?:the )?(?:\S+ ){0,4}licen[cs]e
license-hint | 4 | licensed under (?:the )?(?:terms of )?(?:the )?(?:\S+ ){0,4}licen[cs]e
license-hint | 4 | distributed under (?:the )?(?:terms of )?(?:the )?(?:\S+ ){0,4}licen[cs]e
license-hint | 4 | see (?:the )?licen[cs]e(?: file)? for (?:details|more information|terms)
license-hint | 4 | licen[cs]e agreement
license-hint | 4 | terms of the licen[cs]e
license-hint | 4 | bajo (?:la )?licencia(?: de)? \S+
license-hint | 4 | sous (?:la )?licence \S+
license-hint | 4 | unter (?:der )?lizenz
"""

# Families: every version (and type) of a licence gives a notice, a short name and an identifier.
GNU = {"gpl": ("", ("1", "2", "3")), "lgpl": ("(?:lesser|library) ", ("2", "2 1", "3")), "agpl": ("affero ", ("1", "3"))}
CREATIVE = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative|ative works|atives|s)",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ative works|atives|s)",
}
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
NUMBERED = {
    "mpl": ("mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    "epl": ("eclipse public licen[cs]e", ("1 0", "2 0")),
    "cddl": ("common development and distribution licen[cs]e", ("1 0", "1 1")),
    "eupl": ("european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    "osl": ("open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    "afl": ("academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "cecill": ("cecill", ("1 0", "2 0", "2 1")),
    "apsl": ("apple public source licen[cs]e", ("1 0", "1 1", "1 2", "2 0")),
    "busl": ("business source licen[cs]e", ("1 0", "1 1")),
    "ogl-uk": ("open government licen[cs]e", ("1 0", "2 0", "3 0")),
    "mulanpsl": ("mulan permissive software licen[cs]e", ("1 0", "2 0")),
    "elastic": ("elastic licen[cs]e", ("1 0", "2 0")),
}


def families() -> list[tuple[str, int, str]]:
    """Rules of the families: ``label, tier, pattern``."""
    out = []
    for name, (kind, versions) in GNU.items():
        for version in versions:
            spoken = version if " " in version else f"{version}(?: 0)?"
            label = f"{name}-{version.replace(' ', '.')}" + ("" if " " in version else ".0")
            notice = rf"gnu {kind}general public licen[cs]e (?:v ?|version )?{spoken}"
            out.append((f"{label}-or-later", 2, rf"{notice}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?"))
            out.append((label, 2, rf"(?:under (?:the )?(?:terms of )?)?(?:the )?{notice}"))
            out.append((label, 2, rf"(?:gnu )?{name} (?:v ?|version )?{spoken}(?: only)?"))
            out.append((label, 2, rf"(?:gnu )?{name}v{spoken}"))
            out.append((label, 2, rf"spdx license identifier {name} {spoken}(?: only| or later)?"))
    for kind, spoken in CREATIVE.items():
        short = kind.replace("-", " ")
        out.append((f"cc-{kind}", 3, rf"cc {short}"))
        out.append((f"cc-{kind}", 3, rf"creative commons {spoken}(?: international| unported| generic)?(?: licen[cs]e)?"))
        out.append((f"cc-{kind}", 3, rf"creativecommons org licenses {short}"))
        for version in CREATIVE_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            out.append((label, 2, rf"cc {short} {version}"))
            out.append((label, 2, rf"creative commons {spoken} {version}(?: international| unported| generic)?(?: licen[cs]e)?"))
            out.append((label, 2, rf"creativecommons org licenses {short} {version}"))
    for name, (spoken, versions) in NUMBERED.items():
        for version in versions:
            label = f"{name}-{version.replace(' ', '.')}"
            out.append((label, 2, rf"(?:the )?{spoken} (?:v ?|version )?{version}"))
            out.append((label, 2, rf"spdx license identifier {name.replace('-', ' ')} {version}"))
    for n, spoken in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        out.append((f"bsd-{n}-clause", 2, rf"(?:{n}|{spoken}) clause bsd(?: licen[cs]e)?"))
        out.append((f"bsd-{n}-clause", 2, rf"bsd (?:{n}|{spoken}) clause(?: licen[cs]e)?"))
        out.append((f"bsd-{n}-clause", 2, rf"spdx license identifier bsd {n} clause"))
    return out


def plain_words(pattern: str) -> list[str]:
    """Whole words that every match of the pattern holds: those outside of groups and without regex signs."""
    bare, depth, begin = [], 0, 0
    for i, sign in enumerate(pattern):
        if sign == "(":
            depth += 1
            begin = i if depth == 1 else begin
        elif sign == ")":
            depth -= 1
            if depth == 0:  # a group stands for itself; what it keeps apart stays apart
                choices = pattern[begin + 3 : i].split("|")
                bare.append(" " * all(c.startswith(" ") for c in choices) + "\0" + " " * all(c.endswith(" ") for c in choices))
        elif depth == 0:
            # the quantifier of a group stays with the group, before the space that sets the next word off
            after_group = sign == "?" and bare and bare[-1].endswith("\0 ")
            bare.append("" if after_group else sign)
    return [w for w in re.split(r" (?!\?)", "".join(bare)) if re.fullmatch(r"\w+", w)]


def _gated(label: str, tier: int, pattern: str) -> Rule:
    found = plain_words(pattern)
    if not found:
        raise ValueError(f"no plain word in {pattern!r}")
    return Rule(label, tier, max(found, key=lambda w: (w not in COMMON, len(w))), pattern)


def all_rules() -> list[Rule]:
    """Every rule; those of one tier rank in this order."""
    single = [tuple(x.strip() for x in line.split(" | ")) for line in SINGLE.strip().splitlines()]
    rules = [_gated(label, int(tier), pattern) for label, tier, pattern in single] + [_gated(*f) for f in families()]
    return sorted(rules, key=lambda r: r.tier)
