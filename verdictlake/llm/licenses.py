"""License scans by ordered signature rules, as column expressions only: no row leaves its partition.

A text becomes its words, each with a space on either side. RULES is an ordered table of regular expressions: license tags,
signatures written by hand (grant and disclaimer sentences, addresses, glued names such as gplv3), and the names of license
families with their versions and the ways a license is mentioned. A rule runs only on texts that hold its keyword, and rules are
looked at only under GATES that the text holds. Every place a rule matches is a detection. A detection inside
another one of an earlier priority (a grant with a version before a name with a version, before a bare name), or of the same
priority but longer or from an earlier rule, is suppressed. Labels are those of the detections left, and the base labels.

Defined cases: null texts have no words and no license; base phrases count wherever their words stand side by side, whatever
separates them; repeated rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import ASCII_LOWER, NON_WORD, spaced

#: Phrase and label of the base search.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, names, versions.
FAMILIES = (
    ("mit", ("mit license", "expat license"), ()),
    ("apache", ("apache license", "apache software license", "apache licence"), ("1.0", "1.1", "2.0")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public license", "lesser general public license", "library general public license", "lgpl"), ("2", "2.1", "3")),
    ("agpl", ("gnu affero general public license", "affero general public license", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3")),
    ("bsd", ("bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd"), ()),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("eupl", ("european union public license", "european union public licence", "eupl"), ("1.0", "1.1", "1.2")),
    ("isc", ("isc license",), ()),
    ("zlib", ("zlib license",), ()),
    ("bsl", ("boost software license",), ("1.0",)),
    ("artistic", ("artistic license",), ("1.0", "2.0")),
    ("unlicense", ("the unlicense", "unlicense license"), ()),
    ("ofl", ("open font license",), ("1.0", "1.1")),
    ("psf", ("python software foundation license", "psf license"), ("2",)),
    ("odbl", ("open database license", "odbl"), ("1.0",)),
    ("ms-pl", ("microsoft public license",), ()),
    ("osl", ("open software license",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("postgresql", ("postgresql license",), ()),
    ("cc0", ("cc0", "creative commons zero"), ("1.0",)),
    *((f"cc-by{a}", (f"cc by{b}", f"creative commons attribution{c}"), ("1.0", "2.0", "2.5", "3.0", "4.0")) for a, b, c in (("", "", ""), ("-sa", " sa", " sharealike"), ("-nd", " nd", " noderivatives"), ("-nc", " nc", " noncommercial"), ("-nc-sa", " nc sa", " noncommercial sharealike"), ("-nc-nd", " nc nd", " noncommercial noderivatives"))),
)

#: Signatures written by hand: label | priority | confidence | keyword | words in order. [x y] may be missing, (x|y z) is one of
#: the ways to say it. The keyword is part of every match, and begins with the word under which the rule is gated.
SIGNATURES = """
mit | 0 | 1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software [and associated documentation files]
mit | 0 | 0.9 | copyright notice and this permission notice | the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software
mit | 2 | 0.7 | software is provided as is without warranty of any kind express or implied | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 3 | 0.8 | licensed under | licensed under [the] mit
mit | 1 | 0.9 | mit licensed | mit licensed
mit | 1 | 0.95 | licenses mit | (opensource org|mit edu|choosealicense com) licenses mit
mit-0 | 0 | 0.95 | mit no attribution | mit no attribution
x11 | 0 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used
expat | 3 | 0.8 | expat license | expat license
apache-2.0 | 0 | 1.0 | licensed under the apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 0 | 0.9 | license is distributed on an as is basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | 1 | 0.95 | apache org licenses license 2 0 | [www] apache org licenses license 2 0
apache-2.0 | 1 | 0.9 | licensed to the apache software foundation | licensed to the apache software foundation [asf] under one or more contributor license agreements
apache-2.0 | 0 | 0.95 | terms and conditions for use reproduction and distribution | apache license version 2 0 january 2004 [http www apache org licenses] terms and conditions for use reproduction and distribution
apache-2.0 | 1 | 0.9 | license apache 2 0 | license apache 2 0
apache-2.0 | 2 | 0.8 | apache2 | apache2 [license]
apache-2.0 | 2 | 0.8 | asl 2 0 | asl 2 0
apache-1.1 | 0 | 0.95 | product includes software developed by the apache | this product includes software developed by the apache (software foundation|group)
gpl | 0 | 0.95 | redistribute it and or modify it under the terms of the gnu general public license | redistribute it and or modify it under the terms of the gnu general public license [as published by the free software foundation]
gpl-2 | 0 | 1.0 | gnu general public license as published by the free software foundation either version 2 | gnu general public license as published by the free software foundation either version 2 of the license or [at your option] any later version
gpl-3 | 0 | 1.0 | gnu general public license as published by the free software foundation either version 3 | gnu general public license as published by the free software foundation either version 3 of the license or [at your option] any later version
gpl-2 | 0 | 0.95 | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3 | 0 | 0.95 | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl | 1 | 0.85 | copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (program|software|library|file)
gpl | 1 | 0.95 | gnu org licenses gpl | [www] gnu org licenses gpl [html|txt]
gpl-2 | 1 | 0.95 | gnu org licenses old licenses gpl 2 0 | [www] gnu org licenses old licenses gpl 2 0
gpl-3 | 1 | 0.95 | gnu org licenses gpl 3 0 | [www] gnu org licenses gpl 3 0
gpl-2 | 2 | 0.85 | gplv2 | [gnu] gplv2 [or later]
gpl-3 | 2 | 0.85 | gplv3 | [gnu] gplv3 [or later]
gpl-2 | 2 | 0.8 | gpl2 | [gnu] gpl2
gpl-3 | 2 | 0.8 | gpl3 | [gnu] gpl3
gpl | 1 | 0.85 | gpl compatible | gpl compatible
gpl | 1 | 0.9 | module license gpl | module license gpl [v2]
gpl | 2 | 0.8 | copyleft license | copyleft license
lgpl | 0 | 0.95 | gnu lesser general public license as published | gnu lesser general public license as published by the free software foundation
lgpl-2.1 | 0 | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3 | 0 | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2 | 0 | 0.95 | gnu library general public license | gnu library general public license [as published by the free software foundation]
lgpl-2.1 | 1 | 0.95 | gnu org licenses old licenses lgpl 2 1 | [www] gnu org licenses old licenses lgpl 2 1
lgpl | 1 | 0.95 | gnu org licenses lgpl | [www] gnu org licenses lgpl
lgpl-2 | 2 | 0.85 | lgplv2 | lgplv2
lgpl-2.1 | 2 | 0.85 | lgplv2 1 | lgplv2 1
lgpl-3 | 2 | 0.85 | lgplv3 | lgplv3
lgpl | 2 | 0.8 | lgpl2 | lgpl2
lgpl | 2 | 0.8 | lgpl3 | lgpl3
agpl | 0 | 0.95 | gnu affero general public license as published | gnu affero general public license as published by the free software foundation
agpl-3 | 0 | 0.95 | gnu affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl | 1 | 0.95 | gnu org licenses agpl | [www] gnu org licenses agpl
agpl-3 | 2 | 0.85 | agplv3 | agplv3
agpl-3 | 2 | 0.8 | agpl3 | agpl3
agpl | 1 | 0.9 | remote network interaction | remote network interaction use with the gnu general public license
gfdl | 0 | 0.95 | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 1 | 0.95 | gnu org licenses fdl | [www] gnu org licenses fdl
gfdl | 1 | 0.95 | gnu org copyleft fdl | [www] gnu org copyleft fdl
gpl-exception | 2 | 0.8 | classpath exception | [with] classpath exception
gpl-exception | 2 | 0.8 | linking exception | [with] linking exception
gpl-exception | 2 | 0.8 | gcc runtime library exception | gcc runtime library exception
bsd | 0 | 0.95 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted [provided that the following conditions are met]
bsd | 1 | 0.85 | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 1 | 0.85 | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3 | 0 | 0.95 | contributors may be used to endorse or promote products | neither the name of the (copyright holder|university|authors|author|company|organization) nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4 | 0 | 0.95 | advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | 2 | 0.7 | copyright holders and contributors as is | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-2 | 1 | 0.95 | licenses bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3 | 1 | 0.95 | licenses bsd 3 clause | opensource org licenses bsd 3 clause
bsd | 1 | 0.9 | licenses bsd license | opensource org licenses bsd license
bsd | 1 | 0.9 | bsd style license | bsd style license
bsd-3 | 1 | 0.9 | new bsd license | new bsd license
bsd-3 | 1 | 0.9 | modified bsd license | modified bsd license
bsd-3 | 1 | 0.9 | revised bsd license | revised bsd license
bsd-2 | 1 | 0.9 | simplified bsd license | simplified bsd license
bsd-2 | 1 | 0.9 | freebsd license | freebsd license
bsd-0 | 0 | 0.9 | zero clause bsd | [bsd] zero clause bsd [license]
bsd-0 | 0 | 0.9 | 0bsd | 0bsd
isc | 0 | 0.95 | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 1 | 0.8 | author disclaims all warranties with regard to this software | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | 1 | 0.95 | licenses isc | opensource org licenses isc [license]
hpnd | 0 | 0.9 | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose [and] without fee is hereby granted
zlib | 0 | 0.95 | software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0 | 0.9 | origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 1 | 0.8 | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
libpng | 1 | 0.9 | libpng license | libpng license
bsl-1.0 | 0 | 0.95 | boost software license version 1 0 17th august 2003 | boost software license version 1 0 17th august 2003
bsl-1.0 | 1 | 0.95 | boost org license 1 0 | [www] boost org license 1 0 [txt]
mpl-2.0 | 0 | 1.0 | source code form is subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license [v 2 0]
mpl-1.1 | 0 | 0.95 | contents of this file are subject to the mozilla public license | the contents of this file are subject to the mozilla public license [version 1 1]
mpl-2.0 | 1 | 0.95 | mozilla org mpl 2 0 | mozilla org mpl 2 0
mpl | 1 | 0.9 | mozilla org mpl | [www] mozilla org mpl
mpl-2.0 | 1 | 0.8 | incompatible with secondary licenses | incompatible with secondary licenses
npl | 1 | 0.9 | netscape public license | netscape public license
epl-1.0 | 0 | 0.95 | terms of this eclipse public license | accompanying program is provided under the terms of this eclipse public license
epl-2.0 | 1 | 0.95 | eclipse org legal epl 2 0 | [www] eclipse org legal epl 2 0
epl-1.0 | 1 | 0.95 | eclipse org legal epl v10 | [www] eclipse org legal epl v10
edl | 1 | 0.9 | eclipse distribution license | eclipse distribution license [v 1 0]
cpl-1.0 | 1 | 0.9 | common public license | common public license [version 1 0]
ipl-1.0 | 1 | 0.9 | ibm public license | ibm public license [version 1 0]
cddl-1.0 | 0 | 0.95 | common development and distribution license the license | terms of the common development and distribution license the license
sissl | 1 | 0.9 | sun industry standards source license | sun industry standards source license
unlicense | 0 | 1.0 | unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 1 | 0.95 | unlicense org | unlicense org
public-domain | 2 | 0.75 | public domain | (released|placed|dedicated|is) [into|in|to] [the] public domain
cc0-1.0 | 0 | 0.95 | copyright and related or neighboring rights | waived all copyright and related or neighboring rights
cc0-1.0 | 1 | 0.95 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
cc-by | 1 | 0.9 | creativecommons org licenses by | creativecommons org licenses by [2 0|2 5|3 0|4 0]
cc-by-sa | 1 | 0.95 | creativecommons org licenses by sa | creativecommons org licenses by sa [2 0|2 5|3 0|4 0]
cc-by-nd | 1 | 0.95 | creativecommons org licenses by nd | creativecommons org licenses by nd [2 0|2 5|3 0|4 0]
cc-by-nc | 1 | 0.95 | creativecommons org licenses by nc | creativecommons org licenses by nc [2 0|2 5|3 0|4 0]
cc-by-nc-sa | 1 | 0.97 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [2 0|2 5|3 0|4 0]
cc-by-nc-nd | 1 | 0.97 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [2 0|2 5|3 0|4 0]
wtfpl | 0 | 0.95 | do what the fuck you want to public license | do what the fuck you want to public license
wtfpl | 1 | 0.9 | wtfpl | wtfpl
beerware | 0 | 0.9 | beer ware license | beer ware license
beerware | 1 | 0.9 | buy me a beer in return | you can buy me a beer in return
artistic-2.0 | 1 | 0.95 | licenses artistic license 2 0 | [opensource org] licenses artistic license 2 0
perl | 1 | 0.9 | same terms as perl itself | under the same terms as perl itself
ruby | 1 | 0.9 | same terms as ruby | under the same terms as ruby
ruby | 1 | 0.85 | ruby license | ruby license
php-3.01 | 1 | 0.95 | php license version 3 01 | php license version 3 01
php | 2 | 0.85 | php license | php license
python-2.0 | 0 | 0.95 | psf license agreement for python | psf license agreement for python
python-2.0 | 1 | 0.9 | cnri open source license agreement | cnri open source license agreement
openssl | 0 | 0.95 | openssl toolkit | product includes software developed by the openssl project for use in the openssl toolkit
openssl | 1 | 0.9 | openssl license | openssl license
ncsa | 1 | 0.9 | ncsa open source license | [university of illinois] ncsa open source license
postgresql | 1 | 0.9 | postgresql global development group | portions copyright c [1996] [2020] the postgresql global development group
w3c | 1 | 0.9 | w3c software notice and license | w3c software notice and license
w3c | 1 | 0.9 | w3c software and document | w3c software and document (notice and license|license)
upl-1.0 | 1 | 0.9 | universal permissive license | universal permissive license [version 1 0|v 1 0]
ecl-2.0 | 1 | 0.9 | educational community license | educational community license [version 2 0]
eupl-1.2 | 1 | 0.9 | licensed under the eupl | licensed under the eupl [version 1 2]
cecill | 1 | 0.9 | cecill license | [governed by the] cecill license
lppl-1.3 | 1 | 0.9 | latex project public license | latex project public license
qpl-1.0 | 1 | 0.9 | q public license | q public license [version 1 0]
ofl-1.1 | 1 | 0.95 | sil open font license | [this font software is licensed under the] sil open font license [version 1 1]
ofl-1.1 | 1 | 0.95 | scripts sil org ofl | scripts sil org ofl
sspl-1.0 | 1 | 0.95 | server side public license | server side public license [version 1]
busl-1.1 | 1 | 0.95 | business source license | business source license [1 1]
elastic-2.0 | 1 | 0.95 | elastic license | elastic license [2 0]
commons-clause | 1 | 0.95 | commons clause | commons clause [license condition]
rpl-1.5 | 1 | 0.9 | reciprocal public license | reciprocal public license
zpl-2.1 | 1 | 0.9 | zope public license | zope public license
ms-pl | 1 | 0.9 | microsoft public license | microsoft public license [ms pl]
ms-rl | 1 | 0.9 | microsoft reciprocal license | microsoft reciprocal license
mulanpsl-2.0 | 1 | 0.9 | mulan psl v2 | [licensed under] mulan psl v2
vim | 1 | 0.85 | vim license | vim license
sleepycat | 1 | 0.9 | sleepycat license | sleepycat license
unicode | 1 | 0.9 | unicode inc license agreement | unicode inc license agreement
json | 0 | 0.9 | shall be used for good not evil | the software shall be used for good not evil
curl | 1 | 0.85 | curl license | curl license
ijg | 1 | 0.85 | independent jpeg group | this software is based in part on the work of the independent jpeg group
freetype | 1 | 0.9 | freetype project license | freetype project license
pddl-1.0 | 1 | 0.9 | public domain dedication and license | public domain dedication and license
odc-by | 1 | 0.9 | open data commons attribution license | open data commons attribution license
proprietary | 2 | 0.6 | all rights reserved | (proprietary and confidential|confidential and proprietary) all rights reserved
proprietary | 2 | 0.6 | strictly prohibited | unauthorized copying of this file via any medium is strictly prohibited
eula | 2 | 0.7 | end user license agreement | end user license agreement
"""

#: License tags of package headers, by identifier; a dash or a point in one parts its words.
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-4.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 FTL GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later "
    "HPND IPL-1.0 ISC LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 "
    "OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()


class Rule(NamedTuple):
    id: int
    keyword: str
    regex: str
    label: str
    priority: int
    confidence: float


def _words(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _regex(signature: str) -> str:
    """The regular expression of a signature's words, each with a space on either side."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|\([^)]*\)|\S+", signature):
        ways = "|".join(map(_words, part.strip("[]()").split("|")))
        out += f"(?:{ways})?" if part[0] == "[" else f"(?:{ways})" if part[0] == "(" else ways
    return out


def make_rules() -> list[Rule]:
    """Tags and signatures by their own priority, then names: grants with a version, names with a version, grants without, bare names."""
    grant = "(?: licensed | released | distributed | available | provided | published )(?: under )(?: the )?(?: terms  of )?(?: the )?"
    rules: list[Rule] = []
    for tag in TAGS:
        words = _words(" ".join(re.split("[-.]", tag.lower())))
        rules.append(Rule(len(rules), _words("spdx license identifier"), _words("spdx license identifier") + words, tag.lower(), 0, 1.0))
    for line in SIGNATURES.strip().split("\n"):
        label, priority, confidence, keyword, signature = (x.strip() for x in line.split(" | "))
        rules.append(Rule(len(rules), _words(keyword), _regex(signature), label, int(priority), float(confidence)))
    for priority, confidence, granted, versioned in ((1, 1.0, True, True), (2, 0.9, False, True), (3, 0.8, True, False), (4, 0.6, False, False)):
        for label, names, versions in FAMILIES:
            for name in names:
                for version in versions if versioned else ("",):
                    first, *rest = version.split(".") if version else [""]
                    more = "".join(f" {x} " for x in rest) if rest != ["0"] else "(?: 0 )?"
                    tail = f"(?: license | licence | international )?(?: version | v )?(?: {first} | v{first} ){more}(?: or  later )?" if version else "(?: license | licence )?"
                    rules.append(Rule(len(rules), _words(name), (grant if granted else "") + _words(name) + tail, f"{label}-{version}" if version else label, priority, confidence))
    return rules


RULES = make_rules()


#: A text is looked at only if it holds one of these, and a rule only under the first that its keyword holds.
GATES = ("licen", "gpl", "bsd ", " mit ", "public", "software", "copyright", "redistribut", " org ", "commons", "fdl ", " mpl ", " epl ", "cddl", "eupl", "odbl", " cc ", " cc0 ", "apache", " asl ", "exception", "wtfpl", " psl ", "consortium", "permission", "terms", "contributors", "reserved", "prohibited", "remote", "features", " group ", "source", "toolkit", "good", "return")


def gate_of(rule: Rule) -> str:
    return next(g for g in GATES if g in rule.keyword)


def _table(rules: list[Rule]) -> Column:
    """The rules by their gates, one constant."""
    by_gate: dict[str, list[dict]] = {}
    for r in rules:
        by_gate.setdefault(gate_of(r), []).append(r._asdict())
    return F.from_json(F.lit(json.dumps([{"gate": g, "rules": own} for g, own in by_gate.items()])), "array<struct<gate:string,rules:array<struct<id:int,keyword:string,regex:string,label:string,priority:int,confidence:double>>>>")


#: Matches whose places are added up at a time.
STEP = 256


def _detections(text: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword the text holds: start, minus the end (both in characters), priority, rule, label, confidence."""

    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["p"]).alias("start"), (a["at"] + x["p"] + x["m"]).alias("stop")))).alias("out"))

    def laid(sizes: Column) -> Column:
        # the array grows by a step's matches at once, so that it isn't copied for each of many mentions
        return F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(sizes) / STEP).cast("int")),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, k: F.aggregate(F.slice(sizes, k * STEP + 1, STEP), F.struct(a["at"].alias("at"), none.alias("out")), add, lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], b["out"]).alias("out"))),
            lambda a: a["out"],
        )

    def of(rule: Column) -> Column:
        pieces = F.transform(F.split(text, rule["regex"], F.lit(-1)), lambda x: F.length(x))
        matches = F.transform(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda x: F.length(x))
        # what stands before the k-th match, and the match; the last piece stands before none. An array of one, so that it is worked out once
        sizes = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: x["m"].isNotNull())
        places = F.flatten(F.transform(F.array(sizes), laid))
        return F.transform(places, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("minus_stop"), rule["priority"].alias("priority"), rule["id"].alias("id"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    open_ = F.flatten(F.transform(F.filter(_table(rules), lambda g: F.contains(text, g["gate"])), lambda g: g["rules"]))
    return F.flatten(F.transform(F.filter(open_, lambda r: F.contains(text, r["keyword"])), of))


def _kept(all_: Column) -> Column:
    """labels, confidence and n of the detections that no other hides, in one sweep over the text.

    In order of start, longer first, then by priority and rule, whatever hides a detection comes before it. Only detections that
    reach beyond the current place are looked at.
    """

    def hides(x: Column, y: Column) -> Column:
        # start minus stop is minus the length
        longer, same = (y["start"] + y["minus_stop"]) < (x["start"] + x["minus_stop"]), (y["start"] + y["minus_stop"]) == (x["start"] + x["minus_stop"])
        return (y["start"] <= x["start"]) & (y["minus_stop"] <= x["minus_stop"]) & ((y["priority"] < x["priority"]) | ((y["priority"] == x["priority"]) & (longer | (same & (y["id"] < x["id"])))))

    def step(a: Column, x: Column) -> Column:
        hidden = F.exists(a["open"], lambda y: hides(x, y))
        near = F.filter(a["open"], lambda y: y["minus_stop"] < -x["start"])
        on = F.struct(x["start"].alias("start"), x["minus_stop"].alias("minus_stop"), x["priority"].alias("priority"), x["id"].alias("id"))
        seen = F.struct(F.concat(near, F.array(on)).alias("open"), F.when(F.array_contains(a["labels"], x["label"]), a["labels"]).otherwise(F.concat(a["labels"], F.array(x["label"]))).alias("labels"), F.greatest(a["confidence"], x["confidence"]).alias("confidence"), (a["n"] + 1).alias("n"))
        return F.when(hidden, a).otherwise(seen)

    start = F.struct(F.array().cast("array<struct<start:int,minus_stop:int,priority:int,id:int>>").alias("open"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(all_), start, step, lambda a: F.struct(a["labels"].alias("labels"), a["confidence"].alias("confidence"), a["n"].alias("n")))


def _n_words(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    score is the highest confidence of a detection that is left, at least 0.6 where a base phrase occurs, else 0.
    """
    rules = RULES if rules is None else rules
    words = spaced(F.col(text_col))
    texts = df.select(F.col(id_col).alias("doc_id"), F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))).alias("t"))
    text = F.col("t")
    gated = F.lit(False)
    for gate in GATES:
        gated = gated | F.contains(text, F.lit(gate))
    texts = texts.select("doc_id", _n_words(text).alias("n_words"), F.when(gated, text).alias("t"))

    phrases = [(_words(p), label) for p, label in BASE]
    count = lambda p: F.coalesce((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p), F.lit(0)).cast("bigint")
    first = lambda p: F.when(F.contains(text, F.lit(p)), _n_words(F.substring(text, F.lit(1), F.instr(text, p) - 1)))
    last = lambda p: F.when(F.contains(text, F.lit(p)), _n_words(F.substring(text, F.lit(1), F.length(text) - F.instr(F.reverse(text), p[::-1]) + 1 - len(p))))
    found = texts.select(
        "doc_id",
        "n_words",
        sum((count(p) for p, _ in phrases[1:]), count(phrases[0][0])).alias("n_base"),
        F.least(*(first(p) for p, _ in phrases)).alias("first_word"),
        F.greatest(*(last(p) for p, _ in phrases)).alias("last_word"),
        F.filter(F.array(*(F.when(F.contains(text, F.lit(p)), F.lit(label)) for p, label in phrases)), lambda x: x.isNotNull()).alias("base"),
        F.when(text.isNotNull(), _detections(text, rules)).alias("all"),
    )
    found = found.withColumn("kept", F.when(F.col("all").isNotNull() & (F.size("all") > 0), _kept(F.col("all"))))
    own = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    sure = F.coalesce(F.col("kept.confidence"), F.lit(0.0))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(F.concat(F.col("base"), own)).alias("labels"), F.greatest(sure, F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"), F.coalesce(F.col("kept.n"), F.lit(0)).cast("bigint").alias("n_detections"))


def oracle() -> str:
    """The same scan in SQL, from the same rules."""
    values = ",\n".join(f"({r.id}, '{r.keyword}', '{r.regex}', '{r.label}', {r.priority}, {r.confidence})" for r in RULES)
    gate = " or ".join(f"contains(t, '{g}')" for g in GATES)
    base = ", ".join(f"('{_words(p)}', '{label}')" for p, label in BASE)
    return f"""
with recursive rules(id, keyword, regex, label, priority, confidence) as (values {values}),
base(phrase, label) as (values {base}),
w as (select row_number() over () rid, doc_id, trim(regexp_replace({ASCII_LOWER}, '{NON_WORD}', ' ', 'g')) s from documents),
d as (select rid, doc_id, case when s = '' then 0 else len(string_split(s, ' ')) end n_words, case when s = '' then '' else ' ' || replace(s, ' ', '  ') || ' ' end t from w),
g as (select * from d where {gate}),
b0 as (select rid, label, phrase, string_split(t, phrase) pieces from g join base on contains(t, phrase)),
b1 as (select rid, label, phrase, pieces, unnest(range(1, len(pieces))) k from b0),
b2 as (select rid, label, (list_sum(list_transform(pieces[1:k], lambda x: len(x) - len(replace(x, ' ', '')))) / 2 + (k - 1) * (len(phrase) - len(replace(phrase, ' ', ''))) / 2)::bigint word from b1),
b as (select rid, count(*) n_base, min(word) first_word, max(word) last_word, string_agg(distinct label, ',' order by label) base_labels from b2 group by 1),
m0 as (select rid, r.*, string_split_regex(t, regex) pieces, regexp_extract_all(t, regex) found from g join rules r on contains(t, keyword)),
m1 as (select *, unnest(range(1, len(found) + 1)) k from m0 where len(found) > 0),
m2 as (select rid, id, label, priority, confidence, list_sum(list_transform(pieces[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x))), 0) start, len(found[k]) size from m1),
m as (select * from m2 x where not exists (select 1 from m2 y where y.rid = x.rid and y.start <= x.start and y.start + y.size >= x.start + x.size
    and (y.priority < x.priority or (y.priority = x.priority and (y.size > x.size or (y.size = x.size and y.id < x.id)))))),
l as (select rid, string_agg(distinct label, ',' order by label) labels from (select rid, label from m union all select rid, label from b2) group by 1),
c as (select rid, count(*) n_detections, max(confidence) confidence from m group by 1)
select doc_id, n_words::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
    greatest(coalesce(confidence, 0)::double, case when n_base > 0 then 0.6 else 0 end::double) score, coalesce(n_detections, 0)::bigint n_detections
from d left join b using (rid) left join l using (rid) left join c using (rid)
"""
