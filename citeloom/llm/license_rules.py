"""Signature rules of the license scan, in order: level, label, keyword and pattern.

Patterns are regular expressions over normalised text: lower-case words (letters and digits) with one blank between them, so
"Apache-2.0" reads "apache 2 0". A match begins and ends at a word's edge. {2.0} stands for the spellings of a version ("version 2
0", "v2", "2"), {or later} for an optional "or later" or "only". A named license (levels 2 and 3) takes in the words that put a work
under it ("released under the"). A keyword is a text that every match of the rule holds, from a word's beginning. Levels:
1 identifiers and addresses, 2 a license with its version, 3 a license without, 4 characteristic sentences, 5 mentions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Certainty of a detection, by level.
CERTAINTY = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.3}


class Rule(NamedTuple):
    level: int
    label: str
    keyword: str
    pattern: str


_WRITTEN = """
1 gpl-1.0 | gpl | (?:spdx )?license identifier gpl 1 0(?: only| or later)?
1 gpl-2.0 | gpl | (?:spdx )?license identifier gpl 2 0(?: only| or later)?
1 gpl-3.0 | gpl | (?:spdx )?license identifier gpl 3 0(?: only| or later)?
1 lgpl-2.0 | lgpl | (?:spdx )?license identifier lgpl 2 0(?: only| or later)?
1 lgpl-2.1 | lgpl | (?:spdx )?license identifier lgpl 2 1(?: only| or later)?
1 lgpl-3.0 | lgpl | (?:spdx )?license identifier lgpl 3 0(?: only| or later)?
1 agpl-3.0 | agpl | (?:spdx )?license identifier agpl 3 0(?: only| or later)?
1 gfdl | gfdl | (?:spdx )?license identifier gfdl 1 [123](?: only| or later)?
1 mit | licen | (?:spdx )?license identifier mit
1 mit-0 | licen | (?:spdx )?license identifier mit 0
1 x11 | licen | (?:spdx )?license identifier x11
1 apache-1.1 | apache | (?:spdx )?license identifier apache 1 1
1 apache-2.0 | apache | (?:spdx )?license identifier apache 2 0
1 bsd-2-clause | bsd | (?:spdx )?license identifier bsd 2 clause(?: patent| views)?
1 bsd-3-clause | bsd | (?:spdx )?license identifier bsd 3 clause(?: clear| lbnl)?
1 bsd-4-clause | bsd | (?:spdx )?license identifier bsd 4 clause(?: uc)?
1 0bsd | 0bsd | (?:spdx )?license identifier 0bsd
1 isc | licen | (?:spdx )?license identifier isc
1 mpl-1.1 | mpl | (?:spdx )?license identifier mpl 1 1
1 mpl-2.0 | mpl | (?:spdx )?license identifier mpl 2 0
1 epl-1.0 | epl | (?:spdx )?license identifier epl 1 0
1 epl-2.0 | epl | (?:spdx )?license identifier epl 2 0
1 eupl | eupl | (?:spdx )?license identifier eupl 1 [012]
1 cddl | cddl | (?:spdx )?license identifier cddl 1 [01]
1 bsl-1.0 | licen | (?:spdx )?license identifier bsl 1 0
1 busl-1.1 | licen | (?:spdx )?license identifier busl 1 1
1 zlib | licen | (?:spdx )?license identifier zlib
1 unlicense | licen | (?:spdx )?license identifier unlicense
1 wtfpl | wtfpl | (?:spdx )?license identifier wtfpl
1 artistic-2.0 | artistic | (?:spdx )?license identifier artistic 2 0
1 ofl-1.1 | licen | (?:spdx )?license identifier ofl 1 1
1 postgresql | licen | (?:spdx )?license identifier postgresql
1 python-2.0 | licen | (?:spdx )?license identifier (?:psf|python) 2 0
1 ncsa | licen | (?:spdx )?license identifier ncsa
1 sspl-1.0 | sspl | (?:spdx )?license identifier sspl 1 0
1 odbl-1.0 | odbl | (?:spdx )?license identifier odbl 1 0
1 cc0-1.0 | cc0 | (?:spdx )?license identifier cc0 1 0
1 apache-2.0 | apache | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
1 apache-1.1 | apache | (?:https? )?(?:www )?apache org licenses license 1 1(?: txt)?
1 gpl-2.0 | gnu | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
1 gpl-3.0 | gnu | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: txt| html)?
1 lgpl-2.1 | gnu | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
1 lgpl-3.0 | gnu | (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: txt| html)?
1 agpl-3.0 | gnu | (?:https? )?(?:www )?gnu org licenses agpl 3 0(?: txt| html)?
1 gfdl | gnu | (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [123])?(?: txt| html)?
1 gpl | gnu | (?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)?
1 mit | licen | (?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
1 isc | licen | (?:https? )?(?:www )?opensource org licenses? isc(?: license)?(?: php| html)?
1 bsd-2-clause | bsd | (?:https? )?(?:www )?opensource org licenses? bsd 2 clause
1 bsd-3-clause | bsd | (?:https? )?(?:www )?opensource org licenses? bsd (?:3 clause|license)(?: php)?
1 artistic-2.0 | artistic | (?:https? )?(?:www )?opensource org licenses? artistic (?:license )?2 0
1 mpl-2.0 | mozilla | (?:https? )?(?:www )?mozilla org mpl 2 0
1 mpl-1.1 | mozilla | (?:https? )?(?:www )?mozilla org mpl(?: mpl)? 1 1(?: html)?
1 epl-1.0 | eclipse | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
1 epl-2.0 | eclipse | (?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
1 unlicense | unlicense | (?:https? )?(?:www )?unlicense org
1 wtfpl | wtfpl | (?:https? )?(?:www )?wtfpl net
1 bsl-1.0 | boost | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
1 ofl-1.1 | scripts sil | (?:https? )?scripts sil org ofl(?: license)?
1 odbl-1.0 | odbl | (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0| summary)?
1 odc-by-1.0 | opendatacommons | (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0| summary)?
1 pddl-1.0 | pddl | (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0| summary)?
1 cc0-1.0 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
1 public-domain | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
2 gpl-1.0 | public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? {1.0}{or later}
2 gpl-2.0 | public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? {2.0}{or later}
2 gpl-3.0 | public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? {3.0}{or later}
2 gpl-1.0 | gpl | (?:gnu )?gpl {1.0}{or later}
2 gpl-2.0 | gpl | (?:gnu )?gpl {2.0}{or later}
2 gpl-3.0 | gpl | (?:gnu )?gpl {3.0}{or later}
2 gpl-2.0 | gpl | (?:gnu )?gplv?2(?: 0)?{or later}
2 gpl-3.0 | gpl | (?:gnu )?gplv?3(?: 0)?{or later}
2 lgpl-2.0 | public license | (?:gnu )?(?:library|lesser) general public license(?: as published by the free software foundation)?(?: either)? {2.0}{or later}
2 lgpl-2.1 | public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? {2.1}{or later}
2 lgpl-3.0 | public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? {3.0}{or later}
2 lgpl-2.0 | lgpl | (?:gnu )?lgpl {2.0}{or later}
2 lgpl-2.1 | lgpl | (?:gnu )?lgpl {2.1}{or later}
2 lgpl-3.0 | lgpl | (?:gnu )?lgpl {3.0}{or later}
2 lgpl-2.1 | lgpl | (?:gnu )?lgplv?2 1{or later}
2 lgpl-3.0 | lgpl | (?:gnu )?lgplv?3(?: 0)?{or later}
2 agpl-1.0 | public license | affero general public license {1.0}
2 agpl-3.0 | public license | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? {3.0}{or later}
2 agpl-3.0 | agpl | (?:gnu )?agpl {3.0}{or later}
2 agpl-3.0 | agpl | (?:gnu )?agplv?3(?: 0)?{or later}
2 gfdl | documentation license | (?:gnu )?free documentation license {1.[123]}{or later}
2 gfdl | gfdl | (?:gnu )?gfdl {1.[123]}{or later}
2 apache-1.0 | apache | apache(?: software)?(?: license)? {1.0}
2 apache-1.1 | apache | apache(?: software)?(?: license)? {1.1}
2 apache-2.0 | apache | apache(?: software)?(?: license)? {2.0}
2 apache-2.0 | apache | asl {2.0} apache
2 mpl-1.0 | mozilla | mozilla public license {1.0}
2 mpl-1.1 | mozilla | mozilla public license {1.1}
2 mpl-2.0 | mozilla | mozilla public license {2.0}
2 mpl-1.1 | mpl | mpl {1.1}
2 mpl-2.0 | mpl | mpl {2.0}
2 epl-1.0 | eclipse | eclipse public license {1.0}
2 epl-2.0 | eclipse | eclipse public license {2.0}
2 epl-1.0 | epl | epl {1.0}
2 epl-2.0 | epl | epl {2.0}
2 edl-1.0 | eclipse | eclipse distribution license {1.0}
2 eupl | european union | european union public licen[cs]e {1.[012]}
2 eupl | eupl | eupl {1.[012]}
2 cddl | common development | common development and distribution license(?: cddl)? {1.[01]}
2 cddl | cddl | cddl {1.[01]}
2 cpl-1.0 | common public | common public license {1.0}
2 ipl-1.0 | public license | ibm public license {1.0}
2 artistic-1.0 | artistic | artistic license {1.0}
2 artistic-2.0 | artistic | artistic license {2.0}
2 bsl-1.0 | boost | boost software license {1.0}
2 busl-1.1 | business source | business source license {1.1}
2 ofl-1.0 | open font | (?:sil )?open font license {1.0}
2 ofl-1.1 | open font | (?:sil )?open font license {1.1}
2 afl-3.0 | academic free | academic free license {3.0}
2 afl-2.1 | academic free | academic free license {2.1}
2 osl-3.0 | open software | open software license {3.0}
2 osl-2.1 | open software | open software license {2.1}
2 odbl-1.0 | open database | open (?:data commons open )?database license(?: odbl)? {1.0}
2 odc-by-1.0 | open data commons | open data commons attribution license {1.0}
2 pddl-1.0 | public domain | (?:open data commons )?public domain dedication and licen[cs]e(?: pddl)? {1.0}
2 sspl-1.0 | server side | server side public license {1.0}
2 elastic-2.0 | elastic | elastic license {2.0}
2 lppl | latex | latex project public license {1.[0123]}
2 php-3.0 | php license | php license {3.0}
2 php-3.01 | php license | php license {3.01}
2 python-2.0 | psf | psf license {2.0}
2 python-2.0 | python | python(?: software foundation)? license {2.0}
2 zpl-2.1 | zope | zope public license {2.1}
2 zpl-2.0 | zope | zope public license {2.0}
2 npl-1.1 | netscape | netscape public license {1.1}
2 apsl-2.0 | apple | apple public source license {2.0}
2 cecill-2.1 | cecill | cecill(?: free software license agreement)? {2.1}
2 cecill-2.0 | cecill | cecill(?: free software license agreement)? {2.0}
2 upl-1.0 | permissive | universal permissive license {1.0}
2 polyform | polyform | polyform (?:noncommercial|perimeter|shield|strict|small business|internal use)(?: license)? {1.0}
2 rail-m | openrail | (?:creativeml |bigscience )?openrail(?: m| s)?(?: license)?(?: v1)?
2 rail-m | rail | (?:creativeml |bigscience )?open rail(?: m| s)?(?: license)?(?: v1)?
2 ogl-3.0 | open government | open government licen[cs]e {3.0}
2 ogl-2.0 | open government | open government licen[cs]e {2.0}
2 etalab-2.0 | etalab | (?:licence ouverte )?etalab {2.0}
2 dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung {2.0}
3 gpl | public license | gnu general public license
3 lgpl | public license | (?:gnu )?(?:library|lesser) general public license
3 agpl | public license | (?:gnu )?affero general public license
3 gpl | gpl | gnu gpl
3 lgpl | lgpl | (?:gnu )?lgpl
3 agpl | agpl | (?:gnu )?agpl
3 gfdl | documentation license | (?:gnu )?free documentation license
3 mit | licen | (?:mit|expat)(?: x11)?(?: style)? licen[cs]e
3 mit | licen | licen[cs]ed under(?: the)?(?: terms of)?(?: the)? (?:mit|expat)
3 x11 | licen | x11 licen[cs]e
3 bsd-2-clause | bsd | (?:2|two) clause bsd(?: license)?
3 bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: license)?
3 bsd-2-clause | bsd | bsd (?:2|two) clause(?: license)?
3 bsd-3-clause | bsd | (?:3|three) clause bsd(?: license)?
3 bsd-3-clause | bsd | (?:new|modified|revised) bsd(?: license)?
3 bsd-3-clause | bsd | bsd (?:3|three) clause(?: license)?
3 bsd-4-clause | bsd | (?:4|four) clause bsd(?: license)?
3 bsd-4-clause | bsd | (?:original|old) bsd license
3 bsd-4-clause | bsd | bsd (?:4|four) clause(?: license)?
3 0bsd | bsd | (?:zero|0) clause bsd(?: license)?
3 bsd | bsd | bsd(?: style)? licen[cs]e
3 apache | apache | apache(?: software)? licen[cs]e
3 isc | licen | isc licen[cs]e
3 isc | internet systems | internet systems consortium license
3 mpl | mozilla | mozilla public license
3 epl | eclipse | eclipse public license
3 eupl | european union | european union public licen[cs]e
3 cddl | common development | common development and distribution license
3 artistic | artistic | (?:perl )?artistic license
3 bsl-1.0 | boost | boost software license
3 busl | business source | business source license
3 zlib | licen | zlib(?: libpng)? licen[cs]e
3 libpng | licen | libpng licen[cs]e
3 unlicense | unlicense | unlicense
3 wtfpl | wtfpl | wtfpl
3 wtfpl | do what the | do what the \\S+ you want to public license
3 beerware | beerware | beerware license
3 beerware | beer ware | beer ware license
3 json | licen | json license
3 openssl | openssl | openssl license
3 ssleay | ssleay | (?:original )?ssleay license
3 postgresql | postgresql | postgresql licen[cs]e
3 php | php license | php license
3 python | python | python(?: software foundation)? license
3 ruby | ruby | ruby s? ?license
3 perl | perl | same terms as perl(?: itself)?
3 vim | vim license | vim license
3 tcl | licen | tcl tk license
3 ncsa | licen | (?:university of illinois )?ncsa open source license
3 sleepycat | sleepycat | sleepycat license
3 qpl | q public | q public license
3 lppl | latex | latex project public license
3 ms-pl | microsoft | microsoft public license
3 ms-rl | microsoft | microsoft reciprocal license
3 ofl | open font | (?:sil )?open font license
3 odbl | open database | open database license
3 sspl | server side | server side public license
3 elastic | elastic | elastic license
3 commons-clause | commons clause | commons clause(?: license condition)?
3 hippocratic | hippocratic | hippocratic license
3 polyform | polyform | polyform(?: project)? license
3 cecill | cecill | (?:licence |license )?cecill
3 curl | curl license | curl license
3 ijg | jpeg | independent jpeg group s license
3 icu | licen | (?:unicode )?icu license
3 unicode | unicode | unicode (?:license|terms of use)
3 w3c | w3c | w3c software(?: notice and)? license
3 gutenberg | gutenberg | project gutenberg(?: tm)? license
3 arxiv | arxiv | arxiv(?: org)? (?:perpetual )?non exclusive license
3 llama | llama | llama (?:\\S+ )?community license(?: agreement)?
3 ogl | open government | open government licen[cs]e
3 etalab | licence ouverte | licence ouverte
3 dl-de | datenlizenz | datenlizenz deutschland
3 cc0 | cc0 | cc0
3 cc-zero | creative commons | creative commons zero
3 creative-commons | creative commons | creative commons(?: licen[cs]es?| attribution| lizenz| licencia| licence)?
3 public-domain | public domain | (?:released (?:in)?to|dedicated to|placed in|is in|into) the public domain
3 public-domain | domaine public | (?:dans le )?domaine public
3 public-domain | gemeinfrei | gemeinfrei\\S*
3 public-domain | dominio p | dominio público
4 mit | permission | permission is hereby granted free of charge to any person obtaining a copy
4 isc | permission | permission to use copy modify and or distribute this software for any purpose
4 mit-0 | permission | permission is hereby granted without conditions to any person
4 bsd | redistribut | redistribution and use in source and binary forms with or without modification
4 bsd-3-clause | endorse | may be used to endorse or promote products derived from this software
4 bsd-4-clause | advertising | all advertising materials mentioning features or use of this software
4 apache-2.0 | compliance | you may not use this file except in compliance with the license
4 gpl | redistribut | (?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu
4 gpl | warrant | this program is distributed in the hope that it will be useful but without any warranty
4 mpl-2.0 | this source code form | this source code form is subject to the terms of the mozilla public license
4 zlib | provided as | this software is provided as is without any express or implied warranty
4 boost | permission | permission is hereby granted free of charge to any person or organization obtaining a copy
4 unlicense | unencumbered | this is free and unencumbered software released into the public domain
4 beerware | beer in | you can buy me a beer in return
4 json | evil | shall be used for good not evil
4 warranty-disclaimer | warrant | without (?:any )?warrant(?:y|ies) (?:of any kind|or conditions of any kind)
4 warranty-disclaimer | warrant | the implied warrant(?:y|ies) of merchantability
4 warranty-disclaimer | provided as | (?:is|are) provided as is
4 liability-disclaimer | liab | in no event shall the (?:authors?|copyright holders?|regents)(?: or contributors?| or copyright holders?)? be liable
4 non-commercial | noncommercial | (?:for )?noncommercial (?:use|purposes) only
4 non-commercial | commercial | (?:for )?non commercial (?:use|purposes) only
4 non-commercial | commercial | not (?:be used )?for commercial (?:use|purposes)
4 non-commercial | commercial | (?:usage|utilisation) non commerciale?
4 non-commercial | kommerziell | nicht kommerzielle (?:nutzung|zwecke)
4 non-commercial | comercial | uso no comercial
4 no-derivatives | derivative | no derivative works?(?: are)?(?: permitted| allowed)?
4 attribution | attribution | with(?: proper)? attribution(?: to the author)?
4 no-reproduction | reproduc | no part of this (?:publication|book|work|document|site) may be reproduced
4 no-reproduction | reproduc | (?:may not|must not|cannot) be (?:copied or )?reproduced(?: without(?: prior)?(?: written)? permission)?
4 no-reproduction | reproduc | reproduction (?:interdite|prohibited|in whole or in part)
4 no-reproduction | vervielf | vervielfältigung(?:en)? (?:nur mit|ohne) genehmigung
4 no-reproduction | reproduc | prohibida (?:la|su) reproducción
4 no-mining | tdm | tdm(?: rights)? (?:reserved|prohibited|is not permitted)
4 no-mining | mining | text and data mining(?: rights)? (?:reserved|prohibited|is not permitted)
4 no-training | train | (?:may not|must not) be used (?:to train|for training)
4 permission-required | permission | used (?:with|by) permission(?: of)?
4 permission-required | permission | reprinted (?:with|by) permission(?: of)?
4 permission-required | written | without(?: the)?(?: prior)?(?: express)? written (?:permission|consent)
4 confidential | confidential | (?:proprietary and confidential|confidential and proprietary)
4 proprietary | proprietary | proprietary (?:software|information|license)
4 trademark | trademark | (?:is|are) (?:a )?(?:registered )?trademarks? of
4 all-rights-reserved | rights reserved | all rights reserved
4 all-rights-reserved | rights reserved | (?:some|no) rights reserved
4 all-rights-reserved | droits | tous (?:les )?droits réservés
4 all-rights-reserved | rechte | alle rechte vorbehalten
4 all-rights-reserved | derechos | (?:todos los|reservados todos los) derechos(?: reservados)?
5 copyright | copyright | copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*
5 copyright | copyright | copyright(?: c)?(?: by)?
5 copyright | copyright | copyrighted(?: material| work)?
5 copyright | urheberrecht | urheberrecht(?:lich)?(?: geschützt)?
5 copyright | droit | droits? d auteurs?
5 copyright | derecho | derechos? de autor
5 license-mention | licen | licen[cs]ed (?:under|by|to)
5 license-mention | licen | (?:released|distributed|available|published|provided) under (?:an? |the |this )?(?:\\S+ ){0,3}?licen[cs]e
5 license-mention | licen | (?:see|read) (?:the )?licen[cs]e(?: file| txt| md| agreement)?
5 license-mention | licen | licen[cs]e (?:agreement|terms|notice|file)
5 license-mention | licen | end user licen[cs]e(?: agreement)?
5 license-mention | eula | eula
5 license-mention | licen | sous (?:la )?licence
5 license-mention | lizenz | (?:unter (?:der|einer) )?(?:\\S+ )?lizenz(?:iert)?
5 license-mention | licen | bajo (?:la |una )?licencia
5 terms | terms | terms (?:of (?:use|service)|and conditions)
5 terms | nutzungsbedingungen | nutzungsbedingungen
5 terms | conditions d | conditions d utilisation
5 terms | condiciones | condiciones de uso
5 open-source | open source | open source (?:software|licen[cs]e|initiative)
5 copyleft | copyleft | copyleft
"""

#: The six Creative Commons licenses: their words in a name and in a short form.
_COMMONS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?deriv(?:ative)?s",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}
_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


#: Words before a named license.
_UNDER = "(?:(?:licen[cs]ed|released|distributed|available|published|provided) under (?:an? |the |this )?(?:terms of (?:the )?)?)?"


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    return rf"(?:version |release |v ?)?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


def _commons() -> list[Rule]:
    rules = []
    for short, name in _COMMONS.items():
        label = "cc-" + short.replace(" ", "-")
        for v in _VERSIONS:
            rules.append(Rule(1, f"{label}-{v}", "creativecommons", f"(?:https? )?(?:www )?creativecommons org licenses {short} {v.replace('.', ' ')}"))
            rules.append(Rule(2, f"{label}-{v}", "cc by", f"{_UNDER}cc {short} {_version(v)}"))
            rules.append(Rule(2, f"{label}-{v}", "creative commons", f"{_UNDER}creative commons {name}(?: licen[cs]e)? {_version(v)}"))
        rules.append(Rule(3, label, "cc by", f"{_UNDER}cc {short}"))
        rules.append(Rule(3, label, "creative commons", f"{_UNDER}creative commons {name}(?: licen[cs]e)?"))
    return rules


def _written() -> list[Rule]:
    rules = []
    for line in _WRITTEN.strip().splitlines():
        head, keyword, pattern = (x.strip() for x in line.split("|", 2))
        level, label = head.split()
        if level in "23":
            pattern = _UNDER + (f"(?:{pattern})" if "|" in re.sub(r"\(.*\)", "", pattern) else pattern)
        pattern = pattern.replace("{or later}", "(?: or (?:any )?later(?: version)?| only)?")
        rules.append(Rule(int(level), label, keyword, re.sub(r"\{(\d\.[^}]+)\}", lambda m: _version(m[1]), pattern)))
    return rules


#: All rules; a rule's place is its rank among those of its level.
RULES = sorted(_written() + _commons(), key=lambda r: r.level)
KEYWORDS = sorted({r.keyword for r in RULES})
LABELS = sorted({r.label for r in RULES})


def any_keyword(between: str) -> str:
    """A pattern of all keywords in ASCII letters of either case, grouped by first letter, where `between` (a class of characters) or the text's
    beginning stands before them and between their words."""
    groups: dict[str, list[str]] = {}
    for k in KEYWORDS:
        groups.setdefault(k[0], []).append(k[1:].replace(" ", between + "+"))
    return f"(?i)(?:^|{between})(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"
