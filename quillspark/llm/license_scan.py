"""License texts by ordered signature rules, as DataFrame expressions only.

Texts become lower-case words.  A document goes on only if it has a trigger
word; of the rules only those all of whose keywords it has are tried.  A rule is
a regex over the words joined by spaces, with a label, a tier (its priority) and a weight: names of
licenses by themselves and in phrases, identifiers, and sentences of license texts.  A rule's keywords are
the words that every string which its regex matches has, so the gate never drops a match.
Detections are swept in order of their start: one that lies within a detection of its own
or a higher tier is dropped, so ``gnu lesser general public license`` isn't
also reported as what its parts would be.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases and labels that every scan reports.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License names as regexes over normal words, with their label.
NAMES = (
    ("apache-2.0", "apache (?:software )?(?:license|licence) (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache (?:software )?(?:license|licence) (?:version |v)?1 1"),
    ("apache", "apache (?:software )?(?:license|licence)"),
    ("mit", "mit license"),
    ("mit", "mit licence"),
    ("mit-0", "mit 0(?: license)?"),
    ("mit-0", "mit no attribution"),
    ("x11", "x11 license"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-2-clause", "freebsd(?: license)?"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("bsd-0-clause", "(?:zero clause bsd|bsd 0 clause)(?: license)?"),
    ("bsd-0-clause", "0bsd(?: license)?"),
    ("bsd", "bsd (?:style )?(?:license|licence)"),
    ("gpl-1.0", "gnu general public license (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "gnu general public license (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "gnu general public license (?:version |v)3(?: 0)?"),
    ("gpl", "gnu general public license"),
    ("gpl-2.0", "(?:gnu )?gpl (?:version |v)?2(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?gpl2(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?gplversion 2(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?gpl (?:version |v)?3(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?gpl3(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?gplversion 3(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?gplv2(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?gplv3(?: 0)?"),
    ("gpl", "gnu gpl"),
    ("lgpl-2.0", "gnu lesser general public license (?:version |v)2(?: 0)?"),
    ("lgpl-2.0", "gnu library general public license (?:version |v)2(?: 0)?"),
    ("lgpl-2.1", "gnu lesser general public license (?:version |v)2 1"),
    ("lgpl-3.0", "gnu lesser general public license (?:version |v)3(?: 0)?"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("lgpl", "(?:gnu )?lgpl(?: (?:version |v)?[23](?: [01])?)?"),
    ("agpl-3.0", "gnu affero general public license (?:version |v)3(?: 0)?"),
    ("agpl", "(?:gnu )?affero general public license"),
    ("agpl", "(?:gnu )?agpl(?: (?:version |v)?3(?: 0)?)?"),
    ("gfdl", "gnu free documentation license"),
    ("mpl-1.0", "mozilla public license (?:version |v)?1 0"),
    ("mpl-1.1", "mozilla public license (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla public license (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla public license"),
    ("epl-1.0", "eclipse public license (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse public license (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse public license"),
    ("cddl-1.0", "cddl (?:version |v)?1 0"),
    ("cddl", "common development and distribution license"),
    ("cpl-1.0", "common public license(?: (?:version |v)?1 0)?"),
    ("eupl-1.1", "eupl (?:version |v)?1 1"),
    ("eupl-1.2", "eupl (?:version |v)?1 2"),
    ("eupl", "european union public licen[cs]e"),
    ("isc", "isc license"),
    ("zlib", "zlib(?: libpng)? license"),
    ("unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl"),
    ("artistic-1.0", "artistic license 1 0"),
    ("artistic-2.0", "artistic license 2 0"),
    ("artistic", "artistic license"),
    ("psf", "python software foundation license"),
    ("boost-1.0", "boost software license(?: (?:version )?1 0)?"),
    ("ms-pl", "microsoft public license"),
    ("ofl-1.1", "(?:sil )?open font license(?: (?:version )?1 1)?"),
    ("postgresql", "postgresql license"),
    ("openssl", "openssl license"),
    ("php", "php license"),
    ("ruby", "ruby license"),
    ("odbl", "open database license"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "(?:in|into|to) the public domain"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary|proprietary license)"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
)

# Sentences of license texts, notices and dedications, with their label.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "except as contained in this notice the name of .{1,80} shall not be used in advertising"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is"),
    ("bsd", "in no event shall the (?:copyright (?:holder|owner)s? or contributors|regents or contributors|author) be liable for any direct indirect incidental"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "makes no representations about the suitability of this software for any purpose"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("boost-1.0", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0-or-later", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0-or-later", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("fsf-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "you can obtain a copy of the license at .{1,80} cddl"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "licensed under the eupl"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed .{1,60} artistic"),
    ("perl", "this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-cnri", "this license agreement is between the corporation for national research initiatives"),
    ("php-3.01", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental"),
    ("icu", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .{1,400} both the above copyright notice"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal grants for any file you distribute that contains code from the software"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("qpl-1.0", "you may use copy and distribute the software in unmodified form provided that the entire package"),
    ("lppl-1.3", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights"),
    ("upl-1.0", "the above copyright notice and either this complete permission notice or at a minimum a reference to the upl"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", "any noncommercial purpose is a permitted purpose"),
    ("openrail", "you agree not to use the model or derivatives of the model"),
    ("llama", "is licensed under the llama .{1,20} community license"),
    ("odbl", "is made available under the open database license"),
    ("odc-by", "is made available under the open data commons attribution license"),
    ("pddl", "is made available under the public domain dedication and license"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("cdla-permissive", "community data license agreement permissive"),
    ("cc", "this work is licensed under a creative commons"),
    ("cc", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", "this (?:work|file|software|code) (?:is|has been placed|was placed) in the public domain"),
    ("public-domain", "no copyright is claimed and the author"),
    ("us-government", "this is a work of the (?:u s|united states) government and is not subject to copyright protection"),
    ("proprietary", "this document contains confidential and proprietary information"),
    ("proprietary", "unauthorized (?:copying|reproduction|use) of this (?:file|software|document|material) (?:via any medium )?is strictly prohibited"),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "may not be reproduced distributed or transmitted in any form or by any means"),
    ("proprietary", "you may not reverse engineer decompile or disassemble"),
    ("proprietary", "without the prior written (?:permission|consent) of the (?:publisher|author|copyright owner|copyright holder)"),
    ("reserved", "some rights reserved"),
    ("reserved", "all rights are reserved"),
    ("reserved", "tous droits r[ée]serv[ée]s"),
    ("reserved", "alle rechte vorbehalten"),
    ("reserved", "todos los derechos reservados"),
    ("reserved", "tutti i diritti riservati"),
    ("copyright", "© (?:19|20)[0-9][0-9]"),
    ("copyright", "copyright by"),
)

# Identifiers of the public license list.
SPDX = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0
Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0
CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.5 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Python
CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 Entessa EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.1 EUPL-1.2 Fair FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Info-ZIP Intel IPA IPL-1.0 ISC
JasPer-2.0 JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LiLiQ-P-1.1
Libpng LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MIT-CMU Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 Naumen NCSA NGPL Nokia NPOSL-3.0 NTP
ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5
RPSL-1.0 RSCPL Ruby SGI-B-2.0 SimPL-2.0 SISSL Sleepycat SPL-1.0 SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C Watcom-1.0 WTFPL X11 Xnet
Zend-2.0 Zlib ZPL-2.0 ZPL-2.1
""".split()

# The parts of Creative Commons names and codes.
CC_TERMS = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("", "1 0", "2 0", "2 5", "3 0", "4 0")

# What stands before a name, with tier and weight.  The bare name is the lowest.
FORMS = (
    ("(?:is |are |be )?(?:licensed|licenced|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |a |an )?", 3, 0.95),
    ("spdx license identifier ", 3, 1.0),
    ("(?:subject to|governed by|covered by|according to|in accordance with) (?:the )?(?:terms of )?(?:the )?", 2, 0.85),
    ("", 1, 0.7),
)


def _strings(regex: str) -> list[str]:
    """Every string that a rule's regex matches; classes and repeats of any character stand as one mark that is no letter.

    Rules are made of literals, (?:a|b), ?, [...] and .{m,n} only.
    """

    def sequence(at: int) -> tuple[list[str], int]:
        """Alternatives from a place up to the group's end."""
        done: list[str] = []
        now = [""]
        while at < len(regex) and regex[at] != ")":
            if regex[at] == "|":
                done, now, at = done + now, [""], at + 1
                continue
            if regex.startswith("(?:", at):
                part, at = sequence(at + 3)
                at += 1
            elif regex[at] == "[":
                part, at = ["\0"], regex.index("]", at) + 1
            elif regex[at] == ".":
                part, at = ["\0"], regex.index("}", at) + 1
            else:
                part, at = [regex[at]], at + 1
            if at < len(regex) and regex[at] == "?":
                part, at = [*part, ""], at + 1
            now = [a + b for a in now for b in part]
        return done + now, at

    return sequence(0)[0]


def keywords(regex: str) -> list[str]:
    """The words that every string which a regex matches has."""
    common: set[str] | None = None
    for text in _strings(regex):
        words = {w for w in text.split(" ") if w and "\0" not in w}
        common = words if common is None else common & words
    return sorted(common or ())


def rules() -> list[tuple[str, int, float, list[str], str]]:
    """(label, tier, weight, keywords, regex), the more specific of a tier first."""
    names = list(NAMES)
    for code, words in CC_TERMS:
        for version in CC_VERSIONS:
            label = "cc-" + code.replace(" ", "-") + (f"-{version.replace(' ', '.')}" if version else "")
            tail = f" {version}" if version else ""
            names.append((label, f"cc {code}{tail}"))
            names.append((label, f"creative commons {words}(?: international| unported| license)?{tail}"))
    plain = [(name.lower(), 3, 1.0, "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())) for name in SPDX]
    plain += [(label, 2, 0.9, text) for label, text in TEXTS]
    # keywords of a phrase and a name are those of either
    before = {form: keywords(form) for form, _, _ in FORMS}
    own = {name: keywords(name) for _, name in names}
    out = [(label, tier, weight, keywords(regex), regex) for label, tier, weight, regex in plain]
    out += [(label, tier, weight, sorted({*before[form], *own[name]}), f"{form}(?:{name})") for form, tier, weight in FORMS for label, name in names]
    return [(label, tier, weight, keys, f"(?<= )(?:{regex})(?= )") for label, tier, weight, keys, regex in out]


# Keywords so frequent in any text that they are poor triggers.
FREQUENT = set("advertising appropriate associated available by clause commercial commission community conditions contents contributions developed distribute distributed distribution documentation governed independent information mit organization public received return software subject the under university written".split())


def triggers(table: list[tuple[str, int, float, list[str], str]]) -> list[str]:
    """Words of which a document has one if any rule or base phrase matches: the longest keyword of each that isn't frequent, if it has such."""
    longest = lambda words: max(words, key=lambda w: (w not in FREQUENT, len(w), w))
    return sorted({longest(keys) for _, _, _, keys, _ in table} | {longest(p.split()) for p, _ in BASE})


def _words(text: Column) -> Column:
    """Words of a text in order: A-Z lower-cased, cut at ASCII other than letters and digits."""
    upper = "".join(map(chr, range(65, 91)))
    return F.filter(F.split(F.translate(text, upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _texts(values: list[str]) -> Column:
    """An array of texts as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase's words standing one after another."""
    parts = phrase.split()

    def at(w: Column, i: Column) -> Column:
        same = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & F.get(words, i + k).eqNullSafe(F.lit(part))
        return F.when(same, i)

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())


#: Columns of a detection.
_DETECTION = "array<struct<start: int, end: int, tier: int, label: string, weight: double>>"


def _detections(norm: Column, rule: Column) -> Column:
    """Where a rule matches, in words: gaps and matches alternate, and each has as many words as spaces."""

    def spaces(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def walk(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + spaces(F.get(gaps, i))
            end = start + spaces(F.get(found, i))
            one = F.struct((start - 1).cast("int").alias("start"), end.cast("int").alias("end"), rule["tier"].alias("tier"), rule["label"].alias("label"), rule["weight"].alias("weight"))
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTION).alias("out")), step, lambda acc: acc["out"])

    found = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) > 0, walk(m, F.split(norm, rule["regex"]))).otherwise(F.array().cast(_DETECTION)))


def _swept(detections: Column) -> Column:
    """(labels, score) of the detections that no detection of their tier or a higher one contains."""
    ordered = F.sort_array(F.transform(detections, lambda d: F.struct(d["start"].alias("s"), (-d["end"]).alias("e"), (-d["tier"]).alias("t"), (-d["weight"]).alias("w"), d["label"].alias("label"))))
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end, tier = -d["e"], -d["t"]
        reach = F.greatest(acc["e3"], F.when(tier <= 2, acc["e2"]), F.when(tier <= 1, acc["e1"]))
        stays = reach < end
        far = lambda k: F.when(tier == k, F.greatest(acc[f"e{k}"], end)).otherwise(acc[f"e{k}"]).alias(f"e{k}")
        return F.struct(far(1), far(2), far(3), F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(stays, F.greatest(acc["score"], -d["w"])).otherwise(acc["score"]).alias("score"))

    return F.aggregate(ordered, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``labels`` has those of the base phrases and of the rules; ``score`` is the best weight, 0.5 for a base phrase alone,
    0 without any.  Null and empty texts have no words and empty labels.  Rows come back as often as they come;
    columns other than doc_id and text are not looked at.
    """
    table = rules()
    # one literal: the optimizer folds it, and the driver doesn't build thousands of columns
    fields = ("label", "tier", "weight", "keys", "regex")
    literal = F.from_json(F.lit(json.dumps([dict(zip(fields, rule, strict=True)) for rule in table])), "array<struct<label: string, tier: int, weight: double, keys: array<string>, regex: string>>")
    every = sorted({k for _, _, _, keys, _ in table for k in keys})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    rows = rows.select("doc_id", _let(F.col("words"), lambda w: F.struct(F.size(w).alias("n"), F.when(F.arrays_overlap(w, _texts(triggers(table))), w).alias("w"))).alias("x")).select("doc_id", F.col("x.n").alias("n"), F.col("x.w").alias("words"))

    def named(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("words"), phrase), lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))

    places = F.concat(*[named(phrase, label) for phrase, label in BASE])
    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))

    def scan(text: Column) -> Column:
        have = F.array_intersect("words", _texts(every))
        tried = _let(have, lambda h: F.filter(literal, lambda r: F.size(F.array_except(r["keys"], h)) == 0))
        return _swept(F.flatten(F.transform(tried, lambda r: _detections(text, r))))

    rows = rows.select("doc_id", "n", F.when(F.col("words").isNotNull(), F.struct(places.alias("places"), _let(norm, scan).alias("found"))).alias("x"))
    at = F.col("x.places.i")
    base = F.sort_array(F.array_distinct(F.coalesce(F.col("x.places.label"), F.array().cast("array<string>"))))
    labels = F.sort_array(F.array_union(base, F.coalesce(F.col("x.found.labels"), F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        F.coalesce(F.size(at), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.col("x.found.score"), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
