"""Signature rules for licences, written by hand: identifiers, names, and the wording of bodies, notices, warranties, headers.

Each rule is one regular expression over lower-case text whose words are joined by single blanks, with a keyword that any
match has, a priority and a weight. ``SPDX`` lists identifiers, which count after "SPDX-License-Identifier" and, those that
no prose has, anywhere. ``NAMES`` holds what licences are called; names of a version or a clause count come before those of
a family. ``SIGNATURES`` know licences by their wording, without their names. ``STATEMENTS`` are no rules: they say what
stands before a name, and so how telling it is there.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    kind: str
    pattern: str
    keyword: str  # a literal that any text matching the pattern has
    priority: int
    weight: float
    tagged: bool = False  # counts only as a part of an expression after ``TAG``


#: label: (keyword, pattern) pairs. The keyword is a literal part of each match.
NAMES: dict[str, list[tuple[str, str]]] = {
    "mit": [("mit", r"licen[cs]e mit(?! (?:uses?|used|has|had|is|was|gives?|gave|made|makes|university|press|media|students|researchers|people))"), ("mit", r"(?:the )?mit(?: expat)? licen[cs]e"), ("expat", r"expat licen[cs]e"), ("mit", r"mit x11 licen[cs]e"), ("mit", r"mit style licen[cs]e"), ("mit", r"licen[cs]e mit licen[cs]e")],
    "mit-0": [("mit", r"mit no attribution(?: licen[cs]e)?")],
    "apache": [("apache", r"apache(?: software)? licen[cs]e"), ("asl", r"asl 2 0")],
    "apache-1.1": [("apache", r"apache(?: software)? licen[cs]e (?:version |v )?1 1")],
    "apache-2.0": [("apache", r"apache(?: software)? licen[cs]e (?:version |v )?2(?: 0)?"), ("apache", r"apache 2 0")],
    "gpl": [("general public", r"(?:gnu )?general public licen[cs]e"), ("gnu gpl", r"gnu gpl"), ("gpl", r"gpl(?: licen[cs]e| licen[cs]ed)")],
    "gpl-1.0": [("general public", r"(?:gnu )?general public licen[cs]e (?:version |v )1(?: 0)?")],
    "gpl-2.0": [("general public", r"(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )2(?: 0)?"), ("gplv2", r"gplv2"), ("gpl", r"(?:gnu )?gpl (?:version |v )?v?2(?: 0)?(?: only| or later| or any later version)?")],
    "gpl-3.0": [("general public", r"(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v )3(?: 0)?"), ("gplv3", r"gplv3"), ("gpl", r"(?:gnu )?gpl (?:version |v )?v?3(?: 0)?(?: only| or later| or any later version)?")],
    "lgpl": [("lesser general", r"(?:gnu )?lesser general public licen[cs]e"), ("library general", r"(?:gnu )?library general public licen[cs]e"), ("lgpl", r"(?:gnu )?lgpl")],
    "lgpl-2.1": [("lesser general", r"lesser general public licen[cs]e (?:version |v )2 1"), ("lgplv2", r"lgplv2(?: 1)?"), ("lgpl", r"(?:gnu )?lgpl (?:version |v )?v?2 1(?: only| or later)?")],
    "lgpl-3.0": [("lesser general", r"lesser general public licen[cs]e (?:version |v )3(?: 0)?"), ("lgplv3", r"lgplv3"), ("lgpl", r"(?:gnu )?lgpl (?:version |v )?v?3(?: 0)?(?: only| or later)?")],
    "agpl": [("affero", r"(?:gnu )?affero(?: general)?(?: public)? licen[cs]e"), ("agpl", r"(?:gnu )?agpl")],
    "agpl-3.0": [("affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?"), ("agplv3", r"(?:gnu )?agplv3"), ("agpl", r"(?:gnu )?agpl (?:version |v )?v?3(?: 0)?(?: only| or later)?")],
    "gfdl": [("free documentation", r"(?:gnu )?free documentation licen[cs]e"), ("gfdl", r"gfdl")],
    "bsd": [("bsd", r"bsd(?: style)? licen[cs]e"), ("berkeley", r"berkeley software distribution licen[cs]e")],
    "bsd-2-clause": [("bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?"), ("bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?"), ("freebsd", r"freebsd licen[cs]e"), ("bsd", r"simplified bsd(?: licen[cs]e)?")],
    "bsd-3-clause": [("bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?"), ("bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?"), ("bsd", r"(?:new|revised|modified) bsd(?: licen[cs]e)?")],
    "bsd-4-clause": [("bsd", r"bsd (?:4|four) clause(?: licen[cs]e)?"), ("bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?"), ("bsd", r"(?:original|old) bsd licen[cs]e")],
    "0bsd": [("bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?"), ("0bsd", r"0bsd(?: licen[cs]e)?")],
    "isc": [("isc", r"isc licen[cs]e"), ("internet systems", r"internet systems consortium licen[cs]e")],
    "mpl": [("mozilla", r"mozilla public licen[cs]e")],
    "mpl-1.1": [("mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1")],
    "mpl-2.0": [("mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"), ("mpl", r"mpl 2 0")],
    "epl": [("eclipse", r"eclipse public licen[cs]e")],
    "epl-1.0": [("eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?")],
    "epl-2.0": [("eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?")],
    "edl": [("eclipse distribution", r"eclipse distribution licen[cs]e")],
    "cpl": [("common public", r"common public licen[cs]e")],
    "cddl": [("common development", r"common development and distribution licen[cs]e"), ("cddl", r"cddl(?: 1 [01])?")],
    "eupl": [("european union", r"european union public licen[cs]e"), ("eupl", r"eupl(?: 1 [12])?")],
    "osl": [("open software", r"open software licen[cs]e")],
    "afl": [("academic free", r"academic free licen[cs]e")],
    "artistic": [("artistic", r"artistic licen[cs]e")],
    "artistic-2.0": [("artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?")],
    "perl": [("perl", r"same terms as perl(?: itself)?")],
    "python": [("python", r"python(?: software foundation)? licen[cs]e"), ("psf", r"psf licen[cs]e")],
    "ruby": [("ruby", r"ruby licen[cs]e")],
    "php": [("php", r"php licen[cs]e")],
    "zlib": [("zlib", r"zlib(?: libpng)? licen[cs]e")],
    "libpng": [("libpng", r"libpng licen[cs]e")],
    "bzip2": [("bzip2", r"bzip2 licen[cs]e")],
    "curl": [("curl", r"curl licen[cs]e")],
    "openssl": [("openssl", r"openssl licen[cs]e")],
    "ssleay": [("ssleay", r"ssleay licen[cs]e")],
    "openldap": [("openldap", r"openldap public licen[cs]e")],
    "postgresql": [("postgresql", r"postgresql licen[cs]e")],
    "sqlite": [("sqlite", r"sqlite (?:blessing|licen[cs]e)")],
    "boost": [("boost", r"boost software licen[cs]e"), ("boost", r"boost licen[cs]e")],
    "unlicense": [("unlicen", r"(?:the )?unlicen[cs]e")],
    "wtfpl": [("wtfpl", r"wtfpl"), ("what the", r"do what the fuck you want(?: to)? public licen[cs]e")],
    "public-domain": [("public domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"), ("public domain", r"public domain dedication")],
    "cc0": [("cc0", r"cc0(?: 1 0)?"), ("creative commons", r"creative commons zero")],
    "cc": [("creative commons", r"creative commons(?: licen[cs]e)?"), ("creative commons", r"creative commons attribution(?: licen[cs]e)?")],
    "cc-by": [("cc by", r"cc by(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution [1-4] 0")],
    "cc-by-sa": [("cc by sa", r"cc by sa(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution share ?alike"), ("cc by sa", r"licen[cs]ed under cc by sa")],
    "cc-by-nd": [("cc by nd", r"cc by nd(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution no ?deriv(?:ative)?s")],
    "cc-by-nc": [("cc by nc", r"cc by nc(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution non ?commercial")],
    "cc-by-nc-sa": [("cc by nc sa", r"cc by nc sa(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution non ?commercial share ?alike")],
    "cc-by-nc-nd": [("cc by nc nd", r"cc by nc nd(?: [1-4] 0)?"), ("creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s")],
    "odbl": [("database", r"open (?:data commons )?(?:open )?database licen[cs]e"), ("odbl", r"odbl")],
    "odc-by": [("open data commons", r"open data commons attribution licen[cs]e")],
    "pddl": [("public domain dedication", r"open data commons public domain dedication and licen[cs]e"), ("pddl", r"pddl")],
    "ogl-uk": [("open government", r"open government licen[cs]e")],
    "ofl": [("open font", r"(?:sil )?open font licen[cs]e")],
    "ms-pl": [("microsoft", r"microsoft public licen[cs]e"), ("ms pl", r"ms pl")],
    "ms-rl": [("microsoft", r"microsoft reciprocal licen[cs]e"), ("ms rl", r"ms rl")],
    "bsl": [("business source", r"business source licen[cs]e"), ("busl", r"busl 1 1")],
    "sspl": [("server side", r"server side public licen[cs]e"), ("sspl", r"sspl")],
    "elastic": [("elastic", r"elastic licen[cs]e(?: 2 0)?")],
    "commons-clause": [("commons clause", r"commons clause")],
    "jquery": [("jquery", r"jquery licen[cs]e")],
    "json": [("json", r"json licen[cs]e"), ("good not evil", r"shall be used for good not evil")],
    "beerware": [("beer", r"beer ?ware(?: licen[cs]e)?")],
    "ncsa": [("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e")],
    "w3c": [("w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e")],
    "x11": [("x11", r"x11 licen[cs]e")],
    "vim": [("vim", r"vim licen[cs]e")],
    "tcl": [("tcl", r"tcl(?: tk)? licen[cs]e")],
    "qpl": [("q public", r"q public licen[cs]e")],
    "zpl": [("zope", r"zope public licen[cs]e")],
    "ipl": [("ibm public", r"ibm public licen[cs]e")],
    "sleepycat": [("sleepycat", r"sleepycat licen[cs]e")],
    "upl": [("universal permissive", r"universal permissive licen[cs]e")],
    "mulan": [("mulan", r"mulan (?:permissive software |psl )licen[cs]e")],
    "cecill": [("cecill", r"cecill(?: [abc])?(?: licen[cs]e)?")],
    "unicode": [("unicode", r"unicode licen[cs]e(?: agreement)?")],
    "icu": [("icu", r"icu licen[cs]e")],
    "ijg": [("jpeg", r"independent jpeg group(?: s)? licen[cs]e")],
    "openrail": [("rail", r"(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?")],
    "llama": [("llama", r"llama (?:[23] )?community licen[cs]e")],
    "proprietary": [("all rights", r"all rights reserved"), ("proprietary", r"proprietary and confidential"), ("commercial", r"commercial licen[cs]e")],
    "generic": [("licen", r"this work is licen[cs]ed"), ("licen", r"licen[cs]ed under"), ("licen", r"terms of (?:the|this) licen[cs]e")],
}

#: What may stand before a name: (statement, pattern that ends right before the name, weight).
STATEMENTS: list[tuple[str, str, float]] = [
    ("grant", r"(?:licen[cs]ed|released|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?$", 0.95),
    ("reference", r"(?:see|copy of|terms of|read|conditions of|subject to) (?:the )?(?:gnu )?$", 0.8),
]
#: The last words of statements.
STATEMENT_ENDS = ("under ", "by ", "the ", "gnu ", "see ", "of ", "read ", "to ")
NAME_WEIGHT = 0.6
#: Names that say no more than the family, which versions, clause counts and variants have names of their own for.
FAMILIES = {"apache", "gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "artistic", "cc", "cc-by"}
#: Identifiers of licences as tools write them, without "-only" and "-or-later", which any of them may have.
SPDX = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent "
    "BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 "
    "GPL-3.0 HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OpenSSL "
    "OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
#: Labels of identifiers that are called otherwise above.
SPDX_LABELS = {"bsl": "boost", "busl": "bsl", "oldap": "openldap", "psf": "python", "mulanpsl": "mulan", "unicode-dfs": "unicode", "artistic-1.0-perl": "perl"}
TAG_BEGINS = "spdx licen"
TAG = r"(?<![^ ])spdx licen[cs]e identifier "
#: An expression after the tag, once punctuation is gone: identifiers joined by words. Another's identifier, or an exception,
#: is up to six words of which none is of plain prose, and counts only if the expression goes on after it.
JOINED = r" (?:or|and|with) "
OTHER = r"(?:(?!(?:or|and|with|a|an|the|is|are|was|were|be|of|in|on|to|for|from|by|that|this|it|as|at|people|tag|field|line|string)(?![^ ]))[^ ]+ ){0,5}(?!(?:or|and|with|a|an|the|is|of|in|on|to|for|from|by|that|this|it|as|at)(?![^ ]))[^ ]+(?= (?:or|and|with) )"
#: Up to three words before a statement or a name that deny it.
DENIED = r"(?<![^ ])(?:not|never|neither|nor|without|no longer|cannot|isn t|aren t|wasn t|don t|doesn t)(?: [^ ]+){0,3} $"
#: Identifiers that are no words of any prose once "-" and "." are gone: they count without the tag too.
TELLING = re.compile(r"(?:a?l?gpl|apache|artistic|bsd|cc by(?: nc| sa| nd)*|mpl|epl|cddl|eupl|osl|afl|ofl|lppl|zpl|odbl|gfdl|cecill|busl|sspl) ")


#: kind of wording: (priority, weight)
KINDS: dict[str, tuple[int, float]] = {"body": (36, 0.98), "header": (34, 0.95), "notice": (32, 0.9), "warranty": (25, 0.8)}

#: (label, kind, keyword, pattern)
SIGNATURES: list[tuple[str, str, str, str]] = [
    ("mit", "body", "permission is hereby granted", r"permission is hereby granted free of charge(?! to any person (?:or organization|obtaining a copy of (?:the )?(?:font|unicode|data)))(?: to any person obtaining a copy)?"),
    ("mit", "notice", "substantial portions", r"(?:this permission notice |shall be |included in |all copies or ){2,4}substantial portions of the software"),
    ("mit", "warranty", "authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("boost", "body", "any person or organization", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl", "body", "font software", r"free of charge to any person obtaining a copy of the font software"),
    ("unicode", "body", "free of charge", r"free of charge to any person obtaining a copy of (?:the unicode )?data files"),
    ("x11", "notice", "except as contained in this notice", r"except as contained in this notice the names? of"),
    ("bsd", "body", "source and binary forms", r"redistribution and use in source and binary forms(?: with or without modification(?: are permitted)?)?"),
    ("bsd", "notice", "redistributions of source", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "notice", "redistributions in binary", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "notice", "endorse or promote", r"(?:neither the names? of|the names? of) (?:[^ ]+ ){1,24}?endorse or promote products derived from this software"),
    ("bsd-4-clause", "notice", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "warranty", "this software is provided by", r"this software is provided by (?:[^ ]+ ){1,12}?as is and any express(?:ed)? or implied warranties"),
    ("bsd", "warranty", "exemplary or consequential", r"be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "body", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "body", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "warranty", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("postgresql", "body", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("gpl", "header", "is free software you can redistribute it", r"(?:this (?:program|file|software) |it )?is free software you can redistribute it(?! and or modify it under the terms of (?:[^ ]+ ){0,4}?(?:lesser|library|affero))(?<!library is free software you can redistribute it)"),
    ("lgpl", "header", "is free software you can redistribute it", r"this library is free software you can redistribute it"),
    ("lgpl", "header", "is free software you can redistribute it", r"is free software you can redistribute it and or modify it under the terms of (?:[^ ]+ ){0,4}?(?:lesser|library) general public licen[cs]e"),
    ("agpl", "header", "is free software you can redistribute it", r"is free software you can redistribute it and or modify it under the terms of (?:[^ ]+ ){0,4}?affero general public licen[cs]e"),
    ("gpl", "warranty", "in the hope that it will be useful", r"(?:this program|this file|this software) is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "warranty", "in the hope that it will be useful", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "body", "take away your freedom", r"designed to take away your freedom to share and change"),
    ("gpl-3.0", "body", "free copyleft license", r"is a free copyleft license for software and other kinds of works"),
    ("lgpl", "body", "derivative of any portion of the library", r"contains no derivative of any portion of the library"),
    ("agpl", "body", "interacting with it remotely", r"must prominently offer all users interacting with it remotely"),
    ("gfdl", "header", "modify this document", r"permission is granted to copy distribute and or modify this document"),
    ("apache-2.0", "header", "except in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "body", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "warranty", "agreed to in writing software", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "header", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mpl-2.0", "header", "this source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "notice", "copy of the mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "header", "the contents of this file are subject", r"the contents of this file are subject to the (?:terms of the )?mozilla public license"),
    ("mpl", "warranty", "governing rights and limitations", r"see the license for the specific language governing rights and limitations"),
    ("epl", "header", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "body", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib", "notice", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "warranty", "authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "body", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", "notice", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "body", "you just do what", r"you just do what the fuck you want to"),
    ("beerware", "body", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc", "body", "exercising the licensed rights", r"by exercising the licensed rights defined below you accept and agree to be bound"),
    ("cc0", "body", "work with this deed", r"who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic", "body", "package may be copied", r"state the conditions under which a package may be copied"),
    ("python", "warranty", "making python", r"psf is making python (?:[^ ]+ ){0,4}?available to licensee on an as is basis"),
    ("openssl", "notice", "openssl project", r"this product includes software developed by the openssl project"),
    ("php", "notice", "php software", r"this product includes php software freely available from"),
    ("sqlite", "body", "do good and not evil", r"may you do good and not evil"),
    ("commons-clause", "body", "right to sell", r"does not grant to you the right to sell the software"),
    ("proprietary", "header", "copying of this file", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
]


def spdx_label(identifier: str) -> str:
    """The label of an identifier: its own name, or that of its family where versions aren't told apart."""
    name = identifier.lower()
    known = {*NAMES, *(label for label, *_ in SIGNATURES)}
    family = re.sub(r"-\d[\d.]*[a-z]?$", "", name)
    for n in (name, family):
        if n in SPDX_LABELS or n in known:
            return SPDX_LABELS.get(n, n)
    return name


def identifiers() -> str:
    """A pattern of any listed identifier as words, the longest first."""
    plain = sorted((re.sub(r"[-.]", " ", i.lower()) for i in SPDX), key=len, reverse=True)
    return rf"(?:{'|'.join(plain)})(?: only| or later)?(?![^ ])"


def rules() -> list[Rule]:
    """All rules: tagged identifiers, signatures of wording, identifiers anywhere, names."""
    whole = lambda pattern: rf"(?<![^ ])(?:{pattern})(?![^ ])"
    plain = {i: re.sub(r"[-.]", " ", i.lower()) for i in SPDX}
    made = [Rule(spdx_label(i), "identifier", whole(rf"{w}(?: only| or later)?"), w, 40, 1.0, True) for i, w in plain.items()]
    made += [Rule(label, kind, whole(pattern), keyword, *KINDS[kind]) for label, kind, keyword, pattern in SIGNATURES]
    made += [Rule(spdx_label(i), "name", whole(rf"{w}(?: only| or later)"), w, 15, NAME_WEIGHT) for i, w in plain.items() if TELLING.match(w) and i.split("-")[0] in ("GPL", "LGPL", "AGPL", "GFDL")]
    made += [Rule(spdx_label(i), "name", whole(w), w, 15, NAME_WEIGHT) for i, w in plain.items() if TELLING.match(w)]
    made += [Rule(label, "name", whole(pattern), keyword, 5 if label == "generic" else 10 if label in FAMILIES else 15, NAME_WEIGHT) for label, names in NAMES.items() for keyword, pattern in names]
    for rule in made:
        re.compile(rule.pattern)
    return made
