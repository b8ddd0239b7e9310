"""The signature rules of the license scan.

A rule reads words in lower case, parted by two spaces and enclosed in one space on each side, and a match covers whole
words. Each belongs to a keyword without which it is never tried, and has a priority: a more specific text ranks before the
general one that it contains.
"""

from __future__ import annotations

import re
from itertools import product

#: (label, name as written in notices). The label is the SPDX name in lower case.
FAMILIES = {
    "apache": ["1 0", "1 1", "2 0"],
    "gpl": ["1 0", "2 0", "3 0"],
    "lgpl": ["2 0", "2 1", "3 0"],
    "agpl": ["1 0", "3 0"],
    "mpl": ["1 0", "1 1", "2 0"],
    "epl": ["1 0", "2 0"],
    "cddl": ["1 0", "1 1"],
    "eupl": ["1 0", "1 1", "1 2"],
    "osl": ["1 0", "2 0", "2 1", "3 0"],
    "afl": ["1 1", "1 2", "2 0", "2 1", "3 0"],
    "artistic": ["1 0", "2 0"],
    "gfdl": ["1 1", "1 2", "1 3"],
    "bsl": ["1 0", "1 1"],
    "lppl": ["1 0", "1 1", "1 2", "1 3"],
    "zpl": ["1 1", "2 0", "2 1"],
    "ecl": ["1 0", "2 0"],
    "apsl": ["1 0", "1 1", "1 2", "2 0"],
    "cecill": ["1 0", "1 1", "2 0", "2 1"],
    "ofl": ["1 0", "1 1"],
    "cpal": ["1 0"],
    "npl": ["1 0", "1 1"],
}
NAMES = {
    "apache": ["apache software license", "apache license"],
    "gpl": ["gnu general public license", "gnu gpl", "general public license"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lesser general public license"],
    "agpl": ["gnu affero general public license", "gnu agpl", "affero general public license"],
    "mpl": ["mozilla public license"],
    "epl": ["eclipse public license"],
    "cddl": ["common development and distribution license"],
    "eupl": ["european union public licence", "european union public license"],
    "osl": ["open software license"],
    "afl": ["academic free license"],
    "artistic": ["perl artistic license", "artistic license"],
    "gfdl": ["gnu free documentation license", "gnu fdl"],
    "bsl": ["boost software license", "business source license"],
    "lppl": ["latex project public license"],
    "zpl": ["zope public license"],
    "ecl": ["educational community license"],
    "apsl": ["apple public source license"],
    "cecill": ["cecill free software license agreement"],
    "ofl": ["sil open font license", "open font license"],
    "cpal": ["common public attribution license"],
    "npl": ["netscape public license"],
}

#: Rules of their own: (label, keyword, words).
SINGLE = [
    ("mit", "mit", "mit license"),
    ("mit", "mit", "the mit license mit"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "distributed under the mit license"),
    ("mit", "mit", "mit licensed"),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", "fitness for a particular purpose and noninfringement"),
    ("mit-0", "mit", "mit no attribution"),
    ("x11", "x11", "x11 license"),
    ("expat", "expat", "expat license"),
    ("isc", "isc", "isc license"),
    ("isc", "modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "bsd", "zero clause bsd"),
    ("bsd", "bsd", "bsd license"),
    ("bsd-2-clause", "bsd", "simplified bsd license"),
    ("bsd-2-clause", "freebsd", "freebsd license"),
    ("bsd-2-clause", "bsd", "bsd 2 clause"),
    ("bsd-2-clause", "bsd", "2 clause bsd"),
    ("bsd-3-clause", "bsd", "new bsd license"),
    ("bsd-3-clause", "bsd", "modified bsd license"),
    ("bsd-3-clause", "bsd", "bsd 3 clause"),
    ("bsd-3-clause", "bsd", "3 clause bsd"),
    ("bsd-4-clause", "bsd", "original bsd license"),
    ("bsd-4-clause", "bsd", "bsd 4 clause"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("unlicense", "unlicense", "the unlicense"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib license"),
    ("zlib", "libpng", "zlib libpng license"),
    ("libpng", "libpng", "libpng license"),
    ("openssl", "openssl", "openssl license"),
    ("php", "php", "php license"),
    ("ruby", "ruby", "ruby license"),
    ("python", "python", "python software foundation license"),
    ("postgresql", "postgresql", "postgresql license"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license"),
    ("curl", "curl", "curl license"),
    ("vim", "vim", "vim license"),
    ("beerware", "beer", "beer ware license"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("public-domain", "domain", "public domain"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "license", "end user license agreement"),
    ("sspl-1.0", "side", "server side public license"),
    ("elastic-2.0", "elastic", "elastic license 2 0"),
    ("commons-clause", "clause", "commons clause"),
    ("polyform", "polyform", "polyform noncommercial license"),
    ("cc0-1.0", "cc0", "cc0 1 0"),
    ("cc0-1.0", "cc0", "cc0 1 0 universal"),
    ("cc0-1.0", "commons", "creative commons zero"),
]

#: Rules written as expressions: (label, keyword, expression). A blank is a gap between words; the keyword is in every match.
WRITTEN = [
    # wordings of notices that name no version
    ("mit", "mit", "(?:under|by) (?:the )?(?:terms of )?(?:the )?mit (?:style )?(?:open source )?licen[sc]e"),
    ("mit", "mit", "(?:see|read) (?:the )?(?:file )?license (?:file )?for (?:the )?mit"),
    ("mit", "mit", "licen[sc]e (?:is )?mit"),
    ("mit", "mit", "mit (?:or|and) apache(?: 2 0)?"),
    ("apache", "apache", "apache(?: 2 0)? (?:or|and) mit"),
    ("apache-2.0", "apache", "(?:under|by) (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?"),
    ("apache-2.0", "apache", "apache (?:v |version )?2(?: 0)? licensed"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "warranties", "without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "compliance", "you may not use (?:this file|these files|this software) except in compliance with the license"),
    ("apache-2.0", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license(?: patent)?"),
    ("gpl", "gpl", "(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    ("gpl", "gpl", "gpl (?:compatible|licensed|software|code)"),
    ("gpl-2.0", "gplv2", "gplv2(?: 0)?"),
    ("gpl-2.0-or-later", "gplv2", "gplv2 (?:or later|or any later version|plus)"),
    ("gpl-2.0-only", "gplv2", "gplv2 only"),
    ("gpl-3.0", "gplv3", "gplv3(?: 0)?"),
    ("gpl-3.0-or-later", "gplv3", "gplv3 (?:or later|or any later version|plus)"),
    ("gpl-3.0-only", "gplv3", "gplv3 only"),
    ("lgpl-2.1", "lgplv2", "lgplv2 1"),
    ("lgpl-2.1-or-later", "lgplv2", "lgplv2 1 or (?:any )?later(?: version)?"),
    ("lgpl-3.0", "lgplv3", "lgplv3(?: 0)?"),
    ("lgpl-3.0-or-later", "lgplv3", "lgplv3 or (?:any )?later(?: version)?"),
    ("agpl-3.0", "agplv3", "agplv3(?: 0)?"),
    ("agpl-3.0-or-later", "agplv3", "agplv3 or (?:any )?later(?: version)?"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license(?: as published by the free software foundation)?"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license"),
    ("agpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", "gnu", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "gnu", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "gnu", "www gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
    ("lgpl", "gnu", "www gnu org (?:licenses|copyleft) lgpl(?: html| txt)?"),
    ("agpl", "gnu", "www gnu org licenses agpl(?: html| txt)?"),
    ("gfdl", "invariant", "with no invariant sections(?: no front cover texts and no back cover texts)?"),
    ("gfdl", "documentation", "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath", "classpath", "(?:with )?(?:the )?(?:gnu )?classpath exception"),
    ("gpl-gcc", "gcc", "gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("gpl-font", "font", "(?:gpl )?font (?:embedding )?exception"),
    ("gpl-linking", "linking", "(?:special|linking|additional) (?:linking )?exception (?:for|to) linking"),
    ("gpl-linking", "syscall", "linux syscall note"),
    ("llvm-exception", "llvm", "(?:with )?llvm exceptions?"),
    # clauses of licences without a name of their own
    ("mit", "sublicense", "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", "(?:shall be included|be included) in all copies or substantial portions of the software"),
    ("mit", "restriction", "to deal in the software without restriction(?: including without limitation the rights)?"),
    ("x11", "consortium", "(?:the )?name of the x consortium shall not be used in advertising"),
    ("bsd", "redistributions", "redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-3-clause", "contributors", "neither the names? of .{1,40} nor the names of (?:its|their) contributors may be used"),
    ("bsd-4-clause", "mentioning", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "bsd", "(?:the )?(?:clear|3 clause clear) bsd license"),
    ("bsd-2-clause-patent", "bsd", "bsd 2 clause plus patent|bsd plus patents? license"),
    ("bsd", "bsd", "bsd (?:style|like|type) licen[sc]e"),
    ("bsd", "bsd", "(?:under|by) (?:the )?(?:terms of )?(?:the )?bsd licen[sc]es?"),
    ("bsd", "bsd", "bsd licensed"),
    ("bsd", "regents", "(?:copyright )?(?:c )?(?:the )?regents of the university of california"),
    ("isc", "permission", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "isc", "(?:under|by) (?:the )?(?:terms of )?(?:the )?isc licen[sc]e"),
    ("isc", "internet", "internet (?:software|systems) consortium license"),
    ("0bsd", "0bsd", "0bsd(?: license)?"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "derivative", "prepare derivative works of the software and to permit third parties to whom the software is furnished"),
    ("bsl-1.0", "boost", "www boost org license 1 0 txt"),
    ("ofl", "reserved", "with reserved font names?"),
    ("ofl", "ofl", "scripts sil org ofl"),
    ("unlicense", "unlicense", "unlicense (?:license|org)"),
    ("unlicense", "dedicate", "we dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "license", "do what the [^ ]{1,8} you want to public license"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("beerware", "beerware", "beerware(?: license)?"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mpl", "(?:the )?contents of this file are subject to the mpl"),
    ("mpl-2.0", "secondary", "incompatible with secondary licenses"),
    ("epl", "eclipse", "www eclipse org (?:legal )?epl (?:v10|v20|2 0)(?: html)?"),
    ("epl", "epl", "(?:under|by) (?:the )?(?:terms of )?(?:the )?epl"),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: v| version)? 1 0"),
    ("cddl", "cddl", "(?:under|by) (?:the )?(?:terms of )?(?:the )?cddl"),
    ("artistic", "perl", "(?:under )?the same terms as perl(?: itself)?"),
    ("ms-pl", "microsoft", "microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft", "microsoft reciprocal license(?: ms rl)?"),
    ("ibm-pl-1.0", "ibm", "ibm public license(?: version| v)?(?: 1 0)?"),
    ("cpl-1.0", "license", "common public license(?: version| v)?(?: 1 0)?"),
    ("qpl-1.0", "license", "q public license(?: version| v)?(?: 1 0)?"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e"),
    ("sun-sissl", "license", "sun industry standards source license"),
    ("intel", "intel", "intel (?:open source|simplified software) license"),
    ("nasa-1.3", "nasa", "nasa open source agreement(?: version| v)?(?: 1 3)?"),
    ("upl-1.0", "license", "universal permissive license(?: upl)?(?: version| v)?(?: 1 0)?"),
    ("unicode", "unicode", "unicode (?:inc )?license agreement(?: data files and software)?"),
    ("icu", "icu", "icu license"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", "(?:the )?freetype (?:project )?license"),
    ("imagemagick", "imagemagick", "imagemagick license"),
    ("tcl", "tcl", "tcl tk license"),
    ("blueoak-1.0.0", "license", "blue oak model license(?: 1 0 0)?"),
    ("mulan-psl-2.0", "mulan", "mulan (?:psl|permissive software license)(?: version| v)?(?: v2| 2(?: 0)?)?"),
    ("osl-3.0", "osl", "licensed under the osl(?: version| v)?(?: 3 0)?"),
    ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("sleepycat", "sleepycat", "sleepycat (?:public )?license"),
    ("odbl-1.0", "odbl", "odbl(?: version| v)?(?: 1 0)?"),
    ("odbl-1.0", "license", "open (?:data commons open )?database license"),
    ("odc-by-1.0", "commons", "open data commons attribution license"),
    ("pddl-1.0", "domain", "public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", "(?:under|by) (?:the )?(?:terms of )?(?:the )?cc0"),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights"),
    ("cc", "creativecommons", "creativecommons org licenses"),
    ("cc-by", "creativecommons", "creativecommons org licenses by (?:[1-4] [05])"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa (?:[1-4] [05])"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?: sa| nd)? (?:[1-4] [05])"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd (?:[1-4] [05])"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "(?:no copyright|not copyrighted) public domain"),
    ("public-domain", "government", "works? of the (?:us|u s|united states) government"),
    # terms that withhold rights
    ("proprietary", "prohibited", "(?:unauthorized|any) (?:copying|reproduction) (?:or|and) (?:distribution|reproduction)(?: of this (?:file|document|software))?(?: is)?(?: strictly)? prohibited"),
    ("proprietary", "copying", "unauthorized copying of this (?:file|document|software|material) via any medium is strictly prohibited"),
    ("proprietary", "confidential", "(?:strictly |company )?confidential (?:and proprietary|information of)"),
    ("proprietary", "trade", "(?:contains|are|is) (?:the )?(?:valuable )?trade secrets? (?:and|of)"),
    ("proprietary", "engineer", "(?:may not|shall not|agree not to) (?:decompile disassemble or )?reverse engineer"),
    ("proprietary", "transferable", "non exclusive non transferable (?:limited )?licen[sc]e"),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "written", "without (?:the )?(?:express )?(?:prior )?written (?:consent|permission) of the (?:publisher|author|owner|copyright holder)"),
    ("non-commercial", "noncommercial", "for (?:personal and )?noncommercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "commercial", "(?:for )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "commercial", "not (?:be )?(?:used )?for commercial (?:use|purposes|gain)"),
    ("research-only", "research", "for (?:academic |educational |non profit )?(?:and )?research (?:use|purposes) only"),
    ("evaluation-only", "evaluation", "for evaluation (?:use|purposes) only"),
    ("busl-1.1", "license", "change license (?:is )?(?:gpl|apache|mpl|gnu)"),
    ("busl-1.1", "busl", "busl(?: 1 1)?"),
    ("sspl-1.0", "sspl", "sspl(?: version| v)?(?: v1| 1(?: 0)?)?"),
    ("elastic-2.0", "hosted", "provide the software to third parties as a hosted or managed service"),
    ("polyform", "polyform", "polyform (?:small business|shield|strict|perimeter|free trial|internal use) license"),
    ("openrail", "rail", "(?:creativeml |bigscience )?(?:open )?rail (?:m )?licen[sc]e"),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?"),
    ("llama", "llama", "llama (?:2 |3 |3 1 )?community license(?: agreement)?"),
    ("dual", "dual", "dual licensed under"),
]


def _phrase(words: str) -> str:
    return "  ".join(words.split())


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern), the most specific first; priorities are distinct."""
    found: list[tuple[int, str, str, str]] = []  # (words that the rule fixes, label, keyword, pattern)

    def add(label: str, keyword: str, words: str, before: str = "", after: str = "") -> None:
        fixed = len(words.split()) + 2 * bool(after) + bool(before)
        found.append((fixed, label, keyword, f" {before}{_phrase(words)}{after} "))

    for family, names in NAMES.items():
        for name in names:
            keyword = "license" if "license" in name.split() else name.split()[-1]
            add(family, keyword, name)
            for version in FAMILIES[family]:
                spdx = f"{family}-{version.replace(' ', '.')}"
                v = _phrase(version)
                if version.endswith(" 0"):
                    v = f"{version[0]}(?:  0)?"
                add(spdx, keyword, name, after=rf"(?:  as  published  by  the  free  software  foundation)?(?:  either)?  (?:version|v)  {v}")
                add(spdx, keyword, name, after=rf"  {v}")
    for family, versions in FAMILIES.items():
        for version in versions:
            spdx = f"{family}-{version.replace(' ', '.')}"
            add(spdx, "spdx", f"spdx license identifier {family} {version}")
            if family in ("gpl", "lgpl", "agpl", "gfdl"):
                add(f"{spdx}-only", "spdx", f"spdx license identifier {family} {version} only")
                add(f"{spdx}-or-later", "spdx", f"spdx license identifier {family} {version} or later")
            add(spdx, family, f"{family} {version}")
    for kind in ("mit", "isc", "bsd 2 clause", "bsd 3 clause", "unlicense", "zlib", "0bsd", "cc0 1 0"):
        add(kind.replace(" 1 0", "-1.0").replace(" ", "-"), "spdx", f"spdx license identifier {kind}")
    short = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    for parts, version in product(("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        label = f"cc-{parts.replace(' ', '-')}-{version.replace(' ', '.')}"
        add(label, "cc", f"cc {parts} {version}")
        long = " ".join(short[p] for p in parts.split())
        add(label, "commons", f"creative commons {long} {version}")
        add(label, "commons", f"creative commons {long}", after=rf"(?:  international|  unported)?(?:  (?:public)?  license)?  (?:version|v)  {_phrase(version)}")
    add("cc", "commons", "creative commons")
    for label, keyword, words in SINGLE:
        add(label, keyword, words)
    add("gpl-or-later", "later", "or at your option any later version")
    for label, keyword, expression in WRITTEN:
        least = re.sub(r"\(\?:[^()]*\)\?", "", expression)
        found.append((len(least.split()), label, keyword, f" (?:{expression.replace(' ', '  ')}) "))
    distinct = list(dict.fromkeys(found))
    ranked = sorted(range(len(distinct)), key=lambda i: (-distinct[i][0], i))
    return [(rank, *distinct[i][1:]) for rank, i in enumerate(ranked)]
