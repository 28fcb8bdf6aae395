"""License scan: ordered signature rules behind a keyword prefilter, in Spark SQL functions only.

A text is brought to its words, lower-cased and one blank apart, and every rule is a regular expression over
those. A rule belongs to a keyword, a piece of text that each of its matches holds; only rules whose keyword
stands in the text are run. Rules are ordered: identifiers come before notices, those before names and
sentences, and bare mentions last. A detection goes if another one of the same or a higher rank contains it; of
equal ones the first rule's stays. Containment within a rank or from above is transitive, so what is left is the
same whichever order detections are judged in. Detections that overlap otherwise both stay.

Detections are sorted by place once, and the furthest end so far of each rank tells whether one is contained;
sums and maxima along an array run in blocks, so a text with very many detections costs little more than its length.

Defined results: null and empty texts have no words and no detection; texts are scanned whole; a row is judged
alone, so rows that repeat give the same; an empty table gives no rows; input columns named as results are left
out, others are carried on.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.arrays import let, running, scan
from viaduct.llm.common import table

# The phrases that always count, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
TAG, NOTICE, NAME, MENTION = range(4)
STRENGTH = [1.0, 0.95, 0.85, 0.6]  # by rank

UNDER = "(?:licen[sc]ed|released|distributed|redistributed|available|provided|published|offered|covered|redistribute it and or modify it) (?:to you |in whole |only )?(?:under|by|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
BY_FSF = "(?: g?f?dl| l?a?gpl)?(?: as)?(?: published by the free software foundation)?(?: either)?"

# Identifiers as they are written in tags.
IDENTIFIERS = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-2.0
artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0
cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0
cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cddl-1.0 cddl-1.1 cecill-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0
ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0
gpl-3.0 hpnd icu ijg imagemagick intel ipl-1.0 isc jasper-2.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff
lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-1.0 mulanpsl-2.0 nasa-1.3 ncsa odbl-1.0 odc-by-1.0
ofl-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat
sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zlib-acknowledgement zpl-2.0 zpl-2.1
""".split()

# Label, keyword and name of a license; each is a rule for a notice and one for the name alone.
NAMES = [
    ("mit", "mit license", "(?:expat )?mit license"),
    ("mit", "expat license", "expat license"),
    ("mit-0", "no attribution", "mit no attribution(?: license)?"),
    ("apache-1", "apache", "apache (?:software )?license(?: version| v)? 1(?: 0)?"),
    ("apache-1.1", "apache", "apache (?:software )?license(?: version| v)? 1 1"),
    ("apache-2", "apache", "apache (?:software )?license(?: version| v)?(?: 2|2)(?: 0)?"),
    ("apache-2", "apache", "apache 2(?: 0)? license"),
    ("gpl", "general public licen", f"gnu general public licen[sc]e{BY_FSF}"),
    ("gpl-1", "general public licen", f"gnu general public licen[sc]e{BY_FSF}(?: version| v)? 1(?: 0)?"),
    ("gpl-2", "general public licen", f"gnu general public licen[sc]e{BY_FSF}(?: version| v)? 2(?: 0)?(?: of the license)?"),
    ("gpl-3", "general public licen", f"gnu general public licen[sc]e{BY_FSF}(?: version| v)? 3(?: 0)?(?: of the license)?"),
    ("gpl-2", "gnu gpl", "gnu gpl(?: version| v)?(?: 2|2)(?: 0)?"),
    ("gpl-3", "gnu gpl", "gnu gpl(?: version| v)?(?: 3|3)(?: 0)?"),
    ("gpl-2", " gpl", "gpl(?: version| v|v)? ?2(?: 0)?"),
    ("gpl-3", " gpl", "gpl(?: version| v|v)? ?3(?: 0)?"),
    ("lgpl", "general public licen", f"gnu (?:lesser|library) general public licen[sc]e{BY_FSF}"),
    ("lgpl-2", "general public licen", f"gnu (?:lesser|library) general public licen[sc]e{BY_FSF}(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "general public licen", f"gnu (?:lesser|library) general public licen[sc]e{BY_FSF}(?: version| v)? 2 1"),
    ("lgpl-3", "general public licen", f"gnu (?:lesser|library) general public licen[sc]e{BY_FSF}(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", " lgpl", "(?:gnu )?lgpl(?: version| v|v)? ?2 1"),
    ("lgpl-3", " lgpl", "(?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?"),
    ("agpl", "affero", f"(?:gnu )?affero general public licen[sc]e{BY_FSF}"),
    ("agpl-1", "affero", "affero general public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("agpl-3", "affero", f"(?:gnu )?affero general public licen[sc]e{BY_FSF}(?: version| v)? 3(?: 0)?"),
    ("agpl-3", " agpl", "(?:gnu )?agpl(?: version| v|v)? ?3(?: 0)?"),
    ("gfdl", "free documentation", f"gnu free documentation licen[sc]e{BY_FSF}"),
    ("gfdl-1.1", "free documentation", f"gnu free documentation licen[sc]e{BY_FSF}(?: version| v)? 1 1"),
    ("gfdl-1.2", "free documentation", f"gnu free documentation licen[sc]e{BY_FSF}(?: version| v)? 1 2"),
    ("gfdl-1.3", "free documentation", f"gnu free documentation licen[sc]e{BY_FSF}(?: version| v)? 1 3"),
    ("gpl-classpath", "classpath exception", "gnu (?:general public licen[sc]e|gpl)(?: version| v)? 2(?: 0)? with (?:the )?classpath exception"),
    ("bsd", "bsd", "bsd(?: style| type)? license"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)"),
    ("0bsd", "bsd", "(?:bsd zero clause|zero clause bsd|0bsd)(?: license)"),
    ("0bsd", "free public license", "free public license 1 0 0"),
    ("isc", "isc license", "isc license"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("mpl-1", "mozilla", "mozilla public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version| v)? 1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("epl-1", "eclipse", "eclipse public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("edl-1", "eclipse", "eclipse distribution licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("cddl", "common development", "common development and distribution licen[sc]e"),
    ("cddl-1", "common development", "common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1(?: 0)?"),
    ("cddl-1.1", "common development", "common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1 1"),
    ("cpl-1", "common public license", "common public license(?: version| v)? 1(?: 0)?"),
    ("ipl-1", "ibm public license", "ibm public license(?: version| v)? 1(?: 0)?"),
    ("cpal-1", "common public attribution", "common public attribution license(?: version| v)? 1(?: 0)?"),
    ("eupl", "european union public", "european union public licen[sc]e"),
    ("eupl-1.1", "european union public", "european union public licen[sc]e(?: eupl)?(?: version| v)? 1 1"),
    ("eupl-1.2", "european union public", "european union public licen[sc]e(?: eupl)?(?: version| v)? 1 2"),
    ("bsl-1", "boost software", "boost software license(?: version| v)?(?: 1(?: 0)?)?"),
    ("busl-1.1", "business source", "business source license(?: version| v)?(?: 1 1)?"),
    ("sspl-1", "server side public", "server side public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("elastic-2", "elastic license", "elastic license(?: version| v)? ?2(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "what the fuck", "do what the fuck you want to public license"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng", "libpng license(?: version 2)?"),
    ("ijg", "independent jpeg", "independent jpeg group s? ?license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("artistic-1", "artistic", "artistic license(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? 2(?: 0)?"),
    ("artistic", "artistic", "(?:perl )?artistic license"),
    ("afl-3", "academic free", "academic free license(?: version| v)? 3(?: 0)?"),
    ("afl", "academic free", "academic free license"),
    ("osl-3", "open software license", "open software license(?: version| v)? 3(?: 0)?"),
    ("osl", "open software license", "open software license"),
    ("ofl-1.1", "open font license", "(?:sil )?open font license(?: version| v)?(?: 1 1)?"),
    ("odbl-1", "open database license", "open database license(?: odbl)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("odc-by-1", "open data commons", "open data commons attribution license(?: version| v)?(?: 1(?: 0)?)?"),
    ("pddl-1", "public domain dedication", "(?:open data commons )?public domain dedication and license"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1", "creative commons zero", "creative commons zero(?: license)?(?: 1 0)?(?: universal)?"),
    ("ms-pl", "microsoft public", "microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license(?: ms rl)?"),
    ("upl-1", "universal permissive", "universal permissive license(?: version| v)?(?: 1(?: 0)?)?"),
    ("ecl-2", "educational community", "educational community license(?: version| v)?(?: 2(?: 0)?)?"),
    ("psf-2", "python software foundation", "python software foundation license(?: version| v)?(?: 2(?: 0)?)?"),
    ("php-3", "php license", "php license(?: version| v)?(?: 3(?: 0|01| 01)?)?"),
    ("ruby", "ruby license", "(?:the )?ruby license"),
    ("postgresql", "postgresql license", "postgresql license"),
    ("openssl", "openssl license", "openssl license"),
    ("lppl", "latex project", "latex project public license(?: version| v)?(?: 1 3c?)?"),
    ("w3c", "w3c", "w3c software(?: notice and)?(?: and document)? license"),
    ("qpl-1", "q public license", "q public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("zpl-2", "zope", "zope public license(?: version| v)?(?: 2(?: 1| 0)?)?"),
    ("apsl-2", "apple public source", "apple public source license(?: version| v)?(?: 2(?: 0)?)?"),
    ("mulan-2", "mulan", "mulan (?:psl|permissive software license)(?: version| v|v)? ?2"),
    ("cecill-2.1", "cecill", "cecill(?: license)?(?: version| v)? 2 1"),
    ("cecill", "cecill", "cecill(?: free software)?(?: license)?"),
    ("blueoak-1", "blue oak", "blue oak model license(?: 1 0 0)?"),
    ("ftl", "freetype", "freetype (?:project )?license"),
    ("vim", "vim license", "vim license"),
    ("x11", "x11", "x11 license"),
    ("openrail", "rail", "(?:creativeml )?(?:bigscience )?open ?rail(?: m| rail m)? license"),
    ("llama-community", "community license", "llama(?: 2| 3)? community license(?: agreement)?"),
]

# Label, keyword and a sentence that only stands in that license or its notice.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse or promote products", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "you may not use this file except", "you may not use this file except in compliance with the license you may obtain a copy of the license at http s? ?www apache org licenses license 2 0"),
    ("apache-2", "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2", "apache org licenses", "(?:https? )?www apache org licenses license 2 0"),
    ("gpl", "it under the terms of the gnu general", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "it under the terms of the gnu lesser", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "it under the terms of the gnu affero", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "should have received a copy of the gnu general", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3", "29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("agpl-3", "19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("gpl", "gnu org licenses gpl", "(?:https? )?www gnu org licenses gpl(?: html| txt)?"),
    ("lgpl", "gnu org licenses lgpl", "(?:https? )?www gnu org licenses lgpl(?: html| txt)?"),
    ("agpl", "gnu org licenses agpl", "(?:https? )?www gnu org licenses agpl(?: html| txt)?"),
    ("gpl-2", "gnu org licenses", "(?:https? )?www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3", "gnu org licenses", "(?:https? )?www gnu org licenses gpl 3 0(?: html| txt)?"),
    ("mpl-2", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "subject to the mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla org", "(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("epl-1", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("cddl-1", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "(?:https? )?(?:www )?unlicense org"),
    ("wtfpl", "you just do what", "0 you just do what the fuck you want to"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "boost org license", "(?:https? )?www boost org license 1 0 txt"),
    ("bsl-1", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0-1", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc0-1", "publicdomain zero", "(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("pd-mark", "publicdomain mark", "(?:https? )?creativecommons org publicdomain mark 1 0"),
    ("ofl-1.1", "scripts sil org", "(?:https? )?scripts sil org ofl"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("odbl-1", "opendatacommons org", "(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", "opendatacommons org", "(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons org", "(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("ncsa", "deal with the software", "to deal with the software without restriction"),
    ("mit", "deal in the software", "to deal in the software without restriction"),
    ("wordnet", "wordnet", "wordnet 3 0 license"),
    ("unicode", "data files and any associated documentation", "copy of the unicode data files and any associated documentation"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("perl", "same terms as perl", "(?:under )?the same terms as perl(?: itself)?"),
    ("python", "same terms as python", "(?:under )?the same terms as python(?: itself)?"),
]

# Label, keyword and a mention that says little alone.
MENTIONS = [
    ("mit", "mit license", "mit licensed?"),
    ("mit", "mit licence", "mit licenced?"),
    ("apache", "apache", "apache (?:software )?license"),
    ("apache-2", "apache", "apache ?2(?: 0)?"),
    ("gpl", " gpl", "(?:gnu )?gpl"),
    ("lgpl", " lgpl", "(?:gnu )?lgpl"),
    ("agpl", " agpl", "(?:gnu )?agpl"),
    ("gpl-2", " gplv2", "gplv2"),
    ("gpl-3", " gplv3", "gplv3"),
    ("lgpl-2.1", " lgplv2", "lgplv2 1"),
    ("lgpl-3", " lgplv3", "lgplv3"),
    ("agpl-3", " agplv3", "agplv3"),
    ("bsd", "bsd licensed", "bsd licensed"),
    ("mpl-2", " mpl", "mpl ?2(?: 0)?"),
    ("mpl-1.1", " mpl", "mpl ?1 1"),
    ("epl-2", " epl", "epl 2 0"),
    ("eupl", " eupl", "eupl"),
    ("cddl", " cddl", "cddl"),
    ("wtfpl", " wtfpl", "wtfpl"),
    ("sspl-1", " sspl", "sspl"),
    ("odbl-1", " odbl", "odbl"),
    ("gfdl", " gfdl", "gfdl"),
    ("creative-commons", "creative commons", "creative commons(?: attribution)?(?: public)?(?: license)?"),
    ("copyleft", "copyleft", "copyleft"),
]

# The terms of creative commons licenses, short and in words.
COMMONS = [("by", "attribution"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by sa", "attribution share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike")]
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def label_of(identifier: str) -> str:
    return identifier.removesuffix(".0.0").removesuffix(".0")


def commons_rules() -> list[tuple[str, str, str, int]]:
    """Each set of terms without a version and with one, as a name in a notice, in words, in short and as a link."""
    out = []
    for (short, long), version in itertools.product(COMMONS, ["", *COMMONS_VERSIONS]):
        label = label_of("-".join(["cc", *short.split(), version]).rstrip("-"))
        number = version.replace(".", " ").removesuffix(" 0")
        end = f"(?: version| v)? {number}(?: 0)?(?: international| unported| generic)?" if version.endswith(".0") else f"(?: version| v)? {number}(?: generic)?" if version else ""
        words, brief = f"creative commons {long}{end}", f"cc {short}{end}"
        out += [(label, "creative commons", UNDER + words, NOTICE), (label, "creative commons", words, NAME), (label, f"cc {short}", UNDER + brief, NOTICE), (label, f"cc {short}", brief, NAME)]
        if version:
            out.append((label, "creativecommons org licenses", f"(?:https? )?(?:www )?creativecommons org licenses {short} {version.replace('.', ' ')}", TAG))
    return out


def rules() -> list[tuple[str, str, str, int]]:
    """``(label, keyword, pattern, rank)`` in order."""
    tags = [(label_of(x), "spdx license identifier", f"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", TAG) for x in IDENTIFIERS]
    named = [(label, keyword, UNDER + name, NOTICE) for label, keyword, name in NAMES] + [(label, keyword, name, NAME) for label, keyword, name in NAMES]
    rest = [(*x, NAME) for x in SENTENCES] + [(*x, MENTION) for x in MENTIONS]
    return sorted(tags + commons_rules() + named + rest, key=lambda x: x[3])


def words_of(text):
    """The words of a text, each with a blank before and after, one between two."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def blanks(text):
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def detections(words):
    """``start, end, rank, ord, label`` of all matches, words from 0 and the end exclusive."""
    every = rules()
    keywords = list(dict.fromkeys(r[1] for r in every))
    one = lambda i, r: F.struct(F.lit(i).alias("ord"), F.lit(r[3]).alias("rank"), F.lit(r[0]).alias("label"), F.lit(rf"\G([\s\S]*?)(?<= )({r[2]})(?= )").alias("pattern"))
    groups = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[one(i, r) for i, r in enumerate(every) if r[1] == k]).alias("rules")) for k in keywords])
    chosen = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))

    def matches(r):
        part = lambda i: F.transform(F.regexp_extract_all(words, r["pattern"], F.lit(i)), blanks)
        pieces = F.arrays_zip(part(1).alias("gap"), part(2).alias("more"))
        placed = let(pieces, lambda p: F.arrays_zip(p.alias("p"), running(F.transform(p, lambda x: x["gap"] + x["more"])).alias("end")))
        return F.transform(placed, lambda x: F.struct((x["end"] - x["p"]["more"] - 1).alias("start"), x["end"].alias("end"), r["rank"].alias("rank"), r["ord"].alias("ord"), r["label"].alias("label")))

    return F.flatten(F.transform(chosen, matches))


def uncontained(found):
    """The detections that none of the same or a higher rank contains, by start."""
    ends = lambda e: F.struct(*[v.alias(f"e{i}") for i, v in enumerate(e)])
    none = ends([F.lit(-1).cast("long")] * len(STRENGTH))
    ranks = range(len(STRENGTH))
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], (-x["end"]).alias("back"), x["rank"], x["ord"], x["label"])))
    step = lambda s, x: ends([F.when(x["rank"] <= i, F.greatest(s[f"e{i}"], -x["back"])).otherwise(s[f"e{i}"]) for i in ranks])
    merge = lambda s, t: ends([F.greatest(s[f"e{i}"], t[f"e{i}"]) for i in ranks])
    furthest = lambda s, x: F.get(F.array(*[s[f"e{i}"] for i in ranks]), x["rank"])

    def kept(items):
        flags = scan(items, none, step, merge, lambda s, x: furthest(s, x) < -x["back"], "boolean")
        return F.filter(F.arrays_zip(items.alias("x"), flags.alias("keep")), lambda z: z["keep"])

    return F.transform(let(order, kept), lambda z: F.struct(z["x"]["start"], (-z["x"]["back"]).alias("end"), z["x"]["rank"], z["x"]["ord"], z["x"]["label"]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the fixed
    phrases; ``detections`` (start, end, rank, ord, label); ``labels``, both, joined; and ``score``, the
    strength of the surest detection."""
    carried = docs.select(*[c for c in docs.columns if c.lower() not in {*RESULTS, "words"}], words_of(F.col("text")).alias("words"))
    words = F.col("words")
    there = [(F.contains(words, F.lit(f" {p} ")), f" {p} ", label) for p, label in PHRASES]
    total = lambda each: sum(each[1:], each[0])
    n_base = total([F.when(has, F.regexp_count(words, F.lit(f"(?<= ){p.strip()}(?= )"))).otherwise(0) for has, p, _ in there]).cast("long")
    first = F.array_min(F.array(*[F.when(has, blanks(F.left(words, F.instr(words, p) - 1))) for has, p, _ in there]))
    left = lambda p: F.col("n_words") - blanks(F.substring_index(words, p, -1)) - len(p.split())
    last = F.array_max(F.array(*[F.when(has, left(p)) for has, p, _ in there]))
    base = F.array_compact(F.array(*[F.when(has, F.lit(label)) for has, _, label in there]))
    out = carried.withColumn("n_words", blanks(words) - 1)
    out = out.select("*", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base.alias("_base"), uncontained(detections(words)).alias("detections")).drop("words")
    every = F.array_sort(F.array_union("_base", F.transform("detections", lambda x: x["label"])))
    best = F.array_min(F.transform("detections", lambda x: x["rank"]))
    strength = F.get(F.array(*[F.lit(s) for s in STRENGTH]), best)
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(strength, F.lit(0.0)))
    return out.select("*", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score")).drop("_base")


def op11_licenses(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def _base_sql() -> str:
    rows = "d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)"
    at = lambda p: f"[i FOR i IN generate_series(0, len(w) - {len(p.split())}) IF w[i + 1:i + {len(p.split())}] = {p.split()!r}]"
    hits = " UNION ALL ".join(f"SELECT r, unnest({at(p)}) AS i, '{label}' AS label FROM d" for p, label in PHRASES)
    return f"WITH {rows}, h AS ({hits}) SELECT doc_id, len(w) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN h USING (r) GROUP BY r, doc_id, w"


BASE_SQL = _base_sql()
