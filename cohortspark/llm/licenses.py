"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

DataFrame expressions only. Texts are reduced to their words, joined by single spaces with a space at either end, so
a signature is a regex over whole words and a place is a number of words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, own_names, running

# The base phrases with their labels, and the characters that words are made of.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Priorities; a detection yields to one of the same or a higher priority that contains it.
TAG, NOTICE, NAME = 3, 2, 1
CONFIDENCE = {TAG: 1.0, NOTICE: 0.95, NAME: 0.8}

SAID = "license|licence|licenses|licences|licensing|licensed|licenced|terms|released|distributed|published|provided|available|placed|subject"
# Families: label, keywords of which the text must hold one as a word, tag (word form of the SPDX identifier), name (regex over
# words), versions. Hand-written; each gives the four forms of `signatures`.
FAMILIES = (
    ("mit", f"expat|{SAID}", "mit", "(?:the )?(?:mit|expat)(?: x11)?", ""),  # "mit" is a German word
    ("apache", "apache", "apache", "(?:the )?apache(?: software)?", "1 0|1 1|2 0|2"),
    ("gpl", "gpl|general", "gpl", "(?:the )?(?:gnu )?(?:gpl|general public)", "1|2|3|1 0|2 0|3 0"),
    ("lgpl", "lgpl|lesser|library", "lgpl", "(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public)", "2|2 1|3|2 0|3 0"),
    ("agpl", "agpl|affero", "agpl", "(?:the )?(?:gnu )?(?:agpl|affero general public)", "1|3|1 0|3 0"),
    ("fdl", "gfdl|documentation", "gfdl", "(?:the )?(?:gnu )?(?:gfdl|free documentation)", "1 1|1 2|1 3"),
    ("bsd", "bsd", "bsd", "(?:the )?(?:(?:new|modified|simplified|revised|original|[234] clause|two clause|three clause) )?bsd", "2 clause|3 clause|4 clause"),
    ("mpl", "mpl|mozilla", "mpl", "(?:the )?(?:mpl|mozilla public)", "1 0|1 1|2 0|2"),
    ("epl", "epl|eclipse", "epl", "(?:the )?(?:epl|eclipse public)", "1 0|2 0|1|2"),
    ("eupl", "eupl", "eupl", "(?:the )?(?:european union public licen[cs]e )?eupl", "1 0|1 1|1 2"),
    ("cddl", "cddl", "cddl", "(?:the )?(?:common development and distribution licen[cs]e )?cddl", "1 0|1 1"),
    ("cpl", "common", "cpl", "(?:the )?common public", "1 0"),
    ("ipl", "ibm", "ipl", "(?:the )?ibm public", "1 0"),
    ("isc", "isc", "isc", "(?:the )?isc", ""),
    ("zlib", "zlib", "zlib", "(?:the )?zlib(?: libpng)?", ""),
    ("libpng", "libpng", "libpng", "(?:the )?libpng", "2 0"),
    ("boost", "boost|bsl", "bsl", "(?:the )?boost software", "1 0"),
    ("artistic", "artistic", "artistic", "(?:the )?(?:perl )?artistic", "1 0|2 0"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "(?:the )?wtfpl", "1|2"),
    ("psf", "python|psf", "psf", "(?:the )?python(?: software foundation)?", "2|2 0"),
    ("php", "php", "php", "(?:the )?php", "3 0|3 01"),
    ("ruby", "ruby", "ruby", "(?:the )?ruby", ""),
    ("openssl", "openssl", "openssl", "(?:the )?openssl", ""),
    ("postgresql", "postgresql", "postgresql", "(?:the )?postgresql", ""),
    ("ofl", "ofl|font", "ofl", "(?:the )?(?:sil )?(?:ofl|open font)", "1 0|1 1"),
    ("odbl", "odbl|database", "odbl", "(?:the )?(?:odbl|open database)", "1 0"),
    ("odc-by", "odc|attribution", "odc by", "(?:the )?(?:odc by|open data commons attribution)", "1 0"),
    ("ms-pl", "ms|microsoft", "ms pl", "(?:the )?microsoft public", ""),
    ("ms-rl", "ms|reciprocal", "ms rl", "(?:the )?microsoft reciprocal", ""),
    ("afl", "afl|academic", "afl", "(?:the )?academic free", "1 1|1 2|2 0|2 1|3 0"),
    ("osl", "osl", "osl", "(?:the )?(?:open software licen[cs]e )?osl", "1 0|2 0|2 1|3 0"),
    ("upl", "upl", "upl", "(?:the )?(?:universal permissive licen[cs]e )?upl", "1 0"),
    ("ncsa", "ncsa", "ncsa", "(?:the )?(?:university of illinois )?ncsa(?: open source)?", ""),
    ("cecill", "cecill", "cecill", "(?:the )?cecill", "1 0|1 1|2 0|2 1|b|c"),
    ("sspl", "sspl", "sspl", "(?:the )?(?:server side public licen[cs]e )?sspl", "1|1 0"),
    ("busl", "busl|business", "busl", "(?:the )?business source", "1 1"),
    ("elastic", "elastic", "elastic", "(?:the )?elastic", "1 0|2 0"),
    ("vim", "vim", "vim", "(?:the )?vim", ""),
    ("beerware", "beerware", "beerware", "(?:the )?beerware", ""),
    ("cc0", "cc0", "cc0", "(?:the )?(?:creative commons )?cc0", "1 0"),
    ("cc-by", "cc|commons", "cc by", "(?:the )?(?:(?:cc|creative commons) by|creative commons attribution)", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "cc|commons", "cc by sa", "(?:the )?(?:(?:cc|creative commons) by sa|creative commons attribution share ?alike)", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "cc|commons", "cc by nd", "(?:the )?(?:(?:cc|creative commons) by nd|creative commons attribution no ?derivatives)", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "cc|commons", "cc by nc", "(?:the )?(?:(?:cc|creative commons) by nc|creative commons attribution non ?commercial)", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "cc|commons", "cc by nc sa", "(?:the )?(?:(?:cc|creative commons) by nc sa|creative commons attribution non ?commercial share ?alike)", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "cc|commons", "cc by nc nd", "(?:the )?(?:(?:cc|creative commons) by nc nd|creative commons attribution non ?commercial no ?derivatives)", "1 0|2 0|2 5|3 0|4 0"),
    ("public-domain", "domain", "public domain", "(?:the )?public domain", ""),
)
# Passages of licence texts and notices that need no name: label, keywords, regex over words. Hand-written.
PASSAGES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", "(?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "dealings", "arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-0", "deal", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", "author", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", "representations", "makes? no representations about the suitability of this software for any purpose"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "(?:neither the names? of .{1,80}? nor the names of (?:its|their) contributors|the name of the author) may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "regents", "copyright c? ?.{0,40}?the regents of the university of california"),
    ("bsd", "exemplary", "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "distributed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache", "prominent", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "option", "either version [23] of the license or at your option any later version"),
    ("gpl", "gpl|gnu", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu", "see the gnu general public license for more details"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "absolutely", "comes with absolutely no warranty for details type show w"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "preferred", "the source code for a work means the preferred form of the work for making modifications to it"),
    ("gpl", "conveying", "nothing in this license shall be construed as excluding or limiting .{0,60}?conveying"),
    ("gpl-classpath", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc", "runtime", "you are granted additional permissions described in the gcc runtime library exception"),
    ("lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "library", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "combined", "a combined work is a work produced by combining or linking an application with the library"),
    ("agpl", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "remotely", "prominently offer all users interacting with it remotely through a computer network"),
    ("fdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("fdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org"),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl", "netscape", "the contents of this file are subject to the netscape public license"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("edl", "eclipse", "under the terms of the eclipse distribution license"),
    ("eupl", "european", "licensed under the eupl version 1 [012] or as soon they will be approved by the european commission subsequent versions"),
    ("cddl", "cddl|common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl", "when distributing covered code include this cddl header notice in each file"),
    ("cpl", "agreement", "the accompanying program is provided under the terms of this common public license agreement"),
    ("boost", "boost", "distributed under the boost software license"),
    ("boost", "executable", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("artistic", "artistic", "you may (?:copy|use|redistribute) .{0,40}?under the terms of (?:either )?.{0,40}?the artistic license"),
    ("artistic", "perl", "this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", "usenet", "place your modifications in the public domain or otherwise make them freely available such as by posting said modifications to usenet"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedication", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0", "waive", "to the extent possible under law .{1,60}? waived? all copyright and related or neighboring rights"),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("psf", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test"),
    ("psf", "beopen", "beopen python open source license agreement"),
    ("cnri", "cnri", "cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "php", "this product includes php software freely available from http www php net"),
    ("php", "php", "products derived from this software may not be called php"),
    ("ruby", "ruby", "you may redistribute .{0,60}?under the same terms as ruby"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("postgresql", "postgres", "postgresql database management system formerly known as postgres"),
    ("curl", "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided .{0,200}?curl"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", "portions of this software are copyright .{0,40}?the freetype project"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font name"),
    ("bitstream-vera", "typefaces", "the fonts? (?:software )?may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("ubuntu-font", "ubuntu", "ubuntu font licen[cs]e"),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode|unicode) data files"),
    ("icu", "icu", "icu license icu 1 8 1 and later"),
    ("w3c", "w3c", "by obtaining using and or copying this work you the licensee agree .{0,80}?w3c"),
    ("w3c", "w3c", "w3c (?:software|document) (?:notice and )?license"),
    ("odbl", "database", "this .{1,40}? is made available under the open database license"),
    ("odbl", "opendatacommons", "opendatacommons org licenses odbl"),
    ("pddl", "public", "public domain dedication and licen[cs]e pddl"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [0-9] [0-9]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "exercising", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal", "reciprocal grants for any file you distribute that contains code from the software"),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", "change", "change date .{0,40}?change license"),
    ("elastic", "managed", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", "polyform (?:noncommercial|strict|shield|small business|perimeter) license"),
    ("llama", "llama", "llama [0-9](?: [0-9])? (?:community|version) license"),
    ("rail", "rail|openrail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m| s)?(?: license)?"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose .{0,400}?tcl"),
    ("latex", "latex", "(?:under the )?(?:conditions of the )?latex project public license"),
    ("sun", "sun", "sun microsystems inc .{0,60}?nuclear facility"),
    ("oracle", "oracle", "oracle (?:binary code|technology network) license agreement"),
    ("intel", "intel", "intel (?:simplified|open source) (?:software )?license"),
    ("nvidia", "nvidia", "nvidia (?:software license agreement|source code license)"),
    ("apple", "apple", "apple (?:public source|sample code) license"),
    ("google", "google", "additional ip rights grant patents .{0,80}?google"),
    ("bouncy-castle", "bouncy", "the legion of the bouncy castle"),
    ("anti-996", "996", "anti 996 license"),
    ("hippocratic", "hippocratic", "hippocratic license"),
    ("mulan", "mulan", "mulan (?:psl|publ|permissive software license)(?: v[0-9])?"),
    ("blue-oak", "oak", "blue oak model license"),
    ("parity", "parity", "parity public license"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "(?:this (?:file|document|software) contains )?confidential and proprietary(?: information)?"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution)(?: or (?:copying|reproduction|distribution))? of this (?:file|document|software|program)"),
    ("proprietary", "evaluation", "(?:for )?(?:internal )?evaluation (?:purposes|use) only"),
    ("non-commercial", "commercial", "(?:for )?(?:personal and )?non commercial use only"),
    ("non-commercial", "research|academic", "for (?:academic|research)(?: and (?:academic|research|educational))? (?:purposes|use) only"),
    ("freeware", "freeware", "this (?:software|program) is (?:distributed as )?freeware"),
    ("shareware", "shareware", "this (?:software|program) is (?:distributed as )?shareware"),
)
LICENCE = "(?:licen[cs]es?|licen[cs]ing terms|terms)"
UNDER = "(?:(?:is |are |was )?(?:dual |re )?(?:licen[cs]ed|released|distributed|published|available|provided|made available|placed|subject) (?:under|to|into|in)(?: the terms of)?(?: either)?)"


@dataclass(frozen=True)
class Signature:
    """One rule: regex over words, tried where the text holds one of the keywords (separated by bars) as a word."""

    label: str
    keyword: str
    regex: str
    priority: int


def signatures() -> list[Signature]:
    """The rules in order; of equal detections the earlier rule's stands."""
    out = [Signature(label, keyword, regex, NOTICE) for label, keyword, regex in PASSAGES]
    for label, keyword, tag, name, versions in FAMILIES:
        number = f"(?: (?:version |v)?(?:{versions}))" if versions else ""
        later = "(?: (?:only|or later|or any later version))?"
        out += [
            Signature(label, "spdx", f"spdx licen[cs]e identifier {tag}(?: [0-9][0-9]?)*{later}", TAG),
            Signature(label, "license|licence", f"licen[cs]e (?:expression |name |type |is )?{tag}{number and number + '?'}", NOTICE if number else NAME),
            Signature(label, keyword, f"{UNDER} {name}(?: {LICENCE})?{number and number + '?'}{later}", NOTICE),
            Signature(label, keyword, f"{name}(?: {LICENCE}{number and number + '?'}{'|' + number if number else ''}){later}", NAME),
        ]
    return out


def words(text: Column) -> Column:
    """Lower-cased words of a text; null counts as empty."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without lower-casing or filtering them."""
    return F.aggregate(F.array(F.split(F.coalesce(text, F.lit("")), GAP + "+")), F.lit(0), lambda n, p: F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long")


def phrase_places(w: Column, phrase: str) -> Column:
    """Word numbers, from 0, where the phrase's words stand one after another."""
    parts = phrase.split(" ")

    def fits(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + k) == p)
        return out

    return F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), fits)


DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"
MARK = "\x01"  # put before and behind a match; no word holds it


def _detections(joined: Column, present: Column, rules: list[Signature]) -> Column:
    """All matches as DETECTIONS, in words, end exclusive. Each rule is an expression of its own with a literal regex, which is
    compiled once, and looks at texts that hold one of its keywords; places are worked out for rules with a match."""

    def marked(i: int, r: Signature) -> Column:
        rule = F.struct(F.lit(r.priority).alias("priority"), F.lit(i).alias("rule"), F.lit(r.label).alias("label"))
        text = F.regexp_replace(joined, F.lit(f"(?<= ){r.regex}(?= )"), F.lit(f"{MARK}$0{MARK}"))
        return F.when(F.arrays_overlap(present, F.array(*map(F.lit, r.keyword.split("|")))), F.struct(text.alias("text"), rule.alias("rule")))

    def placed(m: Column) -> Column:
        # Every other part is a match. Before it stand as many words as spaces, less one; it ends before as many.
        def each(parts: Column) -> Column:
            spaces = running(F.transform(parts, lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))), lambda a, b: a + b)
            one = lambda e: lambda k: F.struct((F.get(e, k - 1) - 1).alias("start"), F.get(e, k).alias("end"), *(m["rule"][c].alias(c) for c in ("priority", "rule", "label")))
            return let(spaces, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 2, F.lit(2)), one(e)))

        return let(F.split(m["text"], F.lit(MARK), -1), each).cast(DETECTIONS)

    texts = F.array(*(marked(i, r) for i, r in enumerate(rules)))
    found = F.filter(texts, lambda m: m.isNotNull() & F.contains(m["text"], F.lit(MARK)))
    return F.flatten(F.transform(found, placed)).cast(DETECTIONS)


def _resolved(found: Column) -> Column:
    """Drops a detection contained in one of a higher priority, or of its own that is longer or comes from an earlier
    rule. In order of start, longest first, only the furthest end before it on each priority is needed: running maxima."""
    levels = (TAG, NOTICE, NAME)
    by = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("p"), d["rule"].alias("rule"), d["label"].alias("label"))))

    def stands(ends: dict[int, Column]) -> Callable[[Column, Column], Column]:
        before = lambda level, i: F.coalesce(F.get(ends[level], i - 1), F.lit(0))
        return lambda d, i: ~reduce(Column.__or__, [(-d["p"] <= level) & (-d["back"] <= before(level, i)) for level in levels])

    def kept(a: Column) -> Column:
        own = lambda level: F.transform(a, lambda d: F.when(d["p"] == -level, -d["back"]).otherwise(0))
        reach = [running(own(level), F.greatest).alias(f"e{level}") for level in levels]
        return let(F.struct(*reach), lambda e: F.filter(a, stands({level: e[f"e{level}"] for level in levels})))

    return F.transform(let(by, kept), lambda d: F.struct(d["start"], (-d["back"]).alias("end"), (-d["p"]).alias("priority"), d["rule"], d["label"])).cast(DETECTIONS)


def alternatives(keywords: list[str]) -> str:
    """Regex of the sorted keywords in any case, by first letter, so that most words are passed over at once."""
    return "|".join(f"[{c}{c.upper()}](?i:{'|'.join(k[1:] for k in own)})" for c, own in groupby(keywords, key=lambda k: k[0]))


@own_names
def scan(docs: DataFrame, text: str = "text", rules: list[Signature] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """Adds n_words, base (array of struct start, label), detections (array of struct start, end in words, priority,
    rule, label) and score.

    A cheap test of the whole text for any keyword comes first; only texts that pass are matched, and there only the
    rules whose keyword is one of the words. score: the highest confidence of a detection that stands, else 0.
    Null and empty texts have no words and no detections; repeated rows are scanned alike; an empty table gives an
    empty one; columns with the added names are replaced."""
    rules = rules if rules is not None else signatures()
    keywords = sorted({k for r in rules for k in r.keyword.split("|")} | {p.split(" ")[-1] for p, _ in base})
    gate = F.coalesce(F.concat(F.lit(" "), F.col(text), F.lit(" ")).rlike(f"{GAP}(?:{alternatives(keywords)}){GAP}"), F.lit(False))
    places_kind, kind = "array<struct<start:int,label:string>>", "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"

    def places_of(s: Column, phrase: str, label: str) -> Column:
        starts = F.when(F.array_contains(s["k"], phrase.split(" ")[-1]), phrase_places(s["w"], phrase)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    def places(s: Column) -> Column:
        return F.flatten(F.array(*[places_of(s, *b) for b in base]))

    def found(w: Column) -> Column:
        parts = F.struct(w.alias("w"), F.array_intersect(w, F.array(*map(F.lit, keywords))).alias("k"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("j"))
        return let(parts, lambda s: F.struct(places(s).cast(places_kind).alias("base"), let(_detections(s["j"], s["k"], rules), _resolved).cast(kind).alias("detections")))

    out = docs.drop("n_words", "base", "detections", "score").withColumn("n_words", n_words(F.col(text))).withColumn("_s", F.when(gate, let(words(F.col(text)), found)))
    out = out.withColumn("base", F.coalesce("_s.base", F.array().cast(places_kind))).withColumn("detections", F.coalesce("_s.detections", F.array().cast(kind)))
    confidence = F.lit(0.0)

    def score(best: Column) -> Column:
        return reduce(lambda rest, level: F.when(best == level, F.lit(CONFIDENCE[level])).otherwise(rest), CONFIDENCE, confidence)

    return out.withColumn("score", let(F.array_max(F.transform("detections", lambda d: d["priority"])), score)).drop("_s")
