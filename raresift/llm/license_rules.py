"""Ordered signature rules of licenses, as patterns over words.

A pattern is a regular expression over lower-case words with one space between them; ``_`` stands for any word. Words are
runs of ASCII letters, digits and characters beyond ASCII, so "Apache-2.0" is ``apache 2 0``. Every family gives three
rules (SPDX tag, grant, name); notices are single rules. A rule is tried only on texts that hold one of its keywords,
and only on texts that ``GATE`` lets through. The order of ``RULES`` is the order of priority within a tier.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Tiers of priority: full notices, tags and grants; names; hints without a name.
NOTICE, NAME, HINT = 1, 2, 3


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


_L = "licen[cs]e"
_V = "(?:version |v )?"
_GPL = "(?:gnu )?general public licen[cs]e"
_LGPL = "(?:gnu )?(?:lesser|library) general public licen[cs]e"
_AGPL = "(?:gnu )?affero general public licen[cs]e"
_CC = "(?:creative commons|cc)"
_LATER = "(?: or(?: at your option)? (?:any )?later(?: version)?| plus)"


def _cc(terms: str, words: str, version: str) -> tuple[str, str, str, str]:
    """A Creative Commons family: by initials or by words, one version."""
    number = version.replace(".", " ")
    kind = terms.replace("-", " ")
    name = f"{_CC} (?:{kind}|{words})(?: (?:international|unported|generic|public))?(?: {_L})?(?: {_V}{number}| {number})"
    return (f"cc-{terms}-{version}", "cc creative", name, f"cc {kind} {number}")


_CC_TERMS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}

#: Label, keywords, name, SPDX identifier in words. Names with a version stand before those without.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("mit", "mit expat x11", f"(?:mit(?: x11| expat)?|expat|x11) {_L}", "(?:mit|x11)"),
    ("mit-0", "mit", f"mit (?:0|no attribution) {_L}", "mit 0"),
    ("apache-1.1", "apache", f"apache(?: software)? {_L} {_V}1 1", "apache 1 1"),
    ("apache-2.0", "apache asl", f"(?:apache(?: software)? {_L}(?: {_V}| )2(?: 0)?|asl 2 0|apache 2 0(?: {_L})?)", "apache 2 0"),
    ("apache", "apache", f"apache(?: software)? {_L}", "apache"),
    ("bsd-2-clause", "bsd freebsd", f"(?:(?:simplified|2 clause|two clause|freebsd) bsd|bsd (?:2|two) clause|freebsd)(?: {_L})?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", f"(?:(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause)(?: {_L})?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause)(?: {_L})?", "bsd 4 clause"),
    ("0bsd", "bsd 0bsd free", f"(?:0bsd|zero clause bsd|bsd zero clause|free public)(?: {_L})", "0bsd"),
    ("bsd", "bsd", f"bsd(?: style)? {_L}", "bsd"),
    ("agpl-3.0-or-later", "agpl agplv3 affero", f"(?:{_AGPL}(?: {_V}| )3(?: 0)?|agpl ?v?3(?: 0)?){_LATER}", "agpl 3 0 or later"),
    ("agpl-3.0", "agpl agplv3 affero", f"(?:{_AGPL}(?: {_V}| )3(?: 0)?|agpl ?v?3(?: 0)?)", "agpl 3 0(?: only)?"),
    ("agpl", "agpl affero", f"(?:{_AGPL}|agpl)", "agpl"),
    ("lgpl-2.1-or-later", "lgpl lgplv2 lesser library", f"(?:{_LGPL}(?: {_V}| )2 1|lgpl ?v?2 1){_LATER}", "lgpl 2 1 or later"),
    ("lgpl-2.1", "lgpl lgplv2 lesser library", f"(?:{_LGPL}(?: {_V}| )2 1|lgpl ?v?2 1)", "lgpl 2 1(?: only)?"),
    ("lgpl-2.0", "lgpl lgplv2 lesser library", f"(?:{_LGPL}(?: {_V}| )2(?: 0)?|lgpl ?v?2(?: 0)?)", "lgpl 2 0(?: only)?"),
    ("lgpl-3.0-or-later", "lgpl lgplv3 lesser", f"(?:{_LGPL}(?: {_V}| )3(?: 0)?|lgpl ?v?3(?: 0)?){_LATER}", "lgpl 3 0 or later"),
    ("lgpl-3.0", "lgpl lgplv3 lesser", f"(?:{_LGPL}(?: {_V}| )3(?: 0)?|lgpl ?v?3(?: 0)?)", "lgpl 3 0(?: only)?"),
    ("lgpl", "lgpl lesser library", f"(?:{_LGPL}|lgpl)", "lgpl"),
    ("gpl-1.0", "gpl gplv1 general", f"(?:{_GPL}(?: {_V}| )1(?: 0)?|gpl ?v?1(?: 0)?)", "gpl 1 0(?: only)?"),
    ("gpl-2.0-or-later", "gpl gplv2 general", f"(?:{_GPL}(?: {_V}| )2(?: 0)?|gpl ?v?2(?: 0)?){_LATER}", "gpl 2 0 or later"),
    ("gpl-2.0", "gpl gplv2 general", f"(?:{_GPL}(?: {_V}| )2(?: 0)?|gpl ?v?2(?: 0)?)", "gpl 2 0(?: only)?"),
    ("gpl-3.0-or-later", "gpl gplv3 general", f"(?:{_GPL}(?: {_V}| )3(?: 0)?|gpl ?v?3(?: 0)?){_LATER}", "gpl 3 0 or later"),
    ("gpl-3.0", "gpl gplv3 general", f"(?:{_GPL}(?: {_V}| )3(?: 0)?|gpl ?v?3(?: 0)?)", "gpl 3 0(?: only)?"),
    ("gpl", "gpl general", f"(?:{_GPL}|(?:gnu )gpl|gpl {_L})", "gpl"),
    ("gfdl-1.3", "gfdl documentation", f"(?:gnu free documentation {_L}|gfdl) {_V}1 3", "gfdl 1 3(?: or later| only)?"),
    ("gfdl", "gfdl documentation", f"(?:gnu )?free documentation {_L}", "gfdl 1 [12](?: or later| only)?"),
    ("mpl-1.1", "mozilla mpl", f"(?:mozilla public {_L}|mpl) {_V}1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla mpl mplv2", f"(?:(?:mozilla public {_L}|mpl) {_V}2(?: 0)?|mplv2)", "mpl 2 0"),
    ("mpl", "mozilla", f"mozilla public {_L}", "mpl"),
    ("epl-1.0", "eclipse epl", f"(?:eclipse public {_L}|epl) {_V}1 0", "epl 1 0"),
    ("epl-2.0", "eclipse epl", f"(?:eclipse public {_L}|epl) {_V}2 0", "epl 2 0"),
    ("epl", "eclipse", f"eclipse public {_L}", "epl"),
    ("edl-1.0", "eclipse", f"eclipse distribution {_L}(?: {_V}1 0)?", "edl 1 0"),
    ("cddl-1.0", "cddl development", f"(?:common development and distribution {_L}|cddl)(?: {_V}1 0)?", "cddl 1 0"),
    ("cddl-1.1", "cddl development", f"(?:common development and distribution {_L}|cddl) {_V}1 1", "cddl 1 1"),
    ("cpl-1.0", "common", f"common public {_L}(?: {_V}1 0)?", "cpl 1 0"),
    ("ipl-1.0", "ibm", f"ibm public {_L}(?: {_V}1 0)?", "ipl 1 0"),
    ("eupl-1.2", "eupl european", f"(?:european union public {_L}|eupl)(?: {_V}1 2)", "eupl 1 2"),
    ("eupl-1.1", "eupl european", f"(?:european union public {_L}|eupl)(?: {_V}1 1)", "eupl 1 1"),
    ("eupl", "european", f"european union public {_L}", "eupl"),
    ("artistic-1.0", "artistic", f"artistic {_L} {_V}1 0", "artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic", f"artistic {_L} {_V}2 0", "artistic 2 0"),
    ("artistic", "artistic", f"(?:perl )?artistic {_L}", "artistic"),
    ("bsl-1.0", "boost", f"boost software {_L}(?: {_V}1 0)?", "bsl 1 0"),
    ("busl-1.1", "business", f"business source {_L}(?: {_V}1 1)?", "busl 1 1"),
    ("isc", "isc", f"isc {_L}", "isc"),
    ("zlib", "zlib libpng", f"(?:zlib(?: libpng)?|libpng) {_L}", "zlib"),
    ("unlicense", "unlicense", "(?:the )unlicense", "unlicense"),
    ("wtfpl", "wtfpl want", f"(?:wtfpl|do what the (?:fuck|f) you want to public {_L})", "wtfpl"),
    ("ofl-1.1", "ofl sil font", f"(?:sil )?(?:open font {_L}|ofl {_V}1 1)(?: {_V}1 1)?", "ofl 1 1"),
    ("psf-2.0", "python psf", f"(?:python software foundation|psf) {_L}(?: {_V}2(?: 0)?)?", "(?:psf|python) 2 0"),
    ("php-3.01", "php", f"php {_L}(?: {_V}3 0 ?1)?", "php 3 01"),
    ("postgresql", "postgresql", f"postgresql {_L}", "postgresql"),
    ("ncsa", "ncsa illinois", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa"),
    ("openssl", "openssl", f"openssl {_L}", "openssl"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}", "w3c"),
    ("vim", "vim", f"vim {_L}", "vim"),
    ("ruby", "ruby", f"ruby {_L}", "ruby"),
    ("osl-3.0", "osl open", f"open software {_L}(?: {_V}3 0)?", "osl 3 0"),
    ("afl-3.0", "afl academic", f"academic free {_L}(?: {_V}3 0)?", "afl 3 0"),
    ("ms-pl", "microsoft", f"microsoft public {_L}", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}", "ms rl"),
    ("sspl-1.0", "sspl server", f"server side public {_L}(?: {_V}1(?: 0)?)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", f"elastic {_L}(?: {_V}2 0)?", "elastic 2 0"),
    ("cecill-2.1", "cecill", f"cecill(?: free software)? {_L}(?: {_V}2 1)?", "cecill 2 1"),
    ("mulanpsl-2.0", "mulan", f"mulan permissive software {_L}(?: {_V}2)?", "mulanpsl 2 0"),
    ("upl-1.0", "universal", f"universal permissive {_L}(?: {_V}1 0)?", "upl 1 0"),
    ("odbl-1.0", "odbl database", f"open (?:data commons open )?database {_L}(?: {_V}1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", f"open data commons attribution {_L}(?: {_V}1 0)?", "odc by 1 0"),
    ("pddl-1.0", "dedication", f"public domain dedication and {_L}(?: {_V}1 0)?", "pddl 1 0"),
    ("cc0-1.0", "cc0 zero", "(?:cc0(?: 1 0)?(?: universal)?|(?:creative commons|cc) zero(?: 1 0)?)", "cc0 1 0"),
    *[_cc(terms, _CC_TERMS[terms], version) for terms in sorted(_CC_TERMS, key=len, reverse=True) for version in ("4.0", "3.0", "2.5", "2.0")],
    *[
        (f"cc-{terms}", "cc creative", f"{_CC} (?:{terms.replace('-', ' ')}|{_CC_TERMS[terms]})(?: {_L})?", f"cc {terms.replace('-', ' ')}")
        for terms in sorted(_CC_TERMS, key=len, reverse=True)
    ],
    ("creative-commons", "creative", f"creative commons {_L}", "cc"),
]

#: Label, keywords, words of the notice itself.
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merge", "use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("x11", "permission", "permission to use copy modify distribute and sell this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", "neither the name (?:_ ){1,8}nor the names of (?:its|their|the) contributors"),
    ("bsd-4-clause", "acknowledgement acknowledgment", "must display the following acknowledge?ment this product includes software"),
    ("apache-2.0", "apache", f"licensed under the apache {_L} version 2 0 the {_L}"),
    ("apache-2.0", "compliance", f"you may not use this file except in compliance with the {_L}"),
    ("apache-2.0", "apache", "www apache org licenses license 2 0"),
    ("gpl-2.0-or-later", "redistribute", f"redistribute it and or modify it under the terms of the {_GPL} as published by the free software foundation either version 2"),
    ("gpl-3.0-or-later", "redistribute", f"redistribute it and or modify it under the terms of the {_GPL} as published by the free software foundation either version 3"),
    ("lgpl", "redistribute", f"redistribute it and or modify it under the terms of the {_LGPL}"),
    ("agpl", "redistribute", f"redistribute it and or modify it under the terms of the {_AGPL}"),
    ("gpl", "redistribute", f"redistribute it and or modify it under the terms of the {_GPL}"),
    ("gpl", "gnu", "www gnu org licenses gpl(?: html)?"),
    ("lgpl", "gnu", "www gnu org licenses lgpl(?: html)?"),
    ("agpl", "gnu", "www gnu org licenses agpl(?: html)?"),
    ("gpl", "copy", f"you should have received a copy of the {_GPL}"),
    ("lgpl", "copy", f"you should have received a copy of the {_LGPL}"),
    ("agpl", "copy", f"you should have received a copy of the {_AGPL}"),
    ("mpl-2.0", "mozilla", f"subject to the terms of the mozilla public {_L} v 2 0"),
    ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", "www mozilla org mpl mpl 1 1"),
    ("epl-2.0", "eclipse", f"made available under the terms of the eclipse public {_L} 2 0"),
    ("epl-1.0", "eclipse", f"made available under the terms of the eclipse public {_L} v1 0"),
    ("bsl-1.0", "boost", "www boost org license 1 0 txt"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "origin", "the origin of this software must not be misrepresented you must not claim"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "www wtfpl net"),
    ("public-domain", "domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "(?:is|are) in the public domain"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    *[
        (f"cc-{terms}-{version}", "creativecommons", f"creativecommons org licenses {terms.replace('-', ' ')} {version.replace('.', ' ')}")
        for terms in sorted(_CC_TERMS, key=len, reverse=True)
        for version in ("4.0", "3.0", "2.5", "2.0")
    ],
    ("mit", "opensource", "opensource org licenses? mit(?: license php)?"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("isc", "opensource", "opensource org licenses? isc"),
    ("ofl-1.1", "sil", "scripts sil org ofl"),
    ("ofl-1.1", "font", f"this font software is licensed under the sil open font {_L}"),
    ("proprietary", "proprietary", f"(?:proprietary and confidential|confidential and proprietary)(?: (?:_ ){{0,6}}{_L})"),
    ("proprietary", "unauthorized", "unauthorized copying of this file (?:_ ){0,6}is strictly prohibited"),
]

#: Hints that some license is meant, without its name.
HINTS: list[tuple[str, str, str]] = [
    ("unknown", "licensed", "licensed under(?: (?:the )?(?:terms|conditions) of)?"),
    ("unknown", "license licence", f"see (?:the )?(?:file )?{_L} (?:file )?for (?:details|terms|more information)"),
    ("unknown", "license licence", f"subject to (?:the terms of )?(?:the|a|this) {_L}"),
    ("unknown", "license licence", f"{_L} agreement"),
]

_GRANT = "(?:licensed|released|distributed|available|published|provided|issued|offered|covered) (?:_ ){0,2}(?:under|by|with) "
_TERMS = "(?:the |a |an )?(?:(?:terms|conditions) (?:and conditions )?of (?:the |a )?)?"

RULES: list[Rule] = [
    *[Rule(label, NOTICE, 1.0, tuple(keywords.split()), words) for label, keywords, words in NOTICES],
    *[Rule(label, NOTICE, 1.0, ("spdx",), f"spdx license identifier {spdx}") for label, _, _, spdx in FAMILIES],
    *[Rule(label, NOTICE, 0.95, tuple(keywords.split()), f"{_GRANT}{_TERMS}{name}") for label, keywords, name, _ in FAMILIES],
    *[Rule(label, NAME, 0.8, tuple(keywords.split()), name) for label, keywords, name, _ in FAMILIES],
    *[Rule(label, HINT, 0.4, tuple(keywords.split()), words) for label, keywords, words in HINTS],
]

#: Every match of every rule, and every base phrase, has one of these in its text as it stands, whatever the case.
GATE = (
    r"(?i)licen[cs]e|redistribut|permission|misrepresented|plainly|acknowledg|contributors|commons|domain|unauthorized|wtfpl|gpl|gfdl"
    r"|(?<![0-9a-z])(?:cc0?|mpl|mplv2|epl|cddl|eupl|ofl|asl|apache|bsd|freebsd)(?![0-9a-z])"
)

#: Phrases of the base: words that stand one after the other, and their label.
BASE: list[tuple[str, str]] = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
