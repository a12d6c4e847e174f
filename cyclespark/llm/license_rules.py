"""Signature rules for licences: name, address and text patterns over lower-cased bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Label, gate words (each match of the name pattern holds all of them), name pattern, short identifier pattern, address pattern ('' for none).
LICENCES = [
    ("apache-1.1", "apache licen", r"apache(?:\s+software)?\s+licen[cs]e,?\s+(?:version\s+|v)?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache licen", r"apache(?:\s+software)?\s+licen[cs]e(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit licen", r"\bmit(?:/x11)?\s+licen[cs]e", r"\bmit", r"opensource\.org/licenses?/mit"),
    ("isc", "isc licen", r"\bisc\s+licen[cs]e", r"\bisc", r"opensource\.org/licenses?/isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd)\s+bsd(?:\s+licen[cs]e)?|bsd\s+2-clause", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause)\s+bsd(?:\s+licen[cs]e)?|bsd\s+3-clause", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd", "bsd licen", r"\bbsd(?:-style)?\s+licen[cs]e", r"\bbsd", r"opensource\.org/licenses?/bsd-license"),
    ("0bsd", "bsd", r"(?:zero-clause|0-clause)\s+bsd", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    ("gpl-1.0", "general public licen", r"(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:as\s+published\s+by[^.]{0,60}?)?(?:version\s+|v)1", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public licen", r"(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:as\s+published\s+by[^.]{0,60}?)?(?:version\s+|v)2", r"(?<!l)(?<!a)gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public licen", r"(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s+(?:as\s+published\s+by[^.]{0,60}?)?(?:version\s+|v)3", r"(?<!l)(?<!a)gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gnu", r"gnu\s+general\s+public\s+licen[cs]e|gnu\s+gpl", r"\bgpl", r"gnu\.org/licenses/gpl\b"),
    ("lgpl-2.1", "lesser licen", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s+(?:version\s+|v)2(?:\.1)?", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser licen", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s+(?:version\s+|v)3", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "general public licen", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[cs]e", r"\blgpl", r"gnu\.org/licenses/lgpl\b"),
    ("agpl-3.0", "affero licen", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e(?:,?\s+(?:version\s+|v)3)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "documentation licen", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e", r"gfdl-1\.[123]", r"gnu\.org/licenses/(?:fdl|gfdl)"),
    ("mpl-1.1", "mozilla licen", r"mozilla\s+public\s+licen[cs]e,?\s+(?:version\s+|v)?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1|mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2.0", "mozilla licen", r"mozilla\s+public\s+licen[cs]e(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0|mozilla\.org/en-us/mpl"),
    ("epl-1.0", "eclipse licen", r"eclipse\s+public\s+licen[cs]e,?\s+(?:-\s+)?(?:version\s+|v)?\s?1", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse licen", r"eclipse\s+public\s+licen[cs]e(?:,?\s+(?:-\s+)?(?:version\s+|v)?\s?2)?", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("cddl-1.0", "distribution licen", r"common\s+development\s+and\s+distribution\s+licen[cs]e", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "common public licen", r"common\s+public\s+licen[cs]e", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    ("artistic-2.0", "artistic licen", r"artistic\s+licen[cs]e(?:,?\s+(?:version\s+|v)?2(?:\.0)?)?", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    ("zlib", "zlib licen", r"\bzlib(?:/libpng)?\s+licen[cs]e", r"\bzlib", r"opensource\.org/licenses?/zlib"),
    ("bsl-1.0", "boost licen", r"boost\s+software\s+licen[cs]e", r"bsl-1\.0", r"boost\.org/license"),
    ("unlicense", "unlicense", r"\bthe\s+unlicense\b", r"\bunlicense", r"unlicense\.org"),
    ("wtfpl", "what want public licen", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e", r"\bwtfpl", r"wtfpl\.net"),
    ("postgresql", "postgresql licen", r"postgresql\s+licen[cs]e", r"\bpostgresql", r"opensource\.org/licenses?/postgresql"),
    ("python-2.0", "licen", r"(?:python\s+software\s+foundation|psf)\s+licen[cs]e", r"python-2\.0|psf-2\.0", r"docs\.python\.org/[\w./]*license"),
    ("php-3.0", "php licen", r"\bphp\s+licen[cs]e", r"php-3\.0[01]?", r"php\.net/license"),
    ("ruby", "ruby licen", r"\bruby\s+licen[cs]e", r"\bruby", r"ruby-lang\.org/[\w./]*license"),
    ("openssl", "openssl licen", r"\bopenssl\s+licen[cs]e", r"\bopenssl", r"openssl\.org/source/license"),
    ("ofl-1.1", "open font licen", r"(?:sil\s+)?open\s+font\s+licen[cs]e", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("eupl-1.2", "european union licen", r"european\s+union\s+public\s+licen[cs]e", r"eupl-1\.[12]", r"joinup\.ec\.europa\.eu/[\w/-]*eupl"),
    ("ms-pl", "microsoft licen", r"microsoft\s+public\s+licen[cs]e", r"\bms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft licen", r"microsoft\s+reciprocal\s+licen[cs]e", r"\bms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("afl-3.0", "academic licen", r"academic\s+free\s+licen[cs]e", r"afl-[123]\.[0-2]", r"opensource\.org/licenses?/afl"),
    ("osl-3.0", "open software licen", r"open\s+software\s+licen[cs]e", r"osl-[123]\.[0-1]", r"opensource\.org/licenses?/osl"),
    ("ncsa", "ncsa licen", r"\bncsa\s+(?:open\s+source\s+)?licen[cs]e", r"\bncsa", r"opensource\.org/licenses?/ncsa"),
    ("odbl", "open database licen", r"open\s+(?:database|data\s+commons\s+open\s+database)\s+licen[cs]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("cc0-1.0", "cc0", r"\bcc0(?:\s+1\.0)?(?:\s+universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-sa", "sharealike", r"(?:creative\s+commons\s+)?attribution[- ]sharealike(?:\s+\d\.\d)?", r"cc-by-sa(?:-\d\.\d)?", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", "noncommercial", r"(?:creative\s+commons\s+)?attribution[- ]noncommercial(?:\s+\d\.\d)?", r"cc-by-nc(?:-\d\.\d)?", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "attribution deriv", r"(?:creative\s+commons\s+)?attribution[- ]no-?derivs?(?:atives)?(?:\s+\d\.\d)?", r"cc-by-nd(?:-\d\.\d)?", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", "noncommercial", r"attribution[- ]noncommercial[- ]sharealike(?:\s+\d\.\d)?", r"cc-by-nc-sa(?:-\d\.\d)?", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "noncommercial", r"attribution[- ]noncommercial[- ]no-?deriv\w*(?:\s+\d\.\d)?", r"cc-by-nc-nd(?:-\d\.\d)?", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by", "creative commons", r"creative\s+commons(?:,)?\s+attribution(?:\s+\d\.\d)?", r"cc-by(?:-\d\.\d)?(?!-)", r"creativecommons\.org/licenses/by/"),
]

#: Label, gate words (each match holds all of them), wording of a licence's own text or of a notice.
WORDINGS = [
    ("mit", "hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person"),
    ("isc", "permission to use", r"permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and/or\s+distribute\s+this\s+software"),
    ("bsd", "source and binary", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("bsd-3-clause", "endorse or promote", r"may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products"),
    ("gpl", "free software", r"this\s+(?:program|file|library)\s+is\s+free\s+software[:;,]"),
    ("gpl", "copyleft", r"\bstrong\s+copyleft\b"),
    ("apache-2.0", "governing permissions", r"see\s+the\s+licen[cs]e\s+for\s+the\s+specific\s+language\s+governing\s+permissions"),
    ("mpl-2.0", "source code form", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms"),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software"),
    ("zlib", "as-is", r"provided\s+['\"]as-is['\"],?\s+without\s+any\s+express"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|donated)\s+(?:in)?to\s+the\s+public\s+domain|\bis\s+in\s+the\s+public\s+domain"),
    ("warranty-disclaimer", "warranty", r"provided\s+[\"'`]*as\s+is[\"'`]*,?\s+without\s+warranty"),
    ("warranty-disclaimer", "warranty", r"without\s+(?:even\s+the\s+implied\s+)?warranty\s+of\s+(?:any\s+kind|merchantability)"),
    ("copyright", "copyright", r"\bcopyright\s+(?:\(c\)|\xc2\xa9)?\s*(?:19|20)\d\d"),
    ("copyright", "(c)", r"\(c\)\s+(?:19|20)\d\d\s+\w+"),
    ("proprietary", "proprietary", r"(?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)"),
    ("proprietary", "unauthori", r"unauthori[sz]ed\s+(?:copying|use|reproduction|distribution)"),
    ("proprietary", "may not be", r"may\s+not\s+be\s+(?:copied|reproduced|redistributed)\s+without"),
]

#: Fixed values of the phrases that every scan counts: words, label.
PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]

_GRANT = r"\b(?:licen[cs]ed|released|distributed|available|published|provided|redistribut\w+|made\s+available)\b[^.\n]{{0,60}}?\b(?:under|by)\b[^.\n]{{0,40}}?(?:{0})"
#: How a rule is built from a licence: kind, template, gate words besides the licence's own, what the template takes, weight.
_FORMS = [
    ("tag", r"spdx-license-identifier:?\s*(?:\(?[\w.+-]+\s+(?:or|and)\s+)?(?:{0})(?![\w.-])", ("spdx",), 3, 0.99),
    ("address", r"(?:https?://)?(?:www\.)?(?:{0})", (), 4, 0.95),
    ("grant", _GRANT, (), 2, 0.95),
    ("field", r"\blicen[cs]e\s*[:=]\s*[\"']?(?:{0})", ("licen",), 3, 0.9),
    ("version", r"(?:{0})(?:,?\s+(?:version|v\.?)\s*\d(?:\.\d)?)?(?:\s+or\s+(?:any\s+)?later(?:\s+version)?)", ("later",), 2, 0.9),
    ("name", r"(?:{0})", (), 2, 0.8),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    kind: str
    gates: tuple[bytes, ...]
    pattern: re.Pattern
    weight: float


def rules() -> list[Rule]:
    """All rules in order of priority (0 first): tags, addresses, grants, fields, versions, texts, names."""
    made = []
    for priority, (kind, form, more, field, weight) in enumerate(_FORMS):
        for row in LICENCES:
            own = () if kind in ("tag", "address", "field") else row[1].split()
            gates = tuple(g.encode() for g in (*more, *own)) or (row[4].split("/")[0].split("\\")[0].split(".")[0].encode(),)
            pattern = re.compile(form.format(row[field]).encode())
            made.append(Rule(priority * 2, row[0], kind, gates, pattern, weight))
    made += [Rule(9, label, "text", tuple(gate.encode().split()), re.compile(p.encode("latin-1")), 0.85) for label, gate, p in WORDINGS]
    return sorted(made, key=lambda r: r.priority)
