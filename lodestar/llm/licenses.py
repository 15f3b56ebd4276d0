r"""License scans by ordered signature rules.

A rule is a regex over the words of a text (A-Z lower-cased, joined by single spaces), a label, a priority and a keyword.
A text is first searched once for all keywords; only the rules of the keywords found are matched. Their matches are
intervals of words. An interval that lies in another one of at least its priority is suppressed: the sweep goes through
the intervals by start, longest first, then by priority and rule order, and keeps for each priority how far the kept
ones reach. Labels of the intervals that remain are reported, and always those of the base phrases.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Everything is DataFrame functions: the rules are one literal array.
Edge cases: a null or empty text has no words, no labels and a score of 0; rows are independent, so repeated rows, null
ids and empty tables need no care; other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Hand-written signatures: keyword, label, priority (3 names a license and version, 2 a license, 1 a hint), regex.
_SIGNATURES = """
apache|apache-2.0|3|(?:licensed under )?(?:the )?apache (?:software )?licen[sc]e(?: v| version)? ?2(?: 0)?
apache|apache-1.1|3|apache (?:software )?licen[sc]e(?: v| version)? ?1 1
apache|apache-1.0|3|apache (?:software )?licen[sc]e(?: v| version)? ?1 0
apache|apache|2|(?:under|the) apache (?:software )?licen[sc]e
apache|apache|1|apache software foundation
mit|mit|3|(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e
mit|mit|2|(?:the )?mit (?:open source )?licen[sc]e
mit|mit|1|mit licensed
permission|mit|3|permission is hereby granted free of charge to any person obtaining a copy
permission|isc|3|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission|hpnd|2|permission to use copy modify and distribute this software and its documentation
permission|permissive-notice|1|permission (?:is|are) (?:hereby )?granted
permission|reserved|1|without (?:prior )?(?:written )?permission(?: of the (?:author|publisher|copyright holder)s?)?
redistribution|bsd|3|redistribution and use in source and binary forms with or without modification are permitted
redistributions|bsd|2|redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
bsd|bsd-2-clause|3|(?:simplified bsd licen[sc]e|(?:2|two) clause bsd(?: licen[sc]e)?|bsd 2 clause)
bsd|bsd-3-clause|3|(?:(?:new|modified|revised) bsd licen[sc]e|(?:3|three) clause bsd(?: licen[sc]e)?|bsd 3 clause)
bsd|bsd-4-clause|3|(?:original bsd licen[sc]e|(?:4|four) clause bsd(?: licen[sc]e)?|bsd 4 clause)
bsd|0bsd|3|(?:zero clause bsd|bsd zero clause|0 clause bsd)
bsd|bsd|2|(?:the )?bsd licen[sc]e
bsd|bsd|1|bsd style
isc|isc|2|(?:the )?isc licen[sc]e
gpl|gpl-3.0-or-later|3|gpl (?:v|version)? ?3(?: 0)? or (?:any )?later
gplv3|gpl-3.0-or-later|3|gplv3(?: 0)? or (?:any )?later
gpl3|gpl-3.0-or-later|3|gpl3(?: 0)? or (?:any )?later
gplversion3|gpl-3.0-or-later|3|gplversion3(?: 0)? or (?:any )?later
gplv|gpl-3.0-or-later|3|gplv 3(?: 0)? or (?:any )?later
gplversion|gpl-3.0-or-later|3|gplversion 3(?: 0)? or (?:any )?later
gpl|gpl-2.0-or-later|3|gpl (?:v|version)? ?2(?: 0)? or (?:any )?later
gplv2|gpl-2.0-or-later|3|gplv2(?: 0)? or (?:any )?later
gpl2|gpl-2.0-or-later|3|gpl2(?: 0)? or (?:any )?later
gplversion2|gpl-2.0-or-later|3|gplversion2(?: 0)? or (?:any )?later
gplv|gpl-2.0-or-later|3|gplv 2(?: 0)? or (?:any )?later
gplversion|gpl-2.0-or-later|3|gplversion 2(?: 0)? or (?:any )?later
gpl|gpl-3.0|3|gnu gpl (?:v|version)? ?3(?: 0)?
gplv3|gpl-3.0|3|gnu gplv3(?: 0)?
gpl3|gpl-3.0|3|gnu gpl3(?: 0)?
gplversion3|gpl-3.0|3|gnu gplversion3(?: 0)?
gplv|gpl-3.0|3|gnu gplv 3(?: 0)?
gplversion|gpl-3.0|3|gnu gplversion 3(?: 0)?
gpl|gpl-2.0|3|gnu gpl (?:v|version)? ?2(?: 0)?
gplv2|gpl-2.0|3|gnu gplv2(?: 0)?
gpl2|gpl-2.0|3|gnu gpl2(?: 0)?
gplversion2|gpl-2.0|3|gnu gplversion2(?: 0)?
gplv|gpl-2.0|3|gnu gplv 2(?: 0)?
gplversion|gpl-2.0|3|gnu gplversion 2(?: 0)?
gpl|gpl|2|gnu gpl
gpl|gpl|1|(?:under|the) gpl
gplv2|gpl-2.0|3|gplv2
gplv3|gpl-3.0|3|gplv3
lgpl|lgpl-2.1|3|lgpl (?:v|version)? ?2 1
lgplv2|lgpl-2.1|3|lgplv2 1
lgpl2|lgpl-2.1|3|lgpl2 1
lgplversion2|lgpl-2.1|3|lgplversion2 1
lgplv|lgpl-2.1|3|lgplv 2 1
lgplversion|lgpl-2.1|3|lgplversion 2 1
lgpl|lgpl-3.0|3|lgpl (?:v|version)? ?3(?: 0)?
lgplv3|lgpl-3.0|3|lgplv3(?: 0)?
lgpl3|lgpl-3.0|3|lgpl3(?: 0)?
lgplversion3|lgpl-3.0|3|lgplversion3(?: 0)?
lgplv|lgpl-3.0|3|lgplv 3(?: 0)?
lgplversion|lgpl-3.0|3|lgplversion 3(?: 0)?
lgpl|lgpl|2|(?:gnu )?lgpl
agpl|agpl-3.0|3|agpl (?:v|version)? ?3(?: 0)?
agplv3|agpl-3.0|3|agplv3(?: 0)?
agpl3|agpl-3.0|3|agpl3(?: 0)?
agplversion3|agpl-3.0|3|agplversion3(?: 0)?
agplv|agpl-3.0|3|agplv 3(?: 0)?
agplversion|agpl-3.0|3|agplversion 3(?: 0)?
agpl|agpl|2|(?:gnu )?agpl
general|gpl-3.0-or-later|3|(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:v|version )3(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?
general|gpl-2.0-or-later|3|(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:v|version )2(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?
general|gpl-3.0|3|(?:gnu )?general public licen[sc]e (?:v|version )3(?: 0)?
general|gpl-2.0|3|(?:gnu )?general public licen[sc]e (?:v|version )2(?: 0)?
general|gpl-1.0|3|(?:gnu )?general public licen[sc]e (?:v|version )1(?: 0)?
general|gpl|2|gnu general public licen[sc]e
lesser|lgpl-2.1|3|(?:gnu )?lesser general public licen[sc]e (?:v|version )2 1
lesser|lgpl-3.0|3|(?:gnu )?lesser general public licen[sc]e (?:v|version )3(?: 0)?
lesser|lgpl|2|(?:gnu )?lesser general public licen[sc]e
library|lgpl-2.0|2|gnu library general public licen[sc]e
affero|agpl-3.0|3|(?:gnu )?affero general public licen[sc]e (?:v|version )3(?: 0)?
affero|agpl|2|(?:gnu )?affero general public licen[sc]e
gnu|gfdl-1.3|3|gnu free documentation licen[sc]e (?:v|version )1 3
gnu|gfdl-1.2|3|gnu free documentation licen[sc]e (?:v|version )1 2
gnu|gfdl|2|gnu free documentation licen[sc]e
gnu|gnu-notice|1|gnu project
free|gpl|2|this program is free software you can redistribute it and or modify it
free|fsf-notice|1|free software foundation
mozilla|mpl-2.0|3|mozilla public licen[sc]e (?:v |version )?2(?: 0)?
mozilla|mpl-1.1|3|mozilla public licen[sc]e (?:v |version )?1 1
mozilla|mpl-1.0|3|mozilla public licen[sc]e (?:v |version )?1 0
mozilla|mpl|2|mozilla public licen[sc]e
mpl|mpl-2.0|3|mpl 2 0
eclipse|epl-2.0|3|eclipse public licen[sc]e (?:v |version )?2(?: 0)?
eclipse|epl-1.0|3|eclipse public licen[sc]e (?:v |version )?1(?: 0)?
eclipse|epl|2|eclipse public licen[sc]e
eclipse|edl-1.0|3|eclipse distribution licen[sc]e
common|cpl-1.0|3|common public licen[sc]e
common|cddl-1.1|3|common development and distribution licen[sc]e (?:v |version )?1 1
common|cddl-1.0|3|common development and distribution licen[sc]e (?:v |version )?1 0
common|cddl|2|common development and distribution licen[sc]e
common|cpal-1.0|3|common public attribution licen[sc]e
cddl|cddl|2|(?:the )?cddl
boost|bsl-1.0|3|boost software licen[sc]e(?: (?:v |version )?1 0)?
artistic|artistic-2.0|3|artistic licen[sc]e (?:v |version )?2(?: 0)?
artistic|artistic-1.0|3|artistic licen[sc]e (?:v |version )?1 0
artistic|artistic|2|artistic licen[sc]e
perl|perl|2|same terms as perl(?: itself)?
python|python-2.0|3|python software foundation licen[sc]e(?: (?:v |version )?2)?
psf|python-2.0|2|psf licen[sc]e
php|php-3.01|3|php licen[sc]e (?:v |version )?3 01
php|php-3.0|3|php licen[sc]e (?:v |version )?3 0
php|php|2|php licen[sc]e
ruby|ruby|2|ruby licen[sc]e
zlib|zlib|2|zlib(?: libpng)? licen[sc]e
altered|zlib|2|altered source versions must be plainly marked as such
libpng|libpng|2|libpng licen[sc]e
openssl|openssl|2|openssl licen[sc]e
openssl|openssl|1|openssl toolkit
ssleay|openssl|2|original ssleay licen[sc]e
unlicense|unlicense|2|(?:the )?unlicense
unencumbered|unlicense|3|free and unencumbered software released into the public domain
wtfpl|wtfpl|2|wtfpl
want|wtfpl|3|do what the f\\S+ you want to public licen[sc]e
beerware|beerware|2|beerware(?: licen[sc]e)?
beer|beerware|2|beer ware licen[sc]e
jam|jam|2|perforce jam licen[sc]e
postgresql|postgresql|2|postgresql licen[sc]e
ms|ms-pl|2|ms pl
ms|ms-rl|2|ms rl
microsoft|ms-pl|3|microsoft public licen[sc]e
microsoft|ms-rl|3|microsoft reciprocal licen[sc]e
microsoft|ms-eula|2|microsoft software licen[sc]e terms
ibm|ibm-1.0|3|ibm public licen[sc]e
intel|intel|2|intel open source licen[sc]e
apple|apsl-2.0|3|apple public source licen[sc]e (?:v |version )?2 0
apple|apsl|2|apple public source licen[sc]e
sun|spl-1.0|3|sun public licen[sc]e
sun|sissl|3|sun industry standards source licen[sc]e
nokia|nokia|2|nokia open source licen[sc]e
netscape|npl-1.1|2|netscape public licen[sc]e
qt|qpl-1.0|2|qt public licen[sc]e
q|qpl-1.0|2|q public licen[sc]e
sleepycat|sleepycat|2|sleepycat licen[sc]e
lucent|lpl-1.02|2|lucent public licen[sc]e
academic|afl-3.0|3|academic free licen[sc]e (?:v |version )?3 0
academic|afl|2|academic free licen[sc]e
educational|ecl-2.0|3|educational community licen[sc]e
open|osl-3.0|3|open software licen[sc]e (?:v |version )?3 0
open|osl|2|open software licen[sc]e
open|ofl-1.1|3|(?:sil )?open font licen[sc]e(?: (?:v |version )?1 1)?
open|odbl-1.0|3|open (?:data commons open )?database licen[sc]e
open|odc-by|3|open data commons attribution licen[sc]e
open|ogl-3.0|3|open government licen[sc]e (?:v|version )3(?: 0)?
open|ogl|2|open government licen[sc]e
open|opl|2|open publication licen[sc]e
open|oasis|1|open source licen[sc]e
sil|ofl-1.1|2|sil ofl
ofl|ofl-1.1|2|ofl 1 1
odbl|odbl-1.0|2|odbl
european|eupl-1.2|3|european union public licen[sc]e (?:v |version )?1 2
european|eupl-1.1|3|european union public licen[sc]e (?:v |version )?1 1
european|eupl|2|european union public licen[sc]e
eupl|eupl|2|eupl
cecill|cecill|2|cecill(?: (?:v |version )?(?:1|2)(?: [01])?)?
cecill|cecill-b|3|cecill b
cecill|cecill-c|3|cecill c
mulan|mulan-psl-2.0|3|mulan psl ?(?:v|version)? ?2
mulan|mulan-psl|2|mulan permissive software licen[sc]e
ncsa|ncsa|2|(?:university of illinois )?ncsa(?: open source)? licen[sc]e
upl|upl-1.0|2|upl 1 0
universal|upl-1.0|3|universal permissive licen[sc]e
blue|blueoak-1.0.0|3|blue oak model licen[sc]e
elastic|elastic-2.0|3|elastic licen[sc]e (?:v |version )?2(?: 0)?
elastic|elastic|2|elastic licen[sc]e
server|sspl-1.0|3|server side public licen[sc]e
sspl|sspl-1.0|2|sspl
business|busl-1.1|3|business source licen[sc]e(?: (?:v |version )?1 1)?
commons|commons-clause|3|commons clause(?: licen[sc]e condition)?
polyform|polyform-nc-1.0.0|3|polyform noncommercial licen[sc]e
polyform|polyform|2|polyform \\S+ licen[sc]e
creative|cc0-1.0|3|creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
creative|cc-by-sa|3|creative commons attribution share ?alike
creative|cc-by-nc-sa|3|creative commons attribution non ?commercial share ?alike
creative|cc-by-nc-nd|3|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
creative|cc-by-nc|3|creative commons attribution non ?commercial
creative|cc-by-nd|3|creative commons attribution no ?deriv(?:ative)?s?(?: works)?
creative|cc-by|2|creative commons attribution
creative|cc|1|creative commons
cc|cc-by-nc-sa|3|cc by nc sa
cc|cc-by-nc-nd|3|cc by nc nd
cc|cc-by-nc|3|cc by nc
cc|cc-by-sa|3|cc by sa
cc|cc-by-nd|3|cc by nd
cc|cc0-1.0|2|cc zero
cc0|cc0-1.0|3|cc0(?: 1 0)?(?: universal)?
public|public-domain|2|(?:in|into|to) the public domain
public|public-domain|1|public domain
pddl|pddl-1.0|2|pddl
spdx|spdx-tag|1|spdx licen[sc]e identifier
copyright|reserved|3|copyright (?:c )?(?:\\S+ ){0,6}all rights reserved
copyright|copyright|1|copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*
copyrighted|copyright|1|copyrighted (?:material|work|by)
rights|reserved|2|(?:no rights granted|all rights are reserved|some rights reserved)
interdite|reserved|2|toute reproduction interdite
vorbehalten|reserved|2|alle rechte vorbehalten
derechos|reserved|2|todos los derechos reservados
droits|reserved|2|tous droits r\\S+s
tous|reserved|1|tous droits
proprietary|proprietary|2|proprietary (?:and confidential|licen[sc]e|software|information)
confidential|proprietary|2|(?:strictly )?confidential and proprietary
unauthorized|proprietary|2|unauthorized (?:copying|use|reproduction|distribution)(?: (?:or|and) \\S+)? (?:of this \\S+ )?is (?:strictly )?prohibited
eula|proprietary|2|end user licen[sc]e agreement eula
end|proprietary|2|end user licen[sc]e agreement
trade|proprietary|1|trade secrets?
shareware|shareware|2|(?:this is )?shareware
freeware|freeware|2|(?:this is )?freeware
evaluation|trial|2|for evaluation (?:purposes )?only
non|non-commercial|2|(?:for )?non commercial (?:use|purposes) only
noncommercial|non-commercial|2|(?:for )?noncommercial (?:use|purposes) only
noncommercial|non-commercial|2|noncommercial (?:use|purposes)
commercial|commercial|1|commercial licen[sc]e
personal|non-commercial|1|(?:for )?personal use only
research|research-only|2|(?:for )?research (?:use|purposes) only
academic|research-only|2|(?:for )?academic (?:use|purposes) only
redistribute|no-redistribution|2|(?:may|must|do) not (?:be )?redistribute
redistributed|no-redistribution|2|(?:may|must|do) not (?:be )?redistributed
royalty|royalty-free|1|royalty free
warranty|as-is|1|without (?:any )?warranty of any kind
warranties|as-is|1|without (?:any )?warranties of any kind
warranties|as-is|1|without warranties or conditions of any kind
llama|llama-2|3|llama 2 community licen[sc]e
llama|llama-3|3|(?:meta )?llama 3(?: \\d)? community licen[sc]e
openrail|openrail|2|(?:bigscience )?openrail(?: m)?
responsible|rail|2|responsible ai licen[sc]e
gemma|gemma|2|gemma terms of use
kaggle|dataset-terms|1|kaggle competition rules
dual|dual|1|dual licen[sc]ed
licensed|named|1|licensed under (?:the )?\\S+
""".strip()

# Families whose versions follow one form: words of the name, label, keyword, versions.
_FAMILIES = [
    ("creative commons attribution", "cc-by", "creative", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution share ?alike", "cc-by-sa", "creative", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("creative commons attribution non ?commercial", "cc-by-nc", "creative", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by", "cc-by", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by sa", "cc-by-sa", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nc", "cc-by-nc", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nc sa", "cc-by-nc-sa", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc by nd", "cc-by-nd", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("open software licen[sc]e", "osl", "open", ("1 0", "1 1", "2 0", "2 1")),
    ("academic free licen[sc]e", "afl", "academic", ("1 1", "1 2", "2 0", "2 1")),
    ("latex project public licen[sc]e", "lppl", "latex", ("1 0", "1 1", "1 2", "1 3")),
    ("zope public licen[sc]e", "zpl", "zope", ("1 1", "2 0", "2 1")),
    ("open ldap public licen[sc]e", "oldap", "ldap", ("2 7", "2 8")),
    ("w3c software notice and licen[sc]e", "w3c", "w3c", ("",)),
    ("vovida software licen[sc]e", "vsl", "vovida", ("1 0",)),
    ("reciprocal public licen[sc]e", "rpl", "reciprocal", ("1 1", "1 5")),
    ("nasa open source agreement", "nasa", "nasa", ("1 3",)),
    ("ricoh source code public licen[sc]e", "rscpl", "ricoh", ("",)),
]
#: Score of the strongest label that remains, by priority.
_SCORES = {1: 0.5, 2: 0.8, 3: 1.0}


def rules() -> list[dict]:
    """All rules in order: place, keyword, label, priority, regex."""
    rows = [line.split("|", 3) for line in _SIGNATURES.splitlines()]
    for name, label, keyword, versions in _FAMILIES:
        for v in versions:
            rows.append([keyword, f"{label}-{v.replace(' ', '.')}" if v else label, "3", f"{name}(?: licen[sc]e)?(?: v| version)?(?: international| unported)? {v}" if v else name])
    for phrase, label in BASE.items():
        rows.append([phrase.split()[0], label, "2", phrase])
    return [{"at": i, "keyword": k, "label": label, "priority": int(p), "regex": f"(?<= )(?:{r.replace(chr(92) * 2, chr(92))})(?= )"} for i, (k, label, p, r) in enumerate(rows)]


_FROM, _TO = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), T._parse_datatype_string(schema))


def _places(text: Column, regex: Column) -> Column:
    """(start, end) in words of all matches of regex in text, whose words stand between single spaces. Matches are marked
    with signs that no word holds, and the marked words counted once, so time grows with the text alone."""
    marked = F.regexp_replace(text, regex, F.lit(f"{_FROM}$0{_TO}"))
    at = lambda m, found, less: F.array_compact(F.transform(F.split(m, " "), lambda w, i: F.when(found(w), i - less)))
    pairs = lambda m: F.zip_with(at(m, lambda w: F.startswith(w, F.lit(_FROM)), 1), at(m, lambda w: F.endswith(w, F.lit(_TO)), 0), lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.get(F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit(_FROM)), pairs(m)).otherwise(none)), F.lit(0))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text)."""
    table = rules()
    rule_type = "array<struct<at:int,keyword:string,label:string,priority:int,regex:string>>"
    keywords = "(?<= )(?:" + "|".join(sorted({r["keyword"] for r in table}, key=lambda k: (-len(k), k))) + ")(?= )"
    bases = "(?<= )(?:" + "|".join(BASE) + ")(?= )"

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER).alias("low"))
    rows = rows.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", _SPLIT, " ")), F.lit(" ")).alias("norm"))
    n_words = F.when(F.col("norm") == "  ", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1)
    rows = rows.withColumn("n_words", n_words.cast("long")).withColumn("keywords", F.array_distinct(F.regexp_extract_all("norm", F.lit(keywords), F.lit(0))))
    # The regexes see a text only where one of their keywords stands in it.
    rows = rows.select("doc_id", "n_words", "keywords", F.when(F.size("keywords") > 0, F.col("norm")).alias("norm"))
    places = _places(F.col("norm"), F.lit(bases))
    found = F.regexp_extract_all("norm", F.lit(bases), F.lit(0))
    gated = F.filter(_literal(table, rule_type), lambda r: F.array_contains(F.col("keywords"), r["keyword"]))
    spans = F.flatten(F.transform(gated, lambda r: F.transform(_places(F.col("norm"), r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["at"].alias("at"), r["label"].alias("label")))))
    zero = F.expr("named_struct('p1', -1, 'p2', -1, 'p3', -1, 'best', 0, 'labels', cast(array() as array<string>))")

    def sweep(a: Column, x: Column) -> Column:
        end, priority = -x["minus_end"], -x["minus_priority"]
        reach = F.greatest(F.when(priority <= 1, a["p1"]).otherwise(-1), F.when(priority <= 2, a["p2"]).otherwise(-1), a["p3"])
        kept = reach < end
        far = lambda p: F.when(kept & (priority == p), F.greatest(a[f"p{p}"], end)).otherwise(a[f"p{p}"]).alias(f"p{p}")
        return F.struct(far(1), far(2), far(3), F.when(kept, F.greatest(a["best"], priority)).otherwise(a["best"]).alias("best"), F.when(kept, F.array_union(a["labels"], F.array(x["label"]))).otherwise(a["labels"]).alias("labels"))

    rows = rows.withColumn("places", F.when(F.col("norm").isNotNull(), places)).withColumn("base", F.when(F.col("norm").isNotNull(), F.array_distinct(F.transform(found, lambda p: F.element_at(_literal(BASE, "map<string,string>"), p)))))
    rows = rows.withColumn("kept", F.when(F.col("norm").isNotNull(), F.aggregate(F.array_sort(spans), zero, sweep)))
    score = F.lit(0.0)
    for p, s in _SCORES.items():
        score = F.when(F.col("kept.best") == p, F.lit(s)).otherwise(score)
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["start"].cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base", none), F.coalesce("kept.labels", none))), ",").alias("labels"),
        score.alias("score"),
    )
