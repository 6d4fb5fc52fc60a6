"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: comment signs at line starts go, wrapped lines are joined, and a sentence ends at
. ! ? before white space, at an empty line and around an SPDX line. Each sentence is normalised (lower case, runs of
other signs as one space), loses the clauses that deny a licence, and is mapped to the identifiers of the known
sentences in it. The identifiers in text order form a sequence. Ordered licence rules are matched against it: a rule
names its licence and uses up its identifiers, then the next rules look at what is left. Licences have SPDX names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and what a normalised sentence must contain.
SENTENCES = (
    ("Copyright", r"\bcopyright( c)? [0-9]{4}\b"),
    ("AllRights", r"\ball rights reserved\b"),
    ("Secret", r"\bproprietary and confidential\b|\bunauthorized copying of this file\b"),
    ("MITtitle", r"^(the )?mit license( mit)?( copyright|$)"),
    ("MITref", r"\b(under|by|of) (the )?(terms of )?(the )?(mit|expat|x11) license\b"),
    ("MITperm", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("MITnotice", r"\babove copyright notice and this permission notice shall be included in all copies\b"),
    ("MITasis", r"\bthe software is provided as is without warranty of any kind\b"),
    ("MITliab", r"\bin no event shall the authors or copyright holders be liable for any claim\b"),
    ("BSDcond", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("BSDsource", r"\bredistributions of source code must retain the above copyright notice\b"),
    ("BSDbinary", r"\bredistributions in binary form must reproduce the above copyright notice\b"),
    ("BSDadvert", r"\ball advertising materials mentioning features or use of this software must display\b"),
    ("BSDendorse", r"\bnames? of .*may (not )?be used to endorse or promote products\b"),
    ("BSDasis", r"\bthis software is provided by .*as is and any express or implied warranties\b"),
    ("BSDliab", r"\bin no event shall .*be liable for any direct indirect incidental\b"),
    ("BSD4ref", r"\b(original|4 clause|four clause) bsd license\b|\bbsd 4 clause\b"),
    ("BSD3ref", r"\b(new|revised|modified|3 clause|three clause) bsd license\b|\bbsd 3 clause\b"),
    ("BSD2ref", r"\b(simplified|2 clause|two clause) bsd license\b|\bbsd 2 clause\b|\bfreebsd license\b"),
    ("ISCperm", r"\bpermission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that\b"),
    ("ZeroPerm", r"\bpermission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted$"),
    ("ISCasis", r"\bthe software is provided as is and the author disclaims all warranties\b"),
    ("ISCref", r"\bisc license\b"),
    ("ZlibPerm", r"\bpermission is granted to anyone to use this software for any purpose including commercial applications\b"),
    ("ZlibRef", r"\bzlib license\b"),
    ("ApacheComply", r"\bmay not use this file except in compliance with the license\b"),
    ("ApacheBasis", r"\bunless required by applicable law or agreed to in writing software distributed under the license\b"),
    ("Apache-2.0", r"\bapache 2 0 license\b|\bunder (the )?apache 2 0\b"),
    ("NoWarranty", r"\bwithout any warranty without even the implied warranty of merchantability\b"),
    ("Boost", r"\bboost software license\b"),
    ("Public", r"\bfree and unencumbered software released into the public domain\b|\bunder the unlicense\b"),
    ("CC0", r"\bcc0\b|\bcreative commons zero\b|\bpublic domain dedication\b"),
    ("WTFPL", r"\bdo what the [a-z]+ you want to public license\b|\bwtfpl\b"),
)

#: Families whose sentences name a version, and their names.
FAMILIES = (
    ("AGPL", r"(?:gnu )?affero general public license|(?:gnu )?agpl"),
    ("LGPL", r"gnu (?:lesser|library) general public license|(?:gnu )?lgpl"),
    ("GPL", r"gnu general public license|(?:gnu )?gpl"),
    ("Apache", r"apache(?: software)? license|apache org licenses license"),
    ("MPL", r"mozilla public license|mpl"),
    ("EPL", r"eclipse public license|epl"),
)
#: Families whose licences differ by whether later versions may be taken.
LATER = ("AGPL", "LGPL", "GPL")
_BY_FSF = " as published by the free software foundation"
_VERSION = (
    rf"(?:(?:{_BY_FSF})?(?: either)?(?: version)? ?v? ?[0-9](?: [0-9])?\b(?: of the license|{_BY_FSF})*"
    r"(?: or at your option any later version| or any later version| or later|\+)?)?"
)
_CC = (
    r"\b(?:creative commons attribution|cc by)(?: non ?commercial| nc)?"
    r"(?: share ?alike| sa| no ?derivs| no ?derivatives| nd)?(?: [0-9] [0-9])?\b"
)
#: A clause that denies a licence, up to what is put in its place.
DENIED = (
    r"\b(?:not|never|no longer|isn t|aren t)(?: [a-z]+)? (?:licensed|released|distributed|available|offered|published|covered|provided)"
    r" (?:under|by|with)\b.*?(?: but |$)"
)

_OWN = "(?:<Copyright>)*(?:<AllRights>)?(?:<Copyright>)*"
_LIST = "<BSDcond>(?:<BSDsource>)?(?:<BSDbinary>)?"
_BSD_END = "(?:<BSDasis>)?(?:<BSDliab>)?"
#: Fixed values, in order: licence and the pattern over the sequence, in which every identifier stands in angle brackets.
RULES = (
    ("BSD-4-Clause", f"{_OWN}{_LIST}<BSDadvert>(?:<BSDendorse>)?{_BSD_END}|<BSD4ref>"),
    ("BSD-3-Clause", f"{_OWN}{_LIST}<BSDendorse>{_BSD_END}|<BSD3ref>"),
    ("BSD-2-Clause", f"{_OWN}{_LIST}{_BSD_END}|<BSD2ref>"),
    ("MIT", f"(?:<MITtitle>)?{_OWN}<MITperm>(?:<MITnotice>)?(?:<MITasis>)?(?:<MITliab>)?|<MITref>|<MITtitle>"),
    ("ISC", f"(?:<ISCref>)?{_OWN}<ISCperm>(?:<ISCasis>)?|<ISCref>"),
    ("0BSD", f"{_OWN}<ZeroPerm>(?:<ISCasis>)?"),
    ("Zlib", f"(?:<ZlibRef>)?{_OWN}<ZlibPerm>|<ZlibRef>"),
    ("BSL-1.0", f"{_OWN}<Boost>"),
    ("Unlicense", "<Public>"),
    ("CC0-1.0", "<CC0>"),
    ("WTFPL", f"{_OWN}<WTFPL>"),
)
#: A sentence can only be known if it holds one of these.
HINTS = r"licen|copyright|reserved|gpl|mpl|epl|commons|cc0|cc[^a-z0-9]+by|redistribut|advertis|endorse|permission|warrant|liable|unencumbered|public|confidential|unauthorized|apache|bsd|wtfpl"


def sentences(text: Column) -> Column:
    """The text's sentences in their own letters; an SPDX line is a sentence of its own."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, r"""(?md)^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--|\"\"\"|''')[ \t]*""", "")
    out = F.regexp_replace(out, r"(?i)(SPDX-License-Identifier:[^\n]*)", "\n\n$1\n\n")
    out = F.regexp_replace(out, r"(?i)\bv(?:ers?)?\. ?([0-9])", "version $1")
    return F.split(F.regexp_replace(out, r"[.!?](?:\s|$)", "\n\n"), r"\n[ \t]*\n")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9+]+", " ")), DENIED, " "))


def _versioned(sentence: Column, family: str, names: str) -> Column:
    """Identifiers of a family's mentions: with version, or the family alone."""

    def name(found: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(found, "[0-9](?: [0-9])?", 0), " ", ".")
        full = F.concat(F.lit(f"{family}-"), number, F.when(F.length(number) == 1, ".0").otherwise(""))
        if family in LATER:
            full = F.concat(full, F.when(found.rlike(r"(?:later version|later|\+)$"), "-or-later").otherwise("-only"))
        return F.when(number == "", family).otherwise(full)

    return F.transform(F.regexp_extract_all(sentence, F.lit(rf"\b(?:{names})\b{_VERSION}|\b(?:{names})(?=v?[0-9]){_VERSION}"), F.lit(0)), name)


def _creative_commons(sentence: Column) -> Column:
    def name(found: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(found, "[0-9] [0-9]", 0), " ", ".")
        return F.concat(
            F.lit("CC-BY"),
            F.when(found.rlike(" non ?commercial| nc"), "-NC").otherwise(""),
            F.when(found.rlike(" share ?alike| sa"), "-SA").otherwise(""),
            F.when(found.rlike(" no ?deriv| nd"), "-ND").otherwise(""),
            F.when(number == "", "").otherwise(F.concat(F.lit("-"), number)),
        )

    return F.transform(F.regexp_extract_all(sentence, F.lit(_CC), F.lit(0)), name)


def _spdx(sentence: Column) -> Column:
    """The licences of an SPDX expression; operators, brackets and exceptions are left out."""
    told = F.regexp_extract(sentence, r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*)", 1)
    words = F.split(F.regexp_replace(told, r"(?i)\bwith[ \t]+[^ \t()]+", " "), r"[() \t]+")
    words = F.filter(words, lambda w: w.rlike("^[A-Za-z0-9][A-Za-z0-9.+-]*$") & ~F.lower(w).isin("or", "and"))
    return F.transform(words, lambda w: F.concat(F.lit("SPDX="), w))


def sentence_ids(sentence: Column) -> Column:
    """All identifiers of one sentence, in the tables' order."""

    def of(s: Column) -> Column:
        fixed = F.array_compact(F.array(*[F.when(s.rlike(p), F.lit(k)) for k, p in SENTENCES]))
        return F.concat(fixed, *[_versioned(s, f, n) for f, n in FAMILIES], _creative_commons(s))

    each = F.flatten(F.transform(F.array(normalised(sentence)), of))
    return F.when(sentence.rlike(r"(?i)SPDX-License-Identifier:"), _spdx(sentence)).otherwise(each)


def identified(text: Column) -> Column:
    """The identifiers of a text in order."""
    known = F.filter(sentences(text), lambda s: F.lower(s).rlike(HINTS))
    ids = F.flatten(F.transform(known, sentence_ids))
    return F.when(F.lower(text).rlike(HINTS), ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses) for each row of ``docs`` (doc_id, text).

    ``sentence_ids``: identifiers in text order, joined by commas; ``licenses``: licences that
    sentences or SPDX lines name with or without a version, in text order, then those of the ordered rules, then ``Proprietary`` for rights that no rule used up; each
    once, joined by commas. A family without a version counts only where no sentence names its version. Null and empty texts
    have none; repeated rows each get a row; no rows give none; other columns are not read.
    """
    out = docs.select("doc_id", identified(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))
    out = out.withColumn("rest", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    for k, (_, rule) in enumerate(RULES):
        out = out.withColumn(f"r{k}", F.col("rest").rlike(rule)).withColumn("rest", F.regexp_replace("rest", rule, ""))
    by_rule = F.array_compact(F.array(*[F.when(F.col(f"r{k}"), F.lit(name)) for k, (name, _) in enumerate(RULES)]))
    bare = [f for f, _ in FAMILIES]
    left = F.filter(
        F.split(F.regexp_replace("rest", "^<|>$", ""), "><"),
        lambda i: i.rlike(rf"^(?:{'|'.join(bare)})-|^CC-BY|^SPDX=")
        | (i.isin(*bare) & ~reduce(lambda a, b: a | b, [(i == f) & F.col("rest").contains(f"<{f}-") for f in bare])),
    )
    named = F.transform(left, lambda i: F.regexp_replace(i, "^SPDX=", ""))
    rights = F.when(F.col("rest").rlike("<(?:AllRights|Secret)>"), F.array(F.lit("Proprietary"))).otherwise(F.array().cast("array<string>"))
    out = out.select("doc_id", "ids", F.array_distinct(F.concat(named, by_rule, rights)).alias("found"))
    return out.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"),
        F.size("found").cast("bigint").alias("n_licenses"),
    )
