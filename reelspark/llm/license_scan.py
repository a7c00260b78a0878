"""Licence scan by sentence rules.

Wrapped lines of a paragraph are joined, the text is cut into sentences (line
ends that are left, and white space after . ! or ?), and a sentence is
normalised (lower case, everything but letters, digits and dots becomes one
space, dots at its ends go). Sentences that speak of licensing are mapped to
the identifier of the first sentence rule that matches them, or to UNKNOWN. A
document's identifiers in order form a sequence, against which the licence
rules are matched in order: a rule whose run of identifiers occurs names its
licence and uses the run up, so that specific rules, listed first, hide the
general ones. Identifiers that many licence texts hold (NEUTRAL: unknown
sentences, copyright lines, notices about other paragraphs) stand between those
of a run without breaking it.

Only DataFrame functions, evaluated row by row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import prepare

#: A sentence that matches no rule is UNKNOWN if its normal form matches this, and nothing otherwise.
TOPIC = r"licen[cs]e|copyright|all rights reserved|permission|warrant|redistribut|spdx|public domain"

#: Fixed values: (identifier, pattern on the normalised sentence), first match counts.
SENTENCES = (
    ("SpdxMit", r"spdx license identifier mit\b"),
    ("SpdxApache2", r"spdx license identifier apache 2\.0"),
    ("SpdxBsd2", r"spdx license identifier bsd 2 clause"),
    ("SpdxBsd3", r"spdx license identifier bsd 3 clause"),
    ("SpdxIsc", r"spdx license identifier isc\b"),
    ("SpdxMpl2", r"spdx license identifier mpl 2\.0"),
    ("SpdxGpl2Later", r"spdx license identifier gpl 2\.0(?: or later|\+)"),
    ("SpdxGpl2", r"spdx license identifier gpl 2\.0"),
    ("SpdxGpl3Later", r"spdx license identifier gpl 3\.0(?: or later|\+)"),
    ("SpdxGpl3", r"spdx license identifier gpl 3\.0"),
    ("SPDX", r"spdx license identifier"),
    ("Agpl3Later", r"gnu affero general public license as published by the free software foundation either version 3"),
    ("Lgpl3Later", r"gnu (?:lesser|library) general public license as published by the free software foundation either version 3"),
    ("Lgpl21Later", r"gnu (?:lesser|library) general public license as published by the free software foundation either version 2\.1"),
    ("Gpl3Later", r"gnu general public license as published by the free software foundation either version 3"),
    ("Gpl2Later", r"gnu general public license as published by the free software foundation either version 2"),
    ("Gpl3Only", r"gnu general public license as published by the free software foundation version 3"),
    ("Gpl2Only", r"gnu general public license as published by the free software foundation version 2"),
    ("Agpl3", r"gnu affero general public license v?(?:ersion )?3"),
    ("Lgpl3", r"gnu (?:lesser|library) general public license v?(?:ersion )?3"),
    ("Lgpl21", r"gnu (?:lesser|library) general public license v?(?:ersion )?2\.1"),
    ("Gpl3", r"gnu general public license v?(?:ersion )?3"),
    ("Gpl2", r"gnu general public license v?(?:ersion )?2"),
    ("GplWarranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplDetails", r"\bsee the gnu (?:affero |lesser |library )?general public license for more details"),
    ("GplReceived", r"you should have received a copy of the gnu"),
    ("AgplAny", r"gnu affero general public license"),
    ("LgplAny", r"gnu (?:lesser|library) general public license"),
    ("GplAny", r"gnu general public license"),
    ("GplOption", r"\beither version [0-9.]+ of the license or at your option any later version"),
    ("Gpl3Date", r"^version 3 (?:29 june|19 november) 2007"),
    ("Gpl2Date", r"^version 2 june 1991"),
    ("Lgpl21Date", r"^version 2\.1 february 1999"),
    ("Apache2", r"apache license v?(?:ersion )?2\.0"),
    ("ApacheTerms", r"^apache license$"),
    ("ApacheDate", r"^version 2\.0 january 2004"),
    ("ApacheCopy", r"\byou may obtain a copy of the license at"),
    ("ApacheExcept", r"\byou may not use this file except in compliance with the license"),
    ("ApacheBasis", r"distributed under the license is distributed on an as is basis"),
    ("Mpl2", r"mozilla public license v?(?: ?version )? ?2\.0"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file"),
    ("MitName", r"\bmit license\b"),
    ("MitGrant", r"\bpermission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"copyright notice and this permission notice shall be included"),
    ("IscGrant", r"\bpermission to use copy modify and or distribute this software for any purpose"),
    ("AsIs", r"\b(?:the|this) software is provided .*as is.*warrant"),
    ("BsdName", r"\bbsd (?:[234] clause )?license\b"),
    ("BsdPre", r"\bredistribution and use in source and binary forms"),
    ("BsdSource", r"\bredistributions of source code must retain"),
    ("BsdBinary", r"\bredistributions in binary form must reproduce"),
    ("BsdEndorse", r"may be used to endorse or promote products"),
    ("CcByNcSa", r"\bcc by nc sa\b|attribution non ?commercial share ?alike"),
    ("CcByNcNd", r"\bcc by nc nd\b|attribution non ?commercial no ?deriv"),
    ("CcByNc", r"\bcc by nc\b|attribution non ?commercial"),
    ("CcBySa", r"\bcc by sa\b|attribution share ?alike"),
    ("CcByNd", r"\bcc by nd\b|attribution no ?deriv"),
    ("CcBy", r"\bcc by\b|creative commons attribution"),
    ("Cc0", r"\bcc0\b"),
    ("PublicDomain", r"public domain"),
    ("AllRights", r"\ball rights reserved\b"),
    ("Copyright", r"^copyright"),
)
UNKNOWN = "UNKNOWN"
NEUTRAL = (UNKNOWN, "Copyright", "AllRights", "GplWarranty", "GplDetails", "GplReceived")

#: What a sentence must hold to be looked at: every rule's pattern holds one of these, and so does TOPIC.
HINT = (r"licen[cs]|copyright|reserved|permission|warrant|redistribut|spdx|public domain|endorse or promote|copy of the (?:mpl|gnu)|see the gnu"
        r"|\bcc0\b|\bcc by\b|creative commons|attribution|^version [23]")
#: The same, or more, on a whole text in lower case, whose words may stand apart by anything.
RELATED = HINT.replace("^", "").replace(r"\b", "").replace(" ", "[^a-z0-9.]+")

#: Fixed values: (licence, run of sentence identifiers), in order of use.
LICENCES = (
    ("Apache-2.0", ("Apache2", "ApacheExcept", "ApacheCopy", "ApacheBasis")),
    ("Apache-2.0", ("ApacheTerms", "ApacheDate")),
    ("Apache-2.0", ("Apache2",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("MIT", ("MitName", "MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitGrant", "AsIs")),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitName",)),
    ("MIT", ("SpdxMit",)),
    ("ISC", ("IscGrant", "AsIs")),
    ("ISC", ("IscGrant",)),
    ("ISC", ("SpdxIsc",)),
    ("BSD-3-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("BSD-2-Clause", ("BsdPre", "BsdSource", "BsdBinary")),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("BSD", ("BsdName",)),
    ("AGPL-3.0-or-later", ("Agpl3Later",)),
    ("AGPL-3.0", ("AgplAny", "Gpl3Date")),
    ("AGPL-3.0", ("Agpl3",)),
    ("LGPL-3.0-or-later", ("Lgpl3Later",)),
    ("LGPL-3.0", ("LgplAny", "Gpl3Date")),
    ("LGPL-3.0", ("Lgpl3",)),
    ("LGPL-2.1-or-later", ("Lgpl21Later",)),
    ("LGPL-2.1", ("LgplAny", "Lgpl21Date")),
    ("LGPL-2.1", ("Lgpl21",)),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-3.0-or-later", ("Gpl3", "GplOption")),
    ("GPL-3.0-or-later", ("SpdxGpl3Later",)),
    ("GPL-3.0", ("GplAny", "Gpl3Date")),
    ("GPL-3.0", ("Gpl3Only",)),
    ("GPL-3.0", ("Gpl3",)),
    ("GPL-3.0", ("SpdxGpl3",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("GPL-2.0-or-later", ("Gpl2", "GplOption")),
    ("GPL-2.0-or-later", ("SpdxGpl2Later",)),
    ("GPL-2.0", ("GplAny", "Gpl2Date")),
    ("GPL-2.0", ("Gpl2Only",)),
    ("GPL-2.0", ("Gpl2",)),
    ("GPL-2.0", ("SpdxGpl2",)),
    ("GPL", ("GplAny",)),
    ("AGPL", ("AgplAny",)),
    ("LGPL", ("LgplAny",)),
    ("MPL-2.0", ("Mpl2", "MplCopy")),
    ("MPL-2.0", ("Mpl2",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("CC-BY-NC-SA", ("CcByNcSa",)),
    ("CC-BY-NC-ND", ("CcByNcNd",)),
    ("CC-BY-NC", ("CcByNc",)),
    ("CC-BY-SA", ("CcBySa",)),
    ("CC-BY-ND", ("CcByNd",)),
    ("CC-BY", ("CcBy",)),
    ("CC0-1.0", ("Cc0",)),
    ("public-domain", ("PublicDomain",)),
    ("SPDX-reference", ("SPDX",)),
)
RESERVED = "all-rights-reserved"

#: Replacements, in order, that leave one sentence or unwrapped line on each line: line ends; "v. 2"; the next line
#: of a paragraph after one of 40 characters or more, or one that goes on in lower case; sentence ends.
CUTS = (
    (r"\r\n?", "\n"),
    (r"\b([vV])\.[ \t]*([0-9])", "{1} {2}"),
    (r"([^\n]{40})\n([^A-Za-z0-9\n]*[A-Za-z0-9])", "{1} {2}"),
    (r"\n([^A-Za-z0-9\n]*[a-z])", " {1}"),
    (r"([.!?])[ \t\n]+", "{1}\n"),
)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order."""
    for pattern, to in CUTS:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", "")
    return F.transform(F.split(text, "\n", -1), plain)


def sentence_ids(text: Column) -> Column:
    def name(s: Column) -> Column:
        out = F.when(~s.rlike(HINT), F.lit(None).cast("string"))
        for ident, pattern in SENTENCES:
            out = out.when(s.rlike(pattern), ident)
        return out.when(s.rlike(TOPIC), UNKNOWN)
    return F.filter(F.transform(sentences(text), name), lambda i: i.isNotNull())


def licences_of(ids: Column) -> Column:
    """Licences named by a sequence of identifiers, in order of the rules."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("," + ",".join(run) + ",").alias("run")) for n, run in LICENCES])
    telling = F.filter(ids, lambda i: ~i.isin(*NEUTRAL))
    # every identifier between its own pair of commas, so that runs used up leave their neighbours apart
    start = F.struct(F.concat(F.lit(","), F.array_join(telling, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["run"])
        return F.struct(F.when(hit, F.replace(acc["left"], rule["run"], F.lit(",#,"))).otherwise(acc["left"]).alias("left"),
                        F.when(hit, F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    reserved = F.when(F.array_contains(ids, "AllRights"), F.array(F.lit(RESERVED))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_distinct(F.aggregate(rules, start, apply)["found"]), reserved)


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (recognised or UNKNOWN), sentences (identifiers in
    order, comma-joined), licenses (names in order of the rules, comma-joined)
    per row of ``docs``.

    Null, empty and unrelated texts give 0 and empty strings. A document naming
    several licences gets them all. Repeated rows and null doc_ids each get a
    row; other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    related = F.lower("text").rlike(RELATED)
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .select("doc_id", F.when(related, sentence_ids(F.col("text"))).alias("ids")))
    rows = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    names = F.when(F.size("ids") > 0, licences_of(F.col("ids"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"),
                       F.array_join(names, ",").alias("licenses"))
