"""License scan by ordered signature rules.

A rule is a keyword with what must stand left and right of it, as regular expressions
over lower-cased words: names of licenses in four forms, and sentences of notices that name none. Only texts with a stem of a keyword are split into words, and
only the rules of a keyword that stands there are tried. Of the rules that match at one
keyword the longest wins, then the one of higher priority; a detection that lies inside
the words of another one is dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import WORD, lower_ascii, word_count

#: Words that a rule looks at on each side of its keyword.
REACH = 14

#: label | left of the keyword | keyword | right of it | words of the short identifier.
#: A left part ends, a right part begins with a space.
FAMILIES = r"""
mit | (the )? | mit | ( expat)? licen[sc]e | mit
mit-0 | (the )? | mit | no attribution( licen[sc]e)? | mit 0
apache-1.1 | (the )? | apache | ( software)? licen[sc]e( version)? 1 1 | apache 1 1
apache-2.0 | (the )? | apache | ( software)? licen[sc]e( version)? v?2( 0)? | apache 2 0
apache | (the )? | apache | ( software)? licen[sc]e | apache
gpl-1 | (the )?(gnu )? | general | public licen[sc]e( version)? v?1( 0)? | gpl 1 0( only| or later)?
gpl-2 | (the )?(gnu )? | general | public licen[sc]e( version)? v?2( 0)? | gpl 2 0( only| or later)?
gpl-3 | (the )?(gnu )? | general | public licen[sc]e( version)? v?3( 0)? | gpl 3 0( only| or later)?
gpl | (the )?(gnu )? | general | public licen[sc]e | gpl
gpl-2 | (the )?(gnu )? | gplv2 | ( 0)?( or later| only)? |
gpl-3 | (the )?(gnu )? | gplv3 | ( 0)?( or later| only)? |
gpl-2 | (the )?(gnu )? | gpl | ( version)? v?2( 0)?( or later| only)? |
gpl-3 | (the )?(gnu )? | gpl | ( version)? v?3( 0)?( or later| only)? |
gpl | (the )?(gnu )? | gpl | |
lgpl-2 | (the )?(gnu )? | library | general public licen[sc]e( version)? v?2( 0)? | lgpl 2 0( only| or later)?
lgpl-2.1 | (the )?(gnu )? | lesser | general public licen[sc]e( version)? v?2 1 | lgpl 2 1( only| or later)?
lgpl-3 | (the )?(gnu )? | lesser | general public licen[sc]e( version)? v?3( 0)? | lgpl 3 0( only| or later)?
lgpl | (the )?(gnu )? | lesser | general public licen[sc]e | lgpl
lgpl-2.1 | (the )?(gnu )? | lgplv2 | 1( or later| only)? |
lgpl-3 | (the )?(gnu )? | lgplv3 | ( 0)?( or later| only)? |
lgpl-2.1 | (the )?(gnu )? | lgpl | ( version)? v?2 1( or later| only)? |
lgpl-3 | (the )?(gnu )? | lgpl | ( version)? v?3( 0)?( or later| only)? |
lgpl | (the )?(gnu )? | lgpl | |
agpl-3 | (the )?(gnu )? | affero | general public licen[sc]e( version)? v?3( 0)? | agpl 3 0( only| or later)?
agpl | (the )?(gnu )? | affero | general public licen[sc]e | agpl
agpl-3 | (the )?(gnu )? | agplv3 | ( 0)?( or later| only)? |
agpl-3 | (the )?(gnu )? | agpl | ( version)? v?3( 0)?( or later| only)? |
agpl | (the )?(gnu )? | agpl | |
fdl | (the )?(gnu )? | free | documentation licen[sc]e( version| v)?( 1 [123])? | gfdl( 1 [123])?
mpl-1.1 | (the )? | mozilla | public licen[sc]e( version)? v?1 1 | mpl 1 1
mpl-2.0 | (the )? | mozilla | public licen[sc]e( version)? v?2( 0)? | mpl 2 0
mpl | (the )? | mozilla | public licen[sc]e | mpl
bsd-2 | (the )?(2|two) clause (simplified )? | bsd | ( licen[sc]e)? | bsd 2 clause
bsd-3 | (the )?(3|three) clause (new |revised |modified )? | bsd | ( licen[sc]e)? | bsd 3 clause
bsd-4 | (the )?(4|four) clause (original )? | bsd | ( licen[sc]e)? | bsd 4 clause
bsd | (the )?(new |modified |simplified )? | bsd | licen[sc]e | 0bsd
isc | (the )? | isc | licen[sc]e | isc
zlib | (the )? | zlib | ( libpng)? licen[sc]e | zlib
boost | (the )? | boost | software licen[sc]e( version)?( 1 0)? | bsl 1 0
unlicense | (the )? | unlicense |  | unlicense
wtfpl | (the )?do what the | fuck | you want to public licen[sc]e | wtfpl
eclipse | (the )? | eclipse | public licen[sc]e( version| v)?( [12]( 0)?)? | epl [12] 0
eupl | (the )? | european | union public licen[sc]e( version| v)?( 1 [012])? | eupl 1 [012]
cddl | (the )? | common | development and distribution licen[sc]e( version)?( 1 [01])? | cddl 1 [01]
cpl | (the )? | common | public licen[sc]e( version)?( 1 0)? | cpl 1 0
artistic | (the )?(perl )? | artistic | licen[sc]e( version)?( [12]( 0)?)? | artistic [12] 0
python | (the )? | python | software foundation licen[sc]e( version)?( 2)? | psf 2 0
php | (the )? | php | licen[sc]e( version)?( 3 01?)? | php 3 01?
ruby | (the )? | ruby | licen[sc]e | ruby
openssl | (the )? | openssl | licen[sc]e | openssl
postgresql | (the )? | postgresql | licen[sc]e | postgresql
ncsa | (the )?(university of illinois )? | ncsa | open source licen[sc]e | ncsa
ofl | (the )?(sil )?open | font | licen[sc]e( version)?( 1 [01])? | ofl 1 [01]
odbl | (the )?open | database | licen[sc]e( 1 0)? | odbl 1 0
odc-by | (the )?open data commons | attribution | licen[sc]e( 1 0)? | odc by 1 0
cc0 | (the )?(creative commons )? | cc0 | ( 1 0)?( universal)? | cc0 1 0
cc-by-nc-nd | (the )?(creative commons )? | cc | by nc nd( [1-4] [05])? | cc by nc nd( [1-4] [05])?
cc-by-nc-sa | (the )?(creative commons )? | cc | by nc sa( [1-4] [05])? | cc by nc sa( [1-4] [05])?
cc-by-nc | (the )?(creative commons )? | cc | by nc( [1-4] [05])? | cc by nc( [1-4] [05])?
cc-by-nd | (the )?(creative commons )? | cc | by nd( [1-4] [05])? | cc by nd( [1-4] [05])?
cc-by-sa | (the )?(creative commons )? | cc | by sa( [1-4] [05])? | cc by sa( [1-4] [05])?
cc-by | (the )?(creative commons )? | cc | by( [1-4] [05])? | cc by( [1-4] [05])?
cc-by-nc-sa | (the )? | creative | commons attribution non ?commercial share ?alike( [1-4] [05])?( international)?( licen[sc]e)? | cc by nc sa
cc-by-nc-nd | (the )? | creative | commons attribution non ?commercial no ?deriv(ative|ativ)e?s( [1-4] [05])?( international)?( licen[sc]e)? | cc by nc nd
cc-by-nc | (the )? | creative | commons attribution non ?commercial( [1-4] [05])?( international)?( licen[sc]e)? | cc by nc
cc-by-sa | (the )? | creative | commons attribution share ?alike( [1-4] [05])?( international)?( licen[sc]e)? | cc by sa
cc-by | (the )? | creative | commons attribution( [1-4] [05])?( international)?( licen[sc]e)? | cc by
public-domain | (the )? | public | domain( dedication)? | pddl 1 0
proprietary | | proprietary | ( software)? licen[sc]e | licenseref proprietary
reserved | all | rights | reserved | licenseref reserved
"""
#: Sentences of notices that don't name their license: label | left | keyword | right.
NOTICES = r"""
mit | permission is | hereby | granted free of charge to any person obtaining a copy
boost | permission is | hereby | granted free of charge to any person or organi[sz]ation obtaining
isc | distribute this software( and its documentation)? for any purpose with or without fee is | hereby | granted
bsd | | redistribution | and use in source and binary forms with or without modification are permitted
bsd-3 | names? of (its|the|any) (copyright holders? |contributors |authors? )?(and contributors )?may( not)? be used to | endorse | or promote products derived from this software
bsd-4 | all | advertising | materials mentioning features or use of this software must display
zlib | in no event will the authors? be | held | liable for any damages arising from the use of this software
unlicense | this is free and | unencumbered | software released into the public domain
disclaimer | without | warranty | of any kind( either)?( express(ed)? or implied)?
disclaimer | without any | warranty | without even the implied warranty of
"""
#: Form | what stands before the name | confidence; the short identifier has a form of its own.
FORMS = (
    ("name", "", 0.6),
    ("grant", "(dual |also )?(licen[sc]ed|released|distributed|published|available|covered|provided|offered) (under|by) "
              "(the terms (and conditions )?of )?(version [1-4]( 0)? of )?", 0.95),
    ("reference", "(see|read|copy of|subject to|compatible with|accordance with|according to|terms of) ", 0.85),
)
TAG_CONFIDENCE, NOTICE_CONFIDENCE = 0.99, 0.9
#: Every match has one of these somewhere in the lower-cased text.
STEMS = (
    "licen", "spdx", "rights", "public", "creative", "cc0", "bsd", "gpl", "hereby", "redistribution", "endorse", "advertising", "liable",
    "unencumbered", "warranty",
)
CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
#: The base: phrase and label (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """``label, keyword, left, right, priority, confidence``, a lower number being of higher priority."""
    made = []
    for row in FAMILIES.strip().splitlines():
        label, left, keyword, right, tag = (part.strip() for part in re.split(r"(?<=\s)\|(?=\s)", row + " "))
        left = left + " " if left and not left.endswith("?") else left
        right = right if not right or right.startswith("( ") else f" {right}"
        for form, before, confidence in FORMS:
            made.append((label, keyword, f"{before}{left}", right, confidence))
        if tag:
            made.append((label, "spdx", "", f" licen[sc]e identifier {tag}", TAG_CONFIDENCE))
    for row in NOTICES.strip().splitlines():
        label, left, keyword, right = (part.strip() for part in re.split(r"(?<=\s)\|(?=\s)", row + " "))
        made.append((label, keyword, left and left + " ", f" {right}", NOTICE_CONFIDENCE))
    return [
        (label, keyword, f"(?:^|(?<= ))({left})$", f"^({right})(?= |$)", number, confidence)
        for number, (label, keyword, left, right, confidence) in enumerate(sorted(made, key=lambda r: -r[4]))
    ]


def _rule_array() -> Column:
    fields = ("label", "keyword", "left", "right", "priority", "confidence")
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, rule)]) for rule in rules()])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _contains_any(text: Column) -> Column:
    found = F.contains(text, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        found = found | F.contains(text, F.lit(stem))
    return found | (F.contains(text, F.lit("cc")) & F.rlike(text, F.lit(CC_BY)))


def _detections(words: Column, keywords: list[str], table: Column) -> Column:
    """The winning rule at each keyword, in order of position."""
    kept = F.array(*[F.lit(k) for k in keywords])
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    places = F.filter(numbered, lambda p: F.array_contains(kept, p["word"]))

    def at(place: Column) -> Column:
        start = F.greatest(place["at"] - REACH, F.lit(0))
        left = F.concat(F.array_join(F.slice(words, start + 1, place["at"] - start), " "), F.when(place["at"] > 0, F.lit(" ")).otherwise(F.lit("")))
        right = F.concat(F.lit(" "), F.array_join(F.slice(words, place["at"] + 2, F.lit(REACH)), " "))
        matching = F.filter(
            table, lambda r: (r["keyword"] == place["word"]) & F.rlike(left, r["left"]) & F.rlike(right, r["right"])
        )
        spans = F.transform(matching, lambda r: F.struct(
            (place["at"] - _spaces(F.coalesce(F.regexp_substr(left, r["left"]), F.lit("")))).alias("start"),
            (place["at"] + 1 + _spaces(F.coalesce(F.regexp_substr(right, r["right"]), F.lit("")))).alias("end"),
            r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"),
        ))
        # Longest first, then by priority.
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
            (s["start"] - s["end"]).alias("shortness"), s["priority"].alias("rank"), s.alias("span")
        )))
        return F.get(ordered, F.lit(0))["span"]

    return F.filter(F.transform(places, at), lambda d: d.isNotNull())


def _outermost(found: Column) -> Column:
    """Detections that lie in no other one. One can only contain those of keywords within its words."""
    def neighbours(i: Column) -> Column:
        first = F.greatest(i - 2 * REACH, F.lit(0))
        return F.slice(found, first + 1, F.lit(4 * REACH + 1))

    def inside(d: Column, e: Column) -> Column:
        wider = e["end"] - e["start"] > d["end"] - d["start"]
        same = (e["end"] == d["end"]) & (e["start"] == d["start"]) & (e["priority"] < d["priority"])
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (wider | same)

    return F.filter(found, lambda d, i: ~F.exists(neighbours(i), lambda e: inside(d, e)))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, detections, labels, score``.

    ``detections`` are structs of start and end (words, end exclusive), label, priority
    and confidence. ``score`` is the chance that one of them is right at least, each
    having its rule's confidence. Everything is computed inside the row: no shuffle,
    so no key can be hot, and repeated rows each get the same result.

    Null or empty text has no words, labels ``''`` and score 0. Very long texts are
    searched as a whole. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), lower_ascii(text).alias("low"))
    gated = low.select(
        "doc_id", word_count(F.col("text")).alias("n_words"),
        F.when(_contains_any(F.col("low")), F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).alias("words"),
    )
    plain = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    lined = gated.withColumn("plain", F.when(F.size("words") > 0, plain))
    columns = {}
    for number, (phrase, _) in enumerate(BASE):
        columns[f"cut{number}"] = F.when(
            F.contains("plain", F.lit(f" {phrase} ")), F.split("plain", f"(?<= ){phrase}(?= )", -1)
        )
    cut = lined.withColumns(columns)
    counts, firsts, lasts, labels = [], [], [], []
    for number, (phrase, label) in enumerate(BASE):
        pieces = F.col(f"cut{number}")
        counts.append(F.coalesce(F.size(pieces) - 1, F.lit(0)))
        firsts.append(_spaces(pieces[0]) - 1)
        lasts.append(F.col("n_words") - (_spaces(F.element_at(pieces, -1)) - 1) - (phrase.count(" ") + 1))
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    based = cut.select(
        "doc_id", "n_words", "words", sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"), F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )
    keywords = sorted({rule[1] for rule in rules()})
    found = based.withColumn(
        "detections", F.when(F.size("words") > 0, _detections(F.col("words"), keywords, _rule_array()))
    ).drop("words").withColumn("detections", _outermost(F.col("detections")))
    miss = F.aggregate("detections", F.lit(1.0), lambda rest, d: rest * (1.0 - d["confidence"]))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.coalesce("detections", F.array().cast(
            "array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"
        )).alias("detections"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(
            F.col("base"), F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
        ))), ",").alias("labels"),
        F.greatest(1.0 - F.coalesce(miss, F.lit(1.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
