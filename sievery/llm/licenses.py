"""License scans with ordered signature rules.

A text is read as its lower-cased words. Rules are regular expressions over the words joined by single spaces; each is
gated by keywords, so that a text without them costs no more than finding its words, and a rule runs only on texts that
have its keyword. Detections are intervals of words. They are taken in order of priority, then length, and one that
lies within an interval taken before is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.llm.words import PLAIN, blocks

#: Phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    #: The rule runs on texts with any of these words; whatever the pattern matches has one of them.
    keywords: tuple[str, ...]
    pattern: str


#: label, names (patterns over words), identifier words of the SPDX form, keywords
FAMILIES = (
    ("mit", r"(?:the )?(?:mit|expat|x11)", "mit", ("mit", "expat", "x11")),
    ("apache-2.0", r"(?:the )?apache(?: software)?(?: license)?(?: version)?(?: ?v)? ?2(?: 0)?", "apache 2 0", ("apache", "apache2", "apachev2", "apachev")),
    ("apache-1.1", r"(?:the )?apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1", ("apache",)),
    ("bsd-2-clause", r"(?:the )?(?:2|two) clause bsd|(?:simplified|freebsd) bsd|bsd 2 clause", "bsd 2 clause", ("bsd",)),
    ("bsd-3-clause", r"(?:the )?(?:3|three) clause bsd|(?:new|revised|modified) bsd|bsd 3 clause", "bsd 3 clause", ("bsd",)),
    ("bsd-4-clause", r"(?:the )?(?:4|four) clause bsd|original bsd|bsd 4 clause", "bsd 4 clause", ("bsd",)),
    ("gpl-1.0", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| ?v)? ?1(?: 0)?", "gpl 1 0", ("gpl", "gpl1", "gplv1", "gplv", "general")),
    ("gpl-2.0", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| ?v)? ?2(?: 0)?", "gpl 2 0", ("gpl", "gpl2", "gplv2", "gplv", "general")),
    ("gpl-3.0", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| ?v)? ?3(?: 0)?", "gpl 3 0", ("gpl", "gpl3", "gplv3", "gplv", "general")),
    ("lgpl-2.0", r"(?:the )?(?:gnu )?(?:lgpl|(?:library|lesser) general public license)(?: version| ?v)? ?2(?: 0)?", "lgpl 2 0", ("lgpl", "lgpl2", "lgplv2", "lgplv", "lesser", "library")),
    ("lgpl-2.1", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version| ?v)? ?2 1", "lgpl 2 1", ("lgpl", "lgpl2", "lgplv2", "lgplv", "lesser")),
    ("lgpl-3.0", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version| ?v)? ?3(?: 0)?", "lgpl 3 0", ("lgpl", "lgpl3", "lgplv3", "lgplv", "lesser")),
    ("agpl-3.0", r"(?:the )?(?:gnu )?(?:agpl|affero general public license)(?:(?: version| ?v)? ?3(?: 0)?| version| v)?", "agpl 3 0", ("agpl", "agpl3", "agplv3", "agplv", "affero")),
    ("gfdl", r"(?:the )?gnu free documentation license(?: version)?(?: 1 [1-3])?", "gfdl 1 3", ("gfdl", "documentation")),
    ("mpl-1.1", r"(?:the )?(?:mpl|mozilla public license)(?: version| ?v)? ?1 1", "mpl 1 1", ("mpl", "mpl1", "mplv1", "mplv", "mozilla")),
    ("mpl-2.0", r"(?:the )?(?:mpl|mozilla public license)(?: version| ?v)? ?2(?: 0)?", "mpl 2 0", ("mpl", "mpl2", "mplv2", "mplv", "mozilla")),
    ("epl-1.0", r"(?:the )?(?:epl|eclipse public license)(?: version| ?v)? ?1(?: 0)?", "epl 1 0", ("epl", "epl1", "eplv1", "eplv", "eclipse")),
    ("epl-2.0", r"(?:the )?(?:epl|eclipse public license)(?: version| ?v)? ?2(?: 0)?", "epl 2 0", ("epl", "epl2", "eplv2", "eplv", "eclipse")),
    ("cddl-1.0", r"(?:the )?(?:cddl|common development and distribution license)(?:(?: version| ?v)? ?1(?: 0)?| version| v)?", "cddl 1 0", ("cddl", "cddl1", "cddlv1", "cddlv", "development")),
    ("cpl-1.0", r"(?:the )?common public license(?: version)?(?: 1 0)?", "cpl 1 0", ("common",)),
    ("eupl-1.2", r"(?:the )?(?:eupl|european union public licen[cs]e)(?:(?: version| ?v)? ?1 [0-2]| version| v)?", "eupl 1 2", ("eupl", "eupl1", "euplv1", "euplv", "european")),
    ("artistic-1.0", r"(?:the )?(?:perl )?artistic license(?: version)?(?: 1 0)?", "artistic 1 0", ("artistic",)),
    ("artistic-2.0", r"(?:the )?artistic license(?: version)? 2(?: 0)?", "artistic 2 0", ("artistic",)),
    ("isc", r"(?:the )?isc", "isc", ("isc",)),
    ("zlib", r"(?:the )?zlib(?: libpng)?", "zlib", ("zlib",)),
    ("bsl-1.0", r"(?:the )?boost software license(?: version)?(?: 1 0)?", "bsl 1 0", ("boost", "bsl")),
    ("unlicense", r"(?:the )?unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", r"(?:the )?(?:wtfpl|do what the fuck you want to public license)", "wtfpl", ("wtfpl", "fuck")),
    ("0bsd", r"(?:the )?(?:0bsd|zero clause bsd)", "0bsd", ("0bsd", "bsd")),
    ("python-2.0", r"(?:the )?(?:python software foundation|psf) license(?: version)?(?: 2)?", "python 2 0", ("python", "psf")),
    ("php-3.0", r"(?:the )?php license(?: version)?(?: 3 01?)?", "php 3 01", ("php",)),
    ("ruby", r"(?:the )?ruby license", "ruby", ("ruby",)),
    ("openssl", r"(?:the )?openssl(?: ssleay)?", "openssl", ("openssl",)),
    ("ofl-1.1", r"(?:the )?(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1", ("font", "ofl")),
    ("ms-pl", r"(?:the )?microsoft public license", "ms pl", ("microsoft",)),
    ("ms-rl", r"(?:the )?microsoft reciprocal license", "ms rl", ("microsoft",)),
    ("osl-3.0", r"(?:the )?open software license(?: version)?(?: 3 0)?", "osl 3 0", ("open",)),
    ("afl-3.0", r"(?:the )?academic free license(?: version)?(?: 3 0)?", "afl 3 0", ("academic",)),
    ("ncsa", r"(?:the )?university of illinois ncsa open source", "ncsa", ("ncsa", "illinois")),
    ("upl-1.0", r"(?:the )?universal permissive license(?: version)?(?: 1 0)?", "upl 1 0", ("permissive", "upl")),
    ("busl-1.1", r"(?:the )?business source license(?: version)?(?: 1 1)?", "busl 1 1", ("business", "busl")),
    ("sspl-1.0", r"(?:the )?server side public license(?: version)?(?: 1)?", "sspl 1 0", ("server", "sspl")),
    ("elastic-2.0", r"(?:the )?elastic license(?: version)?(?: 2 0)?", "elastic 2 0", ("elastic",)),
    ("odbl-1.0", r"(?:the )?open (?:data commons open )?database license(?: version)?(?: 1 0)?", "odbl 1 0", ("database", "odbl")),
    ("odc-by-1.0", r"(?:the )?open data commons attribution license", "odc by 1 0", ("commons",)),
    ("pddl-1.0", r"(?:the )?(?:open data commons )?public domain dedication and license", "pddl 1 0", ("dedication", "pddl")),
    ("cc0-1.0", r"(?:the )?(?:cc0(?: 1 0)?|creative commons zero)(?: universal)?", "cc0 1 0", ("cc0", "creative")),
)
#: Creative Commons: terms, the words of their short and their long form.
TERMS = (
    ("by", "by", r"attribution"),
    ("by-sa", "by sa", r"attribution share ?alike"),
    ("by-nd", "by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "by nc", r"attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", r"attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
#: Signatures of their own: label, priority, keywords, pattern.
TEXTS = (
    ("mit", 95, ("hereby",), r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 70, ("noninfringement",), r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", 95, ("hereby",), r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", 95, ("apache",), r"www apache org licenses license 2 0"),
    ("bsd-3-clause", 95, ("endorse",), r"neither the name of .{1,120}? may be used to endorse or promote products"),
    ("bsd", 80, ("redistributions",), r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 80, ("redistributions",), r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", 95, ("advertising",), r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", 90, ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 92, ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl-or-later", 85, ("later",), r"either version [123] of the license or at your option any later version"),
    ("gpl", 88, ("gnu",), r"www gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", 88, ("gnu",), r"www gnu org (?:licenses|copyleft) lgpl"),
    ("agpl", 88, ("gnu",), r"www gnu org licenses agpl"),
    ("mpl-2.0", 95, ("mozilla",), r"mozilla org mpl 2 0"),
    ("unlicense", 95, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("zlib", 95, ("altered",), r"altered source versions must be plainly marked as such"),
    ("wtfpl", 90, ("fuck",), r"you just do what the fuck you want to"),
    ("bsl-1.0", 95, ("boost",), r"www boost org license 1 0"),
    ("cc0-1.0", 95, ("creativecommons",), r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", 95, ("creativecommons",), r"creativecommons org publicdomain mark 1 0"),
    ("public-domain", 60, ("domain",), r"(?:in|into|to) the public domain"),
    ("public-domain", 55, ("domain",), r"public domain"),
    ("copyright", 50, ("copyright",), r"copyright(?: c| ©)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", 40, ("copyright", "copyrighted"), r"copyrighted|copyright"),
    ("reserved", 70, ("reserved",), r"all rights reserved"),
    ("reserved", 65, ("reserved",), r"(?:some|any) rights reserved"),
    ("reserved", 65, ("droits",), r"tous droits réservés"),
    ("reserved", 65, ("rechte",), r"alle rechte vorbehalten"),
    ("reserved", 65, ("derechos",), r"todos los derechos reservados"),
    ("proprietary", 75, ("proprietary",), r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 75, ("unauthorized",), r"unauthorized (?:copying|reproduction|distribution|use)(?: of this \w+)?(?: \w+){0,6} is (?:strictly )?prohibited"),
    ("no-redistribution", 70, ("reproduced",), r"may not be reproduced(?: \w+){0,8} without(?: the)?(?: prior)?(?: written)? (?:permission|consent)"),
    ("non-commercial", 70, ("commercial", "noncommercial"), r"(?:for )?non ?commercial use only"),
    ("royalty-free", 60, ("royalty",), r"royalty free"),
    ("gpl", 60, ("general",), r"(?:gnu )?general public licen[cs]e"),
    ("lgpl", 62, ("lesser",), r"(?:gnu )?lesser general public licen[cs]e"),
    ("cc", 45, ("creative",), r"creative commons"),
    ("license", 30, ("license", "licence", "licensed", "licenced"), r"(?:licensed|licenced) under(?: the)?"),
)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order that decides between equal detections."""
    out = [Rule(label, priority, keywords, pattern) for label, priority, keywords, pattern in TEXTS]
    named = [(label, f"(?:{names})", spdx, keywords) for label, names, spdx, keywords in FAMILIES]
    for term, short, long in TERMS:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{term}-{version.replace(' ', '.')}"
            named.append((label, f"(?:cc {short} {version}|(?:the )?creative commons {long}(?: {version[0]} {version[2]}| version {version}))", f"cc {short} {version}", ("cc", "creative")))
            out.append(Rule(label, 96, ("creativecommons",), f"creativecommons org licenses {short} {version}"))
        out.append(Rule(f"cc-{term}", 58, ("cc", "creative"), f"(?:cc {short}|creative commons {long})"))
    for label, name, spdx, keywords in named:
        out += [
            Rule(label, 99, ("spdx",), f"spdx license identifier {spdx}(?: only| or later)?"),
            Rule(label, 90, keywords, f"(?:licensed|licenced|released|distributed|published|available|provided|covered)(?: under| by)(?: the terms of)?(?: the)? {name}(?: licen[cs]e)?"),
            Rule(label, 80, keywords, f"(?:this|the) (?:work|software|program|project|file|library|code|text|page|document) is (?:\\w+ )?(?:under )?{name} licen[cs]ed?"),
            Rule(label, 75, keywords, f"licen[cs]e {name}"),
            Rule(label, 72, keywords, f"{name} licen[cs]e" if "icen" not in name else name),
        ]
    return tuple(out)


@cache
def _compiled() -> tuple[np.ndarray, list[list[int]], list[re.Pattern]]:
    """Hashes of the keywords, ascending; the rules of each; the patterns."""
    all_rules = rules()
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(all_rules):
        for word in rule.keywords:
            by_word.setdefault(word, []).append(i)
    hashes = _hashes(list(by_word))
    order = np.argsort(hashes)
    lists = list(by_word.values())
    return hashes[order], [lists[i] for i in order], [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in all_rules]


def _hashes(words: list[str]) -> np.ndarray:
    return next(blocks(pa.array([" ".join(words)]), PLAIN)).hashes


def detect(words: str, gated: list[int]) -> list[tuple[int, int, int]]:
    """Detections (first character, end, rule) of the given rules in joined words that no other suppresses."""
    all_rules, patterns = rules(), _compiled()[2]
    found = [(*m.span(), i) for i in gated for m in patterns[i].finditer(words)]
    found.sort(key=lambda d: (-all_rules[d[2]].priority, d[0] - d[1], d[0], d[2]))
    kept, starts, ends = [], [], []  # starts and ends: of kept intervals that lie within no other, both ascending
    for start, end, i in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, i))
        low = at
        while low < len(starts) and ends[low] <= end:
            low += 1
        first = at - 1 if at and starts[at - 1] == start else at
        starts[first:low], ends[first:low] = [start], [end]
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords, gates, _ = _compiled()
    all_rules = rules()
    phrases = [(_hashes(p.split()), label) for p, label in BASE]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for block in blocks(batch.column(batch.schema.get_field_index("text")), PLAIN):
            h, n = block.hashes, len(block.first) - 1
            owner = np.repeat(np.arange(n), np.diff(block.first))
            count, first, last, base = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), [set() for _ in range(n)]
            for words, label in phrases:
                size = len(words)
                at = np.flatnonzero(h[: max(0, len(h) - size + 1)] == words[0])
                for k in range(1, size):
                    at = at[h[at + k] == words[k]]
                at = at[owner[at] == owner[at + size - 1]]
                text, place = owner[at], at - block.first[owner[at]]
                np.add.at(count, text, 1)
                np.minimum.at(first, text, place)
                np.maximum.at(last, text, place)
                for i in np.unique(text):
                    base[i].add(label)
            slot = np.minimum(np.searchsorted(keywords, h), len(keywords) - 1)
            hit = np.flatnonzero(keywords[slot] == h)
            gated: dict[int, set[int]] = {}
            for i, k in zip(owner[hit].tolist(), slot[hit].tolist(), strict=True):
                gated.setdefault(i, set()).update((k,))
            for i in range(n):
                kept = []
                if i in gated:
                    low, high = block.first[i], block.first[i + 1]
                    data = block.data.tobytes() if n == 1 else block.data[block.begin[i] : block.begin[i + 1]].tobytes()
                    start = block.start[low:high] - (0 if n == 1 else block.begin[i])
                    words = [data[a:b].decode().translate(_LOWER) for a, b in zip(start.tolist(), (start + block.length[low:high]).tolist(), strict=True)]
                    found = detect(" ".join(words), sorted({r for k in gated[i] for r in gates[k]}))
                    # The spaces before a place tell the word that it lies in.
                    spaces = np.cumsum([len(w) + 1 for w in words]) - 1
                    starts, ends = (np.searchsorted(spaces, [x[k] for x in found]).tolist() for k in (0, 1))
                    kept = [(a, b + 1, all_rules[r].label, all_rules[r].priority) for a, b, (_, _, r) in zip(starts, ends, found, strict=True)]
                out["n_words"].append(int(block.first[i + 1] - block.first[i]))
                out["n_base"].append(int(count[i]))
                out["first_word"].append(int(first[i]) if count[i] else None)
                out["last_word"].append(int(last[i]) if count[i] else None)
                out["base_labels"].append(",".join(sorted(base[i])))
                out["labels"].append(",".join(sorted(base[i] | {k[2] for k in kept})))
                out["score"].append(max([0.7] * bool(base[i]) + [k[3] / 100 for k in kept], default=0.0))
                out["spans"].append([{"first": a, "end": b, "label": label, "priority": p} for a, b, label, p in sorted(kept)])
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, x in enumerate(batch.schema.names) if x != "text"], *[pa.array(v, t) for v, t in zip(out.values(), _TYPES, strict=True)]], [*[x for x in batch.schema.names if x != "text"], *out])


_LOWER = {c: c + 32 for c in range(65, 91)}
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))
_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:bigint,end:bigint,label:string,priority:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): words, base phrases, labels, score and the detections by word.

    A null text is an empty one: no words, no labels, score 0. Texts of any length are read whole, in time that grows with their length; each
    row is scanned for itself, also where doc_id is null or repeated. The score is the priority of the strongest detection, in hundredths.
    An empty table gives an empty table, and columns besides doc_id and text are dropped.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, f"doc_id long, {_FOUND}")
