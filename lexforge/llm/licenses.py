"""Licence scan: matching statistics against licence templates, chained into spans.

Licence templates and the plain licence phrases form one generalised suffix
automaton (bounded: it holds only the templates given).  Files stream through
it on the executors.  Two things are read off the states: every place where a
phrase stands, and matches of ``min_match`` words or more with each template
that no word more would extend: the longest match's state and, down its suffix
links, those of shorter matches with other templates.  Long matches that lie close together in the file and
go forward in the same template are chained; a chain that covers at least
``min_cover`` of a template labels the file with it.

Defined results: null text counts as empty; a file without words has score 0;
texts are read whole, a few MB at a time; spans that tie in place are ordered
by label; repeated rows give equal results; clashing input columns are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.automaton import SuffixAutomaton, merged
from lexforge.llm.common import free_name, without
from lexforge.llm.tokens import ALNUM, SPACE, Tokens, chunks

# The phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Grant or notice texts of common public licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files, to deal in the Software without "
           "restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
              "this file except in compliance with the License. You may obtain a copy of the "
              "License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the "
           "terms of the GNU General Public License as published by the Free Software Foundation, "
           "either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are "
           "permitted provided that the following conditions are met",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used "
             "to endorse or promote products derived from this software without specific prior "
             "written permission",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms "
            "of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
           "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
           "or without fee is hereby granted",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved",
}

OUTPUT = ("n_words", "places", "phrase_labels", "spans", "score")
_TYPE = ("n_words long, places array<long>, phrase_labels array<string>, "
         "spans array<struct<label string, start long, end long, cover double>>, score double")


def _split(text: str) -> list[bytes]:
    t = Tokens([text.encode()], ALNUM, True)
    return t.words(0, len(t.start))


class LicenseIndex:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int):
        self.labels = list(templates)
        seqs = [_split(templates[x]) for x in self.labels]
        self.length = {x: len(s) for x, s in zip(self.labels, seqs)}
        self.after: dict[str, list[int]] = {}      # words of each template as the automaton numbers them
        self.min_match = min_match
        names = [("phrase", phrases[p]) for p in phrases]
        longest = max([len(s) for s in seqs] + [1])
        # every template part and phrase is looked up whole: the window is out of reach
        self.automaton = SuffixAutomaton(seqs + [_split(p) for p in phrases],
                                         [("template", x) for x in self.labels] + names, longest + 1)
        need = [min(min_match, len(s)) for s in seqs] + [len(_split(p)) for p in phrases]
        self.automaton.least = min(need)
        self.shortest = min([min(min_match, len(s)) for s in seqs if s], default=1)
        # where each state ends in each template: (template, words read so far)
        self.ends: dict[int, list[tuple[str, int]]] = {}
        for x, s in zip(self.labels, seqs):
            self.after[x] = self.automaton.ids(Tokens([b" ".join(s)], SPACE, False).hash).tolist()
            states, _ = self.automaton.stream(self.after[x])
            for n, v in enumerate(states, 1):
                while v:
                    self.ends.setdefault(v, []).append((x, n))
                    v = self.automaton.link[v]

    def scan(self, t: Tokens) -> tuple[list, list]:
        """Places of phrases (word, label), and long matches (label, from, to, template from)."""
        a, places, matches = self.automaton, [], []
        for lo, _, ids in a.runs(t):
            words = ids.tolist()
            states, lengths = a.stream(words)
            for i, (v, n) in enumerate(zip(states, lengths)):
                s = a.short[v]
                while s:
                    if a.len[s] <= n:
                        places += [(lo + i + 1 - a.len[s], label)
                                   for kind, label in a.names[s] if kind == "phrase"]
                    s = a.short[a.link[s]]
                if n >= self.shortest:
                    matches += self._ending(v, n, lo + i + 1, words[i + 1] if i + 1 < len(words) else None)
        return places, matches

    def _ending(self, v: int, n: int, end: int, following: int | None) -> list:
        """Matches that end before word ``end`` and that ``following`` does not extend, longest of each place."""
        out, seen = [], set()
        while v and n >= self.shortest:
            for place in self.ends.get(v, ()):
                x, to = place
                if place not in seen:
                    seen.add(place)
                    extended = following is not None and to < self.length[x] and self.after[x][to] == following
                    if not extended and n >= min(self.min_match, self.length[x]):
                        out.append((x, end - n, end, to - n))
            v = self.automaton.link[v]
            n = min(n, self.automaton.len[v])
        return out

    def chain(self, matches: list, gap: int, min_cover: float) -> list[tuple[str, int, int, float]]:
        """Chains that go forward in file and template, at most ``gap`` words apart."""
        out = []
        for x in sorted({m[0] for m in matches}):
            chains: list[list] = []      # [from, to, template end, words covered]
            for _, s, e, at in sorted(m for m in matches if m[0] == x):
                best = next((c for c in reversed(chains)
                             if 0 <= s - c[1] <= gap and at >= c[2]), None)
                if best:
                    best[1], best[2], best[3] = e, at + e - s, best[3] + e - s
                else:
                    chains.append([s, e, at + e - s, e - s])
            out += [(x, s, e, n / self.length[x]) for s, e, _, n in chains
                    if n >= min_cover * self.length[x]]
        return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def read_templates(spark: SparkSession, folder: str, suffix: str = "") -> dict[str, str]:
    """Templates from a shared folder of licence texts, one a file, labelled by the file's name.

    They are a dictionary on the driver, as those above: licences, not a corpus.
    """
    rows = (spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
            .select(F.regexp_extract("_metadata.file_name", f"^(.*?){re.escape(suffix)}$", 1).alias("label"), "value"))
    return {unquote(r["label"]).lower(): r["value"] for r in rows.collect()}


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None, min_match: int = 4, gap: int = 12,
                  min_cover: float = 0.6) -> DataFrame:
    """``docs`` with n_words, places (first word of each phrase place, sorted),
    phrase_labels, spans of covered templates and score (share of words inside
    a phrase place or a template span).
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    index = LicenseIndex(TEMPLATES if templates is None else templates, phrases, min_match)
    size = {label: max(len(_split(p)) for p in phrases if phrases[p] == label)
            for label in phrases.values()}
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(_TYPE)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for text in batches:
            rows = []
            for lo, hi, t in chunks(text.tolist(), ALNUM, True):
                places, matches = ix.scan(t)
                by_doc: dict[int, tuple[list, list]] = {}
                for p in places:
                    by_doc.setdefault(int(t.doc[p[0]]), ([], []))[0].append(p)
                for m in matches:
                    by_doc.setdefault(int(t.doc[m[1]]), ([], []))[1].append(m)
                for d in range(hi - lo):
                    first = int(t.first[d])
                    n = int(t.first[d + 1]) - first
                    ps, ms = by_doc.get(d, ([], []))
                    spans = [(x, s - first, e - first, c) for x, s, e, c in
                             ix.chain(ms, gap, min_cover)]
                    at = sorted((int(w) - first, label) for w, label in ps)
                    hit = merged([(w, w + size[label]) for w, label in at]
                                 + [(s, e) for _, s, e, _ in spans])
                    rows.append((n, [w for w, _ in at], sorted({x for _, x in at}),
                                 [dict(label=x, start=s, end=e, cover=min(1.0, c)) for x, s, e, c in spans],
                                 min(1.0, sum(e - s for s, e in hit) / n) if n else 0.0))
            yield pd.DataFrame(rows, columns=OUTPUT)

    out = without(docs, [c for c in OUTPUT if c != text_col.lower()])
    found = free_name(out, "_found")
    return (out.withColumn(found, scan(F.col(text_col).cast("binary")))
            .select("*", f"{found}.*").drop(found))
