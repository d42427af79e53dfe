"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of consecutive words of every template. A document's words stream through it once and
give matching statistics: at each word, the length of the longest run ending there that some template contains; each
template is credited where its own run ends, also if a longer template goes on. Long
matches of one template are chained, with small gaps and in the order of the template, into covered spans; a span's score
is the share of the template's words that it covers, each counted once. Words outside all templates send the automaton back to its start, so that time is linear.

Base labels (phrases of the contract) are places where the phrase's words stand consecutively.

Defined results: a null text counts as empty (no words, no labels, score 0); every row gives one row, repeated rows
too; equal template coverage is settled by the label's alphabetical order; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases and labels of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Whole texts of short licences in their parts (each part has the licence's label where it stands alone),
#: standard headers of long ones, and common notices; a parameter of scan().
TEMPLATES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mit-notice": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
LEAST_RUN = 4  # words of a match that may be chained
GAP = 3  # words between chained matches
LEAST_SHARE = 0.6  # of the template's words

#: Bytes that are no part of a word become blanks, A-Z become lower case.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """Suffix automaton of several word sequences; each state knows the templates in which its runs occur."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.members = [{}], [-1], [0], [set()]
        self.ended: dict = {}
        for k, seq in enumerate(sequences):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                self.members[last].add(k)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.members[self.link[s]] |= self.members[s]

    def _new(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.members.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, p: int, w: int) -> int:
        if w in self.next[p]:
            q = self.next[p][w]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        new = self._new(self.length[p] + 1, {}, 0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def statistics(self, ids: list[int]):
        """(position, length, state) wherever the match ending at position is longest, that is, can't go on."""
        state = length = 0
        out = []
        for i, w in enumerate(ids):
            if w not in self.next[state]:
                if length:
                    out.append((i - 1, length, state))
                while state > 0 and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state = length = 0
        if length:
            out.append((len(ids) - 1, length, state))
        return out

    def _ended(self, state: int, w: int | None) -> list[tuple[int, int]]:
        """(length, or 0 for that of the whole match; template) of every template whose own match the word w ends."""
        if (state, w) not in self.ended:
            out, seen, q = [], set(), state
            while q > 0:
                on = self.next[q].get(w)
                out += [(0 if q == state else self.length[q], k) for k in sorted(self.members[q] - seen) if on is None or k not in self.members[on]]
                seen |= self.members[q]
                q = self.link[q]
            self.ended[state, w] = out
        return self.ended[state, w]

    def matches(self, ids: list[int], least: int):
        """(position, length, template) wherever a template's own longest match ends, if it has `least` words.

        A template's match may end while a longer template's goes on: its longest run is that of the first state on the
        suffix links that it belongs to.
        """
        state = length = 0
        for i, w in enumerate([*ids, None]):
            if length >= least:
                yield from ((i - 1, n or length, k) for n, k in self._ended(state, w) if (n or length) >= least)
            while state > 0 and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state = length = 0


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]], phrases: dict[str, str]):
        parts = sorted((k, p) for k, t in templates.items() for p in ([t] if isinstance(t, str) else t))
        self.labels = [k for k, _ in parts]
        self.code: dict[bytes, int] = {}
        self.seqs = seqs = [[self.code.setdefault(w, len(self.code)) for w in p.encode().translate(WORDS).split()] for _, p in parts]
        self.size = [len(s) for s in seqs]
        self.places: list[dict] = [{} for _ in seqs]  # where each run of LEAST_RUN words stands in its template
        for own, s in zip(self.places, seqs):
            for i in range(len(s) - LEAST_RUN + 1):
                own.setdefault(tuple(s[i : i + LEAST_RUN]), []).append(i)
        self.phrases = [([self.code.setdefault(w, len(self.code)) for w in p.encode().split()], label) for p, label in phrases.items()]
        self.auto = Automaton(seqs)
        self.heads = {p[0] for p, _ in self.phrases}

    def scan(self, text: str):
        """n_words, base places [(start, label)], spans [(label, first word, end, share)]."""
        words = text.encode().translate(WORDS).split()
        ids = np.fromiter((self.code.get(w, -1) for w in words), dtype=np.int32, count=len(words))
        known = np.flatnonzero(ids >= 0)
        places, chains = [], {}
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) else []:
            own, at = ids[run].tolist(), int(run[0])
            if len(own) < 2:
                continue
            if not self.heads.isdisjoint(own):
                for p, label in self.phrases:
                    n = len(p)
                    places += [(at + i, label) for i in range(len(own) - n + 1) if own[i] == p[0] and own[i : i + n] == p]
            if len(own) < LEAST_RUN:
                continue
            for end, n, k in self.auto.matches(own, LEAST_RUN):
                chain = chains.setdefault(k, [])
                start, stop = at + end - n + 1, at + end + 1
                run, seq = own[end - n + 1 : end + 1], self.seqs[k]
                stands = [p for p in self.places[k][tuple(run[:LEAST_RUN])] if seq[p : p + n] == run]
                # a chain goes on at the next place of the template; words that it already has count no more
                if chain and start - chain[-1][1] <= GAP and (on := [p for p in stands if p + n > chain[-1][3]]):
                    last, p = chain[-1], on[0]
                    last[2] += p + n - max(p, last[3])
                    last[1], last[3] = max(stop, last[1]), p + n
                else:
                    chain.append([start, stop, n, stands[0] + n])
        spans = [(self.labels[k], s, e, n / self.size[k]) for k, c in chains.items() for s, e, n, _ in c if n >= LEAST_SHARE * self.size[k]]
        return len(words), sorted(places), sorted(spans, key=lambda s: (s[1], -s[3], s[0]))


def scan(docs: DataFrame, templates: dict[str, str | list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, base (places), spans: one row per document, no shuffle."""
    kind = "doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<struct<label:string,first_word:long,end_word:long,share:double>>"
    base_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_t = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in batches:
            n, base, spans = [], [], []
            for t in b.column(1).to_pylist():
                count, places, found = scanner.scan(t or "")
                n.append(count)
                base.append([{"word": w, "label": x} for w, x in places])
                spans.append([{"label": x, "first_word": s, "end_word": e, "share": share} for x, s, e, share in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(base, base_t), pa.array(spans, span_t)], ["doc_id", "n_words", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    share = F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("base") > 0, F.greatest(share, F.lit(0.5))).otherwise(share).alias("score"),
    )
