"""License scans by a generalised suffix automaton of licence words.

The templates' words go into one suffix automaton. A text is streamed through it once: at each word the automaton gives
the length of the longest stretch ending there that stands in some template (matching statistics). Maximal long
stretches are anchored at a place in a template, chained while they follow each other in both text and template, and a
chain that covers enough of a template gives its label. Where chains of several templates share most of their place in the text, as those of versions of
one licence do, the one that covers most words counts, then the one that covers the greater share of its template; equals all count. Base phrases
are found as places of consecutive words.

Defined cases: a null text counts as empty (no words, score 0, empty labels); overlapping places all count; repeated
rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import ascii_words, over_texts, texts_of

#: Phrases whose every place counts, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wording of public licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-2": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2.1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}

#: Words of a stretch that counts, words of text that a chain may step over, and the share of a template that gives its label.
LEAST_STRETCH, MOST_GAP, LEAST_SHARE = 4, 8, 0.6
WORDS = ascii_words()


class Automaton:
    """Suffix automaton of several word sequences; each state knows where in which sequence its stretches first end."""

    def __init__(self, templates: dict[str, str]):
        self.labels = sorted(templates)
        self.sizes = [len(templates[k].split()) for k in self.labels]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for n, label in enumerate(self.labels):
            last = 0
            for place, word in enumerate(templates[label].encode().split()):
                last = self.extend(last, word)
                self.ends[last].add((n, place))
        for state in sorted(range(1, len(self.next)), key=lambda k: -self.length[k]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        self.vocabulary = frozenset(w for step in self.next for w in step)

    def state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def split(self, p: int, q: int, word: bytes) -> int:
        """A state for the stretches of q that are as short as those coming from p."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self.split(last, self.next[last][word], word)
        new, p = self.state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, self.next[p][word], word)
        return new

    def stretches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(end in the text, length, state) of the maximal stretches of LEAST_STRETCH words or more."""
        found, state, length = [], 0, 0
        step, link, sizes = self.next, self.link, self.length
        known = self.vocabulary
        for place, word in enumerate(words):
            if word not in known:
                if length >= LEAST_STRETCH:
                    found.append((place, length, state))
                state = length = 0
                continue
            if word not in step[state]:
                if length >= LEAST_STRETCH:
                    found.append((place, length, state))
                while state and word not in step[state]:
                    state = link[state]
                    length = sizes[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
        if length >= LEAST_STRETCH:
            found.append((len(words), length, state))
        return found

    def chains(self, words: list[bytes]) -> dict[int, tuple[int, int, int]]:
        """For each template that a chain touches: (words covered, start, end in the text) of its best chain."""
        best: dict[int, tuple[int, int, int]] = {}
        open_chains: dict[int, list] = {}
        for end, length, state in self.stretches(words):
            start = end - length
            for n, place in sorted(self.ends[state]):
                chain = open_chains.get(n)
                first = place - length + 1
                if chain and start - chain[2] <= MOST_GAP and first > chain[3] - length and place > chain[3]:
                    fresh = min(length, place - chain[3])
                    chain[0], chain[2], chain[3] = chain[0] + fresh, end, place
                elif not chain or start - chain[2] > MOST_GAP or length > chain[0]:
                    chain = open_chains[n] = [length, start, end, place]
                if chain[0] > best.get(n, (0, 0, 0))[0]:
                    best[n] = (chain[0], chain[1], chain[2])
        return best


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(TEMPLATES)


def winners(spans: list[tuple[int, float, int, int, str]]) -> list[tuple[str, int, int]]:
    """(label, start, end) of chains (words covered, share of the template, start, end, label) that no better chain shares half of their place with."""
    kept: list[tuple] = []
    for own in sorted(spans, key=lambda s: (-s[0], -s[1], s[4])):
        better = (k for k in kept if k[:2] > own[:2] and 2 * (min(k[3], own[3]) - max(k[2], own[2])) > own[3] - own[2])
        if not any(better):
            kept.append(own)
    return sorted((label, start, end) for _, _, start, end, label in kept)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(text: str | None, model: Automaton, phrases: list[tuple[bytes, str]]) -> tuple:
    words = (text or "").encode().translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    n_base, ends, labels = 0, [], set()
    for phrase, label in phrases:
        at = line.find(phrase)
        if at >= 0:
            ends += [at, line.rfind(phrase)]
            labels.add(label)
        while at >= 0:
            n_base += 1
            at = line.find(phrase, at + 1)
    places = [line.count(b" ", 0, at) for at in (min(ends), max(ends))] if ends else [None, None]  # words are counted twice a text, not at each place
    best = model.chains(words)
    shares = {n: covered / model.sizes[n] for n, (covered, _, _) in best.items()}
    spans = winners([(best[n][0], share, *best[n][1:], model.labels[n]) for n, share in shares.items() if share >= LEAST_SHARE])
    found = {label for label, _, _ in spans}
    score = 1.0 if n_base else min(1.0, max(shares.values(), default=0.0))
    base = sorted(labels)
    return len(words), n_base, *places, ",".join(base), ",".join(sorted(labels | found)), score, ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, labels, score and covered template spans (label:start:end in words) of every text."""
    names = [x.strip().split()[0] for x in FIELDS.split(",")]

    def work():
        model = automaton()
        phrases = [(f" {k} ".encode(), v) for k, v in PHRASES.items()]
        return lambda texts: dict(zip(names, zip(*[scan(x, model, phrases) for x in texts]), strict=True))

    found = over_texts(texts_of(docs), work, FIELDS)
    return found.select("doc_id", "__found.*")
