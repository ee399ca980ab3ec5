"""Licence scan by a positional rare-token index.

Templates are licence notices and the sentences that open and close licence texts. A file that has all words of a
template's mandatory phrases is looked up by those of the template's words that it has and that the fewest documents of the
corpus have: their postings, less their places in the template, are intersected, and where two or more
agree on the template's place, but for a few words put in or left out, it is confirmed if the mandatory phrases
stand there. Base phrases are reported wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import cut, small_batches

# Phrases that give a label wherever they stand.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of public licence notices and texts (label, sentence, mandatory phrases), in lower case and without marks.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program", ["copy of the gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license version 2 0", "terms and conditions for use reproduction and distribution"]),
    ("artistic-2.0", "this program is distributed under the terms of the artistic license 2 0", ["artistic license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", ["provided with the distribution this software is provided by the copyright holders"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "to endorse or promote products derived from this software"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0 international"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights to this work", ["waived all copyright and related"]),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license as published by", "version 2 of the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by", "version 3 of the license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["use copy modify and or distribute this software"]),
    ("lgpl", "licensed under the gnu lesser general public license version", ["lesser general public license"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license as published by"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license version 1 1"]),
    ("spdx", "spdx license identifier", ["spdx license identifier"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("wtfpl", "do what the fuck you want to public license", ["do what the fuck you want to"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages"]),
]

#: Rare words of a template that a file is looked up by, how many of them must agree on its place, and by how many words they may be off.
RARE_WORDS = 4
AGREE = 2
DRIFT = 3


@dataclass
class Index:
    """Word numbers, the templates and phrases in them, and how many documents have each word."""

    hashes: np.ndarray
    templates: list[tuple[str, np.ndarray, list[np.ndarray]]]
    phrases: list[tuple[str, np.ndarray]]
    documents: np.ndarray


def vocabulary(templates=TEMPLATES, phrases=BASE_PHRASES) -> Index:
    """The index before any document was counted."""
    words = sorted({w for t in templates for text in (t[1], *t[2]) for w in text.split()} | {w for p in phrases for w in p.split()})
    raw = np.array([W.word_hash(w.encode()) for w in words], dtype=np.uint64)
    order = np.argsort(raw)
    number = {words[k]: i for i, k in enumerate(order.tolist())}
    seq = lambda text: np.array([number[w] for w in text.split()])
    return Index(raw[order], [(label, seq(text), [seq(p) for p in must]) for label, text, must in templates], [(label, seq(p)) for p, label in phrases.items()], np.zeros(len(raw), np.int64))


def _numbers(hashes: np.ndarray, block: W.Block) -> np.ndarray:
    """Each word's number among ``hashes``, -1 if it is not one."""
    hint = np.zeros(1 << 16, dtype=bool)
    hint[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(block.hash), -1, dtype=np.int32)
    at = np.flatnonzero(hint[(block.hash & np.uint64(0xFFFF)).astype(np.int64)])
    n = np.minimum(np.searchsorted(hashes, block.hash[at]), len(hashes) - 1)
    out[at] = np.where(hashes[n] == block.hash[at], n, -1)
    return out


def _counter(hashes: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("licenses")
        total = np.zeros(len(hashes), dtype=np.int64)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                block = W.split(part.column(0), W.ALNUM, fold=True)
                number = _numbers(hashes, block)
                known = np.flatnonzero(number >= 0)
                cell = np.unique((np.searchsorted(block.first, known, side="right") - 1) * len(hashes) + number[known])
                total += np.bincount(cell % len(hashes), minlength=len(hashes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["word", "n"])

    return count


def _places(seq: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Where ``seq`` stands in ``number``."""
    n = len(number) - len(seq) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(number[:n] == seq[0])
    for k in range(1, len(seq)):
        at = at[number[at + k] == seq[k]]
    return at


def _in_order(seq: np.ndarray, number: np.ndarray) -> int:
    """The most words of ``seq`` that stand in ``number`` in the same order."""
    best = np.zeros(len(number) + 1, dtype=np.int64)
    for w in seq.tolist():
        match = np.where(number == w, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], match))
    return int(best[-1])


def _template_at(index: Index, t: int, number: np.ndarray, places: dict[int, np.ndarray]) -> list[tuple[int, float]]:
    """Confirmed places of one template in a file's word numbers, with the share of its words that stand there in order; ``places`` has the file's postings."""
    _, seq, must = index.templates[t]
    held = sorted({w for w in seq.tolist() if w in places}, key=lambda w: (index.documents[w], w))[:RARE_WORDS]
    votes = [(places[w][:, None] - np.flatnonzero(seq == w)[None]).ravel() for w in held]
    word = np.repeat(np.arange(len(votes)), [len(x) for x in votes])
    at = np.concatenate(votes)
    order = np.argsort(at, kind="stable")
    at, word = at[order], word[order]
    need = min(AGREE, len(set(seq.tolist())))
    found: list[tuple[int, float]] = []
    last = None
    for k, upto in enumerate(np.searchsorted(at, at + DRIFT, side="right").tolist()):
        place = int(at[k])
        if (last is not None and place <= last + DRIFT) or len(set(word[k:upto].tolist())) < need:
            continue
        around = number[max(0, place - DRIFT) : place + len(seq) + 2 * DRIFT]
        if all(len(_places(m, around)) for m in must):
            found.append((max(0, place), _in_order(seq, around) / len(seq)))
            last = place
    return found


def _scanner(index: Index, full: bool):
    needed = [np.unique(np.concatenate(must)) for _, _, must in index.templates]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("licenses")
        for batch in batches:
            for part in W.pieces(batch, "text"):
                block = W.split(part.column(1), W.ALNUM, fold=True)
                number = _numbers(index.hashes, block)
                known = np.flatnonzero(number >= 0)
                has = np.zeros((block.rows, len(index.hashes)), dtype=bool)
                has[np.searchsorted(block.first, known, side="right") - 1, number[known]] = True
                able: dict[int, list[int]] = {}
                for t, words in enumerate(needed):
                    for i in np.flatnonzero(has[:, words].all(axis=1)).tolist():
                        able.setdefault(i, []).append(t)
                base: dict[int, list[tuple[int, str]]] = {}
                for label, seq in index.phrases:
                    at = _places(seq, number)
                    row = np.searchsorted(block.first, at, side="right") - 1
                    inside = at + len(seq) <= block.first[row + 1]
                    for p, i in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                        base.setdefault(i, []).append((p - int(block.first[i]), label))
                out = []
                for i, (a, b) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)):
                    found: list[tuple[int, int, float]] = []
                    if i in able:
                        own = number[a:b]
                        at = np.flatnonzero(own >= 0)
                        at = at[np.argsort(own[at], kind="stable")]
                        words, first = np.unique(own[at], return_index=True)
                        postings = dict(zip(words.tolist(), np.split(at, first[1:]), strict=True))
                        found = [(t, p, share) for t in able[i] for p, share in _template_at(index, t, own, postings)]
                    places = base.get(i, [])
                    own_labels = sorted({x for _, x in places})
                    labels = sorted({*own_labels, *(index.templates[t][0] for t, _, _ in found)})
                    row = (b - a, len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(own_labels), ",".join(labels), max([1.0] * bool(places) + [s for _, _, s in found], default=0.0))
                    out.append((*row, [{"label": index.templates[t][0], "word": p, "share": s} for t, p, s in sorted(found)]) if full else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
                width = 8 if full else 7
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], kinds[k]) for k in range(width))], names=["doc_id", *names[:width]])

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` and, if ``full``, the notices, row by row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest of their starts (null without any), ``score`` is the largest share of a confirmed
    template's words that stand there in order, 1 for a base phrase, 0 for none. Word frequencies cover all
    documents. Null and empty texts have no words; whole texts count, however long. Rows may repeat and ids may be null; other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = vocabulary()
    counted = cut(rows.select("text").mapInArrow(_counter(index.hashes), "word int, n long"))
    for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():  # as many rows as the templates have words
        index.documents[r["word"]] = r["n"]
    more = ", notices array<struct<label:string,word:long,share:double>>" if full else ""
    return rows.mapInArrow(_scanner(index, full), f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double{more}")
