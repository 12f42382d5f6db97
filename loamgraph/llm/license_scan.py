"""Licence detection through a positional index of rare licence words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Template:
    """A licence text; ``keys`` are phrases of it without which a place is not this licence."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Phrases that count wherever their words stand consecutively.
BASE = tuple(
    Template(label, phrase, (phrase,), True)
    for label, phrase in [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
)
TEMPLATES = BASE + (
    Template(
        "gpl-3.0",
        "licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge",),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    # whole notices
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice shall be included in all copies or substantial portions of the software the software is"
        " provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright"
        " holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies the software is provided"
        " as is and the author disclaims all warranties with regard to this software including all implied warranties of"
        " merchantability and fitness",
        ("permission to use copy modify and or distribute this software", "the author disclaims all warranties"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by"
        " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language"
        " governing permissions and limitations under the license",
        ("apache license version 2 0", "unless required by applicable law"),
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later"
        " version this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for"
        " more details",
        ("free software foundation either version 3 of the license",),
    ),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 2 of the license or at your option any later"
        " version this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for"
        " more details",
        ("free software foundation either version 2 of the license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
        " compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
        " commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
)
#: The least share of a template's IDF weight that must be in place.
LEAST_SCORE = 0.5

#: Every byte that isn't in a word becomes a space: words are 0-9, a-z, A-Z lower-cased, all of U+0080 on.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


@dataclass
class Index:
    """Postings (template, position) of all words of the templates, and which of them is the rarest of each template's key
    phrases: where that one isn't, the template isn't."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    rarest: list[tuple[bytes, int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    keys: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)

    def __post_init__(self):
        for n, template in enumerate(self.templates):
            words = words_of(template.text)
            for i, w in enumerate(words):
                self.postings.setdefault(w, []).append((n, i))
            spots = []
            for key in map(words_of, template.keys):
                spots.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
            at = max((i for i, key in spots for i in range(i, i + len(key))), key=lambda i: (self.idf[words[i]], words[i]))
            self.rarest.append((words[at], at))
            self.sizes.append(len(words))
            self.keys.append(spots)
        self.weights = [sum(self.idf[w] for w in words_of(t.text)) for t in self.templates]

    def _keys_stand(self, words: list[bytes], n: int, start: int) -> bool:
        return all(start + i >= 0 and words[start + i : start + i + len(key)] == key for i, key in self.keys[n])

    def matches(self, words: list[bytes], least: float) -> list[dict]:
        """Places of templates among a file's words, as label, start, stop, score, base.

        The file's licence words are looked up by falling IDF. A place of a template is a start that its postings give by
        their positions: it opens with the template's rarest word, if the key phrases stand whole there, and each other
        word whose posting gives the same start adds its IDF.
        """
        spots: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                spots.setdefault(w, []).append(i)
        places: dict[int, dict[int, list]] = {}
        order = sorted(spots, key=lambda w: (-self.idf[w], w))
        for w in order:
            for n, at in self.postings[w]:
                if self.rarest[n] == (w, at) and (starts := [i - at for i in spots[w] if self._keys_stand(words, n, i - at)]):
                    places[n] = {start: [0.0, self.sizes[n], -1] for start in starts}
        if not places:
            return []
        for w in order:
            for n, at in self.postings[w]:
                if n in places:
                    found, weight = places[n], self.idf[w]
                    near = spots[w] if len(spots[w]) <= len(found) else [s + at for s in found]
                    for i in near:
                        place = found.get(i - at)
                        if place is not None and 0 <= i < len(words) and words[i] == w:
                            place[0] += weight
                            place[1], place[2] = min(place[1], at), max(place[2], at)
        out = []
        for n in sorted(places):
            for start, (weight, first, last) in sorted(places[n].items()):
                score = min(1.0, weight / self.weights[n])
                if score >= least:
                    out.append({"label": self.templates[n].label, "start": start + first, "stop": start + last + 1, "score": score, "base": self.templates[n].base})
        return out


def license_word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF over all of ``docs`` of each word that the templates have; what comes back is bounded by them."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = frozenset(vocabulary), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen[b""] += 1
                seen.update(known.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    rows = (
        docs.select(text_or_empty().alias("text"))
        .mapInArrow(counted, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found = {bytes(r.word): r.n for r in rows}
    return {w: math.log((found.get(b"", 0) + 2) / (found.get(w, 0) + 1)) for w in vocabulary}


MATCHES = "array<struct<label:string,start:long,stop:long,score:double,base:boolean>>"


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_score: float = LEAST_SCORE
) -> DataFrame:
    """Licence places in each row of ``docs`` (doc_id, text, ...).

    Returns doc_id, n_words and matches: label, start, stop (in words from 0), score (the share of
    the template's IDF weight in place, 0 to 1) and base. A template of which one word is in each
    key phrase at least is found wherever its key phrases stand whole and enough of the rest
    stands where it should. A null text is empty, with no words and no matches. Rows are
    independent: repeated rows and null ids stay. No rows give none; other columns are ignored.
    """
    idf = license_word_idf(docs, templates)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            (
                "matches",
                pa.list_(
                    pa.struct(
                        [("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]
                    )
                ),
            ),
        ]
    )

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for batch in batches:
            counts, places = [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append(index.matches(words, least_score))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(places, schema.field("matches").type)], schema=schema
            )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(scanned, f"doc_id long, n_words long, matches {MATCHES}")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Per row of a scan: the base phrases' places and the labels found."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
