"""License scans by a positional rare-token index.

Each word of the licence templates has an inverse document frequency over the
templates.  The index holds the postings (template, position) of the rarer words.
A file's licence words of highest IDF are looked up first: a template stays only
if those that the file has can still reach the share of its weight that must line
up.  Its postings are then intersected by relative position about each place of
its first mandatory phrase.  What is left is aligned in order, so a word more or
less in a notice costs no more than itself, and all mandatory phrases must stand
there.  Templates are opening sentences and short notices, and windows of whole
texts, so a notice is found without its opening as well.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LETTER_OR_DIGIT, Words, slices, word_hash

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public licence notices, and the phrases each must hold.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons"]),
    ("cc", "licensed under creative commons attribution", ["creative commons"]),
    ("cc", "licensed under cc by", ["under cc by"]),
    ("cc", "cc by 4 0", ["cc by 4 0"]),
    ("cc", "cc by 3 0", ["cc by 3 0"]),
    *[("cc", f"cc by {kind} 4 0", [f"cc by {kind}"]) for kind in ("nc", "sa", "nd", "nc sa", "nc nd")],
    ("cc", "cc0 1 0 universal", ["cc0 1 0"]),
]
# Labels of the first word of an id in "SPDX-License-Identifier: id".
SPDX = {x: x for x in "mit apache gpl lgpl agpl bsd mpl isc unlicense zlib epl cc".split()} | {"bsl": "boost", "cc0": "cc"}
# Words after the first one of such an id, beside versions.
ENDINGS = frozenset("only later v1 v2 v3 clause by nc nd sa patent modern exception".split())
TEMPLATES += [(label, f"spdx license identifier {x}", [f"spdx license identifier {x}"]) for x, label in SPDX.items()]

# Whole texts of public licences, after their opening sentence.
TEXTS = {
    "mit": """to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
        and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd": """redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in
        binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission this software is provided by the copyright holders and
        contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
        exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
        any way out of the use of this software even if advised of the possibility of such damage""",
    "apache": """you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
        the license for the specific language governing permissions and limitations under the license""",
    "gpl": """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
        fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public
        license along with this program if not see http www gnu org licenses""",
    "isc": """provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
        all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable
        for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
        contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "zlib": """permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
        subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions
        must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any
        source distribution""",
    "unlicense": """anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain""",
}

#: Share of a template's IDF weight that must line up.
LEAST = 0.6
#: Words of a window of a whole text, from one to the next, and of the phrase that must stand in it.
WINDOW, STEP, PHRASE = 24, 8, 4
#: Words in more than this share of the templates aren't in the index.
RARE = 0.2


def _windows(texts: dict[str, str]) -> list[tuple[str, str, list[str]]]:
    """Overlapping windows of the texts as templates.

    The mandatory phrase is the one whose words the fewest windows hold; a window
    all of whose phrases another licence's text holds as well tells nothing.
    """
    cut = [(label, w[k : k + WINDOW]) for label, text in texts.items() for w in [text.split()] for k in range(0, max(1, len(w) - WINDOW + STEP), STEP)]
    held = Counter(x for _, w in cut for x in set(w))
    joined = {label: f" {' '.join(text.split())} " for label, text in texts.items()}
    out = []
    for label, w in cut:
        own = [w[k : k + PHRASE] for k in range(len(w) - PHRASE + 1)]
        own = [p for p in own if not any(f" {' '.join(p)} " in text for other, text in joined.items() if other != label)]
        if own:
            out.append((label, " ".join(w), [" ".join(min(own, key=lambda p: sum(held[x] for x in p)))]))
    return out


class Index:
    """Postings and weights of the templates' words."""

    def __init__(self, templates: list | None = None):
        templates = TEMPLATES + _windows(TEXTS) if templates is None else templates
        words = [t.split() for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        names = sorted({w for t in words for w in t} | {w for p in BASE for w in p.split()})
        at = {w: k for k, w in enumerate(names)}
        hashes = np.array([word_hash(w.encode()) for w in names], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        held = Counter(w for t in words for w in set(t))
        self.idf = np.array([math.log((len(words) + 1) / max(1, held[w])) for w in names])
        self.names = [w.encode() for w in names]
        self.text = [np.array([at[w] for w in t]) for t in words]
        self.weight = [self.idf[t] for t in self.text]
        self.phrases = [[np.array([at[w] for w in p.split()]) for p in must] for _, _, must in templates]
        self.offset = [int(_places(ids, must[0])[0]) for ids, must in zip(self.text, self.phrases)]
        # rare word -> its (template, place); each template's rare weight is what postings can give
        rare = np.array([held[w] <= RARE * len(words) for w in names])
        self.rare = rare
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.needed = []
        for t, ids in enumerate(self.text):
            for place in np.flatnonzero(rare[ids]):
                self.postings.setdefault(int(ids[place]), []).append((t, int(place)))
            self.needed.append(LEAST * self.weight[t].sum() - self.weight[t][~rare[ids]].sum() - 1e-9)
        self.spdx = np.array([at[w] for w in ("spdx", "license", "identifier")])
        self.base = {label: np.array([at[w] for w in p.split()]) for p, label in BASE.items()}

    def known(self, words: Words) -> np.ndarray:
        """The licence word at each place of a batch, -1 for others.

        Bytes of the rarer words, which decide, are compared as well.
        """
        k = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        ids = np.where(self.hashes[k] == words.hash, self.order[k], -1)
        for j in np.flatnonzero((ids >= 0) & (self.idf[ids] > 1.0)):
            if words.word(j) != self.names[ids[j]]:
                ids[j] = -1
        return ids


def _places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    last = len(ids) - len(phrase) + 1
    if last <= 0:
        return np.empty(0, dtype=np.int64)
    ok = np.ones(last, dtype=bool)
    for k, w in enumerate(phrase):
        ok &= ids[k : k + last] == w
    return np.flatnonzero(ok)


def _aligned(own: np.ndarray, weight: np.ndarray, span: np.ndarray) -> float:
    """The greatest share of a template's weight whose words stand in order in a span."""
    where: dict[int, list[int]] = {}
    for k in range(len(own) - 1, -1, -1):
        where.setdefault(int(own[k]), []).append(k)
    best = [0.0] * (len(own) + 1)  # by the last template place used, plus one
    for w in span.tolist():
        for k in where.get(w, ()):
            best[k + 1] = max(best[k + 1], max(best[: k + 1]) + float(weight[k]))
    return max(best) / float(weight.sum())


def _votes(index: Index, ids: np.ndarray) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Template -> (place, where its word stands in the file) of rare words, for the
    templates that these words and all common ones can still make up."""
    at = np.flatnonzero((ids >= 0) & index.rare[ids])
    order = at[np.argsort(ids[at], kind="stable")]
    found, begin = np.unique(ids[order], return_index=True)
    votes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for word, where in zip(found.tolist(), np.split(order, begin[1:])):
        for t, place in index.postings.get(word, ()):
            votes.setdefault(t, []).append((place, where))
    return {t: v for t, v in votes.items() if sum(index.weight[t][place] for place, _ in v) >= index.needed[t]}


def matches(index: Index, ids: np.ndarray) -> dict[str, float]:
    """Label -> best share of a template's weight that lines up in a file.

    A template lines up within its own length at the place of its first phrase,
    and half as much before and behind (two words at least).
    """
    found: dict[str, float] = {}
    seen: dict[tuple[int, bytes], float] = {}
    for t, votes in _votes(index, ids).items():
        own, label, offset = index.text[t], index.labels[t], index.offset[t]
        if found.get(label, 0.0) >= 1.0:
            continue
        starts = _places(ids, index.phrases[t][0]) - offset
        drift = max(2, len(own) // 2)
        met = np.zeros(len(starts))
        for place, where in votes:
            next_ = np.searchsorted(where, starts + place - drift)
            near = where[np.minimum(next_, len(where) - 1)]
            met += index.weight[t][place] * ((next_ < len(where)) & (near <= starts + place + drift))
        for at in starts[met >= index.needed[t]].tolist():
            span = ids[max(0, at - drift) : at + len(own) + drift]
            known = (t, span.tobytes())
            if known not in seen:  # a notice that a file repeats is aligned once
                seen[known] = _aligned(own, index.weight[t], span) if all(len(_places(span, p)) for p in index.phrases[t]) else 0.0
            if seen[known] >= LEAST and seen[known] > found.get(label, 0.0):
                found[label] = seen[known]
                if seen[known] >= 1.0:
                    break
    return found


def _expression(words: Words, at: int, end: int) -> set[str]:
    """Labels of a whole expression of ids ("GPL-2.0-only OR MIT") from its first word.

    An id goes on over versions and endings; ``or`` and ``and`` begin another one,
    ``with`` an exception, which names no licence.
    """
    found, starts = set(), True
    for k in range(at, end):
        word = words.word(k).decode("utf-8", "replace")
        if word in ("or", "and"):
            starts = True
        elif word == "later" and starts and found:
            starts = False  # "or later" is part of an id
        elif starts:
            if word not in SPDX:
                break
            found.add(SPDX[word])
            starts = False
        elif word == "with":
            starts = None
        elif starts is False and not (word in ENDINGS or word[:1].isdigit()):
            break
        elif starts is None and word.endswith("exception"):
            starts = False
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for a, b in slices(texts):
            words = Words(texts[a:b], LETTER_OR_DIGIT)
            known = index.known(words)
            rows = []
            for k in range(b - a):
                ids = known[words.first[k] : words.first[k + 1]]
                n, base, at = len(ids), [], []
                found: dict[str, float] = {}
                if (ids >= 0).any():
                    for label, phrase in index.base.items():
                        places = _places(ids, phrase)
                        at += places.tolist()
                        base += [label] * bool(len(places))
                    found = matches(index, ids)
                    for place in _places(ids, index.spdx).tolist():
                        begin = words.first[k] + place + len(index.spdx)
                        found |= dict.fromkeys(_expression(words, begin, words.first[k + 1]), 1.0)
                labels = sorted({*base, *found})
                score = max([*found.values(), LEAST / 2 if base else 0.0])
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(labels), min(1.0, score)))
            out = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=["doc_id", *schema.names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of anything beyond ASCII,
    A-Z lower-cased.  Base labels come from places of the base phrases; labels
    add what the index finds.  The score is the best aligned share of a
    template's weight, 0.3 for a base phrase that no template covers.  A null or
    empty text has no words, no labels ('') and score 0.  Rows may repeat.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
