"""License scans: a sparse word n-gram logistic regression over paragraphs, in DataFrame expressions.

The model is trained on the driver, on copies of the templates below with words left out and put around, and on
other text that shares their words; L1 shrinkage leaves few n-grams. Its classes are the licence families,
``unknown`` (a notice of another licence) and ``none`` (any other text). One temperature calibrates it, fitted to
templates that a first fit did not see. A family counts only if the paragraph also contains enough of one of its
templates, wherever in it, and meets the family's pattern; a notice that no template confirms is ``unknown``.

Every paragraph is scored. Only words of the model's or the templates' n-grams can be part of one, so a
paragraph's n-grams are read from its runs of such words: the result is that of all its n-grams.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices of public licences, by family.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD license."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GPL, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL, version 3."],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC license."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL, version 2.1."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
}
# Notices of licences of no family here.
NOTICES = [
    "All rights reserved.", "The software is sold under a commercial license.", "Licensed under the Example Proprietary License, version 7.", "This work is licensed under the terms of the seller.",
    "Licensed under the terms of the agreement.", "Use is subject to license terms.", "Released under a proprietary license.", "Distributed under a license of its own.", "License: proprietary", "SPDX-License-Identifier: LicenseRef-Own",
    "You may not copy, modify or distribute this software without written permission.", "This program is licensed to you for evaluation.", "Licensed under the community license agreement.", "See the license for details.",
]
# Text that shares words with notices, but is none.
OTHERS = [
    "Licensed premises are closed on Sunday.", "Please renew your driver license before it ends.", "Driver license renewals are due.",
    "The license fee is due each year.", "Released under the supervision of the board.", "Version 3 was released under pressure.", "The general public is welcome.", "A public license hearing was held.",
    "Version 2.0 of the file.", "Creative writing for the common people.", "Permission is granted to park here free of charge.", "You may not use this file.", "The source code of the program.", "International attribution of the work.", "Copyright by the author.",
    "It is one of the most used forms of the language, and is read in all parts of the world.", "This is free for any person who is in the city on the day of the event.", "The following is a list of the names of the people and the works that they made.",
    "Er ist mit dem Zug in die Stadt gefahren, und im August war es mit den anderen von hier an warm.", "Mit der Zeit kommt Rat, in der Not isst man mit allen.", "Elle a dit que les permissions de la ville sont sur la table et on an a pour les uns.",
    "No se puede decir que la casa de los padres es a la vez de todos en general.", "Come si dice in questo caso, non fare a meno del sole.", "He said that it was on the way, and that some of them had been there for an hour or two before it.",
    "In no event was the public informed of the use of the water.", "The above is not a limit to what may be done under the law.",
]
# What a licence is called in notices, with its SPDX name first. BSD is told apart by the document.
NAMES = {
    "AGPL-3.0": ["AGPL-3.0", "GNU Affero General Public License", "AGPL v3", "AGPLv3"],
    "Apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0"],
    "BSD": ["BSD", "BSD License"],
    "BSD-2-Clause": ["BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "CC-BY": ["CC-BY-4.0", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution Non-Commercial License"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution Share-Alike License"],
    "CC0": ["CC0-1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GPL-2.0", "GNU General Public License v2", "GPLv2", "GPL version 2"],
    "GPL-3.0": ["GPL-3.0", "GNU General Public License v3", "GPLv3", "GPL version 3"],
    "ISC": ["ISC", "ISC License"],
    "LGPL": ["LGPL-2.1", "LGPL-3.0", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL"],
    "MIT": ["MIT", "MIT License"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
}
FORMS = ["SPDX-License-Identifier: {}", "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "available under the {} license", "available under {}", "License: {}"]
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
# Paragraphs of licence bodies and headers.
BODIES = {
    "AGPL-3.0": [_GNU.format("program", "Affero ", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004", "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "GPL-2.0": [_GNU.format("program", "", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": [_GNU.format("program", "", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL": [_GNU.format("library", "Lesser ", "2.1"), _GNU.format("library", "Lesser ", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "The MIT License (MIT)",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released into the public domain under the Unlicense"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
}
for _family, _names in NAMES.items():
    TEMPLATES[_family] = list(dict.fromkeys([*TEMPLATES.get(_family, []), *BODIES.get(_family, []), *(f.format(n) for n in _names for f in FORMS)]))
# What a paragraph of a family has in its words, by a pattern; it tells versions and variants apart.
MUSTS = {
    "AGPL-3.0": r"\b(affero general public license|agpl(v3)?)\b",
    "Apache-2.0": r"\bapache (org licenses )?(software )?(license )?(version |v )?v?2\b|\bunless required by applicable law or agreed to in writing software distributed under the license\b",
    "BSD": r"\bredistributions? (and use in source|(of|in) (source|binary))|\bthis software is provided by the\b|\b(under( the)?( terms of the)?|identifier|license) bsd( license)?\b(?! (2|3|style|two|three))",
    "BSD-2-Clause": r"\b(bsd (2|two) clause|(2|two) clause bsd|simplified bsd)\b",
    "BSD-3-Clause": r"\b(bsd (3|three) clause|(3|three) clause bsd|(new|modified|revised) bsd|bsd style)\b|\bneither the names? of\b",
    "CC-BY": r"\b(cc by|creative commons attribution)\b(?! (nc|sa|nd|non|share|no))",
    "CC-BY-NC": r"\b(cc by nc|creative commons attribution non ?commercial)\b(?! (sa|nd|share|no))",
    "CC-BY-SA": r"\b(cc by sa|creative commons attribution share ?alike)\b",
    "CC0": r"\bcc0\b|\bassociated a work with this deed\b",
    "GPL-2.0": r"(?<!lesser )(?<!affero )(?<!library )\b(general public license|gpl)( [a-z]+){0,9}? v?2\b|\bgplv2\b",
    "GPL-3.0": r"(?<!lesser )(?<!affero )(?<!library )\b(general public license|gpl)( [a-z]+){0,9}? v?3\b|\bgplv3\b",
    "ISC": r"\bisc license|\b(under( the)?( terms of the)?|identifier|license) isc\b|\bpermission to use copy modify and (or )?distribute this software\b|\bis provided as is and the authors? disclaims?\b",
    "LGPL": r"\b((lesser|library) general public license|lgpl(v2|v3)?)\b",
    "MIT": r"\bmit license|\b(under( the)?( terms of the)?|identifier|license) mit\b|\bpermission is hereby granted free of charge\b|\bthe above copyright notice and this permission notice shall\b|\bsoftware is provided as is without warranty of any kind\b",
    "MPL-2.0": r"\b(mozilla public license|mpl) (version |v )?v?2\b",
    "EPL-2.0": r"\b(eclipse public license|epl) (version |v )?v?2\b",
    "BSL-1.0": r"\b(boost software license|bsl) (version |v )?v?1\b",
    "Unlicense": r"\bunlicense\b|\bfree and unencumbered software\b|\bfree to copy modify publish use compile sell or distribute this software\b",
}
# Of each pattern, words of which one is in whatever the pattern matches.
KEYS = {
    "AGPL-3.0": ["affero", "agpl", "agplv3"], "Apache-2.0": ["apache", "unless"], "BSD": ["redistribution", "redistributions", "provided", "bsd"], "BSD-2-Clause": ["bsd"], "BSD-3-Clause": ["bsd", "neither"],
    "BSL-1.0": ["boost", "bsl"], "CC-BY": ["cc", "creative"], "CC-BY-NC": ["cc", "creative"], "CC-BY-SA": ["cc", "creative"], "CC0": ["cc0", "deed"], "EPL-2.0": ["eclipse", "epl"],
    "GPL-2.0": ["public", "gpl", "gplv2"], "GPL-3.0": ["public", "gpl", "gplv3"], "ISC": ["isc", "permission", "disclaim", "disclaims"], "LGPL": ["lesser", "library", "lgpl", "lgplv2", "lgplv3"],
    "MIT": ["mit", "permission", "notice", "warranty"], "MPL-2.0": ["mozilla", "mpl"], "Unlicense": ["unlicense", "unencumbered", "compile"],
}
UNKNOWN, NONE = "unknown", "none"


def words(text: str) -> list[str]:
    import re

    return [w.replace("licence", "license") for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def word_ngrams(text: str, longest: int = 3) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)}


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]  # by n-gram, already divided by the temperature
    bias: tuple[float, ...]


def perturbed(text: str, copies: int, rng: np.random.Generator) -> list[str]:
    """The text, and copies of it with some words left out and others put around."""
    out = [text]
    for _ in range(copies - 1):
        w = [x for x in words(text) if rng.random() > 0.04 or x in ("1", "2", "3", "nc", "sa")]
        pad = [f"w{i}" for i in rng.integers(0, 200, rng.integers(0, 8))]
        out.append(" ".join(pad[: len(pad) // 2] + w + pad[len(pad) // 2 :]))
    return out


def training_rows(copies: int, rng: np.random.Generator) -> list[tuple[str, str, bool]]:
    """(text, class, whether it is made of a template that is held back for the temperature)."""
    rows = []
    for family, texts in [*sorted(TEMPLATES.items()), (UNKNOWN, NOTICES), (NONE, OTHERS)]:
        for k, text in enumerate(texts):
            rows += [(t, family, k % 5 == 4) for t in perturbed(text, copies // 2 if family in (UNKNOWN, NONE) else max(4, 2 * copies // len(texts)), rng)]
    every = [t for ts in TEMPLATES.values() for t in ts]
    rows += [(" ".join(rng.permutation(words(t))), NONE, k % 5 == 4) for k, t in enumerate(every)]  # shuffled notices say nothing
    pool = sorted({w for t in every for w in words(t)})
    # nor do their words alone, in short texts and in long ones
    rows += [(" ".join(rng.choice(pool, int(2 ** rng.uniform(0, 8)))), NONE, k % 5 == 4) for k in range(20 * copies)]
    plain = [w for t in OTHERS for w in words(t)]
    rows += [(" ".join(rng.choice(plain, int(2 ** rng.uniform(2, 9)))), NONE, k % 5 == 4) for k in range(10 * copies)]
    return rows


class _Rows:
    """A sparse 0/1 matrix of texts and n-grams."""

    def __init__(self, texts: list[str], at: dict[str, int]):
        found = [sorted(at[g] for g in word_ngrams(t) if g in at) + [len(at)] for t in texts]  # the last column is one
        self.cols = np.concatenate([np.array(f) for f in found])
        self.begin = np.r_[0, np.cumsum([len(f) for f in found])[:-1]]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        order = np.argsort(self.cols, kind="stable")
        self.by_col, self.used = owner[order], np.unique(self.cols)
        self.col_begin = np.searchsorted(self.cols[order], self.used)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.cols], self.begin, axis=0)

    def transposed_times(self, d: np.ndarray, out: np.ndarray) -> np.ndarray:
        out[self.used] = np.add.reduceat(d[self.by_col], self.col_begin, axis=0)
        return out


def fitted(texts: list[str], y: np.ndarray, at: dict[str, int], n_classes: int, l1: float, rate: float, rounds: int) -> np.ndarray:
    """Weights by n-gram, the biases in the last row, by proximal gradient steps."""
    x, gold = _Rows(texts, at), np.eye(n_classes)[y]
    w, grad = np.zeros((len(at) + 1, n_classes)), np.zeros((len(at) + 1, n_classes))
    w[-1, -1] = 1.0
    for _ in range(rounds):
        z = x.times(w)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.transposed_times((p / p.sum(axis=1, keepdims=True) - gold) / len(texts), grad)
        w[:-1] -= rate * 10 * g[:-1]
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
        w[-1, :-1] -= rate * g[-1, :-1]
    return w


@functools.lru_cache(maxsize=1)
def trained(copies: int = 16, l1: float = 0.003, rate: float = 0.5, rounds: int = 160, seed: int = 3) -> LicenseModel:
    from .language_id import fit_temperature

    rows = training_rows(copies, np.random.default_rng(seed))
    classes = (*sorted(TEMPLATES), UNKNOWN, NONE)
    number = {c: i for i, c in enumerate(classes)}
    y, back = np.array([number[c] for _, c, _ in rows]), np.array([b for _, _, b in rows])
    grams = sorted({g for t in [*NOTICES, *OTHERS, *(t for ts in TEMPLATES.values() for t in ts)] for g in word_ngrams(t)})
    at = {g: i for i, g in enumerate(grams)}
    some = lambda flags: [t for (t, _, _), f in zip(rows, flags, strict=True) if f]
    first = fitted(some(~back), y[~back], at, len(classes), l1, rate, rounds)
    t = fit_temperature(_Rows(some(back), at).times(first), y[back])
    w = fitted(some(back | ~back), y, at, len(classes), l1, rate, rounds)
    return LicenseModel(classes, {g: tuple(w[i] / t) for g, i in at.items() if np.abs(w[i]).max() > 0}, tuple(w[-1] / t))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), "[^a-z0-9]+"), lambda w: w != "")


def double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ngrams_within(w: Column, vocabulary: list[str], longest: int = 3) -> Column:
    """Distinct n-grams of an array of words that hold words of the vocabulary alone."""
    masked = F.transform(w, lambda x: F.when(x.isin(vocabulary), x).otherwise(""))

    def of_length(run: Column, n: int) -> Column:
        at = F.when(F.size(run) >= n, F.sequence(F.lit(1), F.size(run) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(run, i, n), " "))

    def of(m: Column) -> Column:
        # unknown words are blanks, so that two blanks part the runs of known ones; a run of one word has no longer n-gram
        runs = F.filter(F.transform(F.split(F.array_join(m, " "), "  +"), lambda r: F.trim(r)), lambda r: r.contains(" "))
        longer = F.transform(F.transform(runs, lambda r: F.split(r, " ")), lambda r: F.concat(*[of_length(r, n) for n in range(2, longest + 1)]))
        return F.array_distinct(F.concat(F.filter(F.array_distinct(m), lambda x: x != ""), F.flatten(longer)))

    return F.element_at(F.transform(F.array(masked), of), 1)


def scan_licenses(docs: DataFrame, least_score: float = 0.5, least_likeness: float = 0.5) -> DataFrame:
    """doc_id, n_paragraphs, paragraphs (array of number, family, score, likeness) for each row (doc_id, text).

    Paragraphs are what blank lines part; those without a character that is not white space don't count. Each is
    scored. Its likeness to a template is the part of the template's 2- and 3-grams that it has, wherever they stand
    in it, and the score is that of the words it has of the template. It is listed once with each family whose
    pattern it meets, whose best template has a likeness of ``least_likeness`` and a score of ``least_score``; with
    none, once as ``unknown`` (score: how sure it is a notice at all) if ``none`` is not its likeliest class. BSD
    paragraphs carry the number of clauses that their document tells, or none.

    A null or empty text has no paragraphs, an empty table gives no row; texts of any length are read whole. Equal
    scores: the templates' order. Rows are kept one by one, repeated ones too; other columns are ignored.
    """
    model = trained()
    # one JSON literal each, which the optimizer folds
    weights = F.from_json(F.lit(json.dumps({g: list(w) for g, w in sorted(model.weights.items())})), "map<string,array<double>>")
    order = sorted(TEMPLATES)
    families = [{"family": k, "templates": [sorted(word_ngrams(t)) for t in TEMPLATES[k]]} for k in order]
    templates = F.from_json(F.lit(json.dumps(families)), "array<struct<family:string,templates:array<array<string>>>>")
    known = {g for k in families for t in k["templates"] for g in t} | set(model.weights)
    keys = sorted({k for ks in KEYS.values() for k in ks})
    vocabulary, weighed = sorted({w for g in [*known, *keys] for w in g.split(" ")}), sorted(model.weights)
    names = F.from_json(F.lit(json.dumps(model.classes)), "array<string>")
    none = len(model.classes) - 1

    def logits(grams: Column) -> Column:
        found = F.filter(F.transform(grams, lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull())
        return F.aggregate(found, double_array(model.bias), lambda s, w: F.zip_with(s, w, lambda a, b: a + b))

    def score_of(z: Column, top: Column) -> Column:
        return F.exp(top - F.array_max(z)) / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(z)))

    # one step after another, each on what the one before has found of a paragraph
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    worded = F.transform(parts, lambda p, i: F.struct(i.alias("number"), split_words(p).alias("w")))
    marked = F.transform(worded, lambda p: F.struct(p["number"].alias("number"), p["w"].alias("w"), ngrams_within(p["w"], vocabulary).alias("grams")))

    def own(p: Column) -> Column:
        """The paragraph with the places of the families whose pattern it meets; one that has no key of a pattern can't meet it."""
        line = F.array_join(p["w"], " ")
        told = lambda ks: F.arrays_overlap(p["grams"], F.from_json(F.lit(json.dumps(ks)), "array<string>"))
        hits = F.filter(F.array(*[F.when(told(KEYS[k]) & line.rlike(MUSTS[k]), F.lit(i + 1)) for i, k in enumerate(order)]), lambda i: i.isNotNull())
        third = told(["neither"]) & line.rlike(r"\bneither the names? of\b")
        clause = F.when(third, 3).when(told(["redistributions"]) & line.rlike(r"\bredistributions in binary form\b"), 2).otherwise(0)
        return F.struct(p["number"].alias("number"), p["grams"].alias("grams"), hits.alias("own"), clause.alias("clause"))

    def best(p: Column) -> Column:
        """Its own families, each with its best template's likeness and the score of the n-grams found of it."""

        def part(t: Column) -> Column:
            both = F.array_intersect(t, p["grams"])
            longer = lambda a: F.size(F.filter(a, lambda g: g.contains(" ")))
            return F.struct((longer(both) / longer(t)).alias("likeness"), both.alias("grams"))

        of = F.transform(F.transform(p["own"], lambda i: F.element_at(templates, i)), lambda f: F.struct(f["family"].alias("family"), F.array_max(F.transform(f["templates"], part)).alias("best")))
        of = F.transform(of, lambda f: F.struct(f["family"].alias("family"), f["best"]["likeness"].alias("likeness"), logits(f["best"]["grams"]).alias("z")))
        return F.struct(p["number"].alias("number"), p["clause"].alias("clause"), logits(F.filter(p["grams"], lambda g: g.isin(weighed))).alias("z"), of.alias("families"))

    rows = docs.select("doc_id", F.size(parts).cast("long").alias("n_paragraphs"), F.transform(F.transform(F.filter(marked, lambda p: F.size(p["grams"]) > 0), own), best).alias("found"))
    clauses = F.coalesce(F.array_max(F.transform("found", lambda p: p["clause"])), F.lit(0))
    rows = rows.withColumn("bsd", F.when(clauses == 3, "BSD-3-Clause").when(clauses == 2, "BSD-2-Clause").otherwise("BSD"))

    def compared(p: Column) -> Column:
        def entry(family, score, likeness) -> Column:
            return F.struct(p["number"].alias("number"), family.alias("family"), score.alias("score"), likeness.cast("double").alias("likeness"))

        def judged(f: Column) -> Column:
            own = F.element_at(f["z"], F.array_position(names, f["family"]).cast("int"))
            return entry(F.when(f["family"] == "BSD", F.col("bsd")).otherwise(f["family"]), score_of(f["z"], own), f["likeness"])

        every = F.transform(p["families"], judged)
        sure = F.filter(every, lambda e: (e["score"] >= least_score) & (e["likeness"] >= least_likeness))
        like = F.coalesce(F.array_max(F.transform(every, lambda e: e["likeness"])), F.lit(0.0))
        plain = p["z"][none]
        unsure = F.when(plain < F.array_max(p["z"]), F.array(entry(F.lit(UNKNOWN), 1 - score_of(p["z"], plain), like))).otherwise(F.array().cast(kind))
        return F.when(F.size(sure) > 0, sure).otherwise(unsure)

    kind = "array<struct<number:int,family:string,score:double,likeness:double>>"
    return rows.select("doc_id", "n_paragraphs", F.coalesce(F.flatten(F.transform("found", compared)), F.array()).cast(kind).alias("paragraphs"))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs (all of them are scored), those with a licence and those with an unknown one, and the families."""
    from .common import table

    found = scan_licenses(table(spark, sf_dir, "documents"))
    sure = F.filter("paragraphs", lambda p: p["family"] != UNKNOWN)
    count = lambda ps: F.size(F.array_distinct(F.transform(ps, lambda p: p["number"]))).cast("long")
    return found.select(
        "doc_id", "n_paragraphs", count(sure).alias("n_license"), count(F.filter("paragraphs", lambda p: p["family"] == UNKNOWN)).alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
    )
