"""License texts found by conditional compression.

Candidate blocks are the words around each trigger word of a text, wherever lines break: for each
template as many on either side as it has, and half as many more. A block is compressed alone and
then with that template as raw dictionary. The bytes saved, against those that the template saves on its
own text, tell how much of it the block holds: templates of a share below ``LEAST_GAIN`` are out, the rest are
ranked by bytes saved. They are confirmed in that order by the exact differences of wording, and the
first that holds is the finding; the search goes on behind it. A template holds if

* the block has at least ``LEAST_COVER`` of its words in order,
* its slots, the names and version numbers that tell licenses apart, stand there unchanged and with
  nothing between them,
* no word of denial stands shortly before.

Templates that share too few words with the block to be confirmed are not compressed.

Map-only; each text is searched whole. Null and empty texts have no findings, nor do texts without a
trigger. Repeated rows give repeated findings, rows with a null id give findings with a null id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.words import slices

# Wording of well-known notices and texts. The part of a name before the slash is the license;
# slots are in brackets.
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU {} License] as published by "
    "the Free Software Foundation, either version [{}] of the License, or (at your option) any later version."
)
_MIT_TEXT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. [Neither the name of] the copyright holder [nor the names of] its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the [Apache License], Version [2.0].",
    "Apache-2.0/header": (
        'Licensed under the [Apache License], Version [2.0] (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-1.1": "Licensed under the [Apache License], Version [1.1].",
    "MIT": "Released under the [MIT License].",
    "MIT/permission": _MIT_TEXT,
    "MIT/text": _MIT_TEXT + _MIT_WARRANTY,
    "ISC": "Released under the [ISC License].",
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": "Released under the [BSD License].",
    "BSD/permission": _BSD_START,
    "BSD-2-Clause": "Released under the [BSD 2-Clause] License.",
    "BSD-2-Clause/text": _BSD_START + _BSD_TWO,
    "BSD-3-Clause": "Released under the [BSD 3-Clause] License.",
    "BSD-3-Clause/text": _BSD_START + _BSD_TWO + _BSD_THIRD,
    "GPL-2.0": "This work is licensed under the [GNU General Public License], version [2].",
    "GPL-2.0/header": _GNU_HEADER.format("General Public", "2"),
    "GPL-3.0": "This work is licensed under the [GNU General Public License], version [3].",
    "GPL-3.0/header": _GNU_HEADER.format("General Public", "3"),
    "LGPL-2.1": "This work is licensed under the [GNU Lesser General Public License], version [2.1].",
    "LGPL-3.0": "This work is licensed under the [GNU Lesser General Public License], version [3].",
    "LGPL-3.0/header": _GNU_HEADER.format("Lesser General Public", "3"),
    "AGPL-3.0": "This work is licensed under the [GNU Affero General Public License], version [3].",
    "AGPL-3.0/header": _GNU_HEADER.format("Affero General Public", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the [Mozilla Public License], v. [2.0].",
    "Unlicense": "This is free and unencumbered software released into the [public domain].",
    "CC-BY-4.0": "Licensed under [CC BY 4.0].",
    "CC-BY-SA-4.0": "Licensed under [CC BY-SA 4.0].",
    "CC-BY-ND-4.0": "Licensed under [CC BY-ND 4.0].",
    "CC-BY-NC-4.0": "Licensed under [CC BY-NC 4.0].",
    "CC-BY-NC-SA-4.0": "Licensed under [CC BY-NC-SA 4.0].",
    "CC-BY-NC-ND-4.0": "Licensed under [CC BY-NC-ND 4.0].",
    "CC-BY-4.0/long": "This work is licensed under a [Creative Commons Attribution 4.0] International License.",
    "CC-BY-SA-4.0/long": "This work is licensed under a [Creative Commons Attribution-ShareAlike 4.0] International License.",
    "CC-BY-NC-4.0/long": "This work is licensed under a [Creative Commons Attribution-NonCommercial 4.0] International License.",
    "reserved": "Copyright. [All rights reserved].",
    "reserved/alone": "[All rights reserved].",
}
_TRIGGER = re.compile(r"licen[cs]e|copyright|rights reserved|redistribut|hereby granted|free software|free and unencumbered|public license|creative commons", re.I)
_SIGNS = ("icens", "icenc", "opyright", "ICENS", "ICENC", "OPYRIGHT", "eserved", "RESERVED", "edistribut", "EDISTRIBUT", "hereby granted", "HEREBY GRANTED", "ree software", "REE SOFTWARE", "ree and", "REE AND", "reative", "REATIVE")
_WORD = re.compile(r"[\w.]+")
_DENIAL = {"not", "never", "nor", "neither", "cannot", "isn", "aren", "wasn", "no"}
LEAST_COVER = 0.8
#: A template must save at least this share of what it saves on its own text.
LEAST_GAIN = 0.25
#: Bytes are saved in the smallest blocks only by the level that finds matches of three bytes.
LEVEL = 19


def _plain(word: str) -> str:
    """Lower case, without a full stop; 3 for 3.0 and v3."""
    return re.sub(r"^v(?=\d)|(?<=\d)\.0$", "", word.lower().rstrip("."))


def wording(template: str) -> str:
    """The template without its marks."""
    return template.replace("[", "").replace("]", "")


def _slots(template: str) -> set[int]:
    """Places of the words that stand in brackets."""
    found, place = set(), 0
    for part in re.split(r"(\[[^\]]*\])", template):
        n = len(_WORD.findall(part))
        if part.startswith("["):
            found.update(range(place, place + n))
        place += n
    return found


class Scanner:
    """Templates with their compressors."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        texts = [wording(t) for t in templates.values()]
        self.words = [[_plain(w) for w in _WORD.findall(t)] for t in texts]
        self.slots = [_slots(t) for t in templates.values()]
        self.counts = [Counter(w) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.told = [
            zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_checksum=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for w in self.words
        ]
        self.own = [max(1, self.saved(w, k)) for k, w in enumerate(self.words)]

    def saved(self, block: list[str], k: int) -> int:
        """Bytes by which template k makes the block smaller."""
        data = " ".join(block).encode()
        return len(self.plain.compress(data)) - len(self.told[k].compress(data))

    def ranked(self, words: list[str], done: int, at: int) -> list[tuple[int, float, int, int, int]]:
        """Bytes saved, share of the template, template, first and last word: most saved first."""
        found = []
        for k, template in enumerate(self.words):
            reach = len(template) + max(4, len(template) // 2)
            low, high = max(done, at - reach), min(len(words), at + reach + 1)
            # words in common bound the cover
            if (self.counts[k] & Counter(words[low:high])).total() < LEAST_COVER * len(template):
                continue
            saved = self.saved(words[low:high], k)
            if saved >= LEAST_GAIN * self.own[k]:
                found.append((saved, saved / self.own[k], k, low, high))
        return sorted(found, key=lambda f: (-f[0], -f[1], f[2]))

    def denied(self, found: list[re.Match], words: list[str], done: int, first: int, upto: int) -> bool:
        """Whether a word of denial stands in the three words before the place or in it before its first slot."""
        for i in range(upto - 1, max(done, first - 3) - 1, -1):
            if i < first and found[i][0].endswith("."):
                return False
            if words[i] in _DENIAL:
                return True
        return False

    def confirm(self, text: str, found: list[re.Match], words: list[str], low: int, high: int, at: int, k: int):
        """Cover of template k around word ``at``, within the words ``low`` to ``high``, with the
        first and last word of its place and the differences there; None if it does not hold."""
        template, slots, done = self.words[k], self.slots[k], low
        while low <= at < high:
            runs = [r for r in SequenceMatcher(None, template, words[low:high], autojunk=False).get_matching_blocks() if r.size]
            if not runs:
                return None
            # as many words more of the same line as the template has before its first and after its last match
            first, last = low + runs[0].b, low + runs[-1].b + runs[-1].size
            for _ in range(runs[0].a):
                if first > low and "\n" not in text[found[first - 1].end() : found[first].start()]:
                    first -= 1
            for _ in range(len(template) - runs[-1].a - runs[-1].size):
                if last < high and "\n" not in text[found[last - 1].end() : found[last].start()]:
                    last += 1
            if first <= at < last:
                steps = SequenceMatcher(None, template, words[first:last], autojunk=False).get_opcodes()
                touched = any(
                    slots.intersection(range(a, b)) if a < b else a - 1 in slots and a in slots for tag, a, b, _, _ in steps if tag != "equal"
                )
                cover = sum(b - a for tag, a, b, _, _ in steps if tag == "equal") / len(template)
                if touched or cover < LEAST_COVER:
                    return None
                slot = min(slots, default=0)
                upto = next(first + c + slot - a for tag, a, b, c, _ in steps if tag == "equal" and a <= slot < b) if slots else first
                if self.denied(found, words, done, first, upto):
                    return None
                changes = [f"{' '.join(template[a:b])} -> {' '.join(words[first:last][c:d])}" for tag, a, b, c, d in steps if tag != "equal"]
                return cover, first, last, changes
            # another notice nearby: look again on this side of it
            longest = max(runs, key=lambda r: r.size)
            if first > at:
                high = low + longest.b
            else:
                low = low + longest.b + longest.size
        return None

    def findings(self, text: str):
        if not any(s in text for s in _SIGNS):
            return
        triggers = [m.start() for m in _TRIGGER.finditer(text)]
        if not triggers:
            return
        found = list(_WORD.finditer(text))
        words = [_plain(m[0]) for m in found]
        starts = [m.start() for m in found]
        done = 0
        for trigger in triggers:
            at = bisect.bisect_right(starts, trigger) - 1
            if at < done:
                continue
            for _, gain, k, low, high in self.ranked(words, done, at):
                confirmed = self.confirm(text, found, words, low, high, at, k)
                if confirmed:
                    cover, first, last, changes = confirmed
                    license, _, _ = self.names[k].partition("/")
                    yield license, starts[first], found[last - 1].end(), gain, cover, changes, self.names[k]
                    done = last
                    break


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per confirmed block: the id, ``license, start, end`` (code points, end exclusive),
    ``gain`` (bytes saved as a share of those that the template saves on its own text), ``cover``, ``differences``, each as
    template words -> words found, and ``template``."""
    templates = templates or TEMPLATES
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates)
        for batch in slices(batches, 1):
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for f in scanner.findings(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "license", "start", "end", "gain", "cover", "differences", "template"])

    return (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(run, f"id {key}, license string, start bigint, end bigint, gain double, cover double, differences array<string>, template string")
        .withColumnRenamed("id", id_column)
    )
