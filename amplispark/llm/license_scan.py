"""License scan by conditional compression.

A block is the text around a cue word, whatever its line breaks and sentences: on
either side as many words as the longest template has and as many more as may
differ; blocks that overlap are one. Windows of a block are the places that hold
as many of a template's words as it has to; windows that overlap make a stretch.
A stretch is compressed alone and with each template as raw zstandard dictionary,
and the relative gain ranks the templates. In that order they are confirmed: by
the words that differ between the template and one of its windows, by the gain of
that window, which has to be large enough, and by the words that tell licenses of
a family apart (names, versions), which have to be those of the template, no less
and no more. The first that is confirmed has the stretch: its windows with fewest
words that differ are taken, and what is left beside them is compressed and ranked
again; so a block gives all its licenses.

The templates are notices, headers and short texts (license_texts.py); a license
that is only given by name in running prose, or whose text isn't among them, isn't
found. Every template has a word that CUES matches, and a place without a window
can't be confirmed, so no wording is passed over.

Nulls and edge cases: a null or empty text has no block. Equal gains go to the
first template by name. n_diff adds up all notices found, also those of one license,
which is named once. Every row gives one row; repeated rows stay; other
columns are ignored; an empty table gives an empty result. Whole texts are
scanned, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .license_texts import TELLING, TEXTS

#: Least relative gain of the compression, and most words that may differ, as a share of the template's.
MIN_GAIN, MAX_DIFF = 0.25, 0.2
#: Words of a template from which on windows are aligned as a whole instead of tried one by one.
LONG = 40
CUES = r"(?i)licen[sc]e|copyright|permission\W+(?:is|to)|public\W+domain|creative\W+commons|\bCC\W*(BY|0)|\bGPL|waived|redistribut"
WORDS = re.compile(r"[a-z0-9]+(?:[.-][0-9a-z]+)*")
#: ASCII only, so that places stay.
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BREAKS = re.compile(r"\s*\n[\s#*/;!%>|-]*|\s+")
#: Runs longer than any in a template; left out of what is ranked, as they would only hide the gain.
RUNS = re.compile(r"[^A-Za-z0-9]{33,}|[A-Za-z0-9]{65,}")


#: What may follow a version in an identifier.
LATER = re.compile(r"-(?:only|or-later)$")


def tokens(text: str) -> list[str]:
    return [LATER.sub("", w) for w in WORDS.findall(text.translate(LOWER))]


class Scanner:
    def __init__(self, texts=TEXTS):
        self.cue = re.compile(CUES)
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self.templates = []
        self.holding: dict[str, list[int]] = {}
        for i, (name, text) in enumerate(sorted(texts)):
            raw = zstandard.ZstdCompressionDict(text.encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = tokens(text)
            self.templates.append((name, words, Counter(words), self.telling(words), zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
            for w in set(words):
                self.holding.setdefault(w, []).append(i)
        longest = max((len(t[1]) for t in self.templates), default=0)
        self.reach = longest + int(MAX_DIFF * longest)
        self.known: dict[tuple[int, str], tuple[int, float] | None] = {}
        self.orders: dict[str, list[int]] = {}

    @staticmethod
    def telling(words: list[str]) -> set[str]:
        """The words that tell licenses apart; of an SPDX line the identifier."""
        if "spdx-license-identifier" in words:
            at = words.index("spdx-license-identifier") + 1
            return set(words[at : at + 1])
        return set(words) & TELLING

    def gains(self, text: str) -> list[float]:
        """Relative gain of a text with each template as dictionary, over the text alone."""
        raw = text.encode()
        alone = len(self.plain.compress(raw))
        return [1 - len(t[4].compress(raw)) / alone for t in self.templates]

    def ranked(self, text: str) -> list[int]:
        """All templates, that with the largest gain first."""
        text = RUNS.sub(" ", text)
        if text not in self.orders:
            if len(self.orders) > 2_000:
                self.orders.clear()
            gains = self.gains(text)
            self.orders[text] = sorted(range(len(gains)), key=lambda i: (-gains[i], i))
        return self.orders[text]

    def confirmed(self, i: int, text: str) -> tuple[int, float] | None:
        """Words that differ between template i and a window, and the gain, if both suffice."""
        if (i, text) in self.known:
            return self.known[i, text]
        _, template, _, marks, z = self.templates[i]
        got = None
        words = tokens(text)
        differing = self.differing(template, words)
        if differing <= self.may(template) and self.telling(words) == marks:
            raw = text.encode()
            gain = 1 - len(z.compress(raw)) / len(self.plain.compress(raw))
            got = (differing, gain) if gain >= MIN_GAIN else None
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[i, text] = got
        return got

    @staticmethod
    def differing(template: list[str], words: list[str]) -> int:
        """Words of the template not found in order, and words between those that are."""
        same = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return len(template)
        found = sum(m.size for m in same)
        between = same[-1].b + same[-1].size - same[0].b - found
        return len(template) - found + between

    @staticmethod
    def may(template: list[str]) -> int:
        """Words that may differ."""
        return int(MAX_DIFF * len(template))

    def windows(self, i: int, words: list[str], hits: list[int]):
        """First and last word of the windows that hold enough words of template i, in places of hits."""
        _, template, counted, marks, _ = self.templates[i]
        may = self.may(template)
        need, room = len(template) - may, len(template) + may
        if len(template) > LONG:
            yield from self.aligned(template, words, hits, counted, need, may)
            return
        for a in self.enough(words, hits, counted, room, need):
            left, got, missing = dict(counted), 0, set(marks)
            for b in range(a, len(hits)):
                if hits[b] - hits[a] >= room:
                    break
                w = words[hits[b]]
                if left[w]:
                    left[w] -= 1
                    got += 1
                    missing.discard(w)
                    if got >= need and not missing:
                        yield hits[a], hits[b]

    @staticmethod
    def enough(words: list[str], hits: list[int], counted: Counter, room: int, need: int):
        """Places in hits from which on room words hold need words of a template, each as often as it does at most."""
        seen: Counter = Counter()
        got = end = 0
        for a, first in enumerate(hits):
            while end < len(hits) and hits[end] < first + room:
                w = words[hits[end]]
                seen[w] += 1
                got += seen[w] <= counted[w]
                end += 1
            if got >= need:
                yield a
            w = words[first]
            got -= seen[w] <= counted[w]
            seen[w] -= 1

    @classmethod
    def aligned(cls, template: list[str], words: list[str], hits: list[int], counted: Counter, need: int, may: int):
        """Windows of a long template: where enough hits stand together, the part that aligns with it, without stray words at its ends.

        A stretch is wider than the template by twice what may differ, and the
        next begins a quarter of that further on, so one of them holds a whole notice.
        """
        room = len(template) + 2 * may
        after = 0  # where the next stretch may begin
        for a in cls.enough(words, hits, counted, room, need):
            first = hits[a]
            if first < after:
                continue
            end = first + room
            blocks = [m for m in SequenceMatcher(None, template, words[first:end], autojunk=False).get_matching_blocks() if m.size]
            while len(blocks) > 1 and blocks[1].b - blocks[0].b - blocks[0].size > blocks[0].size:
                blocks.pop(0)
            while len(blocks) > 1 and blocks[-1].b - blocks[-2].b - blocks[-2].size > blocks[-1].size:
                blocks.pop()
            low, high = first + blocks[0].b, first + blocks[-1].b + blocks[-1].size - 1
            found = sum(m.size for m in blocks) >= need
            if found:
                yield low, high
            after = high if found else first + max(1, may // 4)

    def notices(self, text: str) -> list[tuple[str, int]]:
        """License and words that differ of each notice in a block."""
        spans = list(WORDS.finditer(text.translate(LOWER)))
        words = [LATER.sub("", m[0]) for m in spans]
        hits: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            for i in self.holding.get(w, ()):
                hits.setdefault(i, []).append(k)

        def part(a: int, b: int) -> str:
            return BREAKS.sub(" ", text[spans[a].start() : spans[b].end()])

        taken, out = bytearray(len(words)), []
        left = self.stretches({(a, b, i) for i, at in hits.items() for a, b in self.windows(i, words, at)})
        while left:
            stretch = left.pop()
            free = [(a, b, i) for a, b, i in stretch if not any(taken[a : b + 1])]
            if len(free) < len(stretch):  # it was cut from one before it
                left += self.stretches(free)
                continue
            own: dict[int, list[tuple[int, int]]] = {}
            for a, b, i in stretch:
                own.setdefault(i, []).append((a, b))
            for i in self.ranked(part(stretch[0][0], max(b for _, b, _ in stretch))):
                places = own.pop(i, ())
                got = sorted((found[0], -found[1], a, b) for a, b in places if (found := self.confirmed(i, part(a, b))))
                if got:
                    for differing, _, a, b in got:
                        if differing == got[0][0] and not any(taken[a : b + 1]):
                            taken[a : b + 1] = b"\1" * (b + 1 - a)
                            out.append((self.templates[i][0], differing))
                    own[i] = places
                    left += self.stretches((a, b, i) for i, at in own.items() for a, b in at if not any(taken[a : b + 1]))
                    break
        return out

    def stretches(self, windows) -> list[list[tuple[int, int, int]]]:
        """Windows that overlap, together, the last stretch first; one that goes on and on is cut, so that the work stays linear."""
        out: list[list[tuple[int, int, int]]] = []
        end = -1
        for w in sorted(windows):
            if w[0] > end or w[0] >= out[-1][0][0] + 2 * self.reach:
                out.append([])
                end = -1
            out[-1].append(w)
            end = max(end, w[1])
        return out[::-1]

    def scan(self, text: str | None) -> tuple[int, list[str], int]:
        """Blocks, licenses in order of name, words that differ in all."""
        if not text or not self.cue.search(text):
            return 0, [], 0
        starts, ends = [], []
        for m in WORDS.finditer(text.translate(LOWER)):
            starts.append(m.start())
            ends.append(m.end())
        blocks: list[list[int]] = []
        for m in self.cue.finditer(text) if starts else ():
            first = max(bisect_right(starts, m.start()) - 1 - self.reach, 0)
            last = min(bisect_left(ends, m.end()) + self.reach, len(ends) - 1)
            if blocks and first <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], last)
            else:
                blocks.append([first, last])
        got = [x for a, b in blocks for x in self.notices(text[starts[a] : ends[b]])]
        return len(blocks), sorted({name for name, _ in got}), sum(n for _, n in got)


def scan_licenses(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_blocks, licenses (joined by commas) and n_diff of every row."""

    @F.arrow_udf("n_blocks long, licenses string, n_diff long")
    def scan(found: pa.Array) -> pa.Array:
        own = held("license_scan")
        scanner = own.get(texts) or own.setdefault(texts, Scanner(texts))
        got = [scanner.scan(x.as_py()) for x in found]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([",".join(x[1]) for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64())], ["n_blocks", "licenses", "n_diff"])

    got = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("got"))
    return got.select("doc_id", "got.n_blocks", "got.licenses", "got.n_diff")
