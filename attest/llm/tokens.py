"""Token ids of whole text columns under a byte-level BPE tokenizer file.

The tokenizer's own split into words is done for a whole batch at once on its code points; its BPE model then sees every
distinct word of a task once. With `marks`, ids equal those of `Tokenizer.encode(text, add_special_tokens=False)`; without,
those of a tokenizer with `encode_special_tokens`, which spells out the contents of its added tokens.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from attest.llm.hashing import coded_hashes, scramble, text_column

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSEEN = 0, 1, 2, 3, 9
_MOST_WORDS = 1_500_000


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    take the letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """One per task; keeps the ids of the words it has met, up to a fixed number of words."""

    def __init__(self, path: str, marks: bool = False):
        tokenizer = self.tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder() if marks else {}
        self.marks = {token.content: k for k, token in added.items() if token.content}
        # tokens that look at what stands around them are left to the tokenizer itself
        self.around = any(t.single_word or t.lstrip or t.rstrip or (t.normalized and tokenizer.normalizer) for t in added.values())
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")")
        self.split, self.model = tokenizer.pre_tokenizer, tokenizer.model
        self.letters = _byte_letters()
        self.kinds = np.full(0x110000, _UNSEEN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _kind(self, point: int) -> int:
        """How the tokenizer's own splitter classes a code point: it extends a run of its own kind."""
        for sign, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            if len(self.split.pre_tokenize_str(sign + chr(point))) == 1:
                return kind
        return _SPACE

    def _starts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places where words start. `at`: where texts start, and the end."""
        n = len(points)
        new = np.unique(points)
        for point in new[self.kinds[new] == _UNSEEN].tolist():
            self.kinds[point] = self._kind(point)
        kind = self.kinds[points]
        opens = np.zeros(n + 1, bool)  # a text starts here
        opens[at] = True
        run = np.ones(n, bool)
        run[1:] = (kind[1:] != kind[:-1]) | opens[1:n]
        space = kind == _SPACE
        blank = points == 0x20
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1] & ~opens[1:n]
        starts = run & (space | ~after_blank)
        # the last white space before a word stands alone or leads the word
        lead = np.zeros(n, bool)
        lead[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
        starts |= lead
        # short forms after an apostrophe
        for i in np.flatnonzero((points == 0x27) & run & ~after_blank).tolist():
            end = int(at[np.searchsorted(at, i, side="right")])
            if i + 1 >= end or opens[i + 1]:
                continue
            tail = "".join(map(chr, points[i + 1:min(i + 3, end)].tolist()))
            size = 1 if tail[:1] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
            if size:
                starts[i + 1] = False
                stop = i + 1 + size
                if stop < end and kind[stop] == _LETTER:
                    starts[stop] = True
        return np.flatnonzero(starts)

    def _learn(self, codes: np.ndarray, words: list[str]) -> None:
        ids = []
        for word in words:
            mapped = "".join(map(self.letters.__getitem__, word.encode()))
            ids.append([token.id for token in self.model.tokenize(mapped)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for each in ids for x in each), np.uint32, int(sizes.sum()))
        first = len(self.pool) + np.cumsum(sizes) - sizes
        known = np.concatenate([self.known, codes])
        order = np.argsort(known)
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null texts are empty."""
        marked = np.zeros(len(column), bool)
        for content in self.marks:
            marked |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._spelled(column)
        parts, owner, after = [], [], []  # texts between marks, whose they are, ids that follow them
        for i, text in enumerate(column.to_pylist()):
            if not marked[i]:
                split = [text]
            elif self.around:
                split = ["", self.tokenizer.encode(text, add_special_tokens=False).ids]
            else:
                split = self.mark.split(text)
                split[1::2] = [[self.marks[content]] for content in split[1::2]]
            parts += split[::2]
            owner += [i] * len(split[::2])
            after += split[1::2] + [[]] * (len(split) % 2)
        ids, counts = self._spelled(pa.array(parts, column.type))
        more = np.fromiter(map(len, after), np.int64, len(after))
        flat = np.array([x for each in after for x in each], np.uint32)
        ids = np.insert(ids, np.repeat(np.cumsum(counts), more), flat)
        return ids, np.bincount(owner, weights=counts + more, minlength=len(column)).astype(np.int64)

    def _spelled(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, at = text_column(column)
        whole = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
        at = heads[at]
        if not len(whole):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts = self._starts(whole, at)
        ends = np.r_[starts[1:], len(whole)]
        codes = coded_hashes(scramble(whole.astype(np.uint64) + np.uint64(1)), starts, ends)
        distinct, sample, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > _MOST_WORDS:
            self._forget()
        slot = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        inside = slot < len(self.known)
        found[inside] = self.known[slot[inside]] == distinct[inside]
        if not found.all():
            fresh = sample[~found]
            self._learn(distinct[~found], [whole[b:e].tobytes().decode("utf-32-le") for b, e in
                                           zip(starts[fresh].tolist(), ends[fresh].tolist())])
            slot = np.searchsorted(self.known, distinct)
        slot = slot[back]
        sizes = self.size[slot]
        total = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[slot] - (total - sizes), sizes) + np.arange(int(total[-1]))]
        doc = np.searchsorted(at, starts, side="right") - 1
        return ids, np.bincount(doc, weights=sizes, minlength=len(at) - 1).astype(np.int64)
