"""Whole texts as sequences of numbers that are worked out once per distinct segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments remembered; beyond it the memory starts afresh.
REMEMBERED = 3 << 19

#: Punctuation that never joins a word before it.
TAIL = ".,;:!?"

#: The letters of `one_word`, behind at most one space.
LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
WORD = f"^ ?{LETTERS}"
#: Two words with line ends between them, and the punctuation behind both.
LINES = f"^(?P<word> ?{LETTERS})(?P<between>[{TAIL}]*\n+)(?P<next>{LETTERS})(?P<tail>[{TAIL}]*)$"


def text_runs(batches: Iterable[pa.RecordBatch], most: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Views of so many rows at most, whose texts (the second column) have `most` bytes together, or of
    one longer row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(low, high - low)
            low = high


def one_word(segment: str) -> bool:
    """Letters behind at most one space, which the splitting patterns take as one match."""
    stem = segment.removeprefix(" ")
    return stem.isalpha() and max(stem) < "\u0250"


class SegmentMemory:
    """`learn` gives the numbers of each of a list of strings, as lists or arrays; `words` those of
    strings that are `one_word`, all of them behind a space or none, as the count of each and all in
    one array.

    No match of a splitting pattern for byte-level BPE reaches from a non-blank to a single space
    behind it, so a text may be cut before every such space. Texts with other runs of blanks are
    learnt whole.
    """

    def __init__(self, learn: Callable[[list[str]], list[list[int]]],
                 words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.learn = learn
        self.words = words or self._learnt
        self.forget()

    def forget(self) -> None:
        self.number: dict[str | tuple[str], int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 15, dtype=np.int64)
        self.size = np.zeros(1 << 15, dtype=np.int64)
        self.plain = np.zeros(1 << 15, dtype=bool)

    def _flat(self, at: np.ndarray) -> np.ndarray:
        """The numbers of the segments at these places, one after the other."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.pool[np.repeat(self.start[at], sizes) + inside]

    def _learnt(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        learnt = self.learn(strings)
        sizes = np.fromiter(map(len, learnt), dtype=np.int64, count=len(learnt))
        return sizes, np.fromiter(chain.from_iterable(learnt), dtype=np.uint32, count=int(sizes.sum()))

    def _add(self, segments: pa.Array) -> None:
        """Learn new segments, all different. Words, words that end in punctuation, and two of these
        with line ends between them are parted in Arrow: every pattern parts a letter from what
        follows and from a line end before it, so each part is learnt once."""
        lines = pc.extract_regex(segments, LINES)
        self._add_parted(segments.filter(lines.is_valid()), [pc.struct_field(lines.drop_null(), k) for k in range(4)])
        segments = segments.filter(lines.is_null())
        stems = pc.utf8_rtrim(segments, TAIL)
        simple = pc.match_substring_regex(stems, WORD + "$")
        self._add_other(set(segments.filter(pc.invert(simple)).to_pylist()))
        segments, stems = segments.filter(simple), stems.filter(simple)
        tailed = pc.greater(pc.binary_length(segments), pc.binary_length(stems))
        self._places(segments.filter(pc.invert(tailed)))
        segments = segments.filter(tailed)
        self._add_parted(segments, [stems.filter(tailed), None, None, pc.replace_substring_regex(segments, WORD, "")])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of these strings that are `one_word` is stored; new ones are learnt."""
        coded = words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.number]
        for own in ([w for w in new if w[0] == " "], [w for w in new if w[0] != " "]):
            if own:
                self._store(own, *self.words(own), simple=True)
        return np.array([self.number[w] for w in words], np.int64)[coded.indices.to_numpy()]

    def _add_parted(self, segments: pa.Array, parts: list[pa.Array | None]) -> None:
        """Learn segments made of a word, punctuation with line ends, a word, and punctuation."""
        if not len(segments):
            return
        word, between, then, tail = parts
        at = [self._places(word)]
        if between is not None:
            coded = between.dictionary_encode()
            strings = coded.dictionary.to_pylist()
            # as they are before a letter; kept apart from segments that are the same in whole
            new = [b for b in strings if (b,) not in self.number]
            if new:
                learnt, letter = self.learn([b + "a" for b in new]), len(self.learn(["a"])[0])
                learnt = [list(numbers)[:-letter] for numbers in learnt]
                self._store([(b,) for b in new], np.array([*map(len, learnt)]),
                            np.array([*chain.from_iterable(learnt)], np.uint32), simple=True)
            at += [np.array([self.number[b,] for b in strings])[coded.indices.to_numpy()], self._places(then)]
        coded = tail.dictionary_encode()
        strings = coded.dictionary.to_pylist()
        self._add_other({t for t in strings if t not in self.number})
        at = np.stack([*at, np.array([self.number[t] for t in strings])[coded.indices.to_numpy()]], axis=1)
        self._store(segments.to_pylist(), self.size[at].sum(axis=1), self._flat(at.ravel()), simple=True)

    def _add_other(self, segments: set[str]) -> None:
        """Learn the segments; of those that end in punctuation behind a letter, where every
        pattern parts, the word and the punctuation are learnt and joined."""
        split = {}
        for segment in segments:
            if segment[-1:] in TAIL:
                stem = segment.rstrip(TAIL)
                if stem and stem != segment and stem[-1] < "\u0250" and stem[-1].isalpha():
                    split[segment] = (stem, segment[len(stem):])
        parts = segments.difference(split).union(chain.from_iterable(split.values()))
        new = list(parts.difference(self.number))
        if new:
            self._store(new, *self._learnt(new))
        # a tail can be what another segment is in whole
        joined = [s for s in split if s not in self.number]
        if joined:
            at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split[s] for s in joined)),
                             dtype=np.int64, count=2 * len(joined))
            self._store(joined, self.size[at].reshape(-1, 2).sum(axis=1), self._flat(at))

    def _store(self, segments: list, sizes: np.ndarray, numbers: np.ndarray, simple: bool = False) -> None:
        first, stop, total = len(self.number), len(self.number) + len(segments), len(numbers)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while stop > len(self.start):
            for name in ("start", "size", "plain"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.size[first:stop] = sizes
        self.start[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.plain[first:stop] = simple or [len(s) > 1 and not s[1].isspace() and not s[-1].isspace()
                                            for s in segments]
        self.pool[self.used:self.used + total] = numbers
        self.used += total
        self.number.update(zip(segments, range(first, stop)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The numbers of every text; null is empty. Parts are looked up once for all these texts."""
        if len(self.number) > REMEMBERED:
            self.forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        coded = lists.flatten().dictionary_encode()
        place, parts = coded.indices.to_numpy(), coded.dictionary
        # every part but the first keeps the space before it
        first = place[edges[:-1]]
        heads = parts.take(pa.array(first)).to_pylist()
        behind = np.ones(len(place), dtype=bool)
        behind[edges[:-1]] = False
        used = np.zeros(len(parts), dtype=bool)
        used[place[behind]] = True
        spaced = pc.binary_join_element_wise(pa.scalar("", parts.type), parts, pa.scalar(" ", parts.type))
        parts = spaced.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.number.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        unknown = np.flatnonzero(used & (known < 0))
        new = list({h for h in heads if h not in self.number})
        if new or len(unknown):
            self._add(pa.concat_arrays([spaced.take(pa.array(unknown)), pa.array(new, spaced.type)]))
        known[unknown] = [self.number[parts[k]] for k in unknown.tolist()]
        at = known[place]
        at[edges[:-1]] = [self.number[h] for h in heads]
        out = []
        for text, head, low, high in zip(texts, heads, edges.tolist(), edges[1:].tolist()):
            if high - low > 1 and (head[-1:].isspace() or not self.plain[at[low + 1:high]].all()):
                out.append(np.array(self.learn([text.as_py()])[0], dtype=np.uint32))
            else:
                out.append(self._flat(at[low:high]))
        return out
