"""Ids of words, remembered in flat arrays: texts are looked up and put together without a step in Python per word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids of new words: all ids in one array, and where each word's ids start in it and how many they are.
Learnt = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Rows, and bytes of text, that are coded at a time.
STEP_ROWS, STEP_BYTES = 256, 1 << 20


class WordCache:
    """Ids of up to ``most`` words; when there are more, those used most often stay, half of ``most`` at the utmost.

    ``learn`` gives the ids of words that aren't known, each once.
    """

    def __init__(self, learn: Callable[[list[str]], Learnt], kind: str, most: int):
        self.learn, self.kind, self.most = learn, kind, most
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat = np.empty(0, self.kind)
        self.filled = 0
        self.start, self.length, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def places(self, words: Iterable[str], n: int) -> np.ndarray:
        """Where in the table each of the ``n`` words is; new ones are learnt."""
        before = len(self.place)
        try:
            places = np.fromiter(map(self.place.__getitem__, words), np.int64, n)
            if new := len(self.place) - before:
                self._add(list(islice(reversed(self.place), new))[::-1])
        except BaseException:
            self.clear()
            raise
        self.uses[: len(self.place)] += np.bincount(places, minlength=len(self.place))
        return places

    def _add(self, words: list[str]) -> None:
        flat, start, length = self.learn(words)
        known, size = len(self.place) - len(words), len(self.place)
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.empty(self.filled // 2 + len(flat), self.kind)])
        if size > len(self.start):
            more = np.zeros(known // 2 + len(words), np.int64)
            self.start, self.length, self.uses = (np.concatenate([x[:known], more]) for x in (self.start, self.length, self.uses))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.start[known:size], self.length[known:size] = start + self.filled, length
        self.uses[known:size] = 0
        self.filled += len(flat)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their places, one word after the other, and where each word ends."""
        length = self.length[places]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[places] - ends + length, length) + np.arange(total)], ends

    def encode(self, texts: pa.ListArray) -> list[np.ndarray]:
        """Ids of each text, given as its words."""
        coded = texts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        flat, ends = self.gather(self.places(words, len(words))[coded.indices.to_numpy()])
        stops = np.cumsum(pc.list_value_length(texts).to_numpy())
        stops = np.concatenate([[0], ends])[stops].tolist()
        self.trim()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def trim(self) -> None:
        if len(self.place) <= self.most:
            return
        uses = self.uses[: len(self.place)]
        kept = np.sort(np.argsort(-uses, kind="stable")[: self.most // 2])
        kept = kept[uses[kept] > 1]
        chosen = np.zeros(len(uses), bool)
        chosen[kept] = True
        words = list(compress(self.place, chosen.tolist()))
        flat, ends = self.gather(kept)
        self.length, self.uses = self.length[kept], uses[kept] // 2
        self.flat, self.filled, self.start = flat, len(flat), ends - self.length
        self.place = defaultdict(count(len(words)).__next__, zip(words, range(len(words))))


def cut(ids: np.ndarray, ends: np.ndarray) -> Learnt:
    """Words whose ids lie one after the other and end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    return ids, starts, ends - starts


def joined(parts: list[np.ndarray], kind: str) -> Learnt:
    """Words whose ids are given one by one."""
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return cut(np.concatenate([np.empty(0, kind), *parts]), ends)


def merged(second: np.ndarray, one: Learnt, two: Learnt) -> Learnt:
    """Words of which ``second`` tells whose ids are in ``two``, the others' being in ``one``."""
    start, length = np.empty((2, len(second)), np.int64)
    start[~second], start[second] = one[1], two[1] + len(one[0])
    length[~second], length[second] = one[2], two[2]
    return np.concatenate([one[0], two[0]]), start, length


def steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of a row at least and about ``STEP_BYTES`` of text at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        room = (upto[at - 1] if at else 0) + STEP_BYTES
        stop = min(max(int(np.searchsorted(upto, room, "right")), at + 1), at + STEP_ROWS)
        yield batch.slice(at, stop - at)
        at = stop
