"""Token ids of a byte-level BPE tokenizer by the installed library, with a memory of words.

The library cuts a text into words by a pattern in which a space that a visible character follows always begins a word.
So a text may be cut before such spaces, each distinct cut encoded once, and the ids laid side by side: they are the ids
of the whole text. It may also be cut between a letter and a mark, for no word of the pattern goes on from letters to
marks, and around a line end that stands alone. So far fewer distinct cuts are met than with marks left at the words.
New cuts are encoded together, and parted again by the bytes that each token stands for.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Words that a worker remembers before it starts anew (some 200 bytes each), and bytes of text cut at a time.
REMEMBERED, GROUP_BYTES = 500_000, 2 << 20
#: A word that was met more often than this outlives that.
USES = 2
#: Bytes of new words that are encoded together.
ENCODED_BYTES = 256 << 10

#: Bytes that certainly begin a visible character: not white space, and not the first byte of a longer character among
#: which Unicode has white space (U+0085, U+00A0, U+1680, U+2000 and on, U+3000).
_VISIBLE = np.ones(256, bool)
_VISIBLE[list(range(0x21)) + [0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: ASCII letters; ASCII marks but the apostrophe, which may begin a word of letters; the second bytes of the letters that begin with C3.
_LETTER, _MARK, _LETTER_AFTER_C3 = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER_AFTER_C3[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def _cuts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of some bytes before which a space begins a word, and those where letters, marks and lone line ends part."""
    if len(a) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero((a[:-1] == 0x20) & _VISIBLE[a[1:]])
    letter = _LETTER[a]
    letter[1:] |= (a[:-1] == 0xC3) & _LETTER_AFTER_C3[a[1:]]
    marks = np.flatnonzero(letter[:-1] & _MARK[a[1:]]) + 1
    lines = np.flatnonzero(a == 0x0A)
    lines = lines[(lines > 0) & (lines < len(a) - 1)]
    lines = lines[(letter[lines - 1] | _MARK[a[lines - 1]]) & _VISIBLE[a[lines + 1]]]
    return spaces, np.concatenate([marks, lines, lines + 1])


class _Numbers(dict):
    """Numbers for words; those that are new since the last look are in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start:start+count], one after the other."""
    at = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[at + np.arange(len(at))]


class Encoder:
    """Ids of whole texts, each followed by one end id."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space"):
            raise ValueError("a plain byte-level tokenizer is needed: no normalizer, no prefix space, the usual word pattern")
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must hold no spaces and take none")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        added = {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = added.get(i, len(token))  # a character of a token's name is a byte of text
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.numbers[b""] = 0  # the end of a text
        self.flat, self.start, self.count = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.uses = np.zeros(1, np.int64)

    def _trim(self) -> None:
        """Keep the words that were met several times, if they leave room for others; forget all else."""
        self.uses[0] = USES + 1
        kept = np.flatnonzero(self.uses > USES)
        if len(kept) > REMEMBERED // 2:
            return self._forget()
        words, numbers = list(self.numbers), _Numbers()
        numbers.update((words[i], n) for n, i in enumerate(kept.tolist()))
        self.flat = _gathered(self.flat, self.start[kept], self.count[kept])
        self.numbers, self.count = numbers, self.count[kept]
        self.start, self.uses = np.cumsum(self.count) - self.count, np.zeros(len(kept), np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words and remember their ids."""
        begins = np.array([w[0] == 0x20 and len(w) > 1 and _VISIBLE[w[1]] for w in words])
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, size = [self.flat], len(self.flat)
        alone = np.flatnonzero(~begins)
        for i in range(0, len(alone), 1000):
            at = alone[i : i + 1000]
            for n, e in zip(at.tolist(), self.tokenizer.encode_batch_fast([words[n].decode() for n in at.tolist()], add_special_tokens=False)):
                parts.append(np.array(e.ids, np.uint32))
                start[n], count[n] = size, len(e.ids)
                size += len(e.ids)
        joined = np.flatnonzero(begins)
        lengths = np.array([len(words[n]) for n in joined.tolist()], np.int64)
        groups_of = (np.cumsum(lengths) - lengths) // ENCODED_BYTES
        for at, length in zip(*(np.split(v, np.flatnonzero(np.diff(groups_of)) + 1) for v in (joined, lengths))):
            if not len(at):
                continue
            (encoded,) = self.tokenizer.encode_batch_fast([b"".join([words[n] for n in at.tolist()]).decode()], add_special_tokens=False)
            ids = np.array(encoded.ids, np.uint32)
            reached, ends = np.cumsum(self.width[ids]), np.cumsum(length)
            cut = np.searchsorted(reached, ends)
            if cut[-1] >= len(reached) or (reached[cut] != ends).any():
                raise ValueError("a token reaches over the start of a word: this tokenizer's pattern is another")
            parts.append(ids)
            count[at] = np.diff(cut, prepend=-1)
            start[at] = size + np.append(0, cut[:-1] + 1)
            size += len(ids)
        self.flat = np.concatenate(parts)
        self.start, self.count, self.uses = np.append(self.start, start), np.append(self.count, count), np.append(self.uses, np.zeros(len(words), np.int64))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many are each text's (its end id included)."""
        # The texts lie side by side, each with a NUL behind it, which no cut looks beyond.
        whole = b"\x00".join(texts) + b"\x00"
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        spaces, fine = _cuts(np.frombuffer(whole, np.uint8))
        for i, text in enumerate(texts) if any(t in whole for t in self.added) else ():
            if any(t in text for t in self.added):  # such a token may hold letters and marks
                fine = fine[(fine < ends[i] - len(text)) | (fine > ends[i])]
        begins = np.zeros(len(whole) + 1, bool)
        for at in (spaces, fine, ends, ends + 1, 0):
            begins[at] = True
        bounds = np.flatnonzero(begins)
        at = np.searchsorted(bounds, ends)
        bounds = bounds.tolist()
        words = [whole[i:j] for i, j in zip(bounds, bounds[1:])]
        for i in at.tolist():
            words[i] = b""
        sizes = np.diff(at, prepend=-1)
        if len(self.numbers) > REMEMBERED:
            self._trim()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.fresh:
            self._learn(self.numbers.fresh)
            self.numbers.fresh = []
        self.uses += np.bincount(ids, minlength=len(self.uses))
        counts = self.count[ids]
        total = np.add.reduceat(counts, np.append(0, np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        return _gathered(self.flat, self.start[ids], counts), total


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process: its memory lives on from task to task."""
    return Encoder(path, end_id)


def groups(texts: list[bytes]):
    """Runs of texts of a bounded number of bytes; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        last, size = at, 0
        while last < len(texts) and (last == at or size + len(texts[last]) <= GROUP_BYTES):
            size += len(texts[last])
            last += 1
        yield texts[at:last]
        at = last
