"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie in one flat numpy array of symbols. Each round finds every word's best-ranked pair,
merges its occurrences from the left, and compacts the array, until no pair is left. The result equals the
library's own for BPE models with an identity normalizer, a dummy prefix and byte fallback.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches, release_memory

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Words whose encodings a worker remembers; when full it starts anew, so memory stays bounded.
CACHE_WORDS = 150_000
#: Characters of text that are encoded at once, or one longer text.
CHUNK_BYTES = 1_000_000


class PieceModel:
    """Vocabulary and merge table of a model file."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_text = [str(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        self.byte_of = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i], 16) if pieces[i][0] != "<" else int(pieces[i][1:-1], 16)] = i
                self.byte_of[i] = int(pieces[i][1:-1], 16)
        self.surface = [p.replace(SPACE, " ") for p in pieces]
        known = {pieces[i]: i for i in normal}
        chars = {c for p in known for c in p}
        if any(c not in known for c in chars):
            raise ValueError("a character of a piece has no piece of its own")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known):
            raise ValueError("a piece runs over a word boundary")
        codes = sorted((ord(c), known[c]) for c in known if len(c) == 1)
        self.char_codes = np.array([c for c, _ in codes], np.int64)
        self.char_ids = np.array([i for _, i in codes], np.int64)
        scores = [sp.get_score(i) for i in normal]
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        tied = [s for s, k in Counter(scores).items() if k > 1]
        self.base = n
        table = {}
        for p, i in known.items():
            rank = order[sp.get_score(i)]
            for k in range(1, len(p)):
                if (x := known.get(p[:k])) is not None and (y := known.get(p[k:])) is not None:
                    table[x * n + y] = (rank, i)
        keys = sorted(table)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([*(table[k][0] for k in keys), NONE], np.int64)
        self.merged = np.array([*(table[k][1] for k in keys), 0], np.int64)
        self.tied = np.zeros(len(order) + 1, bool)
        self.tied[[order[s] for s in tied]] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; rank NONE where they don't merge."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all words, and the word each belongs to; characters without a piece become byte pieces."""
        flat = "".join(words)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        at = np.minimum(np.searchsorted(self.char_codes, code), len(self.char_codes) - 1)
        known = self.char_codes[at] == code
        sym = self.char_ids[at]
        if known.all():
            return sym, word
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        count = np.where(known, 1, size)
        start = np.cumsum(count) - count
        out, owner = np.repeat(sym, count), np.repeat(word, count)
        unknown = np.flatnonzero(~known)
        raw = np.frombuffer("".join(flat[i] for i in unknown.tolist()).encode("utf-8", "surrogatepass"), np.uint8)
        within = np.arange(len(raw)) - np.repeat(np.cumsum(size[unknown]) - size[unknown], size[unknown])
        out[np.repeat(start[unknown], size[unknown]) + within] = self.byte_id[raw]
        return out, owner

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word begins with its spaces, written as SPACE."""
        done: list[list[int]] = [[]] * len(words)
        sym, word = self.symbols(words)
        rank, to = self._pairs(sym, word)
        while len(sym):
            # Best pair of each word that is still in the array.
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                size = np.diff(np.r_[first, len(sym)])
                ended = np.repeat(over, size)
                ids = sym[ended].tolist()
                k = 0
                for w, n in zip(word[first[over]].tolist(), size[over].tolist()):
                    done[w] = ids[k : k + n]
                    k += n
                left = ~ended
                sym, word, rank, to, best, size = sym[left], word[left], rank[left], to[left], best[~over], size[~over]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            else:
                size = np.diff(np.r_[first, len(sym)])
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = self._merges(sym, word, rank, to, at)
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym[at] = to[at]
            new = (np.cumsum(keep) - 1)[at]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            self._refresh(sym, word, rank, to, np.concatenate([new, new[new > 0] - 1]))
        return done

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, to = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
        self._refresh(sym, word, rank, to, np.arange(len(sym)))
        return rank, to

    def _refresh(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, to: np.ndarray, at: np.ndarray) -> None:
        """Rank again the pairs that begin at ``at``."""
        rank[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        rank[at], to[at] = self.pair(sym[at], sym[at + 1])

    def _merges(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the best pairs at ``at``, those that merging one by one from the left would merge before any other pair."""
        w = word[at]
        lead = np.r_[True, w[1:] != w[:-1]]
        if len(at) == int(lead.sum()):
            return at
        # Of overlapping occurrences (a run of one symbol) every other one merges.
        touch = np.r_[False, (at[1:] == at[:-1] + 1) & ~lead[1:]]
        run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
        at = at[(at - at[run]) % 2 == 0]
        w = word[at]
        lead = np.r_[True, w[1:] != w[:-1]]
        made = to[at]
        # A merge that makes a pair as good or better lets nothing to its right merge in this round.
        before = np.maximum(at - 1, 0)
        joined = np.r_[False, (at[1:] == at[:-1] + 2) & ~lead[1:]]
        before_sym = np.where(joined, np.r_[0, made[:-1]], sym[before])
        before_ok = joined | ((at > 0) & (word[before] == w))
        after = np.minimum(at + 2, len(sym) - 1)
        after_ok = (at + 2 < len(sym)) & (word[after] == w)
        own = rank[at]
        stops = self.tied[np.minimum(own, len(self.tied) - 1)].copy()
        stops |= before_ok & (self.pair(before_sym, made)[0] <= own)
        stops |= after_ok & (self.pair(made, sym[after])[0] <= own)
        seen = np.cumsum(stops) - stops
        start = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
        return at[seen == seen[start]]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, with the spaces of the pieces; runs of byte pieces are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.surface[i])
        return "".join(out) + run.decode("utf-8", "replace")


@lru_cache(1)
def piece_model(model_bytes: bytes) -> PieceModel:
    """Kept by each Python worker from task to task."""
    return PieceModel(model_bytes)


def split_words(text: str) -> list[str]:
    """The words of a text without their first SPACE: the dummy prefix's for the first word, else a space of the text."""
    if not text:
        return []
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]


class Encoder:
    """Encodes texts batch by batch and remembers words."""

    def __init__(self, model: PieceModel):
        self.model, self.ids, self.text = model, {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        new = list({w for ws in texts for w in ws}.difference(self.ids))
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids, self.text = {}, {}
            new = list({w for ws in texts for w in ws})
        names = self.model.id_text
        for w, ids in zip(new, self.model.encode_words([SPACE + w for w in new])):
            self.ids[w] = ",".join([names[i] for i in ids])
            self.text[w] = self.model.decode_ids(ids)

    def encode(self, words: list[str]) -> str:
        """Decimal ids joined by commas."""
        return ",".join([self.ids[w] for w in words])

    def decoded(self, words: list[str]) -> str:
        """What the ids of the words decode to; decoding drops the dummy prefix."""
        return "".join([self.text[w] for w in words])[1:]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and round trip of every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the hash of the empty string twice. Repeated rows give a row each, null
    ids stay null, an empty table gives no rows, and other columns are not read. The model file (half a megabyte) is
    sent with the task.
    """
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(piece_model(proto))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, text = [], [], []
            for some in _chunks(texts):
                split = [split_words(t) for t in some]
                encoder.learn(split)
                for words in split:
                    line = encoder.encode(words)
                    n.append(line.count(",") + 1 if line else 0)
                    ids.append(hashlib.sha256(line.encode()).hexdigest())
                    text.append(hashlib.sha256(encoder.decoded(words).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del encoder
        release_memory()

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return in_small_batches(source).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
