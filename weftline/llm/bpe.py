"""BPE encoding and decoding by a prefix-sharing walk over a trie of the distinct words.

For byte-pair encoding with a ranked vocabulary, the encoding of a prefix ends in exactly one token t, the only one for
which (last token of the rest, t) is a pair that merging leaves alone. So the last token of every prefix is a state that
follows from the states of shorter prefixes. The distinct words (pre-tokens) of a part are put into a trie and walked
depth first: sorted words are the trie's leaves in order, the states of the current path are on a stack, and of each word only the states below the prefix it shares with the word before are computed. An encoding is read off by walking
back along the path. Words met before are not encoded again: a worker keeps a dictionary of them, emptied when it has
CACHE words, which changes no result.

Result: (doc_id, n_tokens, ids, exact): `exact` says that decoding the ids gives the text's bytes again; it is computed
for every row; `decode_table` gives the texts back. Edge cases: a null or empty text has no ids and is exact; rows with a null doc_id are kept with it; very
long texts and words are encoded whole; repeated rows are encoded alike; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, texts_of
from .token_ids import PATTERN, VOCABULARY, ranks_of, ship

CACHE = 500_000
#: Bytes from which a word is long: its tokens are found by an automaton.
LONG = 256


class Coder:
    """Encoder and decoder for a vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.size, self.automaton = size, None
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def merge(self, word: bytes, stop: int = 1) -> list[int]:
        """Plain merging of the pair with the lowest rank, the leftmost first; ends when `stop` parts are left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this token joins; None for a byte."""
        got = self.parts.get(token)
        if got is None:
            b = self.bytes[token]
            parts = self.merge(b, 2) if len(b) > 1 else []
            got = self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
        return None if got[0] < 0 else got

    def pair(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b again. Merges are undone from the last back; the pair
        falls if, at any stage, its ends would have merged across the border before the merge just undone."""
        key = a * self.size + b
        got = self.fits.get(key)
        if got is None:
            got = self.fits[key] = self._pair(a, b)
        return got

    def _pair(self, a: int, b: int) -> bool:
        names, ranks, limit = self.bytes, self.ranks, self.size
        left, right = a, b
        while True:
            across = ranks.get(names[left] + names[right])
            if across is not None and across < limit:
                return False
            l, r = self.split(left), self.split(right)
            if l is None and r is None:
                return True
            # the later merge is undone first; of equal ones that on the right, as merging goes from left to right
            if r is None or (l is not None and left > right):
                limit, left = left, l[1]
            else:
                limit, right = right + 1, r[0]

    def words(self, ordered: list[bytes]) -> list[list[int]]:
        """Encodings of words in sorted order."""
        ranks, longest, pair, names = self.ranks, self.longest, self.pair, self.bytes
        state: list[int] = [-1]
        before = b""
        out = []
        for word in ordered:
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del state[shared + 1 :]
            if len(word) > LONG:
                self._long(word, state, shared)
            else:
                for i in range(shared + 1, len(word) + 1):
                    for j in range(max(0, i - longest), i):
                        t = ranks.get(word[j:i])
                        if t is not None and (pair(state[j], t) if j else self._alone(t)):
                            state.append(t)
                            break
                    else:
                        raise ValueError("the vocabulary lacks a byte")
            before = word
            ids, i = [], len(word)
            while i:
                t = state[i]
                ids.append(t)
                i -= len(names[t])
            ids.reverse()
            out.append(ids)
        return out

    def _long(self, word: bytes, state: list[int], shared: int) -> None:
        """The states of a long word's prefixes; an automaton finds the tokens that end at each byte in one pass."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token, i in self.ranks.items():
                self.automaton.add_word(token.decode("latin-1"), i)
            self.automaton.make_automaton()
        names = self.bytes
        for end, found in groupby(self.automaton.iter(word.decode("latin-1")), key=itemgetter(0)):
            if end < shared:
                continue
            for t in sorted((t for _, t in found), key=lambda t: -len(names[t])):
                j = end + 1 - len(names[t])
                if self.pair(state[j], t) if j else self._alone(t):
                    state.append(t)
                    break
        if len(state) != len(word) + 1:
            raise ValueError("the vocabulary lacks a byte")

    def _alone(self, token: int) -> bool:
        """Whether a token's bytes encode as that token."""
        return len(self.bytes[token]) == 1 or self.split(token) is not None

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        if not len(n):
            return b""
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.joined[at].tobytes()


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(ranks_of(path))


class Encoder:
    """Encodes texts, remembering the distinct words met so far."""

    def __init__(self, code: Coder, cache: int = CACHE):
        import regex

        self.code, self.cut, self.most = code, regex.compile(PATTERN).findall, cache
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more than texts)."""
        if len(self.known) > self.most or len(self.flat) > 8 * self.most:
            self.clear()
        cut = [self.cut(t) for t in texts]
        words = [w for c in cut for w in c]
        new = sorted((w.encode("utf-8"), w) for w in set(words).difference(self.known))
        got = self.code.words([b for b, _ in new])
        for k, (_, w) in enumerate(new, len(self.known)):
            self.known[w] = k
        if got:
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in got for i in ids), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in got])])
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.ends[index + 1] - self.ends[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.ends[index] - (ends - n), n)]
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]
        return ids, edge.astype(np.int64)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    return Encoder(coder(path))


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, encoder = coder(path), encoder_of(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = texts_of(part, "text").to_pylist()
                ids, edge = encoder.texts(texts)
                whole = code.decode(ids)
                at = np.concatenate([[0], np.cumsum(code.lengths[ids])])[edge]
                exact = [whole[a:b] == t.encode("utf-8") for a, b, t in zip(at, at[1:], texts)]
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edge), pa.int32()), lists, pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids", "exact"])

    return run


def encode_table(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    path = ship(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInArrow(_run(path), "doc_id long, n_tokens int, ids array<int>, exact boolean")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            texts = [None if ids is None else code.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_table(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids, ...); null ids give a null text, and bytes that aren't UTF-8 U+FFFD."""
    path = ship(coded.sparkSession, path)
    return coded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
