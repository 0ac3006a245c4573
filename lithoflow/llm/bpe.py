"""Byte-level BPE by prefix-sharing trie traversal.

A batch's distinct words are taken in sorted order, which is the depth-first order of their trie: the states of the prefix
that a word shares with the one before are kept on a stack and only the new bytes are visited. A node's state is the last
token of its prefix's encoding. It is the one token that ends the prefix and may follow the state of what is left
(``_Vocabulary.fits``); walking the states back from a word's node gives its encoding. Encoded words stay in a bounded
cache of the worker.

Words come from the vocabulary's published split pattern; the strings of added tokens are taken out first, as the
tokenizers library does. Defined cases: null text is the empty text and has no ids; equal texts have equal ids; repeated
rows are rows each; an empty table gives none; words of any length are encoded in time in proportion to it (those of over
``LONG`` bytes with an automaton of all tokens); lone surrogates can't occur in Spark strings; extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_sizes, slices

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, LONG = 400_000, 64
NEVER = 1 << 40


def printable_bytes() -> dict[str, int]:
    """The vocabulary file's character for each byte: itself if printable Latin-1, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = printable_bytes()
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        vocab = file["model"]["vocab"]
        self.id_of = {raw(s): i for s, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.size_of = {i: len(b) for b, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self._automaton = None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for n, merge in enumerate(file["model"]["merges"]):
            left, right = (merge.split(" ") if isinstance(merge, str) else merge)
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = n
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, n
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.fitting: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def automaton(self):
        """Finds the tokens within a word's bytes, as Latin-1 characters."""
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for raw, i in self.id_of.items():
                found.add_word(raw.decode("latin-1"), i)
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is merged, first byte first: (token, rank of the merge that ends it)."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until, token = self.made[token], self.parts[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly these two tokens.

        Follows the two tokens that touch the border as merges go by in order of rank. They become one if their own merge
        comes before either is merged away from the border; of equal ranks the leftmost merges first.
        """
        key = left << 20 | right
        if (known := self.fitting.get(key)) is not None:
            return known
        a, b, i, j, ok = self._edge(left, 1), self._edge(right, 0), 0, 0, True
        while True:
            (x, end_x), (y, end_y) = a[i], b[j]
            own = self.rank.get((x, y), NEVER)
            if own < NEVER and own < end_x and own <= end_y:
                ok = False
                break
            if end_x == end_y == NEVER:
                break
            if end_x <= end_y:
                i += 1
            else:
                j += 1
        self.fitting[key] = ok
        return ok

    def merges_whole(self, token: int) -> bool:
        """Whether merging a token's bytes gives this token."""
        if (known := self.whole.get(token)) is None:
            known = token not in self.parts or self._merged(self.bytes_of[token]) == [token]
            self.whole[token] = known
        return known

    def _merged(self, raw: bytes) -> list[int]:
        ids = [self.id_of[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best, at = min((self.rank.get((ids[i], ids[i + 1]), NEVER), i) for i in range(len(ids) - 1))
            if best == NEVER:
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids


class Encoder:
    """Encodes texts and decodes ids of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        self.vocabulary = _Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit bytes, of distinct words."""
        v, out = self.vocabulary, {}
        id_of, fitting, fits, longest = v.id_of, v.fitting, v.fits, v.longest
        states: list[tuple[int, int]] = [(0, -1)]  # at each depth of the present path: start of the last token, its id
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n = min(len(raw), len(before))
            shared = next((i for i in range(n) if raw[i] != before[i]), n)
            del states[shared + 1 :]
            if len(raw) > LONG:
                self._long_states(raw, states)
            for end in range(len(states), len(raw) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = id_of.get(raw[start:end])
                    if token is None:
                        continue
                    if not start:
                        if v.merges_whole(token):
                            break
                    else:
                        last = states[start][1]
                        ok = fitting.get(last << 20 | token)
                        if ok or ok is None and fits(last, token):
                            break
                states.append((start, token))
            before, at, ids = raw, len(raw), []
            while at:
                at, token = states[at]
                ids.append(token)
            out[word] = np.array(ids[::-1], "<u4").tobytes()
        return out

    def _long_states(self, raw: bytes, states: list[tuple[int, int]]) -> None:
        """Adds the states of a long word's bytes. An automaton names the tokens that end at each byte, longest first, in place of a
        lookup for each start."""
        v, sizes = self.vocabulary, self.vocabulary.size_of
        automaton = v.automaton()
        for at, token in automaton.iter(raw.decode("latin-1"), max(0, len(states) - v.longest)):
            end = at + 1
            if end != len(states):
                continue
            start = end - sizes[token]
            if v.fits(states[start][1], token) if start else v.merges_whole(token):
                states.append((start, token))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        v, parts = self.vocabulary, []
        for t in texts:
            pieces = v.split_added.split(t or "") if v.split_added and any(s in (t or "") for s in v.added) else [t or ""]
            parts.append([p if i % 2 else self.find(p) for i, p in enumerate(pieces)])
        fresh = {w for p in parts for x in p if isinstance(x, list) for w in x}.difference(self.cache)
        if fresh:
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.cache = {}
                fresh = {w for p in parts for x in p if isinstance(x, list) for w in x}
            self.cache |= self.encode_words(fresh)
        known, added = self.cache.__getitem__, {s: np.array([i], "<u4").tobytes() for s, i in v.added.items()}
        return [b"".join(added[x] if isinstance(x, str) else b"".join(map(known, x)) for x in p) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; its cache carries over from task to task."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str, facts, schema: pa.Schema, ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """facts(encoder, text, ids bytes) -> values of schema, for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b[1]), 2048):
                texts = b[1].slice(i, j - i).to_pylist()
                rows = [facts(e, t, ids) for t, ids in zip(texts, e.encode_batch(texts), strict=True)]
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.record_batch([b[0].slice(i, j - i), *columns], ["id", *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {ddl}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text."""
    return encoded(docs, path, lambda e, t, ids: (np.frombuffer(ids, "<u4"),), pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>", id_col, text_col)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids); null ids are null text."""
    kind = ids.schema["id"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = [None if x is None else e.decode(np.array(x, "<u4").tobytes()) for x in b["ids"].to_pylist()]
            yield pa.record_batch([b["id"], pa.array(texts, pa.string())], ["id", "text"])

    return ids.select("id", "ids").mapInArrow(run, f"id {kind}, text string")
