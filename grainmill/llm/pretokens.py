"""Public tokenizers by way of their pre-tokens: pieces of text that the library encodes independently of their neighbours.

A text's ids are the ids of its pre-tokens, one after the other. So each distinct pre-token goes through the library
once, and texts are split, counted and put together by Arrow and NumPy.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How the GPT-2 kind of byte-level tokenizers splits text (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: When a worker's store of encoded pre-tokens has more entries, its younger half goes.
CACHE_ENTRIES = 500_000
#: Pre-tokens that are encoded at a time; words that go through the library together, and the words that may: these letters are their own normal forms.
STEP, GROUP = 16_384, 128
LETTERS_SIGNS = re.compile(r"([a-zß-öø-ÿ]*)([.,;:!?|]*)").fullmatch


class Pretokenizer:
    """split(texts) gives a list array of pre-tokens; encode(pretokens) their ids by the library."""

    def __init__(self, content: bytes, kind: str):
        self.slot, self.by_word = {"": 0}, False
        if kind == "model":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.split, self._ids = self._split_model, lambda x: self.library.encode(x, num_threads=1)
            self.n_ids = self.library.get_piece_size()
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(content.decode())
            stated = json.loads(content)
            self.specials = [x["content"].lower() for x in stated["added_tokens"]]
            text = json.dumps([stated["normalizer"], stated["pre_tokenizer"]])
            self.fold = '"Lowercase"' in text
            drops_space = '"Removed"' in text and r"[^\\s\\p{L}\\p{N}]+" in text and '"use_regex": false' in text
            self.split = self._split_space if drops_space else self._split_pattern
            self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
            self.suffix = stated["model"].get("end_of_word_suffix") or ""
            self._ids = lambda x: [e.ids for e in self.library.encode_batch_fast(x, add_special_tokens=False)]
            self.by_word = bool(drops_space and self.fold and self.suffix)
            if self.by_word:
                # For lower-case ASCII words the normal form and the byte signs are the words themselves.
                self.lean = Tokenizer.from_str(json.dumps(stated | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
                self.is_end = np.zeros(self.n_ids, dtype=bool)
                for word, i in self.library.get_vocab().items():
                    self.is_end[i] = word.endswith(self.suffix)
        self.dtype = np.uint16 if self.n_ids <= 1 << 16 else np.uint32
        self.start, self.length, self.flat = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=self.dtype)

    def _has_special(self, texts: pa.Array) -> np.ndarray:
        has = np.zeros(len(texts), dtype=bool)
        for s in self.specials:
            has |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        return has

    def _split_space(self, texts: pa.Array) -> pa.Array:
        """At ASCII white space, which the tokenizer drops. Folding A-Z early makes fewer pre-tokens, but not of special strings."""
        if self.fold:
            has = self._has_special(texts)
            folded = pc.ascii_lower(texts)
            texts = pc.if_else(pa.array(has), texts, folded) if has.any() else folded
        return pc.ascii_split_whitespace(texts)

    def _split_pattern(self, texts: pa.Array) -> pa.Array:
        import regex

        find, has = regex.compile(BYTE_LEVEL).findall, self._has_special(texts)
        return pa.array([[t] if h else find(t) for t, h in zip(texts.to_pylist(), has, strict=True)], pa.list_(pa.string()))

    def _split_model(self, texts: pa.Array) -> pa.Array:
        """Before each run of spaces that something follows. The library puts a space before what it gets, so each such
        run goes without its first one. Its own sign for a space counts as one."""
        find = re.compile(r"^[^ ]+(?: +$)?| +[^ ]+(?: +$)?|^ +$").findall
        out = []
        for t in texts.to_pylist():
            parts = find(t.replace("\u2581", " "))
            out.append(parts[:1] + [p[1:] for p in parts[1:]])
        return pa.array(out, pa.list_(pa.string()))

    def _singly(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and how many each pre-token has."""
        if self.by_word:
            each = [e.ids for e in self.library.encode_batch_fast(pretokens, add_special_tokens=False)]
        else:
            each = self._ids(pretokens)
        return np.array([i for x in each for i in x], dtype=self.dtype), np.array([len(x) for x in each], dtype=np.int64)

    def _together(self, library, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one pre-token each: GROUP of them go through the library as one text, which is
        cheaper than a text each, and the marks of word ends tell them apart. If these do not come out even, singly."""
        flat, lengths = [], []
        for at in range(0, len(words), GROUP):
            group = words[at : at + GROUP]
            ids = np.array(library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                ids, n = self._singly(group)
                cuts = np.cumsum(n)
            flat.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        return np.concatenate(flat), np.concatenate(lengths)

    def encoded(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct pre-tokens, in an order of their own kind, and how many each has; pretokens is put in that order."""
        kinds: list[list[str]] = [[], [], []]
        for p in pretokens:
            kinds[(0 if p.isascii() else 1) if self.by_word and LETTERS_SIGNS(p) else 2].append(p)
        ways = [lambda x: self._together(self.lean, x), lambda x: self._together(self.library, x), self._singly]
        done = [way(k[at : at + STEP]) for way, k in zip(ways, kinds, strict=True) for at in range(0, len(k), STEP)]
        pretokens[:] = [p for k in kinds for p in k]
        if not done:
            return np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=np.int64)
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def parts(self, split: list[str]) -> tuple[list[str], list[str]]:
        """What the pieces of a split are made of: letters and the signs after them, or the whole and an empty string."""
        if not self.by_word:
            return split, [""] * len(split)
        found = [LETTERS_SIGNS(p) for p in split]
        return [m[1] if m else p for p, m in zip(split, found, strict=True)], [m[2] if m else "" for m in found]

    def _slots(self, pretokens: list[str]) -> np.ndarray:
        """Each pre-token's number in the store, where new ones are put."""
        new = [p for p in dict.fromkeys(pretokens) if p not in self.slot]
        if new:
            if len(self.slot) > CACHE_ENTRIES:  # the older half stays: the common words came first
                half = CACHE_ENTRIES // 2
                self.slot = {p: i for p, i in self.slot.items() if i < half}
                self.start, self.length = self.start[:half], self.length[:half]
                self.flat = self.flat[: int(self.start[-1] + self.length[-1])].copy()
                new = [p for p in dict.fromkeys(pretokens) if p not in self.slot]
            flat, lengths = self.encoded(new)
            self.slot.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length, self.flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, flat])
        return np.fromiter(map(self.slot.__getitem__, pretokens), dtype=np.int64, count=len(pretokens))

    def count(self, pretokens: list[str]) -> np.ndarray:
        """How many ids each of the distinct pre-tokens has."""
        ordered = list(pretokens)
        _, n = self.encoded(ordered)
        at = dict(zip(ordered, n.tolist(), strict=True))
        return np.array([at[p] for p in pretokens], dtype=np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the len(texts) + 1 offsets of the texts in them."""
        words, codes, ends = factorized(self.split(texts))
        slots = self._slots([x for pair in zip(*self.parts(words.to_pylist()), strict=True) for x in pair])
        at, n = ragged(self.start, self.length, slots)
        flat, lengths = self.flat[at], n.reshape(-1, 2).sum(axis=1)
        at, n = ragged(np.cumsum(lengths) - lengths, lengths, codes)
        return flat[at], np.concatenate([[0], np.cumsum(n)])[ends]


def factorized(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A list array's distinct values, their codes in order, and where each list begins and ends among them."""
    ends = np.asarray(lists.offsets)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all items of the pieces `codes`, of which piece c has lengths[c] items from starts[c] on, and their numbers."""
    n = lengths[codes]
    before = np.cumsum(n) - n
    return np.repeat(starts[codes] - before, n) + np.arange(int(n.sum())), n


_loaded: dict[str, Pretokenizer] = {}


def load(content: bytes, kind: str) -> Pretokenizer:
    """The tokenizer in a file's content, kept for the later tasks of this worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pretokenizer(content, kind)
    return _loaded[key]


def read_tokenizer(spark, path: str):
    """The content of a tokenizer's file, broadcast (some MB, whatever the corpus), and its kind, json or model."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), path.rpartition(".")[2]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A batch's texts, nulls as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def slices(texts: pa.Array, most: int):
    """Ranges of rows with at most so many bytes of text; a longer text is a range of its own."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield at, to
        at = to


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
