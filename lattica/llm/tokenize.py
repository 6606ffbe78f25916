"""Encoding with a tokenizers file, by words: a byte-level BPE never merges across the matches of its splitting pattern, so
the library encodes each distinct match once, many to a call, and its ids are reused by index."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from .common import held

#: Distinct matches kept between batches; beyond it the cache starts anew.
CACHE = 400_000
#: The splitting pattern of byte-level BPE files of this family (fixed value) for texts of PLAIN characters alone, on which
#: explicit ranges say what its letter and number classes mean. Other texts go to the library whole.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏ"
SPLIT = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}¡-©«-±´¶-¸»¿×÷‐-‧€]*")


class Words(dict):
    """Indices of matches; a new one gets the next index and waits to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tk.get_added_tokens_decoder().values())
        told = json.loads(self.tk.to_str())
        pre = told["pre_tokenizer"] or {}
        self.by_words = told["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told["normalizer"] is None and not told["model"].get("dropout")
        vocabulary = self.tk.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, "i8")  # bytes of each token: a character stands for a byte
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.words, self.count = Words(), 0
        self.begin, self.length, self.ids, self.used = np.zeros(1024, "i8"), np.zeros(1024, "i8"), np.zeros(4096, "u4"), 0

    def _room(self, name: str, n: int) -> np.ndarray:
        x = getattr(self, name)
        if len(x) < n:
            x = np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])
            setattr(self, name, x)
        return x

    def _learn(self) -> None:
        """Encodes the waiting matches in one call; where each one's ids end follows from the tokens' bytes."""
        new, self.words.waiting = self.words.waiting, []
        if not new:
            return
        got = np.array(self.tk.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, "u4")
        ends = np.searchsorted(np.cumsum(self.sizes[got]), np.cumsum([len(w.encode("utf-8", "replace")) for w in new])) + 1
        n, used = self.count, self.used
        self._room("begin", n + len(new))[n : n + len(new)] = used + np.concatenate([[0], ends[:-1]])
        self._room("length", n + len(new))[n : n + len(new)] = np.diff(ends, prepend=0)
        self._room("ids", used + len(got))[used : used + len(got)] = got
        self.count, self.used = n + len(new), used + len(got)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        plain = [self.by_words and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        if len(self.words) > CACHE:
            self._reset()
        get, index, lengths = self.words.__getitem__, [], []
        for t, p in zip(texts, plain, strict=True):
            if p:
                words = SPLIT.findall(t)
                index += map(get, words)
                lengths.append(len(words))
        self._learn()
        at = np.array(index, "i8")
        n = self.length[at]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.begin[at] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
        cuts = np.append(0, ends)[np.cumsum([0, *lengths])]
        out, k = [], 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                out.append(flat[cuts[k] : cuts[k + 1]])
                k += 1
            else:
                out.append(np.array(self.tk.encode_batch_fast([t], add_special_tokens=False)[0].ids, "u4"))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a process, so that tasks of a worker share what it has encoded."""
    return Encoder(path)


held(encoder.cache_clear)


@functools.lru_cache(maxsize=8)
def vocabulary_size(path: str) -> int:
    """One more than the tokenizer's largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1
