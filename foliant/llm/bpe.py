"""Operator 9: exact byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can stand last in its encoding. A suffix automaton over the
vocabulary reads the word; its suffix links name all tokens that end at a position, longest first. Of
these candidates one is right: that which survives beside the token before it (which the shorter prefix
stores), so that no merge that the encoder would have done earlier crosses their border. The back-pointers
from the last position give the ids, and the tokens' bytes in a flat table give the text back. Vocabulary
files are a parameter.

Defined results: nulls count as empty texts; an empty text has no ids; rows are independent, so repeated
rows, ties and null or repeated doc_ids need no rule; very long texts cost time in proportion; an empty
table gives no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_bytes

#: Pre-token pattern of the byte-level vocabulary (fixed value, from the public vocabulary file's kind).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-token pattern of the word-end vocabulary (fixed value).
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the word-end path encodes itself; others go to the tokenizers library.
PLAIN = regex.compile(r"[!-~À-ɏ]+")
#: Parts that a text of the word-end vocabulary falls into whatever stands beside them: contractions, runs of
#: letters, of digits, of other signs; and whole words that hold a letter beyond ASCII and Western Europe's.
LETTER, GAP = "a-zÀ-ÖØ-öø-ÿ", " \t-\r"
PARTS = rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[0-9]+|[^{GAP}{LETTER}0-9]+"
ODD = rf"[^{GAP}!-~À-ÖØ-öø-ÿ]"
SIMPLE_PARTS, ALL_PARTS, ODD_LETTER = re.compile(PARTS), re.compile(rf"[^{GAP}]*{ODD}[^{GAP}]*|{PARTS}"), re.compile(ODD)
#: Words that a worker remembers; beyond that those of the last lot stay. A lot is about so many bytes of text.
REMEMBERED, LOT = 600_000, 1 << 20
#: Longer words are encoded one by one, so that a lot's steps stay few, and aren't remembered past their lot.
LONG = 48
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 500_000


class Places(dict):
    """Word -> its place in ``words``; a new word gets the next place."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words = words

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.words)
        self.words.append(word)
        return at


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers among sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def picked(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin where told, end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1])] if len(size) else flat[:0]


class SuffixAutomaton:
    """Suffix automaton of all words of a vocabulary, over symbols below 512.

    A vocabulary word starts where nothing precedes it, so it is the longest string of its state; the words
    that end at a position are therefore those of the state reached there (if it is matched in full) and of
    the states that its suffix links lead to.
    """

    def __init__(self, words: dict[str, int]) -> None:
        self.go: dict[int, int] = {}  # state << 9 | symbol -> state
        self.size, self.link, self.leaving = array("i", [0]), array("i", [-1]), [""]
        own: dict[int, tuple[int, int]] = {}
        for word, token in words.items():
            state = 0
            for c in word:
                state = self.extended(state, c)
            own[state] = token, len(word)
        del self.leaving
        keys = sorted(self.go)
        self.keys, self.to = np.array(keys, np.int64), np.array([self.go[k] for k in keys], np.int64)
        del self.go
        self.size, self.link = np.array(self.size, np.int64), np.array(self.link, np.int64)
        self.token = np.full(len(self.size), -1)
        for state, (token, _) in own.items():
            self.token[state] = token
        #: state -> the nearest state with a word, itself or by suffix links; 0 if there is none.
        self.holder = np.zeros(len(self.size), np.int64)
        for state in np.argsort(self.size, kind="stable")[1:].tolist():
            self.holder[state] = state if self.token[state] >= 0 else self.holder[self.link[state]]

    def step(self, state: np.ndarray, matched: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state and the length matched in it, one symbol further."""
        at, ok = found(self.keys, state << 9 | symbol)
        state, matched, to = state.copy(), matched.copy(), self.to[at]
        left = np.flatnonzero(~ok)
        while len(left):  # every symbol is a word of its own, so the first state leads on
            state[left] = self.link[state[left]]
            matched[left] = self.size[state[left]]
            at, ok = found(self.keys, state[left] << 9 | symbol[left])
            to[left] = self.to[at]
            left = left[~ok]
        return to, matched + 1

    def added(self, size: int, link: int, leaving: str) -> int:
        self.size.append(size)
        self.link.append(link)
        self.leaving.append(leaving)
        return len(self.size) - 1

    def leads(self, state: int, c: str, to: int) -> None:
        self.go[state << 9 | ord(c)] = to

    def split(self, state: int, c: str, to: int) -> int:
        """The state of the shorter strings of ``to``, parted from it where ``state`` leads there by c."""
        twin = self.added(self.size[state] + 1, self.link[to], self.leaving[to])
        for x in self.leaving[to]:
            self.leads(twin, x, self.go[to << 9 | ord(x)])
        self.link[to] = twin
        while state >= 0 and self.go.get(state << 9 | ord(c)) == to:
            self.leads(state, c, twin)
            state = self.link[state]
        return twin

    def extended(self, last: int, c: str) -> int:
        """The state of the string of ``last`` with c behind it."""
        to = self.go.get(last << 9 | ord(c))
        if to is not None:
            return to if self.size[to] == self.size[last] + 1 else self.split(last, c, to)
        new, state = self.added(self.size[last] + 1, 0, ""), last
        while state >= 0 and (to := self.go.get(state << 9 | ord(c))) is None:
            self.leads(state, c, new)
            self.leaving[state] += c
            state = self.link[state]
        if state >= 0:
            self.link[new] = to if self.size[to] == self.size[state] + 1 else self.split(state, c, to)
        return new


def byte_letters() -> dict[str, int]:
    """Letter in the vocabulary file -> byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary. A symbol is a character: the byte, plus 256 if a word ends with it."""

    def __init__(self, path: str) -> None:
        self.library = functools.partial(library, path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        end = model.get("end_of_word_suffix") or ""
        self.word_end = bool(end)

        def symbols(token: str) -> str:
            last = bool(end) and token.endswith(end)
            got = [letters[c] for c in (token[: -len(end)] if last else token)]
            if last:
                got[-1] += 256
            return "".join(map(chr, got))

        special = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        by_name = {t: i for t, i in model["vocab"].items() if t not in special}
        self.special = special
        self.bytes_of = {i: bytes(ord(c) & 255 for c in symbols(t)) for t, i in by_name.items()}
        self.bytes_of |= {v: k.encode() for k, v in special.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = by_name[a], by_name[b], by_name[a + b]
            self.merged[left, right] = rank, both
            self.parts[both] = rank, left, right
        self.whole = {symbols(t): i for t, i in by_name.items()}
        self.automaton = SuffixAutomaton({s: i for s, i in self.whole.items() if i in self.parts or len(s) == 1})
        self.pairs, self.fit = np.array([-1]), np.array([False])
        self.lasting = np.zeros(max(by_name.values()) + 1, bool)
        for i in by_name.values():
            self.lasting[i] = self.makes_itself(i)
        self.forget([])
        self.pattern = regex.compile(WORD_END if end else BYTE_LEVEL)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def fits(self, left: int, right: int) -> bool:
        """Would the encoder leave these two tokens side by side?

        Undo the two tokens' merges from the latest back. Whenever the symbols at the border form a pair
        whose merge ranks before the merges undone so far, the encoder would have joined across it.
        """
        before = 1 << 60
        while True:
            join = self.merged.get((left, right))
            if join and join[0] < before:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if not a and not b:
                return True
            # Of equal merges the encoder does the left one first, so the right one is undone first.
            if b and (not a or b[0] >= a[0]):
                before, right = b[0] + 1, b[1]
            else:
                before, left = a[0], a[2]

    def all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs; remembered ones are looked up."""
        pair = left << 20 | right
        at, ok = found(self.pairs, pair)
        if not ok.all():
            if len(self.pairs) > PAIRS:
                self.pairs, self.fit = np.array([-1]), np.array([False])
            new = np.unique(pair[~found(self.pairs, pair)[1]])
            fit = np.fromiter(map(self.fits, (new >> 20).tolist(), (new & (1 << 20) - 1).tolist()), bool, len(new))
            order = np.argsort(np.concatenate([self.pairs, new]), kind="stable")
            self.pairs, self.fit = np.concatenate([self.pairs, new])[order], np.concatenate([self.fit, fit])[order]
            at, _ = found(self.pairs, pair)
        return self.fit[at]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of symbols, end to end, and how many each word has. All words advance together, prefix by prefix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        symbols = np.frombuffer("".join(words).encode("utf-16-le"), "<u2").astype(np.int64)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        last, width = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        auto, state, matched = self.automaton, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t))  # words longer than t
            at = begin[:k] + t
            state, matched = auto.step(state[:k], matched[:k], symbols[at])
            holder = auto.holder[np.where(matched == auto.size[state], state, auto.link[state])]
            left = np.arange(k)
            while len(left):  # candidates, longest first, until one is right
                token, n = auto.token[holder[left]], auto.size[holder[left]]
                whole = n == t + 1
                ok = self.lasting[token] & whole
                ok[~whole] = self.all_fit(last[at[left] - n][~whole], token[~whole])
                last[at[left[ok]]], width[at[left[ok]]] = token[ok], n[ok]
                left = left[~ok]
                holder[left] = auto.holder[auto.link[holder[left]]]
        # Back-pointers: a token stands last where a word, or the token behind it, says so.
        stands, at = np.zeros(len(symbols), bool), begin + size - 1
        at, first = at[size > 0], begin[size > 0]
        while len(at):
            stands[at] = True
            at = at - width[at]
            at, first = at[at >= first], first[at >= first]
        count = np.zeros(len(words), np.int64)
        ends = np.concatenate([[0], np.cumsum(stands)])
        count[order] = ends[begin + size] - ends[begin]
        return last[stands], count

    @functools.lru_cache(None)  # noqa: B019  one entry a token, for the worker's life
    def makes_itself(self, token: int) -> bool:
        part = self.parts.get(token)
        return not part or (self.makes_itself(part[1]) and self.makes_itself(part[2]) and self.fits_before(*part))

    def fits_before(self, rank: int, left: int, right: int) -> bool:
        """Do both sides stand until this very merge?"""
        before = rank
        while True:
            a, b = self.parts.get(left), self.parts.get(right)
            if not a and not b:
                return True
            if b and (not a or b[0] >= a[0]):
                before, right = b[0] + 1, b[1]
            else:
                before, left = a[0], a[2]
            join = self.merged.get((left, right))
            if join and join[0] < before:
                return False

    def forget(self, words: list[str]) -> None:
        """Keep nothing but room for these words, whose ids are set anew."""
        self.places, self.done = Places(words), 0
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def symbols(self, word: str) -> list[str]:
        """The words of symbols that a part of a text stands for."""
        if not self.word_end:
            return [word.encode().decode("latin-1")]
        raw = (piece.encode().decode("latin-1") for piece in self.pattern.findall(word.lower()))
        return [x[:-1] + chr(ord(x[-1]) + 256) for x in raw]

    def learn(self) -> None:
        """Set the ids of the words that have got a place since the last call."""
        new = self.places.words[self.done :]
        direct = [w not in self.special if not self.word_end else (PLAIN.fullmatch(w) is not None and "<|" not in w) for w in new]
        parts = [self.symbols(w) if d else [] for w, d in zip(new, direct, strict=True)]
        each = [x for p in parts for x in p]
        short = [x for x in each if len(x) <= LONG]
        ids, count = self.ids_of(short)
        if len(short) < len(each):  # long words in the order that all words stand in
            pieces, rest = np.split(ids, np.cumsum(count)[:-1]) if short else [], iter(range(len(short)))
            pieces = [pieces[next(rest)] if len(x) <= LONG else self.long_ids(x) for x in each]
            ids, count = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, parts), np.int64, len(parts)))
        sizes = np.bincount(owner, count, len(new)).astype(np.int64)
        begin = np.cumsum(sizes) - sizes + len(self.flat)
        flat = [self.flat, ids.astype(np.uint32)]
        at = len(self.flat) + len(ids)
        for i in (i for i, d in enumerate(direct) if not d):
            other = np.array(self.library().encode(new[i], add_special_tokens=False).ids, np.uint32)
            flat.append(other)
            begin[i], sizes[i] = at, len(other)
            at += len(other)
        self.flat, self.begin, self.count = np.concatenate(flat), np.concatenate([self.begin, begin]), np.concatenate([self.count, sizes])
        self.done = len(self.places.words)

    def long_ids(self, word: str) -> np.ndarray:
        """Ids of one long word of symbols: the same table of prefixes, filled one by one."""
        auto, go, link = self.automaton, self.steps, self.links
        last, width, fit, state, matched = [], [], {}, 0, 0
        for end, c in enumerate(map(ord, word)):
            while (to := go.get(state << 9 | c)) is None:
                state = link[state]
                matched = int(auto.size[state])
            state, matched = to, matched + 1
            holder = int(auto.holder[state if matched == auto.size[state] else link[state]])
            while True:
                token, n = int(auto.token[holder]), int(auto.size[holder])
                if n > end:
                    ok = self.lasting[token]
                elif (ok := fit.get((last[end - n], token))) is None:
                    ok = fit[last[end - n], token] = self.fits(last[end - n], token)
                if ok:
                    break
                holder = int(auto.holder[link[holder]])
            last.append(token)
            width.append(n)
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= width[at]
        return np.array(out[::-1], np.int64)

    @functools.cached_property
    def steps(self) -> dict[int, int]:
        return dict(zip(self.automaton.keys.tolist(), self.automaton.to.tolist(), strict=True))

    @functools.cached_property
    def links(self) -> list[int]:
        return self.automaton.link.tolist()

    def of_parts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in parts, end to end, and where each text's begin and end."""
        place = self.places.__getitem__
        at = np.concatenate([np.fromiter(map(place, t), np.int64, len(t)) for t in texts])
        self.learn()
        ids, count = picked(self.flat, self.begin[at], self.count[at]), self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        if len(self.places) > REMEMBERED or any(len(w) > LONG for t in texts for w in t):
            words = self.places.words
            used = np.unique(at) if len(self.places) > REMEMBERED else np.arange(len(words))
            used = used[[len(words[i]) <= LONG for i in used.tolist()]]
            self.flat, count = picked(self.flat, self.begin[used], self.count[used]), self.count[used]
            self.places, self.done = Places([words[i] for i in used.tolist()]), len(used)
            self.begin, self.count = np.cumsum(count) - count, count
        return ids, ends[np.cumsum([0, *map(len, texts)])]

    def parts_of(self, text: bytes) -> list[str]:
        """Parts of a text whose ids don't depend on what stands beside them; special tokens of byte-level texts too."""
        if not self.word_end:
            whole = text.decode()
            if self.apart is None or "<|" not in whole:
                return self.pattern.findall(whole)
            return [w for i, x in enumerate(self.apart.split(whole)) for w in ([x] if i % 2 else self.pattern.findall(x))]
        if b"<|" in text:  # special tokens keep their case
            return [w.decode() for w in text.split()]
        lowered = text.lower().decode()
        return (ALL_PARTS if ODD_LETTER.search(lowered) else SIMPLE_PARTS).findall(lowered)

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """For each text its ids, in order; lots of about LOT bytes are worked on together."""
        lot: list[list[str]] = []
        held = 0
        for text in texts:
            lot.append(self.parts_of(text))
            if (held := held + len(text)) >= LOT:
                ids, bounds = self.of_parts(lot)
                yield from (ids[a:b] for a, b in itertools.pairwise(bounds.tolist()))
                lot, held = [], 0
        if lot:
            ids, bounds = self.of_parts(lot)
            yield from (ids[a:b] for a, b in itertools.pairwise(bounds.tolist()))

    @functools.cached_property
    def octets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes end to end; where each token's begin, and how many they are."""
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        size = np.array([len(t) for t in tokens])
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        flat, begin, size = self.octets
        return picked(flat, begin[ids], size[ids]).tobytes()


@functools.lru_cache(4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


@functools.lru_cache(4)
def library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def ids_of_texts(texts: Iterable[bytes], path: str) -> Iterator[np.ndarray]:
    """For each text its ids (32-bit), as the tokenizers library gives them."""
    return loaded(path).encode(texts)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, ids binary (little-endian unsigned 32-bit), decoded binary.

    Exactly the ids of the tokenizers library for a byte-level vocabulary file without special tokens
    added; decoding them gives the text back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids, decoded = [], []
            for x in bpe.encode(t.as_py() for t in batch["_text"]):
                ids.append(x.astype("<u4").tobytes())
                decoded.append(bpe.decode(x))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest of ``encode_documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


