"""Token ids of whole texts with the tokenizers library, one encoding for each different piece of text.

A piece is a stretch that the vocabulary's own pre-tokenizer never joins to its neighbours, so the ids of a text are
the ids of its pieces in order. Pieces repeat far more often than texts: each is encoded once and then looked up.
Strings of added tokens (an end-of-text mark, say) get their own ids wherever they stand in a text, as the library gives
them; what is between two of them is encoded as a text of its own.
"""

from __future__ import annotations

import json
import os
import re
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters with Unicode property White_Space, as a character class body.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: By kind of vocabulary: "word" drops white space and never joins across it; in "byte" one space joins what follows.
PIECES = {
    "word": re.compile(f"[^{SPACES}]+"),
    "byte": re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]"),
}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What stands between pieces that are encoded in one call; its one id stems from no other text.
BETWEEN = {"word": " \x01 ", "byte": "\n"}


# White space but for the space and the line end, and NUL.
UNUSUAL = "\0\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that end a word for either pre-tokenizer (an apostrophe may not).
MARKS = ".,;:!?*$%&#)"
CONTROLS = UNUSUAL[:5]
TWO = [a + b for a in " \n" for b in " \n"]
THREE = [a + b for a in TWO for b in " \n"]


#: Pieces of Latin-1 letters (in "byte" behind a space), which RULES leave as they are, in one stretch.
LETTERS = {"word": re.compile("[a-z\xdf-\xf6\xf8-\xff]+"), "byte": re.compile(" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")}


def _bytes(regex: bool) -> dict:
    return {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": regex}


SPACE = "\u0120"  # as vocabularies of bytes write it
# Normalizer and pre-tokenizer, as the vocabularies' files have them.
STRETCHES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": STRETCHES}, "behavior": "Removed", "invert": True}, _bytes(False)]},
    ),
    "byte": (None, _bytes(True)),
}


def _state(part) -> dict | None:
    return None if part is None else json.loads(part.__getstate__())


class _Index(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        return at


class PieceEncoder:
    """Encodes lists of texts. It keeps at most ``limit`` pieces beyond those of one call, then starts afresh."""

    def __init__(self, path: str, kind: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: i for content, (i, _) in added.items()}
        # The longest of those that begin at the leftmost place.
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        normal = self.tokenizer.normalizer is not None
        #: Added tokens that are more than their string (matched in normalized text, or with what is around).
        self.whole = any(t.lstrip or t.rstrip or t.single_word or (t.normalized and normal) for _, t in added.values())
        self.own = Tokenizer.from_file(path) if self.whole else None
        self.tokenizer.encode_special_tokens = True  # pieces never hold the strings, but in lower case they may seem to
        self.kind, self.find, self.limit, self.between = kind, PIECES[kind].findall, limit, BETWEEN[kind]
        (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.letters = self._for_letters()
        self._clear()

    def _for_letters(self):
        """The same model behind rules that only cut at spaces; None if the vocabulary's own are not RULES."""
        from tokenizers import Tokenizer, pre_tokenizers

        if RULES.get(self.kind) != (_state(self.tokenizer.normalizer), _state(self.tokenizer.pre_tokenizer)):
            return None
        quick = Tokenizer(self.tokenizer.model)
        cut = pre_tokenizers.WhitespaceSplit() if self.kind == "word" else pre_tokenizers.Split(" ", "merged_with_next")
        quick.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Of the ids of a piece only the last one bears the mark of an end, or only the first one the space.
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.kind == "byte":
            self.edge[[i for t, i in vocabulary.items() if t[:1] == SPACE]] = True
        elif suffix:
            self.edge[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return quick

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep only what was used again since the last time; nothing, if that is still too much."""
        kept = np.flatnonzero(self.used > 2)
        if len(kept) > self.limit // 2:
            return self._clear()
        again = self.used > 2
        self.index = _Index((p, i) for i, p in enumerate(compress(self.index, again)))
        self.flat, self.sizes = self.flat[_runs(self.starts[kept], self.sizes[kept])], self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.used = np.zeros(len(kept), np.int64)

    def _learn(self) -> None:
        """Encode what was met for the first time; a word with marks behind it is put together from both."""
        known, get = len(self.starts), self.index.__getitem__
        fresh = list(islice(self.index, known, None))
        if not fresh:
            return
        whole, core, tail = [], [], []
        for code, piece in enumerate(fresh, known):
            if piece[-1:] in MARKS:
                word = piece.rstrip(MARKS)
                if word and word[-1].isalpha() and word[-1] < "\u0100":
                    whole.append(code)
                    core.append(get(word))
                    tail.append(get(piece[len(word) :]))
        fresh += islice(self.index, known + len(fresh), None)
        alone = np.ones(len(fresh), bool)
        alone[np.array(whole, np.int64) - known] = False
        flat, at, found = self._ids(list(compress(fresh, alone)))
        sizes, starts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        sizes[alone], starts[alone] = found, len(self.flat) + at
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        if whole:
            both = np.stack([core, tail], axis=1)
            sizes = self.sizes[both]
            self.sizes[whole] = sizes.sum(axis=1)
            self.starts[whole] = len(self.flat) + np.cumsum(self.sizes[whole]) - self.sizes[whole]
            self.flat = np.concatenate([self.flat, self.flat[_runs(self.starts[both].ravel(), sizes.ravel())]])

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of at least one piece in any order; where each piece's ids begin, and how many they are."""
        plain = np.zeros(len(pieces), bool)
        if self.letters is not None:
            plain = np.fromiter((m is not None for m in map(LETTERS[self.kind].fullmatch, pieces)), bool, len(pieces))
        found = self._of_letters(list(compress(pieces, plain))) if plain.any() else None
        if found is None:
            flat, sizes = self._together(pieces)
            return flat, np.cumsum(sizes) - sizes, sizes
        flat, own = found
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[plain], starts[plain] = own, np.cumsum(own) - own
        if not plain.all():
            more, own = self._together(list(compress(pieces, ~plain)))
            sizes[~plain], starts[~plain] = own, len(flat) + np.cumsum(own) - own
            flat = np.concatenate([flat, more])
        return flat, starts, sizes

    def _of_letters(self, pieces: list[str], most: int = 2048) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and numbers of ids of pieces of letters; None if edges are missing (the vocabulary lacks a byte, say)."""
        between = " " if self.kind == "word" else ""
        joined = (between.join(pieces[i : i + most]) for i in range(0, len(pieces), most))
        flat = np.concatenate([np.array(self.letters.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) for x in joined])
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(pieces):
            return None
        return flat, np.diff(edges, prepend=-1) if self.kind == "word" else np.diff(edges, append=len(flat))

    def _together(self, pieces: list[str], most: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of at least one piece; pieces of white space or with the mark's own character go one by one."""
        mark = self.between.strip(" ")
        alone = [i for i, p in enumerate(pieces) if mark in p or not p or p.isspace()]
        rest = pieces
        if alone:
            rest = pieces.copy()
            for i in alone:
                rest[i] = "a"
        joined = [self.between.join(rest[i : i + most]) for i in range(0, len(rest), most)]
        ids = [np.array(x.ids + [self.mark], np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(ids)
        marks = np.flatnonzero(flat == self.mark)
        sizes = np.diff(marks, prepend=-1) - 1
        flat = np.delete(flat, marks)
        if not alone:
            return flat, sizes
        starts = np.cumsum(sizes) - sizes
        own = [self.tokenizer.encode(pieces[i], add_special_tokens=False).ids for i in alone]
        more = np.fromiter(map(len, own), np.int64, len(own))
        starts[alone] = len(flat) + np.cumsum(more) - more
        sizes[alone] = more
        flat = np.concatenate([flat, np.array([i for x in own for i in x], np.uint32)])
        return flat[_runs(starts, sizes)], sizes

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; where each text's ids stop). None counts as empty."""
        texts = [t or "" for t in texts]
        if self.whole:
            lists = [self.own.encode(t, add_special_tokens=False).ids + [end] for t in texts]
            return np.array([i for x in lists for i in x], np.uint32), np.cumsum([len(x) for x in lists])
        if not any(content in t for content in self.added for t in texts):
            return self._encode(texts, end)
        parts, after, last = [], [], []
        for t in texts:
            at = 0
            for m in self.split.finditer(t):
                parts.append(t[at : m.start()])
                after.append(self.added[m.group()])
                at = m.end()
            parts.append(t[at:])
            after.append(end)
            last.append(len(parts) - 1)
        ids, stops = self._encode(parts, end)
        ids[stops - 1] = after
        return ids, stops[last]

    def _encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        if len(self.index) > self.limit:
            self._forget()
        codes, counts = self._codes(texts)
        self._learn()
        self.used = np.concatenate([self.used, np.zeros(len(self.index) - len(self.used), np.int64)]) + np.bincount(codes, minlength=len(self.index))
        sizes = self.sizes[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        stops = upto[np.cumsum(counts)] + np.arange(1, len(texts) + 1)
        out = np.full(int(upto[-1]) + len(texts), end, np.uint32)
        mask = np.ones(len(out), bool)
        mask[stops - 1] = False
        out[mask] = self.flat[_runs(self.starts[codes], sizes)]
        return out, stops

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, and how many pieces each has."""
        plain = [self.kind == "word" or _is_plain(t) for t in texts]
        if self.kind == "word":
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        else:
            marked = [t.replace("\n", "\0\n\0").replace(" ", "\0 ") if p else "" for t, p in zip(texts, plain)]
            lists = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        get = self.index.__getitem__
        known = np.fromiter(map(get, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words.dictionary))
        codes, starts, counts = known[words.indices.to_numpy()], offsets[:-1] - offsets[0], np.diff(offsets)
        if all(plain):
            return codes, counts
        own = [list(map(get, self.find(t))) if not p else [] for t, p in zip(texts, plain)]
        more = np.fromiter(map(len, own), np.int64, len(own))
        at = len(codes) + np.cumsum(more) - more
        codes = np.concatenate([codes, np.array([c for x in own for c in x], np.int64)])
        plain = np.array(plain)
        counts = np.where(plain, counts, more)
        return codes[_runs(np.where(plain, starts, at), counts)], counts


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of the ranges [start, start + size), one range after another."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _is_plain(text: str) -> bool:
    """White space is spaces and line ends, nowhere more than two at once: pieces then end before each of them."""
    has = text.__contains__
    if any(map(has, CONTROLS if text.isascii() else UNUSUAL)):
        return False
    return not any(map(has, TWO)) or not (any(map(has, THREE)) or text[-2:] in TWO)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str, limit: int = 300_000) -> PieceEncoder:
    """The encoder of this Python worker: what it has learnt serves the worker's later tasks too."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind, limit)
    return _ENCODERS[path, kind]
