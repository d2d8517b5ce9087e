"""Encoding with the installed tokenizer libraries, with results kept per part of a text.

`WordEncoder` and `PieceCounter` give exactly what the library gives for the whole text. They use
that the two vocabularies never join characters across certain white space, so the parts between
can be encoded once and looked up. Parts or texts that do not plainly follow those rules go to the
library as they are. The tables of known parts have a fixed size, so memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablegauge.llm.common import worker_table

GENERATION = 150_000
LIBRARY_PARTS = 64

#: Longer parts are not kept in the tables, whose size would else not be bounded by their number.
KEPT_CHARACTERS = 64

#: Words of characters below U+0180, where lower case, letters and digits are beyond doubt (U+0130
#: is left out, its lower case has a combining mark), and the vocabulary's own pieces of them.
_PLAIN_WORD = "^[\\x21-\\x7e\\x{a1}-\\x{12f}\\x{131}-\\x{17f}]+$"
_LETTERS = "a-z\\x{aa}\\x{b5}\\x{ba}\\x{df}-\\x{f6}\\x{f8}-\\x{180}"
_DIGITS = "0-9\\x{b2}\\x{b3}\\x{b9}\\x{bc}-\\x{be}"
_PLAIN_PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; only the default of a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known:
    """A table of at most two generations; what is asked for again moves into the young one."""

    def __init__(self) -> None:
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def split(self, keys: set[str]) -> tuple[dict[str, Any], set[str]]:
        """What is known of these keys, as a small table, and the keys that are new."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = keys.difference(young)
        for k in [k for k in new if k in old]:
            young[k] = old[k]
            new.discard(k)
        found = keys.difference(new) if new else keys
        return dict(zip(found, map(young.__getitem__, found), strict=True)), new

    def find(self, keys: list[str]) -> list[Any]:
        """What is known of each of these distinct keys, None for what is new."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, keys))
        if self.old:
            for i in [i for i, x in enumerate(found) if x is None]:
                x = self.old.get(keys[i])
                if x is not None:
                    found[i] = self.young[keys[i]] = x
        return found

    def learn(self, pairs: dict[str, Any]) -> None:
        self.young.update(pairs)


def _joined(parts: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """One value for each run of `parts`, an array of its own; `ends` counts the parts up to the end of each run."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy())])
    offsets = at[np.concatenate([[0], ends])].astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), parts.buffers()[2] or pa.py_buffer(b"")])


def _list_ends(lists: pa.LargeListArray) -> np.ndarray:
    return np.cumsum(pc.list_value_length(lists).to_numpy())


class WordEncoder:
    """Ids of texts under a vocabulary that drops white space and marks the end of every word.

    Arrow cuts texts into white-space words and these into the vocabulary's pieces; Python looks up
    each distinct piece of a batch once, and the library encodes the new ones.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        from tokenizers import Tokenizer, pre_tokenizers

        # the same model for pieces, which are normalized and parted already
        self.piece_tokenizer = Tokenizer(self.tokenizer.model)
        self.piece_tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words = Known()
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.is_end[ends] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Many pieces go in one text, a piece to a word; the ids that end a word tell them apart."""
        out: list[bytes] = []
        for at in range(0, len(pieces), LIBRARY_PARTS * LIBRARY_PARTS):
            some = pieces[at : at + LIBRARY_PARTS * LIBRARY_PARTS]
            texts = [" ".join(some[i : i + LIBRARY_PARTS]) for i in range(0, len(some), LIBRARY_PARTS)]
            encoded = self.piece_tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in encoded])
            ends = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
            whole, start = ids.tobytes(), 0
            for _, end in zip(some, ends, strict=True):
                out.append(whole[start:end])
                start = end
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts: pieces of plain words, and other words as they are."""
        found = self.words.find(parts)
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            plain = self._plain(pa.array([parts[i] for i in new], pa.large_string())).to_numpy(zero_copy_only=False).tolist()
            pieces = [i for i, known in zip(new, plain, strict=True) if known]
            others = [i for i, known in zip(new, plain, strict=True) if not known]
            encoded = self._encode_pieces([parts[i] for i in pieces]), self._library([parts[i] for i in others])
            for places, blobs in zip((pieces, others), encoded, strict=True):
                for i, blob in zip(places, blobs, strict=True):
                    found[i] = blob
            self.words.learn({parts[i]: found[i] for i in new if len(parts[i]) <= KEPT_CHARACTERS})
        return found

    @staticmethod
    def _plain(words: pa.LargeStringArray) -> pa.BooleanArray:
        return pc.and_not(pc.match_substring_regex(words, _PLAIN_WORD), pc.match_substring(words, "<|"))

    def _encode_words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), _PLAIN_PIECE, "\\0 ")
        parts = pc.split_pattern(pc.if_else(self._plain(words), spaced, words), " ")
        numbered = parts.flatten().dictionary_encode()
        found = self._encode_parts(numbered.dictionary.to_pylist())
        return _joined(pa.array(found, pa.large_binary()).take(numbered.indices), _list_ends(parts))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and `end_id` after them; a null counts as empty.

        Words are cut and numbered by Arrow, so each distinct word of the batch is parted once.
        """
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]")
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts)
        numbered = words.flatten().dictionary_encode()
        encoded = self._encode_words(numbered.dictionary).take(numbered.indices)
        out = [x + end for x in _joined(encoded, _list_ends(words)).to_pylist()]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._library([texts[i].as_py()])[0] + end
        return out


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    return worker_table(("words", path), lambda: WordEncoder(path))


#: The byte-level vocabulary's own pre-tokens, for texts of plain characters only.
_PRE_TOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ]+"
    r"| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\sA-Za-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ\xb2\xb3\xb9\xbc-\xbe]+|\s+(?!\S)|\s+"
).findall
_PLAIN_TEXT = re.compile("[\t\n\r\x20-\x7e\xa1-ſ]*").fullmatch
class PreTokenizer:
    """Parts texts into a byte-level vocabulary's pre-tokens.

    A text is cut before each space; a cut part is parted once and looked up after. A text with
    two spaces in a row or one at its end, where a pre-token may hold a space with others, is parted
    whole, and so is one with special strings, which count as one token each.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.whole = "  | $" + "".join("|" + re.escape(x) for x in added)
        self.units = Known()

    def _pre_tokens(self, text: str) -> list[str]:
        if _PLAIN_TEXT(text):
            return _PRE_TOKENS(text)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def _units(self, units: list[str]) -> list[tuple[str, ...]]:
        known, new = self.units.split(set(units))
        found = {u: tuple(self._pre_tokens(u)) for u in new}
        self.units.learn(found)
        known |= found
        return list(map(known.__getitem__, units))

    def frequencies(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens; entries (number of the pre-token, of the text, and how often), in which a
        pair may come more than once; and the number of special strings in each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), dtype=np.int64)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        # units are what stands before, between and after single spaces; all but the first keep theirs
        units = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        numbered = units.flatten().dictionary_encode()
        ends = units.offsets.to_numpy()[1:] - units.offsets.to_numpy()[0]
        starts = np.concatenate([[0], ends[:-1]])
        names = numbered.dictionary.to_pylist()
        number = numbered.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(number), dtype=bool)
        first[starts] = True
        number[~first] += len(names)
        owner = np.repeat(np.arange(len(texts)), ends - starts)
        pairs, often = np.unique(owner * (2 * len(names)) + number, return_counts=True)
        owner, number = np.divmod(pairs, 2 * len(names)) if len(pairs) else (pairs, pairs)
        used = np.unique(number)
        parted = self._units([names[i] if i < len(names) else " " + names[i - len(names)] for i in used.tolist()])
        places: dict[str, int] = {}
        flat = np.array([places.setdefault(t, len(places)) for unit in parted for t in unit], dtype=np.int64)
        sizes = np.fromiter(map(len, parted), dtype=np.int64, count=len(parted))
        unit = np.searchsorted(used, number)
        each = sizes[unit]
        at = np.cumsum(each)
        token = flat[np.arange(at[-1] if len(at) else 0) + np.repeat((np.cumsum(sizes) - sizes)[unit] - at + each, each)]
        owner, often = np.repeat(owner, each), np.repeat(often, each)
        more: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(whole).tolist():
            parts = self.special.split(texts[i].as_py())
            special[i] = len(parts) - 1
            for t, n in Counter(t for part in parts for t in self._pre_tokens(part)).items():
                more.append((places.setdefault(t, len(places)), i, n))
        if more:
            token, owner, often = (np.concatenate([a, b]) for a, b in zip((token, owner, often), np.array(more).T, strict=True))
        return list(places), token, owner, often, special

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]
