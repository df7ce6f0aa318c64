"""Token ids of whole texts with a public tokenizer file, a batch of texts at a time."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a generation of a worker's memo of pieces. Two are kept, so its memory (some 200 bytes an entry) is bounded.
MEMO = 150_000
#: Characters of a block of texts whose equal pieces are looked up once.
BLOCK_CHARS = 10_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(other)}


BYTE_CHARS = _byte_chars()


#: A run of these after letters is a token of its own to the pre-tokenizers (an apostrophe may begin a contraction).
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class Memo:
    """Ids (little-endian unsigned 32-bit bytes) of pieces, asked of the library when first met.

    words has pieces of Latin-1 letters alone (maybe after a line feed): to the pre-tokenizer one token that NFC leaves as
    it is and that stays letters in lower case. Punctuation after them is a token of its own, so such pieces share the
    entry of their letters. others has all other pieces, whole. A piece means the same whatever was asked before.
    """

    def __init__(self, library, lower: bool):
        self.library, self.tokens, self.lower = library, library.model.tokenize, lower
        self.words, self.old_words, self.others, self.old_others = {}, {}, {}, {}
        self.tails, self.line = {}, self.ask("\n")

    def ask(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Without a mark of its own, a piece of a tokenizer that keeps white space stands after a space."""
        if len(self.words) > MEMO:
            self.words, self.old_words = {}, self.words
        if len(self.others) > MEMO // 4:
            self.others, self.old_others = {}, self.others
        out = list(map(self.words.get, pieces))
        new: dict[str, list[int]] = {}
        for i, ids in enumerate(out):
            if ids is None:
                p = pieces[i]
                ids = self.word(p) or self.others.get(p)
                if ids is None:
                    new.setdefault(p, []).append(i)
                out[i] = ids
        if new:
            ask = [p for p in new if p not in self.old_others]
            texts = [p if self.lower or p[0] == "\n" else p[1:] if p[0] == "\0" else " " + p for p in ask]
            asked = dict(zip(ask, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True))
            for p, where in new.items():
                ids = array("I", asked[p].ids).tobytes() if p in asked else self.old_others[p]
                if len(p) < 256:
                    self.others[p] = ids
                for i in where:
                    out[i] = ids
        return out

    def word(self, piece: str) -> bytes | None:
        """Ids of Latin-1 letters and punctuation after them; else nothing."""
        stem = piece.rstrip(PUNCTUATION)
        ids = self.words.get(stem)
        if ids is None:
            ids = self.old_words.get(stem) or self.letters(stem)
            if ids is None:
                return None
            self.words[stem] = ids
        if len(stem) == len(piece):
            return ids
        tail = piece[len(stem) :]
        more = self.tails.get(tail)
        if more is None:
            more = self.ask(tail)
            if len(tail) < 4:
                self.tails[tail] = more
        return ids + more

    def letters(self, stem: str) -> bytes | None:
        first = stem[:1]
        free = not self.lower and (first == "\n" or first == "\0")
        text = stem[1:] if free else stem
        if not text.isalpha():
            return None
        if self.lower:
            text = text.lower()
        if not text.isascii():
            if max(stem) > "\xff":
                return None
            text = text.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = array("I", [x.id for x in self.tokens(text if self.lower or free else "\u0120" + text)]).tobytes()
        return self.line + ids if first == "\n" else ids


class Encoder:
    """Ids of texts; equal to the library's encode(text, add_special_tokens=False), whatever was encoded before.

    Texts are cut where no token can cross, and the equal pieces of a block are looked up once: at ASCII white space if
    the tokenizer drops white space (and lower-cases); else before each single space or line feed between other
    characters. A text with white space that the cut doesn't cover is encoded whole.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.drops_space, self.memo = drops_space, Memo(Tokenizer.from_file(path), drops_space)

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As texts(), with end_id after each text."""
        for ids, ends in self.texts(texts):
            yield np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of blocks of texts, in order: text i of a block has the ids from ends[i - 1] to ends[i]. Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BLOCK_CHARS
        starts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield self.block(texts[a:b])

    def pieces(self, texts: pa.Array) -> pa.Array:
        """The list of pieces of each text."""
        if self.drops_space:
            return pc.ascii_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, r"[ \n]{2}|[\x00-\x09\x0B-\x1F\x7F]|[\x{80}-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n]$")
        first = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(pc.replace_substring(first, "\n", " \n"), " ")
        if not pc.any(odd).as_py():
            return parts
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), first)
        return pc.if_else(odd, whole, parts)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self.pieces(texts)
        places = parts.flatten().dictionary_encode()
        which = places.indices.to_numpy()
        found = self.memo.many(places.dictionary.to_numpy(zero_copy_only=False).tolist())
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n
        count = n[which]
        ends = np.cumsum(count)
        ids = flat[np.repeat(first[which] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        return ids, np.append(0, ends)[last]


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> Encoder:
    """One per worker process."""
    return Encoder(path, drops_space)
