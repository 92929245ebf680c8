"""Token ids of whole texts by a public tokenizer file, with a bounded cache of encoded pieces.

Both tokenizer kinds split a text into pre-tokens before they merge, and no pre-token spans the
places where we cut:

* `drops_space` (word ends, white space dropped): cut at white space, which yields no ids;
* otherwise (byte level): cut into `[space]word` and runs of white space, which are unions of the
  tokenizer's own pre-tokens;
* in texts of Latin-1 characters without apostrophes (no contractions, nothing to compose) also
  between letters and other characters, which no pre-token spans either.

So the ids of a text are its pieces' ids in a row, and each distinct piece goes through the
library once per worker and cache life instead of once per occurrence.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from tessella.llm.common import hold

#: Code points with the Unicode property White_Space, as the tokenizer's \s takes them.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The letters (Unicode category L) of Latin-1.
LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
BLANKS = f"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
BYTE_PIECES = re.compile(f" ?[^{SPACE}]+|{BLANKS}")
BYTE_LATIN_PIECES = re.compile(f" ?[{LATIN}]+| ?[^{SPACE}{LATIN}]+|{BLANKS}")
#: Characters that str.split() cuts at although they aren't white space to the tokenizer.
ONLY_SPLIT = re.compile("[\x1c-\x1f]")
WORD_PIECES = re.compile(f"[^{SPACE}]+")
WORD_LATIN_PIECES = re.compile(f"[{LATIN}]+|[^{SPACE}{LATIN}]+")
#: What keeps a text from being cut by plain replacement: a full stop or comma that isn't between a
#: letter or digit and a letter, digit, blank or end; a run of blanks; the mark that we cut at.
MARK = "\x00"
NOT_PLAIN_STOPS = re.compile(f"[.,](?:(?<=[^{LATIN}0-9][.,])|(?![{LATIN}0-9 \\n]|\\Z))")
NOT_PLAIN_BLANKS = ("  ", " \n", "\n ", "\n\n", *"\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
#: Pieces that are one pre-token and stay so when they are put one after another.
ONE_BYTE_TOKEN = re.compile(f" [{LATIN}]+\\Z")
ONE_WORD_TOKEN = re.compile(f"[{LATIN}]+\\Z")
#: Texts are encoded in groups of about so many characters, each with one call for what is new.
GROUP_CHARS = 1_000_000


def _plain(text: str) -> bool:
    if "'" in text or "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _odd_stops(text: str) -> bool:
    return text[:1] in (".", ",") or NOT_PLAIN_STOPS.search(text) is not None


class _Known(dict):
    """Piece -> ids; a piece that isn't known yet gives None and is noted in `new`."""

    def __init__(self, *a):
        super().__init__(*a)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.new.append(piece)


class CachedEncoder:
    """Token ids as little-endian bytes, `width` bytes each (2 where the vocabulary fits)."""

    def __init__(self, path: str, cache_entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        self.drops_space = (spec.get("pre_tokenizer") or {}).get("type") == "Sequence"
        self.limit = cache_entries
        self.cache = _Known({"": b""})

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn(self, pieces: list[str]) -> None:
        """Put the pieces' ids into the cache. Words go through the library as one text, by which a
        piece costs half as much; which ids are whose is told by the library's word numbers."""
        one, mark = (ONE_WORD_TOKEN, " ") if self.drops_space else (ONE_BYTE_TOKEN, "")
        words = [p for p in pieces if one.match(p)]
        rest = [p for p in pieces if not one.match(p)]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            enc = self.tokenizer.encode(mark.join(part), add_special_tokens=False)
            number = np.array(enc.word_ids)
            if number[-1] != len(part) - 1:
                rest += part
                continue
            ends = (np.searchsorted(number, np.arange(len(part) + 1)) * self.width).tolist()
            ids = np.array(enc.ids, self.dtype).tobytes()
            self.cache.update(zip(part, (ids[a:b] for a, b in itertools.pairwise(ends)), strict=True))
        for at in range(0, len(rest), 50_000):
            part = rest[at : at + 50_000]
            self.cache.update(zip(part, self._ids(part), strict=True))

    def _pieces(self, text: str) -> list[str]:
        plain = _plain(text)
        if self.drops_space:
            if not plain:
                return WORD_PIECES.findall(text)
            # lower case as the tokenizer does it (character by character), for fewer pieces
            text = text.lower()
            if _odd_stops(text) or ONLY_SPLIT.search(text):
                return WORD_LATIN_PIECES.findall(text)
            return text.replace(".", " . ").replace(",", " , ").split()
        if plain:
            if any(x in text for x in NOT_PLAIN_BLANKS) or _odd_stops(text):
                return BYTE_LATIN_PIECES.findall(text)
            for old, new in ((" ", "\0 "), (".", "\0."), (",", "\0,"), ("\n", "\0\n\0")):
                text = text.replace(old, new)
            return text.split(MARK)
        # a special token may hold spaces, so a text that might have one stays whole
        return [text] if "<|" in text else BYTE_PIECES.findall(text)

    def encode_group(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        look, new = self.cache.__getitem__, self.cache.new
        ids = [list(map(look, p)) for p in pieces]
        if new:
            missing = list(set(new))
            new.clear()
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
                self.cache[""] = b""
                missing = list(set().union(*pieces))
            self._learn(missing)
            ids = [x if None not in x else list(map(look, p)) for x, p in zip(ids, pieces, strict=True)]
        return [b"".join(x) for x in ids]

    def encode_many(self, texts: list[str]):
        """ids of each text, in order."""
        group, chars = [], 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= GROUP_CHARS:
                yield from self.encode_group(group)
                group, chars = [], 0
        if group:
            yield from self.encode_group(group)

    def encode(self, text: str) -> bytes:
        return self.encode_group([text])[0]


_encoders: dict[tuple[str, int], CachedEncoder] = {}


def encoder(path: str, cache_entries: int = 500_000) -> CachedEncoder:
    """This worker's encoder for a tokenizer file; the cache lives as long as the worker."""
    key = path, cache_entries
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, cache_entries)
        hold(_encoders.clear)
    return _encoders[key]


def le32(ids: bytes, width: int) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
