"""Byte-level BPE encoding and decoding, exact to the ``tokenizers`` library.

*Pre-tokens never cross a single space.* A space between two characters that aren't white
space always starts a pre-token, and what follows it doesn't depend on what comes before.
So a text is cut at such spaces and the parts are encoded on their own, most of them from
a cache; parts come back as packed little-endian 32-bit ids, and a document is a join of
byte strings.

*Tree concatenation.* A pre-token longer than ``LEAF`` bytes (text without any split) is
halved again and again; the leaves are encoded in parallel threads. At each join a window
of tokens around it is encoded again, and grows until both its sides agree: until the
tokens at either edge of the window form a pair that BPE itself leaves as it is. A
sequence all of whose neighbours do so is the BPE encoding of its bytes, so this is exact.
"""

from __future__ import annotations

import json
import re
from array import array
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np

LEAF = 2048
CACHE = 250_000
THREADS = 4
#: Where a space that isn't beside white space starts a part.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Characters on which all regular expression engines agree about letters and digits.
_PLAIN = re.compile("[\x00-\x1b !-~¡-©«-±´¶-¸»¿-ſ‐-‧€]*\\Z")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    for themselves, the others, in order, for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A tokenizer read from a ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        plain = plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # added tokens are found as they stand: one that takes spaces, or whole words alone, would be another encoding
        plain = plain and not any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word"))
        if not plain or merged != sorted(set(merged)):
            raise ValueError(f"{path} isn't plain byte-level BPE whose ids follow its merges")
        byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.token = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.token[i] = t
        self._core = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._core._encode_single_piece
        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ordinary_ids = self._core._core_bpe.encode_ordinary
        self._length = np.array([len(t) for t in self.token])
        self._cache: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    # ---- encoding

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Parts that the cache lacks are encoded in one call."""
        split = [self._split(t) for t in texts]
        seen = set().union(*(parts for _, parts in split if parts))
        self._learn(seen.difference(self._cache))
        get = self._cache.get
        out = []
        for text, (head, parts) in zip(texts, split, strict=True):
            if parts is None:
                out.append(self._slow(text) if text else b"")
            else:
                ids = list(map(get, parts))
                out.append(self._slow(text) if None in ids else self._encode_part(head) + b"".join(ids))
        if len(self._cache) > CACHE:
            cache = self._cache
            self._cache = {p: cache[p] for p in seen if p in cache}
        return out

    def _split(self, text: str | None) -> tuple[str, list[str] | None]:
        """The part before the first space and the parts after spaces, if each such space
        is single and the text has no added tokens."""
        if not text or (self._specials and self._specials.search(text)):
            return "", None
        head, *parts = text.split(" ")
        if "" in parts or not head or head[-1].isspace():
            return "", None
        return head, parts

    def _learn(self, parts: set[str]) -> None:
        """Cache the ids of parts that follow a space; not of those that begin or end with
        white space, whose texts go the slow way."""
        easy = []
        for p in parts:
            if p[0].isspace() or p[-1].isspace():
                continue
            if len(p) <= LEAF // 4 and (p.isascii() or _PLAIN.match(p)):
                easy.append(p)
            else:
                self._cache[p] = self._encode_part(" " + p)
        if not easy:
            return
        joined = " " + " ".join(easy)
        ids = np.array(self._ordinary_ids(joined), "<u4")
        raw = ids.tobytes()
        starts = np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 32)
        begin = np.cumsum(self._length[ids]) - self._length[ids]
        at = (4 * np.searchsorted(begin, starts)).tolist()
        self._cache.update(zip(easy, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))

    def _slow(self, text: str) -> bytes:
        """Any text: cut at added tokens, then where a part may start."""
        if self._specials and self._specials.search(text):
            parts = self._specials.split(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._slow(p) for p in parts if p)
        return b"".join(map(self._encode_part, _CUT.split(text)))

    def _encode_part(self, part: str) -> bytes:
        if not part:
            return b""
        if len(part) <= LEAF // 4:
            if part.isascii() or _PLAIN.match(part):
                return array("I", self._ordinary_ids(part)).tobytes()
            return array("I", self._whole.encode(part, add_special_tokens=False).ids).tobytes()
        out: list[int] = []
        for _, (a, b) in self._whole.pre_tokenizer.pre_tokenize_str(part):
            piece = part[a:b].encode("utf-8", "surrogatepass")
            out += self.encode_unsplit(piece)
        return array("I", out).tobytes()

    # ---- text without any split

    def encode_unsplit(self, piece: bytes, leaf: int = LEAF) -> list[int]:
        """BPE of one pre-token, by tree concatenation if it is long."""
        if len(piece) <= leaf:
            return self._piece(piece)
        leaves = [piece[i : i + leaf] for i in range(0, len(piece), leaf)]
        with ThreadPoolExecutor(THREADS) as pool:
            level = list(pool.map(self._piece, leaves))
            while len(level) > 1:
                pairs = [(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
                level = list(pool.map(lambda p: p[0] if p[1] is None else self.concatenate(*p), pairs))
        return level[0]

    def concatenate(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves' joined bytes."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._piece(b"".join(self.token[t] for t in [*left[len(left) - i :], *right[:j]]))
            fits_left = i == len(left) or self._stays(left[-i - 1], window[0])
            fits_right = j == len(right) or self._stays(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if fits_left else 2 * i), (j if fits_right else 2 * j)

    def _stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves these neighbours as they are."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self._piece(self.token[a] + self.token[b]) == [a, b]
        return known

    # ---- decoding

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        token = self.token
        return b"".join([token[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
