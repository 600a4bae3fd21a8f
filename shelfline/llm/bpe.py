"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix of a piece of text ends in one token, and that
last token is unique. The vocabulary's automaton reports, for every end
position, the tokens that end there, longest first; the first whose
predecessor (the last token of the prefix before it) may stand next to it is
the last token of this prefix. Two tokens may stand side by side if merging
their join never happens before the merges that make them. Back-pointers then
give the ids of the whole piece, in time linear in its length.

Pieces come from the tokenizer's own splitting pattern. A worker remembers the
pieces it has met, up to a bound, and forgets them together when it is full;
that changes the time only.

Null text is empty: no tokens. Special strings in a text give their own id, as
the library does by default. Repeated rows are encoded each for itself. A very
long text is encoded whole, also if it is a single piece. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from shelfline.llm.common import per_batch

#: The splitting pattern of the byte-level tokenizers; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALL_PIECES = regex.compile(PATTERN).findall
#: The same split for texts of ASCII and Latin letters only, where plain character classes say what \p{L} does.
LETTER, BLANK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"\t-\r "
USUAL_PIECES = re.compile(rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{BLANK}{LETTER}0-9]+"
                          rf"|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall
UNUSUAL = re.compile("[^\x00-\x1b -~\xc0-\xd6\xd8-\xf6\xf8-\u017f]").search
#: Pieces a worker remembers in each of two generations.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary: automaton, merge ranks, and what each token was merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            self.parts.setdefault(whole, (ids[left], ids[right], rank))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        # Only tokens that their own merges reach can end a prefix.
        self.reachable = {i for i, token in self.bytes_of.items() if len(token) == 1}
        for i in sorted(self.parts, key=lambda t: len(self.bytes_of[t])):
            if self._stands(i):
                self.reachable.add(i)
        self.automaton = ahocorasick.Automaton()
        for i in self.reachable:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(self.bytes_of[i]) for i in self.reachable}
        self.said = {str(i): token for i, token in self.bytes_of.items()}
        self.said |= {str(i): content.encode() for content, i in self.special.items()}
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def _stands(self, token: int) -> bool:
        left, right, _ = self.parts[token]
        return left in self.reachable and right in self.reachable and self._compatible(left, right, self.parts[token][2])

    def _compatible(self, left: int, right: int, below: int) -> bool:
        """No merge across the join comes before `below` or before the tokens beside it are complete.

        Both sides are undone step by step, the later merge first; at each step
        the pair at the join must not be a merge that came earlier.
        """
        limit = below
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < limit:
                return False
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            rank_left = of_left[2] if of_left else -1
            rank_right = of_right[2] if of_right else -1
            if rank_left < 0 and rank_right < 0:
                return True
            # The right side's merge happens after an equal or earlier one of the left side.
            if rank_left > rank_right:
                limit, left = rank_left, of_left[1]
            elif rank_right > rank_left:
                limit, right = rank_right + 1, of_right[0]
            else:
                limit, right = rank_right + 1, of_right[0]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            found = self.fits[pair] = self._compatible(left, right, sys.maxsize)
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        last = [-1] * (len(piece) + 1)
        length, fits = self.length, self.fits
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if start:
                    fit = fits.get((last[start], token))
                    if fit is None:
                        fit = self.compatible(last[start], token)
                    if not fit:
                        continue
                last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _piece(self, piece: str) -> str:
        if len(self.known) >= REMEMBERED:
            self.known, self.before = {}, self.known
        found = self.before.get(piece)
        if found is None:
            ids = [self.special[piece]] if piece in self.special else self.encode_bytes(piece.encode("utf-8"))
            found = ",".join(map(str, ids))
        self.known[piece] = found
        return found

    def split(self, text: str) -> list[str]:
        pieces = ALL_PIECES if UNUSUAL(text) else USUAL_PIECES
        if self.special_pattern is None or not self.special_pattern.search(text):
            return pieces(text)
        return [p for k, part in enumerate(self.special_pattern.split(text)) for p in ([part] if k % 2 else pieces(part))]

    def encode_joined(self, text: str) -> str:
        """The ids as decimals joined by commas."""
        pieces = self.split(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [f or self.known.get(p) or self._piece(p) for f, p in zip(found, pieces)]
        return ",".join(found)

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text or "")
        return list(map(int, joined.split(","))) if joined else []

    def decode_joined(self, joined: str) -> str:
        return b"".join(map(self.said.__getitem__, joined.split(","))).decode("utf-8", "replace") if joined else ""

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Token count, hash of the ids, hash of the text that the ids decode to."""
        ids = self.encode_joined(text or "")
        whole = self.decode_joined(ids).encode("utf-8", "replace")
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One automaton per worker and vocabulary file; the file is installed on every machine."""
    return Bpe(path)


def _ids_of(columns: dict, path: str) -> list[list[int]]:
    bpe = load(path)
    return [bpe.encode(t.decode("utf-8", "replace") if t else "") for t in columns["text"]]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "ids": _ids_of(c, path)},
                     f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids. A null array gives an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return per_batch(encoded.select("doc_id", "ids"),
                     lambda c: {"doc_id": c["doc_id"], "text": [load(path).decode(i or []) for i in c["ids"]]},
                     f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def run(columns: dict) -> dict:
        bpe = load(path)
        found = [bpe.digest(t.decode("utf-8", "replace") if t else "") for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "n_tokens": [f[0] for f in found], "ids_sha256": [f[1] for f in found],
                "decoded_sha256": [f[2] for f in found]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
