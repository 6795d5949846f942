"""Ids of whole texts through bounded caches of the chunks between spaces."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

#: Chunks that a generation of a cache holds; two generations are kept.
CACHE_CHUNKS = 300_000
#: Longer chunks are encoded each time and never kept.
LONGEST_KEPT = 100
#: Characters of the texts that are looked up together, a longer text by itself.
GROUP_CHARS = 1 << 20

SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def uneven(chunk: str) -> bool:
    """Whether the cut on some side of a chunk is not a single space between other characters."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class ChunkCache:
    """Values of chunks: `compute` is asked for a list of those not known.

    When the newer generation is full it becomes the older one, so memory is bounded and what is in
    use stays. What the caller names in `unkept` is never found later.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], size: int = CACHE_CHUNKS):
        self.compute, self.size = compute, size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, wanted: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What the newer generation has, and the places that it lacks."""
        found = list(map(self.new.get, wanted))
        return found, [i for i, v in enumerate(found) if v is None] if None in found else []

    def fill(
        self,
        wanted: list[str],
        found: list[bytes | None],
        places: list[int],
        unkept: frozenset[str] | set[str] = frozenset(),
    ) -> list[bytes]:
        absent = list({wanted[i]: None for i in places})
        known = {c: v for c in absent if (v := self.old.get(c)) is not None}
        asked = [c for c in absent if c not in known]
        if asked:
            known.update(zip(asked, self.compute(asked)))
        for i in places:
            found[i] = known[wanted[i]]
        self.new.update(known)
        for c in known:
            if len(c) > LONGEST_KEPT or c in unkept:
                del self.new[c]
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        return found

    def values(self, wanted: list[str]) -> list[bytes]:
        found, places = self.known(wanted)
        return self.fill(wanted, found, places) if places else found


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of so many characters together."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return array("I", ids).tobytes()


class SpacedChunks:
    """Ids of texts for a pattern that joins at most one space to the word behind it.

    No match of such a pattern spans a single space between two other characters, so texts are cut
    there, and a chunk with its space has the same ids everywhere. `compute` gives the ids of whole
    strings. Texts with other white space next to a space are cut by a slower rule; they are told by
    their uneven chunks, which are never kept and so never found.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]]):
        self.compute = compute
        self.first = ChunkCache(compute)
        self.later = ChunkCache(lambda asked: compute([" " + c for c in asked]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for group in groups(texts):
            cut = [t.split(" ") for t in group]
            heads, rest = [parts[0] for parts in cut], [c for parts in cut for c in parts[1:]]
            found, places = self.later.known(rest)
            odd = {c for c in {rest[i] for i in places}.union(heads) if uneven(c)}
            if odd:
                cut = [
                    parts if odd.isdisjoint(parts) else SINGLE_SPACE.split(t)
                    for parts, t in zip(cut, group)
                ]
                heads, rest = [parts[0] for parts in cut], [c for parts in cut for c in parts[1:]]
                found, places = self.later.known(rest)
                odd = {c for c in {rest[i] for i in places} if uneven(c)}
            first = self.first.values(heads)
            later = self.later.fill(rest, found, places, odd)
            at = 0
            for parts, head in zip(cut, first):
                end = at + len(parts) - 1
                yield head + b"".join(later[at:end])
                at = end


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library that runs on the calling thread only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Stands behind the last byte of a word; no UTF-8 text has it.
WORD_END = b"\xff"


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to id of a byte-level BPE file whose ids are the order of its merges; else None.

    A suffix for the end of a word becomes `WORD_END`. Ids are that order if those of merges rise and
    are above those of single bytes, with and without the suffix. Special tokens are left out.
    """
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    model, letters = tokenizer["model"], _bytes_of_letters()
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    special = {t["content"] for t in tokenizer["added_tokens"]}
    ranks = {}
    for token, i in vocab.items():
        ends = bool(suffix) and token.endswith(suffix)
        plain = token[: len(token) - len(suffix)] if ends else token
        if token not in special and set(plain) <= letters.keys():
            ranks[bytes(letters[c] for c in plain) + WORD_END * ends] = i
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    singles = [i for t, i in ranks.items() if len(t.removesuffix(WORD_END)) <= 1]
    rising = all(a < b for a, b in zip(made, made[1:]))
    return ranks if rising and made and max(singles) < made[0] else None


def special_strings(path: str) -> list[str]:
    """The special tokens of a tokenizer file, longest first; their strings in texts are single ids."""
    with open(path, encoding="utf-8") as file:
        strings = [t["content"] for t in json.load(file)["added_tokens"]]
    return sorted(strings, key=len, reverse=True)


def special_pattern(path: str) -> re.Pattern | None:
    """Matches the special tokens of a tokenizer file."""
    strings = special_strings(path)
    return re.compile("|".join(map(re.escape, strings))) if strings else None
