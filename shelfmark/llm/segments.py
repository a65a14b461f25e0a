"""Cut texts where a byte-level tokenizer's pre-tokens end in any case, and remember what pieces encode to.

The split pattern of these tokenizers never joins a character that is not white space with white space behind it,
and it looks forward only inside a run of white space. So the place before a blank that follows anything but white
space is a border of pre-tokens whatever stands around it: the pieces' ids, one after the other, are the text's ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_UNSAFE = re.compile(r"\s ")


def pieces(text: str) -> list[str]:
    """The text cut at every safe blank; joined, the pieces are the text. An empty text has none."""
    parts = text.split(" ")
    if not _UNSAFE.search(text) and text[:1] != " ":
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out if text else []
    out, current = [], parts[0]
    for part in parts[1:]:
        if current and not current[-1].isspace():
            out.append(current)
            current = " " + part
        else:
            current += " " + part
    if current:
        out.append(current)
    return out


def spans(text: str, most: int) -> list[str]:
    """The text cut at safe blanks into spans of about ``most`` characters; a stretch without such a blank stays whole."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        cut = text.find(" ", start + most)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


class PieceCache:
    """Ids of pieces as little-endian 32-bit bytes, from a batch encoder.

    Two generations: when the young one holds ``most`` pieces it becomes the old one, so what still occurs is kept and
    at most twice ``most`` pieces are held.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 100_000):
        self.encode, self.most = encode, most
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, keys: set) -> dict:
        """The ids of all keys; what neither generation knows is encoded."""
        young, old = self.young, self.old
        fresh = keys.difference(young)
        if fresh:
            missing = []
            for key in fresh:
                found = old.get(key)
                if found is None:
                    missing.append(key)
                else:
                    young[key] = found
            if missing:
                young.update(zip(missing, self.encode(missing), strict=True))
        if len(young) > self.most:
            self.young, self.old = {}, young
        return young

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [pieces(t) for t in texts]
        known = self.lookup(set().union(*cut))
        return [b"".join([known[p] for p in c]) for c in cut]
