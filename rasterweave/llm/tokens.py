"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import kept, slices

#: White space outside ASCII that the byte-level split pattern knows (Unicode White_Space).
ODD_SPACE = re.compile("[\x85\xa0  -     　]")
_MIX = np.random.default_rng(29).integers(1, 2**63, 64 * 256, dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of bytes: 0 space, 1 other white space or control, 2 letter, 3 mark, 4 apostrophe, 5 digit, 6 part of a longer character.
_KIND = np.full(256, 3, np.uint8)
_KIND[:32] = 1
_KIND[32] = 0
_KIND[127] = 1
_KIND[128:] = 6
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
_KIND[list(b"0123456789")] = 5
_KIND[39] = 4
_CUT = np.zeros((7, 7), bool)
_CUT[2:, 0] = True  # before white space after anything else
_CUT[2, [3, 4, 5]] = True  # after a run of letters
_CUT[3, [2, 5]] = True  # after a run of marks, unless its last is an apostrophe
#: The same where a longer character may be white space.
_CUT_ODD = _CUT.copy()
_CUT_ODD[6, 0] = False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def cuts(buf: np.ndarray, odd: np.ndarray | None) -> np.ndarray:
    """For each byte whether a piece may start there: the split pattern never joins
    it to what stands before. ``odd`` marks bytes of texts with longer white space."""
    kind = _KIND[buf]
    pair = kind[:-1].astype(np.intp) * 7 + kind[1:]
    out = np.zeros(len(buf), bool)
    out[1:] = _CUT.ravel()[pair]
    # a run of white space starts with a cut, and ends with one if it is one line break
    line, other = (buf >= 9) & (buf <= 13), kind > 1
    out[1:] |= line[1:] & other[:-1]
    out[2:] |= line[1:-1] & other[:-2] & other[2:]
    if odd is not None:
        out[1:] &= ~odd[1:] | (_CUT_ODD.ravel()[pair] & (kind[:-1] != 6))
    return out


#: Characters encoded at a time.
ENCODED = 250_000


class TextEncoder:
    """Whole texts -> ids, with the tokenizers library.

    Texts are cut where the byte-level pattern always cuts, and the ids of a text are
    those of its pieces one after another. Pieces repeat, so their ids are
    remembered by a 64-bit hash of their bytes, in a table of ``slots`` places
    that is emptied when half full; a longer memory changes speed alone. Texts
    with an added token's string go to the library whole.
    """

    def __init__(self, path: str | None = None, slots: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        small = max([self.tokenizer.get_vocab_size(), *self.tokenizer.get_added_tokens_decoder()]) < 1 << 16
        self.ids = np.zeros(1 << 16, np.uint16 if small else np.uint32)
        self._table(slots)

    def _table(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys, self.first, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.known = self.used = 0

    def forget(self) -> None:
        self.keys[:] = 0
        self.known = self.used = 0

    def _piece(self, raw: bytes) -> list[int]:
        bare = raw[1:] if raw[:1] == b" " else raw
        if bare.isalpha():  # ASCII letters are one word of the pattern: no split to do
            word = bare.decode()
        else:
            text = bare.decode()
            if not (text.isalpha() and max(text) < "ɐ"):
                return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
            word = "".join(map(self.letters.__getitem__, bare))
        return [t.id for t in self.model.tokenize(self.letters[32] + word if len(bare) < len(raw) else word)]

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        if 2 * (self.known + len(raw)) > len(self.keys):
            self.forget()
            if 2 * len(raw) > len(self.keys):  # one text of more pieces than the table holds
                self._table(1 << (4 * len(raw)).bit_length())
        found = [self._piece(r) for r in raw]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for f in found for i in f), self.ids.dtype, int(size.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used, 1 << 16), self.ids.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.known += len(raw)
        todo, at = np.arange(len(raw)), (hashes & self.mask).astype(np.intp)
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = hashes[todo[free]]
            won = todo[self.keys[at[todo]] == hashes[todo]]
            self.first[at[won]], self.size[at[won]] = first[won], size[won]
            todo = todo[self.keys[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & int(self.mask)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (hashes & self.mask).astype(np.intp)
        got = self.keys[at]
        out = np.where(got == hashes, at, -1)
        todo = np.flatnonzero((got != hashes) & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            got = self.keys[at[todo]]
            hit = got == hashes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != 0)]
        return out

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` after each, little-endian u32; how many each has)."""
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        raw = [b"" if t is None or i in whole else t.encode() for i, t in enumerate(texts)]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        ends = np.cumsum(sizes) - 1  # the line break after each text stands for its end
        odd = np.array([t is not None and not t.isascii() and ODD_SPACE.search(t) is not None for t in texts])
        cut = cuts(buf, np.repeat(odd, sizes) if odd.any() else None)
        cut[ends] = True
        cut[(ends - sizes + 1)] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(buf)))
        is_end = np.zeros(len(buf), bool)
        is_end[ends] = True
        is_end = is_end[starts]

        place = np.arange(len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        mixed = _MIX[((place & 63) << 8) | buf]
        far = np.flatnonzero(place > 63)
        mixed[far] *= 2 * (place[far] >> 6).astype(np.uint64) + np.uint64(1)
        hashes = np.add.reduceat(mixed, starts) + lengths.astype(np.uint64)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _SPREAD
        hashes ^= hashes >> np.uint64(29)
        hashes[hashes == 0] = 1

        at = self._places(hashes)
        at[is_end] = 0
        new = np.flatnonzero(at < 0)
        if len(new):
            values, one = np.unique(hashes[new], return_index=True)
            one = new[one]
            known = self.known
            self._learn(values, [bytes(buf[a : a + n]) for a, n in zip(starts[one].tolist(), lengths[one].tolist())])
            if self.known != known + len(values):  # the memory was emptied: all of this batch is learned anew
                rest = np.flatnonzero(~is_end)
                values, one = np.unique(hashes[rest], return_index=True)
                one = rest[one]
                self.forget()
                self._learn(values, [bytes(buf[a : a + n]) for a, n in zip(starts[one].tolist(), lengths[one].tolist())])
                at = self._places(hashes)
                at[is_end] = 0
            else:
                at[new] = self._places(hashes[new])
        count = np.where(is_end, 1, self.size[at])
        before = np.cumsum(count) - count
        total = int(before[-1] + count[-1])
        out = self.ids[np.repeat(np.where(is_end, 0, self.first[at]) - before, count) + np.arange(total)].astype("<u4")
        last = before[is_end]
        out[last] = end_id
        n = np.diff(np.concatenate([[0], last + 1]))
        if whole:
            parts = np.split(out, last[:-1] + 1)
            for i, ids in whole.items():
                parts[i] = np.array([*ids, end_id], "<u4")
                n[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, n

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian u32 bytes; none for null or empty text."""
        return self.encode_all([text], 0)[0][:-1].tobytes()

    def batches(self, texts, end_id: int):
        """``encode_all`` of about ENCODED characters at a time: (first text, ids, lengths)."""
        at = 0
        for some in slices(texts, ENCODED):
            yield at, *self.encode_all(some, end_id)
            at += len(some)


def encoder(path: str | None = None) -> TextEncoder:
    """This process's encoder; Python workers keep what they know between tasks."""
    return kept(("tokens", path), lambda: TextEncoder(path))
