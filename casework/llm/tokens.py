"""Token ids of whole texts by a public tokenizer file, with repeated pieces encoded once.

Encoding a word costs far more than finding it again, and most words of a corpus come back. Where
the tokenizer's own rules always end a piece, a text is cut: before a lone space, on both sides of
a lone line break, and between a Latin letter and a mark. The pieces of a block of texts
are found, looked up and put together as numpy arrays; only new ones are encoded, many in a call.
The ids are those of the whole text either way. White space next to white space is never cut, and
a tokenizer with other rules gets whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from casework.llm import arrays

CACHE_ENTRIES = 800_000  # pieces remembered per Python worker; beyond that it starts afresh
JOINED = 20_000  # new pieces encoded in one call
_SECOND = (0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_LETTER = arrays.byte_set((0x41, 0x5A), (0x61, 0x7A))
_MARK = arrays.byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # no apostrophe
_LATIN = arrays.byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # after 0xC3: U+00C0 to U+00FF without the signs
_LONE = arrays.byte_set((0x20, 0x20), (0x0A, 0x0A))
_encoders: dict[str, "Encoder"] = {}


def _ends_at_spaces(spec: dict) -> bool:
    """Whether no piece of this tokenizer goes on across a lone space or line break."""
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") == "ByteLevel":
        return spec.get("normalizer") is None and before["use_regex"] and not before["add_prefix_space"]
    if before.get("type") != "Sequence" or not before["pretokenizers"]:
        return False
    first, *others = before["pretokenizers"]
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
    plain = drops and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and all(
        o["type"] == "ByteLevel" and not o["add_prefix_space"] and not o["use_regex"] for o in others)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    return bool(plain) and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}


def _space(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes that begin, and that end, a white space or control character."""
    begins = data <= 0x20
    ends = begins.copy()
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]  # U+0085, U+00A0
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    lead, middle, last = data[three], data[three + 1], data[three + 2]
    general = (lead == 0xE2) & (middle == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    three = three[general | ((lead == 0xE1) & (middle == 0x9A) & (last == 0x80))
                  | ((lead == 0xE2) & (middle == 0x81) & (last == 0x9F))
                  | ((lead == 0xE3) & (middle == 0x80) & (last == 0x80))]  # U+2000 on, U+1680, U+205F, U+3000
    begins[two] = ends[two + 1] = True
    begins[three] = ends[three + 2] = True
    return begins, ends


def piece_starts(block: arrays.Block) -> np.ndarray:
    """Where the block's texts may be cut, their beginnings included."""
    data, at = block.data, block.at
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # where a text begins, and the end of the last
    begins, ends = _space(data)
    alone = _LONE[data].copy()
    alone[0] = alone[-1] = False
    alone[1:] &= ~ends[:-1]
    alone[:-1] &= ~begins[1:]
    alone &= ~edge[:-1] & ~edge[1:]
    cut = edge.copy()
    cut[:-1] |= alone
    cut[1:] |= alone & (data == 0x0A)
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    cut[1:-1] |= _MARK[data[1:]] & letter[:-1]
    return np.flatnonzero(cut[:-1])


class _Table:
    """Ids of the pieces met so far, by two independent 64-bit hashes of their bytes."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """``keys`` in order, none of them known; ``flat`` are their ids, ``size`` of each."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.dtype)])
        begin = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _joined(ids: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*ids, np.zeros(0, dtype)]), np.array([len(i) for i in ids], np.int64)


class Encoder:
    """Texts to little-endian ids; special tokens' names in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = _ends_at_spaces(spec)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.folds = self.cuts and any(n["type"] == "Lowercase" for n in steps)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.table = _Table(self.dtype)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short texts end to end and how many each has, in one call.

        A special token between two texts keeps them apart.
        """
        if not self.special or any(s in "\0".join(texts) for s in self.special):
            return _joined(self.whole(texts), self.dtype)
        mark = self.model.token_to_id(self.special[0])
        self.model.encode_special_tokens = False
        line = self.model.encode_batch_fast([self.special[0].join(texts)], add_special_tokens=False)
        self.model.encode_special_tokens = True
        ids = np.array(line[0].ids, self.dtype)
        between = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(np.concatenate([[-1], between, [len(ids)]])) - 1

    def encode_block(self, block: arrays.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts end to end, and how many each text has."""
        if not self.cuts:
            return self._plain(block)
        data = block.data
        if self.folds:  # as the tokenizer would, so that fewer pieces differ
            high = np.concatenate([[0], np.cumsum(data >= 0x80)])
            plain = np.repeat(high[block.at[1:]] == high[block.at[:-1]], np.diff(block.at))
            data = np.where(plain, arrays.LOWER[data], data)
        start = piece_starts(block)
        end = np.append(start[1:], len(data))[: len(start)]
        key, check = (h.of(start, end) for h in (arrays.Prefix(data), arrays.Prefix(data, *_SECOND)))
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        checks = check[first]
        if (checks[which] != check).any():  # two pieces of one hash
            return self._plain(block)
        if len(self.table.keys) > CACHE_ENTRIES:
            self.table.clear()
        new = np.flatnonzero(self.table.find(keys) < 0)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
        for i in range(0, len(texts), JOINED):
            part = new[i : i + JOINED]
            self.table.add(keys[part], checks[part], *self.apart(texts[i : i + JOINED]))
        at = self.table.find(keys)
        if (self.table.checks[at] != checks).any():
            return self._plain(block)
        begin, size = self.table.begin[at][which], self.table.size[at][which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.table.ids[np.repeat(begin - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(start, block.at)])

    def _plain(self, block: arrays.Block) -> tuple[np.ndarray, np.ndarray]:
        raw = block.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(block.at[:-1].tolist(), block.at[1:].tolist())]
        return _joined(self.whole(texts), self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for block in arrays.blocks(pa.array(texts, pa.string())):
            ids, sizes = self.encode_block(block)
            out += np.split(ids, np.cumsum(sizes)[:-1])
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
