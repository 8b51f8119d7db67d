"""Whole texts to token ids through the tokenizers library: numpy finds the pre-tokens, the library encodes each different
one once while it is remembered."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from biblio_spark.llm.bytescan import flat, texts_of

#: Classes of bytes: space, other white space, letter, number, anything else printable, and what is left to the library.
SPACE, WHITE, LETTER, NUMBER, OTHER, ODD = range(6)


def _class_of(character: str) -> int:
    kind = unicodedata.category(character)
    if kind[0] in "LN":
        return LETTER if kind[0] == "L" else NUMBER
    return ODD if kind in ("Cc", "Cf", "Mn", "Zs", "Cn") else OTHER


#: Of single bytes; all beyond ASCII are odd unless _PAIR says otherwise.
_BYTE = np.full(256, ODD, dtype=np.uint8)
_BYTE[0x21:0x7F] = [_class_of(chr(c)) for c in range(0x21, 0x7F)]
_BYTE[0x20] = SPACE
_BYTE[[0x09, 0x0A, 0x0D]] = WHITE
#: Of code points below U+0250, which UTF-8 writes in two bytes with a lead of C2 to C9.
_PAIR = np.array([_class_of(chr(c)) for c in range(0x280)], dtype=np.uint8)
_PAIR[0x250:] = ODD

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Longest pre-token that the table holds, in bytes, as three words of eight.
_WIDTH = 24
#: Pre-tokens that one call of the library gets in one string.
_JOINED = 100


#: Bytes of one text handled at once.
_PART = 4_000_000
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _safe_cut(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on of a space between ASCII letters or digits, -1 without one."""
    while at < len(data) - 2:
        part = data[at : at + 1_000_002]
        found = np.flatnonzero((part[1:-1] == 0x20) & _ALNUM[part[:-2]] & _ALNUM[part[2:]])
        if len(found):
            return at + 1 + int(found[0])
        at += 1_000_000
    return -1


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, odd) of the pre-tokens of consecutive texts in ``data``, as a byte-level BPE with the usual pattern cuts them:
    contractions, runs of letters, numbers or other characters with one space before, white space.

    A piece with ``odd`` goes to the library whole: it runs between places where any text may be cut (before a space between
    two plain characters) and holds characters beyond Latin, control characters or what may be a special token.
    """
    n = len(data)
    kind = _BYTE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(lead):
        of = _PAIR[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
        kind[lead] = of
        kind[lead + 1] = of
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    kind[special] = ODD
    edge = np.zeros(n + 1, dtype=bool)  # a text starts here
    edge[offsets] = True
    white = kind <= WHITE
    start = np.empty(n, dtype=bool)
    start[0] = True
    # what is not white: another class than before, and no space before it
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    # white space: where a run begins, and its last character if something follows
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~white[1:]
    follows &= ~edge[1:]
    at = np.flatnonzero(white)
    before = np.where(at > 0, white[at - 1], False)
    start[at] = ~before | follows[at]
    start |= edge[:-1]
    quotes = np.flatnonzero(data[:-1] == 0x27)
    quotes = quotes[start[quotes] & (kind[quotes + 1] == LETTER) & ~edge[quotes + 1]]
    if len(quotes):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
        pair = (one.astype(np.int64) << 8) | two
        inside = ~edge[quotes + 2]
        size[inside & np.isin(pair, [0x7265, 0x7665, 0x6C6C])] = 3  # re, ve, ll
        quotes, size = quotes[size > 0], size[size > 0]
        start[quotes + 1] = False
        start[np.where(size == 3, quotes + 2, quotes)] &= size == 2
        after = quotes + size
        start[after[after < n]] = True
    odd_at = np.flatnonzero(kind == ODD)
    marks = np.zeros(n, dtype=bool)
    if len(odd_at):
        plain = (kind >= LETTER) & (kind <= OTHER)
        cut = edge[:-1].copy()
        cut[1:-1] |= (data[1:-1] == 0x20) & plain[:-2] & plain[2:] & ~edge[2:-1]
        cuts = np.append(np.flatnonzero(cut), n)
        regions = np.unique(np.searchsorted(cuts, odd_at, side="right") - 1)
        for a, b in zip(cuts[regions].tolist(), cuts[regions + 1].tolist(), strict=True):
            start[a + 1 : b] = False
            marks[a] = True
    starts = np.flatnonzero(start)
    return starts, marks[starts]


class _Table:
    """Pre-tokens of up to _WIDTH bytes, held exactly, with their ids: open addressing in arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.slots = np.full(1 << max(8, (2 * limit - 1).bit_length()), -1, dtype=np.int32)
        self.keys = np.zeros((3, limit), dtype=np.uint64)
        self.first = np.zeros(limit, dtype=np.int64)
        self.count = np.zeros(limit, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.size = self.used = 0

    def clear(self) -> None:
        self.slots[:] = -1
        self.size = self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.slots[slot]
        todo = np.flatnonzero(out >= 0)
        e = out[todo]
        todo = todo[(self.keys[0][e] != keys[0][todo]) | (self.keys[1][e] != keys[1][todo]) | (self.keys[2][e] != keys[2][todo])]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[slot[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[(self.keys[:, out[todo]] != keys[:, todo]).any(axis=0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Different keys that are not held yet, each with ``count`` of ``ids`` from ``first`` on; the caller sees to it that
        they fit."""
        own = np.arange(self.size, self.size + len(count))
        self.keys[:, own] = keys
        self.first[own], self.count[own] = first + self.keep(ids), count
        self.size += len(own)
        self.used += len(ids)
        slot = self._slot(keys)
        todo = np.arange(len(own))
        while len(todo):
            free = self.slots[slot[todo]] < 0
            self.slots[slot[todo[free]]] = own[todo[free]]
            todo = todo[self.slots[slot[todo]] != own[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` stand in the pool; they stay until the next call unless ``used`` is raised."""
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(2 * (self.used + len(ids)), dtype=np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        return self.used


class WordEncoder:
    """ids of texts, equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``; with ``plain`` the strings of special tokens
    inside a text are ordinary text.

    For byte-level BPE files with the usual pattern (``public_tokenizers`` byte_bpe_*.json) each different pre-token goes to
    the library once while it is remembered; at ``limit`` pre-tokens all are forgotten. Other files take whole texts.
    """

    def __init__(self, path: str, limit: int = 1 << 20, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        own = json.loads(self.tokenizer.to_str())
        cutter = own.get("pre_tokenizer") or {}
        self.by_words = (
            own.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
            and own.get("post_processor") is None and own["model"]["type"] == "BPE" and all(t["content"].startswith("<|") and t["content"].endswith("|>") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in own["added_tokens"])
        )
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            for token, number in vocabulary.items():
                self.sizes[number] = len(token)  # one character stands for one byte
        self._forget(limit)

    def _forget(self, limit: int) -> None:
        self.table = _Table(limit)
        #: ids of longer and of odd pieces, with at most ``limit`` bytes of pieces and ids in all
        self.long: dict[bytes, np.ndarray] = {}
        self.room = 8 * limit

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces begin that are encoded by themselves, and which of them are not remembered in the table."""
        return pretokens(data, offsets)

    def _library(self, pieces: list[bytes]) -> list[np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece begin, how many they are) of plain pre-tokens. Many go to the library in one string,
        white space apart; a line feed, which is a pre-token by itself there, parts those that do not begin with a space."""
        white = np.fromiter(map(bytes.isspace, pieces), dtype=bool, count=len(pieces))
        alone, joined = np.flatnonzero(white), np.flatnonzero(~white)
        lone = self._library([pieces[k] for k in alone.tolist()])
        parts = [pieces[k] if pieces[k][0] == 0x20 else b"\n" + pieces[k] for k in joined.tolist()]
        many = self._library([b"".join(parts[i : i + _JOINED]) for i in range(0, len(parts), _JOINED)])
        first, count = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *many])
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        size = np.fromiter((len(pieces[k]) for k in joined.tolist()), dtype=np.int64, count=len(joined))
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])  # bytes before each id
        first[joined] = np.searchsorted(at, ends - size)
        count[joined] = np.searchsorted(at, ends) - first[joined]
        count[alone] = [len(x) for x in lone]
        first[alone] = len(ids) + np.cumsum(count[alone]) - count[alone]
        return np.concatenate([ids, *lone]), first, count

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets in them) of the n consecutive UTF-8 texts in ``data``. A long text comes alone; it is cut where any
        text may be cut, so that the arrays stay bounded."""
        if self.by_words and len(offsets) == 2 and len(data) > _PART:
            cuts, at = [0], 0
            while len(data) - at > _PART:
                cut = _safe_cut(data, at + _PART // 2)
                if cut < 0:
                    break
                cuts.append(at := cut)
            cuts.append(len(data))
            parts = [self._encode_part(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        return self._encode_part(data, offsets)

    def _encode_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words or not len(data):
            raw = data.tobytes()
            each = self._library([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
        starts, odd = self._cut(data, offsets)
        size = np.diff(np.append(starts, len(data)))
        padded = np.concatenate([data, np.zeros(_WIDTH + 8, np.uint8)])
        words = np.ndarray((len(data) + _WIDTH,), dtype="<u8", buffer=padded, strides=(1,))
        keys = np.zeros((3, len(starts)), dtype=np.uint64)
        keys[0] = words[starts] & _MASKS[np.minimum(size, 8)]
        for k in (1, 2):
            some = np.flatnonzero(size > 8 * k)
            keys[k, some] = words[starts[some] + 8 * k] & _MASKS[np.minimum(size[some] - 8 * k, 8)]
        long = odd | (size > _WIDTH)
        keys[:, long] = 0  # no key: bytes of plain pieces are never zero
        table = self.table
        entry = table.find(keys)
        entry[long] = -2
        raw = data.tobytes()
        missing = np.flatnonzero(entry == -1)
        if len(missing):
            new: dict[bytes, int] = {}
            for k, a, b in zip(missing.tolist(), starts[missing].tolist(), (starts[missing] + size[missing]).tolist(), strict=True):
                new.setdefault(raw[a:b], k)
            if table.size + len(new) > table.limit:
                if len(new) > table.limit // 2 or len(starts) > table.limit:
                    return self._halves(data, offsets)
                table.clear()
                return self._encode_part(data, offsets)
            at = np.fromiter(new.values(), dtype=np.int64, count=len(new))
            table.add(keys[:, at], *self._learn(list(new)))
            entry[missing] = table.find(keys[:, missing])
        first, count = table.first[entry], table.count[entry]
        if long.any():
            places = np.flatnonzero(long)
            ids, sizes = self._long([raw[a : a + n] for a, n in zip(starts[places].tolist(), size[places].tolist(), strict=True)])
            first[places] = table.keep(ids) + np.cumsum(sizes) - sizes
            count[places] = sizes
        ends = np.cumsum(count)
        total = int(ends[-1])
        ids = table.pool[np.arange(total) + np.repeat(first - (ends - count), count)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    def _halves(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewer texts at once where the table is too small; one text alone goes to the library whole."""
        if len(offsets) == 2:
            ids = self._library([data.tobytes()])[0]
            return ids, np.array([0, len(ids)])
        middle = len(offsets) // 2
        cut = offsets[middle]
        left, a = self._encode_part(data[:cut], offsets[: middle + 1])
        right, b = self._encode_part(data[cut:], offsets[middle:] - cut)
        return np.concatenate([left, right]), np.concatenate([a, b[1:] + a[-1]])

    def _long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = [p for p in dict.fromkeys(pieces) if p not in self.long]
        found = dict(zip(new, self._library(new), strict=True))
        out = [found[p] if p in found else self.long[p] for p in pieces]
        for piece, ids in found.items():
            if len(piece) < 200:
                self.room -= len(piece) + 4 * len(ids) + 200
                if self.room < 0:
                    self.long.clear()
                    self.room = 8 * self.table.limit
                self.long[piece] = ids
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode_flat(*flat(texts_of(pa.array(texts, type=pa.string()))))
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a tokenizer file; it outlives single tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
