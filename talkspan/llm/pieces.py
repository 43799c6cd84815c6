"""SentencePiece encoding and decoding, batched in numpy.

Texts are cut into words that no piece crosses; a batch's distinct words of equal length advance together. Polynomial
hashes of all their substrings probe the sorted piece keys. A Viterbi pass keeps the best score at every position and
the piece that reached it. For unigram models all paths count. A BPE model's own encoder merges instead, the best-scored
neighbouring pair of symbols first and the leftmost at a tie; there only paths count whose neighbouring pieces merging
would leave side by side, which makes the path the merged one. Whether two pieces stay apart is read off the merges that
made them, undone from the last to the first, for many pairs at once. Long words are cut where no piece crosses.
Characters of no piece fall back to bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE, LENGTH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Penalty below the worst piece for a character of no piece.
UNKNOWN_PENALTY = 10.0
#: Words longer than this are cut where no piece crosses, as far as there are such places.
CUT = 32
#: Highest bits of keys by which substrings are sieved before they are looked for among the sorted keys.
SIEVE_BITS = 20
SIEVE_SHIFT = np.uint64(64 - SIEVE_BITS)
#: Pairs of pieces of which a worker remembers whether they stay apart, as a power of two.
ASKED_BITS = 20
#: Words whose ids a worker holds from batch to batch; beyond, it keeps the KEPT that came most often.
HELD_WORDS, KEPT = 300_000, 100_000
#: Rows that advance position by position in Python rather than as a batch: a few long ones.
ROWS = 4
#: Characters of text whose words are gathered before they are encoded.
GATHER = 1 << 22


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int
    dummy_prefix: bool
    keys: np.ndarray = field(init=False)  # sorted
    ids: np.ndarray = field(init=False)  # by key
    codes: np.ndarray = field(init=False)  # the pieces' characters, padded
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces that hold a space after other characters are not supported")
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.codes = np.zeros((len(self.pieces), self.longest), np.uint32)
        keys = np.zeros(len(usable), np.uint64)
        for n, i in enumerate(usable):
            c = np.array([ord(x) for x in self.pieces[i]], np.uint32)
            self.codes[i, : len(c)] = c
            with np.errstate(over="ignore"):
                keys[n] = prefix_hashes(c[None, :])[0, -1] + np.uint64(len(c)) * LENGTH
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same key")
        self.scores = self.scores.astype(np.float32)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)  # by their highest bits: most substrings go no further
        self.sieve[(self.keys >> SIEVE_SHIFT).astype(np.int64)] = True
        self.unknown = int(np.nonzero(self.types == UNKNOWN)[0][0])
        self.unknown_score = np.float32(self.scores[usable].min() - UNKNOWN_PENALTY)
        self.by_text = {self.pieces[i]: i for i in usable}
        self.byte_ids = {self.pieces[i]: i for i, t in enumerate(self.types) if t == BYTE}
        # whether letters and other characters, but for the space before a word, never meet within a piece
        self.letters_apart = not any(a != SPACE and a.isalpha() != b.isalpha() for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False))
        self.breaks = not any("\n" in self.pieces[i] and len(self.pieces[i]) > 1 for i in usable)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, BASE))))
        if self.kind == BPE:
            self._merges(np.array(usable))

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def probe(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes and lengths, -1 for none."""
        with np.errstate(over="ignore"):
            want = hashes + lengths.astype(np.uint64) * LENGTH
        out = np.full(want.shape, -1, np.int32)
        may = np.nonzero(self.sieve[(want >> SIEVE_SHIFT).astype(np.int64)])
        w = want[may]
        at = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == w, self.ids[at], -1)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _merges(self, usable: np.ndarray) -> None:
        """What merges each piece is made by: `made`, the last one's place in the order of merges (-1: a character),
        its two sides, and whether merging makes the piece from its own text at all."""
        n = len(self.pieces)
        self.sizes = np.array([len(x) for x in self.pieces], np.int64)
        self.rank = np.full(n + 1, 2 * n)  # the last stands for no piece
        self.rank[usable[np.argsort(-self.scores[usable], kind="stable")]] = np.arange(len(usable))
        self.hashes = np.zeros(n, np.uint64)
        self.made, self.left, self.right, self.whole = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n + 2, bool)
        self.whole[-1] = True  # a character of no piece
        for size in range(1, self.longest + 1):
            ids = usable[self.sizes[usable] == size]
            prefix = prefix_hashes(self.codes[ids, :size])
            self.hashes[ids] = prefix[:, -1]
            if size == 1:
                self.whole[ids] = True
            for cut in range(1, size):
                rows = np.arange(len(ids))
                x = self.probe(prefix[:, cut], np.array(cut))
                with np.errstate(over="ignore"):
                    y = self.probe(prefix[:, size] - prefix[:, cut] * self.powers[size - cut], np.array(size - cut))
                rows = rows[(x >= 0) & (y >= 0) & self.whole[x] & self.whole[y]]
                rows = rows[self.apart(x[rows], y[rows], self.rank[ids[rows]])]
                p = ids[rows]
                self.made[p], self.left[p], self.right[p], self.whole[p] = self.rank[p], x[rows], y[rows], True

    def apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves whole pieces x and y side by side, by merges earlier than `limit`.

        The merges of both are undone from the last on. What then meets at the seam must not merge before the merge
        just undone: before it comes what ranks higher and, of merges of one rank, what lies further left.
        """
        out, live = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), 2 * len(self.pieces)) if limit is None else limit
        while len(live):
            size = self.sizes[x] + self.sizes[y]
            fits = size <= self.longest
            with np.errstate(over="ignore"):
                both = self.hashes[x] * self.powers[np.where(fits, self.sizes[y], 0)] + self.hashes[y]
            joined = self.rank[np.where(fits, self.probe(both, size), -1)]
            merged = joined < limit
            out[live[merged]] = False
            first = self.made[x] > self.made[y]
            last = np.where(first, self.made[x], self.made[y])
            go = ~merged & (last >= 0)
            limit = np.where(first, last, last + 1)[go]
            x, y, live = np.where(first, self.right[x], x)[go], np.where(first, y, self.left[y])[go], live[go]
        return out

    def follows(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece `ids` whole after piece `before`: len(pieces) for the beginning, one more for a
        character of no piece. What has been asked is kept in a table of fixed size, by hash."""
        if "_asked" not in self.__dict__:
            self._asked, self._yes = np.full(1 << ASKED_BITS, -1), np.zeros(1 << ASKED_BITS, bool)
        key = before.astype(np.int64) * (len(self.pieces) + 2) + ids
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * LENGTH) >> np.uint64(64 - ASKED_BITS)).astype(np.int64)
        out = self.whole[ids]
        pair = out & (before < len(self.pieces)) & (ids < len(self.pieces))
        held = self._asked[slot] == key
        out = np.where(pair & held, self._yes[slot], out)
        new = np.nonzero(pair & ~held)[0]
        if len(new):
            yes = self.apart(before[new], ids[new])
            self._asked[slot[new]], self._yes[slot[new]] = key[new], yes
            out[new] = yes
        return out

    def fallback(self, char: int) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[f"<0x{b:02X}>"] for b in chr(char).encode("utf-8", "surrogatepass")]


def load(path: str = MODEL) -> PieceModel:
    """Model of a .model file. Its normalizer must leave texts as they are."""
    pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f[1].decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            types.append(f.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models whose normalizer is the identity are supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return PieceModel(pieces, np.array(scores), np.array(types), kind, prefix)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Rows of hashes of each row's first 0, 1, ... characters."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + codes[:, i]
    return out


def _sub(m: PieceModel, prefix: np.ndarray, rows, start, end) -> np.ndarray:
    with np.errstate(over="ignore"):
        return prefix[rows, end] - prefix[rows, start] * m.powers[end - start]


def lattice(m: PieceModel, codes: np.ndarray) -> list[np.ndarray]:
    """Of words of equal length: by piece length less one, ids of the pieces that begin at each position, -1 for none."""
    length = codes.shape[1]
    prefix = prefix_hashes(codes)
    found = []
    for k in range(1, min(m.longest, length) + 1):
        with np.errstate(over="ignore"):
            h = prefix[:, k:] - prefix[:, :-k] * m.powers[k]
        ids = m.probe(h, np.array(k))
        r, s = np.nonzero(ids >= 0)  # keys agree: compare the characters too
        for j in range(k):
            wrong = m.codes[ids[r, s], j] != codes[r, s + j]
            if wrong.any():
                ids[r[wrong], s[wrong]] = -1
                r, s = r[~wrong], s[~wrong]
        found.append(ids)
    return found


def viterbi(m: PieceModel, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of equal length: each position's best piece ending there (-1: one unknown character), its length."""
    n, length = codes.shape
    best = np.full((n, length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    piece, back = np.full((n, length + 1), -1, np.int32), np.ones((n, length + 1), np.int32)
    found = lattice(m, codes)
    score = [np.where(ids >= 0, m.scores[ids], -np.inf).astype(np.float32) for ids in found]
    for j in range(1, length + 1):
        for k in range(min(len(found), j), 0, -1):
            with np.errstate(invalid="ignore"):
                value = best[:, j - k] + score[k - 1][:, j - k]
            ids = found[k - 1][:, j - k]
            if k == 1:
                value = np.where(ids >= 0, value, best[:, j - 1] + m.unknown_score)
            up = value > best[:, j]
            best[up, j], piece[up, j], back[up, j] = value[up], ids[up], k
    return piece, back


def merged_path(m: PieceModel, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """viterbi() for a BPE model: over paths whose neighbouring pieces merging would leave side by side.

    A sequence of pieces is what merging returns exactly if each piece and each neighbouring pair is what merging
    returns for its own text. So a position's last piece settles which may follow, and the one path to a position
    that this leaves is the merged one. Words whose end no such path reaches have piece -3 there.
    """
    n, length = codes.shape
    none, start, odd = -3, len(m.pieces), len(m.pieces) + 1
    last = np.full((n, length + 1), none)
    last[:, 0] = start
    best = np.full((n, length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    piece, back = np.full((n, length + 1), -1, np.int32), np.ones((n, length + 1), np.int32)
    found = lattice(m, codes)
    for j in range(1, length + 1):
        ks = np.arange(min(len(found), j), 0, -1)
        ids = np.stack([found[k - 1][:, j - k] for k in ks], axis=1)
        before, value = last[:, j - ks], best[:, j - ks]
        ids = np.where((ks == 1) & (ids < 0), odd, ids)
        r, c = np.nonzero((ids >= 0) & (before != none))
        good = m.follows(before[r, c], ids[r, c])
        r, c = r[good], c[good]
        score = np.full(ids.shape, -np.inf, np.float32)
        known = ids[r, c] != odd
        score[r, c] = value[r, c] + np.where(known, m.scores[np.where(known, ids[r, c], 0)], m.unknown_score)
        top = score.argmax(1)
        rows = np.arange(n)
        reached = score[rows, top] > -np.inf
        best[:, j] = score[rows, top]
        last[:, j] = np.where(reached, ids[rows, top], none)
        piece[:, j] = np.where(last[:, j] == odd, -1, last[:, j])
        back[:, j] = ks[top]
    return piece, back


def scan(m: PieceModel, codes: np.ndarray, merged: bool) -> tuple[np.ndarray, np.ndarray]:
    """viterbi() or merged_path() of one row: pieces and neighbours are looked up for all positions at once, and the
    maxima are taken position by position."""
    length = codes.shape[1]
    start, size, ids = [], [], []
    for k, found in enumerate(lattice(m, codes), 1):
        at = np.arange(length) if k == 1 else np.nonzero(found[0] >= 0)[0]  # a character of no piece is one step too
        start.append(at)
        size.append(np.full(len(at), k))
        ids.append(found[0][at])
    start, size, ids = np.concatenate(start), np.concatenate(size), np.concatenate(ids)
    order = np.lexsort((-size, start + size))
    start, end, ids = start[order], (start + size)[order], ids[order]
    state = np.where(ids < 0, len(m.pieces) + 1, ids)
    score = np.where(ids < 0, m.unknown_score, m.scores[ids]).astype(np.float32)
    good: set[int] = set()
    base = len(m.pieces) + 2
    if merged:
        # every two that meet at a position, each pair of pieces once
        keys = [np.unique(len(m.pieces) * base + state[start == 0])]
        first, last = np.searchsorted(end, np.arange(length + 1)), np.searchsorted(end, np.arange(length + 1), "right")
        for a in range(0, len(start), 1 << 16):
            s, n = start[a : a + (1 << 16)], state[a : a + (1 << 16)]
            count = last[s] - first[s]
            row = np.repeat(np.arange(len(s)), count)
            before = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[s][row]
            keys.append(np.unique(state[before] * base + n[row]))
        every = np.unique(np.concatenate(keys))
        good = set(every[m.follows(every // base, every % base)].tolist())
    best: list[np.float32 | None] = [None] * (length + 1)
    held, back = [len(m.pieces)] * (length + 1), [1] * (length + 1)
    best[0] = np.float32(0)
    for s, e, n, x in zip(start.tolist(), end.tolist(), state.tolist(), score, strict=True):
        if best[s] is not None and (not merged or held[s] * base + n in good):
            value = best[s] + x
            if best[e] is None or value > best[e]:
                best[e], held[e], back[e] = value, n, e - s
    piece = np.array([-3 if b is None else -1 if h == base - 1 else h for b, h in zip(best, held, strict=True)])
    return piece[None, :], np.array(back)[None, :]


def _walk(m: PieceModel, codes: np.ndarray, piece: np.ndarray, back: np.ndarray) -> list[list[int]]:
    """Ids of each word along the backpointers."""
    n, length = codes.shape
    at = np.full(n, length)
    steps_p, steps_c = [], []
    while (live := at > 0).any():
        rows = np.arange(n)
        p = np.where(live, piece[rows, at], -2)
        k = back[rows, at]
        steps_p.append(p)
        steps_c.append(codes[rows, np.maximum(at - 1, 0)])
        at = np.where(live, at - k, 0)
    return _ids(m, np.array(steps_p[::-1]).T, np.array(steps_c[::-1]).T)


def _ids(m: PieceModel, pieces: np.ndarray, chars: np.ndarray) -> list[list[int]]:
    """pieces: ids, -1 for an unknown character (in chars), -2 for nothing."""
    keep = pieces != -2
    counts = keep.sum(1)
    flat = pieces[keep]
    cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
    values = flat.tolist()
    out = [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for i in np.nonzero(((pieces == -1) & keep).any(1))[0].tolist():
        c = chars[i][keep[i]].tolist()
        out[i] = [x for p, ch in zip(out[i], c, strict=True) for x in ([p] if p >= 0 else m.fallback(ch))]
    return out


def merges(m: PieceModel, codes: np.ndarray) -> list[list[int]]:
    """Of words of equal length: ids after merging the best-scored pair again and again, all words at once."""
    n, length = codes.shape
    prefix = prefix_hashes(codes)
    start = np.tile(np.arange(length + 1), (n, 1))  # symbols by number; the last is the end
    count = np.full(n, length)
    rows = np.arange(n)

    def pair(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Scores of symbols i and i+1 of rows r together, -inf for none."""
        ok = (i >= 0) & (i + 1 < count[r])
        a = start[r, np.where(ok, i, 0)]
        b = start[r, np.where(ok, i + 2, 1)]
        ok &= b - a <= m.longest
        b = np.where(ok, b, a + 1)
        ids = m.probe(_sub(m, prefix, r, a, b), b - a)
        return np.where(ok & (ids >= 0), m.scores[ids], -np.inf)

    if length > 1:
        r, i = np.repeat(rows, length - 1), np.tile(np.arange(length - 1), n)
        scores = pair(r, i).reshape(n, length - 1)  # of symbol i and the next
        live = rows
        while True:
            at = scores[live].argmax(1)
            good = scores[live, at] > -np.inf
            live, at = live[good], at[good]
            if not len(live):
                break
            # symbol at+1 goes: what follows moves one place down
            left = np.arange(length + 1)[None, :] <= at[:, None]
            start[live] = np.where(left, start[live], np.concatenate((start[live][:, 1:], start[live][:, -1:]), axis=1))
            left = np.arange(length - 1)[None, :] <= at[:, None]
            moved = np.concatenate((scores[live][:, 1:], np.full((len(live), 1), -np.inf)), axis=1)
            scores[live] = np.where(left, scores[live], moved)
            count[live] -= 1
            scores[live, at] = pair(live, at)
            before = at > 0
            scores[live[before], at[before] - 1] = pair(live[before], at[before] - 1)
    number = np.arange(length)[None, :]
    here = number < count[:, None]
    a, b = start[:, :-1], np.where(here, start[:, 1:], start[:, :-1] + 1)
    r = np.repeat(rows, length).reshape(n, length)
    ids = m.probe(_sub(m, prefix, r, np.minimum(a, length - 1), np.where(here, b, np.minimum(a, length - 1) + 1)), b - a)
    return _ids(m, np.where(here, ids, -2), codes[r, np.minimum(a, length - 1)])


def _settle(m: PieceModel, codes: np.ndarray, algorithm: str) -> list[list[int]]:
    if algorithm == "merge":
        return merges(m, codes)
    few = len(codes) <= ROWS and codes.shape[1] > CUT
    if algorithm == "viterbi":
        return [ids for row in codes for ids in _walk(m, row[None, :], *scan(m, row[None, :], False))] if few else _walk(m, codes, *viterbi(m, codes))
    if few:
        parts = [scan(m, row[None, :], True) for row in codes]
        piece, back = np.concatenate([p for p, _ in parts]), np.concatenate([b for _, b in parts])
    else:
        piece, back = merged_path(m, codes)
    lost = np.nonzero(piece[:, -1] == -3)[0]
    got = _walk(m, codes, np.maximum(piece, -1), back)
    if len(lost):  # a vocabulary with pieces that merging makes in company only
        for i, ids in zip(lost.tolist(), merges(m, codes[lost]), strict=True):
            got[i] = ids
    return got


def encode_words(m: PieceModel, words: list[str], algorithm: str) -> list[list[int]]:
    """Ids of each word, with spaces as SPACE. algorithm: "viterbi", "merged_path" (the same over
    paths that merging leaves), or "merge" (the merges themselves, which settle pairs and check the rest)."""
    out: list[list[int]] = [[]] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if algorithm != "merge":
        long = np.nonzero(lengths > CUT)[0].tolist()
        parts = [cut(m, words[i]) for i in long]
        got = _by_length(m, [w for p in parts for w in p], algorithm)
        ends = np.cumsum([0] + [len(p) for p in parts]).tolist()
        for i, s, e in zip(long, ends, ends[1:], strict=False):
            out[i] = list(chain.from_iterable(got[s:e]))
        few = np.nonzero(lengths <= CUT)[0].tolist()
    else:
        few = list(range(len(words)))
    for i, ids in zip(few, _by_length(m, [words[i] for i in few], algorithm), strict=True):
        out[i] = ids
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Characters of words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def cut(m: PieceModel, word: str) -> list[str]:
    """The word's parts between positions that no piece crosses: no path and no merge does."""
    change = np.zeros(len(word) + 1, np.int64)
    for k, ids in enumerate(lattice(m, _codes([word]))[1:], 2):
        at = np.nonzero(ids[0] >= 0)[0]
        np.add.at(change, at + 1, 1)
        np.add.at(change, at + k, -1)
    ends = [0, *(np.nonzero(np.cumsum(change)[1:-1] == 0)[0] + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _by_length(m: PieceModel, words: list[str], algorithm: str) -> list[list[int]]:
    out: list[list[int]] = [[]] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths > 0]):
        at = np.nonzero(lengths == length)[0]
        step = max(1, (1 << 20) // int(length * min(length, m.longest)))
        for s in range(0, len(at), step):
            part = at[s : s + step].tolist()
            for i, ids in zip(part, _settle(m, _codes([words[i] for i in part]), algorithm), strict=True):
                out[i] = ids
    return out


def split(m: PieceModel, text: str) -> list[str]:
    """Words that pieces do not cross: spaces and what follows them, line breaks apart if no piece holds one."""
    if not text:
        return []
    whole = (" " if m.dummy_prefix else "") + text
    out: list[str] = []
    for n, line in enumerate(whole.split("\n") if m.breaks else [whole]):
        if n:
            out.append("\n")
        parts = line.split(" ")
        if "  " not in line and not line.endswith(" "):
            if parts[0]:
                out.append(parts[0])
            out.extend([SPACE + w for w in parts[1:]])
            continue
        spaces = ""
        for k, w in enumerate(parts):
            spaces += SPACE if k else ""
            if w:
                out.append(spaces + w)
                spaces = ""
        if spaces:
            out.append(spaces)
    return out


def algorithm_of(m: PieceModel) -> str:
    return "viterbi" if m.kind == UNIGRAM else "merged_path"


class _Words:
    """Words that have been encoded, their ids one after another, and whether those decode to the word."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes, self.flat, self.same = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.asked = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Keeps the `most` words that came most often."""
        keep = np.zeros(len(self.sizes), bool)
        keep[np.argsort(-self.asked, kind="stable")[:most]] = True
        self.flat = self.flat[np.repeat(keep, self.sizes)]
        self.sizes, self.same, self.asked = self.sizes[keep], self.same[keep], self.asked[keep] // 2
        words = [w for w, k in zip(self.number, keep.tolist(), strict=True) if k]
        self.number = dict(zip(words, range(len(words)), strict=True))


#: What stands for a line break, what a line begins with, and what a part of a word but its first, where texts are cut at
#: spaces; texts that hold them, and those with spaces side by side or at an end, are cut by split().
_BREAK, _BEGIN, _MORE = "\x01", "\x02", "\x03"


def _numbers(m: PieceModel, texts: list[str], number: dict[str, int]) -> list[np.ndarray]:
    """Each text's words by number; new words get the next ones."""
    out: list[np.ndarray | None] = [None] * len(texts)
    easy = []
    for i, t in enumerate(texts):
        if t and m.dummy_prefix and m.breaks and "  " not in t and " \n" not in t and t[0] not in " \n" and t[-1] != " " and not any(x in t for x in (_BREAK, _BEGIN, _MORE)):
            easy.append(i)
        else:
            out[i] = np.array([number.setdefault(w, len(number)) for w in split(m, t)], np.int64)
    if easy:
        marked = pa.array([texts[i].replace("\n", f" {_BREAK} {_BEGIN}") if "\n" in texts[i] else texts[i] for i in easy], pa.large_string())
        if m.letters_apart:  # words end where letters do: fewer words to encode
            for pattern in (rf"(\pL)([^\pL ])", rf"([^\pL {_BEGIN}])(\pL)"):
                marked = pc.replace_substring_regex(marked, pattern, rf"\1 {_MORE}\2")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        known = np.empty(len(coded.dictionary), np.int64)
        for k, w in enumerate(coded.dictionary.to_pylist()):
            # an empty line and a line that begins with a space leave _BEGIN alone: no word, but the next keeps its space
            word = "\n" if w == _BREAK else w[1:] if w[0] in (_BEGIN, _MORE) else SPACE + w
            known[k] = number.setdefault(word, len(number)) if word else -1
        flat = known[coded.indices.to_numpy()]
        ends = lists.offsets.to_numpy().tolist()
        for i, s, e in zip(easy, ends, ends[1:], strict=False):
            part = flat[s:e]
            out[i] = part[part >= 0]
    return out


def encode_texts(m: PieceModel, texts: list[str], algorithm: str | None = None) -> tuple[list[np.ndarray], list[bool]]:
    """Ids of each text, and whether they decode to it: they do if each word's do, as decoding goes word by word.
    A word is encoded once for all texts, and once for later calls too while it is held."""
    algorithm = algorithm or algorithm_of(m)
    held = m.__dict__.setdefault("_words", {})
    store = held.setdefault(algorithm, _Words())
    if len(store.number) > HELD_WORDS:
        store.shrink(KEPT)
    known = len(store.number)
    at = _numbers(m, texts, store.number)
    words = list(islice(store.number, known, None))
    got = encode_words(m, words, algorithm)
    new = np.fromiter(map(len, got), np.int64, len(got))
    ids = np.fromiter(chain.from_iterable(got), np.int32, int(new.sum()))
    raw = [w.replace(SPACE, " ").encode("utf-8", "surrogatepass") for w in words]
    surface = [m.surface[i] for i in ids.tolist()]
    ends = np.cumsum(np.fromiter(map(len, surface), np.int64, len(surface)))
    at_words = np.concatenate(([0], ends))[np.cumsum(new)]
    same = np.ones(len(words), bool)
    if not (np.array_equal(at_words, np.cumsum([len(r) for r in raw])) and b"".join(surface) == b"".join(raw)):
        same[:] = [b"".join([m.surface[i] for i in g]) == r for g, r in zip(got, raw, strict=True)]
    store.sizes = np.concatenate((store.sizes, new))
    store.flat = np.concatenate((store.flat, ids))
    store.same = np.concatenate((store.same, same))
    store.asked = np.concatenate((store.asked, np.zeros(len(words), np.int64))) + np.bincount(np.concatenate(at) if at else np.zeros(0, np.int64), minlength=len(store.number))
    sizes, flat = store.sizes, store.flat
    begin = np.cumsum(sizes) - sizes
    out = []
    for numbers in at:
        n = sizes[numbers]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(begin[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
    return out, [bool(store.same[numbers].all()) and SPACE not in t for numbers, t in zip(at, texts, strict=True)]


def decode(m: PieceModel, ids: list[int] | np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join([m.surface[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if m.dummy_prefix and text.startswith(" ") else text


def _gathered(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of GATHER characters or a little more, and where they begin. Nulls are empty."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
    start = 0
    while start < len(sizes):
        end = start + 1 + int(np.searchsorted(np.cumsum(sizes[start:]), GATHER))
        yield start, [t or "" for t in texts.slice(start, end - start).to_pylist()]
        start = end


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, algorithm: str | None = None) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>, round_trip boolean: a row for each row of docs.

    round_trip: decoding the ids gives the text again. Null and empty texts have no ids and a true round_trip.
    algorithm: as of encode_words(); by default what the model file asks for. The model is read by the driver and is
    part of the plan: executors need no file.
    """
    model = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at, texts in _gathered(b.column(1)):
                got, same = encode_texts(m, texts, algorithm)
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(sizes), ids, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """doc_id, text: a row for each row; null and empty ids give an empty text. Ids beyond the vocabulary raise."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(shared.value, ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
