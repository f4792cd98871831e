"""Byte-level BPE over whole Arrow batches: vectorised pre-tokenising in overlapping chunks, then encoding of distinct pieces.

The split pattern is that of the rank files (contractions, letter, number and symbol runs with one leading space, white space).
Its matches depend on runs of four character classes only, so a batch of chunks is split by array operations at once.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers

from simspark.llm.common import RollingHash

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Characters a chunk must still show behind a boundary before the boundary counts as final.
MARGIN = 4
CHUNK, OVERLAP = 16_384, 512
_RESET = 150_000
_spans = RollingHash(11, 0)
#: Codes that are held against each other at once.
_CHECKED = 1 << 18


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            found[a : b + 1] = kind
    return found


def boundaries(codes: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in codes; segments: starts of texts that are split each by itself."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = character_classes()[codes]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    first = np.zeros(n, bool)
    first[segments[segments < n]] = True
    new |= first
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    what = kind[start]
    follows = np.append(~first[start[1:]], False)  # the next run belongs to the same text
    space = what == SPACE
    ends_blank = space & follows & (codes[end - 1] == 32)
    joined = np.append(False, ends_blank[:-1])  # a blank before the run opens its match
    mark = np.zeros(n, bool)
    mark[start[~joined]] = True
    mark[(end - 1)[space & follows]] = True
    # contractions: a lone apostrophe that opens a match, before a letter run
    lone = np.flatnonzero((codes[start] == 39) & (end - start == 1) & (what == OTHER) & ~joined & follows)
    if len(lone):
        lone = lone[what[lone + 1] == LETTER]
        at, size = start[lone], (end - start)[lone + 1]
        one = codes[at + 1]
        two = codes[np.minimum(at + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (size >= 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        take = np.where(short, 1, np.where(long, 2, 0))
        at, size, take = at[take > 0], size[take > 0], take[take > 0]
        mark[at + 1] = False
        rest = at + 1 + take
        mark[rest[take < size]] = True
    return np.flatnonzero(mark)


def split_texts(codes: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Starts of all pieces of the texts codes[offsets[i]:offsets[i+1]].

    Texts over `chunk` characters are cut into overlapping chunks, all chunks are split at once, and neighbours are stitched
    at the first boundary that both have: from a common boundary on, both scans go the same way.
    """
    size = np.diff(offsets)
    long = np.flatnonzero(size > chunk)
    if not len(long):
        return boundaries(codes, offsets[:-1][size > 0])
    step = chunk - overlap
    pieces, owner = [], []
    for i in range(len(size)):
        if size[i] <= chunk:
            if size[i]:
                pieces.append((offsets[i], offsets[i + 1])), owner.append(i)
            continue
        at = offsets[i]
        while True:
            stop = min(at + chunk, offsets[i + 1])
            pieces.append((at, stop)), owner.append(i)
            if stop == offsets[i + 1]:
                break
            at += step
    a, b = np.array(pieces, np.int64).T
    put = np.concatenate([[0], np.cumsum(b - a)])
    local = boundaries(np.concatenate([codes[x:y] for x, y in zip(a, b)]), put[:-1])
    cut = np.searchsorted(local, put)
    out, k = [], 0
    while k < len(a):
        mine = local[cut[k] : cut[k + 1]] - put[k] + a[k]
        stop = b[k]
        while k + 1 < len(a) and owner[k + 1] == owner[k]:  # stitch the next chunk of the same text on
            k += 1
            theirs = local[cut[k] : cut[k + 1]] - put[k] + a[k]
            sure = mine[mine <= stop - MARGIN]
            both = sure[np.searchsorted(sure, a[k]) :]
            both = both[np.isin(both, theirs)]
            if len(both):
                p = both[0]
            else:  # no boundary in common, as in a run longer than the overlap: split on from the last sure one
                p = sure[-1]
                theirs = boundaries(codes[p : b[k]], np.zeros(1, np.int64)) + p
            mine, stop = np.concatenate([sure[: np.searchsorted(sure, p)], theirs[np.searchsorted(theirs, p) :]]), b[k]
        out.append(mine)
        k += 1
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gather(offsets: np.ndarray, data: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[offsets[i]:offsets[i+1]] for each i of index, one after another, and where each starts."""
    size = (offsets[1:] - offsets[:-1])[index]
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(at[-1], dtype=np.int64)
    where += np.repeat(offsets[index] - at[:-1], size)
    return data[where], at


def span_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[starts[i]:ends[i]], the same wherever they stand."""
    return _spans.span(_spans.prefix(codes), starts, ends)


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, back): hash and number of one span of each kind, and the kind of each span. Spans of one kind have equal codes."""
    key, first, back = np.unique(_spans.span(_spans.prefix(codes), starts, ends), return_index=True, return_inverse=True)
    back = back.ravel()
    size = ends - starts
    like = first[back]
    # a hash only proposes; spans that aren't the first of their hash are held against it
    check = np.flatnonzero((like != np.arange(len(starts))) & (size == size[like]))
    bad = np.flatnonzero(size != size[like])
    if len(check):
        total = np.cumsum(size[check])
        cuts = np.searchsorted(total, np.arange(_CHECKED, total[-1] + _CHECKED, _CHECKED), side="right")
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):  # some codes at a time
            if b > a:
                part = check[a:b]
                n = size[part]
                at = np.cumsum(n) - n
                mine = np.arange(int(at[-1] + n[-1]))
                mine += np.repeat(starts[part] - at, n)
                differs = codes[mine] != codes[mine + np.repeat(starts[like[part]] - starts[part], n)]
                if differs.any():
                    bad = np.concatenate([bad, part[np.logical_or.reduceat(differs, at)]])
    kinds: dict[bytes, int] = {}
    for i in bad.tolist():
        name = codes[starts[i] : ends[i]].tobytes()
        if name not in kinds:
            kinds[name] = len(first) + len(kinds)
        back[i] = kinds[name]
    if kinds:
        own = np.unique(back[bad], return_index=True)[1]
        key, first = np.append(key, key[np.searchsorted(key, _spans.span(_spans.prefix(codes), starts[bad[own]], ends[bad[own]]))]), np.append(first, bad[own])
    return key, first, back


class Encoder:
    """Encodes batches of texts by a rank file. Distinct pieces are encoded once and kept up to a bound."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # pieces are handed over in one string with a separator between them
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"\x00|[^\x00]+", mergeable_ranks=self.ranks, special_tokens={})
        self.separator = self.ranks[b"\x00"]
        self._forget()

    def encode_around(self, texts: list[str], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """encode(), where special strings in a text become their own id and part what is on either side."""
        import regex

        found = [s for s in special if any(s in t for t in texts)]
        if not found:
            return self.encode(texts)
        split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        parts = [split.split(t) for t in texts]  # every other part is a special string
        ids, at = self.encode([x for p in parts for x in p[::2]])
        out, k = [], 0
        for p in parts:
            mine = []
            for i, x in enumerate(p):
                if i % 2:
                    mine.append(np.array([special[x]], np.uint32))
                else:
                    mine.append(ids[at[k] : at[k + 1]])
                    k += 1
            out.append(np.concatenate(mine))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.offsets, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        self.texts: list[str] = []

    def _add(self, pieces: list[str]) -> None:
        """Append the ids of new pieces to the pool, in order."""
        plain = "\x00".join("" if "\x00" in p else p for p in pieces)
        found = self.encoding.encode_to_numpy(plain, disallowed_special=())
        stops = np.append(np.flatnonzero(found == self.separator), len(found))
        starts = np.append(0, stops[:-1] + 1)
        flat, sizes = found[found != self.separator], stops - starts
        if any("\x00" in p for p in pieces):
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            parts = [np.array(self.encoding._encode_single_piece(p), np.uint32) if "\x00" in p else x for p, x in zip(pieces, parts)]
            flat, sizes = np.concatenate(parts).astype(np.uint32), np.array([len(x) for x in parts])
        n, at = self.size, self.offsets[self.size]
        while n + len(pieces) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.offsets[n + 1 : n + 1 + len(pieces)] = at + np.cumsum(sizes)
        self.ids[at : at + len(flat)] = flat
        self.texts += pieces
        self.size += len(pieces)

    def pieces(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's ids start) of codes[starts[i]:ends[i]]."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.size > _RESET:
            self._forget()
        key, first, back = distinct_spans(codes, starts, ends)
        a, b = starts[first], ends[first]
        flat, at = gather(np.stack([a, b], 1).ravel(), codes, np.arange(0, 2 * len(a), 2))
        text, at = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at.tolist()
        index, new = np.empty(len(first), np.int64), []
        for i, k in enumerate(key.tolist()):
            piece, known = text[at[i] : at[i + 1]], self.known.get(k, -1)
            # a piece that shares its hash with another is encoded by itself each time
            if known < 0 or known >= self.size or self.texts[known] != piece:
                known = self.size + len(new)
                self.known.setdefault(k, known)
                new.append(piece)
            index[i] = known
        if new:
            self._add(new)
        return gather(self.offsets, self.ids, index[back])

    def encode(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids start)."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts = split_texts(codes, offsets, chunk, overlap)
        ids, at = self.pieces(codes, starts, np.append(starts[1:], len(codes)))
        return ids, at[np.searchsorted(starts, offsets)]

    @property
    def tables(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each id, its raw bytes and its decimal digits with a blank behind, as (offsets, data)."""
        if not hasattr(self, "_tables"):
            raw = [b""] * (max(self.ranks.values()) + 1)
            for b, i in self.ranks.items():
                raw[i] = b
            self._tables = tuple((np.concatenate([[0], np.cumsum([len(x) for x in xs])]), np.frombuffer(b"".join(xs), np.uint8)) for xs in (raw, [b"%d " % i for i in range(len(raw))]))
        return self._tables


@lru_cache(2)
def encoder(ranks_path: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
