"""Piece encoding and decoding (byte-pair merges) with a seeded dropout of candidate merges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, list_array, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
SPACE, LITERAL = 0x2581, 0x110000  # the model's mark for a space; stands for that mark as the text's own character
#: Longest unit that goes through the table of many units; longer ones are merged one by one with a heap.
WIDE = 40
#: Units merged without dropout that a task keeps for later slices.
KEEP = 300_000

_NO = np.iinfo(np.int32).max


class Pieces:
    """A piece model's vocabulary as arrays.  Symbols are numbers: pieces' ids, then single characters without a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        number = {self.names[i]: i for i in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain_set = set(plain)
        self.raw = [self.names[i].replace("▁", " ").encode() if i in plain_set else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(n, _NO, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.of_rank = np.array(order, np.int32)
        singles = {ord(s): i for s, i in number.items() if len(s) == 1}
        for s in number:
            for c in s:
                singles.setdefault(ord(c), n + len(singles))
        self.codes = np.array(sorted(singles), np.int64)
        self.symbols = np.array([singles[c] for c in self.codes.tolist()], np.int64)
        self.near = np.full(1 << 16, -1, np.int64)  # of the first 65536 code points, which nearly all texts keep to
        self.near[self.codes[self.codes < 1 << 16]] = self.symbols[self.codes < 1 << 16]
        self.other = n + len(singles) + 1  # code point c without a symbol is other + c
        symbol = lambda s: number.get(s, singles[ord(s)] if len(s) == 1 else None)
        merges = {}
        for s, i in number.items():
            for k in range(1, len(s)):
                left, right = symbol(s[:k]), symbol(s[k:])
                if left is not None and right is not None:
                    merges[left, right] = i
        self.merges = merges
        keys = np.array([(a << 32) | b for a, b in merges], dtype=np.uint64)
        self.bits = int(np.ceil(np.log2(max(2, len(keys))))) + 2
        self.slot_key, self.slot_rank = np.full(1 << self.bits, np.iinfo(np.uint64).max), np.full(1 << self.bits, _NO, np.int32)
        ranks, left, self.probes = self.rank[np.array(list(merges.values()), dtype=np.int64)], np.arange(len(keys)), 0
        while len(left):
            at = (self._home(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = self.slot_key[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.slot_key[at[take]], self.slot_rank[at[take]] = keys[left[take]], ranks[left[take]]
            left = np.delete(left, take)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make together; _NO if none."""
        keys = (left.astype(np.uint64) << U64(32)) | right.astype(np.uint64)
        home, out, open_ = self._home(keys), np.full(len(keys), _NO, np.int32), np.arange(len(keys))
        for probe in range(self.probes):
            at = (home[open_] + probe) & ((1 << self.bits) - 1)
            held = self.slot_key[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            open_ = open_[~hit & (held != np.iinfo(np.uint64).max)]
            if not len(open_):
                break
        return out

    def symbol_of(self, codes: np.ndarray) -> np.ndarray:
        if codes.max(initial=0) < 1 << 16:
            found = self.near[codes]
            return np.where(found >= 0, found, self.other + codes)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.symbols[at], self.other + codes)

    def ids_of(self, symbols: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, of which those without a piece become their bytes, and how many ids each has."""
        whole = symbols < len(self.names)
        count = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(~whole)
        if not len(odd):
            return symbols.astype(np.int32), count
        spelled = [_bytes_of(int(c)) for c in codes[odd]]
        count[odd] = [len(x) for x in spelled]
        out = np.repeat(symbols, count).astype(np.int32)
        first = np.cumsum(count) - count
        for at, text in zip(first[odd].tolist(), spelled, strict=True):
            out[at : at + len(text)] = self.byte_ids[list(text)]
        return out, count


def _bytes_of(code: int) -> bytes:
    if code == LITERAL:
        return "▁".encode()
    return bytes([code - 0xDC00]) if 0xDC80 <= code <= 0xDCFF else chr(code).encode("utf-8", "surrogatepass")


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


def _candidate(start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A candidate merge as a number: where the left symbol starts, and the two symbols."""
    with np.errstate(over="ignore"):
        return start.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + (left.astype(np.uint64) << U64(32)) + right.astype(np.uint64)


def _skipped(key: np.ndarray, candidate: np.ndarray, dropout: float) -> np.ndarray:
    """By a keyed hash of the candidate merge."""
    with np.errstate(over="ignore"):
        return (mix(key + candidate) >> U64(11)).astype(np.float64) < dropout * float(1 << 53)


def _merge_table(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray, key: np.ndarray, dropout: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short units: rows of ``symbols`` (n, widest).  Each row's agenda is its row of candidate ranks;
    a step takes the best candidate of each row.  Returns the symbols and which of them are still there; ``met`` gets
    the rows and candidates that came up."""
    n, wide = symbols.shape
    there = np.arange(wide)[None, :] < lengths[:, None]
    nxt, prev = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, wide - 1), (n, 1))
    rank = np.full((n, wide), _NO, np.int32)

    def fill(row: np.ndarray, at: np.ndarray) -> None:
        after = nxt[row, at]
        ok = after < lengths[row]
        rank[row[~ok], at[~ok]] = _NO
        row, at, after = row[ok], at[ok], after[ok]
        left, right = symbols[row, at], symbols[row, after]
        value = pieces.pair_rank(left, right)
        if dropout > 0 or met is not None:
            hit = np.flatnonzero(value != _NO)
            candidate = _candidate(at[hit], left[hit], right[hit])
            if met is not None:
                met.append((row[hit], candidate))
            if dropout > 0:
                value[hit[_skipped(key[row[hit]], candidate, dropout)]] = _NO
        rank[row, at] = value

    row, at = np.nonzero(np.arange(wide)[None, :] < lengths[:, None] - 1)
    fill(row, at)
    active = np.arange(n)
    while len(active):
        at = rank[active].argmin(axis=1)
        value = rank[active, at]
        alive = value != _NO
        active, at, value = active[alive], at[alive], value[alive]
        if not len(active):
            break
        gone = nxt[active, at]
        symbols[active, at] = pieces.of_rank[value]
        there[active, gone] = False
        rank[active, gone] = _NO
        after = nxt[active, gone]
        nxt[active, at] = after
        inner = after < lengths[active]
        prev[active[inner], after[inner]] = at[inner]
        fill(active, at)
        before = prev[active, at]
        inner = before >= 0
        fill(active[inner], before[inner])
    return symbols, there


def _merge_long(pieces: Pieces, symbols: np.ndarray, key: int, dropout: float) -> np.ndarray:
    """Merge one long unit with a heap of candidates; returns the places of the symbols left (``symbols`` changes)."""
    n = len(symbols)
    nxt, prev, there = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    sym, agenda = symbols.tolist(), []

    def push(i: int) -> None:
        if i >= 0 and nxt[i] < n and (piece := pieces.merges.get((sym[i], sym[nxt[i]]))) is not None:
            one = lambda x, kind=np.int64: np.array([x], kind)
            if not (dropout > 0 and _skipped(one(key, np.uint64), _candidate(one(i), one(sym[i]), one(sym[nxt[i]])), dropout)[0]):
                heapq.heappush(agenda, (int(pieces.rank[piece]), i, sym[i], sym[nxt[i]]))

    for i in range(n):
        push(i)
    while agenda:
        value, i, left, right = heapq.heappop(agenda)
        if not there[i] or sym[i] != left or nxt[i] >= n or sym[nxt[i]] != right:
            continue
        gone = nxt[i]
        sym[i], there[gone], nxt[i] = int(pieces.of_rank[value]), False, nxt[gone]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        push(prev[i])
    symbols[:] = sym
    return np.flatnonzero(there)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with a space mark in front unless it is empty; bytes that are no UTF-8 become
    the surrogates DC80 to DCFF."""
    raw = data.tobytes()
    parts = [raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    joined = "".join(" " + p if p else "" for p in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == SPACE] = LITERAL
    codes[codes == 0x20] = SPACE
    return codes, np.concatenate(([0], np.cumsum([len(p) + 1 if p else 0 for p in parts])))


class Encoder:
    """Encodes slices of texts.  Every occurrence of a unit draws its own skipped merges.  What a unit gives without dropout,
    and the candidate merges that come up on the way, is kept from one slice to the next, KEEP units at most: an occurrence
    that skips none of these candidates has that result, every other one is merged anew."""

    def __init__(self, path: str = MODEL, seed: int = 0, dropout: float = DROPOUT):
        self.pieces, self.seed, self.dropout = load(path), seed, dropout
        self.forget()

    def forget(self) -> None:
        none = lambda kind=np.int64: np.zeros(0, kind)
        self.known, self.count, self.first, self.flat = none(np.uint64), none(), none(), none(np.int32)
        self.met_count, self.met_first, self.met = none(), none(), none(np.uint64)

    def encode(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text.  ``keys``: a uint64 of each text, which keys its units' hashes."""
        codes, at = _codes(data, offsets)
        if not len(codes):
            return [np.zeros(0, np.int32) for _ in keys]
        mark = codes == SPACE
        head = np.zeros(len(codes), dtype=bool)
        head[at[:-1][np.diff(at) > 0]] = True
        begin = np.flatnonzero(head | (mark & ~np.concatenate(([False], mark[:-1]))))
        end = np.append(begin[1:], len(codes))
        row = np.searchsorted(at, begin, "right") - 1
        with np.errstate(over="ignore"):
            nth = np.arange(len(begin)) - np.searchsorted(row, row)
            key = mix(mix(keys[row] + U64(self.seed) * U64(0xD6E8FEB86659FD93)) + nth.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            letters = mix(codes.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F) + (np.arange(len(codes)) - np.repeat(begin, end - begin)).astype(np.uint64) * U64(0x9FB21C651E98DF25))
            unit = mix(np.add.reduceat(letters, begin) + (end - begin).astype(np.uint64))
        count, first, flat = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), self.flat
        anew = (end - begin > WIDE) & (self.dropout > 0)
        if len(short := np.flatnonzero(~anew)):
            place = self._places(unit[short], codes, begin[short], end[short])
            count[short], first[short], flat = self.count[place], self.first[place], self.flat
            if self.dropout > 0:
                n = self.met_count[place]
                owner = np.repeat(np.arange(len(short)), n)
                candidate = self.met[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.met_first[place], n)]
                anew[short[owner[_skipped(key[short[owner]], candidate, self.dropout)]]] = True
        if len(anew := np.flatnonzero(anew)):
            count[anew], own, more = self._segment(codes, begin[anew], end[anew], key[anew], self.dropout)
            first[anew] = own + len(flat)
            flat = np.concatenate([flat, more])
        source = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = flat[source]
        cuts = total[np.searchsorted(row, np.arange(len(at)))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _places(self, unit: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each unit is among the known ones; new ones are merged without dropout."""
        distinct, one, which = np.unique(unit, return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[place] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            names, met = distinct[new], [] if self.dropout > 0 else None
            count, first, flat = self._segment(codes, begin[one[new]], end[one[new]], np.zeros(len(new), np.uint64), 0.0, met)
            owner, candidate = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            met_count = np.bincount(owner, minlength=len(new))
            at = np.searchsorted(self.known, names)  # both are sorted
            put = lambda old, x: np.insert(old, at, x)
            self.known, self.count, self.first = put(self.known, names), put(self.count, count), put(self.first, first + len(self.flat))
            self.met_count, self.met_first = put(self.met_count, met_count), put(self.met_first, np.cumsum(met_count) - met_count + len(self.met))
            self.flat, self.met = np.concatenate([self.flat, flat]), np.concatenate([self.met, candidate[np.argsort(owner, kind="stable")]])
            place = np.searchsorted(self.known, distinct)
        return place[which]

    def _segment(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray, dropout: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each unit has, where they begin, and all ids; ``met`` gets the candidates of units up to WIDE."""
        size = end - begin
        count, parts, order = np.zeros(len(size), np.int64), [], []
        for low, high in ((1, 6), (7, 12), (13, WIDE)):
            for chunk in np.array_split(mine, max(1, len(mine) // 8_000)) if len(mine := np.flatnonzero((size >= low) & (size <= high))) else []:
                wide = int(size[chunk].max())
                cell = np.minimum(begin[chunk][:, None] + np.arange(wide)[None, :], len(codes) - 1)
                own = None if met is None else []
                symbols, there = _merge_table(self.pieces, self.pieces.symbol_of(codes[cell]), size[chunk], key[chunk], dropout, own)
                if own is not None:
                    met.extend((chunk[row], candidate) for row, candidate in own)
                ids, n = self.pieces.ids_of(symbols[there], codes[cell][there])
                each = there.sum(axis=1)
                count[chunk] = np.add.reduceat(n, np.cumsum(each) - each)
                parts.append(ids)
                order.append(chunk)
        for i in np.flatnonzero(size > WIDE).tolist():
            own = codes[begin[i] : end[i]]
            symbols = self.pieces.symbol_of(own)
            left = _merge_long(self.pieces, symbols, int(key[i]), dropout)
            ids, n = self.pieces.ids_of(symbols[left], own[left])
            count[i] = n.sum()
            parts.append(ids)
            order.append(np.array([i]))
        order = np.concatenate(order)
        first = np.zeros(len(size), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return count, first, np.concatenate(parts)


def decode_bytes(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text's bytes: the pieces one after the other, without the space in front."""
    raw = pieces.raw
    return b"".join([raw[i] for i in ids.tolist()])[1:]


def _texts(ids: list[np.ndarray], pieces: Pieces) -> pa.Array:
    return pa.array([decode_bytes(x, pieces) for x in ids], pa.binary()).view(pa.string())


def encode(docs: DataFrame, path: str = MODEL, seed: int = 0, dropout: float = DROPOUT) -> DataFrame:
    """``doc_id, ids`` (array<int>) of each whole text under the piece model at ``path``.

    Merging follows an agenda of candidate merges, best piece first; each candidate is skipped for good if a hash keyed
    with ``seed``, doc_id, the word's number in the text, the place and the two symbols falls below ``dropout``.  Every occurrence
    of a word so draws for itself, and a rerun gives the same ids.
    With dropout 0 the ids are the model's own.  Characters without a piece, bytes that are no UTF-8, and the space mark as
    a character of the text become byte pieces, so that decoding gives every text back.

    Null and empty texts get no ids; a null doc_id counts as 0 in the key; repeated rows are encoded alike; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, seed, dropout)
        for part, data, offsets in slices(batches):
            ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(encoder.encode(ids, data, offsets), pa.int32())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` (with a column ``ids``) and the decoded ``text``; ids outside the vocabulary raise, null ids give empty text."""
    rest = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            column = batch.column("ids").fill_null([])
            flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            text = _texts([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str = MODEL, seed: int = 0, dropout: float = DROPOUT) -> DataFrame:
    """``doc_id, ids, text``: what ``decode(encode(docs))`` gives, in one pass, so that a task holds one Python process."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, seed, dropout)
        for part, data, offsets in slices(batches):
            keys = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids = encoder.encode(keys, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(ids, pa.int32()), _texts(ids, encoder.pieces)], names=["doc_id", "ids", "text"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>, text string")
