"""Merge-type piece encoding by backtracking, and decoding.

A run of pieces is what merging gives exactly if each two neighbours are what merging gives for the two alone: the first merge across
a boundary would also come first in the pair. So the longest piece at a place is tried first, then its shorter prefixes; a place
from which nothing leads on is marked in a bitfield and never entered again."""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, byte_lengths, lean, ship_code
from .encoding import ODD_PIECES, Stretches, piece_stretches, piece_vocabulary

#: Characters searched for pieces at once, pairs of neighbours that a worker remembers, text bytes encoded at once.
SEARCHED, PAIRS, BATCH_BYTES = 1 << 19, 400_000, 4 << 20
SPACE = "▁"


class Backtracking:
    """Ids of stretches by the pieces of a merge-type model. Only its vocabulary file comes from the library."""

    def __init__(self, path: str):
        import ahocorasick

        p, self.pieces = piece_vocabulary(path)
        n = len(self.pieces)
        self.begin, self.end = p.bos_id(), p.eos_id()
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        if any(p.is_unused(i) for i in normal) or len({self.pieces[i] for i in normal}) < len(normal):
            raise ValueError(f"{path}: unused or repeated pieces aren't handled")
        self.score = {self.pieces[i]: p.get_score(i) for i in normal}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.leaf = -1 - np.arange(0x110000)  # a character without a piece: -1 - its code point
        letters = {c for i in normal for c in self.pieces[i]}
        if len(self.byte) < 256 or any(c not in self.score for c in letters):
            raise ValueError(f"{path}: only models with a piece for each of 256 bytes and for each character of a piece are handled")
        self.gap = next(c for c in map(chr, range(32)) if c not in letters)  # stands between stretches that are searched at once
        number = {self.pieces[i]: i for i in normal}
        self.length = np.array([len(x) for x in self.pieces])
        self.shorter = [-1] * n
        self.find = ahocorasick.Automaton()
        for i in normal:
            piece = self.pieces[i]
            if len(piece) == 1:
                self.leaf[ord(piece)] = i
            else:
                self.find.add_word(piece, i)
                self.shorter[i] = next(number[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in number)
        self.find.make_automaton()
        self.lengths, self.fits = self.length.tolist(), {}
        control = [p.is_control(i) for i in range(n)]
        raw = [b"" if control[i] else " ⁇ ".encode() if p.is_unknown(i) else bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.pieces)]
        self.is_byte, self.is_control = np.array([p.is_byte(i) for i in range(n)]), np.array(control)
        self.opens = np.array([x.startswith(SPACE) and len(r) > 0 for x, r in zip(self.pieces, raw)])
        self.raw_length = np.array([len(x) for x in raw])
        self.raw_start, self.raw = np.cumsum(self.raw_length) - self.raw_length, np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merging by its definition: the best score first, of equal ones the leftmost. For the few characters of a pair."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max((score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging leaves these two apart and whole; left < 0: whether it makes the right one at all."""
        key = (left + 1) << 32 | right
        known = self.fits.get(key)
        if known is None:
            pair = [self.pieces[i] for i in (left, right) if i >= 0]
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merged("".join(pair)) == pair
        return known

    def longest(self, text: str) -> list[int]:
        """The longest piece that begins at each character."""
        best = self.leaf[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        found = np.fromiter(chain.from_iterable(self.find.iter(text)), np.int64).reshape(-1, 2)
        best[found[:, 0] + 1 - self.length[found[:, 1]]] = found[:, 1]  # matches come by their ends: the longest at a start comes last
        return best.tolist()

    def backtrack(self, best: list[int], start: int, stop: int) -> list[int]:
        """Pieces of the characters from start to stop; below 0 those without one."""
        lengths, shorter, known = self.lengths, self.shorter, self.fits
        out: list[int] = []
        failed, any_failed = bytearray((stop - start >> 3) + 1), False
        at, piece = start, best[start]
        while True:
            end = at + (lengths[piece] if piece >= 0 else 1)
            left = out[-1] if out else -1
            fits = not (any_failed and failed[end - start >> 3] >> (end - start & 7) & 1)
            if fits and piece >= 0 and (left >= 0 or end == stop):  # a character without a piece never merges
                if (fits := known.get((left + 1) << 32 | piece)) is None:
                    fits = self.neighbours(left, piece)
            if fits:
                out.append(piece)
                if end == stop:
                    return out
                at, piece = end, best[end]
                continue
            piece = shorter[piece] if piece >= 0 else -1
            while piece < 0:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                any_failed = True
                last = out.pop()
                at -= lengths[last] if last >= 0 else 1
                piece = shorter[last] if last >= 0 else -1

    def encode(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of stretches, each after a space sign. Many are searched at once."""
        words = [SPACE + s.replace(" ", SPACE) for s in new.to_pylist()]
        counts, ids = [], []
        for a, b in by_bytes(np.fromiter(map(len, words), np.int64, len(words)), SEARCHED):
            best, start = self.longest(self.gap.join(words[a:b])), 0
            for w in words[a:b]:
                got = self.backtrack(best, start, start + len(w))
                if min(got) < 0:
                    got = [y for x in got for y in ([x] if x >= 0 else [self.byte[v] for v in chr(-1 - x).encode()])]
                start += len(w) + 1
                counts.append(len(got))
                ids += got
        return np.array(counts, np.int64), np.array(ids, np.int32)

    def decode(self, lengths: np.ndarray, flat: np.ndarray) -> list[bytes]:
        """UTF-8 texts of runs of ids, as the library decodes them: begin and end vanish, and so does the space sign of the first other
        piece; bytes that are no UTF-8 become U+FFFD each."""
        n = self.raw_length[flat]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.raw[np.repeat(self.raw_start[flat] - total[:-1], n) + np.arange(total[-1])]
        ends = np.cumsum(lengths)
        has_bytes = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        out = []
        for a, b in zip((ends - lengths).tolist(), ends.tolist()):
            first = a
            while first < b and self.is_control[flat[first]]:
                first += 1
            text = data[total[a] + (1 if first < b and self.opens[flat[first]] else 0) : total[b]].tobytes()
            if has_bytes[b] > has_bytes[a] and not _is_utf8(text):
                text = self._mended(flat[first:b])
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, held = [], b""
        for k, i in enumerate(ids.tolist()):
            raw = self.raw[self.raw_start[i] : self.raw_start[i] + self.raw_length[i]].tobytes()
            if self.is_byte[i]:
                held += raw
                continue
            out += [_valid(held), raw[1:] if k == 0 and self.opens[i] else raw]
            held = b""
        return b"".join([*out, _valid(held)])


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _valid(data: bytes) -> bytes:
    """Each byte that begins no whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        n = next((n for n in (1, 2, 3, 4) if at + n <= len(data) and _is_utf8(data[at : at + n])), 0)
        out.append(data[at : at + n] if n else "�".encode())
        at += n or 1
    return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> tuple[Backtracking, Stretches]:
    b = Backtracking(path)
    return b, Stretches(ODD_PIECES, piece_stretches, False, b.encode, len(b.pieces))


def _framed(lengths: np.ndarray, flat: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths + 2)
    out = np.empty(len(flat) + 2 * len(lengths), flat.dtype)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - 2 - lengths] = False
    out[inner], out[ends - 1], out[ends - 2 - lengths] = flat, end, begin
    return lengths + 2, out


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, ids array<int>): begin, the pieces of the whole text, end.

    A null or empty text is begin and end alone; null and repeated ids stay as they are, a row each; an empty table gives an
    empty result; other columns are not read. One narrow stage: texts are cut at isolated spaces, where no piece crosses, and each new stretch of
    a worker is encoded once. `model` is a file that every executor can read."""
    ship_code(docs.sparkSession)

    def run(batches):
        b, stretches = codec(model)
        for batch in batches:
            for i, j in by_bytes(byte_lengths(batch.column(1)), batch_bytes):
                n, flat = _framed(*stretches.ids(batch.column(1).slice(i, j - i)), b.begin, b.end)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", batch_ids: int = BATCH_BYTES // 4) -> DataFrame:
    """(id, n_tokens, ids_sha256, text): any ids of the vocabulary decoded, with the digest of the ids as little-endian unsigned 32-bit numbers.
    Null ids count as none; an id outside the vocabulary is an error. One narrow stage."""
    ship_code(encoded.sparkSession)

    def run(batches):
        b, _ = codec(model)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(b.pieces)):
                raise ValueError("an id outside the vocabulary")
            for i, j in by_bytes(np.diff(offsets), batch_ids):
                n, ids = np.diff(offsets[i : j + 1]), flat[offsets[i] : offsets[j]]
                texts = b.decode(n, ids)
                packed, to = memoryview(ids.astype("<u4").tobytes()), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
                digests = [hashlib.sha256(packed[x:y]).hexdigest() for x, y in zip(to, to[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, "n_tokens", "ids_sha256", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {dict(encoded.dtypes)[id_col]}, n_tokens long, ids_sha256 string, text string")
