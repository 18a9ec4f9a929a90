"""Fill-in-the-middle: texts cut at code points and put together in another order.

Cuts are found in the UTF-8 bytes of a whole Arrow batch, eight at a time: a byte ends a code point if the next one doesn't continue it, `bitwise_count`
tells how many ends a word holds, their running sums find the word of an end, and a sum within the word its byte."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, byte_lengths, lean, ship_code

#: Text bytes handled at once.
BATCH_BYTES = 8 << 20
_HIGH, _ONES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
_U = np.uint64


class Ends:
    """Places of the code points' ends in some UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        words = np.zeros(len(data) // 8 + 2, "<u8")
        words.view(np.uint8)[: len(data)] = data
        starts = (~words | words << _U(1)) & _HIGH  # not 10xxxxxx
        ends = starts >> _U(8)
        ends[:-1] |= starts[1:] << _U(56)
        self.bits = ends >> _U(7)  # 1 in each byte that ends a code point
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def count(self, at: np.ndarray) -> np.ndarray:
        """Ends among the bytes before each place."""
        inside = (_U(1) << (at.astype(_U) & _U(7)) * _U(8)) - _U(1)
        return self.before[at >> 3] + np.bitwise_count(self.bits[at >> 3] & inside)

    def place(self, count: np.ndarray) -> np.ndarray:
        """The place behind the end of this number, from 1; 0 for none."""
        word = np.searchsorted(self.before, count, "left") - 1
        rest = (count - self.before[word]).astype(_U)
        sums = self.bits[word] * _ONES  # in byte k: ends in bytes 0 to k, at most 8
        below = ((sums | _HIGH) - rest * _ONES) & _HIGH ^ _HIGH  # bytes whose sum is smaller than rest
        return np.where(count > 0, word * 8 + np.bitwise_count(below) + 1, 0)


def _hashes(doc_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, signs: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output). Of n code points the prefix ends after the smaller and the middle after the larger of
    h1 % (n + 1) and h2 % (n + 1); `plain` percent of the texts, empty ones and those with one of the signs (prefix, suffix, middle) stay as they are, `spm` percent of
    the others put the suffix first. The h are 32-bit groups of the SHA-256 of "seed:id".

    A null text is empty; a null id hashes as an empty one; repeated rows give a row each and the same cuts for the same id; an empty table gives an empty result; other
    columns are not read. One narrow stage, bounded by an Arrow batch."""
    if any(a != b and a in b for a in signs for b in signs) or len(set(signs)) < 3 or any(a[:k] == b[-k:] for a in signs for b in signs for k in range(1, len(a)) if k < len(b)):
        raise ValueError("signs must differ, and none may begin as another ends")
    ship_code(docs.sparkSession)
    sign = [s.encode() for s in signs]
    any_sign = "|".join(map(re.escape, signs))

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            for i, j in by_bytes(byte_lengths(batch.column(1)), batch_bytes):
                part = batch.slice(i, j - i)
                texts = pc.fill_null(part.column(1), "").cast(pa.large_string())
                texts = pa.concat_arrays([texts])  # offsets from 0
                _, offsets, data = texts.buffers()
                offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
                ends = Ends(data)
                base = ends.count(offsets)
                n = np.diff(base)
                h = np.frombuffer(bytes.fromhex("".join(part.column(2).to_pylist())), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                whole = (n == 0) | (h[:, 2] % 100 >= 100 - plain) | pc.match_substring_regex(texts, any_sign).to_numpy(zero_copy_only=False)
                back = ~whole & (h[:, 3] % 100 < spm)
                cuts = [np.where(x > 0, ends.place(base[:-1] + x), offsets[:-1]) for x in (low, high)]
                out, raw = [], data.tobytes()
                for a, p, m, b, w, s in zip(offsets.tolist(), *(c.tolist() for c in cuts), offsets[1:].tolist(), whole.tolist(), back.tolist()):
                    if w:
                        out.append(raw[a:b])
                    elif s:
                        out.append(b"".join((sign[1], raw[m:b], sign[0], raw[a:p], sign[2], raw[p:m])))
                    else:
                        out.append(b"".join((sign[0], raw[a:p], sign[1], raw[m:b], sign[2], raw[p:m])))
                form = np.where(whole, "plain", np.where(back, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=whole), pa.array(high - low, mask=whole), pa.array(out, pa.binary()).cast(pa.string())],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(id_col), F.col(text_col), _hashes(F.col(id_col), seed))
    return found.mapInArrow(lean(run), f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, signs: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The exact text from an output and its form. Its parts hold no sign, so that the three signs found are the ones put in."""
    parts = F.split(output, "|".join("\\Q" + s + "\\E" for s in signs), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
