"""Token ids of whole texts, word by word.

Both kinds of tokenizer split or merge only within the stretch between two isolated spaces, so a text may be cut
there without changing its ids (`safe boundaries`). Texts are cut and looked up as Arrow columns; each new stretch of a worker is
encoded once, by the library in one batch, and a text's ids are gathered from the stretches'."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct stretches that a worker remembers (about 60 bytes each); beyond, it keeps the half that was met most often.
MEMO = 400_000
#: Ids that a worker remembers, and bytes of a stretch beyond which it is forgotten first.
MOST_IDS, LONG = 16 * MEMO, 1024


class Stretches:
    """Ids of stretches, gathered by number. `odd` is a pattern of texts that `cut` must cut; all others are cut at each space.
    If `marks_first`, a text's first stretch, which no space precedes, is another one than the same word later: it is known by a space before it."""

    def __init__(self, odd: str, cut, marks_first: bool, encode, vocabulary: int, keep_ids: bool = True):
        self.odd, self.cut, self.marks_first, self.encode, self.vocabulary, self.keep_ids = odd, cut, marks_first, encode, vocabulary, keep_ids
        self.forget(np.zeros(0, np.int64))

    def forget(self, keep: np.ndarray) -> None:
        """Only the stretches of these numbers stay."""
        if len(keep):
            n = self.lengths[keep]
            if self.keep_ids:
                self.flat = self.flat[np.repeat(self.starts[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self.known, self.lengths, self.met, self.starts = self.known.take(pa.array(keep)), n, self.met[keep], np.cumsum(n) - n
        else:
            self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32)
            self.starts, self.lengths, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All stretches of some texts (null as empty), how many each text has, and the texts' numbers in the order in which they come."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(full & ~odd)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        if self.marks_first and len(plain):
            first = np.zeros(len(flat), bool)
            first[offsets[:-1] - offsets[0]] = True
            named = pc.binary_join_element_wise(pa.scalar(""), flat.filter(pa.array(first)), " ")
            flat = pc.replace_with_mask(flat, pa.array(first), named)
        parts, counts, order = [flat], [np.diff(offsets)], [plain]
        if len(rest := np.flatnonzero(full & odd)):
            cut = [self.cut(t) for t in texts.take(pa.array(rest)).to_pylist()]
            parts.append(pa.array([s for x in cut for s in x], pa.string()))
            counts.append(np.array([len(x) for x in cut], np.int64))
            order.append(rest)
        empty = np.flatnonzero(~full)
        return pa.concat_arrays(parts), np.concatenate([*counts, np.zeros(len(empty), np.int64)]), np.concatenate([*order, empty])

    def numbers(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, self.known)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            lost = words.filter(at.is_null())
            new = pc.unique(lost)
            out[out < 0] = len(self.known) + pc.index_in(lost, new).to_numpy()
            lengths, flat = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths, self.met = np.concatenate([self.lengths, lengths]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
            if self.keep_ids:
                self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, new])
        self.met += np.bincount(out, minlength=len(self.met))
        return out

    def trim(self) -> None:
        """Bounds the memory: of the short stretches, the half that was met most often stays, if its ids are few enough."""
        if len(self.known) <= MEMO and len(self.flat) <= MOST_IDS:
            return
        short = np.flatnonzero(pc.binary_length(self.known).to_numpy() <= LONG)
        keep = short[np.argsort(-self.met[short], kind="stable")[: MEMO // 2]]
        self.forget(np.sort(keep[np.cumsum(self.lengths[keep]) <= MOST_IDS // 2]))
        self.met //= 2

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        words, n_words, order = self.words(texts)
        number = self.numbers(words)
        total = np.concatenate([[0], np.cumsum(self.lengths[number])])
        out, ends = np.empty(len(texts), np.int64), np.cumsum(n_words)
        out[order] = total[ends] - total[ends - n_words]
        self.trim()
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in the texts' order)."""
        words, n_words, order = self.words(texts)
        number = self.numbers(words)
        if len(order) and (order[1:] < order[:-1]).any():  # back into the texts' order
            begin, place = np.cumsum(n_words) - n_words, np.argsort(order)
            n_words, begin = n_words[place], begin[place]
            number = number[np.repeat(begin - (np.cumsum(n_words) - n_words), n_words) + np.arange(n_words.sum())]
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[number] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        total, to = np.concatenate([[0], ends]), np.cumsum(n_words)
        self.trim()
        return total[to] - total[to - n_words], flat


_BEFORE_WORD = re.compile(r"(?<=.)(?= \S)", re.S)
_ISOLATED = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
#: A space before white space of any kind, or at the end.
_ODD_BYTES = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| \z"
ODD_PIECES = r"  |▁|\A | \z"


def byte_level_stretches(text: str) -> list[str]:
    """Stretches without the space before each, the first marked by one. A byte-level pre-tokenizer always cuts before a space that a word
    follows; longer runs of white space stay inside a stretch."""
    if not text:
        return []
    first, *rest = _BEFORE_WORD.split(text)
    return [" " + first, *(s[1:] for s in rest)]


def piece_stretches(text: str) -> list[str]:
    """Stretches without the isolated spaces between them: the library puts a space sign before each. No vocabulary entry
    holds that sign after another character, so no merge crosses such a boundary."""
    return _ISOLATED.split(text) if text else []


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return lengths, np.fromiter((x for y in ids for x in y), np.int32, int(lengths.sum()))


def _joined(words: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


def _in_one(new: pa.Array, apart: np.ndarray, together, alone) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of stretches in order: most from one call on their joined text, the odd ones each by itself."""
    lengths, flat = together(new.filter(pa.array(~apart)))
    if not apart.any():
        return lengths, flat
    odd_lengths, odd = _flat(alone(new.filter(pa.array(apart)).to_pylist()))
    out = np.empty(len(new), np.int64)
    out[apart], out[~apart] = odd_lengths, lengths
    ids = np.empty(len(flat) + len(odd), np.int32)
    from_odd = np.repeat(apart, out)
    ids[from_odd], ids[~from_odd] = odd, flat
    return out, ids


def _any(words: pa.Array, parts: list[str]) -> np.ndarray:
    found = np.zeros(len(words), bool)
    for p in parts:
        found |= pc.match_substring(words, p).to_numpy(zero_copy_only=False)
    return found


def _json_encoder(path: str, plain: bool = False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    if type(t.pre_tokenizer).__name__ != "ByteLevel" or t.normalizer is not None:
        raise ValueError(f"{path}: only a byte-level tokenizer without normalizer may be cut at spaces")
    added = t.get_added_tokens_decoder()
    special = [] if plain else [a.content for a in added.values()]
    n_bytes = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():  # a sign of the byte-level alphabet stands for one byte
        n_bytes[i] = len(token.encode() if i in added else token)

    def alone(new: list[str]) -> list[list[int]]:
        return [x.ids for x in t.encode_batch_fast([s[1:] if s[:1] == " " else " " + s for s in new], add_special_tokens=False)]

    def together(new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One call on the joined text; the ids' bytes tell where each stretch ends."""
        if not len(new):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ids = np.array(t.encode_batch_fast([" " + _joined(new)], add_special_tokens=False)[0].ids, np.int32)
        ends, done = np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64) + 1), np.cumsum(n_bytes[ids])
        last = np.searchsorted(done, ends)
        if not (last < len(done)).all() or not (done[last] == ends).all():
            raise ValueError(f"{path}: an id crosses a boundary of stretches")
        return np.diff(np.concatenate([[-1], last])), ids

    apart = lambda new: pc.starts_with(new, " ").to_numpy(zero_copy_only=False) | _any(new, special)
    return lambda new: _in_one(new, apart(new), together, alone), t.get_vocab_size()


def piece_vocabulary(path: str):
    """(the library's model, its pieces), if the model allows to cut texts at isolated spaces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    if any("▁" in x.lstrip("▁") for x in pieces):
        raise ValueError(f"{path}: a piece joins words, so texts can't be cut at spaces")
    probe = "a b ﬁ Å　x\ty\nÀ  z"  # what the common normalizers change: spaces of other kinds, ligatures, combined letters
    if p.normalize(probe) != "▁" + probe.replace(" ", "▁"):
        raise ValueError(f"{path}: the model changes texts before it cuts them, so they can't be cut at spaces")
    return p, pieces


def _piece_encoder(path: str):
    p, pieces = piece_vocabulary(path)
    opens = np.array([x.startswith("▁") for x in pieces])

    def together(new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each stretch begins at a piece with the space sign."""
        if not len(new):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ids = np.array(p.encode(_joined(new), num_threads=1), np.int32)
        lengths = np.diff(np.concatenate([np.flatnonzero(opens[ids]), [len(ids)]]))
        if len(lengths) != len(new):
            raise ValueError(f"{path}: an id crosses a boundary of stretches")
        return lengths, ids

    alone = lambda new: p.encode(new, num_threads=1)
    return lambda new: _in_one(new, _any(new, [" ", "▁"]), together, alone), p.get_piece_size()


@functools.lru_cache(maxsize=4)
def encoder(path: str, keep_ids: bool = True, plain: bool = False) -> Stretches:
    """Memory of stretches for a tokenizer file: tokenizers for .json, sentencepiece for .model. Without `keep_ids` it counts only. If `plain`,
    the strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        encode, n = _json_encoder(path, plain)
        return Stretches(_ODD_BYTES, byte_level_stretches, True, encode, n, keep_ids)
    encode, n = _piece_encoder(path)
    return Stretches(ODD_PIECES, piece_stretches, False, encode, n, keep_ids)
