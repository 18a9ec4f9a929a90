"""Piece codec, fill-in-the-middle and alignment against the library, a brute-force version and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import queries as Q
from vigil.llm.alignment import align_documents, terminals
from vigil.llm.common import Workspace
from vigil.llm.fill_in_middle import Ends, fill_in_middle, restored
from vigil.llm.piece_bpe import codec, decode_pieces, encode_pieces

from .helpers import odd_documents

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
#: Extra columns that clash with the operators' own.
SCHEMA = "doc_id long, text string, n long, ids string, form string, block long, links int, output string"


def hostile():
    rng = random.Random(3)
    texts = [" " * i + "ab" + " " * (i // 2) for i in range(1, 40)] + [" " * i for i in range(1, 70)] + ["a" * i for i in range(1, 40)]
    texts += ["日本語한국어🙂" * 7, "ab\x00cd\x01e", "x" * 3000, "=" * 500 + "-" * 300, "▁▁▁a ▁ b", "<P> in it", "a <M", "<S>", "<", ">x<P", "<|endoftext|>", "<0x41> <unk>", "é‍👩‍🔬"]
    return texts + ["".join(rng.choice("abcdeth ▁ \n.é日🙂=  ") for _ in range(rng.randint(1, 40))) for _ in range(300)]


def rows():
    docs = odd_documents()
    docs += [(1000 + i, t) for i, t in enumerate(hostile())]
    return docs + [(None, "a null id"), (None, "a null id"), (-5, "negative"), (3, "one"), (3, "a repeated id"), (2**40, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, "z") for i, t in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer(PIECES))


def key(r):
    return tuple((x is not None, x) for x in r)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_pieces_equal_the_library(spark, docs, library):
    model = Q.tokenizer(PIECES)
    encoded = encode_pieces(docs, model, batch_bytes=2000)
    got = sorted((tuple(r) for r in decode_pieces(encoded, model, batch_ids=500).collect()), key=key)
    want = []
    for i, t in rows():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), library.decode(ids)))
    assert got == sorted(want, key=key)
    assert decode_pieces(encode_pieces(docs.limit(0), model), model).count() == 0


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = random.Random(5)
    b, _ = codec(Q.tokenizer(PIECES))
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(262), 259 + rng.randrange(40)]) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    got = b.decode(np.array([len(x) for x in lists]), np.array([y for x in lists for y in x]))
    assert [x.decode() for x in got] == [library.decode(x) for x in lists]
    bad = spark.createDataFrame([(1, [1, 32000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode_pieces(bad, Q.tokenizer(PIECES)).collect()
    assert decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), Q.tokenizer(PIECES)).first()["n_tokens"] == 0


def test_merging_by_its_definition_equals_backtracking():
    """On stretches, without the library: the whole stretch merged at once."""
    rng = random.Random(7)
    b, _ = codec(Q.tokenizer(PIECES))
    words = ["".join(rng.choice("estanriolu ▁") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    n, flat = b.encode(pa.array(words))
    ends = np.cumsum(n)
    for w, x, y in zip(words, ends - n, ends):
        assert [b.pieces[i] for i in flat[x:y]] == b.merged("▁" + w.replace(" ", "▁")), w


def test_ends_of_code_points():
    rng = random.Random(1)
    for size in range(70):
        text = "".join(rng.choice("aé日🙂") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        e = Ends(data)
        places = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert e.place(np.arange(size + 1)).tolist() == places.tolist()
        want = [sum(p <= at for p in places[1:]) for at in range(len(data) + 1)]
        assert e.count(np.arange(len(data) + 1)).tolist() == want


def test_fill_in_middle_equals_the_definition(spark, docs):
    out = fill_in_middle(docs, batch_bytes=3000)
    from pyspark.sql import functions as F

    got = sorted((tuple(r) for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()), key=key)
    want, forms = [], Counter()
    for i, t in rows():
        t, h = t or "", sha(f"1:{'' if i is None else i}")
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(t)
        p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        pre, mid, suf = t[:p], t[p:q], t[q:]
        form = "plain" if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        forms[form] += 1
        text = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        want.append((i, n, form, *((None, None) if form == "plain" else (p, q - p)), text, t))
    assert got == sorted(want, key=key)
    assert min(forms.values()) > 20
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_signs_that_overlap_are_an_error(docs):
    for signs in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("a", "xay", "z")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, signs=signs)


def plain_alignment(texts, library):
    """Straight from the definition: groups by a walk over both lists of ends, links by all pairs that end together, counts in one table."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer(BYTES))
    t.encode_special_tokens = True
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found, counts = [], Counter()
    for text in texts:
        text = text or ""
        a, b = t.encode(" " + text, add_special_tokens=False), library.encode(text)
        bytes_a = [bytes(byte[c] for c in x) for x in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [library.id_to_piece(i)]]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, x, y, ids_a = [], 0, 0, a.ids  # the library makes that list anew at each call
        for c in cuts:
            p, q = ends_a.index(c, x) + 1, ends_b.index(c, y) + 1
            groups.append((",".join(map(str, ids_a[x:p])), ",".join(map(str, b[y:q]))))
            x, y = p, q
        at_b = defaultdict(list)
        for i, e in zip(b, ends_b):
            at_b[e].append(i)
        links = [(i, j) for i, e in zip(ids_a, ends_a) for j in at_b[e]]
        counts.update(links)
        found.append((len(ids_a), len(b), len(groups), links, sha(";".join("|".join(g) for g in groups))))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in found]


@pytest.mark.parametrize("sizes", [(4 << 20, 16 << 20), (3000, 3000), (1000, 9000)])
def test_alignment_equals_brute_force(spark, docs, library, sizes):
    got = sorted((tuple(r) for r in align_documents(Workspace(spark), docs, Q.tokenizer(BYTES), Q.tokenizer(PIECES), batch_bytes=sizes[0], block_bytes=sizes[1]).collect()), key=key)
    want = [(i, *x) for (i, _), x in zip(rows(), plain_alignment([t for _, t in rows()], library))]
    assert got == sorted(want, key=key)
    assert any(x[3] == 0 and x[0] is not None for x in want) and any(1 < x[3] < x[1] for x in want)


def test_alignment_of_an_empty_table(spark, docs):
    assert align_documents(Workspace(spark), docs.limit(0), Q.tokenizer(BYTES), Q.tokenizer(PIECES)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {tuple(r) for r in align_documents(Workspace(spark), nothing, Q.tokenizer(BYTES), Q.tokenizer(PIECES)).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


def test_pointer_jumping_on_long_chains():
    """Tokens of two bytes against tokens of two bytes shifted by one: a single component; then one that closes often."""
    n = 5000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    last_a, last_b = terminals(a, b)
    assert set(last_a) == set(last_b) == {len(b) - 1}
    r = np.random.default_rng(zlib.crc32(b"chain"))
    a, b = (np.unique(np.append(r.integers(1, 3000, 1500), 3000)) for _ in range(2))
    cuts = np.intersect1d(a, b)
    last_a, last_b = terminals(a, b)
    assert (b[last_a] == cuts[np.searchsorted(cuts, a)]).all() and (b[last_b] == cuts[np.searchsorted(cuts, b)]).all()
