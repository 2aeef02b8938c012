"""Alignment of two tokenizers against a plain version on whole texts; the perfect hash; groups of slices, salts and small memory."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from polyglossa.llm import crosstoken as ct

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(4)
    words = ["".join(r.choices("abcdeéß漢😀'-.,0123ABC", k=r.randint(1, 9))) for _ in range(150)] + ["the", "of", "don't", "<|endoftext|>", "<s>", "<0x41>", "\r\n;\r"]
    prose = [" ".join(r.choices(words, k=r.randint(5, 120))) for _ in range(30)]
    odd = [None, "", " ", "x", "  two  spaces ", "tab\t and\n\n lines \n", "a ▁ b", "▁", "\x00\x1c \x85 \xa0  x y", "a\x1c b　 c", "é́ ﬁ ​", "=" * 3000, "漢" * 200, "end\r", " lead", "a\t  b", "don't  stop 's"]
    return [*odd, *prose, prose[0], prose[0], prose[1] + " " + prose[2]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, 1, "g") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, n_a int, groups string").repartition(4).cache()


def plain_groups(a, b, bytes_a, bytes_b, text):
    """The contract, on the whole text."""
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(bytes_a[i] for i in ids_a) != (" " + text).encode() or b"".join(bytes_b(i) for i in ids_b) != (" " + text).encode():
        return []
    ends = []
    for ids, of in ((ids_a, lambda i: bytes_a[i]), (ids_b, bytes_b)):
        ends.append(np.cumsum([len(of(i)) for i in ids]).tolist())
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((ids_a[i:to_a], ids_b[j:to_b]))
        i, j = to_a, to_b
    return out


@pytest.fixture(scope="module")
def wanted(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a = {}
    table = {c: x for c, x in ct._byte_letters().items()}
    for token, i in a.get_vocab().items():
        bytes_a[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows = [(r.doc_id, plain_groups(a, b, bytes_a, bytes_b, r.text)) for r in docs.collect()]
    links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for _, groups in rows]
    count = collections.Counter(p for found in links for p in set(found))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, groups), found in zip(rows, links):
        s = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        sums = sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found), *sums, hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(map(str, out))


def test_whole(docs, wanted):
    found = ct.align_documents(docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == wanted
    assert not ct.align_documents(docs.limit(0), A, B).count()


def test_small_memory(docs, wanted):
    """Several groups of slices, salts summed as a tree, tasks that write and forget all the time."""
    found = ct.align_documents(docs, A, B, slice_pairs=90, least_slices=1, group_pairs=250, salt_rows=20, fan=2, most_pairs=50, most_chunks=2000, with_groups=True).collect()
    assert sorted(str(tuple(r)[:-1]) for r in found) == wanted
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found if r.groups)


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        h = ct.PerfectHash.read(*ct.PerfectHash.of(keys).parts())
        assert sorted(h(keys).tolist()) == list(range(len(keys)))
        assert len(h.words) * 64 <= 3.2 * len(keys) + 64 * ct.LEVELS
    few = ct.PerfectHash.of(np.array([5, 6, 7]))
    few.rest = np.array([9])  # a key left after the last level
    assert few(np.array([9])).tolist() == [3]


def test_chunks_are_exact(docs):
    aligner = ct.loaded(A, B)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    r = random.Random(8)
    made = ["".join(r.choice([*spaces, "a", "b.", "'s", "1", "é", " ", " "]) for _ in range(40)) for _ in range(300)]
    for t in [*made, *filter(None, texts())]:
        chunks = aligner.chunks(t)
        whole = aligner.a.encode(" " + t, add_special_tokens=False).ids
        assert "".join(chunks) == " " + t and [i for c in chunks for i in aligner.a.encode(c, add_special_tokens=False).ids] == whole
        assert [i for c in chunks for i in aligner.b.encode(c[1:])] == aligner.b.encode(t)


def test_byte_letters():
    assert sorted(ct._byte_letters().values()) == list(range(256))


def test_wide_groups(monkeypatch):
    """Links of long groups, counted by distinct ids, are those of the plain product."""
    aligner, t = ct.loaded(A, B), [" " + "=" * 900 + "-" * 7, " " + "漢字" * 50, " ß"]
    plain = [x for f in aligner.align(t, True) for x in f[2:]]
    monkeypatch.setattr(ct, "WIDE", 1)
    assert all(np.array_equal(x, y) for x, y in zip(plain, [x for f in aligner.align(t, True) for x in f[2:]]))


def test_ranks_are_the_same(monkeypatch):
    """Encoding by ranks gives the ids of the library that the file is for, special tokens' strings as plain text."""
    aligner, r = ct.loaded(A, B), random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzéßø漢字😀0123456789'.,;:!?<|>_-=\"#\t\n\r \x00\x85\xa0\u3000\u200b"
    t = ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(4000)] + [x for x in texts() if x] + ["<|endoftext|> don't I'LL", "a" * 9000, " " * 5000 + "x"]
    assert aligner.quick is not None
    quick = [x for x in (aligner.ids_a([y])[0] for y in t)]
    monkeypatch.setattr(ct, "RANKED", -1)
    assert quick == [aligner.ids_a([y])[0] for y in t] == [aligner.a.encode(y, add_special_tokens=False).ids for y in t]
