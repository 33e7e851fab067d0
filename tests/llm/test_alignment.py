"""Alignment against whole-text encodings and a byte-by-byte alignment in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from captionloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spelled = {c: bytes([k]) for c, k in alignment.byte_spelling().items()}

    def one(text):
        """(n_a, n_b, groups string, list of links) of a whole text, without units."""
        if not text:
            return 0, 0, None, []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [a.id_to_token(i).encode() if i == 50256 else b"".join(spelled[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return 0, 0, None, []
        spans = []
        for ids, pieces in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, own = 0, []
            for i, p in zip(ids, pieces, strict=True):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, place = [], [0, 0]
        for e in ends:
            sides = []
            for side, own in enumerate(spans):
                ids = []
                while place[side] < len(own) and own[place[side]][1] <= e:
                    ids.append(str(own[place[side]][2]))
                    place[side] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        return len(ids_a), len(ids_b), groups, links

    return one


def expected(plain, texts):
    got = [plain(t) for t in texts]
    count = Counter(p for *_, links in got for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (n_a, n_b, len(groups or []), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in got
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    r = random.Random(3)
    bits = [" ", "  ", "   ", "\n", "\t", "\r\n", " \n ", " ", "　", " ", "᠎", "", "\x1c", "​", "the", "word", "don't", "'ll", "ähnlich", "日本語", "😀", "👩‍👩‍👧", "é", "ﬁ", "①", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "123", "4", "...", "!?", "\x00", "\x7f", "ß", "İ", "ǅ", ";\r", "{", "a" * 40, "٣", "क्षि", "᳐", "🮱", "𞤀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    return texts + [None, "", " ", "   ", "a▁b", "x▁ y", "▁", "word " * 50, "word " * 50, " lead", "trail ", "\n", "a\n b", "z" * 3000]


def test_equals_whole_texts(plain):
    texts = odd_texts()
    made = alignment.Aligner(A, B)
    for t, (numbers, digest, codes, counts) in zip(texts, made.align(texts), strict=True):
        n_a, n_b, groups, links = plain(t)
        assert (numbers, digest) == ([n_a, n_b, len(groups or []), len(links)], hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""), repr(t)
        assert Counter({(c // made.size_b, c % made.size_b): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)}) == Counter(links)


def test_forgetting_and_windows_change_nothing(plain, monkeypatch):
    texts = [t for t in odd_texts() if t][:300]
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "WINDOW", 7)
    monkeypatch.setattr(alignment.windows, "__defaults__", (7,))
    for got, want in zip(alignment.Aligner(A, B, keep=5).align(texts), whole, strict=True):
        assert got[:2] == want[:2]
        assert np.array_equal(got[2], want[2]) and np.array_equal(got[3], want[3])


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_query_equals_plain_python(spark, docs, rows, plain, bound):
    got = alignment.alignment_digests(docs, A, B, bound).collect()
    want = expected(plain, [r[1] for r in rows])
    assert sorted((repr(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted((repr(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_clashing_columns_and_empty_table(spark, empty, plain):
    df = spark.createDataFrame([(1, "a b", 5, 6, "x"), (2, "a▁", 5, 6, "x"), (None, None, 5, 6, "x")], "doc_id long, text string, row int, n_a int, `links.a` string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digests(df, A, B).collect()}
    assert got == dict(zip([1, 2, None], expected(plain, ["a b", "a▁", None]), strict=True))
    assert alignment.alignment_digests(empty, A, B).count() == 0
