import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberlog.llm import packing, pieces, tokens

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed=3, n=60):
    r = random.Random(seed)
    odd = [" ", "　", "́", "é", "ß", "İ", "Σ", "ς", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "▁", "😀", "漢字", "\n", "\r\n", "\t", "  ", "    ", "'s", "it's", "12345", "...", "�", "\x1c", "\x85", "ﬁ", "한국어", "עברית"]
    out = ["".join(r.choice([" ", "", "\n"]) + (r.choice(odd) if r.random() < 0.3 else "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCéüñ") for _ in range(r.randint(1, 12)))) for _ in range(r.randint(0, 120))) for _ in range(n)]
    return [*out, None, "", " ", "\n", "a", " a", "a ", "x" * 3000, "ab " * 1500, "é" * 700, "́a"]


def test_word_tokenizer_like_library():
    tk = Tokenizer.from_file(WORDS)
    t = texts()
    for lot in (t, t[::-1], t * 2):
        flat, sizes = (enc := tokens.WordTokenizer(WORDS))(pa.array(lot))
        want = [tk.encode(x or "", add_special_tokens=False).ids for x in lot]
        assert sizes.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]
        enc.cache.bytes = 1 << 40
        assert enc(pa.array(lot))[0].tolist() == flat.tolist()


def test_codec_like_library():
    codec = pieces.Codec(PIECES)
    t = [x or "" for x in texts(5, 150)]
    want = codec.v.library.encode(t)
    flat, sizes = codec.encode(t)
    got = np.split(flat, np.cumsum(sizes)[:-1])
    for x, g, w in zip(t, got, want, strict=True):
        assert g.tolist() == w, x
    assert [d.decode() for d in codec.decode(flat, sizes)] == [codec.v.library.decode(w) for w in want]
    for w in ("▁thequick", "▁▁▁ab", "▁" + "ab" * 99):
        assert codec._slow(w) == codec.v.library.encode(w[1:])


def spelled(text):
    library = pieces.Codec(PIECES).v.library
    return library.decode(library.encode(text or ""))


def test_differences_raise():
    codec = pieces.Codec(PIECES)
    t = ["one river", "", "two  stones"]
    flat, sizes = codec.encode(t)
    decoded = codec.decode(flat, sizes)
    names = pa.array([4, 5, 6])
    pieces.verify(codec.v.library, names, t, flat, sizes, decoded)
    wrong = flat.copy()
    wrong[-1] += 1
    with pytest.raises(ValueError, match="document 6"):
        pieces.verify(codec.v.library, names, t, wrong, sizes, decoded)
    with pytest.raises(ValueError, match="document 4"):
        pieces.verify(codec.v.library, names, t, flat, sizes, [b"One river", *decoded[1:]])


def test_every_decoded_text_is_compared():
    codec = pieces.Codec(PIECES)
    t = [x or "" for x in texts(13, 12)] + [" a", "  a", " ", ""]
    flat, sizes = codec.encode(t)
    decoded = codec.decode(flat, sizes)
    names = pa.array(range(100, 100 + len(t)))
    pieces.verify(codec.v.library, names, t, flat, sizes, decoded)
    for k in range(len(t)):
        with pytest.raises(ValueError, match=f"document {100 + k} "):
            pieces.verify(codec.v.library, names, t, flat, sizes, [*decoded[:k], decoded[k] + b"x", *decoded[k + 1 :]])
        pieces.verify(codec.v.library, names[k : k + 1], t[k : k + 1], flat[sizes[:k].sum() : sizes[: k + 1].sum()], sizes[k : k + 1], decoded[k : k + 1])


def test_piece_codes(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts(9, 20))] + [(None, "null id", "x"), (2, "again", "y")]
    out = pieces.piece_codes(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PIECES, keep=True).collect()
    assert len(out) == len(rows) and [r.decoded for r in out if r.doc_id == 2] == [spelled(rows[2][1]), "again"]
    assert {r.n_tokens for r in out if r.doc_id == 20} == {2}
    assert pieces.piece_codes(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_knapsack_and_columns():
    value, worth = np.array([3.0, 4.0, 5.5]), packing.knapsack(np.array([3.0, 4.0, 5.5]), np.array([3, 4, 5]), 12)
    assert worth[0] == pytest.approx(max(3 * a + 4 * b + 5.5 * c for a in range(5) for b in range(4) for c in range(3) if 3 * a + 4 * b + 5 * c <= 12))
    assert value @ worth[1] == pytest.approx(worth[0])
    size, demand = np.array([3, 5, 7]), np.array([100, 70, 40])
    columns, x = packing.column_generation(size, demand.astype(float), 12)
    assert np.allclose(columns @ x, demand) and x.sum() <= (size @ demand) / 12 * 1.1
    histogram = {c: random.Random(c).randint(0, 50) for c in range(1, 129)}
    plan = packing.plan(histogram)
    assert {c: n for c, n in histogram.items() if n} == {c: s for c in range(1, 129) if (s := sum(k * col.get(c, 0) for k, col in plan))}
    assert all(sum(c * n for c, n in col.items()) <= 128 for _, col in plan)


def check_pack(spark, rows):
    tk = Tokenizer.from_file(WORDS)
    got = packing.piece_digest(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS)).collect()
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    of, seq = {}, {}
    for p in got:
        of.setdefault(p.doc_id, []).append(p)
        seq.setdefault(p.sequence_id, []).append(p)
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id]) and p.length > 0
    assert set(of) == set(want)
    for i, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(want[i])
    padding = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_pack(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["the", "of", "lorem", "ipsum", "banana"]) for _ in range(int(r.paretovariate(0.6)) % 6000))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "of " * 2047), (1003, "of " * 2048), (1004, "of " * 8192)]
    check_pack(spark, rows)
    monkeypatch.setattr(packing, "LOT", 3)
    check_pack(spark, rows[:120])
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_pack_ignores_other_columns(spark):
    rows = [(k, "the river " * k) for k in range(8)]
    df = spark.createDataFrame([(*r, "u", 5, "c", 1.0, "i") for r in rows], "doc_id long, text string, uid string, pid long, class string, rank double, ids string")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda d: sorted(map(tuple, packing.piece_digest(packing.pack(d, WORDS)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert [x[0] for x in digest(df)] and {x[0]: x[4] for x in digest(df)} == {x[0]: x[4] for x in digest(plain)}


def test_count_tokens(spark, tmp_path):
    r = np.random.default_rng(1)
    for name, ids in (("a.bin", r.integers(0, 4, 999)), ("b.bin", np.array([7] * 50)), ("c.bin", np.array([3])), ("d.bin", np.array([1, 2])), ("e.bin", np.array([1, 3, 3])), ("f.bin", np.zeros(0)), ("g.bin", np.array([3] * 30))):
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    got = sorted(map(tuple, tokens.count_tokens(spark, f"file://{tmp_path}", 3, block_bytes=16).collect()))
    want = []
    for f in sorted(tmp_path.glob("*.bin")):
        ids, at, k = np.frombuffer(f.read_bytes(), "<u2").tolist(), 0, 0
        while 3 in ids[at:]:
            end = ids.index(3, at)
            want.append((f.name, k, at, end - at, True))
            at, k = end + 1, k + 1
        if at < len(ids):
            want.append((f.name, k, at, len(ids) - at, False))
    assert got == sorted(want)


def test_token_counts(spark):
    tk = Tokenizer.from_file(WORDS)
    tk.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(texts(11, 30))] + [(None, "x"), (4, "twice"), (4, "twice")]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 49407).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), WORDS, 49407).count() == 0
