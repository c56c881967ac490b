import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bundlelens.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, start string, size int, k long"
ROWS = [(5, "Hello world, it's 42!", "x", "y", 1, 1), (2, None, None, None, None, None), (9, "", "", "", 0, 0), (2, "a § b §§ c", "", "", 0, 0), (None, "null key", "", "", 0, 0), (7, "é́ ﬁ  x y <|endoftext|>z", "", "", 0, 0), (8, "word " * 5000, "", "", 0, 0), (8, "word " * 5000, "", "", 0, 0), (1, "x" * 3000, "", "", 0, 0)]


def ids_of(text, end):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_tokenizer_equals_library_on_whole_texts(spark):
    t = tokens.WordTokenizer(PATH, cap=50)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [r[1] for r in ROWS]
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        for text, ids in zip(part, t.encode([None if x is None else x.encode() for x in part]), strict=True):
            assert np.frombuffer(ids, t.dtype).tolist() == ids_of(text, 0)[:-1]


def test_word_tokenizer_equals_library_on_odd_words():
    t, rng = tokens.WordTokenizer(PATH), random.Random(5)
    assert t.by_word
    letters = "abTWHJtehKZ'.,-1 \tÉéßİıſΣσςǅﬁ\u00a0\u2028" + "".join(map(chr, range(0x300, 0x345))) + "\u0327\u0328\u0331\u030c"
    for text in ["T\u0308 H\u0331 W\u030a J\u030c", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(20_000))]:
        assert np.frombuffer(t.encode([text.encode()])[0], t.dtype).tolist() == t.full.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_models_get_whole_texts():
    t = tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  words\n and T\u0308"
    assert not t.by_word
    assert np.frombuffer(t.encode([text.encode(), None])[0], t.dtype).tolist() == t.full.encode(text, add_special_tokens=False).ids


def test_records_round_trip_in_key_order(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    files = tokens.write_token_records(docs, "doc_id", "text", str(tmp_path / "out"), PATH, 2, roll_bytes=2000)
    got = sorted(tokens.record_digests(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(r[0]), crc(ids_of(r[1], 2))) for r in ROWS)
    back = {(r.start): r.ids for r in tokens.read_token_records(files).collect()}
    assert all(crc(back[r.start]) == r.ids_crc32 for r in got)
    assert files.count() > 1
    native = tokens.read_token_records(files).select("start", tokens.crc32_of("ids").alias("c")).collect()
    assert {r.start: r.c for r in native} == {r.start: r.ids_crc32 for r in got}
    path = files.first().path
    n = len(tokens.read_index(path))
    assert [i for i, _, _ in tokens.read_records(path, np.arange(n)[::-1])] == list(range(n))[::-1]


def test_damaged_record_raises():
    data = bytearray(tokens.frame(b"payload"))
    assert tokens.unframe(bytes(data), 0) == (b"payload", len(data))
    for at in (2, 9, 14):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokens.unframe(bytes(bad), 0)
    assert tokens.masked(struct.pack("<Q", 7)) != zlib.crc32(struct.pack("<Q", 7))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert tokens.record_digests(tokens.write_token_records(docs, "doc_id", "text", str(tmp_path / "out"), PATH, 2)).count() == 0
    assert packing.pack_documents(docs, "doc_id", "text", PATH, 0, 2048).count() == 0


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("per_task", [3, 50_000])
def test_packing_places_every_piece_once(spark, per_task):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    found = packing.pieces(docs, "doc_id", "text", PATH, 0, 64)
    got = packing.pack(found, 64, per_task=per_task, fan_in=2).collect()
    check_packing(got, 64)
    want = []
    for r in ROWS:
        ids = ids_of(r[1], 0)
        want += [(str(r[0]), p, a, len(ids[a : a + 64]), crc(ids[a : a + 64])) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_packing_is_tight_over_rounds(spark):
    rows = [(i, 0, 0, 1 + (i * 7919) % 2047, i) for i in range(3000)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, 2048, per_task=800, fan_in=4).collect()
    assert len(got) == 3000
    n = check_packing(got, 2048)
    assert n <= 1.03 * -(-sum(r[3] for r in rows) // 2048)


def test_sequences_hold_the_ids(spark):
    rows = [(i, "word " * (i * 13 % 90)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = packing.pack_documents(docs, "doc_id", "text", PATH, 0, 64)
    out = packing.sequences(docs, placed, "doc_id", "text", PATH, 0, 64).collect()
    assert sum(len(r.ids) for r in out) == sum(len(ids_of(t, 0)) for _, t in rows)
    assert all(len(r.ids) == sum(r.lengths) <= 64 for r in out)


def test_pieces_that_fit_nowhere_are_not_sent_up(spark, tmp_path, monkeypatch):
    rows = [(i, 0, 0, 1100 + i % 900, i) for i in range(2000)] + [(5000 + i, 0, 0, 10, i) for i in range(3)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "shared_dir", lambda *_: str(tmp_path / "packing"))
    got = packing.pack(found, 2048, per_task=200, fan_in=4).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    assert check_packing(got, 2048) == 2000
    late = [p for p in (tmp_path / "packing").glob("round=*") if p.name != "round=0"]
    assert sum(spark.read.parquet(str(p)).count() for p in late) <= 2 * 11
