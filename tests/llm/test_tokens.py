"""Packing, token files and token counts against the tokenizer libraries."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import byte_bpe, packing, repair, token_counts
from terralog.llm.queries import tokenizer_path
from terralog.session import scratch_path
from tests.llm import helpers as H

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def odd_rows():
    r = random.Random(9)
    letters = [*"ab Z's.,!\n\t  09²éßñ'漢　\xa0\x1c<|>", "<|endoftext|>", " the", "'ll", "ı", "😀", "\r\n", "▁", "<s>"]
    return H.doc_rows(H.odd_texts() + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)])


def test_encoder_equals_the_library():
    rows = odd_rows()
    texts = [r[1] or "" for r in rows]
    encoder = byte_bpe.UnitEncoder(tokenizer_path(BPE))
    assert encoder.cut
    encoder.words.size = 5  # generations turn over all the time
    assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.encode(texts)] == H.token_ids(texts)


def test_words_are_split_as_arrays_as_the_library_splits_them(monkeypatch):
    r = random.Random(4)
    parts = [*"a Zé9²'!×ªɏ\n\t\r  ", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'l", "'r", " '", "''", "  ", "\n\n", "漢", "\0"]
    texts = ["", "'", "'s", "'l", " 'll", "'sad", "a'll 's", "a  ", " \n", "\n b", "é's\t c"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    encoder, wanted = byte_bpe.UnitEncoder(tokenizer_path(BPE)), H.token_ids(texts)
    met, make = [], encoder.words.make
    encoder.words.make = lambda w: met.append(w) or make(w)
    assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.encode(texts)] == wanted
    assert len(met) == len(set(met)) and all(isinstance(w, bytes) for w in met)  # words stay arrays, and each is spelt once
    monkeypatch.setattr(byte_bpe, "TEXT_BYTES", 3)  # texts are cut before lone spaces, and groups end all the time
    assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.encode(texts)] == wanted


def check_packing(rows, pieces, most):
    ids = dict(zip((r[0] for r in rows), H.token_ids([r[1] for r in rows])))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids == H.packed(ids[p.doc_id][p.start : p.start + p.length]) and p.doc_tokens == len(ids[p.doc_id])
        of_doc[p.doc_id].append((p.start, p.length))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    for found, whole in [(of_doc[k], len(v)) for k, v in ids.items()] + [(v, None) for v in of_sequence.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= most and (at == most or at & (at - 1) == 0)


def test_packing(spark):
    rows = odd_rows()
    pieces = packing.packed_pieces(H.documents(spark, rows), tokenizer_path(BPE), 64).collect()
    check_packing(rows, pieces, 64)


def test_pack_prefers_the_lowest_cost():
    pieces, used = packing.pack([60, 50, 40, 30, 20], 100)
    assert used == 2 and sum(p[2] for p in pieces) == 200
    assert {p[3] for p in pieces if p[0] in (0, 1)} == {0, 1}  # the two longest lie apart
    assert packing.capacities(1000, 256) == [256, 256, 256, 128, 64, 32, 8]
    assert packing.attention_cost(200) > 2 * packing.attention_cost(100)


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(1)
    motifs = [r.integers(0, 500, 30) for _ in range(5)]
    ids = np.concatenate([motifs[k] for k in r.integers(0, 5, 400)] + [r.integers(0, 50000, 500), np.full(999, 7)]).astype(np.uint32)
    base, symbols, rules, lengths = repair.compress(ids)
    assert len(symbols) < len(ids) / 2 and len(rules) == len(lengths)
    assert repair.expand(symbols, base, rules, lengths).tolist() == ids.tolist()
    for _ in range(200):
        a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
        assert repair.ids_between(base, symbols, rules, lengths, a, b).tolist() == ids[a:b].tolist()
    for few in ([], [3], [3, 3], [0, 0, 0]):
        base, symbols, rules, lengths = repair.compress(np.array(few, np.uint32))
        assert repair.expand(symbols, base, rules, lengths).tolist() == few


def test_token_files_read_back_in_id_order(spark):
    rows = odd_rows()
    got = {r.doc_id: r for r in repair.token_file_digest(H.documents(spark, rows, 5), tokenizer_path(BPE)).collect()}
    at = 0
    for row, ids in zip(rows, H.token_ids([r[1] for r in rows])):
        r = got[row[0]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), H.crc(ids))
        at += len(ids)


def test_token_files_hold_repeated_and_null_ids(spark):
    rows = [(2, "b", "en", "s", 1), (None, "n", "en", "s", 1), (2, "b", "en", "s", 1), (1, None, None, None, None)]
    path = scratch_path(spark, "token-test")
    repair.write_token_files(H.documents(spark, rows), tokenizer_path(BPE), path)
    got = sorted(((r.start, r.doc_id, len(r.ids) // 4) for r in repair.read_token_files(spark, path).collect()))
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2)]


def test_token_counts(spark):
    import sentencepiece

    rows = odd_rows() + [(3, "repeated id", "en", "s", 1)]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    got = token_counts.token_counts(H.documents(spark, rows), tokenizer_path(PIECES), 100).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t, *_ in rows]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)


@pytest.mark.parametrize("operator", [lambda d: packing.packed_pieces(d, tokenizer_path(BPE)), lambda d: repair.token_file_digest(d, tokenizer_path(BPE)), lambda d: token_counts.token_counts(d, tokenizer_path(PIECES))])
def test_empty_table_and_clashing_columns(spark, operator):
    assert operator(H.documents(spark, [])).collect() == []
    docs = H.documents(spark, H.doc_rows(["one two", None])).withColumns({c: F.lit("x") for c in ("id", "body", "place", "word", "start", "ids")})
    assert sorted({r.doc_id for r in operator(docs).collect()}) == [0, 1]
