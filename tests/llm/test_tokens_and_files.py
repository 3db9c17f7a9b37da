import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import packing, repair, tokens
from siftline.llm.bytesops import text_chunks
from siftline.llm.shared import new_path
from siftline.llm.tokens import default_vocabulary, encoder

from .helpers import ROWS, documents, tuples


def ids_of(text, end):
    return [*encoder(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PIECES = ["a", "B", "the", "ing", "é", "ß", "×", "÷", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'re", ".", ",", "%%%", "…", "—", "’", "\u00a0", "\u2009", "\u3000", "\x85", "\x00", "\x1c", "слово", "日本", "1", "23", "½", "ª", "\u0301", "😀"]


def encoded(texts, size=1 << 20, most_parts=400_000):
    own, out = tokens.Encoder(default_vocabulary(), most_parts), []
    for _, _, buf, offsets in text_chunks(pa.array(texts), size):
        ids, at = own.encode(buf, offsets, 2)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def test_encoding_by_parts_is_that_of_the_whole_text(monkeypatch):
    random.seed(3)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    texts += ["I'll don't we've  x", "word. word., word.,' 3.5.", "", " ", "\n"]
    want = [ids_of(t, 2) for t in texts]
    assert encoded(texts) == want
    assert encoded(["the <|endoftext|> end", "a<|endoftext|>."]) == [ids_of(t, 2) for t in ("the <|endoftext|> end", "a<|endoftext|>.")]
    monkeypatch.setattr(tokens, "BLOCK", 64)  # texts over many blocks, and a table that forgets
    assert encoded(texts, 3000, 300) == want


def test_other_vocabularies_are_encoded_by_the_library():
    import public_tokenizers

    own = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 1000)
    assert not own.splits
    text = "Hello, World! don't"
    _, _, buf, offsets = next(text_chunks(pa.array([text])))
    assert own.encode(buf, offsets, 7)[0].tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 7]


def pairs_of(symbols, starts):
    first = set(starts.tolist())
    return Counter((symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if i + 1 not in first)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=0, max_size=60), min_size=1, max_size=12))
def test_grammar_round_trip(docs):
    ids = np.array([x for d in docs for x in [*d, 2]], dtype=np.int32)
    n = np.array([len(d) + 1 for d in docs])
    symbols, starts, rules, lengths = repair.compress(ids, np.cumsum(n) - n, least=2)
    assert max(pairs_of(symbols, starts).values(), default=0) < 3  # two that overlap may be left
    assert repair.expand(symbols, rules, lengths).tolist() == ids.tolist()
    shard = repair.Shard(np.diff(np.append(starts, len(symbols))), rules.astype("<i4").tobytes(), lengths.astype("<i4").tobytes(), repair._pack(symbols))
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == [*d, 2]
        assert [shard.token(k, i) for i in range(len(d) + 1)] == [*d, 2]


def test_grammar_is_smaller():
    ids = np.tile(np.arange(50, dtype=np.int32), 400)
    symbols, _, rules, _ = repair.compress(ids, np.array([0]))
    assert len(symbols) + 2 * len(rules) < len(ids) / 10


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.3, 60_000) % 3000).astype(np.int32)
    symbols, starts, rules, lengths = repair.compress(ids, np.arange(0, len(ids), 500))
    counts = pairs_of(symbols, starts)
    assert max(n for (a, b), n in counts.items() if a != b) < repair.LEAST
    assert repair.expand(symbols, rules, lengths).tolist() == ids.tolist()


def test_ids_that_a_symbol_cannot_hold_are_refused():
    with pytest.raises(ValueError):
        repair.compress(np.array([1, repair.FIRST_RULE], np.int32), np.array([0]))


def test_token_files(spark):
    docs = documents(spark)
    path = new_path(spark, "test")
    repair.write_token_files(docs, path, end=2, shard_ids=5000)
    got = sorted(repair.read_digests(spark, path).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    start = 0
    by_id = {}
    for d, t in ROWS:
        by_id.setdefault(d, []).append(crc(ids_of(t, 2)))
    for r in got:
        assert r.start == start and r.ids_crc32 in by_id[r.doc_id]
        start += r.n_tokens
    assert {r.doc_id: r.ids for r in repair.read_documents(spark, path, [4, -3]).collect()} == {4: ids_of("Hello World", 2), -3: ids_of(dict(ROWS)[-3], 2)}


def test_distinct_parts_of_a_batch_are_looked_up_once(monkeypatch):
    random.seed(8)
    texts = [" ".join(random.choice(["same", "words", "again", f"n{i}"]) for _ in range(30)) for i in range(200)] + [None]
    asked, own = [], tokens.Encoder._ids_of_block
    monkeypatch.setattr(tokens.Encoder, "_ids_of_block", lambda self, *a: (asked.append(len(a[1])), own(self, *a))[1])
    monkeypatch.setattr(repair, "CHUNK", 1 << 10)
    monkeypatch.setattr(repair, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batches = [pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]
    rows = [r for b in repair._build(default_vocabulary(), 2, 1000)(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    assert len(asked) == 1 and len(rows) > 5  # shards still end behind chunks
    got = [s.document(k).tolist() for r in rows for s in [repair.Shard(r["doc_symbols"], r["rules"], r["rule_lengths"], r["symbols"])] for k in range(len(r["doc_ids"]))]
    assert got == [ids_of(t, 2) for t in texts] and sum(r["n_tokens"] for r in rows) == sum(map(len, got))


def test_no_documents(spark):
    empty = documents(spark, [])
    assert repair.token_files(empty).collect() == []
    assert packing.pack_documents(empty).collect() == []


def test_tree_is_first_fit():
    random.seed(5)
    sizes = sorted((random.randint(1, 100) for _ in range(500)), reverse=True)
    got, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
    room: list[int] = []
    for n, s, o in zip(sizes, got.tolist(), offsets.tolist()):
        want = next((i for i, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(100)
        assert (s, o) == (want, 100 - room[want])
        room[want] -= n
    with pytest.raises(ValueError):
        packing.CapacityTree(1, 4).place(5)


def test_packing_keeps_every_id_once(spark):
    pieces = packing.pack_documents(documents(spark), group_pieces=4).collect()
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 <= packing.CAPACITY and p.ids_crc32 == zlib.crc32(p.ids)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    long = sorted((p.start, p.ids) for p in pieces if p.doc_id == 9)
    assert np.frombuffer(b"".join(x for _, x in long), "<u4").tolist() == ids_of("word " * 30000, 1)
    total = sum(len(ids_of(t, 1)) for _, t in ROWS)
    assert sum(p.length for p in pieces) == total
    assert len(tuples(packing.pack_documents(documents(spark), with_ids=False), "doc_id", "start")) == len(pieces)


def test_packing_keeps_ids_beside_null(spark):
    rows = [(None, "a b"), ((1 << 53) + 1, "a b"), ((1 << 62) + 3, None), (5, "same text")] + [(5, "same text")] * 40
    pieces = packing.pack_documents(documents(spark, rows), group_pieces=4, with_ids=False).collect()
    assert Counter(p.doc_id for p in pieces) == Counter(d for d, _ in rows)
    assert len({p.sequence_id >> 32 for p in pieces if p.doc_id == 5}) > 4  # repeated rows are dealt to many groups


def test_groups_are_bounded_by_pieces(spark):
    docs = documents(spark, [(i, "word " * 40_000) for i in range(4)])
    pieces = packing.pack_documents(docs, group_pieces=8, with_ids=False).collect()
    sizes = Counter(p.sequence_id >> 32 for p in pieces)
    assert len(pieces) == 4 * 20 and max(sizes.values()) <= 24
