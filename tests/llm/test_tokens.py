"""Tokenizers, counts and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from docweave.llm import bpe, packing, token_counts
from docweave.llm.columnar import blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = " \n\t 　 \x1c\x85abeé1'#日😀.,"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return [*texts, "", None, " ", "a" * 900, "ab" * 400, "<|endoftext|> x<|endoftext|>", "don't I'LL", "\r\n \r\n", "x  y \n z"]


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_merge_replay(odd, corpus, reference_bpe):
    own = bpe.BpeCodec(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    texts = odd + [t for _, t in corpus]
    got = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string()), 4000):
        ids, ends, _, _ = own.encode_block(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    assert got == [reference_bpe.encode_ordinary(t or "") for t in texts]
    assert [own.decode(ids) for ids in got] == [(t or "").encode() for t in texts]


def test_both_replays_where_ranks_go_back():
    rng = random.Random(11)
    for _ in range(60):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 290:
            tokens.add(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))))
        order = sorted(tokens - {bytes([i]) for i in range(256)}, key=lambda _: rng.random())
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        reference = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(300)]
        replay = bpe.MergeReplay(ranks)
        want = [reference.encode_ordinary(w.decode()) if w not in ranks else [ranks[w]] for w in words]
        assert [replay.replay_one(w) if w not in ranks else [ranks[w]] for w in words] == want
        assert [ids if w not in ranks else [ranks[w]] for w, ids in zip(words, replay.encode(words), strict=True)] == want


def test_op2_rows(docs, corpus, empty, reference_bpe):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in corpus:
        ids = reference_bpe.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN, with_ids=True).count() == 0


def unigram():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    vocab = [(p.piece if p.type in (1, 2, 6) else f"<<{i}>>", p.score if p.type == 1 else -1e9) for i, p in enumerate(model.pieces)]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="never")
    return t


def test_counts(odd, docs, corpus, empty):
    reference, own = unigram(), token_counts.counter(PIECES)
    texts = odd + [t for _, t in corpus]
    got = np.concatenate([own.counts(data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.string()), 4000)]).tolist()
    assert got == [len(e.ids) for e in reference.encode_batch([t or "" for t in texts])]
    rows = {(r.doc_id, r.n_chars, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert rows == {(i, len(t or ""), len(reference.encode(t or "").ids)) for i, t in corpus}
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_op5_counts_runs_of_spaces_whole(odd, corpus, spark, tmp_path):
    """The registered query, against the public tokenizer without a split."""
    from docweave.llm import queries

    reference = unigram()
    reference.pre_tokenizer = None
    rng = random.Random(4)
    texts = odd + [t for _, t in corpus] + ["a" + " " * 16 + "b", "if x:\n    return y", "  a", "a▁ ▁b", "▁  a", " " * 70, "\n  \n"]
    texts += ["".join(rng.choice(["  ", " ", "\n", "▁", "a", "the", "é", "x:", "    "]) for _ in range(rng.randint(1, 25))) for _ in range(1000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    want = [len(e.ids) for e in reference.encode_batch([t or "" for t in texts])]
    assert [got[i] for i in range(len(texts))] == want


def test_counts_ties_and_unknown_runs():
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "aab": -3.0, "ba": -1.5, "▁": -1.0}
    for bytes_for_unknown in (False, True):
        own = token_counts.CountingViterbi(pieces, bytes_for_unknown)
        vocab = [("<unk>", 0.0), *pieces.items()] + [(f"<0x{i:02X}>", -9.0) for i in range(256)] * bytes_for_unknown
        low = min(s for _, s in vocab)
        own.unknown = low - token_counts.UNKNOWN_PENALTY
        reference = Tokenizer(models.Unigram(vocab, 0, bytes_for_unknown))
        rng = random.Random(2)
        for _ in range(400):
            t = "".join(rng.choice("ababzéx") for _ in range(rng.randint(1, 12)))
            assert own.count(t) == len(reference.encode(t).ids), t


def check_packing(rows, corpus, size, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(t or "")
    for i, some in texts.items():
        want = []
        for t in some:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
            want += [(a, min(size, len(ids) - a), zlib.crc32(ids[a : a + size].tobytes()), len(ids)) for a in range(0, len(ids), size)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == sorted(want)
    return by_sequence


def test_packing(docs, corpus, empty):
    tokenizer = Tokenizer.from_file(JSON)
    odd = [*corpus, (999, "a<|endoftext|> b")]
    extra = docs.sparkSession.createDataFrame([odd[-1]], "doc_id long, text string")
    rows = packing.pack_documents(docs.select("doc_id", "text").unionByName(extra), JSON, public_tokenizers.PATTERN).collect()
    sequences = check_packing(rows, odd, 2048, tokenizer)
    total = sum(r.length for r in rows)
    padding = sum(2048 - n for n in (sum(r.length for r in s) for s in sequences.values()) if n & (n - 1))
    assert padding <= 2047 + 0.02 * total
    small = packing.pack_documents(docs, JSON, public_tokenizers.PATTERN, size=100, with_ids=True).collect()
    check_packing(small, corpus, 100, tokenizer)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in small)
    assert packing.pack_documents(empty, JSON, public_tokenizers.PATTERN).count() == 0


def test_places_are_whole_packs():
    """Every rank of every length has a place of its own, gapless in its pack, as the patterns say."""
    histogram = {1: 900, 2: 30, 3: 77, 5: 20, 7: 41, 10: 3, 90: 5, 100: 2}
    key, first, packs, offset = packing.places(packing.shortest_pack_first(histogram, 100))
    filled = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            run = int(np.searchsorted(key, length << 44 | rank, "right")) - 1
            turn, pack = divmod((length << 44 | rank) - int(key[run]), int(packs[run]))
            filled[int(first[run]) + pack].append((int(offset[run]) + turn * length, length))
    for pieces in filled.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 100
    assert len(filled) == -(-sum(k * n for k, n in histogram.items()) // 100)


def test_shortest_pack_first():
    packs = packing.shortest_pack_first({7: 2, 4: 1, 3: 3, 1: 4}, 10)
    placed = defaultdict(int)
    for n, pattern in packs:
        assert sum(pattern) <= 10
        for length in pattern:
            placed[length] += n
    assert dict(placed) == {7: 2, 4: 1, 3: 3, 1: 4}
    assert packing.shortest_pack_first({10: 10**12, 1: 10**12}, 10) and packing.shortest_pack_first({}, 10) == []


def test_words_of_equal_sums_and_texts_over_a_block(reference_bpe):
    """Two words that collide under any polynomial hash modulo 2 ** 64, and texts of over BLOCK bytes, each in one go."""
    from docweave.llm.columnar import BLOCK
    from tests.llm.test_dedup import morse

    texts = [morse(n, *x) for n in (1024, 4096) for x in ("ab", "ba")]
    texts += ["lorem ipsum, dolor! " * (BLOCK // 18), "", "é日 x1 " * (BLOCK // 7) + morse(1024, "b", "a")]
    own = bpe.BpeCodec(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    packer = packing.SegmentTokenizer(JSON, public_tokenizers.PATTERN)
    exact = Tokenizer.from_file(JSON)
    pieces, by_bytes = token_counts.read_pieces(open(PIECES, "rb").read())
    counter = token_counts.CountingViterbi(pieces, by_bytes, whole_runs=True)
    at = 0
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, ends, _, _ = own.encode_block(data, offsets)
        packed, packed_ends = packer.encode_block(data, offsets)
        counts = counter.counts(data, offsets)
        for i in range(len(offsets) - 1):
            t = texts[at]
            assert ids[ends[i] : ends[i + 1]].tolist() == reference_bpe.encode_ordinary(t)
            if len(t) < 10_000:
                assert packed[packed_ends[i] : packed_ends[i + 1]].tolist() == exact.encode(t, add_special_tokens=False).ids
                assert counts[i] == (counter.count(token_counts.MARK + t) if t else 0)
            at += 1
    assert at == len(texts)


def test_segments_whose_hashes_collide(monkeypatch):
    """With a hash of three values every lookup collides; codes still follow the bytes."""
    from docweave.llm import segments

    monkeypatch.setattr(segments, "chained", lambda state, value: (state + value) % np.uint64(3))
    seen = {}
    table = segments.Segments(segments.space_starts, lambda new, first: np.array([seen.setdefault(x, len(seen)) for x in new], np.int64))
    rng = random.Random(2)
    for _ in range(4):
        text = " ".join(rng.choice(["a", "b", "cc", "d" * 30, "e" * 40, "f" * 2000]) for _ in range(200)).encode()
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        codes, _ = table.codes_of(data, offsets)
        start = segments.space_starts(data, offsets)
        assert [seen[text[a:b]] for a, b in zip(start, [*start[1:], len(text)], strict=True)] == codes.tolist()
