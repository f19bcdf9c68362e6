"""Packing, token files and BPE against whole-text encoding by the tokenizers library; exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framewake.llm import bpe, packing, tokenfile
from framewake.llm.chunks import ChunkEncoder

from .helpers import documents, empty

BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    random.seed(0)
    pieces = ["a", "b", "'s", "'", " ", "  ", "\n", "1", "é", "é", "　", "\xa0", "\x1c", "!", "…", "<|endoftext|>", "<|startoftext|>", "T", "ing", "Σ", "İ", "ﬁ", "🙂", "_"]
    made = ["".join(random.choice(pieces) for _ in range(50)) for _ in range(400)]
    return made + ["".join(f" a{chr(c)}b{chr(c)} {chr(c)}!" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 256)]


@pytest.mark.parametrize("name, tokenizer", [("byte_bpe_50k.json", BYTE), ("word_bpe_49k.json", WORD)])
def test_chunks_give_the_ids_of_whole_texts(name, tokenizer):
    texts = odd_texts()
    ids, each = ChunkEncoder(public_tokenizers.path(name), remembered=50).encode(texts)
    ends = np.cumsum(each)
    assert all(ids[e - n : e].tolist() == ids_of(tokenizer, t) for t, n, e in zip(texts, each, ends, strict=True))


def test_pair_index_encodes_and_decodes_as_the_library():
    texts = odd_texts()
    encoder = bpe.IndexEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = ids_of(BYTE, text)
        assert ids.tolist() == want
        assert encoder.decode(ids) == BYTE.decode(want, skip_special_tokens=False)
    assert encoder.encode(["aaaaaaa", "aaaa aaaaa"])[0].tolist() == ids_of(BYTE, "aaaaaaa")


def test_bpe_query_rows(spark):
    docs = documents(spark)
    got = sorted(map(repr, bpe.encode_decode(docs).collect()))
    want = []
    for r in docs.collect():
        ids = ids_of(BYTE, r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a!r}, n_tokens={b}, ids_sha256={c!r}, decoded_sha256={d!r})" for a, b, c, d in want)
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_packing_places_each_id_once(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(docs).toPandas()
    for r in docs.collect():
        ids, at = [*ids_of(BYTE, r.text), 0], 0
        for p in pieces[pieces.doc_id == r.doc_id].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
    full = pieces.groupby("sequence_id").length.sum()
    assert (full < 1024).sum() <= docs.rdd.getNumPartitions() + 4  # one open sequence for each task
    assert packing.pack_documents(empty(spark)).count() == 0


def test_three_limits_hold_at_once():
    random.seed(1)
    packer = packing.VectorPacker(100, 4, 40)
    items = [(k, 0, random.randint(1, 60), 0, None) for k in range(500)]
    items = [(k, 0, n, random.randint(0, min(n, 40)), None) for k, _, n, _, _ in items]
    for i in items:
        packer.add(i)
    out = list(packer.pack(last=True))
    assert sorted(i[0] for s in out for i in s) == list(range(500))
    assert all(sum(i[2] for i in s) <= 100 and len(s) <= 4 and sum(i[3] for i in s) <= 40 for s in out)
    least = max(sum(i[2] for i in items) / 100, len(items) / 4, sum(i[3] for i in items) / 40)
    assert len(out) <= 1.15 * least + 1


@pytest.mark.parametrize("limits", [(1024, 256, 500), (100, 3, 1000), (64, 5, 20), (50, 256, 49)])
def test_a_cut_heeds_all_limits(limits):
    random.seed(sum(limits))
    ids = [np.arange(n, dtype="<u4") + 1000 * k for k, n in enumerate([600, 1, 2, 900, *[random.randint(1, 300) for _ in range(80)]])]
    packer = packing.VectorPacker(*limits, packing._cut)
    for k, x in enumerate(ids):
        packer.add((k, 0, len(x), len(x) - 1, x))
    out = list(packer.pack(last=True))
    for s in out:
        assert sum(p[2] for p in s) <= limits[0] and len(s) <= limits[1] and sum(p[3] for p in s) <= limits[2]
        assert all(len(p[4]) == p[2] and p[3] == p[2] - 1 for p in s)
    for k, x in enumerate(ids):
        pieces = sorted((p for s in out for p in s if p[0] == k), key=lambda p: p[1])
        assert np.array_equal(np.concatenate([p[4] for p in pieces]), x) and [p[1] for p in pieces] == [0, *np.cumsum([p[2] for p in pieces])[:-1].tolist()]


def test_conversations_are_packed_under_limits_that_bind(spark):
    from pyspark.sql import functions as F

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    n = F.length(F.coalesce("text", F.lit(""))) / 4 + 1
    talks = turns.groupBy("conv_id").agg(F.sum(n.cast("long")).alias("n"), F.sum(F.when(F.col("role") == "assistant", n.cast("long")).otherwise(0)).alias("loss")).cache()
    most = talks.agg(F.max("n"), F.max("loss")).first()
    for limits in ((most[0] * 2, 100, most[1] * 100), (most[0] * 100, 3, most[1] * 100), (most[0] * 100, 100, most[1])):
        got = packing.pack_examples(talks.coalesce(1), "conv_id", "n", "loss", *limits).toPandas()
        s = got.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"))
        assert len(got) == talks.count() == got.conv_id.nunique()
        full = [s.n.max() / limits[0], s.k.max() / limits[1], s.loss.max() / limits[2]]
        assert max(full) <= 1 and max(full) > 0.9  # the limit that is tight is nearly filled
        least = max(got.length.sum() / limits[0], len(got) / limits[1], got.loss_tokens.sum() / limits[2])
        assert len(s) <= 1.4 * least + 2


def test_memory_that_is_forgotten_changes_no_id():
    texts = odd_texts()[:200]
    for name, tokenizer in (("byte_bpe_50k.json", BYTE), ("word_bpe_49k.json", WORD)):
        for remembered, size in ((1, 1), (50, 1 << 20), (10**6, 2000)):
            encoder = ChunkEncoder(public_tokenizers.path(name), remembered, size)
            for k in range(0, 200, 20):
                ids, each = encoder.encode(texts[k : k + 20])
                assert ids.tolist() == [i for t in texts[k : k + 20] for i in ids_of(tokenizer, t)]
    index = bpe.IndexEncoder(public_tokenizers.path("byte_bpe_50k.json"), 30, 3000)
    for k in range(0, 200, 20):
        assert [x.tolist() for x in index.encode(texts[k : k + 20])] == [ids_of(BYTE, t) for t in texts[k : k + 20]]


def test_plain_words_go_to_the_model_alone():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = ChunkEncoder(public_tokenizers.path(name))
        assert encoder.plain is not None and encoder.mark is not None
        asked = []
        through = encoder._through_library
        encoder._through_library = lambda texts: asked.extend(texts) or through(texts)
        encoder.encode(["plain words über alles, it's 12 o'clock"])
        assert "plain" not in "".join(asked) and any("12" in x for x in asked)


def test_examples_are_packed_whole(spark):
    df = spark.createDataFrame([(k, 10 + k % 50, k % 30) for k in range(300)] + [(None, None, None), (7, 0, 0)], "id long, n long, loss long")
    got = packing.pack_examples(df, "id", "n", "loss", 128, 8, 64).toPandas()
    assert len(got) == 302
    s = got.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"))
    assert s.n.max() <= 128 and s.k.max() <= 8 and s.loss.max() <= 64
    with pytest.raises(Exception, match="exceeds the limits"):
        packing.pack_examples(spark.createDataFrame([(1, 500, 0)], "id long, n long, loss long"), "id", "n", "loss", 128, 8, 64).collect()


def test_token_files_hold_all_ids_in_order(spark):
    docs = documents(spark)
    got = tokenfile.token_files(docs, image_ids=200).toPandas()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    got = got.sort_values("start")
    ids = got.doc_id.astype(object).where(got.doc_id.notna(), None).tolist()
    assert [i for i in ids if i is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None) and ids[0] is None
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1].tolist()]
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array([*ids_of(WORD, r.text), 2], "<u4").tobytes())) for r in rows)
    assert sorted((-1 if i is None else int(i), c) for i, c in zip(ids, got.ids_crc32, strict=True)) == want
    assert tokenfile.token_files(empty(spark)).count() == 0


def test_elias_fano_selects_and_round_trips():
    random.seed(2)
    for values in ([], [0], [5], [0, 0, 0], list(range(2000)), sorted(random.randrange(10**9) for _ in range(3000)), [3] * 700 + [2**60], sorted(random.choice([1, 2, 10**6]) for _ in range(900))):
        e = tokenfile.EliasFano.of(np.array(values, np.uint64))
        e, _ = tokenfile.EliasFano.load(memoryview(e.dump()))
        assert e.all().tolist() == values
        assert [e.select(i) for i in range(len(values))] == values
    dense = tokenfile.EliasFano.of(np.arange(0, 4_000_000, 400, dtype=np.uint64))
    assert len(dense.dump()) < 10_000 * 1.6  # 12 bits a boundary, not 64


def test_images_are_checked():
    image = tokenfile.write_image(np.arange(10, dtype=np.uint32), np.array([4, 6]), [None, 9])
    f = tokenfile.TokenFile(image)
    assert len(f) == 2 and f.document(1).tolist() == [4, 5, 6, 7, 8, 9] and f.doc_ids() == [None, 9]
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.TokenFile(image[:-1] + b"\xff")
    assert tokenfile.TokenFile(tokenfile.write_image(np.array([70_000], np.uint32), np.array([1]), [-5])).document(0).tolist() == [70_000]
