from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from skyledger.llm.chat import ChatTemplate, assemble, chat_digests, format_chats
from skyledger.llm.pieces import ByteLevelEncoder, FieldCounter, load_tokenizer
from skyledger.llm.token_counts import chunk_edges, splice, token_counts
from skyledger.llm.token_store import read_document, read_store, store_digests, write_store

from .cases import document_rows, documents, nothing, prose

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    bits = ["a", "é", "İ", "ς", "Σ", " ", "\n", "\t", "'s", "'", "1", "<|endoftext|>", "\x1c", "́", "字", ".", ",", "Foo", "\r", "ſ", "가", "ᆨ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library():
    texts = odd_texts(3000) + [prose(200, k) for k in range(5)]
    words, bytes_ = load_tokenizer(WORDS), load_tokenizer(BYTES)
    assert FieldCounter(WORDS).count(texts) == [len(e) for e in words.encode_batch(texts, add_special_tokens=False)]
    ids = [np.array(e.ids, "<u2").tobytes() for e in bytes_.encode_batch(texts, add_special_tokens=False)]
    small = ByteLevelEncoder(BYTES)
    small.first.age = small.rest.age = 7  # turns over all the time
    assert small.encode(texts) == ByteLevelEncoder(BYTES).encode(texts) == ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_spliced_chunks_equal_the_whole(path):
    tok = load_tokenizer(path)
    spliced = 0
    for text in [*("".join(odd_texts(60)[k::3]) for k in range(3)), prose(900, 4), "字각" * 300]:
        step, overlap = 90, 70
        spans = range(0, max(1, len(text) - overlap), step)
        chunks = [
            chunk_edges(tok, text[a : a + step + overlap], a, overlap, a == 0, i + 1 == len(spans)) for i, a in enumerate(spans)
        ]
        got = splice(chunks)
        if got is not None:
            spliced += 1
            assert got == len(tok.encode(text, add_special_tokens=False))
    assert spliced


def test_token_counts(spark):
    df = documents(spark)
    tok = load_tokenizer(WORDS)
    want = Counter()
    for i, text, *_ in document_rows():
        n = len(tok.encode(text or "", add_special_tokens=False))
        want[(i, len((text or "").encode()), n, n > 2048)] += 1
    for chunk, overlap in ((1 << 15, 256), (500, 60)):
        got = token_counts(df, WORDS, chunk_chars=chunk, overlap_chars=overlap)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert token_counts(nothing(df), WORDS).count() == 0


def test_token_store(spark, tmp_path):
    df = documents(spark)
    tok = load_tokenizer(BYTES)
    rows = sorted(document_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    encoded = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    folder = str(tmp_path / "store")
    write_store(df, folder, BYTES, end_id=2)
    start, want = 0, []
    for i, ids in encoded:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in store_digests(spark, folder).orderBy("start").collect()]
    assert [r[1:3] for r in got] == [w[1:3] for w in want] and Counter(got) == Counter(want)
    whole = {r["start"]: np.frombuffer(r["ids"], "<u2").tolist() for r in read_store(spark, folder).collect()}
    assert [whole[w[1]] for w in want] == [ids for _, ids in encoded]
    assert read_document(spark, folder, 3) == [ids for i, ids in encoded if i == 3]
    assert read_document(spark, folder, 999) == []
    empty = str(tmp_path / "empty")
    write_store(nothing(df), empty, BYTES, end_id=2)
    assert store_digests(spark, empty).count() == 0


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "Be \x1bkind."), (1, 1, "user", said), (1, 2, "assistant", said + " <|turn|><|done|>"), (1, 3, "assistant", None),
        (2, 0, None, "no role"), (None, 0, "assistant", "lost"), (None, None, "user", ""), (3, 0, "assistant", "twice"),
        (3, 0, "assistant", "twice"), (4, 0, "<|says|>", prose(3000, 8)), (4, 1, "assistant", prose(3000, 9)), (5, 0, "user", "only"),
    ]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, block string, ids string")
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = [r[3] or "" for r in turns if r[2] == "assistant"]
        want[conv] = (len(turns), sha(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns), len("".join(loss)), sha(loss))
    for block in (1 << 16, 50):
        blocks = format_chats(df, BYTES, block_tokens=block).cache()
        assert (blocks.groupBy("conv_id").count().filter("count > 1").count() > 0) == (block == 50)
        got = chat_digests(blocks, BYTES)
        assert {r[0]: tuple(r)[1:5] for r in got.collect()} == want
        assert got.filter("formatted_chars < loss_chars").count() == 0
    assert chat_digests(format_chats(nothing(df), BYTES), BYTES).count() == 0


def test_escaping_and_mask():
    t = ChatTemplate()
    for text in ["", "plain", "\x1b", "\x1ba", *t.controls, "".join(t.escaped), "[INST[INST]]", "</</s>s>"]:
        hidden = t.escape(text)
        assert t.unescape(hidden) == text and not any(c in hidden for c in t.escaped[1:])
    turns = [(b"\x01\x00", b"\x02\x00\x03\x00", True), (b"", b"", True), (b"\x01\x00", b"\x04\x00", False)]
    ids, mask = assemble(turns, 1000)
    assert ids.tolist() == [1000, 1, 1001, 2, 3, 1002, 1000, 1001, 1002, 1000, 1, 1001, 4, 1002]
    assert ids[mask == 1].tolist() == [2, 3]
