"""What the findings of the third round's check ask for."""

import os
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import byte_bpe, language, token_store
from tallyloom.llm.common import pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.own, name)


def odd_texts(n):
    pick = random.Random(4)
    parts = ["a", "Zürich", "日本語のテキスト", "don't", "12345", "a\nb", "\n", "\t", "x y", "　", "\x1c", "<|endoftext|>", "q<|endoftext|>", "—", "🙂🙂", "é", "w" * 60, "", ""]
    return ["", " ", "  ", " lead", "trail ", "two  spaces", " \n x", *(" ".join(pick.choice(parts) + pick.choice(["", "", str(pick.randrange(3000))]) for _ in range(pick.randrange(1, 40))) for _ in range(n))]


def test_chunks_go_to_the_tokenizer_together(monkeypatch):
    from tokenizers import Tokenizer

    counted = Counted(Tokenizer.from_file(PATH))
    monkeypatch.setattr(Tokenizer, "from_file", staticmethod(lambda _: counted))
    token_store.codec.cache_clear()
    try:
        own = token_store.codec(PATH)
        text = " ".join(f"word{i}" for i in range(5000))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == counted.own.encode(text, add_special_tokens=False).ids
        assert counted.texts < 500
    finally:
        token_store.codec.cache_clear()


def test_codec_gives_the_ids_of_the_plain_tokenizer():
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(PATH), odd_texts(600)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    token_store.codec.cache_clear()
    try:
        own = token_store.codec(PATH)
        for block, entries in ((1 << 22, 1 << 20), (300, 50), (5000, 5)):
            own.block, own.entries = block, entries
            assert own.encode(texts) == wanted
            assert own.encode(texts[::-1]) == wanted[::-1]
            assert len(own.chunks) == len(own.sizes) == len(own.seen)
    finally:
        token_store.codec.cache_clear()


def test_tokens_that_are_not_the_text_are_encoded_one_by_one():
    from tokenizers import Tokenizer, normalizers

    path = f"/tmp/lower-{os.getpid()}.json"
    own = Tokenizer.from_file(PATH)
    own.normalizer = normalizers.NFD()
    own.save(path)
    texts = ["Zürich é ü à", "plain words"]
    try:
        codec = token_store.codec(path)
        assert codec.encode(texts) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    finally:
        os.remove(path)
        token_store.codec.cache_clear()


def test_byte_bpe_of_odd_texts_is_the_same_from_any_cache():
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = odd_texts(300)
    own, small = byte_bpe.Encoding(ranks, public_tokenizers.PATTERN), byte_bpe.Encoding(ranks, public_tokenizers.PATTERN)
    small.codec.block, small.codec.entries = 200, 20
    ids = own.encode(texts)
    for text, code in zip(texts, ids):
        flat, _ = own.encode_many([], [text])  # as one text, no chunk
        assert code == flat.tobytes()
    assert [*map(small.encode, [[t] for t in texts])] == [[x] for x in ids] and small.encode(texts) == ids


def test_tasks_hold_few_texts_at_once():
    rows = [pa.record_batch({"id": list(range(2_500)), "text": ["x" * 10] * 2_500}), pa.record_batch({"id": list(range(8)), "text": ["y" * 1_000_000] * 8})]
    got = list(pieces(rows))
    assert [p.num_rows for p in got[:3]] == [1_000, 1_000, 500] and [p.num_rows for p in got[3:]] == [4, 4]
    assert pa.Table.from_batches(got) == pa.Table.from_batches(rows)
    assert list(pieces([rows[0].slice(0, 0)])) == []


def arrow_columns(frame):
    """The columns that go to the tasks of each mapInArrow of a plan."""
    plan = frame._jdf.queryExecution().analyzed()
    nodes = [plan]
    found = []
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "MapInArrow":
            found.append([children[0].output().apply(i).name() for i in range(children[0].output().size())])
        nodes += children
    return found


def test_pipeline_sends_a_text_once(spark, tmp_path):
    spark.createDataFrame([("b1", "one two three four five six seven eight nine ten")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "One two.", "en"), (2, None, "en"), (2, "", None)], "doc_id long, text string, lang string")
    assert arrow_columns(language.with_language(docs, {"en": [1]}, "pred", "score")) == [["doc_id", "text", "lang"]]
    (sent,) = arrow_columns(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert len(sent) == 4 and sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [1, 2, 2]
    numbers = docs.withColumn("text", F.col("doc_id"))  # texts that are no strings are sent as strings besides
    assert [r.pred for r in language.with_language(numbers, {"en": [1]}, "pred", "score").collect()] == ["und"] * 3


def test_a_tasks_end_gives_memory_back():
    held = [b"%05d" % i * 1_000 for i in range(20_000)]
    last = held[-1]  # stands above the others, so that they don't go by themselves
    size = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE")
    held.clear()
    before = size()
    assert list(pieces([])) == [] and last
    assert size() < before - 50_000_000
