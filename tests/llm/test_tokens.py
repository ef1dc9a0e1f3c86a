import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casework.llm import packing, token_files
from casework.llm.tokens import Encoder
from casework.workspace import fresh_path

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
SCHEMA = "doc_id long, text string, ids string, part int"
AWKWARD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb", "\n a", "a\tb c", "I'll we've 's x's", "x 's",
    "é É ß ﬁ ǅ Σας ΑΣ ς", "é ́x ä", "a b   c", "<|endoftext|> a <|startoftext|>b", "12 345a6",
    "***, ??  !", "日本語 テキスト", "😀 😀😀\n😀", "a\r\nb\r\n", "a\x1cb \x1c c", "a\x0bb \x85 c d", "İ i̇ K", "tab\t end\t",
]


def plain(path, text):
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_the_whole_text(path):
    rng, tool = random.Random(1), Encoder(path)
    assert tool.cuts
    texts = AWKWARD + ["".join(rng.choice(" \n aAé'st.,1 *́ΣΑ😀\t;H\u2003\u2019\u0331\x85\u3000") for _ in range(60)) for _ in range(3000)]
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    for text, ids in zip(texts, tool.encode(texts)):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, text


def documents():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "über", "thing", "x9"]) for _ in range(rng.choice([0, 5, 300, 3000]))))
            for i in range(60)]
    return rows + [(3, None), (None, "no id"), (None, None), (7, "again"), (7, "again")] + list(enumerate(AWKWARD, 100))


def test_packing_is_exact_and_full(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    pieces = packing.pack(docs, BYTES).collect()
    line = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert 0 < len(ids) <= 1024 - p.offset
        for i, x in enumerate(ids.tolist()):
            place = p.sequence_id * 1024 + p.offset + i
            assert place not in line
            line[place] = (p.doc_id, p.start + i, p.doc_tokens, x)
    assert sorted(line) == list(range(len(line)))  # gapless, so only the last sequence can be short
    found, now = [], []
    for place in sorted(line):
        doc_id, at, size, x = line[place]
        now.append(x)
        assert at == len(now) - 1
        if len(now) == size:
            found.append((doc_id, tuple(now)))
            now = []
    assert sorted(found, key=repr) == sorted(((d, (*plain(BYTES, t), 0)) for d, t in rows), key=repr)


def test_packed_sequences_and_digest(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in documents()], SCHEMA)
    pieces = packing.pack(docs, BYTES)
    built = sorted(packing.sequences(pieces).collect())
    assert [r.n_tokens for r in built[:-1]] == [1024] * (len(built) - 1)
    n = built[-1].n_tokens
    assert all(len(r.ids) == 4096 for r in built[:-1]) and len(built[-1].ids) == (4 * n if n & (n - 1) == 0 else 4096)
    for whole, brief in zip(sorted(pieces.collect(), key=repr), sorted(packing.digest(pieces).collect(), key=repr)):
        assert (brief.length, brief.ids_crc32) != (0, 0)
    assert {(r.sequence_id, r.offset): zlib.crc32(r.ids) for r in pieces.collect()} == {
        (r.sequence_id, r.offset): r.ids_crc32 for r in packing.digest(pieces).collect()}


@pytest.mark.parametrize("many", [True, False])
def test_token_files_round_trip(spark, many):
    rows = documents() if many else [(5, "one text"), (2, None)]
    path = fresh_path(spark, "corpus")
    token_files.write_corpus(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), path, WORDS, 1)
    found = token_files.read_corpus(spark, path).orderBy("start").collect()
    ids = [tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    expected = [(d, (*plain(WORDS, t), 1)) for d, t in rows]
    assert sorted(zip([r.doc_id for r in found], ids), key=repr) == sorted(expected, key=repr)
    order = [r.doc_id for r in found]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))
    assert [r.start for r in found] == [0, *np.cumsum([len(i) for i in ids]).tolist()][:-1]
    brief = token_files.digest(token_files.read_corpus(spark, path)).orderBy("start").collect()
    assert [r.ids_crc32 for r in brief] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    one = token_files.read_document(spark, path, 5)
    assert [tuple(i.tolist()) for i in one] == [i for d, i in expected if d == 5]


def test_another_dictionary_is_refused(spark):
    a, b = fresh_path(spark, "corpus"), fresh_path(spark, "corpus")
    docs = spark.createDataFrame([(*r, "x", 1) for r in documents()], SCHEMA)
    token_files.write_corpus(docs, a, WORDS, 1)
    token_files.write_corpus(docs.where("doc_id < 40"), b, WORDS, 1)
    spark.read.parquet(f"{a}/blocks").write.parquet(f"{b}/blocks", mode="overwrite")
    with pytest.raises(Exception, match="dictionary"):
        token_files.read_corpus(spark, b).collect()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(docs, BYTES).count() == 0
    path = fresh_path(spark, "corpus")
    token_files.write_corpus(docs, path, WORDS, 1)
    assert token_files.read_corpus(spark, path).count() == 0
