import hashlib
import random
from array import array

import pytest
from helpers import awkward, documents, empty

from probanda.llm import bpe
from probanda.llm.queries import QUERIES, VOCABULARY

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(back)


def test_query_equals_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: expected(library, t) for i, t in documents(spark)}


def test_words_equal_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    random.seed(5)
    letters = [*" \n\t 　'std re12½٣éßñ漢字🙂՘Ᲊ\U000323b0\U00011de0\x1c\x85!@#<|>", "<|endoftext|>", "'ll", "   "]
    latin = [chr(c) for c in range(256)] + ["'re", "  ", "ab", " é"]
    for n in range(3000):
        text = "".join(random.choices(letters if n % 2 else latin, k=random.randint(0, 50)))
        ids = array("i")
        encoder.encode_into(text, ids)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_heap_equals_scan(library):
    encoder = bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    random.seed(6)
    for alphabet in ("ab", "theinraoed", "é漢a"):
        word = "".join(random.choices(alphabet, k=1200))
        assert encoder.scan(word.encode()) == encoder.heap(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_awkward_rows_round_trip(spark, library):
    docs = awkward(spark)
    out = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert set(out.columns) == set(docs.columns) | {"decoded"}
    rows = out.collect()
    assert len(rows) == 10
    for r in rows:
        assert r.decoded == (r.text or "")
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.digests(empty(spark), VOCABULARY).collect() == []
