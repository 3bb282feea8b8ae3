import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [None, "", " \t\n ", "Hello  World's we'LL 'S", "ΑΣ ΣΑΣ οδοσ", "a<|endoftext|>B <|startoftext|><|endoftext|", "x" * 5000, "aaaaaaa" * 300 + " " + "!?" * 800, "café CAFÉ İ \0 \0a \x1c\x85", "12345 ½ ² ٣", "日本語テキスト 한국어 ไทย हिन्दी", "👩‍👩‍👧 🏳️‍🌈", "ᲉꟋ՘", "</w> <w/>", "lic­ence tabs\tand\r\nlines"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoding_and_decoding_equal_the_library(spark, library):
    rng = random.Random(2)
    rows = [(i, t, -1) for i, t in enumerate(CASES)] + [(3, CASES[3], 0), (None, "no id", 0)]
    rows += [(100 + i, "".join(rng.choice("aeinorst lthe.,'") for _ in range(rng.randrange(400))), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = sorted((str(i), wanted(library, t), library.decode(wanted(library, t), skip_special_tokens=False)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in got) == want
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdehilnorst' <|>/ẃΣİ", max_size=80))
def test_any_text(vocabulary, library, text):
    assert list(vocabulary.encode(text)) == wanted(library, text)


def test_settled_signs_are_split_as_by_the_library(vocabulary, library):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not vocabulary.odd.search(chr(c))]
    assert len(signs) > 30_000
    for at in range(0, len(signs), 500):
        text = " ".join(f"a{c}b1{c}! {c}" for c in signs[at : at + 500])
        assert list(vocabulary.encode(text)) == wanted(library, text)


def plain_merges(merges, word):
    """Apply the merge of least rank, leftmost first, until none is left."""
    word, ranks = list(word), {p: r for r, p in enumerate(merges)}
    while True:
        found = min(((ranks[p], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks), default=None)
        if found is None:
            return word
        word[found[1] : found[1] + 2] = ["".join(word[found[1] : found[1] + 2])]


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_backtracking_equals_merging_for_any_vocabulary(rng):
    tokens, merges = ["a", "b", "c"], []
    for _ in range(rng.randrange(1, 30)):
        pair = rng.choice(tokens), rng.choice(tokens)
        if "".join(pair) not in tokens:
            tokens.append("".join(pair))
            merges.append(pair)
    m = bpe.Merges({t: i for i, t in enumerate(tokens)}, merges, "")
    for _ in range(20):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        assert [tokens[i] for i in m.encode(word)] == plain_merges(merges, word)


def test_decoding_skips_what_is_no_id(spark, vocabulary):
    rows = [(1, [320, None, -4, 10**6, 49407]), (2, None), (3, [])]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}
    assert vocabulary.decode(np.empty(0, np.int64), np.zeros(2, np.int64)) == pa.array(["", ""])


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())
    with open(PATH, "rb") as f, pytest.raises(ValueError):
        bpe.Vocabulary(re.sub(rb'"lstrip": ?false', b'"lstrip":true', f.read()))
