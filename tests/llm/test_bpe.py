import hashlib
import random

import pytest

from tests.llm.helpers import documents
from tidegrid.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH) as f:
        return bpe.tokenizer(f.read()), tokenizers.Tokenizer.from_file(PATH)


def naive(word, merges):
    """Merge by merge, the first of the list that applies, leftmost first."""
    parts = [bytes([b]) for b in word]
    for a, b in merges:
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_of_small_merge_lists(seed):
    rng = random.Random(seed)
    pieces, merges = [b"a", b"b", b"c"], []
    while len(merges) < 25:
        a, b = rng.choice(pieces), rng.choice(pieces)
        if a + b not in pieces and len(a + b) < 12 and naive(a + b, merges) == [a, b]:
            merges.append((a, b))
            pieces.append(a + b)
    ids = {p: i for i, p in enumerate(pieces)}
    automaton = bpe.Automaton(pieces, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
    for _ in range(400):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
        found = [pieces[t] for t in automaton.encode_word(word)]
        assert found == naive(word, merges)


def test_equals_the_library(both):
    mine, theirs = both
    rng = random.Random(11)
    alphabet = ["a", "b", "e", "t", "h", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "你", "🙂", "<|endoftext|>", " ", "　", "\x1c", "\x85", "²", "===", "aaaa", "ing", "the", "\t", "​", "́", "<|endof", "'LL"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == want
        assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_part_of_a_character_decodes_as_the_library_does(both):
    mine, theirs = both
    ids = mine.encode("🙂你")
    for k in range(len(ids)):
        assert mine.decode(ids[k:]) == theirs.decode(ids[k:], skip_special_tokens=False)


def test_documents(spark, both):
    _, theirs = both
    docs = documents(spark)
    want = []
    for r in docs.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    found = bpe.encode_documents(docs, PATH).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_long_texts_are_encoded_in_blocks(both, monkeypatch):
    mine, theirs = both
    text = "some  words 12 and<|endoftext|> more\n\n of 🙂them' s " * 40
    monkeypatch.setattr(bpe, "LONG", 64)
    assert len(list(mine.blocks(text))) > 20
    assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids and list(mine.blocks("")) == []


def test_the_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    words = bpe.Words(both[0].automaton)
    for i in range(100):
        assert words[f"w{i}"][2] == f"w{i}".encode()
    words["y" * 100]
    assert len(words) <= 10


def test_options_that_are_not_compiled_are_errors():
    with pytest.raises(ValueError):
        bpe.Tokenizer({"model": {"type": "Unigram"}})
