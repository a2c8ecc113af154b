import zlib
from collections import defaultdict

import numpy as np
from fixtures import CLASHES, EDGE, TOKENIZER, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eoframe.llm import packing, tokens

LIBRARY = Tokenizer.from_file(TOKENIZER)
WORDS = tokens.WordEncoder(TOKENIZER)
ALPHABET = "abzAZ019 .,!'éÜßİΣσ́Å \x1c\x85　\t\n<|>stlndofex日"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    ids, bounds = WORDS.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_special_tokens_and_contractions():
    texts = ["it's we'll DON'T 'S", "a<|endoftext|>b <|startoftext|>", None, "", "x" * 5000, "***$$$ 12a 3"]
    ids, bounds = WORDS.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("azSTDmrevlßéİÅº09½².,'!_- \t\n\f\r\v"), max_size=40), max_size=5))
def test_ids_of_latin_texts_equal_the_library(texts):
    ids, bounds = WORDS.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_every_latin_character_equals_the_library():
    texts = [f"A{c}B {c}{c}9 '{c}s 's{c}\n{c}" for c in map(chr, range(0x250))]
    ids, bounds = WORDS.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, hex(i)


def test_words_that_share_pieces_are_remembered_as_pieces():
    own = tokens.WordEncoder(TOKENIZER)
    stems, ends = ["tion", "Ment", "NESS", "ful", "été"], [a + b for a in ".,!?*" for b in "#$%&"]
    text = " ".join(s + e for s in stems for e in ends)
    ids, _ = own.encode([text, text.upper()])
    assert ids.tolist() == 2 * LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own.index) <= len(stems) + len(ends) + 1  # the empty piece is one; whole words would be more than 100


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_HELD", 50)
    monkeypatch.setattr(tokens, "WORDS_KEPT", 10)
    own = tokens.WordEncoder(TOKENIZER)
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(20)) + " same"
        ids, _ = own.encode([text])
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own.index) <= 50 + 21


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_equals_plain(lengths):
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    used, rooms = {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        rooms.append((min(fits) if fits else 64) - lengths[i])
        if fits:
            rooms.remove(min(fits))
    for w, o, n in zip(windows, offsets, lengths):
        assert o + n <= 64
        used.setdefault(w, []).append((o, n))
    assert sorted(64 - sum(n for _, n in u) for u in used.values()) == sorted(rooms)
    for u in used.values():
        at = 0
        for o, n in sorted(u):
            assert o == at
            at += n


def check(found, rows, window):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, docs_ids in ids.items():
        if len(docs_ids) > 1:
            continue
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = docs_ids[0][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(docs_ids[0])
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r.length
        assert at == len(docs_ids[0])
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
    return seqs


def test_pieces(spark):
    found = packing.pack(docs(spark, EDGE, CLASHES), TOKENIZER).collect()
    check(found, EDGE, 2048)
    assert sum(r.length for r in found if r.doc_id == 8) == 4  # the repeated row is packed twice


def test_little_padding_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = [(i, "word " * (i % 37 + 1), "s") for i in range(300)]
    seqs = check(packing.pack(docs(spark, rows), TOKENIZER, window=64).collect(), rows, 64)
    used = sum(n for s in seqs.values() for _, n in s)
    assert used / (64 * len(seqs)) > 0.93


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0
