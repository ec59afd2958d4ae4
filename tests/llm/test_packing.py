import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablepulse.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()
KNOWN = packing.Ids(PATH)
HARD = ["", " ", "don't WE'LL it's 'tis ''s", "ΣΑΣ Σ İstanbul ǅ ﬁ", "é Ǻ \x7f", "a b c\x1cd\x85e​f", "x" * 5000, "<|startoftext|>hi<|endoftext|> <|endoftext|", "日本語 한국어", "🎉🎉 ½ ² ٣٤ 12345", "\x00\x01 a\x00b", "!!! ... ---"]


def best_fit(lengths, size):
    """Each length into the tightest of all open bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if size - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: size - sum(b)).append(n)
        else:
            bins.append([n])
    return bins


def laid_out(counts, size):
    plan, bins = packing.Plan(counts, size), defaultdict(dict)
    for length, n in counts.items():
        sequences, offsets = plan.places(np.full(n, length), np.arange(n))
        for s, o in zip(sequences.tolist(), offsets.tolist(), strict=True):
            assert o not in bins[s]
            bins[s][o] = length
    assert sorted(bins) == list(range(plan.sequences))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([7, 16, 40]).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=80))))
def test_as_one_pass_over_all_pieces(case):
    size, lengths = case
    bins = laid_out(Counter(lengths), size)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b.items()):
            assert offset == at
            at += length
        assert at <= size
    # bins of one remaining capacity are ties, so contents may differ, but not how full the bins are
    assert sorted(sum(b.values()) for b in bins.values()) == sorted(map(sum, best_fit(lengths, size)))


def test_plan_size_does_not_follow_the_number_of_pieces():
    rng = random.Random(1)
    small = {n: rng.randint(1, 9) for n in range(1, 4097)}
    sizes = [len(packing.Plan({n: c * k for n, c in small.items()}).low) for k in (1, 1000, 1_000_000_000)]
    assert max(sizes) < 3 * 4096 * 91 and max(sizes) < 3 * min(sizes)


def test_ids_as_the_library():
    known = packing.Ids(PATH)
    for text in [*HARD, *HARD, " ".join(HARD)]:
        assert np.frombuffer(known.of(text.encode()), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehilnorst' \n<|>É", max_size=80)))
def test_random_ids(text):
    assert np.frombuffer(KNOWN.of(text.encode()), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_LIMIT", 3)
    rng = random.Random(3)
    rows = [*enumerate(HARD), (50, None), (3, HARD[3]), (None, "null id"), (60, "so it is " * 9000), *((100 + i, "ab c " * rng.randint(0, 60)) for i in range(300))]
    size = 64
    got = packing.pack(docs_of(rows, length="clash", part=1).repartition(5), PATH, size).collect()
    want = Counter()
    for i, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            one = ids[at : at + size]
            want[i, k, at, len(one), crc32(np.array(one, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) == len(best_fit([r.length for r in got], size))
    assert packing.pack(docs_of([]), PATH).count() == 0
