import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablepulse.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()
HARD = ["", " ", "don't WE'LL it's 'tis ''s", "ΣΑΣ Σ İstanbul ǅ ﬁ", "é Ǻ", "a b c\x1cd\x85e​f", "x" * 5000, "<|startoftext|>hi<|endoftext|> <|endoftext|", "日本語 한국어 עברית", "🎉🎉 ½ ² ٣٤ 12345", "\x00\x01", "!!! ... ---"]


def same(text):
    own = bpe.codec(PATH)
    flat, bounds = own.encode([text.encode(), text.encode()])
    want = LIB.encode(text, add_special_tokens=False).ids
    assert flat[: bounds[1]].tolist() == want == flat[bounds[1] :].tolist(), text
    assert own.decode(want) == LIB.decode(want, skip_special_tokens=False)


def test_as_the_library():
    for text in HARD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehilnorst' \n<|>É", max_size=80), st.lists(st.sampled_from(["the", "ing", "Straße", "n't", "can't", "<|endoftext|>", "ñandú", "́", "Σ", "1st"]), max_size=12).map("".join)))
def test_random(text):
    same(text)


def test_every_character_as_the_library():
    """All of the first two planes and the ends of the others, between letters, numbers, marks and other characters."""
    points = [c for c in [*range(128, 0x20000), *range(0x20000, 0x110000, 97), *range(0x2A6D0, 0x2A710), *range(0x323A0, 0x323C0), *range(0xE0100, 0xE01F0)] if not 0xD800 <= c < 0xE000]
    own = bpe.codec(PATH)
    for at in range(0, len(points), 64):
        text = " ".join(f"a{c}a1{c}1!{c}!A\u0323{c} A{c}\u0301\u0323 {c}{c}'s{c}" for c in map(chr, points[at : at + 64]))
        flat, _ = own.encode([text.encode()])
        if flat.tolist() != LIB.encode(text, add_special_tokens=False).ids:
            for c in map(chr, points[at : at + 64]):  # says which
                same(f"a{c}a1{c}1!{c}!A\u0323{c} A{c}\u0301\u0323 {c}{c}'s{c}")


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 3)
    monkeypatch.setattr(bpe, "TABLE_KEPT", 2)
    for text in [*HARD, *HARD]:
        same(text)


def test_merges_make_later_ranks():
    own = bpe.codec(PATH)
    made = {}
    for rank, new in own.merges.values():
        made.setdefault(new, rank)
    assert all(rank > max(made.get(pair >> 20, -1), made.get(pair & 0xFFFFF, -1)) for pair, (rank, _) in own.merges.items())


def test_rows(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(50, None), (3, HARD[3]), (None, "null id")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs_of(rows, ids="clash"), PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.digests(docs_of([]), PATH).count() == 0
