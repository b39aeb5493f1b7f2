import os
import random

import pytest

from helixframe.llm.text import Words, in_chunks, plain
from helixframe.llm.tokens import VOCABULARY, Encoder, decode_ids, encode_texts, merged, parse_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")

TEXTS = ["", " ", "  a", "a  ", "\n\n x", "don't've 's 'tis '' 'll'll I'LL 's", "a'", "'r", "'re", "x'r y're", "　あ", "  \n", "!'s", " 's", "1'st", "<|endoftext|> hi", "²½ ①", "éa é", "aaaa" * 3000, "日本語" * 2000, "a\x85b\x1cc \xa0 d", "�​­", "😀👍🏽 ok", "\t\t\tcode  here\r\n", "x" * 24 + " " + "y" * 25]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_public_tokenizer():
    r = random.Random(7)
    alphabet = ["a", "B", "é", "日", "1", "²", "'", "'s", "'ll", " ", "  ", "\n", "\xa0", "!", "-", "😀", "re", "t"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    encoder = Encoder(parse_ranks(open(VOCABULARY, "rb").read()))
    got = []
    for a, b in in_chunks(texts, 5000):
        bounds, ids = encoder.encode(texts[a:b])
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(b - a)]
    assert got == reference()(texts)


def test_long_slices_equal_short_rule():
    ranks = parse_ranks(open(VOCABULARY, "rb").read())
    r = random.Random(8)
    for n in (25, 40, 200):
        piece = bytes(r.choice(b"abcdetinors") for _ in range(n))
        parts = [piece[i : i + 1] for i in range(n)]
        while True:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert merged(piece, ranks) == [ranks[p] for p in parts]


def test_rows_and_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(900, None, "x"), (None, "a b", "x"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = encode_texts(df)
    got = sorted(((r.doc_id, r.ids) for r in out.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert len(got) == len(rows) and dict(got)[0] == [] and dict(got)[900] == []
    back = {r.doc_id: (r.text, r.offsets) for r in decode_ids(out).collect()}
    assert all(back[i][0] == t for i, t in enumerate(TEXTS)) and back[900] == ("", [])
    assert back[16][1][0] == 0 and len(back[16][1]) == len(dict(got)[16])
    kept = {r.doc_id: (r.ids, r.offsets) for r in encode_texts(df, with_offsets=True).collect()}
    assert all(kept[i] == (ids, back[i][1]) for i, ids in dict(got).items() if i is not None)
    assert encode_texts(df.limit(0)).count() == 0


def test_words():
    w = Words([plain("Ab&amp;c d­e, x_1"), "", plain("Ü 2")])
    assert [w.phrase(i, 1) for i in range(len(w))] == ["ab", "c", "de", "x", "1", "ü", "2"]
    assert w.text.tolist() == [0, 0, 0, 0, 0, 2, 2] and len(Words([]).shingles(3)) == 0
