"""Greedy longest-match subword encoding on a 10-entry vocabulary."""

from ibex.operators import subword as SW

VOCAB = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4,
         "un": 5, "##aff": 6, "##able": 7, "aff": 8, "##a": 9}


def test_wordpiece_greedy_longest():
    assert SW.wordpiece("unaffable", VOCAB, 1) == [5, 6, 7]
    assert SW.wordpiece("affa", VOCAB, 1) == [8, 9]
    assert SW.wordpiece("xyz", VOCAB, 1) == [1]          # unknown word is one [UNK]
    assert SW.wordpiece("unx", VOCAB, 1) == [1]
    assert SW.wordpiece("a" * 101, VOCAB, 1) == [1]      # too long


def test_basic_word_strips_accents_and_splits_punct():
    assert SW.basic_word("Ünaff_able") == ["unaff", "_", "able"]
    assert SW.encode_word("UNAFFABLE", VOCAB, 1) == [5, 6, 7]


def test_spark_encode_markers_truncation_padding(spark):
    vocab = spark.createDataFrame(list(VOCAB.items()), "piece string, id int")
    rows = [(1, True, "unaffable affa"), (2, True, "xyz"), (3, False, " ".join(["unaffable"] * 300)), (4, False, "")]
    df = spark.createDataFrame(rows, "k int, is_train boolean, text string")
    enc = SW.subword_encode(df, vocab, "text", max_length=512)
    got = {r["k"]: r["input_ids"] for r in enc.collect()}
    assert got[1] == [2, 5, 6, 7, 8, 9, 3]
    assert got[2] == [2, 1, 3]
    assert len(got[3]) == 512 and got[3][0] == 2 and got[3][-1] == 3
    assert got[4] == [2, 3]
    padded = {r["k"]: r["input_ids"] for r in SW.pad_to_longest(enc, "input_ids", "is_train").collect()}
    assert padded[1] == [2, 5, 6, 7, 8, 9, 3]
    assert padded[2] == [2, 1, 3, 0, 0, 0, 0]
    assert len(padded[4]) == 512


def test_trie_equals_the_rule_for_one_word():
    import random

    from ibex.operators.piece_trie import PieceTrie

    rng = random.Random(6)
    letters = "abcé漢_.-ñßΣİ"
    for _ in range(30):
        pieces = {"[PAD]": 0, "[UNK]": 1}
        for _ in range(rng.randint(0, 60)):
            pieces.setdefault(rng.choice(["", "##"]) + "".join(rng.choices(letters.lower(), k=rng.randint(1, 4))), len(pieces))
        words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(200)] + ["a" * 100, "a" * 101, "##ab", "##", "Σ", "_"]
        for lower in (True, False):
            ids, first = PieceTrie(pieces, 1).encode(words, lower)
            got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
            assert got == [SW.encode_word(w, pieces, 1, lower) for w in words]
    assert PieceTrie({}, 1).encode(["ab", "c."])[0].tolist() == [1, 1, 1]
    assert PieceTrie(pieces, 1).encode([])[1].tolist() == [0]


def test_null_and_empty_lists_of_words():
    import pyarrow as pa

    from ibex.operators.piece_trie import PieceTrie, encode_lists

    words = pa.array([["un", "unaffable"], None, [], ["affa", "un"]], pa.list_(pa.string()))
    got = encode_lists(PieceTrie(VOCAB, 1), words)
    assert got.to_pylist() == [[5, 5, 6, 7], None, [], [8, 9, 5]]
    assert encode_lists(PieceTrie(VOCAB, 1), words.slice(2, 2)).to_pylist() == [[], [8, 9, 5]]
    assert encode_lists(PieceTrie(VOCAB, 1), words.slice(0, 0)).to_pylist() == []
