import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from condensa.functions import ids as I
from condensa.functions.text import word_tokens
from condensa.operators import encode, lookup
from condensa.operators.decode import decode_words
from condensa.operators.skew import attach_by_key, heaviest
from condensa.operators.vocab import build_vocab, load_vocab, save_vocab, vocab_from_mapping, word_counts


def test_pad(column):
    assert column(I.pad_to(F.col("a"), 3), a=[7]) == [7, 0, 0]
    assert column(I.pad_to(F.col("a"), 2), a=[7, 8, 9]) == [7, 8]


@pytest.mark.parametrize(
    "ids, expected",
    [([7, 8], [7, 8, 2, 0]), ([7, 8, 9], [7, 8, 9, 2]), ([7, 8, 9, 10, 11], [7, 8, 9, 2])],
)
def test_close(column, ids, expected):
    assert column(I.close_and_pad(F.col("a"), 4), a=ids) == expected


def test_close_empty(spark):
    df = spark.sql("SELECT cast(array() AS array<int>) AS a")
    assert df.select(I.close_and_pad(F.col("a"), 3)).first()[0] == [2, 0, 0]


def test_collapse_and_masks(column):
    assert column(I.collapse_unknown("a", 5), a=[4, 6, 3, 2]) == [4, 3, 3, 2]
    assert column(I.real_ids("a"), a=[4, 0, 2, 0]) == [4, 2]
    assert column(I.until_eos("a"), a=[4, 5, 2, 7, 2]) == [4, 5]
    assert column(I.until_eos("a"), a=[2, 4]) == []
    assert column(I.until_eos("a"), a=[4, 5]) == [4, 5]
    assert column(I.count_in(F.col("a"), F.lit(5)), a=[5, 4, 5]) == 2


def test_ngrams(column):
    assert column(I.ngrams("a", 2), a=["x", "y", "z"]) == ["x y", "y z"]
    assert column(I.ngrams("a", 2), a=["x"]) == []


EXAMPLE = [(1, "a zz qq zz", "qq zz a ww")]
BOTH = pytest.mark.parametrize("way", ["inline", "join"])


def encoded(spark, pairs, vocab, way, vocab_size, tx, ty, cap):
    df = spark.createDataFrame(pairs, "doc_id long, source string, target string")
    return encode.encode_examples(df, vocab, vocab_size, tx, ty, cap, lookup=way)


@BOTH
def test_slots_capped_and_target_follows_source(spark, way):
    vocab = vocab_from_mapping(spark, {"<unk>": 3, "a": 4})
    row = encoded(spark, EXAMPLE, vocab, way, 5, 5, 5, 1).first()
    assert row["x"] == [4, 6, 3, 6, 0]
    assert row["y"] == [3, 6, 4, 3, 2]
    assert (row["oov_cnt"], row["oov"]) == (1, {6: "zz"})


def plain_encode(source, target, vocab, size, tx, ty, cap):
    """The rule of encoding, stated as loops."""
    find = lambda t: re.findall(r"""[\w']+|[.,!?;"]""", t.lower())
    xs, ys = find(source)[:tx], find(target)[:ty]
    slots = list(dict.fromkeys(w for w in xs if w not in vocab))[:cap]
    number = vocab | {w: size + k for k, w in enumerate(slots, 1)}
    x = [number.get(w, 3) for w in xs]
    y = [number.get(w, 3) for w in ys][: ty - 1] + [2]
    pad = lambda a, n: a + [0] * (n - len(a))
    return pad(x, tx), pad(y, ty), len(slots), {size + k: w for k, w in enumerate(slots, 1)}


@BOTH
def test_equals_loops_on_random_texts(spark, way):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["žluť", "o'neil", ".", "!", "—"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    pairs = [(i, text(40), text(15)) for i in range(200)]
    known = {w: i for i, w in enumerate(words[:12], 4)}
    got = encoded(spark, pairs, vocab_from_mapping(spark, known), way, 16, 20, 8, 5).collect()
    assert len(got) == 200
    for row in got:
        _, source, target = pairs[row["doc_id"]]
        want = plain_encode(source, target, known, 16, 20, 8, 5)
        assert (row["x"], row["y"], row["oov_cnt"], row["oov"]) == want


@BOTH
def test_round_trip_gives_back_the_cut_tokens(spark, way):
    pairs = [(1, 'Ahoj "světe", o\'neil!', "Ahoj kůň"), (2, "", "")]
    vocab = vocab_from_mapping(spark, {"ahoj": 4, "kůň": 5})
    examples = encoded(spark, pairs, vocab, "inline", 6, 6, 4, 9)
    texts = decode_words(
        examples, vocab, 6, {"x": "s", "y": "t"}, "doc_id", True, True, lookup=way
    )
    assert sorted(texts.collect()) == [
        (1, 'ahoj " světe " , o\'neil', "ahoj kůň"),
        (2, "", ""),
    ]


def test_decode_keeps_reserved_words_when_asked(spark):
    df = spark.sql("SELECT 1L AS doc_id, array(4, 6, 5, 3, 2, 0) AS x, map(6, 'zz') AS oov")
    vocab = vocab_from_mapping(spark, {"a": 4})
    for way in ("inline", "join"):
        text = decode_words(df, vocab, 5, {"x": "t"}, lookup=way).first()["t"]
        assert text == "a zz <unk> <unk> <eos> <pad>"
        text = decode_words(df, vocab, 5, {"x": "t"}, "doc_id", True, True, way).first()["t"]
        assert text == "a zz <unk> <unk>"


def test_vocab_order_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("b a b c a",), ("d",)], ["text"])
    vocab = build_vocab(word_counts(df, word_tokens("text")), 3)
    rows = [(r["word"], r["id"], r["n"]) for r in vocab.orderBy("id").collect()]
    assert rows == [("a", 4, 2), ("b", 5, 2), ("c", 6, 1)]
    save_vocab(vocab, str(tmp_path / "v"))
    assert sorted(load_vocab(spark, str(tmp_path / "v")).collect()) == sorted(vocab.collect())


def test_inline_table_checks_its_size(spark):
    vocab = vocab_from_mapping(spark, {f"w{i}": 4 + i for i in range(10)})
    df = spark.range(1).withColumn("t", lookup.word_table(vocab, limit=9))
    with pytest.raises(Exception, match="more than 9 rows"):
        df.select(F.size("t")).collect()
    with pytest.raises(ValueError):
        lookup.id_table(vocab, 300_000)


def test_length_filter(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 6, 5), (3, 5, 6)], "i int, x int, y int")
    assert [r["i"] for r in encode.length_filter(df, F.col("x"), F.col("y"), 5, 5).collect()] == [1]


def test_id_range(spark):
    df = spark.createDataFrame([([1, 70000], [2]), ([65535, -1], [0])], "x array<int>, y array<int>")
    assert tuple(encode.id_range_check(df).first()) == (6, 2, 70000)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 50])
def test_heaviest_keeps_ties_by_key(spark, k):
    rows = [("a", 5), ("b", 3), ("c", 3), ("d", 3), ("e", 1), ("f", 1)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(4)
    assert sorted((r["k"], r["n"]) for r in heaviest(df, "n", "k", k).collect()) == rows[:k]


def test_heaviest_sorts_few_rows(spark):
    df = spark.range(10_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
    assert [r["n"] for r in heaviest(df, "n", "k", 3).orderBy("n").collect()] == [9997, 9998, 9999]
    assert heaviest(df.limit(0), "n", "k", 3).collect() == []


@pytest.mark.parametrize("head_rows", [1, 3, 100])
@pytest.mark.parametrize("counted", [False, True])
def test_attach_by_key_with_a_dominant_key(spark, head_rows, counted):
    keys = ["hot"] * 300 + ["gone"] * 200 + ["b"] * 20 + ["c", "missing", None]
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    right = spark.createDataFrame([("hot", 300), ("b", 20), ("c", 1), ("unused", 9)], "k string, v int")
    heavy = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("weight"))
    got = attach_by_key(
        left, right, "k", "v", heavy=heavy if counted else None, head_rows=head_rows
    )
    values = {"hot": 300, "b": 20, "c": 1}
    assert sorted((r["i"], r["k"], r["v"]) for r in got.collect()) == [
        (i, k, values.get(k)) for i, k in enumerate(keys)
    ]


def test_heaviest_of_equal_weights_sorts_ranges_only(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    top = heaviest(df, "n", "k", 500)
    assert sorted(r["k"] for r in top.collect()) == sorted(map(str, range(20_000)))[:500]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


MISSING = [
    (3, "a b a", None),
    (3, None, "b a"),
    (3, None, None),
    (3, "", ""),
    (3, "a b a", None),
    (None, "b c", "c"),
]


@BOTH
def test_missing_sides_and_equal_keys(spark, way):
    vocab = vocab_from_mapping(spark, {"a": 4})
    df = spark.createDataFrame(MISSING, "doc_id long, source string, target string")
    got = encode.encode_examples(df, vocab, 5, 4, 3, 2, lookup=way).collect()
    assert sorted(((r["doc_id"] or 0), r["x"], r["y"], r["oov_cnt"]) for r in got) == [
        (0, [6, 7, 0, 0], [7, 2, 0], 2),
        (3, [0, 0, 0, 0], [2, 0, 0], 0),
        (3, [0, 0, 0, 0], [2, 0, 0], 0),
        (3, [0, 0, 0, 0], [3, 4, 2], 0),
        (3, [4, 6, 4, 0], [2, 0, 0], 1),
        (3, [4, 6, 4, 0], [2, 0, 0], 1),
    ]


@BOTH
def test_decoding_missing_ids_and_equal_keys(spark, way):
    vocab = vocab_from_mapping(spark, {"a": 4})
    rows = [(1, [4, 0], None, {}), (1, [4, 6], [6], {6: "zz"}), (1, None, [4], {})]
    df = spark.createDataFrame(
        rows, "doc_id long, x array<int>, y array<int>, oov map<int,string>"
    )
    got = decode_words(df, vocab, 5, {"x": "s", "y": "t"}, lookup=way).collect()
    assert sorted((r["s"], r["t"]) for r in got) == [("", "a"), ("a <pad>", ""), ("a zz", "zz")]


def test_mapping_leaves_out_reserved_words_only(spark):
    words = vocab_from_mapping(spark, {"<pad>": 0, "<unk>": 3, "of": 5})
    assert [tuple(r) for r in words.collect()] == [("of", 5)]
    with pytest.raises(ValueError):
        vocab_from_mapping(spark, {"the": 0, "of": 5})


def test_pieces(spark):
    from condensa.operators import subword

    vocab = vocab_from_mapping(spark, {"▁ab": 4, "cd": 5})
    df = spark.createDataFrame([(1, "abcd  ef")], "doc_id long, text string")
    pieces = subword.cut_pieces("text", 2)
    assert df.select(pieces).first()[0] == ["▁ab", "cd", "▁ef"]
    pairs = df.select("doc_id", pieces.alias("source"), F.lit(None).cast("array<string>").alias("target"))
    row = subword.encode_pieces(pairs, vocab, 6, 5, 3, 2).first()
    assert (row["x"], row["y"], row["oov"]) == ([4, 5, 7, 2, 0], [2, 0, 0], {7: "▁ef"})
    short = subword.encode_pieces(pairs, vocab, 6, 3, 3, 2).first()
    assert short["x"] == [4, 5, 2]
    texts = subword.decode_pieces(spark.createDataFrame([row]), vocab, 6, {"x": "s"}).first()
    assert texts["s"] == "abcd ef"
    merged = [subword.merge_fragments(F.col("p"), n) for n in (2, 3)]
    found = spark.createDataFrame([(["▁", "ab", "c"],)], "p array<string>").select(*merged).first()
    assert tuple(found) == (["▁abc"], ["▁", "ab", "c"])


def test_piece_counts_and_first_pieces(spark):
    from condensa.operators import subword

    rows = [("  abcd  e\nf", "abc 😀😀😀"), (None, " "), ("", "x" * 9)]
    df = spark.createDataFrame(rows, "source string, target string")
    whole = F.concat(*[F.coalesce(subword.cut_pieces(c, 2), F.array().cast("array<string>")) for c in df.columns])
    want = Counter(p for r in df.select(whole.alias("p")).collect() for p in r["p"])
    found = {r["word"]: r["n"] for r in subword.piece_counts(df, df.columns, 2).collect()}
    assert found == want and found["▁😀😀"] == 1 and found["▁ab"] == 2
    first = [df.select(F.slice(subword.cut_pieces("source", 2, n), 1, n)).first()[0] for n in (1, 2, 3, 9)]
    pieces = ["▁ab", "cd", "▁e\n", "f"]
    assert first == [pieces[:1], pieces[:2], pieces[:3], pieces]
    # a word behind the first ones is not cut
    assert df.select(subword.cut_pieces("source", 2, 1)).first()[0] == ["▁ab", "cd"]
