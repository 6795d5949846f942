"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from condensa.llm import bitplanes, bpe, classifier, itq, packing, preference, quality_rules
from condensa.llm import near_copies, simhash, token_counts, toxicity
from condensa.llm.common import remainder
from condensa.session import new_path

LONG = " ".join(f"word{i % 977} the" for i in range(30_000)) + "x" * 5_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt is not the end of the tale."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "The quick brown fox jumps over the lazy dog.\nIt is not the end of the tale."),
    (5, "The quick brown fox jumps over the lazy dog.\nIt is not the end of the tale."),
    (None, "a text without a key <|endoftext|> and  two  spaces \n é ǅ 日本"),
    (7, " \t\n "),
    (9007199254740993, "a key that no double holds"),
]
SCHEMA = "doc_id long, text string, lang string, _text string, _bits long, score double, length int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, None, "other", 1, 0.5, 3) for k, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (5, 0, 1), (None, 1, 1), (4, 0, None), (7, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def keys(rows):
    return Counter(r["doc_id"] for r in rows)


ALL = Counter(k for k, _ in TEXTS)
NO_LABELS = "doc_id long, quality int, toxic int"


# --- byte-level BPE -------------------------------------------------------------------

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_gives_the_ids_of_the_library(spark, docs, none):
    own = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    rows = bpe.roundtrip_digests(docs, RANKS, P.PATTERN).collect()
    assert keys(rows) == ALL
    want = Counter()
    for key, text in TEXTS:
        ids = own.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert bpe.roundtrip_digests(none, RANKS, P.PATTERN).collect() == []


def test_bpe_decodes_what_it_encoded(docs):
    encoded = bpe.encode_texts(docs, RANKS, P.PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS, P.PATTERN).collect()
    want = Counter((k, (t or "").encode()) for k, t in TEXTS)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in decoded) == want


def slow_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        pairs = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merge_takes_the_smallest_rank_and_the_leftmost_place():
    random.seed(3)
    letters = [bytes([b]) for b in b"abc"]
    for _ in range(60):
        tokens = set(letters)
        while len(tokens) < 40:
            tokens.add(random.choice(list(tokens))[:3] + random.choice(list(tokens))[:3])
        order = letters + random.sample(sorted(tokens - set(letters)), 37)
        # any order of ranks, also one in which a merge leads to a smaller rank
        ranks = {t: i for i, t in enumerate(order)}
        pieces = [bytes(random.choices(b"abc", k=random.randint(0, 30))) for _ in range(20)]
        found = bpe.merge(pieces, ranks, bpe.pair_table(ranks))
        assert found == [slow_merge(p, ranks) if p else [] for p in pieces]


def test_merge_of_a_very_long_piece():
    ranks = bpe.read_ranks(RANKS)
    piece = b"ab" * 50_000 + b"q" * 100_001
    found = bpe.merge([piece], ranks, bpe.pair_table(ranks))[0]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert found == own._encode_single_piece(piece)


def test_rank_queue_pops_in_order():
    queue = bpe.RankQueue()
    pushed = [(random.randrange(50_000), random.randrange(1000)) for _ in range(3000)]
    for rank, place in pushed:
        queue.push(rank, place)
    popped = []
    while queue.top:
        rank, places = queue.pop()
        popped += [(rank, p) for p in places]
    assert popped == sorted(pushed)


# --- packing --------------------------------------------------------------------------

BYTE_FILE, WORD_FILE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library_ids(path, end=None):
    tokenizer = Tokenizer.from_file(path)
    tail = [] if end is None else [end]
    return [(k, tokenizer.encode(t or "", add_special_tokens=False).ids + tail) for k, t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_places_every_piece_once(docs, none):
    rows = packing.pack(docs, BYTE_FILE, P.PATTERN).collect()
    want = Counter()
    for key, ids in library_ids(BYTE_FILE, 0):
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = sorted({0, first, *range(first, len(ids) + 1, 2048), len(ids)})
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, piece, a, b - a, crc(ids[a:b])] += 1
    found = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert found == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        ends = [0]
        for offset, length in sorted(slots):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert packing.pack(none, BYTE_FILE, P.PATTERN).collect() == []


def slow_best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free[free.index(min(fits))] -= length
        else:
            free.append(capacity - length)
    return len(free)


def test_plan_uses_as_many_sequences_as_best_fit_does():
    random.seed(5)
    for _ in range(50):
        capacity = random.choice([7, 20, 64])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 300))]
        plan = packing.plan_slots(Counter(lengths), capacity)
        used = {}
        for length, first, ranks, sequence, each, at in plan:
            for i in range(ranks):
                place = at + i % each * length
                used.setdefault(sequence + i // each, []).append((place, place + length))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(used) == slow_best_fit(lengths, capacity)
        assert sum(map(len, used.values())) == len(lengths)


# --- bit planes -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 65_537, 200_003])
@pytest.mark.parametrize("width", [3, 16, 20])
def test_planes_round_trip(n, width):
    ids = np.random.default_rng(n).integers(0, 1 << width, n).astype("<u4")
    planes = bitplanes.to_planes(ids, width)
    assert len(planes) == width * -(-n // bitplanes.BLOCK_IDS)
    assert (bitplanes.from_planes(planes, n, width) == ids).all()


def test_id_files_hold_all_documents_in_key_order(spark, docs, none):
    path = new_path(spark, "ids")
    bitplanes.write_ids(docs, WORD_FILE, path, chunk_ids=20_000)
    order = sorted(library_ids(WORD_FILE, 1), key=lambda d: (d[0] is not None, d[0] or 0))
    want, at = Counter(), 0
    for key, ids in order:
        want[key, at, len(ids), crc(ids)] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in bitplanes.read_documents(spark, path).collect()) == want
    read = Counter((r["doc_id"], tuple(r["ids"])) for r in bitplanes.read_ids(spark, path).collect())
    assert read == Counter((k, tuple(i)) for k, i in order)
    empty = new_path(spark, "ids")
    bitplanes.write_ids(none, WORD_FILE, empty)
    assert bitplanes.read_documents(spark, empty).collect() == []


def test_ids_wider_than_the_planes_are_refused(spark, docs):
    with pytest.raises(Exception, match="does not fit"):
        bitplanes.write_ids(docs, WORD_FILE, new_path(spark, "ids"), width=8)


# --- token counts ---------------------------------------------------------------------


def test_counts_of_any_width_come_back():
    random = np.random.default_rng(3)
    sizes = random.integers(1, 40, 300)
    values = random.integers(1, 300, sizes.sum()).astype("<u4")
    values[random.random(len(values)) < 0.01] = 1 << 20
    values[: sizes[0]] = 255
    assert (token_counts._widened(token_counts._narrow(values, sizes), sizes) == values).all()


def test_frequent_pretokens_spread_over_tasks(spark):
    """A pre-token that every text holds: no task gets more than twice the median of its posting bytes."""
    random.seed(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " the ".join(random.choices(words, k=30))) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    dealt = token_counts.dealt_pretokens(table, BYTE_FILE, P.PATTERN, "doc_id", "text", 16)
    hot = dealt.where("pretoken = ' the'").groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("places")))
    assert hot.count() >= 12
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("places")).alias("n")).collect()
    sizes = sorted(r["n"] for r in sizes)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert token_counts.token_counts(table, BYTE_FILE, P.PATTERN).count() == 6000


def test_token_counts_are_the_library_s(docs, none):
    rows = token_counts.token_counts(docs, BYTE_FILE, P.PATTERN).collect()
    sizes = [len((t or "").encode()) for _, t in TEXTS]
    want = Counter(
        (k, n, len(ids), len(ids) > 512) for n, (k, ids) in zip(sizes, library_ids(BYTE_FILE))
    )
    assert Counter(tuple(r) for r in rows) == want
    assert token_counts.token_counts(none, BYTE_FILE, P.PATTERN).collect() == []


# --- SimHash --------------------------------------------------------------------------


def test_fingerprints_by_hand():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A B") == simhash.fingerprint(b"a\tb")
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e", b"c d e f")]
    majority = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) >= 2)
    assert simhash.fingerprint(b"A b C d e f") == majority


def test_block_masks_leave_no_pair_out():
    masks = simhash.block_masks()
    assert len(masks) == 35
    random.seed(1)
    for _ in range(500):
        difference = sum(1 << b for b in random.sample(range(64), 4))
        assert any(difference & m == 0 for m in masks)


def test_groups_equal_brute_force(spark, docs, none):
    rows = simhash.simhash_groups(docs).collect()
    assert keys(rows) == ALL
    prints = {(r["doc_id"], r["fingerprint"]) for r in rows}
    assert (2, "0" * 16) in prints and (7, "0" * 16) in prints
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert group[1] == group[5] == 1 and group[2] == group[3] == group[7] == 2
    assert group[4] == 4 and group[None] is None
    assert simhash.simhash_groups(none).collect() == []


def connected(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def test_links_in_large_buckets_equal_brute_force(spark, monkeypatch):
    """Chunks of 16 members cut the buckets of a group of near copies into many units."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    random.seed(2)
    center = random.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in random.sample(range(64), k))
    bits = {flip(center, random.randint(0, 6)) for _ in range(300)}
    bits |= {random.getrandbits(64) for _ in range(200)}
    bits = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    rows = spark.createDataFrame([(b,) for b in bits], "_bits long")
    found = simhash.components(simhash.fingerprint_links(rows)).collect()
    own = np.array(bits, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= 4
    label = connected(len(bits), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    want = {bits[i]: bits[l] for i, l in enumerate(label)}
    got = {b: b for b in bits} | {r["node"]: r["component"] for r in found}
    assert got == want


def test_one_row_of_each_group_stays(docs, none):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert keys(kept.collect()) == Counter([1, 2, 4, None, 9007199254740993])
    assert simhash.keep_one_per_group(none).collect() == []


def test_near_copies_of_one_group_in_many_units(spark, docs, none, monkeypatch):
    """A chain of near copies whose ends are unlike is one group, in units of eight members, too."""
    for name in ("CHUNK", "SET_CHUNK"):
        monkeypatch.setattr(near_copies, name, 8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((100 - i, " ".join(words)))
        words[5 * i % 300] = f"x{i}"
    table = spark.createDataFrame([*rows, (None, rows[0][1]), (200, "unlike")], "doc_id long, text string")
    assert keys(near_copies.keep_one_per_group(table).collect()) == Counter([41, None, 200])
    kept = near_copies.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert keys(kept.collect()) == Counter([1, 2, 4, None, 9007199254740993])
    assert near_copies.keep_one_per_group(none).collect() == []


@pytest.mark.parametrize("keep", [simhash.keep_one_per_group, near_copies.keep_one_per_group])
def test_unlike_rows_of_one_key_are_judged_each(spark, keep):
    """Key 5 has a text of its own, twice, another of its own, and a copy of key 1's."""
    own, other, copy = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g"
    rows = [(1, copy), (5, own), (5, copy), (5, other), (5, own), (7, other), (5, None)]
    found = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == Counter([(1, copy), (5, own), (5, other), (5, None)])


# --- near vectors ---------------------------------------------------------------------


def test_near_vectors_equal_brute_force(spark):
    random = np.random.default_rng(4)
    base = random.standard_normal((300, 32))
    near = base[:60] + 0.25 * random.standard_normal((60, 32)) * np.linspace(0, 1, 60)[:, None]
    hot = base[0] + 0.02 * random.standard_normal((80, 32))
    vectors = np.concatenate([base, near, hot, base[5:7], 3 * base[7:8]])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32]
    rows += [(1000 + i, b) for i, b in enumerate(bad)] + [(None, vectors[0].tolist())]
    rows += [(5, vectors[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = itq.near_vectors(table.withColumn("_class", F.lit(1))).collect()
    assert Counter(r["vec_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        if r["vec_id"] is None or r["vec_id"] >= 1000:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    good = [r for r in rows if r[0] is not None and r[0] < 1000]
    unit = np.array([v for _, v in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    got = Counter((r["vec_id"], r["n_links"]) for r in found if r["vec_id"] in range(1000))
    true = int(links.sum())
    assert 0.9 * true <= sum(r["n_links"] for r in found) <= true
    label = connected(len(good), [(a, b) for a, b in zip(*np.nonzero(links)) if a < b])
    ids = [k for k, _ in good]
    want = {k: min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i, k in enumerate(ids)}
    same = sum(r["component_id"] == want[r["vec_id"]] for r in found if r["vec_id"] in want)
    assert same >= 0.97 * len(good) and sum(got.values()) == len(good)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq.near_vectors(empty).collect() == []


def _sample(n, d, shared, seed=1):
    """Unit vectors with a common direction; `shared` is about their median cosine."""
    random = np.random.default_rng(seed)
    own = random.standard_normal((n, d)) / np.sqrt(d)
    common = np.eye(d)[0] * np.sqrt(shared / max(1e-9, 1 - shared))
    vectors = own + common
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize("shared", [0.0, 0.7])
@pytest.mark.parametrize("n", [2_000, 50_000, 10_000_000])
def test_codes_are_balanced_and_find_planted_pairs(n, shared):
    """Pairs of 0.90 to 0.92 around vectors that the codes have not seen; buckets stay small."""
    sample = _sample(21_500, 64, shared)
    learned, others = sample[:12_000], sample[12_000:]
    codes = itq.learn_codes(learned, n, 0.9, itq.RECALL)
    for cosine in (0.9, 0.92):
        pairs = itq.planted_pairs(others, cosine, seed=3)
        met = (itq.shared_keys(*(codes.keys(p) for p in pairs)) < np.iinfo(np.int64).max).any(axis=1)
        near = itq.code_distance(*(codes.whole(p) for p in pairs)) <= codes.distance
        assert (met & near).mean() >= 0.95
    if shared == 0.0:
        assert 2 * codes.tables <= 60
    if n == 50_000:
        own, _ = codes.keys(sample)
        largest = max(np.unique(keys, return_counts=True)[1].max() for keys in own.T)
        assert largest <= 0.01 * len(sample) + 20


def test_near_vectors_with_a_common_direction(spark):
    """Recall of planted pairs end to end, where the median cosine is 0.5."""
    base = _sample(4000, 32, 0.5)
    pairs = itq.planted_pairs(base[:400], 0.91, seed=5)
    vectors = np.concatenate([base[400:], *pairs])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = (vectors @ vectors.T >= 0.9) & ~np.eye(len(vectors), dtype=bool)
    found = sum(r["n_links"] for r in itq.near_vectors(table).collect())
    assert 0.95 * links.sum() <= found <= links.sum() and links.sum() >= 800


@pytest.mark.parametrize("d", [1, 2, 5])
def test_vectors_of_few_dimensions(spark, d):
    random = np.random.default_rng(d)
    vectors = random.standard_normal((60, d))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.9).sum()) - 60
    found = sum(r["n_links"] for r in itq.near_vectors(table).collect())
    assert 0.9 * links <= found <= links


def test_rotations_are_orthogonal():
    sample = np.random.default_rng(0).standard_normal((500, 16))
    for r in itq.learn_rotations(sample, 3):
        assert np.allclose(r @ r.T, np.eye(16))


# --- classifier -----------------------------------------------------------------------


def test_classifier_answers_every_row(spark, docs, none, labels):
    learn = remainder("doc_id", 4) != 2
    rows = classifier.classify(docs, labels, learn).collect()
    assert keys(rows) == ALL and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert classifier.classify(none, labels, learn).collect() == []
    unlabelled = spark.createDataFrame([], NO_LABELS)
    assert {r["score"] for r in classifier.classify(docs, unlabelled, learn).collect()} == {0.5}


def test_discriminant_by_hand(spark):
    random = np.random.default_rng(1)
    d = len(classifier.FEATURES)
    x = np.concatenate([random.normal(0, 1, (400, d)), random.normal(1.5, 2, (200, d))])
    y = np.array([0] * 400 + [1] * 200)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>")
    marks = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id long, quality int")
    model = classifier.fit(stats, marks, F.lit(True))
    for c in (0, 1):
        own, pooled = np.cov(x[y == c].T, bias=True), sum((y == k).mean() * np.cov(x[y == k].T, bias=True) for k in (0, 1))
        mixed = (1 - classifier.POOLED) * own + classifier.POOLED * pooled
        spread = np.diag(pooled)
        level = np.trace(mixed / np.sqrt(np.outer(spread, spread))) / d
        cov = (1 - classifier.SHRUNK) * mixed + classifier.SHRUNK * level * np.diag(spread)
        away = x[:5] - x[y == c].mean(axis=0)
        want = np.log((y == c).mean()) - 0.5 * (
            np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.linalg.slogdet(cov)[1]
        )
        assert np.allclose(model.classes[c].log_density(x[:5]), want, atol=1e-4)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_statistics_of_odd_texts():
    for text in (b"", b" ", b"a", b"\n\n", b"!!!", "ÄÖÜ".encode(), b"a a a a", LONG.encode()):
        found = classifier.statistics(text)
        assert len(found) == len(classifier.FEATURES) and np.isfinite(found).all()


# --- toxicity -------------------------------------------------------------------------


def test_toxicity_answers_every_row(spark, docs, none, labels):
    model = toxicity.train(docs, labels, remainder("doc_id", 3) != 1)
    rows = toxicity.score(docs, model).collect()
    assert keys(rows) == ALL and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).collect() == []
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and keys(clean.collect()) == ALL
    empty = toxicity.train(none, spark.createDataFrame([], NO_LABELS), F.lit(True))
    assert empty.terms == ()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    random.seed(8)
    terms = ["scum", "idiot", "moron", "worthless", "disgusting", "idiots", "abc"]
    automaton = toxicity.TermAutomaton(terms, most_states=300)
    for _ in range(3000):
        word = list(random.choice(terms))
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(word) + 1)
            what = random.choice("idx")
            if what == "i":
                word.insert(at, random.choice("abcdimost"))
            elif word and at < len(word):
                word[at : at + 1] = [] if what == "d" else random.choice("abcdimost")
        word = "".join(word)
        near = [(edits(word, t), t) for t in terms if edits(word, t) <= toxicity.allowed_edits(t)]
        want = min(near)[::-1] if near else None
        assert automaton.match(word) == want, word


def test_quotation_is_told_from_abuse():
    find = toxicity.Scanner(["moron"], frozenset())
    plain, misspelled, quoted, addressed, _ = find.features("you are a m0ron and a morron , too")
    assert plain > 0 and misspelled > 0 and quoted == 0 and addressed > 0
    for text in ('he wrote "a moron" there', "the word moron is old", "“moron” was said"):
        plain, misspelled, quoted, *_ = find.features(text)
        assert plain == misspelled == 0 and quoted > 0
    assert find.features("") == find.features("a clean text") == [0.0] * 5


@pytest.mark.parametrize("term", ["xyz", "q", "t" * 45])
def test_terms_of_any_length_are_learned(spark, term):
    random.seed(8)
    common = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        words = random.choices(common, k=60)
        if i % 4 == 0:
            for at in random.sample(range(60), 4):
                words[at] = term
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = remainder("doc_id", 3) != 1
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), learn)
    assert model.terms == (term,)
    scored = toxicity.score(table, model).collect()
    assert [r["predicted"] for r in sorted(scored)] == [t for *_, t in rows]


def test_learned_terms_catch_unseen_documents(spark):
    random.seed(6)
    common = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        words = random.choices(common, k=80)
        if i % 5 == 0:
            for at in random.sample(range(80), 5):
                words[at] = random.choice(["worthless", "pathetic", "clown"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = remainder("doc_id", 3) != 1
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), learn)
    assert set(model.terms) == {"worthless", "pathetic", "clown"}
    scored = toxicity.score(table, model).collect()
    assert [r["predicted"] for r in sorted(scored)] == [t for *_, t in rows]
    odd = spark.createDataFrame([(1, "a pathetc clwn"), (2, "worthles wortless")], "doc_id long, text string")
    assert all(r["predicted"] == 1 for r in toxicity.score(odd, model).collect()[1:])


def test_all_words_near_a_term_are_ordinary(spark):
    letters, term = "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponm"
    words = {
        term[:i] + a + term[i + 1 : j] + b + term[j + 1 :]
        for i in range(14) for j in range(i + 1, 14) for a in letters for b in letters
    } | {term[:i] + a + term[i:j] + b + term[j:] for i in range(14) for j in range(i, 14) for a in letters for b in letters}
    words = sorted(words - {term})
    assert len(words) > 100_000
    counted = spark.createDataFrame([(w, 0, 1) for w in words], "word string, toxic long, clean long")
    assert toxicity._near_by_chance(counted, (term,)) == frozenset(words)


# --- quality rules --------------------------------------------------------------------


def slow_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)})


def test_measures_equal_a_loop(spark, docs, none):
    random.seed(4)
    made = [(100 + i, " ".join(random.choices("ab#c\n", k=random.randint(0, 60)))) for i in range(60)]
    table = docs.unionByName(
        spark.createDataFrame([(k, t, None, "", 0, 0.0, 0) for k, t in made], SCHEMA)
    ).withColumn("n_words", F.lit("clash"))
    rows = quality_rules.quality_rules(table).collect()
    want = Counter()
    for key, text in TEXTS + made:
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        lines = [line for line in text.split("\n") if line.encode().split()]
        n, repeats = len(words), slow_repeats(words)
        symbols = sum(text.count(s) for s in "#*$%&|<>")
        failed = n < 50 or 100 * repeats > 50 * n
        row = (key, n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed)
        want[row] += 1
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert Counter(tuple(r[c] for c in names) for r in rows) == want
    assert not any(r["kept"] and (r["base_failed"] or r["failed_rules"]) for r in rows)
    assert quality_rules.quality_rules(none).collect() == []
    good = quality_rules.keep_good(table)
    assert good.columns == table.columns


def test_rules_are_one_projection(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- preference -----------------------------------------------------------------------


def test_preferences_by_hand(spark):
    turns = "array<struct<role:string,text:string>>"
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no <|end|>")
    rows = [
        (1, [a, b], [a, c]),
        (2, [a, b], [a, b]),
        (3, None, [a]),
        (4, [a], None),
        (5, [], []),
        (6, [a, (None, None)], [a, None]),
        (7, [a, b, a, b], [a, b]),
        (1, [a, b], [a, c]),
    ]
    table = spark.createDataFrame(rows, f"k int, chosen {turns}, rejected {turns}")
    found = preference.format_preferences(table.withColumn("prompt", F.lit("clash"))).collect()
    hi, yes = "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n"
    no = "<|assistant|>\nno <​|end|><|end|>\n"
    got = sorted(
        (r["k"], r["n_common"], r["prompt"], r["chosen_text"], r["rejected_text"]) for r in found
    )
    assert got == [
        (1, 1, hi, yes, no),
        (1, 1, hi, yes, no),
        (2, 2, hi + yes, "", ""),
        (3, 0, "", "", hi),
        (4, 0, "", hi, ""),
        (5, 0, "", "", ""),
        (6, 2, hi + "<|user|>\n<|end|>\n", "", ""),
        (7, 2, hi + yes, hi + yes, ""),
    ]
    spans = {r["k"]: [tuple(s) for s in r["chosen_spans"]] for r in found}
    assert spans[1] == [(14, 25)] and yes[14:25] == "yes<|end|>\n"
    assert spans[7] == [(len(hi) + 14, len(hi) + 25)] and spans[4] == []


def test_preferences_are_native(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (2, 0, None, None), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = preference.format_preferences(preference.stale_reply_pairs(turns))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    by_key = {r["conv_id"]: r for r in made.collect()}
    assert by_key[1]["n_common"] == 1 and "q<|end|>" in by_key[1]["rejected_text"]
    assert by_key[2]["chosen_text"] == "" and set(by_key) == {1, 2, None}
    assert preference.format_preferences(preference.stale_reply_pairs(turns.limit(0))).collect() == []


def test_large_conversations_are_rows_of_turns(spark, monkeypatch):
    """Parts in order of place are what the whole row has; a large conversation is in no row."""
    random.seed(4)
    rows = [(k, t, random.choice(["user", "assistant", None]), random.choice(["a <|b", "cc", None]))
            for k, n in ((1, 40), (2, 3), (None, 50), (3, 12), (4, 11)) for t in range(n)]
    rows += [(5, 0, "user", "q")] * 30 + [(6, 0, "assistant", "r")] + [(6, 1, "user", "s")] * 20
    rows += [(7, t, "user", "x") for t in range(14)] + [(7, 14, "assistant", "y"), (7, 15, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = preference.format_preferences(preference.stale_reply_pairs(turns)).collect()
    schema = preference.stale_reply_preferences(turns).schema
    assert {r["place"] for r in preference.stale_reply_preferences(turns).collect()} == {None}
    monkeypatch.setattr(preference, "WHOLE_TURNS", 11)
    monkeypatch.setattr(preference, "BLOCK", 7)
    made = preference.stale_reply_preferences(turns)
    assert made.schema.simpleString() == schema.simpleString()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "place" in made.columns
    parts = {}
    for r in made.collect():
        parts.setdefault(r["conv_id"], []).append(r)
    assert set(parts) == {r["conv_id"] for r in whole}
    for w in whole:
        own = sorted(parts[w["conv_id"]], key=lambda r: r["place"] or 0)
        size = sum(r[0] == w["conv_id"] for r in rows)
        assert [r["place"] for r in own] == ([None] if size <= 11 else list(range(size)))
        assert {r["n_common"] for r in own} == {w["n_common"]}
        for name in ("prompt", "chosen_text", "rejected_text"):
            assert "".join(r[name] for r in own) == w[name]
        for name in ("chosen_spans", "rejected_spans"):
            assert [tuple(s) for r in own for s in r[name]] == [tuple(s) for s in w[name]]
