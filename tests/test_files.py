import json

import pytest
from pyspark.sql.types import LongType

from condensa.operators.encode import encode_examples
from condensa.operators.vocab import vocab_from_mapping
from condensa.session import CHECKPOINT_SETTING, materialize, new_path, shared_dir
from condensa.plans import prepare
from condensa.sources import articles, examples as files, report
from condensa.streaming.incremental import article_stream, encode_new_articles


def part_lines(path):
    names = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return [line for p in names for line in p.read_bytes().decode().splitlines()]


def test_articles_read_named_fields_only(spark, tmp_path):
    lines = [{"id": 7, "abstract": "A", "text": "Č\nd", "extra": [1]}, {"id": "x1", "text": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = articles.read_articles(spark, str(tmp_path), ["text", "abstract"], key="id")
    assert df.columns == ["id", "text", "abstract"]
    assert {tuple(r) for r in df.collect()} == {("7", "Č\nd", "A"), ("x1", None, None)}


def test_articles_without_a_usable_id_are_refused(spark, tmp_path):
    source = write_lines(tmp_path / "in", [{"id": 1, "text": "a"}, {"text": "b"}])
    with pytest.raises(Exception, match="no usable id"):
        articles.read_articles(spark, source, ["text"], key="id").select("text").collect()
    texts = write_lines(tmp_path / "texts", [{"id": "x1", "text": "a"}])
    with pytest.raises(Exception, match="no usable id"):
        articles.read_articles(spark, texts, ["text"], "id", LongType()).collect()


def test_articles_without_id_are_numbered(spark, tmp_path):
    source = write_lines(tmp_path / "in", [{"text": f"t{i}"} for i in range(50)])
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(json.dumps({"text": f"u{i}"}) for i in range(5)))
    df = articles.numbered(articles.read_articles(spark, source, ["text"]))
    assert [(r["doc_id"], r["text"]) for r in sorted(df.collect(), key=lambda r: r["doc_id"])] == list(
        enumerate([f"t{i}" for i in range(50)] + [f"u{i}" for i in range(5)])
    )


def test_articles_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"\n\\ž')], "doc_id long, text string")
    articles.write_articles(df, str(tmp_path / "a"))
    read = articles.read_articles(spark, str(tmp_path / "a"), ["text"], "doc_id", LongType())
    assert read.collect() == df.collect()


def test_normalized_csv(spark, tmp_path):
    df = spark.createDataFrame([('He said: "A, b"!', "", 1)], "source string, target string, x int").coalesce(1)
    path = tmp_path / "n"
    articles.write_normalized_csv(df, ["source", "target"], str(path))
    assert part_lines(path) == ["source,target", '"he said "" a , b "" !",']
    read = articles.read_normalized_csv(spark, str(path), ["source", "target"])
    assert [tuple(r) for r in read.collect()] == [('he said " a , b " !', "")]


def test_sentences_in_document_order(spark, tmp_path):
    rows = [(i, f"Doc {i}. Second\nline? Third.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = tmp_path / "s"
    articles.write_sentences(df, str(path), proportion=0.5)
    expected = [s for i in range(20) for s in (f"doc {i}.", "second line?", "third.")]
    assert part_lines(path) == expected
    assert articles.read_lines(spark, str(path)).count() == 60


def odd_examples(spark):
    vocab = vocab_from_mapping(spark, {"a": 4})
    pairs = [(1, "a \" , o'neil \" b", "a , b"), (2, "", ""), (3, "a a", "zz")]
    df = spark.createDataFrame(pairs, "doc_id long, source string, target string")
    return encode_examples(df, vocab, 5, 8, 4, 6)


def example_rows(df):
    return sorted((r["x"], r["y"], r["oov_cnt"], sorted(r["oov"].items())) for r in df.collect())


def test_ragged_csv(spark, tmp_path):
    examples, path = odd_examples(spark), tmp_path / "r"
    files.write_examples_csv(examples, str(path))
    first = next(line for line in part_lines(path) if '"' in line)
    assert first.startswith("4,6,7,8,6,9,0,0,4,7,9,2,4,\"\"\"\",6,\",\",7,o'neil,8,b,9")
    read = files.read_examples_csv(spark, str(path), 8, 4, 6)
    assert example_rows(read) == example_rows(examples)


def test_ragged_csv_does_not_lose_words(spark, tmp_path):
    files.write_examples_csv(odd_examples(spark), str(tmp_path / "r"))
    for cap in (1, 2, 3):
        read = files.read_examples_csv(spark, str(tmp_path / "r"), 8, 4, cap)
        for columns in (["x"], ["x", "oov"], read.columns):
            with pytest.raises(Exception, match=f"more than {cap}"):
                read.select(*columns).collect()
    keyed = files.read_examples_csv(spark, str(tmp_path / "r"), 8, 4, 6, key="row")
    assert sorted(r["row"] for r in keyed.collect()) == [0, 1, 2]


def test_examples_parquet(spark, tmp_path):
    examples = odd_examples(spark)
    files.write_examples(examples, str(tmp_path / "e"))
    assert example_rows(files.read_examples(spark, str(tmp_path / "e"))) == example_rows(examples)


def test_report(spark, tmp_path):
    averages = spark.createDataFrame(
        [("rouge-2", 0.1, 0.2, 0.3), ("rouge-1", 0.4, 0.5, 0.6)],
        "metric string, r double, p double, f double",
    )
    samples = spark.createDataFrame(
        [(9, "t9", 'r"9', "p9"), (2, "t2", "r2", "p2")],
        "doc_id long, text string, ref_summary string, pred_summary string",
    )
    path = str(tmp_path / "report")
    report.write_report(averages, samples, {"bw": 4}, path)
    read = report.read_report(spark, path)
    assert read[0]["rouge-1"] == {"r": 0.4, "p": 0.5, "f": 0.6}
    assert read[1] == {"bw": 4}
    assert [s["text"] for s in read[2:]] == ["t2", "t9"]
    assert read[3]["ref_summary"] == 'r"9'


def test_new_files_are_encoded_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    vocab = vocab_from_mapping(spark, {"a": 4})

    def arrive(doc_id):
        rows = [(doc_id, "a b a", "b c")]
        new = spark.createDataFrame(rows, "doc_id long, source string, target string")
        new.write.mode("append").json(source)
        stream = article_stream(spark, source, ["source", "target"], "doc_id", LongType())
        encode_new_articles(stream, vocab, 5, 4, 3, 2, out, state).awaitTermination(120)
        return sorted((r["doc_id"], r["x"], r["y"]) for r in files.read_examples(spark, out).collect())

    joined = str(tmp_path / "joined")
    assert arrive(1) == [(1, [4, 6, 4, 0], [6, 3, 2])]
    assert arrive(2) == [(1, [4, 6, 4, 0], [6, 3, 2]), (2, [4, 6, 4, 0], [6, 3, 2])]
    stream = article_stream(spark, source, ["source", "target"], "doc_id", LongType())
    run = encode_new_articles(
        stream, vocab, 5, 4, 3, 2, joined, str(tmp_path / "state2"), lookup="join"
    )
    run.awaitTermination(120)
    read = files.read_examples(spark, joined)
    assert example_rows(read) == example_rows(files.read_examples(spark, out))


def write_lines(path, rows):
    path.mkdir()
    (path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(path)


ARTICLES = [
    {"doc_id": 2, "body": "B. Zz\nzz.", "lead": "Zz b"},
    {"doc_id": 1, "body": "A b? C.", "lead": "B \"q\""},
]


def test_prepare_examples(spark, tmp_path):
    source = write_lines(tmp_path / "in", ARTICLES)
    vocab = vocab_from_mapping(spark, {"a": 4, "b": 5})
    for form, out in (("parquet", tmp_path / "p"), ("csv", tmp_path / "c")):
        prepare.prepare_examples(
            spark, source, str(out), ("body", "lead"), vocab, 6, 6, 4, 3, form=form
        )
    expected = [
        ([4, 5, 7, 8, 9, 0], [5, 3, 3, 2], 3, [(7, "?"), (8, "c"), (9, ".")]),
        ([5, 7, 8, 8, 7, 0], [8, 5, 2, 0], 2, [(7, "."), (8, "zz")]),
    ]
    assert example_rows(files.read_examples(spark, str(tmp_path / "p"))) == expected
    read = files.read_examples_csv(spark, str(tmp_path / "c"), 6, 4, 3)
    assert example_rows(read) == expected


def test_prepare_texts(spark, tmp_path):
    source = write_lines(tmp_path / "in", ARTICLES)
    prepare.prepare_sentences(spark, source, str(tmp_path / "s"), field="body")
    assert part_lines(tmp_path / "s") == ["a b?", "c.", "b.", "zz zz."]
    prepare.prepare_normalized(spark, source, str(tmp_path / "n"), ["lead"])
    read = articles.read_normalized_csv(spark, str(tmp_path / "n"), ["lead"])
    assert sorted(r["lead"] for r in read.collect()) == ['b " q "', "zz b"]


class Unset:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master, self.folder = master, None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder(spark):
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")
    written = materialize(spark.range(3))
    assert sorted(r["id"] for r in written.collect()) == [0, 1, 2]
    assert written.inputFiles()[0].split("://")[-1].startswith(shared_dir(spark).split("://")[-1])


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(Unset("yarn"))
    local = Unset("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.folder


def test_broken_lines_are_told_apart(spark, tmp_path, monkeypatch):
    """Lines of two files, read in many splits: good ones unharmed, bad ones with file and line."""
    want, good = set(), []
    for name, n in (("a.json", 400), ("b.json", 90)):
        lines = []
        for i in range(1, n + 1):
            kind = i % 11
            line = {
                0: '{"id": 1, "text": "cut',
                1: "not json",
                2: '{"text": "no id"}',
                3: '{"id": "word", "text": "t"}',
                4: "",
                5: "[1, 2]",
            }.get(kind) if i % 3 == 0 else None
            if line is None:
                line = '{"id": %d, "text": "t%d \\u00e9", "more": [1]}' % (i, i)
                good.append((i, f"t{i} é"))
            elif line:
                want.add((name, i, line, "no key" if kind == 2 else "broken"))
            lines.append(line)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = articles.split_articles(spark, str(tmp_path), ["text"], "id", LongType())
        bad = {(r["file"].rsplit("/", 1)[1], r["line"], r["value"], r["reason"]) for r in found.bad.collect()}
        assert sorted(map(tuple, found.good.collect())) == sorted(good)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == want and found.bad.count() == len(want)
    named = articles.split_articles(spark, str(tmp_path), ["text"])
    assert "no key" not in {r["reason"] for r in named.bad.collect()}


def test_a_report_has_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "MAX_SAMPLES", 2)
    samples = spark.createDataFrame([(i, "t", "r", "p") for i in range(3)], "doc_id int, text string, ref_summary string, pred_summary string")
    averages = spark.createDataFrame([("rouge-1", 1.0, 1.0, 1.0)], "metric string, r double, p double, f double")
    with pytest.raises(ValueError):
        report.write_report(averages, samples, {}, str(tmp_path / "r"))
    report.write_report(averages, samples.limit(2), {}, str(tmp_path / "r"))
    assert len(report.read_report(spark, str(tmp_path / "r"))) == 4


def test_rows_of_split_files_are_numbered_as_arrays(spark, tmp_path):
    source, size = tmp_path / "in", "spark.sql.files.maxPartitionBytes"
    source.mkdir()
    lines = {name: [f"{i},{len(name)},2,0" for i in range(n)] for name, n in (("b", 900), ("a1", 7), ("c", 300))}
    for name, rows in lines.items():
        (source / f"{name}.csv").write_text("\n".join(rows) + "\n")
    usual = spark.conf.get(size)
    spark.conf.set(size, "2000")
    try:
        read = files.read_examples_csv(spark, str(source), 2, 1, 1, key="row")
        got = sorted((r["row"], r["x"]) for r in read.collect())
    finally:
        spark.conf.set(size, usual)
    want = [[i, len(name)] for name in sorted(lines) for i in range(len(lines[name]))]
    assert got == list(enumerate(want))
    # what was written for the numbers are the arrays, not the columns of the file
    assert "c0" not in read._jdf.queryExecution().executedPlan().toString()
