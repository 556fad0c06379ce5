"""The pipeline: what each stage keeps, on whole small tables and on awkward rows."""

import corpus_pipeline as C
import public_tokenizers as P
import pyarrow.parquet as pq
from fixtures import awkward, texts
from test_dedup import brute_lines, brute_neardup, brute_spans, words_of
from test_tokens import check_packing
from tokenizers import Tokenizer

from tickloom.llm import quality, substring

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, texts()
    for no, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{no}")
        out = spark.read.parquet(f"{tmp_path}/{no}")
        if name == "best-fit packing":
            check_packing(out.collect(), left, Tokenizer.from_file(P.path("word_bpe_49k.json")))
            continue
        assert out.columns == columns
        rows = out.collect()
        assert all(r.n_chars == len(r.text) for r in rows)
        got = {r.doc_id: r.text for r in rows}
        if name == "quality classifier":
            labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
            known = dict(zip(labels["doc_id"], labels["quality"], strict=True))
            assert sum((i in got) == known[i] for i in known) > 0.9 * len(known)
            assert all(left[i] == t for i, t in got.items())
        elif name == "line dedup":
            ids = sorted(left)
            cut = dict(zip(ids, brute_lines([left[i] for i in ids], 2), strict=True))
            assert got == {i: t for i, t in cut.items() if t == left[i] or t.strip()}
        elif name == "MinHash near-dedup":
            assert got == {i: left[i] for i, x in brute_neardup(left, 5).items() if x[3]}
        else:
            monkeypatch.setattr(substring, "STRETCH", 1)  # for brute_spans() only: units begin at every word
            for i, gone in brute_spans(left).items():
                cut = words_of("".join(c if k not in gone else " " for k, c in enumerate(left[i])))
                assert words_of(got.get(i, "")) == cut and (i in got or not cut), i
        docs, left = out, got


def test_awkward_documents_pass_through(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "a\nb"), (4, "a\nb"), (5, "a\nb\nc"), (6, "one two"), (6, "one two")]
    docs = awkward(spark, rows).withColumnRenamed("source", "a.b")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.fit(docs, labels).prior == 0.5
    for no, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{no}")
        out = spark.read.parquet(f"{tmp_path}/{no}")
        if name != "best-fit packing":
            assert set(out.columns) == set(docs.columns)
            docs = out
    assert sorted((str(r.doc_id), r.length > 0) for r in out.collect()) == [("1", True), ("2", True), ("3", True), ("5", True), ("6", True), ("None", True)]


def test_run_ends_in_sequences(spark):
    out = C.run(spark, SF)
    assert out.count() and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    text = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    rows = [(1, text[0]), (2, text[0] + " end"), (2, text[1]), (3, text[1] + " end"), (3, text[1] + " end"), (4, text[2]), (4, text[2]), (None, text[0]), (None, text[0]), (5, ""), (5, "")]
    got = C.drop_near_duplicates(spark, awkward(spark, rows), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, text[0]), (2, text[1]), (4, text[2]), (None, text[0]), (None, text[0]), (5, "")], key=str)
