"""The pipeline over odd tables: each case has the result that the stages' docstrings state."""

import corpus_pipeline as cp


def write(spark, at, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_text string, bin long, `score` int, row string, component string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return docs


def stages(spark, at):
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/{name}")
        after = spark.read.parquet(f"{at}/{name}")
        if k < len(cp.STAGES) - 1:
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        docs = after
        out.append(after)
    return out


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert [x.count() for x in stages(spark, tmp_path)] == [0] * 5
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nulls_ties_repeats_and_labels_without_matches(spark, tmp_path):
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    more = ("kept", 7, 3, "r", "c")
    rows = [
        (1, text("a", 60), "en", "s", 500, *more),
        (1, text("a", 60), "en", "s", 500, *more),
        (2, text("a", 60) + " end", "en", None, 1, *more),
        (3, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, *more),
        (None, text("b", 50), "en", "t", 400, *more),
        (None, None, None, None, None, None, None, None, None, None),
        (4, text("c", 3000), None, "t", 20000, *more),
        (5, text("d", 10) + " " + text("a", 40) + " " + text("e", 10), "de", "u", 9, *more),
    ]
    write(spark, tmp_path, rows, [(99, 1, 0), (98, 0, 1), (None, 1, 1), (1, None, None)])
    quality, near, cut, mixed, packed = stages(spark, tmp_path)
    # Without labelled texts nothing is rejected.
    assert quality.count() == len(rows)
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    # The repeated row and the near copy go; rows without words and with null ids stay.
    assert ids(near) == sorted((r[0] is not None, r[0] or 0, r[1] or "") for k, r in enumerate(rows) if k not in (1, 2))
    # The passage that documents 1 and 5 share goes from both; what has no words stays, as nothing was taken from it.
    left = {(r["doc_id"], len((r["text"] or "").split())) for r in cut.collect()}
    assert left == {(1, 20), (5, 20), (3, 0), (None, 50), (None, 0), (4, 3000)}
    assert {r["n_chars"] for r in cut.filter("doc_id = 1").collect()} == {len(r["text"]) for r in cut.filter("doc_id = 1").collect()}
    # Words near the targets; what has no words is in no mix; all of the mix is packed.
    n = sum(len(r["text"].split()) for r in mixed.collect())
    assert abs(n - 1.5 * 3090) <= 3 and sum(r["size"] for r in packed.collect()) == n
    again = sorted(map(str, cp.run(spark, str(tmp_path)).collect()))
    assert len(again) == packed.count()
