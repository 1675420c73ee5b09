"""The pipeline on tables with nulls, repeated rows, clashing columns, and on an empty one."""

import os

import corpus_pipeline

GOOD = "The council met on a cold morning to decide how the old harbour should be mended before the winter storms arrive again"
OTHER = "Farmers in the northern valley report that apples ripened early this year although rain had been scarce since late spring"
THIRD = "Many readers have asked us how a small telescope can be built at home with two lenses and a tube of stiff cardboard"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, id long, key string, batch int, _text_hash long, quality double, bucket string"


def folder(spark, tmp_path, rows):
    for name in ("labels", "benchmark"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.createDataFrame([(i, t, None, None, n, 1, "k", 2, 3, 4.0, "b") for i, t, n in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_odd_rows_through_all_stages(spark, tmp_path):
    rows = [(1, GOOD, None), (1, GOOD, None), (2, OTHER + ". Write to ann.lee@example.org or call", 7), (None, GOOD, 3), (None, THIRD, None), (None, None, None), (3, None, None), (4, "", 0), (5, " \t\n", 1), (6, "too short", 9)]
    sf, seen = folder(spark, tmp_path, rows), {}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == 4 or now.columns == columns
        seen[name] = sorted(((r.doc_id or 0, getattr(r, "text", "")) for r in now.collect()))
    assert seen["quality"] == sorted((i or 0, t) for i, t, _ in rows if t and len(t.split()) >= 10)
    assert [i for i, _ in seen["simhash"]] == [0, 1, 2] and seen["simhash"] == seen["decontamination"]
    kept = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert "ann.lee@example.org" not in kept[2].text and kept[2].text.startswith(OTHER) and kept[2].n_chars == len(kept[2].text)
    assert kept[1].text == GOOD and kept[1].n_chars is None and kept[None].text == THIRD
    assert all((r.id, r.key, r.batch, r._text_hash, r.quality, r.bucket) == (1, "k", 2, 3, 4.0, "b") for r in kept.values())
    assert {i for i, _ in seen["packing"]} == {0, 1, 2}


def test_an_empty_table_gives_no_piece(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
