"""What must not follow the corpus, or one key: ranges of packing, levels of the cascade, the lines a field learns from, pictures drawn and searched for corners, pairs laid out; and every SQL text of the folder against its query."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import image_copies, line_crf, packing, sample_media, url_cascade
from millrace.llm.common import importable
from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "benchmark", "conversations", "embeddings")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_equals_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(want.select(*[f'"{c}"' for c in names]).fetchall())


@pytest.mark.parametrize("text", ["concat('words that differ ', id)", "'one text alone that all rows share'"])
def test_packing_deals_rows_of_one_doc_id(spark, text):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.expr(text).alias("text"))
    sizes = importable(lambda s: packing.along_curve(docs))(spark).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and len(sizes) >= 3 and max(r["count"] for r in sizes) < 12_000


def test_packing_weighs_ranges_by_bytes(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.repeat(F.concat(F.lit("heavy "), (F.col("id") % 7).cast("string"), F.lit(" ")), 200)).otherwise(F.concat(F.lit("light "), F.col("id").cast("string"))).alias("text"))
    sizes = importable(lambda s: packing.along_curve(docs))(spark).groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(sizes) >= 3 and max(r.n for r in sizes) < 0.6 * sum(r.n for r in sizes)


def test_cascade_follows_the_list_not_the_universe(spark):
    listed = spark.range(100).select(F.concat(F.lit("k"), (F.col("id") * 7).cast("string")).alias("key"))
    words = []
    for n in (30_000, 300_000):
        universe = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
        cascade = url_cascade.build(listed, universe)
        words.append(sum(len(level.words) for level in cascade.levels))
        wrong = universe.select("key", cascade.lists(F.col("key")).alias("in")).where(F.col("in") != ((F.substring("key", 2, 9).cast("long") % 7 == 0) & (F.substring("key", 2, 9).cast("long") < 700)))
        assert wrong.count() == 0
    assert words[1] <= 1.5 * words[0] and words[1] <= 100 * math.log2(300_000) * 3 / 64


def test_field_learns_beside_an_overlong_document(spark):
    good, bad = "this is a fine line of words\nand another one of them follows here", "BAD!! &&& $$$ ###\n*** %%% buy buy"
    rows = [(i, good if i % 2 else bad) for i in range(200) if i % 4] + [(100_000 + k, "\n".join([good] * 200)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("BAD"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    model = importable(lambda s: line_crf.learn(docs, labels, most_lines=380))(spark)
    got = {r.text: r.score for r in importable(lambda s: line_crf.score(docs.dropDuplicates(["text"]), model))(spark).collect()}
    assert model.slope > 0 and got[bad] < 0.5 < got[good]


@pytest.mark.parametrize("kind", [0, 1])
def test_labels_of_one_kind_give_that_kind(spark, kind):
    docs = spark.createDataFrame([(i, "a line of words") for i in range(40)], "doc_id long, text string")
    model = importable(lambda s: line_crf.learn(docs, docs.select("doc_id", F.lit(kind).alias("quality"))))(spark)
    assert {round(r.score) for r in importable(lambda s: line_crf.score(docs, model))(spark).collect()} == {kind}


def test_images_searched_together_have_the_corners_of_each():
    shown = [sample_media.draw([float(k)]) for k in range(5)]
    images = [*shown, sample_media.edited(shown[0], "half"), None, np.zeros((3, 3)), np.zeros((0, 4)), sample_media.edited(shown[1], "half"), np.full((96, 96), 7.0)]
    got = image_copies.packed_corners(images)
    assert got == [image_copies.packed(image_copies.corners(x)) if x is not None and x.size else b"" for x in images]
    assert all(map(len, got[:6])) and not any(map(len, (got[6], got[7], got[8], got[10])))
    assert (sample_media.draw_all([[float(k)] for k in range(5)]) == np.stack(shown)).all()


def test_equal_images_are_searched_once(spark):
    """Forty rows show four pictures and an edit of one; a null id first, and the least id last, so that another row has the corners."""
    shown = [sample_media.draw([float(k)]) for k in range(4)]
    shown.append(sample_media.edited(shown[2], "gamma"))
    rows = [(None, bytearray(image_copies.encode(shown[0])))] + [(40 - k, bytearray(image_copies.encode(shown[k % 5]))) for k in range(40)]
    for parts in (1, 3):
        media = spark.createDataFrame(rows, "id long, image binary").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "id long, image binary").coalesce(1)
        held = image_copies.described(media, "id", "image", pack=True).where("corners is not null")
        assert held.where("id is null").count() == 0 and held.select("sha").distinct().count() == 5 and held.count() <= 5 * parts
        got = {r.id: (r.class_id, r.n_links) for r in image_copies.copies(media).collect()}
        least = [min(40 - k for k in range(c, 40, 5)) for c in range(5)]
        least[2] = least[4] = min(least[2], least[4])
        assert got == {None: (None, 0)} | {40 - k: (least[k % 5], 15 if k % 5 in (2, 4) else 7) for k in range(40)}


def test_equal_vectors_are_drawn_by_one_task(spark, monkeypatch):
    vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 8).cast("float")).alias("embedding"))
    at = lambda: sample_media.drawn(vectors).withColumn("task", F.spark_partition_id()).groupBy("image").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n")).collect()
    got = importable(lambda s: at())(spark)
    assert sum(r.n for r in got) == 400 and max(r.tasks for r in got) == 1 < max(r.n for r in got)
    monkeypatch.setattr(sample_media, "LOT", 5)
    assert max(r.tasks for r in importable(lambda s: at())(spark)) > 1


def test_pairs_are_laid_out_part_after_part(spark, monkeypatch):
    shown = [sample_media.draw([float(k)]) for k in range(3)]
    images = {i: x for i, x in enumerate([*shown, *(sample_media.edited(x, e) for x in shown for e in ("gamma", "noise"))])}
    media = spark.createDataFrame([(i, bytearray(image_copies.encode(x))) for i, x in images.items()], "id long, image binary")
    written, keep = [], image_copies.stored
    monkeypatch.setattr(image_copies, "stored", lambda df, name: written.append(name) or keep(df, name))
    whole = {tuple(r) for r in image_copies.copies(media).collect()}
    monkeypatch.setattr(image_copies, "LAID", 2)
    assert {tuple(r) for r in image_copies.copies(media).collect()} == whole == {(i, i if i < 3 else (i - 3) // 2, 2) for i in range(9)}
    assert written.count("judged") >= 3
