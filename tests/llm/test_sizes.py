"""Joins, files and steps that must not grow with the input."""
import random

from pyspark.sql import functions as F

from stockhealth.llm import common, sentencepiece_bpe, suffixes
from stockhealth.llm.queries import model_path
from stockhealth.session import pin


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_never_broadcast(spark):
    rows = spark.range(300).select(F.col("id").alias("_node"), F.explode(F.sequence(F.lit(0), F.lit(27))).alias("_key"))
    dealt = common.cells(rows, ["_key"], 100, F.xxhash64("_node"))
    assert "Broadcast" not in executed(dealt)
    assert dealt.select("_node", "_key", "_b").distinct().count() == 300 * 28
    assert dealt.groupBy("_key", "_x", "_y").count().count() == 28 * 6


def test_many_edges_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "_EDGES", 10)
    found = common.components(spark.createDataFrame([(i, i + 2) for i in range(40)], "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {i: i % 2 for i in range(2, 42)}
    nodes = spark.range(42)
    assert "Broadcast" not in executed(nodes.join(found, F.col("id") == F.col("node"), "left"))


def test_pieces_that_share_an_anchor_alone_do_not_stay(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    common, passage = noise(30), noise(60)
    texts = [(i, noise(100) + common + noise(100)) for i in range(200)] + [(200, noise(80) + passage + noise(80)), (201, noise(80) + passage + noise(80))]
    kept = {}

    def spy(df, name):
        found = pin(df, name)
        kept[name] = found.count()
        return found

    for name in ("pin", "pin_last"):
        monkeypatch.setattr(suffixes, name, spy, raising=False)
    found = suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).where("n_removed > 0").collect()
    assert [(r.doc_id, r.n_removed) for r in found] == [(201, 60)]
    assert 0 < kept["met"] < 20


def test_files_of_a_finished_shuffle_go_at_once(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: set(env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split())
    before = held()
    found = common.pin_last(spark.range(1000).repartition(4, "id"), "rows")
    assert held() <= before and found.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_copies_of_a_text_are_encoded_once(monkeypatch):
    codec, encode, seen = sentencepiece_bpe.Codec.read(model_path()), sentencepiece_bpe.Codec.encode, []
    monkeypatch.setattr(sentencepiece_bpe.Codec, "encode", lambda self, text: seen.append(text) or encode(self, text))
    texts = ["a word", "a word", "", "more words é\n", "a word", "more words é\n"]
    found = sentencepiece_bpe._tokens(codec, texts)
    assert seen == ["a word", "", "more words é\n"] and found["decoded"] == texts
    assert [x.tobytes() for x in found["ids"]] == [encode(codec, t) for t in texts]
