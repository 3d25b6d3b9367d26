from weftarc.sources.warcfile import Writer
from weftarc.streaming import listings


def test_listings(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"{k}.wet.gz", "wb") as f:
            Writer(f).write("conversion", f"a b{k} a".encode(), "text/plain", f"http://h/{k}")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("0.wet.gz\n1.wet.gz\n")

    def go():
        stream = listings.records(spark, str(tmp_path / "in"), f"{tmp_path}/")
        listings.append(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
        listings.word_counts(stream, str(tmp_path / "words"), str(tmp_path / "c2")).awaitTermination(60)

    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "2.txt").write_text("2.wet.gz\n")
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    got = spark.read.parquet(str(tmp_path / "words")).groupBy("key").sum("tf", "df").collect()
    assert {r.key: (r[1], r[2]) for r in got} == {"a": (6, 3), "b0": (1, 1), "b1": (1, 1), "b2": (1, 1)}
