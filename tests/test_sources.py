import bz2

import pytest

from lexloom.sources import readers
from lexloom.streaming import memory
from pyspark.sql import functions as F


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_articles(spark, tmp_path):
    page = lambda title, ns, body, extra="": f"<page><title>{title}</title><ns>{ns}</ns>{extra}<revision><id>7</id><text xml:space='preserve'>{body}</text></revision></page>\n"
    dump = "<mediawiki>" + page("A", 0, "one &lt;ref&gt;n&lt;/ref&gt;{{t {{u}} }}[[b|c]] ''d'' -{x|e}- {| t |}") + page("T", 1, "talk") + page("R", 0, "r", "<redirect title='A' />") + page("B", 0, "two") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(dump.encode()))
    rows = readers.articles(spark, str(tmp_path / "d.xml.bz2")).withColumn("plain", readers.wiki_text(F.col("text"))).orderBy("title").collect()
    assert [(r.title, r.revision) for r in rows] == [("A", 7), ("B", 7)] and rows[0].plain.split() == ["one", "c", "d", "e"]
    assert readers.articles(spark, str(tmp_path / "d.xml.bz2"), 1).count() == 1


def test_lines(spark, tmp_path):
    assert [r.text for r in readers.lines(spark, put(tmp_path / "a.tsv", "x\ty\tz\nq\n")).collect()] == ["z", "q"]
    (tmp_path / "b.txt").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(ValueError):
        readers.lines(spark, str(tmp_path / "b.txt"))
    assert readers.lines(spark, str(tmp_path / "b.txt"), strict=False).count() == 2


def test_rows(spark, tmp_path):
    rows = readers.evaluation_rows(spark, put(tmp_path / "a.txt", "c|台北|t b\n|x\nn|m|o|p\n")).collect()
    assert [tuple(r) for r in rows] == [("c", "台北", ["t", "b"])]
    loose = readers.evaluation_rows(spark, put(tmp_path / "b.txt", "# no\n\nc|g\nc|g|r|s\n"), strict=False).collect()
    assert [tuple(r) for r in loose] == [("c", "g", [""]), ("c", "g", ["r|s"])]
    with pytest.raises(ValueError):
        readers.evaluation_rows(spark, put(tmp_path / "c.txt", "nothing\n"), strict=False)
    got = readers.numbered_rows(spark, put(tmp_path / "d.txt", "﻿|台|r\n\nc|北|s\n")).collect()
    assert [(r.line, r.ctx, r.gold) for r in got] == [(1, "", "台"), (3, "c", "北")]
    for bad in ("a|台\n", "a|x|r\n", "a|台|r\n﻿b|台|r\n", "a|台|r \n"):
        with pytest.raises(ValueError):
            readers.numbered_rows(spark, put(tmp_path / "e.txt", bad))


def test_rowstats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 3, 5), (2, 0, 2, 4)], "row int, ok int, errors int, gold_len int")
    readers.write_rowstats(rows, str(tmp_path / "r"))
    assert [tuple(r) for r in readers.rowstats(spark, str(tmp_path / "r")).orderBy("row").collect()] == [(1, 1, 0, 5), (2, 0, 2, 4)]
    for bad in ("1\t2\t0\t3\n", "1\t1\t0\n", "2\t1\t0\t3\n", "1\t1\tx\t3\n", "1\t1\t0\t３\n"):
        with pytest.raises(ValueError):
            readers.rowstats(spark, put(tmp_path / "bad", bad))


def test_lexicon(spark, tmp_path):
    base, one = put(tmp_path / "base", "a-b 甲 -2.0\na 乙 -1.0\na 丙 -1.0\n"), put(tmp_path / "one", "a\t丁\t-1.0\tx\na\t戊\t-0.5\ty\n")
    got = readers.lexicon(spark, base, [one]).orderBy("reading", "rank").collect()
    assert [(r.reading, r.word, r.layer) for r in got] == [(["a"], "戊", 1), (["a"], "丙", 0), (["a"], "乙", 0), (["a"], "丁", 1), (["a", "b"], "甲", 0)]
    with pytest.raises(ValueError):
        readers.lexicon(spark, base, [put(tmp_path / "two", "a\t丁\t-1\tx\na\t丁\t-2\ty\n")])
    with pytest.raises(ValueError):
        readers.overlay(spark, put(tmp_path / "three", "a\t丁\tq\tx\n"))


def test_scores_and_tables(spark, tmp_path):
    assert readers.scores(spark, put(tmp_path / "s", '{"i": 2, "ng": [1.0]}\n{"i": 1, "masked": [true]}\n')).count() == 2
    with pytest.raises(ValueError):
        readers.scores(spark, put(tmp_path / "t", '{"i": 1}\n{"i": 3}\n'))
    assert readers.table_file(spark, put(tmp_path / "u.csv", "﻿學年度,名稱\n113,甲\n")).columns == ["學年度", "名稱"]
    assert readers.table_file(spark, put(tmp_path / "v.csv", "名稱,數\n乙,1\n", "big5hkscs"), "big5hkscs").first()["名稱"] == "乙"
    (tmp_path / "j").mkdir()
    put(tmp_path / "j" / "v1.json", '{"a": 1}')
    assert tuple(readers.json_results(spark, str(tmp_path / "j"), "a int").first()) == (1, "v1.json")
    assert readers.markdown(spark.createDataFrame([("x|y", None)], "a string, b int")) == "| a | b |\n|---|---|\n| x\\|y |  |"
    with pytest.raises(ValueError):
        readers.markdown(spark.range(3), 2)


def test_learning_journal(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(r, "context string, reading string, word string, weight double, day long")
    path = str(tmp_path / "log")
    readers.append_learned(make(("c", "a-b", "x", 1.0, 5), ("c", "a", "y", 2.0, 5)), path, 1)
    readers.append_learned(make(("c", "a-b", "x", 0.5, 9)), path, 2)
    want = [("c", "a", "y", 2.0, 5), ("c", "a-b", "x", 0.5, 9)]
    assert sorted(tuple(r) for r in readers.learned(spark, path + "/*").collect()) == want
    readers.compact_learned(spark, path, str(tmp_path / "new"))
    assert sorted(tuple(r) for r in readers.learned(spark, str(tmp_path / "new/*")).collect()) == want
    with pytest.raises(ValueError):
        readers.learned(spark, put(tmp_path / "bad", readers.LEARNED + "\na\tb\tc\td\te\n"))


def test_manifest(spark, tmp_path):
    kept, path = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string"), str(tmp_path / "m")
    readers.write_with_manifest(kept, spark.createDataFrame([("kept", 2), ("length", 1)], "reason string, n long"), path, "k", "t")
    told = spark.read.text(path + "/manifest").first()[0]
    assert '"rows": 2' in told and '"length": 1' in told and readers.content_hash(kept, "k", "t") in told
    assert readers.unchanged(kept, path + "/kept") and not readers.unchanged(kept.limit(1), path + "/kept") and not readers.unchanged(kept.union(kept), path + "/kept")
    assert readers.content_hash(kept, "k", "t") != readers.content_hash(kept.select((3 - F.col("k")).alias("k"), "t"), "k", "t")


def test_teaching():
    r = memory.taught({}, [(0, "c1", "a", None, 1.0), (0, "c1", "b", "a", 1.0), (0, "c2", "a", None, 1.0)])
    assert r == {("c1", "a"): (0.5, 0), ("c1", "b"): (1.0, 0), ("c2", "a"): (1.0, 0), ("*", "a"): (1.0, 0)}
    assert memory.taught(dict(r), [(0, "", "a", None, None)]) == {("c1", "b"): (1.0, 0)}
    assert set(memory.pruned(r, 0, 2)) == {("*", "a"), ("c1", "b")} and memory.pruned(r, 14 * 5, 9) == {}


def test_teaching_as_a_stream(spark, tmp_path):
    events = [("r1", 1, 0, "c1", "a", None, 1.0), ("r1", 2, 0, "c2", "a", None, 1.0), ("r2", 3, 0, "c1", "z", None, 1.0), ("r1", 4, 14, "c1", "b", "a", 1.0)]
    schema = "reading string, seq long, day long, context string, word string, displaced string, delta double"
    source, seen = tmp_path / "in", {}
    for k, part in enumerate((events[:3], events[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(source / f"b{k}"))

    def take(frame, _):
        for r in frame.collect():
            seen.setdefault(r.reading, {})[r.context, r.word] = (r.weight, r.day)

    stream = memory.teach(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source / "*")))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination()
    want = memory.taught({}, [(d, c, w, x, y) for r, _, d, c, w, x, y in events if r == "r1"])
    assert seen["r1"] == want and seen["r2"] == {("c1", "z"): (1.0, 0)}
