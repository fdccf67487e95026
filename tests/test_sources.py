import json

import pytest

from quarry.operators import render
from quarry.sources import collection as C
from quarry.sources import remote as R
from quarry.streaming import gate


def collection(tmp_path):
    paper = tmp_path / "p1"
    (paper / "text").mkdir(parents=True)
    (paper / "paper.json").write_text(json.dumps({"slug": "p1", "title": "T", "year": 2001, "chapters": [{"stem": "01", "words": 3}]}))
    rows = [{"kind": "heading", "anchor": "sec", "level": 2, "title": "A"}, {"kind": "paragraph", "anchor": "p1", "text": "nul\u0000 line separator"}]
    (paper / "text" / "01.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False).replace("\\u0000", "\x00") for r in rows) + "\n")
    (tmp_path / C.STORE).write_text(json.dumps({"tag": "b"}) + "\n\n" + json.dumps({"tag": "a", "year": 1999}) + "\n")
    return str(tmp_path)


def test_a_collection_is_read(spark, tmp_path):
    root = collection(tmp_path)
    assert C.read_manifests(spark, root).first().title == "T"
    found = C.read_blocks(spark, root).orderBy("idx").collect()
    assert [(r.slug, r.stem, r.idx, r.kind) for r in found] == [("p1", "01", 0, "heading"), ("p1", "01", 1, "paragraph")]
    assert found[1].text == "nul line separator"
    assert {r.tag for r in C.read_store(spark, root).collect()} == {"a", "b"}


def test_missing_roots_are_empty(spark, tmp_path):
    root = str(tmp_path / "none")
    assert C.read_manifests(spark, root).count() == C.read_blocks(spark, root).count() == C.read_store(spark, root).count() == 0


def test_broken_lines_fail_with_their_number(spark, tmp_path):
    root = collection(tmp_path)
    (tmp_path / "p1" / "text" / "02.jsonl").write_text('{"kind": "code"}\n{broken\n')
    with pytest.raises(Exception, match="line 2"):
        C.read_blocks(spark, root).collect()
    (tmp_path / C.STORE).write_text("{}\n{broken\n")
    with pytest.raises(ValueError, match="line 2"):
        C.read_store(spark, root)


def test_sinks_round_trip(spark, tmp_path):
    root = collection(tmp_path)
    blocks = C.read_blocks(spark, root)
    C.write_blocks(blocks, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    assert len(C.block_lines(blocks).first().lines.split("\n")) == 2
    assert C.write_store(C.read_store(spark, root), root) == 2
    assert [json.loads(x)["tag"] for x in (tmp_path / C.STORE).read_text().splitlines()] == ["a", "b"]


def test_a_second_render_changes_nothing(spark, tmp_path):
    pages = render.chapters(C.read_blocks(spark, collection(tmp_path)))
    out = str(tmp_path / "views")
    assert C.write_pages(pages, out, "stem", "markdown") == {"written": 1, "unchanged": 0, "removed": 0}
    (tmp_path / "views" / "old.md").write_text("x")
    assert C.write_pages(pages, out, "stem", "markdown") == {"written": 0, "unchanged": 1, "removed": 1}


def test_a_feed_is_read(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2001.00001v2</id><title>A\n  b</title><published>2020-01-02T00:00:00Z</published><author><name>Q</name></author></entry></feed>')
    row = C.read_feed(spark, str(path)).first()
    assert (row.arxiv_id, row.version, row.title, row.year, row.authors) == ("2001.00001", "v2", "A b", 2020, ["Q"])


def test_records_come_from_canned_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"q1": {"n": 1}}))
    spark.dataSource.register(R.RecordSource)
    rows = spark.read.format("records").option("requests", json.dumps(["q1", "q2"])).option("answers", str(tmp_path / "a.json")).load().collect()
    assert [(r.request, json.loads(r.body)) for r in rows] == [("q1", {"n": 1})]


def test_the_gate_keeps_its_pace():
    now, slept = [0.0], []
    gate_ = R.Gate(lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        gate_.wait("catalogue")
    assert slept == [0.5, 0.5]
    assert (R.retry_after("99", 1, 60), R.retry_after("x", 1, 60), R.retry_after(None, 1, 60)) == (60, 1, 1)
    assert R.in_batches(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


def test_streamed_windows_agree_with_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    query = gate.windowed(gate.read_events(spark, folder)).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select sum(events) from (select max(events) events from windows group by w, event_type)").first()[0] == events.select("event_id").distinct().count()
