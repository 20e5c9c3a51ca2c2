"""Growing logs and files of several lines."""

import json

import pytest

from boxloom.sources import artifacts


def polled(spark, folder, cursor, closed=False):
    lines, cursor = artifacts.read_log_tail(spark, str(folder), cursor, closed)
    return sorted((r.job_id, r.seq, r.line) for r in lines.collect()), cursor


def test_log_tail_gives_every_line_once(spark, tmp_path):
    log = tmp_path / "j1" / "run.log"
    log.parent.mkdir()
    log.write_text("one\n\ntwo\nthr")
    got, cursor = polled(spark, tmp_path, None)
    assert got == [("j1", 0, "one"), ("j1", 1, ""), ("j1", 2, "two")]
    assert polled(spark, tmp_path, cursor)[0] == []
    log.write_text("one\n\ntwo\nthree\nfour\n")
    other = tmp_path / "j2" / "run.log"
    other.parent.mkdir()
    other.write_text("a\nb\n")
    got, cursor = polled(spark, tmp_path, cursor)
    assert got == [("j1", 3, "three"), ("j2", 0, "a")]
    got, cursor = polled(spark, tmp_path, cursor, closed=True)
    assert got == [("j1", 4, "four"), ("j2", 1, "b")]
    assert polled(spark, tmp_path, cursor, closed=True)[0] == []
    log.write_text("new\n")
    assert polled(spark, tmp_path, cursor, closed=True)[0] == [("j1", 0, "new")]


def test_files_of_several_lines(spark, tmp_path):
    page = tmp_path / "book" / "ocr" / "page_0003.json"
    page.parent.mkdir(parents=True)
    page.write_text(json.dumps([{"boxno": 0, "text": "a"}, {"boxno": 1, "text": "b"}], indent=2))
    (page.parent / "page_0004.json").write_text("[]\n")
    (page.parent / "page_0005.json").write_text('{"a":\n 1}')
    rows = artifacts.read_artifact(spark, str(tmp_path), "boxno bigint, text string").collect()
    assert sorted((r.book_id, r.page, r.pos, r.boxno, r.text) for r in rows) == [("book", 3, 0, 0, "a"), ("book", 3, 1, 1, "b")]
    assert [(r.book_id, r.page, r.code) for r in artifacts.broken_artifacts(spark, str(tmp_path)).collect()] == [("book", 5, "not_an_array")]
    assert sorted(r.page for r in artifacts.artifact_pages(spark, str(tmp_path)).collect()) == [3, 4, 5]


def test_stream_gives_every_line_once(spark, tmp_path):
    from boxloom.streaming.tail import LogTail

    logs, out, marks = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "marks")
    log = logs / "j1" / "run.log"
    log.parent.mkdir(parents=True)
    spark.dataSource.register(LogTail)

    def start():
        return (spark.readStream.format("log_tail").option("rangeBytes", 16).load(str(logs)).writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", marks).start())

    def append(path, data):
        with path.open("ab") as file:
            file.write(data)

    def rows():
        return sorted((r["job_id"], r["file"], r["at"], r["line"]) for r in spark.read.parquet(out).collect())

    log.write_bytes("one\ntwo, long enough for several ranges of bytes\nthré".encode()[:-1])  # ends inside a letter
    run = start()
    try:
        run.processAllAvailable()
        assert [r[2:] for r in rows()] == [(0, "one"), (4, "two, long enough for several ranges of bytes")]
        append(log, "é\nfour\rfour again\r\n".encode()[1:])
        run.processAllAvailable()
        assert [r[3] for r in rows()][2:] == ["thré", "four", "four again"]
        run.stop()
        append(log, b"five\n\nsix")  # while no query runs
        run = start()
        run.processAllAvailable()
        assert [r[3] for r in rows()][5:] == ["five", ""]
        old = rows()
        log.rename(log.parent / "run.log.1")
        append(log.parent / "run.log.1", b" and a half\n")
        log.write_bytes(b"new one\n" + b"line of the new file\n" * 20)  # longer than the old one
        run.processAllAvailable()
        assert len(rows()) == len(old) + 1 + 21 and set(old) < set(rows())
        fresh = [r for r in rows() if r not in old]
        assert [r[3] for r in fresh if r[1] == old[0][1]] == ["six and a half"]
        assert [r[3] for r in fresh if r[1] != old[0][1]] == ["new one"] + ["line of the new file"] * 20
        log.write_bytes(b"cut\n")  # truncated in place
        run.processAllAvailable()
        assert [r[3] for r in rows()].count("cut") == 1 and len(rows()) == len(old) + 23
    finally:
        run.stop()


def test_ranges_cut_no_line(tmp_path):
    from boxloom.streaming import tail

    file = tmp_path / "a.log"
    text = [f"{'x' * (n * 7 % 23)}é{n}" for n in range(200)]
    file.write_text("\n".join(text) + "\nopen", encoding="utf-8")
    for size in (1, 5, 64, 1000, 1 << 20):
        got = [x for part in tail.ranges({}, tail.states(str(tmp_path)), size) for x in tail.lines(part)]
        assert [line for _, line in got] == text and [at for at, _ in got] == sorted({at for at, _ in got})
    assert tail.ranges(tail.states(str(tmp_path)), tail.states(str(tmp_path))) == []
    assert tail.states(str(tmp_path / "none")) == {}
    assert [tail.mounted(p) for p in ("/a/b", "file:/a/b", "file:///a/b")] == ["/a/b"] * 3
    with pytest.raises(ValueError):
        tail.mounted("hdfs://host/a")


def test_logs_are_read_in_ranges(spark, tmp_path):
    text = [f"line {n} {'é' * (n % 7)}" if n % 9 else " " for n in range(4000)]
    file = tmp_path / "j1" / "run.log"
    file.parent.mkdir()
    file.write_text("\r\n".join(text) + "\n", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        rows = artifacts.read_logs(spark, str(tmp_path))
        got = sorted((r["seq"], r["line"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [(n, line.strip()) for n, line in enumerate(text) if line.strip()]
    assert {r["job_id"] for r in rows.collect()} == {"j1"}
