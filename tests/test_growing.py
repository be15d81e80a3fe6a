"""Logs that are appended to, rotated, truncated and split are read whole and once."""

import pytest

from logwarden.sources import growing, monitor as mo
from logwarden.streaming import jobs


def poll(spark, folder, out, **options):
    jobs.run(growing.read_growing(spark, str(folder), stream=True, **options), str(out))
    data = out / "data"
    return sorted(r["line"] for r in spark.read.parquet(str(data)).collect()) if data.exists() else []


def append(path, *lines, end="\n"):
    with open(path, "a", newline="") as f:
        f.write("\n".join(lines) + end)


def test_appended_rotated_and_truncated_files_are_read_once(spark, tmp_path):
    folder, out = tmp_path / "log", tmp_path / "out"
    folder.mkdir()
    log = folder / "access.log"
    append(log, "a1", "a2", "é3")
    append(log, "half", end="")
    append(folder / "_hidden.log", "no")
    append(folder / "note.txt", "no")
    want = ["a1", "a2", "é3"]
    assert poll(spark, folder, out, glob="*.log*") == sorted(want)
    append(log, " line", "a5")  # the unfinished line ends
    want += ["half line", "a5"]
    assert poll(spark, folder, out, glob="*.log*") == sorted(want)
    assert poll(spark, folder, out, glob="*.log*") == sorted(want)  # nothing new
    append(log, "a6")
    log.rename(folder / "access.log.1")  # rotated with a line not read yet
    append(log, "b1", "b2")
    want += ["a6", "b1", "b2"]
    assert poll(spark, folder, out, glob="*.log*") == sorted(want)
    (folder / "access.log.1").rename(folder / "access.log.2")
    log.rename(folder / "access.log.1")
    append(folder / "access.log.1", "b3")
    append(log, "c1")
    want += ["b3", "c1"]
    assert poll(spark, folder, out, glob="*.log*") == sorted(want)
    log.write_text("d1\n")  # written anew in place
    (folder / "access.log.2").unlink()
    assert poll(spark, folder, out, glob="*.log*") == sorted([*want, "d1"])


def test_a_file_renamed_between_plan_and_read_is_found(tmp_path):
    log = tmp_path / "auth.log"
    append(log, "one", "two")
    reader = growing.StreamReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    log.rename(tmp_path / "auth.log.1")
    append(log, "three")
    assert [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()] == ["one", "two"]
    more = reader.partitions(end, reader.latestOffset())
    assert [x for p in more for b in reader.read(p) for x in b.column("line").to_pylist()] == ["three"]
    (tmp_path / "auth.log.1").unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_splits_of_any_size_give_every_line_once(spark, tmp_path, monkeypatch, split):
    lines = ["", "x" * 300, "\t", "é" * 9, "end\r", *[f"line {k}" for k in range(40)], "", "last"]
    (tmp_path / "big.log").write_bytes("".join(x + "\n" for x in lines).encode() + b"\xff open")
    reader = growing.BatchReader({"path": str(tmp_path / "big.log"), "splitBytes": str(split)})
    monkeypatch.setattr(growing, "CHUNK", 5)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(b.column("byte").to_pylist(), b.column("line").to_pylist())]
    raw = (tmp_path / "big.log").read_bytes()
    assert [x for _, x in rows] == [x.removesuffix("\r") for x in lines]
    assert all(raw[a:].startswith(x.encode()) and (a == 0 or raw[a - 1 : a] == b"\n") for a, x in rows)


def test_split_monitor_logs_equal_the_join_of_lines_and_headers(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tservice\n" + "".join(f"{k}.5\tU{k}\t10.0.0.{k}\t-\n" for k in range(50)) + "#close\n")
    (tmp_path / "b.log").write_text("#separator |\n#fields|uid|ts|service\nV1|7.0|(empty)\nV2|8.0|T\n")
    (tmp_path / "c.log").write_text('{"ts": 9.5, "uid": "J1", "service": "dns"}\n{"broken\n# note\n')
    (tmp_path / "empty.log").write_text("")
    fields = ["ts", "uid", "id.orig_h", "service"]
    lines = growing.read_growing(spark, str(tmp_path), splitBytes="64")
    assert lines.rdd.getNumPartitions() > 10
    got = mo.parse_headed(lines, fields)
    want = mo.parse_auto(lines.select("file", "line"), fields)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 53
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_an_empty_folder_has_no_lines(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert growing.read_growing(spark, str(tmp_path / "none")).count() == 0
    assert poll(spark, tmp_path / "none", tmp_path / "out") == []
