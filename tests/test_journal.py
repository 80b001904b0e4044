"""A stream of exported journals: nothing lost or doubled over restarts, growing, rotated and cut files."""

import json

import pytest

from tallyhound.sources import journal, sshd_log
from tallyhound.streaming import live


def entry(k, text="Accepted password for ann from 10.0.0.3 port 22 ssh2"):
    return json.dumps({"__CURSOR": f"s=a;i={k:x}", "__REALTIME_TIMESTAMP": str(1789000000000000 + k), "SYSLOG_IDENTIFIER": "sshd", "_PID": "5", "_HOSTNAME": "web", "MESSAGE": f"{text}" if k % 2 else f"ünrelated {k} " + "x" * (k % 50)}, ensure_ascii=False) + "\n"


@pytest.mark.parametrize("part", [64 << 20, 300])
def test_nothing_is_lost_or_doubled(spark, tmp_path, part):
    spark.dataSource.register(journal.Journal)
    folder = tmp_path / "journal"
    folder.mkdir()
    (folder / "empty.json").write_text("")

    def round_():
        df = spark.readStream.format("journal_export").option("path", str(folder)).option("part", str(part)).load()
        live.run_once(df, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return sorted(r.cursor for r in spark.read.schema(journal.SCHEMA).parquet(str(tmp_path / "out")).collect())

    cursors = lambda *ks: sorted(f"s=a;i={k:x}" for k in ks)
    now = folder / "journal.json"
    now.write_text("".join(map(entry, range(20))) + entry(20)[:30])  # the last line is under way
    assert round_() == cursors(*range(20))
    now.write_text("".join(map(entry, range(25))))
    (folder / "other.json").write_text("".join(map(entry, range(100, 103))))
    assert round_() == cursors(*range(25), *range(100, 103))
    assert round_() == cursors(*range(25), *range(100, 103))
    now.rename(folder / "journal.json.1")  # rotated, and written on before it was left
    with (folder / "journal.json.1").open("a") as f:
        f.write(entry(25))
    now.write_text("".join(map(entry, range(30, 33))))
    assert round_() == cursors(*range(26), *range(30, 33), *range(100, 103))
    now.write_text("".join(map(entry, range(40, 42))))  # cut and begun anew
    assert round_() == cursors(*range(26), *range(30, 33), 40, 41, *range(100, 103))
    lines = spark.read.parquet(str(tmp_path / "out"))
    assert sshd_log.events(lines).count() == sum(int(c.split("=")[-1], 16) % 2 for c in round_())


def test_a_file_that_changed_under_its_offset_is_an_error(tmp_path):
    (tmp_path / "a.json").write_text("".join(map(entry, range(5))))
    reader = journal.Reader(str(tmp_path), 1 << 20)
    start = reader.latestOffset()
    (tmp_path / "a.json").write_text(entry(0) + "".join(map(entry, range(50, 60))))
    with pytest.raises(ValueError, match="no longer has"):
        list(reader.read(reader.partitions(start, reader.latestOffset())[0]))
    (tmp_path / "a.json").unlink()
    with pytest.raises(FileNotFoundError):
        reader.partitions({"files": {}}, start)
