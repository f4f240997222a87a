"""Data sources by format name against Spark's own readers."""

import wave

import numpy as np
import pytest

from modlake.sources import formats
from modlake.sources import manifests as R

LINES = ["# id, start, end, labels", 'aa, 1.0, 2.5, "/m/1, /m/2"', "", "bb, x, 3, /m/3", "cc, 1, 2", ',4,5,"/m/4"', 'dä, 7.25, 9, "/m/5"', "ee, 1, 2, ", 'ff,8,9,"/m/6,/m/7",more']


@pytest.fixture(scope="module")
def session(spark):
    formats.register(spark)
    return spark


def rows(df):
    return sorted(map(str, ((r.ytid, r.start, r.end, tuple(r.mids)) for r in df.collect())))


@pytest.mark.parametrize("size", [1, 7, 40, 10**6])
def test_segments_in_any_partitions_are_those_of_the_reader(session, tmp_path, size):
    (tmp_path / "one.csv").write_text("\n".join(LINES * 3), encoding="utf-8")
    (tmp_path / "two.csv").write_text("\r\n".join(LINES) + "\r\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("no, 1, 2, row")
    df = session.read.format("segments").option("partitionBytes", size).load(str(tmp_path))
    assert rows(df) == rows(R.read_segments_csv(session, str(tmp_path))) and df.count() == 20
    assert rows(df.filter("start > 5 and ytid in ('ff', 'aa')")) == ["('ff', 8.0, 9.0, ('/m/6', '/m/7'))"] * 4
    assert df.filter("ytid is null").count() == 4 and df.filter("start is null").count() == 4 and df.filter("start <> 1").count() == 12


def test_filters_are_in_the_plan(session, tmp_path, capsys):
    (tmp_path / "one.csv").write_text("\n".join(LINES))
    session.read.format("segments").load(str(tmp_path)).filter("start >= 3 and mids[0] = 'a'").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "start" in pushed and "3.0" in pushed and "mids" not in pushed
    assert "start" not in "".join(x for x in plan.splitlines() if x.startswith("Condition"))


def test_empty_and_missing_folders(session, tmp_path):
    assert session.read.format("segments").load(str(tmp_path)).count() == 0
    assert session.read.format("wav").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        session.read.format("segments").load(str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="path"):
        session.read.format("wav").load().count()


def test_wav_files_by_path(session, tmp_path):
    for k, rate in enumerate((16000, 8000, 16000)):
        with wave.open(str(tmp_path / f"clip{k}.wav"), "wb") as w:
            w.setparams((1, 2, rate, 0, "NONE", ""))
            w.writeframes(np.arange(40, dtype="<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF no sound")
    (tmp_path / "note.txt").write_text("no sound")
    df = session.read.format("wav").option("partitionBytes", 200).load(str(tmp_path))
    own = {r.path.rsplit("/", 1)[1]: (r.rate, r.samples, r.error) for r in R.audio_files(session, str(tmp_path)).collect()}
    assert {r.path.rsplit("/", 1)[1]: (r.rate, r.samples, r.error) for r in df.collect()} == own and len(own) == 4
    assert own["bad.wav"][1] is None and len(own["clip1.wav"][1]) == 80
    reader = formats.WavReader({"path": str(tmp_path)})
    one = df.filter(df.path.endswith("clip2.wav"))
    assert one.count() == 1 and list(reader.pushFilters([formats.D.StringEndsWith(("path",), "clip2.wav")])) == []
    assert [f[0].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["clip2.wav"]  # others aren't opened
