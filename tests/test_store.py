"""Frame files, their persisted index, streaming groups and repeatable ingest."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.sources import hk, store
from tidewell.streaming import live


def frame(i, kind, session=5, prov=None, t=(), providers=(), name="main", filename="rec", version=2):
    blocks = [(name, [float(x) for x in t], {"v": [str(x) for x in t]})] if t else []
    return (filename, i, i, kind, version, session, prov, float(t[0] if t else 0), list(providers), blocks)


def made(spark, rows):
    return spark.createDataFrame(rows, hk.FRAMES)


RECORD = [
    frame(0, hk.SESSION),
    frame(1, hk.STATUS, providers=[(1, "a"), (2, "b")]),
    frame(2, hk.DATA, prov=1, t=(10, 11, 12)),
    frame(3, hk.DATA, prov=2, t=(10.5,), name="other"),
    frame(4, hk.DATA, prov=1, t=(13, 14)),
    frame(5, hk.STATUS, providers=[(2, "b")]),  # a leaves
    frame(6, hk.STATUS, providers=[(1, "a"), (2, "b")]),  # and is back
    frame(7, hk.DATA, prov=1, t=(20, 21)),
    frame(8, hk.SESSION, session=6),  # all closed
    frame(9, hk.STATUS, session=6, providers=[(1, "c")]),
    frame(10, hk.DATA, session=6, prov=1, t=(30,)),
    frame(11, hk.END, session=6),
]
GROUPS = [(5, "a", "main", 10.0, 15.0, 2, 5), (5, "a", "main", 20.0, 22.0, 1, 2), (5, "b", "other", 10.5, 11.5, 1, 1), (6, "c", "main", 30.0, 31.0, 1, 1)]


def groups(df):
    return sorted(tuple(r[c] for c in ("session_id", "provider", "block_name", "t0", "t1", "frames", "count")) for r in df.collect())


def test_session_groups(spark, tmp_path):
    """Groups close when a provider leaves and when a session ends, whatever the batches are."""
    for k in (0, 1, 2, 3):
        made(spark, RECORD[3 * k : 3 * k + 3]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for f in Path(tmp_path / f"in/{k}").glob("*.parquet"):
            os.utime(f, (1e9 + k, 1e9 + k))
    for files in ("1", "100"):
        stream = spark.readStream.schema(hk.FRAMES).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in/*"))
        assert groups(live.drained(live.session_groups(stream))) == GROUPS
    made(spark, RECORD[:1] + RECORD[2:3]).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no status frame has named"):
        live.drained(live.session_groups(spark.readStream.schema(hk.FRAMES).parquet(str(tmp_path / "bad"))))


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_offsets_and_round_trip(spark, tmp_path, split):
    """Frames come back as they were, each with the byte at which its line begins, over splits of any size."""
    rows = [frame(k, hk.DATA, prov=1, t=(k, k + 0.5), name=f"blöck {k}") for k in range(40)]
    store.write(made(spark, rows).repartition(4), str(tmp_path / "out"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split == "300b" else "4m")
    try:
        got = store.read(spark, str(tmp_path / "out")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(repr(tuple(r)[2:]) for r in got) == sorted(repr(tuple(r)[2:]) for r in made(spark, rows).collect())
    for r in got:
        with open(r["filename"].removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r["byte_offset"])
            assert json.loads(f.readline())["frame_idx"] == r["frame_idx"]
    assert store.read_stream(spark, str(tmp_path / "out")).isStreaming


def test_persisted_index(spark, tmp_path):
    src, index = tmp_path / "src", store.Index(spark, str(tmp_path / "index"))
    src.mkdir()
    line = lambda row: json.dumps(dict(zip([f.name for f in store.SCHEMA], [*row[2:8], [], [{"block_name": b[0], "t": b[1], "fields": b[2]} for b in row[9]]])))
    good = [line(r) for r in RECORD if r[3] == hk.DATA]
    (src / "a.txt").write_text("\n".join(good[:2]) + "\n")
    (src / "b.txt").write_text(good[2] + "\n{torn\n[1]\n\n" + good[3] + "\n")
    (src / "c.txt").write_text("")
    assert index.update(str(src)) == 2 and index.update(str(src)) == 0  # an empty file waits until there is something in it
    files = {r["filename"][-5:]: r for r in index.files().collect()}
    assert [files[n]["frames"] for n in ("a.txt", "b.txt")] == [2, 2] and len(files) == 2
    assert files["b.txt"]["broken"] == 2 and files["b.txt"]["error"].startswith(f"no frame at byte {len(good[2]) + 1}: {{torn")
    assert files["a.txt"]["error"] is None and index.blocks().count() == 4
    # a file that grew is taken anew, the others are not opened again
    with open(src / "a.txt", "a") as f:
        f.write(good[4] + "\n")
    before = index.versions()
    assert index.update(str(src)) == 1 and len(index.versions()) == len(before) + 1
    assert index.frames().count() == 5 and {r["frames"] for r in index.files().where("filename like '%a.txt'").collect()} == {3}
    # an update that died left tables without a marker
    died = tmp_path / f"index/v{max(index.versions()) + 1}"
    index.files().drop("version").write.parquet(str(died / "files"))
    (src / "d.txt").write_text(good[0] + "\n")
    assert index.update(str(src)) == 1 and index.frames().count() == 6
    assert index.frames().groupBy("filename", "byte_offset").count().where("count > 1").isEmpty()


def test_ingest_may_be_repeated(spark, tmp_path):
    """A batch that is done again, as after a crash before its commit, doubles nothing; the last description by time holds."""
    rows = [frame(0, hk.STATUS, providers=[(1, "z")], t=(1,)), frame(1, hk.STATUS, providers=[(1, "a")], t=(2,)), frame(2, hk.DATA, prov=1, t=(10, 11))]
    made(spark, rows).write.parquet(str(tmp_path / "in"))
    for state in ("first", "second"):  # a new checkpoint: batch 0 once more
        live.ingest(spark.readStream.schema(hk.FRAMES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / state)).awaitTermination(120)
        got = live.ingested(spark, str(tmp_path / "out"))
        assert sorted((r["field"], r["t"]) for r in got.collect()) == [("a.v", 10.0), ("a.v", 11.0)]
    assert spark.read.parquet(str(tmp_path / "out/providers")).where(F.col("provider") == "a").count() == 1
