"""Archives: round trips, ranges of bytes, skipped columns, commits, lost tasks, streams."""

import os

import pytest
from pyspark.sql import functions as F

from tagweft.sources import archive

TEXTS = [(1, "é<p>"), (2, None), (None, "x"), (4, ""), (5, "long " * 5000), (6, archive.MARK[1:-1].decode()), (1, "é<p>")]


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(archive.ArchiveSource)
    return spark


def written(session, path, rows, mode="append", parts=3):
    df = session.createDataFrame(rows, archive.SCHEMA).repartition(parts)
    df.write.format("tagweft_archive").mode(mode).save(str(path))


def loaded(session, path, **options):
    return session.read.format("tagweft_archive").options(**options).load(str(path))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [300, 5000, 1 << 20])
def test_round_trip_by_ranges(session, tmp_path, size):
    written(session, tmp_path / "a", TEXTS)
    assert rows_of(loaded(session, f"file://{tmp_path}/a", rangeBytes=size)) == sorted(TEXTS, key=repr)


def test_ranges_are_tasks(session, tmp_path):
    written(session, tmp_path / "a", [(k, "x" * 1000) for k in range(200)], parts=1)
    df = loaded(session, tmp_path / "a", rangeBytes=20_000)
    assert df.rdd.getNumPartitions() > 8 and df.count() == 200


def test_a_schema_without_texts_skips_them(session, tmp_path, monkeypatch):
    written(session, tmp_path / "a", TEXTS)
    ids = session.read.format("tagweft_archive").schema("doc_id long").load(str(tmp_path / "a"))
    assert ids.columns == ["doc_id"] and sorted(r.doc_id or 0 for r in ids.collect()) == sorted(i or 0 for i, _ in TEXTS)
    part = archive._ranges(str(tmp_path / "a"), archive._commits(str(tmp_path / "a")), 1 << 20)
    assert [b.schema.names for p in part for b in archive.read_range(str(tmp_path / "a"), p, ["doc_id"])] == [["doc_id"]] * len(part)
    with pytest.raises(Exception, match="an archive has the columns"):
        session.read.format("tagweft_archive").schema("other long").load(str(tmp_path / "a")).collect()


def test_commits_append_and_replace(session, tmp_path):
    written(session, tmp_path / "a", TEXTS[:2])
    written(session, tmp_path / "a", TEXTS[2:4])
    assert rows_of(loaded(session, tmp_path / "a")) == sorted(TEXTS[:4], key=repr)
    written(session, tmp_path / "a", TEXTS[4:], mode="overwrite")
    assert rows_of(loaded(session, tmp_path / "a")) == sorted(TEXTS[4:], key=repr)
    assert loaded(session, tmp_path / "none").count() == 0


def test_what_a_failed_task_wrote_is_never_read(session, tmp_path):
    """A write that fails in one task leaves no commit, and files of attempts that no commit names are ignored."""
    written(session, tmp_path / "a", TEXTS[:2])

    @F.udf("string")
    def fails(k):
        if k == 7:
            raise RuntimeError("lost")
        return "x"

    bad = session.range(10).repartition(3).select(F.col("id").alias("doc_id"), fails("id").alias("text"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tagweft_archive").mode("append").save(str(tmp_path / "a"))
    with open(tmp_path / "a" / "data-stray", "wb") as f:
        f.write(archive.MARK + archive.HEAD.pack(9, 0, 1) + b"y")
    assert rows_of(loaded(session, tmp_path / "a")) == sorted(TEXTS[:2], key=repr)
    assert len([f for f in os.listdir(tmp_path / "a") if f.startswith("commit-")]) == 1


def test_stream_goes_on_from_its_offset(session, tmp_path):
    found = []
    for k in range(3):
        written(session, tmp_path / "a", TEXTS[2 * k : 2 * k + 2])
        stream = session.readStream.format("tagweft_archive").load(str(tmp_path / "a"))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        found.append(session.read.schema(archive.SCHEMA).parquet(str(tmp_path / "out")).count())
    assert found == [2, 4, 6]
    assert rows_of(session.read.schema(archive.SCHEMA).parquet(str(tmp_path / "out"))) == sorted(TEXTS[:6], key=repr)
