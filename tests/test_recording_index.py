"""Files outside a time range are not opened; no row is lost by a missing or stale index."""

import pytest
from pyspark.sql import functions as F

from fleetpulse import index_recordings, load_session
from fleetpulse.schema import RECORDING


def recording(spark, first, n, name="m"):
    return spark.range(first, first + n).select(
        (F.col("id") * 1000).alias("ts_unix_ms"), F.lit(name).alias("name"), F.lit("{}").alias("labels_json"), F.lit("gauge").alias("kind"),
        F.lit("count").alias("unit"), F.col("id").cast("decimal(20,0)").alias("raw"), F.lit("[[10,5]]").alias("buckets_json")).select(*RECORDING.fieldNames())


def save(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(str(path))


def raws(df):
    return sorted(int(r.raw) for r in df.collect())


def data_file(folder):
    return next(folder.glob("*.parquet"))


@pytest.fixture
def parts(spark, tmp_path):
    for i in range(4):
        save(recording(spark, i * 100, 100), tmp_path / "rec" / f"part {i} [a]")
    index = str(tmp_path / "index")
    index_recordings(spark, [str(tmp_path / "rec")], index)
    return tmp_path / "rec", index


def test_files_outside_the_range_are_not_opened(spark, parts):
    rec, index = parts
    whole = [str(rec)]
    df = load_session(spark, whole, start="1970-01-01 00:02:30 UTC", end="1970-01-01 00:03:19 UTC", index=index)
    assert raws(df) == list(range(150, 200)) and len(df.inputFiles()) == 1
    wide = load_session(spark, whole, start="1970-01-01 00:03:19 UTC", index=index)
    assert raws(wide) == list(range(199, 400)) and len(wide.inputFiles()) == 3
    assert raws(load_session(spark, whole, index=index)) == list(range(400))
    assert load_session(spark, whole, start="1980-01-01", index=index).count() == 0


def test_a_range_without_index_gives_the_same_rows(spark, parts):
    rec, index = parts
    for span in ({"start": "1970-01-01 00:01:39.000001 UTC"}, {"end": "1970-01-01 00:01:39 UTC"}, {"start": "1970-01-01 00:01:39 UTC", "end": "1970-01-01 00:05:00.5 UTC"}):
        assert raws(load_session(spark, [str(rec)], **span)) == raws(load_session(spark, [str(rec)], index=index, **span))
    assert raws(load_session(spark, [str(rec)], start="1970-01-01 00:01:39.000001 UTC"))[0] == 100


def test_unknown_and_changed_files_are_read(spark, parts, tmp_path):
    rec, index = parts
    save(recording(spark, 150, 10, "new"), rec / "late")
    target = data_file(rec / "part 3 [a]")
    save(recording(spark, 160, 7, "changed"), tmp_path / "other")
    target.write_bytes(data_file(tmp_path / "other").read_bytes())
    (target.parent / f".{target.name}.crc").unlink(missing_ok=True)
    span = {"start": "1970-01-01 00:02:30 UTC", "end": "1970-01-01 00:03:19 UTC", "index": index}
    df = load_session(spark, [str(rec)], **span)
    assert df.where("name = 'new'").count() == 10 and df.where("name = 'changed'").count() == 7 and df.count() == 67
    index_recordings(spark, [str(rec)], index)
    entries = spark.read.parquet(index)
    assert entries.count() == 6 and entries.where("rows = 7 AND first_ms = 160000").count() == 1
    index_recordings(spark, [str(rec)], index)
    assert spark.read.parquet(index).count() == 6, "known files are not read again"
    assert load_session(spark, [str(rec)], **span).count() == 67


def test_a_range_never_reaches_a_broken_file_elsewhere(spark, tmp_path):
    save(recording(spark, 0, 10), tmp_path / "rec" / "a")
    save(recording(spark, 500, 10), tmp_path / "rec" / "b")
    index = str(tmp_path / "index")
    index_recordings(spark, [str(tmp_path / "rec")], index)
    broken = data_file(tmp_path / "rec" / "b")
    stamp = broken.stat()
    broken.write_bytes(b"x" * stamp.st_size)
    import os
    os.utime(broken, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert raws(load_session(spark, [str(tmp_path / "rec")], end="1970-01-01 00:00:09 UTC", index=index)) == list(range(10))
    with pytest.raises(Exception):
        load_session(spark, [str(tmp_path / "rec")], end="1970-01-01 00:00:09 UTC").collect()
