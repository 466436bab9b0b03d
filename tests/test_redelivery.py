import datetime as dt
import unicodedata

import pytest

from gaugeworks.operators.redelivery import MessageStore, one_copy, with_message_key

HEX = "c34095635e1bebbcc86e7df9fc6acec7"
UUID = "C3409563-5E1B-EBBC-C86E-7DF9FC6ACEC7"


def at(day, month=1):
    return dt.datetime(2025, month, day)


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, trace string, name string, at timestamp, message string")


@pytest.mark.parametrize(
    ("trace", "name"),
    [
        (HEX, "Résolution 1.pdf"), (UUID, "RÉSOLUTION 1.PDF"), ("{" + UUID + "}", "inbox/2026/Résolution 1.pdf"), ("urn:uuid:" + UUID.lower(), "C:\\in\\Résolution 1.pdf"),
        ("trace:" + HEX, "R%C3%A9solution%201.pdf"), (f" {HEX} ", " " + unicodedata.normalize("NFD", "Résolution 1.pdf") + " "),
    ],
)
def test_writings_of_one_message(spark, trace, name):
    df = frame(spark, [(1, HEX, "Résolution 1.pdf", None, "x"), (2, trace, name, None, "y")])
    keys = {r.message for r in with_message_key(df, "trace", "name", "message").collect()}
    assert len(keys) == 1


def test_other_files_and_missing_parts(spark):
    df = frame(spark, [(1, HEX, "Resolution 1.pdf", None, None), (2, HEX, "Résolution 1.pdf", None, None), (3, None, "a.pdf", None, None), (4, HEX, None, None, None), (5, " ", "a.pdf", None, None), (6, HEX, "/in/", None, None)])
    rows = with_message_key(df, "trace", "name", "message").collect()
    assert sorted(r.row_id for r in rows) == [1, 2] and len({r.message for r in rows}) == 2


def test_winner_and_ties(spark):
    rows = [(3, HEX, "a", at(2), "k"), (2, HEX, "a", at(2), "k"), (1, HEX, "a", None, "k"), (4, HEX, "b", at(1), "m")]
    assert sorted(r.row_id for r in one_copy(frame(spark, rows), "message", "at", "row_id").collect()) == [2, 4]


def store(spark, tmp_path):
    return MessageStore(spark, f"file://{tmp_path}/store", "message", "at", "row_id")


def test_merges_rewrite_only_touched_partitions(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read() is None
    s.merge(frame(spark, [(1, HEX, "a", at(5), "a"), (2, HEX, "b", at(5, 2), "b"), (3, HEX, "c", at(5, 3), "c")]))
    before = s.manifest()[1]
    touched = s.merge(frame(spark, [(4, HEX, "b", at(1, 2), "b"), (5, HEX, "d", at(9, 2), "d")]))
    after = s.manifest()[1]
    assert touched == {"2025-02"} and before["2025-01"] == after["2025-01"] and before["2025-02"] != after["2025-02"]
    assert sorted(r.row_id for r in s.read().collect()) == [1, 3, 4, 5]


def test_winner_moves_to_an_earlier_partition(spark, tmp_path):
    s = store(spark, tmp_path)
    s.merge(frame(spark, [(1, HEX, "a", at(5, 6), "a")]))
    assert s.merge(frame(spark, [(2, HEX, "a", at(5, 1), "a")])) == {"2025-06", "2025-01"}
    assert [r.row_id for r in s.read().collect()] == [2] and set(s.manifest()[1]) == {"2025-01"}


def test_repeated_empty_and_broken_merges(spark, tmp_path):
    s = store(spark, tmp_path)
    batch = frame(spark, [(1, HEX, "a", at(5), "a"), (1, HEX, "a", at(5), "a"), (2, HEX, "b", None, "b")])
    s.merge(batch)
    s.merge(batch)
    s.merge(batch.limit(0))
    assert sorted(r.row_id for r in s.read().collect()) == [1, 2]
    version, folders = s.manifest()
    with pytest.raises(Exception, match="boom"):
        s.merge(batch.withColumn("message", spark.sql("select raise_error('boom') e").schema and batch.message).selectExpr("row_id", "trace", "name", "at", "raise_error('boom') message"))
    assert s.manifest() == (version, folders)


def test_keys_survive_any_order(spark, tmp_path):
    rows = [(i, HEX, str(i % 7), at(1 + (i * 13) % 28, 1 + i % 3), str(i % 7)) for i in range(60)]
    want = sorted(r.row_id for r in one_copy(frame(spark, rows), "message", "at", "row_id").collect())
    s = store(spark, tmp_path)
    for k in range(3):
        s.merge(frame(spark, rows[k::3]))
    assert sorted(r.row_id for r in s.read().collect()) == want


def test_a_small_batch_reads_only_its_buckets_and_partitions(spark, tmp_path):
    s = MessageStore(spark, f"file://{tmp_path}/store", "message", "at", "row_id", buckets=4)
    s.merge(frame(spark, [(i, HEX, str(i), at(5, 1 + i % 6), str(i)) for i in range(240)]))
    before = s._state()
    assert len(before["index"]) == 4 and len(before["parts"]) == 24
    touched = s.merge(frame(spark, [(900, HEX, "7", at(1, 2), "7")]))
    after = s._state()
    assert len(touched) == 1 and next(iter(touched)).startswith("2025-02")
    bucket = next(iter(touched)).rpartition(".")[2]
    assert {p for p in after["parts"] if after["parts"][p] != before["parts"].get(p)} == touched
    assert {b for b in after["index"] if after["index"][b] != before["index"][b]} == {bucket}
    # the look-up opens the index of one bucket, the merge one partition
    assert all(f"index/__dir={bucket}/" in f for f in s.index({int(bucket)}, before).inputFiles())
    assert all(f"rows/__dir={next(iter(touched))}/" in f for f in s._rows(before, touched).inputFiles())
    assert sorted(r.row_id for r in s.read().collect()) == sorted({*range(240), 900} - {7})
    # the index names the partition of every message, once
    want = sorted((r["__hash"], r["__part"]) for r in s._rows(after).collect())
    assert sorted(tuple(r) for r in s.index().collect()) == want and len(want) == 240


def test_vacuum_keeps_what_the_newest_version_needs(spark, tmp_path):
    s = MessageStore(spark, f"file://{tmp_path}/store", "message", "at", "row_id", buckets=2)
    for k in range(3):
        s.merge(frame(spark, [(10 * k + i, HEX, str(i), at(9 - k, 1), str(i)) for i in range(6)]))
    assert s.vacuum() > 0 and s.vacuum() == 0
    assert sorted(r.row_id for r in s.read().collect()) == [20 + i for i in range(6)]
    assert s.manifest()[0] == 3 and sorted(s._versions()) == [3]
    assert MessageStore(spark, f"file://{tmp_path}/store", "message", "at", "row_id", buckets=9).buckets == 2


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from gaugeworks.runtime import shared_dir

    option = lambda: SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=option)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
