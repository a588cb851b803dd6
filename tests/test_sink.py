"""The scored table: replays change nothing, bad rows are kept apart, triggers do not matter."""

import pytest

from compare import differences, duck
from undertone.plans import catalog
from undertone.plans.expected import SQL
from undertone.sources.history import commits
from undertone.streaming import sink

SF = "/root/testdata/sf0.001"
SCHEMA = "flow_id string, isolation_forest_score double, autoencoder_reconstruction_error double"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, one = str(tmp_path / "table"), batch(spark, ("a", 0.1, 2.0), ("b", -0.2, 3.0))
    assert sink.read_scored(spark, path, one.schema).count() == 0
    assert sink.commit_batch(one, 0, path) and not sink.commit_batch(one, 0, path)
    assert sink.commit_batch(batch(spark, ("c", 0.3, 1.0)), 1, path)
    # The same batch with other rows, as a restarted source might give it.
    assert not sink.commit_batch(batch(spark, ("z", 0.3, 1.0)), 1, path)
    assert sorted(r["flow_id"] for r in sink.read_scored(spark, path, one.schema).collect()) == ["a", "b", "c"]


def test_a_writer_lost_on_the_way_leaves_no_rows(spark, tmp_path):
    path, one = str(tmp_path), batch(spark, ("a", 0.1, 2.0))
    # Rows without a commit, and a commit without content.
    sink.with_reason(one).selectExpr("*", "false quarantined").write.partitionBy("quarantined").parquet(f"{path}/batches/run=orphan")
    (tmp_path / "_commits").mkdir()
    (tmp_path / "_commits" / "000000000000.json").write_text("")
    assert sink.read_scored(spark, path, one.schema).count() == 0
    assert sink.commit_batch(one, 0, path)
    assert sink.read_scored(spark, path, one.schema).count() == 1 and list(commits(spark, path)) == [0]


def test_rows_without_scores_are_kept_apart(spark, tmp_path):
    path = str(tmp_path)
    rows = batch(spark, ("a", 0.1, 2.0), ("b", None, 2.0), ("c", 0.1, float("nan")), ("d", float("inf"), float("inf")))
    sink.commit_batch(rows, 0, path)
    sink.commit_batch(rows.limit(0), 1, path)
    assert [r["flow_id"] for r in sink.read_scored(spark, path, rows.schema).collect()] == ["a"]
    assert {r["flow_id"]: r["reason"] for r in sink.read_quarantine(spark, path, rows.schema).collect()} == {
        "b": "no finite isolation_forest_score", "c": "no finite autoencoder_reconstruction_error",
        "d": "no finite isolation_forest_score"}


@pytest.mark.parametrize("files_per_trigger", [1, 64])
def test_scored_stream_has_the_rows_of_its_sql(spark, files_per_trigger):
    got = catalog.stream_scores(spark, SF, files=5, files_per_trigger=files_per_trigger)
    assert differences(got, duck(SF).sql(SQL["stream_scores"])) == []


def test_flows_that_start_together_have_their_own_names():
    from undertone.streaming.live import conversation_name

    keys = [("a.pcap", "dns", "10.0.0.1", k, "10.0.0.2", 53) for k in range(1000)]
    assert len({conversation_name(k) for k in keys}) == 1000 and conversation_name(keys[0]) == conversation_name(tuple(keys[0]))
