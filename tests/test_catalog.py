"""Catalog queries beside their SQL on the smallest tables; ``compare.py`` runs all of them."""

import glob
import os

import pytest

from compare import differences, duck
from undertone.plans import catalog
from undertone.plans.catalog import QUERIES
from undertone.plans.expected import SQL
from undertone.sources.event_packets import event_packets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="source tables are not here")
CHECKED = ["capture_names", "dns_export_packets", "raw_frame_packets", "flow_windows", "window_gaps", "flow_features",
           "document_entropy", "fold_scalers", "ranking_metrics", "describe_by_label", "stream_flow_windows"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF).sql(SQL[name])) == []


@pytest.mark.parametrize("files_per_trigger", [1, 64])
def test_stream_of_many_files_loses_no_packet(spark, monkeypatch, files_per_trigger):
    written = []
    write = catalog.write_packet_files
    monkeypatch.setattr(catalog, "write_packet_files", lambda packets, path, files: (write(packets, path, files), written.append(path)))
    # Latest packets first, as a table may be stored.
    packets = event_packets(spark, SF).orderBy("ts_us", ascending=False)
    got = catalog.streamed_windows(spark, packets, files=9, files_per_trigger=files_per_trigger)
    assert differences(got, duck(SF).sql(SQL["stream_flow_windows"])) == []
    files = glob.glob(f"{written[0].removeprefix('file:')}/part-*")
    assert len(files) >= 8
    tops = [spark.read.parquet(f).agg({"ts_us": "max"}).first()[0] for f in sorted(files, key=os.path.getmtime)]
    assert tops == sorted(tops)


def test_flow_and_row_counts(spark):
    assert QUERIES["flow_features"](spark, SF).count() == 544
    assert QUERIES["flow_assignment"](spark, SF).select("source_file", "flow_id").distinct().count() == 523
