"""Files of small rows are written by several tasks."""

import glob
import re

import pytest

import __spark_entry__ as entry
from tideline.plans import scans


@pytest.mark.parametrize("name", ["media_inventory", "scalar_log_scan", "transcript_segments_io"])
def test_files_come_from_several_tasks(spark, tmp_path, monkeypatch, name):
    """Adaptive execution would go by bytes and let one task write all."""
    monkeypatch.setattr(scans.IO, "shared_folder", lambda _: f"{tmp_path}/out")
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    parts = {re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{tmp_path}/out/**/part-*", recursive=True) if "/json/" not in f}
    assert rows and len(parts) > 1
