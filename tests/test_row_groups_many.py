"""Row groups over several files are those of one table."""

import pytest

from colscan import catalogue


@pytest.mark.parametrize("name", ["row_group_facts", "chunk_facts"])
def test_groups_go_over_files(spark, monkeypatch, name):
    whole = sorted(catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(catalogue, "FILE_GROUPS", 4)
    written = []
    monkeypatch.setattr(catalogue, "write", lambda df, *a, write=catalogue.write: (written.append(df.rdd.getNumPartitions()), write(df, *a)))
    assert sorted(catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect()) == whole
    assert written == [4] and len(whole) == 15
