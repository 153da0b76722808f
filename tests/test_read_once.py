"""Queries that use a ledger several times put it together once: their results come from what was written."""

import pytest

import __spark_entry__ as entry
from ledgerloom.operators import partitions

SF_DIR = "/root/testdata/sf0.001"


def sources(df):
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


@pytest.mark.parametrize("name", ["undo_restore", "answer_batch"])
def test_no_line_items_behind_the_result(spark, name):
    assert "lineitem.parquet" not in sources(entry.queries()[name](spark, SF_DIR))


def test_documents_to_replace_come_from_the_table(spark, monkeypatch):
    seen = []
    replace = partitions.replace_documents_stored
    monkeypatch.setattr(partitions, "replace_documents_stored", lambda folder, *given: seen.extend(given) or replace(folder, *given))
    entry.queries()["stored_document_replace"](spark, SF_DIR)
    assert len(seen) == 2 and all("lineitem.parquet" not in sources(df) for df in seen)
