"""Pack files from JSON to tables."""

import json

from ledgerloom.sources import packs


def test_two_files(spark, tmp_path):
    entry = {"id": "plum", "display_name": "Plum", "aliases": ["Plum Cafe", "ab"], "confidence": "medium", "sources": []}
    (tmp_path / "a.json").write_text(json.dumps({"version": "1", "category": "expenses.food.cafes", "merchants": [entry]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"version": "2", "category": "banks", "providers": [{"id": "bank-x", "display_name": "Bank X", "category": "bank"}, {"id": "plum", "display_name": "Plum Two"}]}))
    read = packs.read_packs(spark, str(tmp_path))
    assert read.count() == 2
    found = {(r.id, r.display_name, r.pack_version, r.status) for r in packs.institutions(read).collect()}
    # of equal ids the later file wins
    assert found == {("bank-x", "Bank X", "2", "active"), ("plum", "Plum Two", "2", "active")}
    aliases = {(r.pattern, r.canonical_merchant, r.confidence) for r in packs.merchant_aliases(read).collect()}
    assert aliases == {("plum", "Plum", "med"), ("plum cafe", "Plum", "med")}
