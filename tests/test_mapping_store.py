"""Versions of mappings: followed once, superseded, never changed."""

from dataclasses import replace

import pytest

from tests.test_language import MAPPING
from tracemill.plans import mapping_store as store


def test_versions_follow_each_other_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "mappings")
    assert store.current(spark, root, MAPPING.name) is None and store.mappings(spark, root).count() == 0
    first = store.save(spark, root, MAPPING)
    assert first.version == 1 and store.current(spark, root, MAPPING.name) == first
    with pytest.raises(store.Conflict):
        store.save(spark, root, MAPPING)  # the name is taken
    second = store.save(spark, root, replace(MAPPING, entities=MAPPING.entities[:1]), follows=1)
    with pytest.raises(store.Conflict, match="version 2"):
        store.save(spark, root, MAPPING, follows=1)
    store.save(spark, root, replace(MAPPING, name="öther"))
    log = {(r["name"], r["version"]): (r["supersedes"], r["superseded"]) for r in store.mappings(spark, root).collect()}
    assert log == {(MAPPING.name, 1): (None, True), (MAPPING.name, 2): (1, False), ("öther", 1): (None, False)}
    assert store.current(spark, root, MAPPING.name) == second
    # a writer that read the log before the second version was stored
    monkeypatch.setattr(store, "current", lambda *_: first)
    with pytest.raises(store.Conflict, match="meanwhile"):
        store.save(spark, root, MAPPING, follows=1)


def test_invalid_mappings_are_not_stored(spark, tmp_path):
    root = str(tmp_path / "mappings")
    bad = replace(MAPPING, entities=(replace(MAPPING.entities[0], target="nothing"),))
    with pytest.raises(ValueError, match="invalid"):
        store.save(spark, root, bad)
    assert store.mappings(spark, root).count() == 0
