"""Listing, catalogue, scan and refresh on a real directory."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuslens import (
    SearchOptions,
    build_catalogue,
    catalogue_status,
    index_search,
    open_index,
    save_index,
    search,
)
from corpuslens.operators.clauses import query_table
from corpuslens.plans import coordinator, scan
from corpuslens.plans.catalogue import catalogue
from corpuslens.plans.refresh import compact, refresh_saved
from corpuslens.schema import CATALOGUE
from corpuslens.sources.tree import files_of, list_tree, with_text


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "corpus"
    for folder in ("sub/deep", "emptydir"):
        (base / folder).mkdir(parents=True)
    for name, raw in {
        "a.txt": "Hello wörld\nfoo bar\n".encode(), "sub/b.MD": b"x",
        "sub/deep/bin.dat": b"ab\x00c", "empty.txt": b"", ".hidden.txt": b"h",
        "_under.txt": b"u", "late_nul.txt": b"a" * 600 + b"\x00",
    }.items():
        (base / name).write_bytes(raw)
    return str(base)


def _names(df, root):
    return sorted(os.path.relpath(r["path"], root) for r in df.collect())


@pytest.mark.parametrize("subtrees", [1, 7])
def test_listing_has_every_file_and_directory_once(spark, root, subtrees):
    rows = list_tree(spark, root, subtrees).collect()
    assert sorted(os.path.relpath(r["path"], root) for r in rows) == sorted([
        "a.txt", "sub", "sub/b.MD", "sub/deep", "sub/deep/bin.dat", "empty.txt", ".hidden.txt",
        "_under.txt", "emptydir", "late_nul.txt"])
    assert sum(r["is_directory"] for r in rows) == 3
    assert {r["extension"] for r in rows if r["is_directory"]} == {None}
    assert {r["size"] for r in rows if r["name"] == "late_nul.txt"} == {601}


def test_catalogue_is_rebuilt_in_place_of_the_old_one(spark, root, tmp_path):
    target = str(tmp_path / "catalogue")
    first = build_catalogue(spark, root, target)
    assert first.schema.names == CATALOGUE.names
    assert catalogue_status(first).first()["entries"] == 10
    os.remove(os.path.join(root, "a.txt"))
    assert catalogue_status(build_catalogue(spark, root, target)).first()["entries"] == 9
    assert catalogue(spark, root).count() == 9


def test_missing_root_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        list_tree(spark, str(tmp_path / "nowhere"))


def test_dangling_link_counts_as_skipped(spark, root):
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "dangling.txt"))
    _, stats = scan.scan_tree(spark, SearchOptions(search_term="a", root_directory=root))
    assert stats.first().asDict() == {
        "files_scanned": 6, "matches_found": 2, "files_skipped": 2}


@pytest.mark.parametrize("options, found, counters", [
    (dict(search_term="foo", search_content=True), ["a.txt"], (6, 1, 1)),
    (dict(search_term="WÖRLD", search_content=True), ["a.txt"], (6, 1, 1)),
    (dict(search_term="WÖRLD", search_content=True, case_sensitive=True), [], (6, 0, 1)),
    (dict(search_term="^f.o b", search_content=True, use_regex=True), ["a.txt"], (6, 1, 1)),
    (dict(search_term="B", search_content=False), ["sub/b.MD"], (6, 1, 1)),
    (dict(search_term=r"^[._]", use_regex=True), [".hidden.txt", "_under.txt"], (6, 2, 1)),
    (dict(search_term="", search_content=True),
     [".hidden.txt", "_under.txt", "a.txt", "late_nul.txt", "sub/b.MD"], (6, 5, 1)),
    (dict(search_term="x", search_content=True, max_size=100, include_extensions=(".md",)),
     ["sub/b.MD"], (1, 1, 6)),
])
def test_scan_of_a_tree(spark, root, options, found, counters):
    outcome = search(spark, SearchOptions(root_directory=root, content_search_mode="scan",
                                          **options))
    assert _names(outcome.hits, root) == found
    assert tuple(outcome.stats.first()) == counters
    assert {(r["snippet"], r["source"]) for r in outcome.hits.collect()} <= {("", "scan")}


def test_search_opens_the_index_and_drops_missing_files(spark, root, tmp_path):
    place = str(tmp_path / "index")
    options = SearchOptions(search_term="foo", search_content=True, root_directory=root,
                            content_index_path=place)
    assert _names(search(spark, options).hits, root) == ["a.txt"]
    assert search(spark, options).messages == [("status", coordinator.NO_INDEX_SCAN)]
    refresh_saved(spark, place, files_of(list_tree(spark, root)), read=with_text)
    outcome = search(spark, options)
    assert [tuple(r)[1:] for r in outcome.hits.collect()] == [
        ("Hello wörld **foo** bar ", "index")]
    assert tuple(outcome.stats.first()) == (0, 1, 0)
    assert outcome.messages == [("status", f"Searching content index: {place}")]
    os.remove(os.path.join(root, "a.txt"))
    assert search(spark, options).hits.count() == 0


def test_refresh_follows_the_tree(spark, root, tmp_path):
    place = str(tmp_path / "index")

    def refresh(**more):
        index, stats = refresh_saved(spark, place, files_of(list_tree(spark, root)),
                                     read=with_text, **more)
        return index, tuple(stats.first())

    def hits(index, text):
        query = query_table(spark, [(1, text, False, False, False, 20)])
        return _names(index_search(index, query), root)

    index, stats = refresh()
    assert stats == (6, 0, 1)
    assert hits(index, "foo") == ["a.txt"]
    index, stats = refresh()
    assert stats == (0, 6, 1)

    path = os.path.join(root, "a.txt")
    with open(path, "w") as stream:
        stream.write("changed text")
    os.utime(path, (1, 1))
    index, stats = refresh()
    assert stats == (1, 5, 1)
    assert hits(index, "foo") == [] and hits(index, "changed") == ["a.txt"]

    os.remove(path)
    index, stats = refresh()
    assert stats == (0, 5, 1)
    assert hits(index, "changed") == ["a.txt"]
    live = list_tree(spark, root)
    query = query_table(spark, [(1, "changed", False, False, False, 20)])
    assert index_search(index, query, live=live).count() == 0

    index, _ = refresh(prune=True)
    assert hits(index, "changed") == [] and index.n_docs == 5 == index.docs.count()

    before = {tuple(r) for r in index.terms().collect()}
    folded = compact(spark, place)
    assert {tuple(r) for r in folded.terms().collect()} == before
    rebuilt = save_index(spark, with_text(files_of(list_tree(spark, root))).filter(
        "extension in ('.txt', '.MD')"), str(tmp_path / "other"))
    assert {tuple(r) for r in rebuilt.terms().collect()} == before
    assert open_index(spark, place).n_docs == 5


def test_directories_that_cannot_be_read_are_told(spark, root, tmp_path):
    options = SearchOptions(search_term="foo", search_content=True)
    gone = search(spark, replace(options, root_directory=str(tmp_path / "nowhere")))
    assert gone.hits.count() == 0 and tuple(gone.stats.first()) == (0, 0, 1)
    assert gone.messages == [
        ("status", coordinator.NO_INDEX_SCAN),
        ("warning", f"Warning: Directory not found: {tmp_path / 'nowhere'}. Skipping.")]
    listing = list_tree(spark, root)
    spoiled = listing.withColumn("listing_error", F.when(
        F.col("name") == "deep", "denied").when(F.col("name") == "emptydir", "not found"))
    assert [tuple(r) for r in scan.unlisted(spoiled).orderBy("path").collect()] == [
        (f"{root}/emptydir", "not found"), (f"{root}/sub/deep", "denied")]


def test_warnings_of_a_scan(spark, root, monkeypatch):
    listed = coordinator.list_tree

    def spoiled(spark, place):
        return listed(spark, place).withColumn("listing_error", F.when(
            F.col("name") == "deep", "denied").when(F.col("name") == "emptydir", "not found"))

    monkeypatch.setattr(coordinator, "list_tree", spoiled)
    outcome = search(spark, SearchOptions(search_term="foo", search_content=True,
                                          root_directory=root, content_search_mode="scan"))
    assert outcome.messages == [
        ("warning", f"Warning: Directory not found: {root}/emptydir. Skipping."),
        ("warning", f"Warning: Access denied to directory: {root}/sub/deep. Skipping.")]
    assert tuple(outcome.stats.first()) == (6, 1, 3) and outcome.unlisted.count() == 2


def test_a_scan_opens_each_file_once(spark, root, monkeypatch, tmp_path):
    from corpuslens.sources import tree
    log, read = str(tmp_path / "opened"), tree._read_files

    def logged(limit):
        inner = read(limit)

        def batches(tables):
            def seen():
                for table in tables:
                    with open(log, "a") as stream:
                        stream.writelines(f"{p}\n" for p in table.column("path").to_pylist())
                    yield table
            return inner(seen())
        return batches

    monkeypatch.setattr(tree, "_read_files", logged)
    outcome = search(spark, SearchOptions(search_term="foo", search_content=True,
                                          root_directory=root, content_search_mode="scan"))
    assert outcome.hits.count() == 1 and tuple(outcome.stats.first()) == (6, 1, 1)
    with open(log) as stream:
        opened = stream.read().split()
    assert len(opened) == len(set(opened)) == 7


def test_driver_lists_no_directory(spark, root, monkeypatch):
    def refuse(path):
        raise AssertionError(f"the driver opened {path}")

    expected = list_tree(spark, root).count()
    monkeypatch.setattr(os, "scandir", refuse)  # tasks run in processes of their own
    assert list_tree(spark, root).count() == expected
