"""Sources, the stored collection, ingest, append and streaming, in temporary folders."""

import os

import pytest
from conftest import plan
from pyspark.sql import functions as F

from passagework.functions.embedding import HashEmbedder
from passagework.functions.paths import folder_category, path_category, plain_path
from passagework.functions.chunking import split_text
from passagework.lineage import shared_folder
from passagework.operators.chunks import _with_metadata
from passagework.operators.ordinals import running_offsets
from passagework.operators.stats import collection_stats
from passagework.plans.ingest import add_documents, ingest
from passagework.schemas import STORED_CHUNK, Settings
from passagework.sources import collection as store
from passagework.sources.documents import assemble_pages, documents_from_pages, scan_pages, \
    scan_texts, single_documents, split_unreadable
from passagework.sources.listing import list_files, read_files
from passagework.streaming import append as streaming
from passagework.streaming.append import append_stream, replace_stream, watch_texts

EMBEDDER = HashEmbedder(16)


def folder(tmp_path, files):
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


def test_scan_texts(spark, tmp_path):
    root = folder(tmp_path, {"a.txt": "one\ntwo", "x/b +1%.txt": "three", "x/y/c.txt": " ",
                             "x/d.csv": "no"})
    got = {r.filename: r for r in scan_texts(spark, root).collect()}
    assert {k: r.category for k, r in got.items()} == {
        "a.txt": "uncategorized", "b +1%.txt": "x", "c.txt": "y"}
    assert got["a.txt"].text == "one\ntwo"
    assert got["b +1%.txt"].source == os.path.join(root, "x/b +1%.txt")
    assert {r.filename for r in scan_texts(spark, root + "/", recursive=False).collect()} == {"a.txt"}
    odd = folder(tmp_path / "odd", {"top.txt": " ", "x/bad.txt": b"\xff\xfe\x00", "x/ok.txt": "é"})
    for name in (odd, "file:" + odd, os.path.relpath(odd)):
        got = {r.filename: (r.text, r.category) for r in scan_texts(spark, name).collect()}
        assert got == {"top.txt": (" ", "uncategorized"), "bad.txt": (None, "x"), "ok.txt": ("é", "x")}
    assert scan_texts(spark, root, suffix=".none").count() == 0
    assert scan_texts(spark, root, recursive=False, suffix=".none").count() == 0
    with pytest.raises(FileNotFoundError):
        scan_texts(spark, root + "/missing")
    with pytest.raises(FileNotFoundError):
        scan_texts(spark, root + "/missing", recursive=False)


def test_every_file_is_listed_by_tasks(spark, tmp_path):
    files = {"a.txt": "one", ".hidden.txt": "two", "_made.txt": "three", "x/empty.txt": "", "x/.y/_z/deep +%.txt": "é",
             "x/bad.txt": b"\xff\xfe", "x/.txt": "suffix", "x/no.csv": "no", "x/a.TXT": "no"}
    root = folder(tmp_path, files)
    (tmp_path / "void").mkdir()
    os.symlink(tmp_path, tmp_path / "x" / "back")
    want = {os.path.join(root, k): None if "bad" in k else v for k, v in files.items() if k.endswith(".txt")}
    for name in (root, "file:" + root, os.path.relpath(root)):
        got = scan_texts(spark, name, every=True).collect()
        assert len(got) == len(want) and {r.source: r.text for r in got} == want
    assert {r.category for r in got} == {"uncategorized", "x", "_z"}
    flat = scan_texts(spark, root, recursive=False, every=True)
    assert {r.filename for r in flat.collect()} == {"a.txt", ".hidden.txt", "_made.txt"}
    # Where Spark sees a file too, both give the same row. Spark follows links to folders round and round.
    os.remove(tmp_path / "x" / "back")
    rows = {tuple(r) for r in scan_texts(spark, root, every=True).collect()}
    assert {tuple(r) for r in scan_texts(spark, root).collect()} <= rows
    assert scan_texts(spark, root + "/void", every=True).count() == 0
    with pytest.raises(FileNotFoundError):
        scan_texts(spark, root + "/missing", every=True)


def test_files_that_go_between_listing_and_reading(spark, tmp_path):
    root = folder(tmp_path, {"a.txt": "one", "b.txt": "two"})
    found = list_files(spark, root, ".txt")
    os.remove(tmp_path / "b.txt")
    assert {os.path.basename(r.path): r.content for r in read_files(found, root).collect()} == {"a.txt": b"one", "b.txt": None}
    assert sorted(r.length for r in found.collect()) == [3, 3]


def test_scan_pages_of_every_file(spark, tmp_path):
    root = folder(tmp_path, {"a.pdf": "p", "_b.pdf": "", ".c.pdf": "q"})
    pages = scan_pages(spark, root, lambda content: [content.decode()], every=True)
    assert {(os.path.basename(r.path), r.text, r.problem) for r in pages.collect()} == {
        ("a.pdf", "p", None), ("_b.pdf", "", None), (".c.pdf", "q", None)}


def test_many_folders_take_one_job_a_depth(spark, tmp_path):
    root = folder(tmp_path, {f"{a}/_{b}/{c}.txt": str(c) for a in range(20) for b in range(10) for c in range(3)})
    found = list_files(spark, root, ".txt")
    assert found.count() == 600 and found.distinct().count() == 600
    assert len(found.inputFiles()) > 3


def test_scan_pages_leaves_out_broken_files(spark, tmp_path):
    def read(content):
        if content.startswith(b"broken"):
            raise ValueError("cannot read")
        return content.decode().split("|")

    root = folder(tmp_path, {"g/a.pdf": "p1| |p3", "b.pdf": "broken", "c.pdf": " "})
    pages = scan_pages(spark, root, read)
    assert [r.problem for r in pages.where("problem is not null").collect()] == ["cannot read"]
    got = {r.filename: (r.text, r.category) for r in documents_from_pages(pages, root).collect()}
    assert got == {"a.pdf": ("p1\n\np3", "g"), "c.pdf": ("", "uncategorized")}


def test_page_assembly_over_many_blocks(spark):
    rows = [(1, p, f"t{p}" if p % 3 else " ") for p in range(2000)] + [(2, 5, " "), (3, 0, None)]
    df = spark.createDataFrame(rows, "doc long, page long, text string").repartition(5)
    got = {r.doc: r.text for r in assemble_pages(df, block=16).collect()}
    assert got == {1: "\n\n".join(f"t{p}" for p in range(2000) if p % 3), 2: "", 3: ""}


def test_category_rules(column):
    paths = ["/data/raw/f.txt", "/data/raw/a/f.txt", "/data/raw/a/b/f.txt", "/d/e/f.txt", "f.txt",
             "/raw", "/x/raw/raw/y/f"]
    assert column(lambda c: folder_category(c, "/data/raw/"), paths[:4]) == [
        "uncategorized", "a", "b", "e"]
    assert column(path_category, paths) == ["f.txt", "a", "a", "e", "", "", "raw"]
    assert column(plain_path, ["file:///a%20b+c", "file:/a", "hdfs://h/a"]) == [
        "/a b+c", "/a", "hdfs://h/a"]


def test_unreadable_documents(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "doc_id long, text string")
    good, bad = split_unreadable(df)
    assert [r.doc_id for r in bad.collect()] == [2] and good.count() == 2


def test_running_offsets(spark):
    rows = [(i * 7 % 1009, i % 5) for i in range(1009)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(6)
    got = {r.k: r.offset for r in running_offsets(df, "k").collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n


def documents(spark, n, start=0, word="word"):
    rows = [(i, (f"{word} {i}. " * (i % 7 * 60)), f"/raw/c{i % 3}/{i}.txt", f"c{i % 3}", f"{i}.txt")
            for i in range(start, start + n)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, category string, filename string")


def ids(spark, root):
    return sorted((r.ordinal, r.chunk_id) for r in store.open_collection(spark, root).collect())


def test_rebuild_append_replace_and_reopen(spark, tmp_path):
    root, docs = str(tmp_path / "store"), documents(spark, 40).repartition(3)
    assert store.open_collection(spark, root).count() == 0
    assert store.open_collection(spark, root).schema == STORED_CHUNK
    with pytest.raises(FileNotFoundError):
        add_documents(docs, root, EMBEDDER)
    report = ingest(docs, root, EMBEDDER).first()
    texts = {r.doc_id: r.text.strip() for r in docs.collect()}
    expected = {i: split_text(t, 1000, 200) for i, t in texts.items()}
    n = sum(map(len, expected.values()))
    assert (report.documents_processed, report.chunks_created, report.errors) == (40, n, 0)
    assert report.categories == {"c0": 14, "c1": 13, "c2": 13}
    assert ids(spark, root) == [(i, f"chunk_{i}") for i in range(n)]
    stored = store.open_collection(spark, root)
    got = {}
    for r in stored.orderBy("ordinal").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, [])) and len(r.embedding) == 16
        got[r.doc_id].append(r.text)
    assert got == {i: c for i, c in expected.items() if c}
    assert "PartitionFilters: [isnotnull(category" in plan(stored.where("category = 'c1'"))

    added = add_documents(documents(spark, 6, 3, "more"), root, EMBEDDER).collect()
    assert {r.filename: r.chunks_added for r in added} == {
        f"{i}.txt": len(split_text(("more %d. " % i * (i % 7 * 60)).strip(), 1000, 200))
        for i in range(3, 9)}
    m = n + sum(r.chunks_added for r in added)
    assert ids(spark, root) == [(i, f"chunk_{i}") for i in range(m)]

    # The same sources again, replacing both earlier copies.
    again = add_documents(documents(spark, 6, 3, "less"), root, EMBEDDER, replace=True).collect()
    rows = store.open_collection(spark, root).where("doc_id between 3 and 8").collect()
    assert rows and all("less" in r.text for r in rows)
    assert len(rows) == sum(r.chunks_added for r in again)
    assert min(r.ordinal for r in rows) == m

    # A rebuild starts over.
    ingest(documents(spark, 5), root, EMBEDDER)
    assert {r.doc_id for r in store.open_collection(spark, root).collect()} == {1, 2, 3, 4}


def test_unfinished_writes_are_invisible(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(documents(spark, 5), root, EMBEDDER)
    before, manifest = ids(spark, root), store.read_manifest(spark, root)
    chunks = store.open_collection(spark, root)
    # Complete data that no manifest names, in this snapshot and in the next one.
    store.write_batch(chunks, f"{store.snapshot_path(root, manifest.snapshot)}/batch=lost")
    store.write_batch(chunks, f"{store.snapshot_path(root, manifest.snapshot + 1)}/batch=lost")
    assert store.read_manifest(spark, root) == manifest and ids(spark, root) == before
    # Another writer has published the same version first.
    with pytest.raises(Exception, match="AlreadyExists"):
        store._commit(spark, root, store.Manifest(manifest.version - 1))
    assert store.read_manifest(spark, root) == manifest


def names(root):
    return sorted(os.listdir(root)), sorted(n for n in os.listdir(f"{root}/manifest") if n.endswith(".json"))


def test_old_snapshots_manifests_and_stages_go(spark, tmp_path):
    root, shared = str(tmp_path / "store"), shared_folder(spark)[len("file:"):]
    stages = set(os.listdir(shared))
    for _ in range(4):
        ingest(documents(spark, 5), root, EMBEDDER)
    folders, manifests = names(root)
    assert folders == ["manifest", "snapshot=2", "snapshot=3"] and manifests == ["2.json", "3.json"]
    for i in range(3):
        add_documents(documents(spark, 1, 10 + i), root, EMBEDDER)
    # Opening and appending read one small folder and one file, however many batches there are.
    assert names(root)[1] == ["5.json", "6.json"]
    left = [n for n in set(os.listdir(shared)) - stages for _ in os.walk(f"{shared}/{n}/empty=false")]
    assert left == []


def test_replacing_a_source_rewrites_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(documents(spark, 12), root, EMBEDDER)
    snapshot = f"{root}/snapshot=0"
    files = {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, ns in os.walk(snapshot) for n in ns}
    for word, gone in (("new", "word 5"), ("newer", "new 5")):
        add_documents(documents(spark, 1, 5, word), root, EMBEDDER, replace=True)
        rows = store.open_collection(spark, root)
        assert rows.where("doc_id = 5").count() > 0
        assert rows.where("doc_id = 5").where(F.col("text").contains(gone)).count() == 0
    assert all(os.path.getmtime(f) == at for f, at in files.items())
    assert store.open_collection(spark, root).select("doc_id").distinct().count() == 10


def test_a_label_counts_once_even_after_a_rebuild(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(documents(spark, 5), root, EMBEDDER)
    for batch in ("9", "10", "9", "10"):
        add_documents(documents(spark, 1, int(batch)), root, EMBEDDER, batch=batch)
    rows = ids(spark, root)
    assert rows == [(i, f"chunk_{i}") for i in range(len(rows))]
    ingest(documents(spark, 5), root, EMBEDDER)
    n = len(ids(spark, root))
    add_documents(documents(spark, 1, 10), root, EMBEDDER, batch="10")
    assert len(ids(spark, root)) == n


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unreadable_and_failed_documents_at_ingest(spark, tmp_path, ansi):
    from passagework.operators.stats import ingest_stats

    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        docs = documents(spark, 6).withColumn("text", F.when(F.col("doc_id") != 2, F.col("text"))) \
            .withColumn("category", F.when(F.col("doc_id") != 3, F.col("category")).otherwise(""))
        report = ingest(docs, str(tmp_path / "store"), EMBEDDER).first()
        assert (report.documents_processed, report.errors) == (5, 0)
        assert report.categories == {"c0": 1, "c1": 2, "c2": 1, "uncategorized": 1}
        stored = store.open_collection(spark, str(tmp_path / "store"))
        assert {r.category for r in stored.where("doc_id = 3").collect()} == {"uncategorized"}
        failed = _with_metadata(docs, F.lit(None).cast("array<string>"), True)
        row = ingest_stats(failed).first()
        assert (row.documents_processed, row.errors) == (0, 6)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_ordinals_do_not_depend_on_the_layout(spark, tmp_path):
    seen = set()
    for i, (cost, tasks, partitions) in enumerate((("1", 1, "8"), ("4m", 7, "8"), ("4m", 3, "2"), ("1", 5, "13"))):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            root = str(tmp_path / f"store{i}")
            ingest(documents(spark, 40).repartition(tasks), root, EMBEDDER)
            rows = store.open_collection(spark, root).select("source", "doc_id", "chunk_index", "ordinal").collect()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        order = [r[:3] for r in sorted(rows, key=lambda r: r.ordinal)]
        assert order == sorted(order) and [r.ordinal for r in sorted(rows, key=lambda r: r.ordinal)] == list(range(len(rows)))
        seen.add(tuple(order))
    assert len(seen) == 1


def test_hits_are_fetched_from_their_blocks(spark, tmp_path, monkeypatch):
    from passagework.operators.embed import embed
    from passagework.operators.search import search

    monkeypatch.setattr(store, "BLOCK_ROWS", 10)
    root = str(tmp_path / "store")
    ingest(documents(spark, 60), root, EMBEDDER)
    collection = store.open_collection(spark, root)
    question = embed(spark.createDataFrame([(1, "word 5")], "query_id long, text string"), EMBEDDER).drop("text")
    few = search(question, collection, Settings(top_k=2))
    many = search(question, collection, Settings(top_k=2, broadcast_hits=1))
    assert "dynamicpruning" in plan(few).lower()
    for hits in (few, many):
        rows = hits.collect()
        assert len(rows) == 2 and all(r.content for r in rows)
        assert "SortMergeJoin" not in plan(hits) and "ShuffledHashJoin" not in plan(hits)
    assert sorted(few.collect()) == sorted(many.collect())


def test_all_documents_blank(spark, tmp_path):
    root = str(tmp_path / "store")
    docs = documents(spark, 3).withColumn("text", F.lit(" "))
    report = ingest(docs, root, EMBEDDER).first()
    assert (report.documents_processed, report.chunks_created) == (3, 0)
    assert store.open_collection(spark, root).count() == 0
    add_documents(documents(spark, 3), root, EMBEDDER)
    assert ids(spark, root)[0] == (0, "chunk_0")


def test_batch_size_is_checked(spark):
    with pytest.raises(ValueError):
        ingest(documents(spark, 1), "/nowhere", EMBEDDER, batch_size=501)


def test_failing_documents_are_counted(spark):
    from passagework.operators.stats import ingest_stats

    rows = [(1, 0, 2, "a"), (1, 1, 2, "a"), (2, None, 0, "b"), (3, None, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, total_chunks int, category string")
    row = ingest_stats(df).first()
    assert (row.documents_processed, row.chunks_created, row.errors) == (2, 2, 1)
    assert row.categories == {"a": 1, "b": 1}


def test_collection_stats(spark):
    settings = Settings(stats_sample=10, categories=(("a", ""), ("b", "")), collection_name="c")
    df = spark.range(100).select(F.col("id").alias("ordinal"), F.when(
        F.col("id") < 4, "a").when(F.col("id") < 8, "b").alias("category"))
    row = collection_stats(df, settings).first()
    assert row.total_chunks == 100 and row.collection_name == "c"
    assert row.categories_sample == {"a": 4, "b": 4, "unknown": 2}
    assert row.available_categories == ["a", "b"]


def test_stream_appends_each_file_once(spark, tmp_path):
    root, inbox = str(tmp_path / "store"), tmp_path / "raw"
    ingest(documents(spark, 5), root, EMBEDDER)
    n = len(ids(spark, root))
    folder(inbox, {"p/a.txt": "first file", "q/r/b.txt": "second file"})

    def drain():
        stream = append_stream(watch_texts(spark, str(inbox), files_per_batch=1), root, EMBEDDER,
                               str(tmp_path / "progress"))
        stream.awaitTermination(120)
        assert stream.exception() is None

    drain()
    folder(inbox, {"p/c.txt": "third file"})
    drain()
    drain()
    rows = store.open_collection(spark, root).where(F.col("text").endswith("file")).collect()
    assert {(r.text, r.category) for r in rows} == {
        ("first file", "p"), ("second file", "q"), ("third file", "p")}
    assert ids(spark, root) == [(i, f"chunk_{i}") for i in range(n + 3)]


SCHEMA = "doc_id long, text string, source string, category string, filename string, arrived timestamp"


def deliver(spark, inbox, *rows):
    """Rows of (source, text, arrived in seconds)."""
    spark.createDataFrame([(len(s), t, s, "c", s) + (at,) for s, t, at in rows],
                          "doc_id long, text string, source string, category string, filename string, at long") \
        .withColumn("arrived", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(inbox)


def test_a_stream_keeps_the_last_content_of_each_source(spark, tmp_path, monkeypatch):
    root, inbox = str(tmp_path / "store"), str(tmp_path / "inbox")
    ingest(documents(spark, 5), root, EMBEDDER)
    start, shown = len(ids(spark, root)), []
    add = streaming.add_documents
    monkeypatch.setattr(streaming, "add_documents", lambda rows, *a, **k: (
        shown.extend(r.source for r in rows.collect()), add(rows, *a, **k))[1])

    def drain(*rows):
        shown.clear()
        deliver(spark, inbox, *rows)
        stream = replace_stream(spark.readStream.schema(SCHEMA).parquet(inbox), root, EMBEDDER, str(tmp_path / "progress"))
        stream.awaitTermination(240)
        assert stream.exception() is None
        stored = store.open_collection(spark, root).where(f"ordinal >= {start}")
        return sorted(shown), {r.source: r.text for r in stored.collect()}

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # Several deliveries of a source in one micro-batch: the last counts. Nulls are passed over, empty texts are not.
    assert drain(("a", "one", 5), ("a", "two", 6), ("a", "two", 6), ("a", "old", 1), ("b", "b", 1), ("d", None, 1), ("e", "", 1)) \
        == (["a", "b", "e"], {"a": "two", "b": "b"})
    # After a restart: unchanged, changed, older than the last, and first seen.
    assert drain(("a", "two", 7), ("b", "B", 2), ("a", "old", 3), ("d", "d", 1)) == (["b", "d"], {"a": "two", "b": "B", "d": "d"})
    # Emptied, and back to a content that was there before.
    assert drain(("a", "", 8), ("b", "b", 3)) == (["a", "b"], {"b": "b", "d": "d"})
    assert drain(("a", "one", 7)) == ([], {"b": "b", "d": "d"})
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    manifest = store.read_manifest(spark, root)
    assert manifest.labels == [] and list(manifest.marks) == ["changes"]


def test_a_micro_batch_that_fails_or_comes_again(spark, tmp_path, monkeypatch):
    root, inbox, progress = (str(tmp_path / n) for n in ("store", "inbox", "progress"))
    ingest(documents(spark, 1), root, EMBEDDER)
    deliver(spark, inbox, ("a", "one", 1), ("b", "two", 1))
    add, fails = streaming.add_documents, ["before", "after"]

    def broken(*a, **k):
        when = fails.pop(0) if fails else None
        if when == "before":
            raise RuntimeError("lost before the batch was added")
        out = add(*a, **k)
        if when == "after":
            raise RuntimeError("lost after the batch was added")
        return out

    monkeypatch.setattr(streaming, "add_documents", broken)
    for attempt in range(3):
        stream = replace_stream(spark.readStream.schema(SCHEMA).parquet(inbox), root, EMBEDDER, progress)
        try:
            stream.awaitTermination(240)
        except Exception as error:
            assert attempt < 2 and "lost" in str(error)
    rows = store.open_collection(spark, root).collect()
    assert fails == [] and sorted((r.source, r.text) for r in rows) == [("a", "one"), ("b", "two")]


def test_streams_leave_one_number_in_the_manifest(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(documents(spark, 2), root, EMBEDDER)
    for number in (0, 1, 1, 0, 2):
        add_documents(documents(spark, 1, 10 + number), root, EMBEDDER, batch=("inbox", number))
    add_documents(documents(spark, 1, 20), root, EMBEDDER)
    manifest = store.read_manifest(spark, root)
    assert manifest.marks == {"inbox": 2} and manifest.labels == [] and len(manifest.batches) == 5
    assert store.has_label(spark, root, ("inbox", 1)) and not store.has_label(spark, root, ("inbox", 3))
    # Labels of micro-batches that an earlier version listed as text are still known.
    manifest.labels.append("old-4")
    assert manifest.has(("old", 4)) and not manifest.has(("old", 3))


def test_texts_move_once_at_ingest(spark, tmp_path, monkeypatch):
    from passagework.plans import ingest as plans

    moved = []
    for name in ("stage", "write_batch"):
        where = plans if name == "stage" else store
        def spy(df, *a, real=getattr(where, name), **k):
            moved.append(sum("Exchange" in line and "Broadcast" not in line for line in plan(df).splitlines()))
            hinted = not (a[1:] and a[1]) and real.__name__ == "write_batch"
            return (real(df, *a, **k), moved.append("moved") if hinted else None)[0]
        monkeypatch.setattr(where, name, spy)
    ingest(documents(spark, 40), str(tmp_path / "store"), EMBEDDER)
    add_documents(documents(spark, 4), str(tmp_path / "store"), EMBEDDER)
    assert "moved" not in moved and moved[0] == moved[2] == 1, moved


def test_files_of_a_batch_written_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BLOCK_ROWS", 50)
    root = str(tmp_path / "store")
    ingest(documents(spark, 400).repartition(7), root, EMBEDDER)
    rows = store.open_collection(spark, root).select("ordinal", "block", "category", F.input_file_name().alias("file")).collect()
    assert all(r.block == r.ordinal // 50 for r in rows) and sorted(r.ordinal for r in rows) == list(range(len(rows)))
    # No more files than folders and, for each task, its categories in the blocks at its ends.
    folders = {(r.category, r.block) for r in rows}
    tasks = {r.file.rsplit("/", 1)[1].split("-")[1] for r in rows}
    assert len({r.file for r in rows}) <= len(folders) + 3 * len(tasks)


def test_single_documents(spark):
    df = spark.createDataFrame([("/d/raw/a/b/f.txt", "x")], "path string, text string")
    assert single_documents(df).first().category == "a"
    assert single_documents(df, "given").first().category == "given"


@pytest.mark.parametrize(("master", "fails"), [("local[8]", False), ("local", False), ("spark://a:7077", True),
                                               ("local-cluster[3,2,1024]", True), ("yarn", True)])
def test_a_cluster_needs_a_shared_folder(master, fails):
    from types import SimpleNamespace

    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None,
                              setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    if fails:
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(session)
    else:
        assert os.path.isdir(shared_folder(session))


def test_plain_scan_lists_in_tasks_what_sparks_reader_sees(spark, tmp_path):
    """The driver lists no folders, and names, empty files and links count as Spark's own reader takes them."""
    root = tmp_path / "files"
    for name, text in (("k=1/part-0.txt", "a"), ("k=1/_x.txt", "b"), ("k=1/.y.txt", "c"), ("_k=2/z.txt", "d"), ("_k3/z.txt", "e"),
                       (".k/z.txt", "f"), ("k=4/empty.txt", ""), ("k=4/a b%2F+.txt", "g"), ("k=4/other.md", "h"), ("top.txt", "i")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "linked.txt").write_text("j")
    (root / "link").symlink_to(tmp_path / "far")
    found = scan_texts(spark, str(root))
    want = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(str(root))
    assert {r.text for r in found.collect()} == {bytes(r.content).decode() for r in want.collect()}
    assert {r.filename for r in found.collect()} >= {"part-0.txt", "a b%2F+.txt", "linked.txt"}
    assert "binaryFile" not in plan(found)
