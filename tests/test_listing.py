"""Listing in tasks, depth by depth."""

import os

import pyarrow as pa

from sieveline.sources import files, sinks, tables


def test_tree_of_folders(spark, tmp_path):
    for name in ("a.txt", "b c/é.MD", "b c/d/e.pdf", "b c/d/_hidden.txt", ".git/x.txt", "b c/d/f/README.md", "n.doc", "b c/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "x")
    (tmp_path / "no files").mkdir()
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.stem, r.suffix, r.length) for r in files.list_files(spark, f"file://{tmp_path}", True).collect()}
    assert got == {
        "a.txt": ("a", "txt", 1), "b c/é.MD": ("é", "md", 1), "b c/d/e.pdf": ("e", "pdf", 1), "b c/empty.txt": ("empty", "txt", 0)
    }
    texts = {r.file: r.text for r in files.load_texts(spark, f"file://{tmp_path}", True).collect()}
    assert set(texts) == {f"file:{tmp_path}/{k}" for k in got} and texts[f"file:{tmp_path}/b c/empty.txt"] == ""
    one = files.load_texts(spark, f"file://{tmp_path}/b c/empty.txt").collect()
    assert [(r.stem, r.text) for r in one] == [("empty", "")]
    assert files.list_files(spark, f"file://{tmp_path}/no files").count() == 0


def test_many_files(spark, tmp_path):
    for k in range(100):
        folder = tmp_path / f"{k % 10}" / f"{k}"
        folder.mkdir(parents=True)
        for i in range(1000):
            os.close(os.open(folder / f"{i}.txt", os.O_CREAT))
    listed = files.tree(spark, f"file://{tmp_path}")
    assert listed.count() == 100_000 == listed.select("path").distinct().count()


def test_json_files_are_named_in_tasks_only(spark, tmp_path, monkeypatch):
    """No plan holds the files' names: a plan that does keeps them all in the driver's memory."""
    for k in range(300):
        (tmp_path / f"k {k}%.json").write_text(f'{{"id": {k}}}')
    (tmp_path / "empty.json").write_text("")
    for name in ("_SUCCESS", ".k.json.crc", "sub/in.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"id": -1}')
    planned = []

    def watched(df, label):
        planned.extend(df.inputFiles())
        return kept(df, label)

    kept = tables.stored
    monkeypatch.setattr(tables, "stored", watched)
    monkeypatch.setattr(files, "stored", watched)
    back = tables.read_json_by_key(spark, f"file://{tmp_path}", "id long")
    assert {(r.key, r.value and r.value.id) for r in back.collect()} == {(f"k {k}%", k) for k in range(300)} | {("empty", None)}
    assert not [p for p in planned if p.endswith(".json")]
    one = tables.read_json_by_key(spark, str(tmp_path / "k 7%.json"), "id long").collect()
    assert [(r.key, r.json, r.value.id) for r in one] == [("k 7%", '{"id": 7}', 7)]


def test_a_large_folder_comes_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ENTRIES_A_BATCH", 10)
    for k in range(95):
        (tmp_path / f"{k}.json").write_text("x" * k)
    os.symlink(tmp_path / "nowhere", tmp_path / "z.json")
    given = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}"])], ["path"])
    got = list(files._children(sinks.Store(f"file:{tmp_path}"))(iter([given])))
    assert len(got) == 10 and max(b.num_rows for b in got) == 10
    rows = {r["path"]: r["length"] for b in got for r in b.to_pylist()}
    assert rows == {f"file:{tmp_path}/{k}.json": k for k in range(95)} | {f"file:{tmp_path}/z.json": 0}
    made = files._bytes_of(sinks.Store(f"file:{tmp_path}"))
    monkeypatch.setattr(files, "BATCH_BYTES", 100)
    paths = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/{k}.json" for k in range(95)])], ["path"])
    read = list(made(iter([paths])))
    assert len(read) > 30 and [len(r["content"]) for b in read for r in b.to_pylist()] == list(range(95))
