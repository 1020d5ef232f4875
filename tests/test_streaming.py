from factloom.streaming.refresh import follow


def test_only_changes_arrive(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.py").write_text("x = 1\n")
    (folder / "b.txt").write_text("no\n")
    stored, seen = {}, []

    def hashes():
        return spark.createDataFrame(list(stored.items()), "file_path string, content_hash string")

    def changed(files, _):
        for r in files.collect():
            stored[r["file_path"]] = r["content_hash"]
            seen.append(r["file_path"].rsplit("/", 1)[-1])

    for _ in range(2):
        follow(spark, str(folder), str(tmp_path / "check"), hashes, changed).awaitTermination()
        (folder / "c.ts").write_text("function f() {}\n")
    assert seen == ["a.py", "c.ts"]
