"""Kept file hashes: what is read again, and what is not."""

import os

from captionloom.sources.artifacts import Fingerprints, sha256_file


def test_only_changed_files_are_hashed(spark, tmp_path):
    folder = tmp_path / "jobs"
    (folder / "a").mkdir(parents=True)
    names = ["a/x.json", "a/with space.vtt", "a/odd[1]{2}*.srt", "a/é.txt", "gone.bin"]
    for n in names:
        (folder / n).write_bytes(f"content of {n}".encode())
    (folder / "empty.bin").write_bytes(b"")
    prints = Fingerprints(spark, str(tmp_path / "table"))
    got = lambda: {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in prints.files([str(folder)]).collect()}
    assert prints.update([str(folder)]) == len(names)
    assert prints.update([str(folder)]) == 0
    first = got()
    assert len(first) == len(names) and {h for _, h in first.values()} == {sha256_file(folder / n) for n in names}
    (folder / "a/x.json").write_bytes(b"longer content than before")
    os.utime(folder / "a/é.txt", (1_000_000_000, 1_000_000_000))  # as long as before, but touched
    (folder / "new.bin").write_bytes(b"n")
    (folder / "gone.bin").unlink()
    assert prints.update([str(folder)]) == 3
    assert prints.update([str(folder)]) == 0
    now = got()
    assert set(first) - set(now) == {"gone.bin"} and now["x.json"][1] == sha256_file(folder / "a/x.json") != first["x.json"][1]


def test_many_changes_are_read_in_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Fingerprints, "NAMED", 2)
    for k in range(5):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "f").write_bytes(bytes([k]))
    prints = Fingerprints(spark, str(tmp_path / "table"))
    folders = [str(tmp_path / f"in{k}") for k in range(5)]
    assert prints.update(folders) == 5 and prints.update(folders) == 0
    assert sorted(r.sha256 for r in prints.files(folders).collect()) == sorted(sha256_file(f"{f}/f") for f in folders)
