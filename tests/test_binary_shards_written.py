import threading

import pytest

from curator.sources import readers, writers


def test_files_are_opened_several_at_a_time(spark, tmp_path, monkeypatch):
    """many small files are not written one after the other; one that exists is refused."""
    make, seen, both = writers._file_writer, set(), threading.Barrier(2)

    def watched(*a):
        write = make(*a)

        def one(name, content):
            seen.add(name)
            if len(seen) <= 2:
                both.wait(30)  # broken if a second file is not begun before the first is done
            write(name, content)

        return one

    monkeypatch.setattr(writers, "_file_writer", watched)
    d = spark.createDataFrame([(f"s{i}", [i, 65535], [0, 1]) for i in range(100)], "shard_id string, tokens array<int>, elig array<int>")
    writers.write_binary_shards(d, str(tmp_path / "b"))
    assert {r.shard_id: (r.tokens, r.elig) for r in readers.binary_shards(spark, str(tmp_path / "b")).collect()} == {f"s{i}": ([i, 65535], [0, 1]) for i in range(100)}
    monkeypatch.setattr(writers, "_file_writer", make)
    with pytest.raises(writers.ImmutableError):
        writers.write_binary_shards(d.limit(1), str(tmp_path / "b"))
