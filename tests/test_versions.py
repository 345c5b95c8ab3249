"""Versioned tables, and the first lines of a folder."""
import pytest
from pyspark.errors import AnalysisException

from quarry.sources import io as IO
from quarry.sources.versions import VersionedTable


def test_rewrite_reads_the_version_before(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(spark.range(10)) == 10
    old = t.read()
    assert t.rewrite(lambda d: d.where("id < 4")) == (10, 4)
    assert old.count() == 10 and t.read().count() == 4 and t.read(1).count() == 10
    assert t.rewrite(lambda d: d.where("false")) == (4, 0) and t.read().count() == 0
    assert sorted(tuple(r)[::2] for r in t.versions().collect()) == [(1, 10), (2, 4), (3, 0)]


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(5))
    staged = t.stage(spark.range(3))  # and the writer dies here
    assert t.read().count() == 5 and t.latest()["version"] == 1

    def dies(d):
        raise RuntimeError("out of luck")
    with pytest.raises(RuntimeError):
        t.rewrite(dies)
    assert t.read().count() == 5
    assert t.commit(*staged, 2) == 3 and t.read().count() == 3
    with pytest.raises(AnalysisException):  # another writer of the same version comes late
        t.commit(*staged, 2)


def test_keep_leaves_what_is_there(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.keep(spark.range(3)) == 3 and t.keep(spark.range(9)) == 3 and t.read().count() == 3


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 11, 100])
def test_first_lines_across_files(spark, tmp_path, n):
    files = {"a.jsonl": ['{"x": 1}', "", '{"x": 2}', "  ", '{"x": 3}'], "b.jsonl": ["", ""], "c.jsonl": [f'{{"x": {i}}}' for i in range(4, 9)],
             "d.jsonl": [f'{{"x": {i}}}' for i in range(9, 12)]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20")  # several blocks a file
        got = IO.read_jsonl(spark, str(tmp_path), "x long", first_n=n).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.x for r in got) == list(range(1, min(n, 11) + 1))
