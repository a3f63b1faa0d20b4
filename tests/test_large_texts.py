"""Large text files by byte ranges: equal to the whole read, whatever the cuts."""
import random

import pytest

from quarry.operators.sections import split_sections
from quarry.sources import large_texts as module
from quarry.sources.documents import read_text_files
from quarry.sources.large_texts import cut_header, read_large_sections


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.section_ord, r.section_id, r.title, r.text) for r in df.collect())


def made(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["Section 5.", "Section", "6.", "Section 7A. Of things..", "Section  8.\tT", "", "  ", "x",
                               "some text of a body", "Section nine", "é Section 3. no", "Section 12", "Section 1. "]))
    return rng.choice(["\n", "\r\n", "\n"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("chunk,split", [(1, "1m"), (40, "4k"), (1 << 20, "4k")])
def test_equals_the_whole_read(spark, tmp_path, monkeypatch, chunk, split):
    rng = random.Random(chunk)
    for i in range(12):
        (tmp_path / f"f{i:02d}.txt").write_bytes(made(rng, rng.choice([2, 3, 10, 60])).encode())
    (tmp_path / "plain.txt").write_text("no header here\n" * 30)
    (tmp_path / "long.txt").write_text("pre\n" + "".join(f"Section {i}. T{i}\n" + "body line\n" * (i * 3) for i in range(30)))
    want = rows(split_sections(read_text_files(spark, str(tmp_path)), keys=("path",)))

    def in_splits(*a, read=module.read_chunks):
        kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "4k")
        try:
            return read(*a)
        finally:
            for c, v in kept.items():
                spark.conf.set(c, v)

    monkeypatch.setattr(module, "read_chunks", in_splits)
    assert rows(read_large_sections(spark, str(tmp_path), chunk_bytes=chunk)) == want


def test_cut_header():
    assert cut_header("a\nb\nSection 5.") == ("a\nb", "Section 5.", True)
    assert cut_header("a\nb\nSection\n") == ("a\nb", "Section\n", True)
    assert cut_header("a\nSection 5.\n\n") == ("", "a\nSection 5.\n\n", False)
    assert cut_header(" \n ") == ("", " \n ", False)
    assert cut_header("a\nb\nSection 6.\nSection 7.") == ("a\nb", "Section 6.\nSection 7.", True)
    assert cut_header("one line") == ("", "one line", False)
    assert cut_header("a\nb\nSection 5. T") == ("a\nb\nSection 5. T", "", True)
