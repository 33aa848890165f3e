"""Heads of files: no more is read than is given."""

import pyarrow as pa

from proselens.operators.provenance import HEAD_BYTES
from proselens.sources import corpora


def test_heads_only(spark, tmp_path):
    (tmp_path / "deep er").mkdir()
    small, large = b"short", b"c2pa" + bytes(range(256)) * 1000
    for name, content in (("a.png", small), ("b%20é.jpg", b"x"), ("empty.png", b""), ("deep er/c.jpg", large)):
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "deep er" / "d.jpg", "wb") as f:  # a sparse file of four gigabytes, which no task could hold
        f.write(b"head")
        f.truncate(4 << 30)
    rows = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in corpora.read_images(spark, str(tmp_path)).collect()}
    assert rows == {"a.png": small, "b%20é.jpg": b"x", "c.jpg": large[:HEAD_BYTES], "d.jpg": b"head" + bytes(HEAD_BYTES - 4)}
    plan = corpora.read_images(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_bytes_asked_for():
    asked = []

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            asked.append(n)
            return b"x" * n

    class Store:
        def open_input_file(self, path):
            return File()

    assert len(corpora.head(Store(), "any")) == HEAD_BYTES and asked == [HEAD_BYTES] and isinstance(pa.array([b""]), pa.Array)
