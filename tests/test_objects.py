"""The partitioned listing source: hidden objects, branches and filters that bound what is opened, single objects."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import listing, objects

KEYS = ("T30/2015/a.tif", "T30/2015/.zarray", "T31/2015/_meta", "T31/2016/b.tif", "T310/c.tif", "T32/deep/er/d.tif", "X.tif", ".hidden/e.tif")


@pytest.fixture
def root(tmp_path):
    for n, k in enumerate(KEYS):
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_bytes(b"x" * n)
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def walked(root, filters=(), **options):
    """(keys, folders opened) of a reader in this process."""
    reader, opened = objects.ObjectReader({"path": root, **options}), []
    plain = objects.children

    def noted(system, path):
        opened.append(path[len(root) + 1 :])
        return plain(system, path)

    objects.children = noted
    try:
        left = list(reader.pushFilters(list(filters)))
        keys = [k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist()]
    finally:
        objects.children = plain
    assert len(keys) == len(set(keys))
    return sorted(keys), set(opened), left


def test_all_objects(spark, root):
    got = {r.key: (r.uri, r["size"]) for r in listing.list_objects(spark, root).collect()}
    assert got == {k: (f"{root}/{k}", n) for n, k in enumerate(KEYS)}
    assert {r.key for r in listing.list_objects(spark, f"file:{root}").collect()} == set(KEYS)
    assert [(r.key, r["size"]) for r in listing.list_objects(spark, f"{root}/X.tif").collect()] == [("X.tif", 6)]
    for parts in (1, 2, 5):
        assert walked(root, parts=parts)[0] == sorted(KEYS)


def test_branches(root):
    keys, opened, _ = walked(root, pattern="^(T30|T32)/.*tif$")
    assert keys == ["T30/2015/.zarray", "T30/2015/a.tif", "T32/deep/er/d.tif"]
    assert opened == {"", "T30", "T30/2015", "T32", "T32/deep", "T32/deep/er"}
    # A branch is a beginning, not a whole part.
    assert walked(root, pattern="^(T31)")[0] == ["T31/2015/_meta", "T31/2016/b.tif", "T310/c.tif"]
    assert objects.literal_branches("^(A|AB|C.d)x") == ["A", "C"]
    for whole in (None, "", "(A|B)/", "^(A|B)*x", "^(A|)x", "^(A|B)/x|y", "^([AB])", "A|B"):
        assert objects.literal_branches(whole) == [""]
    assert walked(root, prefix="T3", pattern="^(T30|X)")[0] == ["T30/2015/.zarray", "T30/2015/a.tif"]
    assert walked(root, prefix="T32/deep/e")[:2] == (["T32/deep/er/d.tif"], {"T32/deep", "T32/deep/er"})
    assert walked(root, prefix="no/such/")[0] == []


def test_filters(root):
    keys, opened, left = walked(root, [objects.StringStartsWith(("key",), "T31/2016"), objects.StringEndsWith(("key",), ".tif"), objects.EqualTo(("size",), 3)])
    assert keys == ["T31/2016/b.tif"] and opened == {"T31", "T31/2016"} and left == [objects.EqualTo(("size",), 3)]
    assert walked(root, [objects.In(("key",), ("T31/2016/b.tif", "X.tif", "none")), objects.EqualTo(("key",), "X.tif")])[:2] == (["X.tif"], {""})


def test_pushed_from_a_query(spark, root):
    rows = listing.list_objects(spark, root)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = rows.where(F.col("key").startswith("T31/") & F.col("key").endswith("a"))
    assert [r.key for r in one.collect()] == ["T31/2015/_meta"]
    assert " Filter " not in plan(one)
    assert [r.key for r in listing.select_objects(rows, "T30", ".tif").collect()] == ["T30/2015/a.tif"]
    branches = listing.list_objects(spark, root, pattern=r"^(T30|T31)/.*\.tif$")
    assert sorted(r.key for r in branches.collect()) == ["T30/2015/a.tif", "T31/2016/b.tif"]
    # Each branch is a partition of its own.
    assert branches.rdd.getNumPartitions() >= 2


def test_sizes(spark, root):
    size = lambda k: listing.object_size(spark, f"{root}/{k}")
    assert [size(k) for k in ("T30/2015/.zarray", "T31/2015/_meta", "X.tif", "T30", "T30/", "none", "no/folder")] == [1, 2, 6, None, None, None, None]
    assert listing.object_size(spark, f"PIXC:{root}/X.tif::pixel_cloud?include=a") == 6
