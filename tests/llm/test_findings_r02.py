"""What the review of round 2 found in the pipeline: files of settled tables, and slices of what is worked on at a time."""

import os

import numpy as np

from tessera.llm import common, components


def test_settled_tables_are_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 20_000, 1, 211)

    def files(df):
        return sum(x.endswith(".parquet") for x in os.listdir(df._settled.removeprefix("file://")))

    plain, small = common.settle(wide), common.settle(wide, rows=20_000)
    assert files(plain) <= 6 * cores and files(small) <= cores
    for found in (plain, small):
        assert found.count() == 20_000 and found.distinct().count() == 20_000


def test_slices_are_bounded():
    sizes = np.array([3, 4, 50, 1, 1, 1, 9, 2])
    found = list(common.slices(sizes, 10))
    assert [k for x in found for k in range(len(sizes))[x]] == list(range(len(sizes)))
    assert all(sizes[x].sum() <= 10 or x.stop - x.start == 1 for x in found) and len(found) == 5
    assert list(common.slices(sizes[:0], 10)) == []


def test_a_prefix_is_one_row_until_it_is_joined(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(20)]
    rows = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "uid long, part long, shingles binary")
    assert components.prefixed(rows, 0.8).count() == 20
