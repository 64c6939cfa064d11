import os

import pytest

from pairloom.storage import checkpoint_dir, discard, scratch_path


def test_discard_takes_scratch_paths_alone(spark, tmp_path):
    path, other = scratch_path(spark, "rows"), scratch_path(spark, "rows")
    for p in (path, other):
        spark.range(3).write.parquet(p)
    discard(spark, path)
    assert not os.path.exists(path) and spark.read.parquet(other).count() == 3
    discard(spark, path)
    mine = tmp_path / "kept"
    mine.mkdir()
    for refused in (str(mine), checkpoint_dir(spark), os.path.dirname(path), os.path.join(other, "part")):
        with pytest.raises(ValueError):
            discard(spark, refused)
    assert mine.exists() and spark.read.parquet(other).count() == 3
