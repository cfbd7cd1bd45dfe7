from unittest.mock import MagicMock

import pytest

from ledgerleaf.workdir import work_dir


def test_setting_is_used(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(base + "/ledgerleaf/x-")


def test_cluster_without_shared_folder_is_refused():
    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(spark, "x")
