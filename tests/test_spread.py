"""Work on the rows of one small file is dealt to all cores."""

import pytest

from docstrata.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["condition_parse", "table_match"])
def test_rows_of_one_file_are_dealt_to_all_cores(spark, name):
    assert registry.queries()[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
