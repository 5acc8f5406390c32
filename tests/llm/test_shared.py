import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratalith.llm import jaccard_join
from stratalith.llm.shared import BATCH, READ, WIDE, small_batches, written


def test_written_tables_take_small_batches_and_put_settings_back(spark):
    before = {k: spark.conf.get(k) for k in BATCH}
    rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id bigint")
    assert [r.id for r in written(spark, rows, "firsts").orderBy("id").collect()] == [0, 1000, 2000, 3000, 4000]
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        1 / 0
    assert {k: spark.conf.get(k) for k in BATCH} == before


def test_tables_are_read_in_pieces_and_settings_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in READ}
    with small_batches(spark):
        assert {k: spark.conf.get(k) for k in READ} == READ
    assert {k: spark.conf.get(k, None) for k in READ} == before
    options = written(spark, spark.range(3), "few")._jdf.queryExecution().analyzed().relation().options()
    assert {k: options.get(k).get() for k in READ} == READ


def test_sets_have_small_row_groups(spark):
    """Sets of 24 MB in one file; before, this was one row group, which every task that read it held whole."""

    def texts(batches):
        for batch in batches:
            made = np.random.default_rng(7).integers(0, 1 << 30, (batch.num_rows, 1000)).astype(str)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(x) for x in made])], ["doc_id", "text"])

    docs = spark.range(0, 3000, 1, 1).mapInArrow(texts, "doc_id bigint, text string")
    found, sets = jaccard_join.placed(docs, 5, 80)
    (file,) = glob.glob(f"{sets._written_at.removeprefix('file://')}/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_row_groups > 1 and all(groups.row_group(i).total_byte_size < 1.5 * WIDE for i in range(groups.num_row_groups))
    assert groups.num_rows == 3000 and found.where("doc_id = component_id").count() > 0
