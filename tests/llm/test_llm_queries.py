import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

from sedimenta.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        compare(df, connect(sf_dir), queries.SQL[name])
    else:
        assert df.count() > 0
