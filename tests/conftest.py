import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from embertrace.schema import wide_schema  # noqa: E402
from embertrace.session import build  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def wide(spark):
    """Wide records from dicts; ids count up where none is given."""
    schema = wide_schema()

    def make(*records, **common):
        rows = []
        for n, r in enumerate(records, 1):
            row = {"id": n, "event_type_id": 1, "event_time": datetime(2024, 1, 10, 12, 0, n % 60), **common, **r}
            rows.append(tuple(row.get(f.name) for f in schema.fields))
        return spark.createDataFrame(rows, schema)

    return make
