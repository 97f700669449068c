import json

import pytest

from sessionmill import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", app="tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Build (file, source, seq, line, value) from lists of dicts or raw strings."""
    def build(files, source="claude-code", per_chunk=1000):
        rows = []
        for name, records in files.items():
            for i, record in enumerate(records):
                value = record if isinstance(record, str) else json.dumps(record)
                rows.append((name, source, i // per_chunk, i % per_chunk, value))
        return spark.createDataFrame(rows, "file string, source string, seq long, line long, value string")
    return build
