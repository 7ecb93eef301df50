import datetime

import pytest

PAYLOAD = "pass_name string, text_id string, token_ids array<int>, hs_last_token array<array<float>>, hs_mean array<array<float>>, routing_indices array<array<array<smallint>>>, routing_weights array<array<array<float>>>, routing_full_last array<array<float>>, written_at timestamp_ntz, loaded_at timestamp_ntz, rank int, label string"
NAMES = [c.split()[0] for c in PAYLOAD.split(", ")]


@pytest.fixture(scope="session")
def at():
    return lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


@pytest.fixture
def payloads(spark, tmp_path, at):
    """Write payload rows given as dicts (missing fields are null) and return the folder."""

    def write(rows):
        full = [tuple({"pass_name": "rerouted", "written_at": at(1), "loaded_at": at(2), "rank": 1, "label": "x"} .get(n) if n not in r else r[n] for n in NAMES) for r in rows]
        spark.createDataFrame(full, PAYLOAD).write.mode("overwrite").parquet(str(tmp_path / "payloads.parquet"))
        return str(tmp_path)

    return write
