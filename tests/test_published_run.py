"""The recipes reproduce a published campaign's scores from its points."""

import json
from pathlib import Path

import pytest

from skyfront.operators import pareto

RUN = json.loads((Path(__file__).parent / "published_run.json").read_text())
REF = (-0.05, -0.05)


@pytest.fixture(scope="module")
def points(spark):
    n, q = RUN["n_initial"], RUN["batch_size"]
    rows = [("t", i, 0 if i < n else (i - n) // q + 1, *y) for i, y in enumerate(RUN["points"])]
    return spark.createDataFrame(rows, "team string, id bigint, rnd int, y1 double, y2 double")


def test_history_and_area(points):
    history = pareto.hv_history(points, "team", "rnd", "y1", "y2", REF)
    assert [r.hv for r in history.orderBy("rnd").collect()] == pytest.approx(RUN["hv_history"], abs=1e-12)
    assert pareto.auc(history, "team", "rnd").first().auc_hv == pytest.approx(RUN["auc_hv"], abs=1e-12)


def test_front_of_selected_points(points):
    front = pareto.skyline(points, "y1", "y2", keep_duplicates=False, id_col="id")
    assert front.where(f"id >= {RUN['n_initial']}").count() == RUN["n_nondominated_selected"]
