"""The files that a ledger of sends leaves: few of them however many chunks there were, and nothing lost on the way."""

import json
from pathlib import Path

import pyspark.taskcontext as tc
import pytest
from pyspark.sql import Row

from stocktide.operators import reconcile, sync
from stocktide.plans import inventory
from stocktide.sinks import updates

CHUNKS = 300


@pytest.fixture()
def third_task(monkeypatch):
    class Here:
        def partitionId(self):
            return 2

    monkeypatch.setattr(tc.TaskContext, "_taskContext", Here())


def rows(n):
    return [Row(product_id=k % 3, variation_id=k, request=json.dumps({"stock_quantity": k})) for k in range(n)]


def refusing(product, variation, payload):
    if variation % 10 == 0:
        raise RuntimeError("无货  refused")
    return {"sku": "v", **payload}


def kinds(folder):
    return sorted(p.suffix for p in Path(folder).glob("part-*/*"))


@pytest.mark.parametrize("whole", [updates.WHOLE, 2000])
def test_many_chunks_leave_few_files_with_all_outcomes(spark, tmp_path, third_task, monkeypatch, whole):
    monkeypatch.setattr(updates, "WHOLE", whole)
    most, add = [0], updates.Attempts.add
    monkeypatch.setattr(updates.Attempts, "add", lambda self, *a: most.append(len(kinds(tmp_path))) or add(self, *a))
    message = updates.UpdateWriter(refusing, str(tmp_path), 2, None).write(iter(rows(2 * CHUNKS)))
    assert (message.sent, message.failed, message.repeated) == (600, 60, 0)
    left = kinds(tmp_path)
    assert set(left) == {f".{updates.ENDED}"}
    if whole > 2000:
        assert len(left) == 1 and max(most) < 50
    else:  # files of WHOLE bytes stay as they are
        assert 10 < len(left) < CHUNKS / 3
    assert sum(len(p.read_bytes().splitlines()) for p in tmp_path.glob("part-2/*")) == 600  # each once
    found = updates.outcomes(spark, str(tmp_path)).collect()
    assert sorted(r["variation_id"] for r in found) == list(range(600))
    assert all(r["after"]["stock_quantity"] == r["variation_id"] if r["ok"] else r["error"] == "无货  refused" for r in found)
    assert updates.announced(spark, str(tmp_path)).distinct().count() == 600


def test_a_second_attempt_leaves_the_files_of_the_first(spark, tmp_path, third_task):
    """A job may be reading them; and what the first announced without an outcome stays known."""

    class Killed(BaseException):
        pass

    def dying(product, variation, payload):
        if variation == 79:
            raise Killed
        return refusing(product, variation, payload)

    with pytest.raises(Killed):
        updates.UpdateWriter(dying, str(tmp_path), 2, None).write(iter(rows(200)))
    first = set(tmp_path.glob("part-2/*"))
    assert kinds(tmp_path).count(f".{updates.ANNOUNCED}") == 1
    assert {r["variation_id"] for r in updates.announced(spark, str(tmp_path)).collect()} == set(range(80))
    message = updates.UpdateWriter(refusing, str(tmp_path), 2, None).write(iter(rows(200)))
    assert (message.sent, message.repeated) == (122, 78) and first < set(tmp_path.glob("part-2/*"))
    assert sorted(r["variation_id"] for r in updates.outcomes(spark, str(tmp_path)).collect()) == list(range(200))


def test_a_ledger_is_listed_without_a_job(spark, tmp_path, third_task):
    """Each file was a path of its own before, listed by a task each."""
    book = updates.Attempts(str(tmp_path))
    for k in range(60):
        book.add(k % 4, updates.ENDED, (json.dumps(updates.ended(1, k, "{}", {"sku": "v"})) + "\n").encode())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "outcomes")
    found = updates.outcomes(spark, str(tmp_path))
    jobs = tracker.getJobIdsForGroup("listing")
    spark.sparkContext.setJobGroup("none", "")
    assert not list(jobs) and found.count() == 60


def test_a_stored_plan_has_what_sends_and_results_take(spark, tmp_path, monkeypatch):
    """Notes and actions of the diff are neither made, nor shuffled or stored for a run."""
    changes, variations = inventory._changes(spark, "/root/testdata/sf0.001")
    plan, plans, put = sync.planned(changes, variations), [], sync.Ledger.put
    monkeypatch.setattr(sync.Ledger, "put", lambda self, kind, run, df: plans.append((kind, df)) or put(self, kind, run, df))
    ledger = sync.Ledger(spark, str(tmp_path))
    results = sync.write_back(ledger, "a", plan)
    assert results.count() == plan.count() > 100
    stored = dict(plans)["plan"]
    assert {"note", "action"} <= set(plan.columns) and stored.columns == sync.PLAN
    made = stored._jdf.queryExecution().optimizedPlan().toString()
    assert reconcile.NOTE_SAME not in made and reconcile.NOTHING not in made


@pytest.mark.parametrize("query", [inventory.sync_after_crash, inventory.rollback_identity])
def test_runs_and_their_images_are_never_broadcast(spark, query):
    """Ids of images are taken for a small part of their compressed files."""
    assert "Broadcast" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
