"""Job-history folding, the workflow hierarchy, and the worked workflow example."""

import json
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from meterline.operators.aggregates import attempt_outcomes
from meterline.operators.history import fold_events
from meterline.operators.joins import action_documents, attempt_containers, expand_jobs, merge_pending, record_failure, stage_tasks
from meterline.operators.projections import counters_to_columns
from meterline.operators.rollups import rollup_stages, rollup_tasks, rollup_workflow, workflow_delays
from meterline.plans.spark_report import spark_report
from meterline.plans.workflow_report import workflow_report, workflow_tables
from meterline.sources.history import find_history, history_paths, read_job_history
from meterline.sources.tables import read_docs

from helpers import plan, rows


def counters(**kv):
    return {"groups": [{"name": "g", "counts": [{"name": k, "value": v} for k, v in kv.items()]}]}


def line(kind, **event):
    return json.dumps({"type": kind, "event": {"org.x." + kind: event}})


LINES = [
    "Avro-Json",
    line("JOB_SUBMITTED", jobid="j1", jobName="n", userName="u", submitTime=1_000_500, jobQueueName="q"),
    line("JOB_INITED", jobid="j1", launchTime=1_010_000, totalMaps=2, totalReduces=1, uberized=False),
    line("JOB_QUEUE_CHANGED", jobid="j1"),
    line("TASK_STARTED", taskid="t1", taskType="MAP", startTime=1_011_000),
    line("TASK_STARTED", taskid="t2", taskType="REDUCE", startTime=1_012_000),
    line("MAP_ATTEMPT_STARTED", taskid="t1", attemptId="a1", taskType="MAP", startTime=1_011_999, containerId="c1", locality={"string": "NODE_LOCAL"}),
    line("MAP_ATTEMPT_FINISHED", taskid="t1", attemptId="a1", taskType="MAP", taskStatus="SUCCEEDED", finishTime=1_020_000, hostname="h", rackname="r",
         mapFinishTime=1_019_000, counters=counters(HDFS_BYTES_READ=5, CPU_MILLISECONDS=7)),
    line("MAP_ATTEMPT_STARTED", taskid="t1", attemptId="a2", taskType="MAP", startTime=1_013_000, containerId="c2"),
    line("MAP_ATTEMPT_KILLED", taskid="t1", attemptId="a3", taskType="MAP", status="KILLED", finishTime=1_014_000, hostname="h", rackname="r", error="e",
         counters={"groups": []}),
    line("MAP_ATTEMPT_FINISHED", taskid="t1", attemptId="a9", taskType="MAP", taskStatus="SUCCEEDED", finishTime=1, hostname="h", rackname="r", counters=counters()),
    line("REDUCE_ATTEMPT_STARTED", taskid="t2", attemptId="r1", taskType="REDUCE", startTime=1_012_000, containerId="c3"),
    line("REDUCE_ATTEMPT_FINISHED", taskid="t2", attemptId="r1", taskType="REDUCE", taskStatus="SUCCEEDED", finishTime=1_030_000, hostname="h", rackname="r",
         shuffleFinishTime=1_018_000, sortFinishTime=1_020_000, counters=counters(SPILLED_RECORDS=3)),
    line("TASK_FINISHED", taskid="t1", taskType="MAP", finishTime=1_020_000, status="SUCCEEDED", successfulAttemptId={"string": "a1"}, counters=counters(X=1)),
    line("JOB_FINISHED", jobid="j1", finishTime=1_040_000, finishedMaps=2, finishedReduces=1, totalCounters=counters(HDFS_BYTES_READ=5),
         mapCounters=counters(HDFS_BYTES_READ=4), reduceCounters={"groups": []}),
]


def test_history_files_are_listed_in_tasks(spark, tmp_path):
    """The driver keeps no list of the files: none is in the plan, whatever their number."""
    day = tmp_path / "done" / "2018" / "09" / "14"
    for name in ("000000/job_1.jhist", "000001/job_2.jhist", "000001/deep/job_3.jhist", "job_4.jhist", ".hidden/job_5.jhist", "000001/_job_6.jhist", "000001/job_7.xml"):
        (day / name).parent.mkdir(parents=True, exist_ok=True)
        (day / name).write_text("Avro-Json\n")
    found = find_history(spark, str(tmp_path), date(2018, 9, 14))
    assert found.inputFiles() == []
    assert sorted(r.path for r in found.collect()) == sorted(f"file:{day}/{n}" for n in ("000000/job_1.jhist", "000001/deep/job_3.jhist", "000001/job_2.jhist", "job_4.jhist"))
    assert [r.path.rpartition("/")[2] for r in find_history(spark, f"file://{tmp_path}", date(2018, 9, 13), "job_2").collect()] == ["job_2.jhist"]


def test_history_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "job_1.jhist").write_text("\n".join(LINES))
    folded = fold_events(read_job_history(spark, str(tmp_path)))["attempts"]
    assert plan(folded).count("from_json(") == 2  # the line, and the payload in it


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "done" / "2018" / "09" / "14" / "000017"
    os.makedirs(folder)
    (folder / "job_1-x.jhist").write_text("\n".join(LINES))
    return str(tmp_path)


def test_history_is_found_and_folded(spark, landed):
    paths = history_paths(landed, date(2018, 9, 14), "job_1", days=1)
    assert paths == [f"{landed}/done/2018/09/14/*/*job_1*jhist"]
    assert find_history(spark, landed, date(2018, 9, 14), "job_1", "2000-01-01T00:00:00").count() == 1
    folded = fold_events(read_job_history(spark, paths))
    att = {r.taskAttemptId: r for r in folded["attempts"].collect()}
    assert set(att) == {"a1", "a2", "a3", "r1"}  # a9 finished without a start
    assert (att["a1"].state, att["a1"].startTime, att["a1"].finishTime, att["a1"].elapsedTime, att["a1"].locality) == ("SUCCEEDED", 1011, 1020, 9, "NODE_LOCAL")
    assert att["a1"].counters == {"hdfsBytesRead": 5, "cpuMilliseconds": 7}
    assert (att["a2"].state, att["a2"].finishTime, att["a2"].elapsedTime) == ("KILLED", -1, -1)
    assert (att["a3"].state, att["a3"].startTime, att["a3"].elapsedTime) == ("KILLED", 0, 1014)
    r1 = att["r1"]
    assert (r1.elapsedShuffleTime, r1.elapsedMergeTime, r1.elapsedReduceTime, r1.elapsedTime) == (6, 2, 10, 18)
    (job,) = folded["jobs"].collect()
    assert (job.submitTime, job.startTime, job.finishTime, job.elapsedTime, job.runTime, job.schedulingDelay) == (1000, 1010, 1040, 40, 30, 10)
    assert job.counters == {"hdfsBytesReadTotal": 5, "hdfsBytesReadMap": 4} and job.state == "SUCCEEDED" and job.mapsTotal == 2
    tasks = {r.taskId: r for r in folded["tasks"].collect()}
    assert tasks["t1"].elapsedTime == 9 and tasks["t1"].successfulAttempt == "a1" and tasks["t2"].state is None
    out = attempt_outcomes(folded["attempts"].withColumn("jobId", F.lit("j1"))).collect()[0]
    assert (out.successfulMapAttempts, out.killedMapAttempts, out.avgMapTime, out.avgShuffleTime, out.avgReduceTime) == (1, 2, 9, 6, 10)


def test_counters_to_columns(spark):
    df = spark.createDataFrame([(1, [{"counts": [{"name": "A_B", "value": 3}]}, {"counts": []}])],
                               "id int, groups array<struct<counts: array<struct<name: string, value: bigint>>>>")
    assert rows(counters_to_columns(df, "groups", ["aB", "missing"], "Map").drop("groups")) == [(1, 3, None)]


WORKFLOW = {
    "id": "W", "appName": "map-reduce-wf", "status": "SUCCEEDED",
    "createdTime": "Fri, 10 Aug 2018 16:05:43 GMT", "startTime": "Fri, 10 Aug 2018 16:05:43 GMT", "endTime": "Fri, 10 Aug 2018 16:10:23 GMT",
    "actions": [
        {"id": "W@:start:", "name": ":start:", "type": ":START:", "externalId": "-", "externalChildIDs": None, "startTime": "Fri, 10 Aug 2018 16:05:43 GMT", "endTime": "Fri, 10 Aug 2018 16:05:43 GMT"},
        {"id": "W@hive", "name": "hive", "type": "hive", "externalId": "job_266", "externalChildIDs": "job_267,job_268", "startTime": "Fri, 10 Aug 2018 16:05:44 GMT", "endTime": "Fri, 10 Aug 2018 16:06:51 GMT"},
        {"id": "W@mr", "name": "mr", "type": "map-reduce", "externalId": "job_270", "externalChildIDs": "", "startTime": "Fri, 10 Aug 2018 16:06:51 GMT", "endTime": "Fri, 10 Aug 2018 16:10:23 GMT"},
        {"id": "W@end", "name": "end", "type": ":END:", "externalId": "-", "externalChildIDs": None, "startTime": "Fri, 10 Aug 2018 16:10:23 GMT", "endTime": "Fri, 10 Aug 2018 16:10:23 GMT"},
    ],
}


@pytest.fixture
def workflow(spark, tmp_path):
    (tmp_path / "w.json").write_text("\n".join(json.dumps({**WORKFLOW, **x}) for x in ({}, {"id": "R", "status": "RUNNING"})))
    return workflow_tables(read_docs(spark, str(tmp_path / "w.json"), "workflow"))


def test_worked_example_documents(workflow):
    wf, wfa = workflow
    (w,) = wf.collect()
    assert w.endTime - w.startTime == 280 and w.startTime == 1533917143
    assert rows(action_documents(wfa), "wfaId", "externalId", "externalChildID") == [
        ("W@hive", "job_266", "job_267"), ("W@hive", "job_266", "job_268"), ("W@mr", "job_270", "job_270"),
    ]
    assert rows(expand_jobs(wfa), "jobId", "position") == [("job_266", 0), ("job_267", 1), ("job_268", 2), ("job_270", 0)]


def test_workflow_report_levels(spark, workflow):
    wf, wfa = workflow
    t = 1533917144
    data = [
        # jobId, submit, start, finish, maps, reduces, avgMap, avgReduce, avgShuffle, avgMerge, read, cpu
        ("job_266", t + 1, t + 2, t + 60, 1, 0, 50, 0, 0, 0, 10, 1),
        ("job_267", t + 5, t + 8, t + 28, 4, 2, 3, 5, 2, 1, 100, 2),
        ("job_268", t + 30, t + 32, t + 50, 2, 0, 10, 0, 0, 0, 200, 3),
        ("job_270", t + 70, t + 75, t + 275, 3, 1, 7, 9, 1, 1, 400, 4),
    ]
    jobs = spark.createDataFrame(
        data, "jobId string, submitTime bigint, startTime bigint, finishTime bigint, mapsTotal bigint, reducesTotal bigint, avgMapTime bigint, "
        "avgReduceTime bigint, avgShuffleTime bigint, avgMergeTime bigint, hdfsBytesReadTotal bigint, cpuMillisecondsTotal bigint",
    )
    attempts = spark.createDataFrame(
        [("job_267", "MAP", "SUCCEEDED", t + 10, t + 20, 10, "NODE_LOCAL", 60), ("job_267", "MAP", "SUCCEEDED", t + 10, t + 28, 18, "OFF_SWITCH", 40),
         ("job_270", "MAP", "SUCCEEDED", t + 80, t + 100, 20, None, 5)],
        "jobId string, type string, state string, startTime bigint, finishTime bigint, elapsedTime bigint, locality string, hdfsBytesRead bigint",
    ).withColumns({c: F.lit(0).cast("bigint") for c in ("elapsedShuffleTime", "elapsedMergeTime", "elapsedReduceTime")})
    # outcome columns computed from the attempts replace those of the documents
    out = workflow_report(wf, wfa, jobs, attempts)
    (w,) = out["workflows"].collect()
    assert w.hdfsBytesReadTotal == 710 and w.nodeLocalHdfsBytesReadTotal == 60 and w.offSwitchHdfsBytesReadTotal == 40
    # actions run back to back from start to end: 0+67+212+0 covered of 280, one second before the first
    assert w.wfSchedulingDelay == 1
    # jobs without the launcher: 20 + 18 + 200 covered
    assert w.jobSchedulingDelay == 280 - 238
    act = {r.wfaId: r for r in out["actions"].collect()}
    assert act["W@hive"].submitDelay == 5 and act["W@hive"].jobDelay == 67 - 38 and act["W@hive"].hdfsBytesReadTotal == 310
    assert act["W@mr"].submitDelay == t + 70 - (t + 67) and act["W@mr"].jobDelay == 212 - 200
    assert act["W@end"].hdfsBytesReadTotal is None and act["W@end"].jobDelay == 0
    wait = {r.jobId: r.waitTime for r in out["jobs"].collect()}
    assert wait["job_267"] == 28 + t - (t + 5) - 18 and wait["job_266"] == 0
    points = [r for r in out["points"].collect() if r.jobId == "job_270"]
    assert len(points) == 26 and sum(p.mapCount for p in points) > 0 and all(p.reduceCount == 0 for p in points)


def test_rollup_gates(spark):
    wf = spark.createDataFrame([("w", 100, 200), ("open", 100, None)], "wfId string, startTime bigint, endTime bigint")
    wfa = spark.createDataFrame([("w", "a", 110, 190, "j2"), ("w", "b", 110, 190, "-"), ("w", "c", 0, 190, "-"), ("open", "d", 110, 190, "-")],
                                "wfId string, wfaId string, startTime bigint, endTime bigint, externalChildIDs string")
    job = spark.createDataFrame(
        [("j1", "w", "a", 0, 111, 112, 150, 2, 3, 10, 2500), ("j3", "w", "b", 0, 120, 125, 0, 9, 9, 9, 9), ("j4", "w", "c", 0, 120, 125, 130, 9, 9, 9, 9), ("j5", "open", "d", 0, 1, 2, 3, 9, 9, 9, 9)],
        "jobId string, wfId string, wfaId string, position int, submitTime bigint, startTime bigint, finishTime bigint, mapsTotal bigint, reducesTotal bigint, avgMapTime bigint, avgReduceTimeMs bigint",
    ).withColumns({c: F.lit(0).cast("bigint") for c in ("avgShuffleTimeMs", "avgMergeTimeMs")})
    out_wf, out_wfa = rollup_workflow(wf, wfa, job)
    (w,) = out_wf.collect()
    # per-job product truncated: 2500 ms * 3 / 1000 = 7, over 3 reduces = 2
    assert (w.wfId, w.mapsTotal, w.reducesTotal, w.weightedAvgMapTime, w.weightedAvgReduceTime) == ("w", 2, 3, 10, 2)
    got = {r.wfaId: (r.mapsTotal, r.submitDelay, r.jobDelay) for r in out_wfa.collect()}
    assert got == {"a": (None, 0, 0), "b": (None, 0, 0)}  # only a launcher; only an unfinished job


def test_delays_with_void_paths(spark):
    wf = spark.createDataFrame([("w", 100, 200)], "wfId string, startTime bigint, endTime bigint")
    wfa = spark.createDataFrame([("w", "a", 110, 150), ("w", "b", 0, 190)], "wfId string, wfaId string, startTime bigint, endTime bigint")
    job = spark.createDataFrame([("w", "a", 0, 100, 200), ("w", "a", 1, 120, 130)], "wfId string, wfaId string, position int, startTime bigint, finishTime bigint")
    (r,) = workflow_delays(wf, wfa, job).collect()
    assert (r.wfSchedulingDelay, r.jobSchedulingDelay) == (0, 90)


def test_spark_report(spark):
    apps = spark.createDataFrame([("a", 0, 1000, 1200), ("idle", 0, 5, 6)], "appId string, appAttemptId int, startTime bigint, endTime bigint")
    stages = spark.createDataFrame(
        [("a", 0, 1, 0, "COMPLETE", 1000, 1002, 1030, None, 3, 1, 2 * 1048576), ("a", 0, 1, 1, "COMPLETE", 1040, 1040, 1060, 7, 7, 0, 0),
         ("a", 0, 2, 0, "COMPLETE", 1100, 1100, 1110, 0, 0, 0, 1048575), ("a", 0, 3, 0, "FAILED", 1, 1, 2, 9, 9, 9, 9)],
        "appId string, appAttemptId int, stageId int, stageAttemptId int, status string, submissionTime bigint, firstTaskLaunchedTime bigint, completionTime bigint, "
        "numTasks bigint, numCompleteTasks bigint, numFailedTasks bigint, inputBytes bigint",
    )
    tasks = spark.createDataFrame(
        [("a", 0, 1, 0, 1002, 1010, 5), ("a", 0, 1, 0, 1010, 1020, None), ("a", 0, 1, 0, 1025, 1030, 7), ("a", 0, 1, 1, 1040, 1050, 1), ("a", 0, 9, 0, 1, 2, 3)],
        "appId string, appAttemptId int, stageId int, stageAttemptId int, launchTime bigint, endTime bigint, jvmGcTime bigint",
    )
    ex = spark.createDataFrame([("a", 0, 4), ("a", 0, None)], "appId string, appAttemptId int, totalCores int")
    out = spark_report(apps, stages, tasks, ex)
    st = {(r.stageId, r.stageAttemptId): r for r in out["stages"].collect()}
    assert set(st) == {(1, 0), (1, 1), (2, 0)}
    assert (st[1, 0].jvmGcTime, st[1, 0].numTasks, st[1, 0].totalCores) == (12, 4, 4)
    assert st[1, 0].taskSchedulingDelay == 30 - (18 + 5) and st[1, 1].taskSchedulingDelay == 0  # one task: no path
    assert st[2, 0].jvmGcTime == 0 and st[1, 0].maxParallelTasks == 2
    app = {r.appId: r for r in out["apps"].collect()}
    assert (app["a"].numStages, app["a"].jvmGcTime, app["a"].dataProc, app["a"].totalCores) == (2, 13, 2, 4)
    assert app["a"].stageSchedulingDelay == 200 - (30 + 20 + 10)
    assert (app["idle"].numStages, app["idle"].minParallelTasks, app["idle"].stageSchedulingDelay) == (0, 0, 0)


@pytest.mark.parametrize("attempt", ["id % 2", "0"])
def test_spark_report_deals_tasks_out_by_their_number(spark, attempt):
    """A task of Spark gets no more rows as the tasks grow in number, whatever the session's number of partitions."""
    ids = spark.range(2000).selectExpr("id % 3 AS appId", f"{attempt} AS appAttemptId", "id AS stageId", "0 AS stageAttemptId")
    stages = ids.selectExpr("*", "'COMPLETE' AS status", "10 AS submissionTime", "10 AS firstTaskLaunchedTime", "40 AS completionTime")
    tasks = ids.selectExpr("*", "12 AS launchTime", "20 + stageId % 7 AS endTime")
    apps = ids.select("appId", "appAttemptId").distinct().selectExpr("*", "5 AS startTime", "90 AS endTime")
    executors = apps.selectExpr("appId", "appAttemptId", "2 AS totalCores")
    out = spark_report(apps, stages, tasks, executors, n_tasks=40 * 500_000 - 1)
    wide = re.findall(r"hashpartitioning\(([^)]*), (\d+)\), (?:REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", plan(out["points"]))
    assert wide and all(n == "40" for keys, n in wide if "stageId" in keys)
    assert out["stages"].count() == 2000 and {r.numStages for r in out["apps"].collect()} <= {333, 334, 666, 667}


def test_rollup_without_metric_column(spark):
    st = spark.createDataFrame([("a", 1, 0)], "appId string, stageId int, stageAttemptId int")
    tk = spark.createDataFrame([("a", 1, 0)], "appId string, stageId int, stageAttemptId int")
    assert rollup_tasks(st, tk).collect()[0].resultSize == 0
    apps = spark.createDataFrame([("a",)], "appId string")
    assert rollup_stages(apps, st, keys=["appId"]).collect()[0].numStages == 1


def test_retry_state(spark):
    new = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    pending = spark.createDataFrame([("b", 2, 3), ("c", 1, 1)], "id string, retry_attempt_id int, number_of_failures int")
    assert rows(merge_pending(new, pending, "id"), "id", "retry_attempt_id", "number_of_failures") == [("a", None, 0), ("b", 2, 3), ("c", 1, 1)]
    failed = spark.createDataFrame([("b", 2), ("d", 1)], "id string, retry_attempt_id int")
    # b fails for the fourth time and is dropped
    assert rows(record_failure(pending, failed, "id")) == [("c", 1, 1), ("d", 1, 1)]


def test_stage_without_tasks_stays_once(spark):
    st = spark.createDataFrame([(1, 0), (2, 0)], "stageId int, stageAttemptId int")
    tk = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (7, 0, 1)], "stageId int, stageAttemptId int, d int")
    assert rows(stage_tasks(st, tk, ["stageId", "stageAttemptId"]), "stageId", "d") == [(1, 5), (1, 6), (2, None)]


def test_container_first_match(spark):
    at = spark.createDataFrame([("a1", "c1"), ("a2", "c2")], "id string, containerId string")
    co = spark.createDataFrame([("c1", "n2", 5), ("c1", "n1", 9)], "containerId string, node string, mb int")
    assert rows(attempt_containers(at, co), "id", "node", "mb") == [("a1", "n1", 9), ("a2", None, None)]
