"""Schemas of landed documents and streams."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def strings(*names: str) -> dict:
    return {n: S for n in names}


def longs(*names: str) -> dict:
    return {n: L for n in names}


LOG_EVENT = struct(
    node=S, _documentType=S, _plugin=S, level=S, time=T.TimestampType(), _tag_appName=S, message=S
)

COUNTER = struct(name=S, value=L)
COUNTERS = struct(groups=T.ArrayType(struct(name=S, counts=T.ArrayType(COUNTER))))
BOXED_STRING = struct(string=S)

# the union of the fields any job-history event carries
HISTORY_EVENT = struct(
    **strings(
        "jobid", "jobName", "userName", "jobQueueName", "jobStatus", "diagnostics", "taskid", "taskType",
        "status", "attemptId", "containerId", "taskStatus", "hostname", "rackname", "state", "error",
    ),
    **longs(
        "submitTime", "launchTime", "finishTime", "startTime", "totalMaps", "totalReduces", "finishedMaps",
        "finishedReduces", "mapFinishTime", "shuffleFinishTime", "sortFinishTime",
    ),
    uberized=B,
    totalCounters=COUNTERS,
    mapCounters=COUNTERS,
    reduceCounters=COUNTERS,
    counters=COUNTERS,
    successfulAttemptId=BOXED_STRING,
    failedDueToAttempt=BOXED_STRING,
    locality=BOXED_STRING,
)

API_COUNTER = struct(name=S, totalCounterValue=L, mapCounterValue=L, reduceCounterValue=L)

# Landed history-API documents by type.
DOCUMENTS = {
    "mr_job": struct(
        **strings("id", "name", "user", "queue", "state", "diagnostics"),
        uberized=B,
        **longs(
            "submitTime", "startTime", "finishTime", "mapsTotal", "mapsCompleted", "reducesTotal",
            "reducesCompleted", "avgMapTime", "avgReduceTime", "avgShuffleTime", "avgMergeTime",
            "failedReduceAttempts", "killedReduceAttempts", "successfulReduceAttempts",
            "failedMapAttempts", "killedMapAttempts", "successfulMapAttempts",
        ),
    ),
    "mr_job_counters": struct(
        id=S,
        counterGroup=T.ArrayType(struct(counterGroupName=S, counter=T.ArrayType(API_COUNTER))),
    ),
    "mr_task": struct(
        **strings("jobId", "id", "state", "type", "successfulAttempt"),
        progress=D,
        **longs("startTime", "finishTime", "elapsedTime"),
    ),
    "mr_attempt": struct(
        **strings(
            "jobId", "taskId", "id", "state", "type", "status", "rack", "nodeHttpAddress",
            "assignedContainerId", "diagnostics",
        ),
        **longs(
            "startTime", "finishTime", "elapsedTime", "shuffleFinishTime", "mergeFinishTime",
            "elapsedShuffleTime", "elapsedMergeTime", "elapsedReduceTime",
        ),
    ),
    "yarn_app": struct(
        **strings(
            "id", "name", "user", "queue", "state", "finalStatus", "applicationType", "diagnostics"
        ),
        **longs("submittedTime", "startedTime", "finishedTime", "elapsedTime", "memorySeconds", "vcoreSeconds"),
    ),
    "yarn_container": struct(
        **strings("containerId", "nodeId", "containerState", "diagnosticsInfo", "logUrl"),
        **longs("startedTime", "finishedTime", "allocatedMB", "allocatedVCores", "priority"),
    ),
    "yarn_node": struct(
        **strings("id", "rack", "state", "nodeHostName", "healthStatus"),
        **longs(
            "numContainers", "usedMemoryMB", "availMemoryMB", "usedVirtualCores", "availableVirtualCores",
            "lastHealthUpdate",
        ),
    ),
    "yarn_metrics": struct(
        **longs(
            "appsSubmitted", "appsCompleted", "appsPending", "appsRunning", "appsFailed", "appsKilled",
            "reservedMB", "availableMB", "allocatedMB", "totalMB", "containersAllocated",
            "containersReserved", "containersPending", "totalNodes", "activeNodes", "lostNodes",
            "unhealthyNodes", "decommissionedNodes", "rebootedNodes",
        )
    ),
    "spark_app": struct(
        **strings("id", "name"),
        attempts=T.ArrayType(
            struct(
                attemptId=I, completed=B, sparkUser=S, appSparkVersion=S,
                **longs("startTimeEpoch", "endTimeEpoch", "lastUpdatedEpoch", "duration"),
            )
        ),
    ),
    "spark_job": struct(
        appId=S, appAttemptId=I, jobId=I, **strings("name", "status", "submissionTime", "completionTime"),
        stageIds=T.ArrayType(I),
        **longs("numTasks", "numCompletedTasks", "numFailedTasks", "numKilledTasks"),
    ),
    "spark_executor": struct(
        appId=S, appAttemptId=I, **strings("id", "hostPort", "addTime"), totalCores=I,
        **longs("totalDuration", "totalGCTime", "memoryUsed", "diskUsed", "maxMemory"),
        executorLogs=T.MapType(S, S), memoryMetrics=T.MapType(S, L),
    ),
    "spark_stage": struct(
        appId=S, appAttemptId=I, stageId=I, attemptId=I,
        **strings("name", "status", "submissionTime", "firstTaskLaunchedTime", "completionTime"),
        **longs(
            "numTasks", "numCompleteTasks", "numFailedTasks", "numKilledTasks", "inputBytes", "outputBytes",
            "inputRecords", "outputRecords", "shuffleReadBytes", "shuffleWriteBytes", "memoryBytesSpilled",
            "diskBytesSpilled", "executorRunTime", "executorCpuTime",
        ),
        accumulatorUpdates=T.ArrayType(struct(name=S, value=S)),
    ),
    "spark_task": struct(
        appId=S, appAttemptId=I, stageId=I, stageAttemptId=I, taskId=L, launchTime=S, duration=L,
        taskMetrics=struct(
            **longs(
                "executorDeserializeTime", "executorDeserializeCpuTime", "executorRunTime", "executorCpuTime",
                "resultSize", "jvmGcTime", "resultSerializationTime", "memoryBytesSpilled", "diskBytesSpilled",
            ),
            inputMetrics=struct(**longs("bytesRead", "recordsRead")),
            outputMetrics=struct(**longs("bytesWritten", "recordsWritten")),
            shuffleReadMetrics=struct(
                **longs(
                    "remoteBlocksFetched", "localBlocksFetched", "fetchWaitTime", "remoteBytesRead",
                    "remoteBytesReadToDisk", "localBytesRead", "recordsRead",
                )
            ),
            shuffleWriteMetrics=struct(**longs("bytesWritten", "writeTime", "recordsWritten")),
        ),
    ),
    "workflow": struct(
        **strings("id", "appName", "status", "user", "createdTime", "startTime", "endTime", "lastModTime"),
        actions=T.ArrayType(
            struct(
                **strings(
                    "id", "name", "type", "status", "externalId", "externalChildIDs", "externalStatus",
                    "errorCode", "startTime", "endTime",
                ),
                retries=I,
            )
        ),
    ),
}
