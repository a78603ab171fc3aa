"""Score requests answered from a stream, with a registry of clauses for each problem as state."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lemmaflow.session import shared_path

OUT = "problem long, request_pos long, n_requested long, n_known long, cached boolean, score_sum double"
STATE = "registry string, pending string, cache string"


def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Messages in order of pos: register (ids with conj_dist), request (ids; the newest replaces one that waits), start (answers it)."""
    registry, pending, cache = {}, None, {}
    if state.exists:
        registry, pending, cache = map(json.loads, state.get)
    out = []
    rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
    for pos, tag, clause_id, conj_dist in zip(rows["pos"], rows["tag"], rows["clause_id"], rows["conj_dist"], strict=True):
        if tag == "register":
            registry[str(clause_id)] = int(conj_dist)
        elif tag == "request":
            pending = [int(pos), [str(clause_id - k) for k in range(3)]]
        elif tag == "start" and pending:
            asked, ids = pending
            known = [i for i in ids if i in registry]
            name = ",".join(ids)
            hit = name in cache
            cache.setdefault(name, sum(2.0 / (1 + registry[i]) for i in known))
            out.append((key[0], asked, len(ids), len(known), hit, cache[name]))
            pending = None
    state.update(tuple(map(json.dumps, (registry, pending, cache))))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def replay(messages: DataFrame) -> DataFrame:
    """messages (streaming): problem, pos, tag, clause_id, conj_dist."""
    return messages.groupBy("problem").applyInPandasWithState(answer, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs over all that is there, into files of the folder that the cluster shares."""
    path = shared_path(spark)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of messages."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    tag = F.when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "signup", "start").otherwise("register")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("problem"), F.col("event_id").alias("pos"), tag.alias("tag"), F.col("event_id").alias("clause_id"), (k % 7).alias("conj_dist"))
