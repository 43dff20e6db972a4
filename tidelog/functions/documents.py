"""JSON documents of a log system: columns to text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REPLICAS = "topic:string,partition:int,leader:int,replicas:array<int>,isr:array<int>"
#: The fields of each kind of document.
FIELDS = {
    "offset_key": "group:string,topic:string,partition:int",
    "offset_value": "offset:bigint,metadata:string,commit_timestamp:bigint,expire_timestamp:bigint",
    "transaction": "transaction_id:string,producer_id:bigint,producer_epoch:int,state:string,partitions:array<struct<topic:string,partition:int>>,timestamp:bigint,timeout_ms:bigint",
    "topic": f"config:struct<name:string,num_partitions:int,replication_factor:int,retention_hours:bigint,retention_bytes:bigint,segment_bytes:bigint,segment_ms:bigint>,partitions:array<struct<{_REPLICAS}>>",
    "broker": "broker_id:int,host:string,port:int,rack:string,state:string,registered_at:bigint,last_heartbeat:bigint",
    "vote": "current_term:bigint,voted_for:string",
    "entry": "term:bigint,index:bigint,command:string",
}
#: What a field is taken for where a document lacks it.
DEFAULTS = {
    "transaction": {"timeout_ms": 60_000},
    "broker": {"state": "starting", "registered_at": 0, "last_heartbeat": 0},
}


def _known(kind: str) -> str:
    if kind not in FIELDS:
        raise ValueError(f"unknown kind of document {kind!r}; there are {', '.join(FIELDS)}")
    return f"struct<{FIELDS[kind]}>"


def to_json(kind: str, value: Column) -> Column:
    """A struct as a document of a kind; its fields are taken by place and nulls are written."""
    return F.to_json(value.cast(_known(kind)), {"ignoreNullFields": "false"})


def from_json(kind: str, text: Column) -> Column:
    """The struct of a document; what it lacks has its default, or is null; what is no JSON is null."""
    value = F.from_json(text, _known(kind))
    for name, default in DEFAULTS.get(kind, {}).items():
        value = F.when(value.isNotNull(), value.withField(name, F.coalesce(value[name], F.lit(default))))
    return value
