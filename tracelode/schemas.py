"""Row shapes of the silver tables."""

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
_IDS = T.ArrayType(_S)
SPAN = T.StructType([T.StructField("start", _L), T.StructField("end", _L)])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRACE_EVENTS = _struct(
    session_id=_S, seq=_L, id=_S, parent_id=_S, kind=_S, role=_S, name=_S, ts_raw=_S, text=_S,
    signature=_S, is_error=_B, usage=T.MapType(_S, T.DoubleType()), parent_ids=_IDS,
    parent_relations=T.MapType(_S, _S), redactions=_IDS, meta=_S, format=_S,
)

FINDINGS = _struct(
    session_id=_S, detector=T.IntegerType(), position=_L, code=_S, severity=_S, summary=_S, evidence=_IDS,
)

# One context event as the recorder writes it (camel case, as in the log).
CONTEXT_LOG = _struct(
    schemaVersion=_S, eventId=_S, sessionId=_S, agentId=_S, parentAgentId=_S, requestId=_S, attemptId=_S,
    toolCallId=_S, producerSeq=_L, monotonicMs=T.DoubleType(), wallTime=_S, parentEventIds=_IDS,
    sourceCategory=_S, sourceAlias=_S, sourceKey=_S, contentVersionKey=_S, sourceRange=SPAN, encoding=_S,
    observation=_S, evidence=_S, adapterId=_S, adapterVersion=_S, boundary=_S, handlerOrdinal=_L, coverage=_S,
    requestSpan=SPAN, sourceSpan=SPAN, matchMethod=_S, ambiguity=_S, lineageEventIds=_IDS,
    usageInputTokens=T.DoubleType(), usageOutputTokens=T.DoubleType(), usageCachedTokens=T.DoubleType(),
    estimatedTokens=_L, byteCount=_L, charCount=_L, droppedEvents=_L, unsupportedBoundary=_S,
    truncation=_B, notes=_S, rawTextRedacted=_B, rawText=_S, sourcePath=_S,
)


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


CONTEXT_EVENTS = T.StructType([T.StructField(snake(f.name), f.dataType) for f in CONTEXT_LOG])
