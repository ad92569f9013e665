"""Explicit schemas of the file sources."""

from pyspark.sql import types as T

S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MANIFEST = struct(
    task_name=S,
    attempts=T.ArrayType(struct(
        number=I, success=B, reward=D, exception_info=S, outcome=S, trajectory_available=B,
        reflection_files=T.ArrayType(S))))

RAW_RESULT = struct(
    truncated=S, content=S, is_error=B, tool_use_id=S,
    raw_tool_result=struct(content=S), tool_use_result=struct(stdout=S, stderr=S))

RAW_STEP = struct(
    step=I, source=S, message=S, step_id=S,
    extra=struct(tool_use_name=S, tool_use_id=S, raw_arguments=T.MapType(S, S),
                 tool_result_metadata=RAW_RESULT, is_error=B))

TRAJECTORY = struct(steps=T.ArrayType(RAW_STEP))

RESULT = struct(
    task_name=S, trial_name=S, exception_info=S, reward=D,
    verifier_result=struct(rewards=struct(reward=D), error=S))

CONTENT_BLOCK = struct(type=S, text=S, id=S, name=S, input=T.MapType(S, S), tool_use_id=S, content=S, is_error=B)

# ``message`` and ``content`` are text or lists; they stay JSON text and are parsed by shape.
LOG_EVENT = struct(type=S, message=S, step_id=S, tool_use_id=S, is_error=B, tool_use_result=S, result=S)
LOG_MESSAGE = struct(content=S)
