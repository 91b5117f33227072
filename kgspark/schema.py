"""Explicit schemas of the stored tables; readers apply these instead of inferring."""

from pyspark.sql import types as T

ZETTEL = T.StructType(
    [
        T.StructField("zettel_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("luhmann_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("thought_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("is_root_topic", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
EDGE = "user_id string, child_id string, parent_id string"
MESSAGE = "id bigint, user_id bigint, message_id bigint, message_text string, message_date timestamp, message_type string, bot_answer string"
CALL_LOG = "success boolean, model string, input_tokens bigint, output_tokens bigint, duration_ms bigint, amount_rub double"
OP = "seq bigint, user_id string, op string, zettel_id string, parent_id string, luhmann_id string, content string, thought_type string, tags array<string>"
CARD = "zettel_id string, luhmann_id string, content string, thought_type string, tags array<string>, parent_id string, is_root_topic boolean"
THOUGHT = "content string, thought_type string, tags array<string>, parent_hint string, is_root_topic boolean"
