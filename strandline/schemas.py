"""Declared schemas of the tables between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_SS = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


BRONZE = _table(episode_id=_S, original_filename=_S, show_type=_S, guest_draft=_S, raw_text=_S, sentences=_SS)
SILVER = _table(episode_id=_S, original_filename=_S, show_type=_S, guest_draft=_S, content_body=_S, ads_removed_count=_L, nlp_guests=_SS)
GOLD = T.StructType([*SILVER.fields, *_table(chaos_score=_D, complexity_score=_D, sentiment=_D, visual_event_count=_L, top_concepts=_SS, business_start_index=_L).fields])
CHUNKS = _table(chunk_id=_S, episode_id=_S, text_content=_S, guest_list=_SS, top_concepts=_SS, episode_chaos=_D, stage=_S, host_probability=_D, has_visual_context=_B)
VECTORS = T.StructType([*CHUNKS.fields, T.StructField("vector", T.ArrayType(T.FloatType(), False))])
NODES = _table(id=_S, type=_S)
EDGES = _table(source=_S, target=_S, type=_S, chunk_id=_S, chaos=_B, weight=_D)
PROMPTS = _table(category=_S, query=_S)
TRACES = _table(trace_id=_L, is_root=_B, question=_S, answer=_S, status=_S, start_time=T.TimestampType(), end_time=T.TimestampType())
