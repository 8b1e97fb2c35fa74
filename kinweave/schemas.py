"""Schemas of the tables that the engine reads and writes."""
from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RELATIONSHIP = _struct(ingest_seq=_L, source_id=_S, source_name=_S, source_type=_S, target_id=_S, target_name=_S, target_type=_S, relation_type=_S, source_data=_S, evidence=_S)
SCORED_EDGE = _struct(a=_S, b=_S, prob=_D, cats=T.ArrayType(_S))
SEARCH_ENTRY = _struct(canonical=_S, normalized=_S, degree=_L, sci=_I, aliases=T.ArrayType(_S))
CANONICAL = _struct(node=_S, canonical=_S, name=_S, type=_S, is_alias=_B, norm=_S)
AFFILIATION = _struct(person=_S, prop=_S, org=_S, org_label=_S, start_year=_I, end_year=_I)
OVERLAP = _struct(a=_S, b=_S, rel=_S, org=_S, start=_I, end=_I)
RESOLUTION = _struct(name=_S, qid=_S, score=_I, facts=T.ArrayType(_S))
DECEASED = _struct(name_lower=_S, death_date=_S)
EVIDENCE = _struct(src=_S, tgt=_S, rel=_S, source=_S, snippet=_S, doc=_S, page=_S, url=_S)
CLAIM = _struct(subject=_S, predicate=_S, object=_S, source_name=_S, source_url=_S, snippet=_S, email=_S)
DISPUTE = _struct(edge_key=_S, reason=_S, source_url=_S, email=_S)
PAYLOAD = _struct(key=_S, payload=_S, ts=T.TimestampType())
REGISTRY = _struct(institution_name=_S, source_type=_S, source_url=_S, format=_S, update_frequency=_S, notes=_S, scrape_status=_S)
PERSON_CSV = _struct(name=_S, anchor_relationship=_S, relationship_to_top_person=_S, top_co_occurring_person=_S, rank=_S)
