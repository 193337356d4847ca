"""Schemas of the parse results."""

from __future__ import annotations

from pyspark.sql import types as T

I, S, B = T.IntegerType(), T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LOCATION = _struct(start_line=I, start_col=I, start_offset=I, end_line=I, end_col=I, end_offset=I)
ATTRIBUTE = _struct(name=S, value=S, prefix=S, namespace=S)
NODE = _struct(
    node_id=I, parent_id=I, sib_idx=I, depth=I, subtree_end=I, node_type=S, name=S, namespace=S, value=S, public_id=S, system_id=S,
    attrs=T.ArrayType(ATTRIBUTE), loc=LOCATION, start_tag_loc=LOCATION, end_tag_loc=LOCATION, attr_locs=T.MapType(S, LOCATION),
)
TOKEN = _struct(
    tok_idx=I, type=S, name=S, text=S, attrs=T.ArrayType(ATTRIBUTE), self_closing=B, force_quirks=B, public_id=S, system_id=S,
    loc=LOCATION, raw=S, last_start_tag=S,
)
ERROR = _struct(err_idx=I, code=S, start_line=I, start_col=I, start_offset=I, end_line=I, end_col=I, end_offset=I)
OPEN_EVENT = _struct(op=S, step=I, name=S, namespace=S)
PARSED = _struct(mode=S, nodes=T.ArrayType(NODE), errors=T.ArrayType(ERROR), html=S, dump=S, open_events=T.ArrayType(OPEN_EVENT))
