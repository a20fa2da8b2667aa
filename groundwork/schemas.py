"""Schemas of the tables that are read and written."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Input files.
CORPUS = _struct(id=_S, title=_S, text=_S, metadata=T.MapType(_S, _S))
GOLD = _struct(id=_S, question=_S, reference_answer=_S, relevant_doc_ids=T.ArrayType(_S), no_answer=_B)
JUDGE_LABELS = _struct(id=_S, question=_S, reference_answer=_S, answer=_S, context=_S, abstained=_B, no_answer=_B, human_correct=_B, human_faithful=_B)

#: Tables of an index.
CHUNKS = _struct(chunk_id=_S, doc_id=_S, ordinal=_I, title=_S, text=_S, metadata=T.MapType(_S, _S), doc_seq=_L)
LISTS = _struct(term=_S, block=_L, n=_L, words=_L, max_tf=_L, min_dl=_I, postings=T.ArrayType(_struct(chunk_id=_S, doc_seq=_L, ordinal=_I, tf=_L, dl=_I)))
TERMS = _struct(term=_S, df=_L)
SIZES = _struct(n=_L, words=_L)
VECTORS = _struct(chunk_id=_S, doc_id=_S, vec=T.ArrayType(T.FloatType()))

#: One row per retrieved chunk of a question.
RANKING = _struct(question_id=_S, chunk_id=_S, rank=_I, score=_D, source=_S)
THRESHOLDS = _struct(metric=_S, floor=_D)
STORED = {"chunks": CHUNKS, "lists": LISTS, "terms": TERMS, "sizes": SIZES, "vectors": VECTORS}
