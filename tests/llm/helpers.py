from pyspark.sql import types as T

#: Documents with an extra column whose name also occurs inside the operators.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " "), (4, "\n\t "), (None, "some words without an id"), (5, "twice"), (5, "twice")]
