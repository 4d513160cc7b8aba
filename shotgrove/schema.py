"""Row shapes that the operators exchange."""

from pyspark.sql import types as T

EXAMPLE = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("guid", T.StringType()),
    T.StructField("text_a", T.StringType()),
    T.StructField("text_b", T.StringType()),
    T.StructField("label", T.StringType()),
])

HIT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

SCORES = T.StructType([
    T.StructField("guid", T.LongType()),
    T.StructField("label_id", T.IntegerType()),
    T.StructField("logit", T.DoubleType()),
])

QA_ARTICLES = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.StructType([
            T.StructField("context", T.StringType()),
            T.StructField("qas", T.ArrayType(T.StructType([
                T.StructField("id", T.StringType()),
                T.StructField("question", T.StringType()),
                T.StructField("is_impossible", T.BooleanType()),
                T.StructField("answers", T.ArrayType(T.StructType([
                    T.StructField("text", T.StringType()),
                    T.StructField("answer_start", T.IntegerType()),
                ]))),
            ]))),
        ]))),
    ]))),
])
