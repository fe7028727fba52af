"""Documents that cover the edge cases."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("shard", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("words", T.StringType()),
                       T.StructField("h", T.StringType()), T.StructField("n", T.StringType()), T.StructField("score", T.StringType())])
PASSAGE = " ".join(f"shared{i}{'.' if i % 9 == 8 else ''}" for i in range(60))


def own(k, n=90):
    return " ".join(f"w{k}x{i * 7 % 83}y{i}{'.' if i % 11 == 10 else ''}" for i in range(n))


TEXTS = [(1, own(1)), (2, own(2) + "\n" + PASSAGE + "\n" + own(22)), (3, own(3) + " " + PASSAGE + " " + own(33)), (4, own(1)), (5, None), (6, ""),
         (7, "one two"), (8, "one two"), (9, own(9, 4000)), (10, own(1).replace("y40", "changed")), (None, own(11)), (12, " \n\t "),
         (13, "same line here.\n" * 60), (14, "ÄÖ éè 日本語 🙂 naïve Ünïcode. " * 5), (7, "one two"), (15, "all rights reserved"), (16, "THE CC BY licence")]
