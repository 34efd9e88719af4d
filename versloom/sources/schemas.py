"""Explicit schemas of the records that are read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """Parsed without a session, so that schemas can be used anywhere."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


VERSE_REF = _struct("reference string,word_count int")
VERSE = _struct("seq int,book string,chapter int,verse int,text string,reference string")
BLOCK = T.StructType(
    [
        *_struct(
            "block_id string,run_id string,voice string,frame_narrator string,quote_status string,quote_source string,target_size int,word_count int,verse_count int,"
            "start_ref string,end_ref string,book string,start_chapter int,start_verse int,end_chapter int,end_verse int,is_remainder boolean,is_undersized boolean,merged_remainder boolean,text string"
        ).fields,
        T.StructField("verse_refs", T.ArrayType(VERSE_REF)),
    ]
)
MANIFEST = _struct("author string,title string,translator string,gutenberg_id int,publication_year int,genre string,filename string,word_count int")
ATTRIBUTION = _struct("speaker string,book string,chapter int,verse int,text string")
PERMUTATION = _struct("perm_id int,unit_id string,label string")
SCORE = _struct("perm_id int,variant string,score double")
