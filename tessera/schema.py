"""Schemas of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


HISTOGRAM = T.MapType(STRING, INT)
VECTOR = T.ArrayType(DOUBLE)

TF = _table(doc_id=STRING, term=STRING, tf=INT)
QUERY_TF = _table(query_id=STRING, term=STRING, tf=INT)
CORPUS = _table(id=STRING, tf=HISTOGRAM)
VOCAB = _table(term=STRING, df=LONG)
DOC_NORMS = _table(doc_id=STRING, norm=DOUBLE)
CORPUS_STATS = _table(n_docs=LONG)
FEATURES = _table(doc_id=STRING, vec_idx=INT, features=T.ArrayType(T.FloatType()))
CENTROIDS = _table(idx=INT, c=T.ArrayType(T.FloatType()))
RANKING = _table(query_id=STRING, rank=INT, doc_id=STRING, score=DOUBLE)
METADATA_MUSIC = _table(stem=STRING, title=STRING, artist=STRING, genre=STRING)
METADATA_FASHION = _table(stem=STRING, name=STRING, category=STRING, subcategory=STRING)
PRODUCT_CATALOGUE = _table(
    id=STRING, productDisplayName=STRING, gender=STRING, masterCategory=STRING, subCategory=STRING, articleType=STRING, baseColour=STRING, usage=STRING, season=STRING
)
SONGS = _table(
    id=LONG, title=STRING, artist=STRING, genre=STRING, lyrics_path=STRING, audio_path=STRING, lyrics_text=STRING, lyrics_hist=HISTOGRAM, audio_hist=HISTOGRAM,
    lyrics_emb=VECTOR, audio_emb=VECTOR, metadata=T.MapType(STRING, STRING), created_at=T.TimestampType(),
)
PRODUCTS = _table(
    id=LONG, name=STRING, category=STRING, subcategory=STRING, image_path=STRING, description=STRING, desc_hist=HISTOGRAM, image_hist=HISTOGRAM,
    desc_emb=VECTOR, image_emb=VECTOR, metadata=T.MapType(STRING, STRING), created_at=T.TimestampType(),
)
CODEBOOKS = _table(app=STRING, modality=STRING, codebook_size=INT, bag_of_words=T.ArrayType(STRING), centroids_path=STRING, index_dir=STRING, created_at=T.TimestampType())
SEARCH_LOGS = _table(app=STRING, modality=STRING, engine=STRING, query=STRING, latency_ms=DOUBLE, n_results=INT, created_at=T.TimestampType())
