"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from tessera.functions.text import PUNCTUATION_AND_DIGITS, STOPWORDS
from tessera.plans import fixtures

K, CODEBOOK, WORDS, CENTROIDS, EVERY = 10, 1000, 32, 8, 20


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '{PUNCTUATION_AND_DIGITS}', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _counts(table: str, key: str, name: str, where: str = "true") -> str:
    return f"(SELECT {key} AS {name}, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT {key}, unnest({_words('text')}) AS term FROM {table} WHERE {where}) GROUP BY 1, 2)"


TF = f"tf AS {_counts('documents', 'doc_id', 'doc_id')}"
DF = "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tf)"
IDF = "CASE WHEN df > 0 AND n_docs > 0 THEN log10(n_docs / df) ELSE 0 END"
WEIGHTS = f"w AS (SELECT doc_id, term, (1 + log10(tf)) * {IDF} AS w FROM tf JOIN df USING (term), n), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"
ALL_QUERIES = f"q AS {_counts('benchmark', 'item_id', 'query_id')}"
FEW_QUERIES = f"q AS {_counts('benchmark', 'item_id', 'query_id', f'item_id % {EVERY} = 0')}"
CODES = f"codebook AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY term ORDER BY n DESC, term LIMIT {CODEBOOK})"
BASE = f"WITH {TF}, {DF}, {WEIGHTS}"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"
#: The index's ranking of queries q (query_id, term, tf).
INDEX = (
    f"qw AS (SELECT query_id, term, (1 + log10(tf)) * {IDF} AS wq FROM q JOIN df USING (term), n), qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS q_norm FROM qw GROUP BY query_id HAVING sqrt(sum(wq * wq)) > 0), "
    "hits AS (SELECT query_id, doc_id, sum(wq * w) AS dot FROM qw JOIN qn USING (query_id) JOIN w USING (term) GROUP BY query_id, doc_id), "
    "scored AS (SELECT query_id, doc_id, round(CASE WHEN q_norm * norm > 0 THEN dot / (q_norm * norm) ELSE 0 END, 6) AS score FROM hits JOIN qn USING (query_id) JOIN norms USING (doc_id)), "
    f"ranked AS (SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, score FROM scored)"
)
#: Unit vectors of documents and queries, and all their pairs.
UNITS = (
    "d AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS w FROM w JOIN norms USING (doc_id)), "
    f"qw0 AS (SELECT query_id, term, (1 + log10(tf)) * {IDF} AS w FROM q JOIN df USING (term), n), qw1 AS (SELECT * FROM qw0 WHERE w <> 0), "
    "qu AS (SELECT query_id, term, w / norm AS w FROM qw1 JOIN (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw1 GROUP BY query_id) USING (query_id)), "
    "grid AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM qu), (SELECT DISTINCT doc_id FROM d))"
)
#: Gaps over the union of keys of each pair.
GAPS = (
    "gaps AS (SELECT query_id, doc_id, abs(d.w - coalesce(qu.w, 0)) AS g FROM grid JOIN d USING (doc_id) LEFT JOIN qu USING (query_id, term) "
    "UNION ALL SELECT query_id, doc_id, abs(qu.w) FROM grid JOIN qu USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = grid.doc_id AND d.term = qu.term))"
)
FIRST = f"c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS idx, embedding AS c FROM embeddings ORDER BY vec_id LIMIT {CENTROIDS})"
NEAREST = f"WITH {FIRST}, near AS (SELECT vec_id, label, embedding, min_by(idx, (dist, idx)) AS idx FROM (SELECT vec_id, label, embedding, idx, list_distance(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[])) AS dist FROM embeddings, c) GROUP BY vec_id, label, embedding)"
COSINES = (
    f"found AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0), "
    f"ranked AS (SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, score FROM found QUALIFY rank <= {K})"
)
LINES = (
    r"lines AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS parts FROM documents), "
    "kept AS (SELECT doc_id, CASE WHEN len(list_filter(parts, lambda x: length(x) >= 20)) > 0 THEN list_filter(parts, lambda x: length(x) >= 20) ELSE parts[1:1] END AS parts FROM lines), "
    "chunks AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM kept)"
)
TEXTS = "t AS (SELECT CAST(doc_id AS VARCHAR) AS stem, doc_id || '.txt' AS path FROM documents)"
PARTS = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS stem, p_partkey FROM part)"
BOTH = f"WITH {TEXTS}, {PARTS}, both_ AS (SELECT coalesce(t.stem, p.stem) AS stem, t.path AS lyrics_path, p.stem || '.wav' AS audio_path FROM t FULL JOIN p ON t.stem = p.stem)"


def _dense(scores: str, order: str) -> str:
    return f"{BASE}, {FEW_QUERIES}, {UNITS}, {scores} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= {K}"


def _minkowski(score: str) -> str:
    return _dense(f"{GAPS}, scored AS (SELECT query_id, doc_id, round({score}, 6) AS score FROM gaps GROUP BY query_id, doc_id)", "ASC")


def _demo() -> str:
    """All four metrics over the literal collections: every document counts for df, whatever its tf."""
    parts = []
    for modality, docs, queries in (("text", fixtures.TEXT, fixtures.TEXT_QUERIES), ("image", fixtures.IMAGE, fixtures.IMAGE_QUERIES), ("audio", fixtures.AUDIO, fixtures.AUDIO_QUERIES)):
        values = lambda c: ", ".join(f"('{k}', '{t}', {n})" for k, own in c.items() for t, n in own.items())
        base = f"tf(doc_id, term, tf) AS (VALUES {values(docs)}), q(query_id, term, tf) AS (VALUES {values(queries)}), {DF}, {WEIGHTS}, {UNITS}, {GAPS}"
        scores = "dots AS (SELECT query_id, doc_id, sum(qu.w * d.w) AS c FROM qu JOIN d USING (term) GROUP BY query_id, doc_id), scored AS (" + " UNION ALL ".join(
            [
                "SELECT 'cosine' AS metric, query_id, doc_id, round(coalesce(c, 0), 6) AS score, -round(coalesce(c, 0), 6) AS place FROM grid LEFT JOIN dots USING (query_id, doc_id)",
                *(f"SELECT '{m}', query_id, doc_id, round({e}, 6) AS score, round({e}, 6) FROM gaps GROUP BY query_id, doc_id" for m, e in (("manhattan", "sum(g)"), ("euclidean", "sqrt(sum(g * g))"), ("chebyshev", "max(g)"))),
            ]
        )
        parts.append(f"SELECT * FROM (WITH {base}, {scores}) SELECT '{modality}' AS modality, metric, query_id, CAST(row_number() OVER (PARTITION BY metric, query_id ORDER BY place, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= 3)")
    return " UNION ALL ".join(parts)


def statements() -> dict[str, str]:
    safe = lambda c: f"trim(regexp_replace({c}, '[^a-zA-Z0-9._-]+', '_', 'g'), '_')"
    own = {
        "tf": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
        "df": f"WITH {TF}, {DF} SELECT term, df FROM df",
        "idf": f"WITH {TF}, {DF} SELECT term, df, round({IDF}, 6) AS idf FROM df, n",
        "tfidf_weights": f"{BASE} SELECT doc_id, term, round(w, 6) AS w FROM w",
        "l2_normalized": f"{BASE} SELECT doc_id, term, round(CASE WHEN norm > 0 THEN w / norm ELSE w END, 6) AS w FROM w JOIN norms USING (doc_id)",
        "doc_norms": f"{BASE} SELECT doc_id, round(norm, 6) AS norm FROM norms",
        "postings": f"WITH {TF}, {DF} SELECT term, df, doc_id, tf FROM tf JOIN df USING (term)",
        "corpus_stats": f"WITH {TF} SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS vocab_size, count(*) AS n_postings FROM tf",
        "codebook_topk": f"WITH {TF}, {CODES} SELECT term, n FROM codebook",
        "codebook_filtered_tf": f"WITH {TF}, {CODES} SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM codebook)",
        "prepare_query": f"WITH {TF}, {CODES}, {ALL_QUERIES} SELECT query_id, term, tf FROM q WHERE term IN (SELECT term FROM codebook)",
        "split_text": f"WITH {LINES} SELECT doc_id || '#chunk' || lpad(CAST(pos AS VARCHAR), CAST(greatest(3, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') AS chunk_id, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks",
        "row_histogram": f"WITH {LINES}, tf AS (SELECT CAST(doc_id AS VARCHAR) AS stem, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM chunks) GROUP BY 1, 2), {CODES} SELECT stem, term, tf FROM tf WHERE term IN (SELECT term FROM codebook)",
        "hist_to_dense": f"WITH {TF}, keys AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS dim FROM (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {WORDS})), "
        "own AS (SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM keys)), sizes AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM own GROUP BY doc_id) "
        "SELECT doc_id, dim, round(coalesce(tf, 0) / norm, 6) AS value FROM sizes CROSS JOIN keys LEFT JOIN own USING (doc_id, term)",
        "word_quantizer_hist": f"WITH {TF}, keys AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {WORDS}) SELECT doc_id, term, CAST(coalesce(tf, 0) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM tf) CROSS JOIN keys LEFT JOIN tf USING (doc_id, term)",
        "spimi_topk": f"{BASE}, q AS (SELECT doc_id AS query_id, term, tf FROM tf WHERE doc_id = (SELECT min(doc_id) FROM documents)), {INDEX} SELECT rank, doc_id, score FROM ranked WHERE rank <= {K}",
        "spimi_topk_batch": f"{BASE}, {ALL_QUERIES}, {INDEX} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {K}",
        "result_envelope": f"{BASE}, q AS (SELECT doc_id AS query_id, term, tf FROM tf WHERE doc_id = (SELECT min(doc_id) FROM documents)), {INDEX} SELECT r.doc_id AS id, source AS name, score, 'spimi' AS engine FROM ranked r JOIN documents d ON r.doc_id = d.doc_id WHERE rank <= {K}",
        "dense_topk_cosine": _dense("dots AS (SELECT query_id, doc_id, sum(qu.w * d.w) / (sqrt(any_value(qs.s)) * sqrt(any_value(ds.s))) AS c FROM qu JOIN d USING (term) JOIN (SELECT query_id, sum(w * w) AS s FROM qu GROUP BY query_id) qs USING (query_id) "
        "JOIN (SELECT doc_id, sum(w * w) AS s FROM d GROUP BY doc_id) ds USING (doc_id) WHERE ds.s > 0 GROUP BY query_id, doc_id), scored AS (SELECT query_id, doc_id, round(coalesce(c, 0), 6) AS score FROM grid LEFT JOIN dots USING (query_id, doc_id))", "DESC"),
        "dense_topk_manhattan": _minkowski("sum(g)"),
        "dense_topk_euclidean": _minkowski("sqrt(sum(g * g))"),
        "dense_topk_chebyshev": _minkowski("max(g)"),
        "dense_topk_minkowski3": _minkowski("pow(sum(g * g * g), 1.0 / 3)"),
        "pgvector_topk": f"WITH {TF}, {CODES}, {FEW_QUERIES}, d AS (SELECT doc_id, term, CAST(tf AS DOUBLE) AS w FROM tf WHERE term IN (SELECT term FROM codebook)), qu AS (SELECT query_id, term, CAST(tf AS DOUBLE) AS w FROM q WHERE term IN (SELECT term FROM codebook)), "
        "dots AS (SELECT query_id, doc_id, sum(qu.w * d.w) / (any_value(qs.s) * any_value(ds.s)) AS c FROM qu JOIN d USING (term) JOIN (SELECT query_id, sqrt(sum(w * w)) AS s FROM qu GROUP BY query_id) qs USING (query_id) "
        "JOIN (SELECT doc_id, sqrt(sum(w * w)) AS s FROM d GROUP BY doc_id) ds USING (doc_id) GROUP BY query_id, doc_id), "
        "scored AS (SELECT query_id, doc_id, round(coalesce(c, 0), 6) AS score FROM (SELECT DISTINCT query_id FROM qu) CROSS JOIN (SELECT DISTINCT doc_id FROM d) LEFT JOIN dots USING (query_id, doc_id)) "
        f"SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= {K}",
        "sparse_dot": f"{BASE}, {FEW_QUERIES}, {UNITS} SELECT query_id, doc_id, round(sum(qu.w * d.w), 6) AS dot FROM qu JOIN d USING (term) GROUP BY query_id, doc_id",
        "fts_and_topk": f"WITH {TF}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_words('text')}) AS term FROM benchmark), sizes AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), "
        "hits AS (SELECT query_id, doc_id, count(*) AS k, round(avg(1 + log10(tf)), 6) AS score FROM tf JOIN q USING (term) GROUP BY query_id, doc_id), "
        f"scored AS (SELECT query_id, doc_id, score FROM hits JOIN sizes USING (query_id) WHERE k = n) SELECT query_id, CAST({RANK} AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= {K}",
        "vector_cosine_topk": f"WITH {COSINES} SELECT query_id, rank, doc_id, score FROM ranked",
        "vector_cosine_one": f"SELECT e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, doc_id LIMIT {K}",
        "recall_at_k": f"WITH {COSINES}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT query_id, round(sum(CASE WHEN doc_id <> query_id AND d.label = q.label THEN 1 ELSE 0 END) / (any_value(n) - 1), 6) AS recall "
        "FROM ranked JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id JOIN sizes ON sizes.label = q.label WHERE n > 1 GROUP BY query_id",
        "quantize_nearest": f"{NEAREST} SELECT vec_id, idx FROM near",
        "codeword_hist": f"{NEAREST} SELECT CAST(label AS VARCHAR) AS doc_id, format('v_{{:04d}}', idx) AS term, CAST(count(*) AS INTEGER) AS tf FROM near GROUP BY 1, 2",
        "codeword_full_hist": f"{NEAREST} SELECT doc_id, idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT label AS doc_id FROM embeddings) CROSS JOIN (SELECT idx FROM c) LEFT JOIN (SELECT label AS doc_id, idx, count(*) AS n FROM near GROUP BY 1, 2) USING (doc_id, idx)",
        "centroid_update": f"{NEAREST} SELECT idx, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT idx, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS x FROM near) GROUP BY idx, dim",
        "collect_full_outer": f"{BOTH} SELECT stem, lyrics_path, audio_path FROM both_",
        "coverage_counts": f"{BOTH} SELECT count(*) AS n, count(lyrics_path) AS with_lyrics, count(audio_path) AS with_audio, count(CASE WHEN lyrics_path IS NOT NULL AND audio_path IS NOT NULL THEN 1 END) AS with_both FROM both_",
        "pair_inner": f"WITH {TEXTS}, {PARTS} SELECT t.stem AS stem, p.stem || '.png' AS image_path, t.path AS desc_path FROM t JOIN p ON t.stem = p.stem",
        "metadata_left": f"WITH {TEXTS}, {PARTS} SELECT t.stem AS stem, t.path AS path, coalesce(m.p_name, t.stem) AS title, m.p_brand AS artist FROM t LEFT JOIN part m ON CAST(m.p_partkey AS VARCHAR) = t.stem",
        "not_cached": f"WITH {TEXTS} SELECT stem, path FROM t WHERE stem NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id IS NOT NULL)",
        "extension_priority": f"WITH {TEXTS}, {PARTS} SELECT coalesce(p.stem, t.stem) AS stem, CASE WHEN p.stem IS NOT NULL THEN p.stem || '.png' ELSE t.path END AS path FROM t FULL JOIN p ON t.stem = p.stem",
        "safe_stem": f"SELECT p_partkey, {safe('concat_ws(chr(95), p_brand, p_name)')} AS stem FROM part",
        "unique_stems": f"SELECT p_partkey, CASE WHEN i > 1 THEN base || '_' || (i - 1) ELSE base END AS stem FROM (SELECT p_partkey, {safe('p_type')} AS base, row_number() OVER (PARTITION BY {safe('p_type')} ORDER BY p_partkey) AS i FROM part)",
        "compose_desc": "SELECT p_partkey, coalesce(p_name, '') || '. Gender:. Category: ' || p_brand || ' / ' || p_type || CASE WHEN p_size > 25 THEN '. Season: S' || p_size ELSE '' END AS description FROM part",
        "short_desc": "SELECT p_partkey, trim(p_name) || '. Category: ' || p_brand || '. Subcategory:' || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END AS description FROM part",
        "first_given": "SELECT p_partkey, CASE WHEN p_size > 40 THEN trim(p_name) ELSE trim(p_brand) END AS name FROM part",
        "append_distinct": f"WITH {TEXTS}, {PARTS} SELECT stem FROM t UNION SELECT stem FROM p",
        "label_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
        "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 4) AS avg_ms, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(CASE WHEN avg(value) > 0 THEN 1000 / avg(value) ELSE 0 END, 2) AS throughput_qps, count(value) AS with_results FROM events GROUP BY event_type",
        "search_log_hours": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1, 2",
        "codebook_upsert": "SELECT 'music' AS app, 'text' AS modality, count(*) + 1 AS codebook_size FROM documents UNION ALL SELECT 'music', 'audio', CAST(200 AS BIGINT) UNION ALL SELECT 'fashion', 'text', CAST(50 AS BIGINT)",
        "stream_ingest": f"{BASE}, {ALL_QUERIES}, {INDEX} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {K}",
        "ranked_labels": "SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 3",
    }
    items = "SELECT CAST(p_partkey AS VARCHAR) AS stem, CASE WHEN p_size % 7 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS {}, p_brand AS {}, p_type AS {} FROM part"
    own |= {
        "music_metadata": items.format("title", "artist", "genre"),
        "fashion_metadata": items.format("name", "category", "subcategory"),
        "jsonl_corpus": f"WITH {TF} SELECT CAST(doc_id AS VARCHAR) AS doc_id, term, tf FROM tf",
        "block_import": f"WITH {ALL_QUERIES} SELECT CAST(query_id AS VARCHAR) AS doc_id, term, tf FROM q",
        "lyrics_rows": "SELECT CAST(doc_id AS VARCHAR) AS title, trim(source) AS artist, trim(lang) AS genre, md5(trim(text)) AS lyrics_md5 FROM documents WHERE length(trim(text)) >= 20",
        "text_files": "SELECT CAST(item_id AS VARCHAR) AS stem, md5(text) AS text_md5, length(text) AS n_chars FROM benchmark",
        "posting_lookup": f"WITH {TF}, {DF} SELECT doc_id, tf, df, (SELECT count(*) FROM df) AS vocab_size FROM tf JOIN (SELECT term, df FROM df ORDER BY df DESC, term LIMIT 1) USING (term)",
        "cached_features": "SELECT CAST(label AS VARCHAR) AS doc_id, CAST(vec_id AS INTEGER) AS vec_idx, CAST(len(embedding) AS INTEGER) AS n_dims FROM embeddings",
        "codebook_terms": f"WITH {TF}, {CODES} SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS place, term FROM codebook",
        "search_log": "SELECT app, count(*) AS n, CAST(sum(i) AS DOUBLE) AS latency, CAST(sum(i) AS BIGINT) AS results FROM (SELECT i, CASE WHEN i % 2 = 1 THEN 'music' ELSE 'fashion' END AS app FROM range(6) t(i)) GROUP BY app",
        "inserted_rows": "SELECT p_name AS title, p_brand AS artist, 2 * count(*) AS n, CAST(0 AS BIGINT) AS entries, CAST(1 AS BIGINT) AS least, any_value(total) * 2 AS most, any_value(total) * 2 AS ids, '1,' || (any_value(total) + 1) AS firsts FROM part, (SELECT count(*) AS total FROM part) GROUP BY ALL",
        "demo_metrics": _demo(),
    }
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    own["stopwords_tf"] = f"WITH {TF} SELECT doc_id, term, tf FROM tf WHERE term NOT IN ({stop})"
    return own
