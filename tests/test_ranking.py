import math

import pytest

from tessera.operators import evaluation, fulltext, index, similarity, terms
from tessera.plans import fixtures


@pytest.fixture(scope="module")
def text(spark):
    return fixtures.relation(spark, fixtures.TEXT).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return fixtures.relation(spark, fixtures.TEXT_QUERIES, "query_id")


def ranking(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_zero_counts_enter_df_of_the_dense_path_only(spark):
    tf = fixtures.relation(spark, fixtures.AUSTEN)
    assert {r["term"]: r["df"] for r in terms.document_frequency(tf).collect()} == {"afecto": 3, "celosa": 3, "chisme": 3, "borrascoso": 3}
    tf = spark.createDataFrame([("x", "a", 5), ("x", "b", 0), ("x", "c", 2), ("y", "a", 0), ("y", "c", 1)], "doc_id string, term string, tf int")
    assert {r["term"] for r in terms.postings(tf).collect()} == {"a", "c"}


def test_log_tf_cosines_of_the_books(spark):
    from pyspark.sql import functions as F

    from tessera.functions import weights

    vectors = fixtures.relation(spark, fixtures.AUSTEN).select("doc_id", "term", weights.log_tf(F.col("tf")).alias("w"))
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    found = {(r["query_id"][:2], r["doc_id"][:2]): r["score"] for r in similarity.cosine_scores(queries, vectors).collect()}
    assert [found["SS", "OP"], found["SS", "CB"], found["OP", "CB"]] == pytest.approx([0.94, 0.79, 0.69], abs=0.01)


def test_index_equals_dense_ranking(text, asked):
    own = index.InvertedIndex.build(text)
    fast = ranking(own.search_batch(asked, 10))
    slow = ranking(similarity.top_k(similarity.vectorize_queries(asked, text), similarity.build_tfidf(text), 10))
    for query, rows in slow.items():
        positive = [r for r in rows if r[1] > 0]
        assert [d for d, _ in fast[query][: len(positive)]] == [d for d, _ in positive]
        assert [s for _, s in fast[query][: len(positive)]] == pytest.approx([s for _, s in positive], abs=1e-9)
    assert all(query[2:] in rows[0][0] for query, rows in fast.items())


def test_index_storage_and_lookups(spark, text, tmp_path):
    with index.InvertedIndex.build(text).write(f"file://{tmp_path}/index") as own:
        assert own.n_docs == 6 and own.has_term("love") and not own.has_term("noexiste") and own.df("noexiste") == 0
        assert own.vocab_size() == len({t for d in fixtures.TEXT.values() for t in d})
        assert [tuple(r) for r in own.get_postings("love").collect()] == [("doc_001_love", 8), ("doc_002_love", 7), ("doc_003_party", 1), ("doc_004_party", 2)]
        assert own.get_postings("noexiste").collect() == []
        own.reset_counters()
        found = own.search_topk({"love": 1, "heart": 1, "noexiste": 3}, 3).collect()
        assert own.terms_read == 2 and [r["rank"] for r in found] == [1, 2, 3]
        assert own.search_topk({"noexiste": 2}, 3).collect() == []
        norms = {r["doc_id"]: r["norm"] for r in own.doc_norms.collect()}
        rows = fixtures.TEXT["doc_001_love"]
        df = {t: sum(t in d for d in fixtures.TEXT.values()) for t in rows}
        assert norms["doc_001_love"] == pytest.approx(math.sqrt(sum(((1 + math.log10(n)) * math.log10(6 / df[t])) ** 2 for t, n in rows.items())), abs=1e-9)
        plan = own.postings.where("term IN ('love', 'heart')")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(term" in plan


def test_postings_are_sorted_in_storage(spark, text, tmp_path):
    own = index.InvertedIndex.build(text).write(f"file://{tmp_path}/index")
    rows = [(r["term"], r["doc_id"]) for r in own.postings.collect()]
    assert len(rows) == len(set(rows))
    lists = {r["term"]: [p["doc_id"] for p in r["postings"]] for r in terms.posting_lists(text).collect()}
    assert all(docs == sorted(docs) for docs in lists.values())


def test_errors_and_empty_queries(spark, text):
    with pytest.raises(ValueError):
        index.InvertedIndex.build(text.where("false"))
    own = index.InvertedIndex(text, text.select("term"), text, 0)
    with pytest.raises(ValueError):
        own.search_batch(text)
    everywhere = spark.createDataFrame([("x", "a", 1), ("y", "a", 2)], "doc_id string, term string, tf int")
    assert index.InvertedIndex.build(everywhere).search_topk({"a": 1}, 5).collect() == []
    with pytest.raises(ValueError):
        similarity.top_k(text, text, 3, "jaccard")


@pytest.mark.parametrize(("metric", "p"), [("manhattan", 1), ("euclidean", 2), ("chebyshev", math.inf), ("third", 3)])
def test_minkowski_over_the_union_of_keys(spark, metric, p):
    docs = {"d1": {"x": 1.0, "y": 2.0, "z": 3.0}, "d2": {"u": 5.0}, "d3": {"x": 4.0, "u": 0.5}}
    queries = {"q1": {"x": 4.0}, "q2": {"v": 1.5, "z": 3.0}}
    rows = lambda c: [(k, t, w) for k, v in c.items() for t, w in v.items()]
    d, q = spark.createDataFrame(rows(docs), "doc_id string, term string, w double"), spark.createDataFrame(rows(queries), "query_id string, term string, w double")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in similarity.minkowski_scores(q, d, p).collect()}
    for a, qa in queries.items():
        for b, db in docs.items():
            gaps = [abs(qa.get(t, 0) - db.get(t, 0)) for t in qa.keys() | db.keys()]
            assert found[a, b] == pytest.approx(max(gaps) if p == math.inf else sum(g**p for g in gaps) ** (1 / p))


@pytest.mark.parametrize("metric", ["cosine", "manhattan", "euclidean", "chebyshev", 3, 2.5])
def test_dense_ranking_in_matrices_and_joins(spark, monkeypatch, metric):
    """No document is crossed with a query; both ways give the brute force's rows, documents at unit length or made so."""
    import numpy as np

    from tessera.operators import scoring

    draw = np.random.default_rng(11)
    docs = {d: {f"t{t}": float(draw.integers(1, 5)) for t in draw.choice(12, draw.integers(1, 6), replace=False)} for d in range(30)} | {30: {"t0": 0.0}}
    queries = {"a": {"t1": 0.6, "t2": 0.8}, "b": {"t2": 1.0, "new": 0.0}, "c": {"t11": 0.28, "t4": 0.96}}
    sizes = {d: math.sqrt(sum(w * w for w in v.values())) or 1.0 for d, v in docs.items()}
    rows = lambda c, by=None: [(k, t, w / (by[k] if by else 1)) for k, v in c.items() for t, w in v.items()]
    raw, own = (spark.createDataFrame(rows(docs, by), "doc_id bigint, term string, w double") for by in (None, sizes))
    asked = spark.createDataFrame(rows(queries), "query_id string, term string, w double")
    want = {}
    for q, qv in queries.items():
        found = []
        for d, dv in docs.items():
            pairs = [(dv.get(t, 0) / sizes[d], qv.get(t, 0)) for t in dv.keys() | qv.keys()]
            gaps = [abs(x - y) for x, y in pairs]
            p = {"manhattan": 1, "euclidean": 2}.get(metric, metric)
            found.append((-round(sum(x * y for x, y in pairs), 6) if metric == "cosine" else round(max(gaps) if metric == "chebyshev" else sum(g**p for g in gaps) ** (1 / p), 6), d))
        want[q] = [(d, pytest.approx(abs(s), abs=2e-6)) for s, d in sorted(found)[:4]]
    for limit in (50_000, 0):
        monkeypatch.setattr(scoring, "BROADCAST_ROWS", limit)
        for given, unit in ((raw, True), (own, False)):
            top = similarity.top_k(asked, given, 4, metric, 6, unit=unit)
            assert ranking(top) == want
            if limit:
                plan = top._jdf.queryExecution().executedPlan().toString()
                assert "Cartesian" not in plan and "NestedLoop" not in plan
    if metric == "cosine":
        pairs = {(r["query_id"], r["doc_id"]): r["dot"] for r in similarity.dots(asked, raw).collect()}
        assert pairs == {(r["query_id"], r["doc_id"]): pytest.approx(r["dot"]) for r in similarity.sparse_dot(asked, own).collect()}


def test_any_python_metric(spark):
    rows = spark.createDataFrame([("d1", "x", 1.0), ("d1", "y", 2.0), ("d2", "x", 2.0)], "doc_id string, term string, w double")
    query = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "query_id string, term string, w double")

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(a[t] * b.get(t, 0) for t in a) / size if size else 0.0

    found = ranking(similarity.top_k_by(query, rows, cosine, 2))["q"]
    assert found[0][0] == "d2" and dict(found)["d1"] == pytest.approx(0.8)


def test_audio_query_finds_its_kind(spark):
    tf, q = fixtures.relation(spark, fixtures.AUDIO), fixtures.relation(spark, fixtures.AUDIO_QUERIES, "query_id")
    found = ranking(similarity.top_k(similarity.vectorize_queries(q, tf), similarity.build_tfidf(tf), 1))
    assert "rock" in found["q_rocky"][0][0] and "pop" in found["q_poppy"][0][0] and "jazz" in found["q_jazzy"][0][0]
    raw = {(r["doc_id"], r["term"]): r["w"] for r in terms.weighted(tf, use_log_tf=False, with_zero=True).collect()}
    assert raw["song_007_silence", "a0"] == pytest.approx(math.log10(7 / 3))


def test_codebook_and_histograms(spark):
    tf = spark.createDataFrame([("d", "hola", 2), ("d", "foo", 1), ("d", "bar", 1), ("d", "test", 1), ("e", "mundo", 1)], "doc_id string, term string, tf int")
    assert [r["term"] for r in terms.top_terms(tf, 2).collect()] == ["hola", "bar"]
    vocabulary = spark.createDataFrame([("hola",), ("mundo",), ("test",), ("foo",)], "term string")
    counts = {(r["doc_id"], r["term"]): r["n"] for r in terms.vocabulary_histogram(tf, vocabulary).collect()}
    assert [counts["d", t] for t in ("hola", "mundo", "test", "foo")] == [2, 0, 1, 1]
    assert {r["doc_id"]: r["hist"] for r in terms.as_maps(tf).collect()}["d"] == {"hola": 2, "foo": 1, "bar": 1, "test": 1}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_words_are_counted_where_their_row_is_read(spark, monkeypatch):
    """No row of a (document, term) is shuffled unless an id comes again; slices of any size give the same counts."""
    rows = [(1, "Hearts, hearts; the running\u2003RUNS\u00a0x9"), (2, None), (3, "  ...  "), (4, "d\u00e9j\u00e0 vu runs "), (None, "one null id")]
    want = {(1, "heart"): 2, (1, "run"): 2, (1, "x"): 1, (4, "d\u00e9j\u00e0"): 1, (4, "vu"): 1, (4, "run"): 1, (None, "on"): 1, (None, "null"): 1, (None, "id"): 1}
    for size in (8_000_000, 1):
        monkeypatch.setattr(terms, "SLICE", size)
        for extra in ([], [(4, "runs"), (None, "null")]):
            docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string").coalesce(2)
            tf = terms.term_frequencies(docs, stop=["the"], stem=True)
            assert bool(exchanges(tf)) == bool(extra)
            assert {(r["doc_id"], r["term"]): r["tf"] for r in tf.collect()} == (want | {(4, "run"): 2, (None, "null"): 2} if extra else want)


def test_rare_terms_alone_are_shuffled_for_df(spark, monkeypatch):
    """df of common terms goes to every task; whatever COMMON is, the same rows, and ranking with null ids, in joins or matrices, is the same."""
    from tessera.operators import scoring

    tf = spark.createDataFrame([(d, t, 1 + d % 3) for d in range(40) for t in ("all", f"t{d % 4}", f"own{d}")] + [(None, "all", 1)], "doc_id bigint, term string, tf int")
    queries = spark.createDataFrame([("a", "t1", 1), ("a", "own5", 2), ("b", "all", 1), ("b", "t2", 3)], "query_id string, term string, tf int")
    plans, found, ranks = [], [], []
    for common in (100_000, 5, 0):
        monkeypatch.setattr(terms, "COMMON", common)
        own = terms.with_df(tf)
        plans.append(own._jdf.queryExecution().optimizedPlan().toString())
        found.append(sorted((str(r["doc_id"]), r["term"], r["tf"], r["df"]) for r in own.collect()))
        for rows in (50_000, 0):
            monkeypatch.setattr(scoring, "BROADCAST_ROWS", rows)
            ranks.append(ranking(index.InvertedIndex.build(tf).search_batch(queries, 5, 6)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 121 and ("None", "all", 1, 41) in found[0]
    assert "Union" not in plans[0] and "Union" in plans[1] and "broadcast" in plans[1]
    assert all(r == ranks[0] for r in ranks) and ranks[0]["a"][0][0] == 5


def test_postings_are_not_shuffled_to_be_weighted(spark, text, tmp_path):
    """The stored index has counts alone, and a search deals out only the postings of its terms."""
    own = index.InvertedIndex.build(text).write(f"file://{tmp_path}/index")
    assert own.postings.columns == ["term", "doc_id", "tf"]
    assert "Join" not in index.InvertedIndex.build(text).postings._jdf.queryExecution().optimizedPlan().toString()


def test_histograms_and_unit_lengths_shuffle_little(spark):
    """A vocabulary's histogram shuffles only its terms; unit lengths need one shuffle of the vectors and no sort of them."""
    tf = spark.createDataFrame([(d, t, 1 + d) for d in range(6) for t in ("a", "b", f"own{d}")] + [(9, "x", 1)], "doc_id bigint, term string, tf int")
    made = terms.vocabulary_histogram(tf, spark.createDataFrame([("a",), ("own3",)], "term string"))
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["term"]): r["n"] for r in made.collect()} == {(d, t): (1 + d) * (d < 6 and (t == "a" or d == 3)) for d in (*range(6), 9) for t in ("a", "own3")}
    vectors = tf.select("doc_id", "term", tf["tf"].cast("double").alias("w")).unionByName(spark.createDataFrame([(7, "z", 0.0)], "doc_id bigint, term string, w double"))
    unit = terms.l2_normalized(vectors)
    assert "SortMergeJoin" not in unit._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["term"]): r["w"] for r in unit.collect()} == {(d, t): pytest.approx(1 / math.sqrt(3)) for d in range(6) for t in ("a", "b", f"own{d}")} | {(9, "x"): 1.0, (7, "z"): 0.0}


def test_chunks_are_counted_without_a_shuffle_unless_stems_repeat(spark, tmp_path):
    from tessera.plans import pipelines

    rows = [("a", "singing songs of the long hearts\nshort\nrunning away from the hearts"), ("b", "a song")]
    for extra in ([], [("b", "a song again")]):
        texts = spark.createDataFrame(rows + extra, "stem string, text string")
        tf = pipelines.analyse(texts, mark="\n")
        assert bool(exchanges(tf)) == bool(extra)
        found = {(r["doc_id"], r["term"]): r["tf"] for r in tf.collect()}
        assert found["a#chunk000", "heart"] == found["a#chunk001", "heart"] == 1 and found["b#chunk000", "song"] == 1 + len(extra)
        own = pipelines.index_text(texts, 3, f"file://{tmp_path}/index{len(extra)}", mark="\n")
        assert "Join" not in own.tf._jdf.queryExecution().optimizedPlan().toString()


def test_full_text_is_conjunctive(spark, text):
    queries = spark.createDataFrame([("a", "love"), ("a", "night"), ("b", "love"), ("b", "noexiste")], "query_id string, term string")
    found = ranking(fulltext.search(text, queries, 10))
    assert set(found) == {"a"} and [d for d, _ in found["a"]] == ["doc_002_love", "doc_001_love", "doc_004_party", "doc_003_party"]


def test_recall_and_percentiles(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "doc_id string, label string")
    found = spark.createDataFrame([("a", 1, "a"), ("a", 2, "b"), ("a", 3, "d"), ("d", 1, "a")], "query_id string, rank int, doc_id string")
    assert {r["query_id"]: r["recall"] for r in evaluation.recall_at_k(found, labels, 3).collect()} == {"a": 0.5}
    rows = spark.createDataFrame([("e", float(x)) for x in (1, 2, 3, 4)], "engine string, ms double")
    r = evaluation.latency_summary(rows, "ms", ["engine"], "ms < 3").first()
    assert (r["n"], r["avg_ms"], r["p50_ms"], r["p95_ms"], r["throughput_qps"], r["with_results"]) == (4, 2.5, 2.5, 3.85, 400.0, 2)
    made = evaluation.benchmark({"ok": lambda q: rows, "bad": lambda q: rows.select("none")}, ["q"])
    assert made[0]["n_results"] == 4 and made[1]["error"]
    assert evaluation.markdown_report(made).count("\n") == 4 and "results" in evaluation.json_report(made)
