import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, pairing, vector_search
from tessera.plans import pipelines
from tessera.plans.search import SearchService
from tessera.sources import audio, catalogues, files, images, synthetic
from tessera.sources.tables import Store, ensure_dimension


def tone(hz, seed, rate=22_050):
    draw = np.random.default_rng(seed)
    x = 0.5 * np.sin(2 * np.pi * hz * np.arange(rate) / rate) + 0.02 * draw.standard_normal(rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def png(x, kind=0):
    h, w = x.shape[:2]
    rows = b"".join(bytes([kind]) + (x[y] if kind == 0 else x[y] - (x[y - 1] if y else 0)).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def picture(kind, seed):
    draw = np.random.default_rng(seed)
    y, x = np.mgrid[:64, :64]
    base = {"stripes": ((x // 4) % 2) * 200, "dots": (((x // 8) + (y // 8)) % 2) * 200, "noise": draw.integers(0, 255, (64, 64))}[kind]
    return (base[:, :, None] + draw.integers(0, 10, (64, 64, 3))).clip(0, 255).astype(np.uint8)


def test_vector_search(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[3]), kind="stable")[:5].tolist()
    assert [r["doc_id"] for r in vector_search.cosine_top_k(rows, x[3].tolist(), 5).collect()] == want
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = vector_search.cosine_top_k_batch(rows, queries, 5).collect()
    for q in range(0, 200, 20):
        assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-(unit @ unit[q]), kind="stable")[:5].tolist()
    near = [r["doc_id"] for r in vector_search.lsh_top_k(rows.where("vec_id < 900"), x[3].tolist(), 5).collect()]
    assert near[0] == 3


def test_quantising(spark):
    rows = spark.createDataFrame([("d", [float(x)]) for x in (1, 2, 6, 9, 11)], "doc_id string, features array<double>")
    coded = clustering.quantize(rows, np.array([[0.0], [5.0], [10.0]]))
    assert [r["n"] for r in clustering.full_histogram(coded, 3).orderBy("idx").collect()] == [2, 1, 2]
    native = rows.select(clustering.nearest(F.col("features"), [[0.0], [5.0], [10.0]]).alias("i")).collect()
    assert [r["i"] for r in native] == [0, 0, 1, 2, 2]
    tie = spark.createDataFrame([([5.0],)], "features array<double>")
    assert clustering.quantize(tie, np.array([[0.0], [10.0]])).first()["idx"] == 0


@pytest.mark.parametrize("algorithm", ["kmean", "kmedoid"])
def test_clusters_of_separate_groups(spark, algorithm):
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    found = clustering.cluster(rows, 3, ["id"], algorithm, seed=3)
    again = clustering.cluster(rows.repartition(7), 3, ["id"], algorithm, seed=3)
    assert np.allclose(found, again) and len(found) == 3
    with pytest.raises(ValueError):
        clustering.cluster(rows, 3, ["id"], "other")


def test_an_empty_cluster_keeps_its_centroid(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id long, features array<double>")
    assert clustering.kmeans(rows, 3, ["id"], start=np.array([[0.0], [10.0], [500.0]]))[2] == 500


def test_pairing(spark):
    lyrics, sounds = spark.createDataFrame([("a", "a.txt"), ("b", "b.txt")], "stem string, path string"), spark.createDataFrame([("b", "b.wav"), ("c", "c.wav")], "stem string, path string")
    items = pairing.collect_files(lyrics, sounds)
    assert pairing.coverage(items).first().asDict() == {"n": 3, "with_lyrics": 2, "with_audio": 2, "with_both": 1}
    assert pairing.pair_files(lyrics, sounds).count() == 1
    meta = spark.createDataFrame([("a", "Title")], "stem string, title string")
    assert {r["stem"]: r["title"] for r in pairing.with_metadata(items, meta, "title").collect()} == {"a": "Title", "b": "b", "c": "c"}
    both = spark.createDataFrame([("a", "a.mp3", ".mp3"), ("a", "a.wav", ".wav"), ("b", "b.txt", ".txt")], "stem string, path string, ext string")
    assert [tuple(r) for r in pairing.first_by_extension(both, [".wav", ".mp3"]).collect()] == [("a", "a.wav")]
    names = spark.createDataFrame([(1, "x y"), (2, "x/y"), (3, "x_y_1"), (4, "!!")], "i int, name string")
    stems = {r["i"]: r["stem"] for r in pairing.unique_stems(names, F.col("name"), [F.col("i")], F.lit("song")).collect()}
    assert stems[1] == "x_y" and stems[4] == "song" and len(set(stems.values())) == 4


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "two.TXT").write_text("x")
    (tmp_path / "meta.csv").write_text("stem,title,artist,genre\none,One,,Pop\n,No,x,y\ntwo,,B,\n")
    (tmp_path / "corpus.json").write_text('{"id":"d1","tf":{"a":2,"b":1}}\n')
    (tmp_path / "block.json").write_text('{"t":"a","p":[["d1",2],["d2",1]]}\n')
    assert {r["stem"] for r in files.listing(spark, str(tmp_path), [".txt"]).collect()} == {"one", "two"}
    assert {r["stem"]: r["text"] for r in files.texts(spark, str(tmp_path)).collect()}["one"] == "café  ok"
    with pytest.raises(ValueError):
        files.checked_extension("x.doc", [".txt"])
    meta = {r["stem"]: r for r in catalogues.music_metadata(spark, str(tmp_path / "meta.csv")).collect()}
    assert set(meta) == {"one", "two"} and meta["two"]["title"] == "two" and meta["one"]["artist"] is None
    assert catalogues.corpus(spark, str(tmp_path / "corpus.json")).count() == 2
    assert catalogues.blocks(spark, str(tmp_path / "block.json")).count() == 2
    assert catalogues.largest_csv(spark, str(tmp_path)).columns == ["stem", "title", "artist", "genre"]
    rows = spark.createDataFrame([("short", "T", "A"), ("x" * 25, "T2", "A2")], "text string, title string, artist string")
    assert [r["title"] for r in catalogues.lyrics_catalogue(rows).collect()] == ["T2"]


def test_synthetic_corpus_is_reproducible(spark):
    a = {tuple(r) for r in synthetic.corpus(spark, 40, partitions=1).collect()}
    assert a == {tuple(r) for r in synthetic.corpus(spark, 40, partitions=5).collect()}
    sizes = {}
    for doc, _, n in a:
        sizes[doc] = sizes.get(doc, 0) + n
    assert len(sizes) == 40 and all(50 <= n <= 200 for n in sizes.values())
    assert synthetic.queries(spark, 10).select("query_id").distinct().count() == 10


def test_decoders():
    x = picture("noise", 1)
    assert (images.decode(png(x)) == x).all() and (images.decode(png(x, 2)) == x).all()
    assert (images.decode(b"P6 64 64 255\n" + x.tobytes()) == x).all()
    assert len(images.patches(x)) == 9 and len(images.patches(x[:10, :10])) == 1
    assert images.shrunk(np.full((800, 200, 3), 7, np.uint8)).shape == (400, 100, 3)
    assert images.gradients(png(x)).shape == (9, 128)
    assert audio.decode(tone(440, 0)).shape == (16_000,)
    assert audio.mfcc(tone(440, 0)).shape == (10, 13)
    assert audio.frames(np.zeros(10)).shape == (1, 1600)
    with pytest.raises(ValueError):
        images.decode(b"nothing")


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    (root / "audio").mkdir()
    (root / "images").mkdir()
    for hz in (220, 440, 880):
        for i in (0, 1):
            (root / "audio" / f"{hz}_{i}.wav").write_bytes(tone(hz, hz + i))
    (root / "audio" / "broken.wav").write_bytes(b"not audio")
    for kind in ("stripes", "dots", "noise"):
        for i in (0, 1):
            (root / "images" / f"{kind}_{i}.png").write_bytes(png(picture(kind, i)))
    words = {"220_0": "love heart you night and dancing love", "440_0": "dance club party night music dances", "love": "crying alone in the rain tonight and rains"}
    lyrics = spark.createDataFrame([(k, f"{v}\n\n{v} once again in another verse") for k, v in words.items()], "stem string, text string")
    descs = spark.createDataFrame([(f"{k}_{i}", f"a {k} pattern for shirts number {i}") for k in ("stripes", "dots", "noise") for i in (0, 1)], "stem string, text string")
    store = Store(spark, f"file://{root}/store")
    folder = f"file://{root}/index"
    music = spark.createDataFrame([("220_0", "Love song", "A", "Pop")], "stem string, title string, artist string, genre string")
    fashion = spark.createDataFrame([("dots_0", "Dotted", "Apparel", "Top")], "stem string, name string, category string, subcategory string")
    pipelines.etl_music(spark, store, lyrics, str(root / "audio"), music, folder, 50, 6)
    pipelines.etl_fashion(spark, store, descs, str(root / "images"), fashion, folder, 50, 8)
    return SearchService(spark, store, folder), root


def test_rows_of_the_applications(service):
    own, _ = service
    songs = own.store.read("songs").collect()
    assert sorted(r["id"] for r in songs) == list(range(1, len(songs) + 1))
    assert {r["title"] for r in songs} >= {"Love song", "440_1", "love"}
    assert {r["name"] for r in own.store.read("products").collect()} >= {"Dotted", "noise_1"}
    with_audio = [r for r in songs if r["audio_emb"] is not None]
    assert len(with_audio) == 6 and all(abs(sum(x * x for x in r["audio_emb"]) - 1) < 1e-9 for r in with_audio)


@pytest.mark.parametrize("engine", ["spimi", "gin", "gist", "pgvector"])
def test_text_engines(service, engine):
    own, _ = service
    found = own.search_music_lyrics("crying in the rain", engine, 3)
    assert found["engine"] == engine and str(found["results"][0]["name"]).startswith("love")
    assert own.search_fashion_desc("dots", engine, 2)["results"]


@pytest.mark.parametrize("engine", ["spimi", "pgvector"])
def test_media_engines_find_the_query_itself(service, engine):
    own, root = service
    found = own.search_music_audio((root / "audio" / "440_1.wav").read_bytes(), engine, 3)
    assert any("440" in str(r["name"]) for r in found["results"])
    found = own.search_fashion_image((root / "images" / "stripes_0.png").read_bytes(), engine, 3)
    assert any("stripes" in str(r["name"]) for r in found["results"])


def test_facade_errors_and_log(service):
    own, _ = service
    for bad in (lambda: own.search_music_lyrics("x", "other"), lambda: own.search_music_lyrics("x", "spimi", 0), lambda: own.search_music_lyrics("x", "spimi", 101), lambda: own.search("none", "text", "x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        own.store.load_codebook("none", "text")
    assert own.store.read("search_logs").count() > 0
    assert own.health()["tables"]["songs"]
    own.clear_caches()


def test_codebook_upsert_and_dimension(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for size in (10, 20):
        store.save_codebook("music", "text", size, ["b", "a"])
    store.save_codebook("music", "audio", 5)
    assert store.load_codebook("music", "text")["codebook_size"] == 20 and store.read("codebooks").count() == 2
    assert store.load_bag("music", "text", None) == ["a", "b"]
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "emb array<double>")
    assert not ensure_dimension(rows, "emb", 2) and ensure_dimension(rows, "emb", 3)
    with pytest.raises(ValueError):
        ensure_dimension(rows, "emb", 0)


def test_feature_cache_takes_new_documents_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    kind = "doc_id string, vec_idx int, features array<float>, error string"
    store.cache_features(spark.createDataFrame([("a", 0, [1.0], None), ("x", None, None, "bad")], kind))
    store.cache_features(spark.createDataFrame([("a", 0, [2.0], None), ("b", 0, [3.0], None)], kind))
    assert {(r["doc_id"], r["features"][0]) for r in store.read("features").collect()} == {("a", 1.0), ("b", 3.0)}


def test_hashing_finds_most_of_the_nearest(spark):
    """Recall at 10 of the approximate search against the exact one, over a stated query set."""
    from tessera.plans import registry

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        exact = {(r["query_id"], r["doc_id"]) for r in registry.vector_cosine_topk(spark, sf).collect()}
        found = {(r["query_id"], r["doc_id"]) for r in registry.lsh_topk(spark, sf).collect()}
        assert len(exact & found) >= 0.9 * len(exact)


def test_hashed_candidates_are_never_listed(spark, monkeypatch):
    """Pairs that share a bucket are found in blocks: the same rows for any block, and no pair is a row of the plan."""
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    from tessera.operators import vector_search

    draw = np.random.default_rng(5)
    data = [(i, draw.normal(size=6).tolist()) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in data if i % 4 == 0 and v], "query_id string, embedding array<double>")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data if v}
    frame = spark.createDataFrame([(i, Vectors.dense(u)) for i, u in unit.items()], ["i", "features"])
    hashes = {r["i"]: np.array([h[0] for h in r["hashes"]]) for r in BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.2, numHashTables=2, seed=42).fit(frame).transform(frame).collect()}
    want = []
    for i in (i for i in unit if i % 4 == 0):
        met = sorted(((-round(float(unit[i] @ unit[j]), 6), j) for j in unit if (hashes[i] == hashes[j]).any()))[:5]
        want += [(f"q{i}", r + 1, j, -s) for r, (s, j) in enumerate(met)]
    for size in (2048, 7):
        monkeypatch.setattr(vector_search, "BLOCK", size)
        for bytes_ in (0, 64_000_000):
            monkeypatch.setattr(vector_search, "BROADCAST_BYTES", bytes_)
            found = vector_search.lsh_top_k_batch(rows, asked, 5, tables=2, width=0.2, digits=6)
            assert [(r["query_id"], r["rank"], r["doc_id"], r["score"] + 0.0) for r in found.sort("query_id", "rank").collect()] == [(a, b, c, pytest.approx(d, abs=1e-6)) for a, b, c, d in sorted(want)]
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "Distinct" not in plan


def test_blocks_of_queries_and_rows(spark, monkeypatch):
    """Many small blocks on both sides give what one block gives; ties go to the least id."""
    import numpy as np

    from tessera.operators import vector_search

    draw = np.random.default_rng(3)
    data = [(i, draw.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)] + [(150, None), (151, [0.0] * 4)]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in data if i % 4 == 0 and v], "query_id string, embedding array<double>")
    results = []
    for size in (2048, 7):
        monkeypatch.setattr(vector_search, "BLOCK", size)
        results.append(sorted(map(tuple, vector_search.cosine_top_k_batch(rows, asked, 5, digits=6).collect())))
    kept = [(i, np.array(v)) for i, v in data if v]
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    want = []
    for i, v in data:
        if i % 4 == 0 and v:
            best = sorted((-round(cosine(np.array(v), x), 6), j) for j, x in kept)[:5]
            want += [(f"q{i}", n + 1, j, -s) for n, (s, j) in enumerate(best)]
    close = lambda found: [(q, r, d) for q, r, d, _ in found] == [(q, r, d) for q, r, d, _ in sorted(want)]
    assert close(results[0]) and close(results[1])


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    """Append mode: windows come out once the watermark has passed, and a row behind it doesn't count."""
    import datetime as dt

    from tessera.streaming import ingest

    source, kind = str(tmp_path / "in"), "ts timestamp, event_type string, value double"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for batch in ([(at(0, 5), "a", 1.0), (at(0, 50), "a", 3.0)], [(at(6), "a", 9.0)], [(at(0, 10), "a", 100.0), (at(12), "a", 9.0)], [(at(20), "a", 9.0)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        windows = ingest.search_log_windows(spark.readStream.schema(kind).parquet(source))
        windows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    found = {r["start"]: (r["n"], r["avg_latency"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[at(0)] == (2, 2.0)


def test_centroids_follow_lloyd(spark):
    """k-means of the library against plain Lloyd steps in NumPy from the same start."""
    import numpy as np

    from tessera.operators import clustering

    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(c, 0.2, (40, 3)) for c in (0.0, 3.0, 6.0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = np.array(clustering.cluster(rows, 3, ["vec_id"], "kmean", "embedding"))
    assign = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    # A fixed point of Lloyd's steps: each centroid is the mean of what is nearest to it.
    own = assign(found)
    assert np.allclose([x[own == k].mean(axis=0) for k in np.unique(own)], found[np.unique(own)], atol=1e-3)


def test_stems_by_brute_force(spark):
    from collections import Counter

    from tessera.functions import text as T
    from tessera.functions.porter import stem_word
    from tessera.operators import terms

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r["doc_id"], r["term"]): r["tf"] for r in terms.term_frequencies(docs, stop=T.STOPWORDS, stem=True).collect()}
    words = docs.select("doc_id", T.tokens(docs["text"]).alias("w")).collect()
    want = Counter((r["doc_id"], stem_word(w)) for r in words for w in r["w"] if w not in set(T.STOPWORDS))
    assert found == dict(want)


def test_rows_are_numbered_before_joins(spark, tmp_path):
    """Numbers made before a join are the ids; the rows aren't computed once more to be counted."""
    from tessera import schema
    from tessera.sources.tables import Store, numbered_rows

    store = Store(spark, f"file://{tmp_path}/store")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    items = numbered_rows(spark.createDataFrame([(f"s{i}",) for i in range(50)], "title string").repartition(4))
    rows = items.mapInArrow(count, items.schema)
    assert store.save_rows("songs", rows, schema.SONGS) == 1
    found = store.read("songs").select("id", "title").collect()
    assert sorted(r["id"] for r in found) == list(range(1, 51)) and len({r["title"] for r in found}) == 50 and seen.value == 50
