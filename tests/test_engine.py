"""The engine's operators on small literals, and every registered query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cadenza import queries as registered
from cadenza.functions import scalars as S
from cadenza.operators import catalog as C
from cadenza.operators import graph as G
from cadenza.operators import ingest as I  # noqa: E741
from cadenza.operators import search as Q
from cadenza.operators import similarity as M
from cadenza.operators.centrality import centralities
from cadenza.sources import landed as L

DATA = "/root/testdata/sf0.001"
SONG = "song_id long, name string, danceability double, energy double, mode int, valence double, tempo double, popularity int, uri string, key int, genre string, artist_id long"


def song(i, name, d=0.5, e=0.6, m=1, v=0.7, t=120.0, p=80):
    return (i, name, d, e, m, v, t, p, f"u{i}", 1, "g", 1)


def placed(spark, songs, pid=1):
    return spark.createDataFrame([(pid, s[0], r) for r, s in enumerate(songs)], "pid long, song_id long, r int")


def test_vector_of_the_worked_example(spark):
    r = M.cosine_vectors(spark.createDataFrame([song(1, "a")], SONG)).first()
    assert [r[x] for x in M.AXES] == [0.5, 0.6, 0.25, 0.7, 0.012, 80.0]


def test_every_twentieth_link_and_names(spark):
    for n, want in ((5, 1), (6, 2)):
        s = [song(i, f"n{i}") for i in range(n)]
        assert M.graph_links(placed(spark, s), spark.createDataFrame(s, SONG)).count() == want
    same = [song(1, "x"), song(2, "x")]
    assert M.graph_links(placed(spark, same), spark.createDataFrame(same, SONG)).count() == 0


def test_long_playlists_are_dealt_in_blocks(spark):
    """Blocks of three songs give the links that one block gives."""
    s = [song(i, f"n{i % 19}", d=(i * 7 % 11) / 10, e=(i * 5 % 13) / 13, v=(i % 7) / 7, p=i % 3) for i in range(23)]
    songs, items = spark.createDataFrame(s, SONG), placed(spark, s).unionByName(placed(spark, s[:2], 2))
    whole, dealt = ({tuple(r) for r in M.graph_links(items, songs, least=0.8, every=3, block=b).collect()} for b in (100, 3))
    assert whole == dealt and len(whole) > 20


def test_playlists_are_scored_in_their_tasks(spark, monkeypatch):
    """Batches that cut playlists, and few pairs at a time, give the links that all pairs give; only links are shuffled on."""
    s = [song(i, None if i == 3 else f"n{i % 19}", d=(i * 7 % 11) / 10, e=(i * 5 % 13) / 13, v=(i % 7) / 7, p=i % 3) for i in range(23)] + [song(40, "zero", 0.0, 0.0, 0, 0.0, 0.0, 0)]
    songs, items = spark.createDataFrame(s, SONG), placed(spark, s)
    for k in range(2, 6):
        items = items.unionByName(placed(spark, s[k : 3 * k], k))
    hits = M.directed(M.threshold(M.pair_scores(M.with_vectors(items, songs)), 0.8))
    want = sorted(tuple(r) for r in M.sample_every(hits, 3).select("pid", "i", "j", "source", "target", "score").collect())
    monkeypatch.setattr(M, "PAIRS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = M.graph_links(items, songs, least=0.8, every=3)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vector_links_in_blocks(spark, monkeypatch):
    """Pairs of blocks give what all pairs give: odd vectors, labels and lengths too; no plan pairs all vectors by label."""
    x = [[(i * 7 % 11) / 11 - 0.4, (i * 5 % 13) / 13 - 0.4, (i % 7) / 7 - 0.4] for i in range(40)]
    x += [[0.0, 0.0, 0.0], [1e-200, 0.0, 0.0], [0.5, None, 0.1], None, [], [0.2, 0.3], [0.3, 0.2], [float("nan"), 0.1, 0.1]]
    rows = [(k, None if k == 5 else k % 2, v) for k, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, label int, x array<double>")
    a, b = v.select("label", F.col("vec_id").alias("i"), F.col("x").alias("xa")), v.select("label", F.col("vec_id").alias("j"), F.col("x").alias("xb"))
    want = a.join(b, "label").where("i < j").withColumn("score", F.round(S.list_cosine(F.col("xa"), F.col("xb")), 6)).where("score > 0.3").select("label", "i", "j", "score")
    want = sorted(map(repr, want.collect()))
    for n in (2048, 5):
        monkeypatch.setattr(M, "VECTORS", n)
        got = M.vector_links(v, 0.3)
        assert sorted(map(repr, got.collect())) == want and len(want) > 100
        assert "xb" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_zero_vector_scores_zero_and_threshold_is_strict(spark):
    s = [song(1, "a"), song(2, "b", 0.0, 0.0, 0, 0.0, 0.0, 0)]
    with pytest.raises(Exception, match="not exactly one row"):
        M.compare_track(spark.createDataFrame(s, SONG), spark.createDataFrame(s, SONG)).collect()
    pairs = M.pair_scores(M.with_vectors(placed(spark, s), spark.createDataFrame(s, SONG)))
    assert pairs.first()["score"] == 0.0
    edge = spark.createDataFrame([(1, 0, 1, "a", "b", 0.97), (1, 0, 2, "a", "c", 0.970000001)], "pid int, i int, j int, source string, target string, score double")
    assert [r["target"] for r in M.threshold(edge).collect()] == ["c"]


def test_catalog_keeps_first_position_and_last_uri(spark):
    c = C.catalog(spark.createDataFrame([(1, 0, "t", "u0"), (1, 1, "s", "u1"), (1, 2, "t", "u2")], "pid int, pos int, name string, uri string"))
    assert {(r["name"], r["pos"], r["uri"]) for r in c.collect()} == {("t", 0, "u2"), ("s", 1, "u1")}


def test_radial_profile_closes(spark):
    rows = C.radial_profile(spark.createDataFrame([song(1, "a")], SONG)).orderBy("place").collect()
    assert [r["r"] for r in rows] == [0.5, 0.6, 0.2, 0.7, 0.012, 0.5]


def test_scalars(spark):
    df = spark.createDataFrame([('["Ann","u:1"]', "a@b.co", ["x", "it's"]), (None, "a@b", [])], "owner string, email string, g array<string>")
    rows = df.select(S.owner_name(F.col("owner")), S.is_email(F.col("email")), S.quoted_list(F.col("g"))).collect()
    assert [tuple(r) for r in rows] == [("Ann", True, "['x', \"it's\"]"), ("Unknown", False, "[]")]
    assert spark.range(1).select(S.bubble_radius(F.lit(1)), S.bubble_radius(F.lit(300))).first()[0:2] == (10.0, 80.0)


def test_get_or_create_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "name string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "name string, v int")
    once = I.get_or_create(old, new, ["name"])
    assert {tuple(r) for r in once.collect()} == {("a", 1, False), ("b", 2, True)}
    twice = I.get_or_create(once.drop("created"), new, ["name"])
    assert twice.count() == 2 and not twice.where("created").count()


def test_subscribe(spark):
    out = I.subscribe(spark.createDataFrame([("a@b.co",)], "email string"), spark.createDataFrame([("a@b.co",), ("x",), ("n@b.co",)], "email string"))
    assert {r["email"]: r["status"] for r in out.collect()} == {"a@b.co": 400, "x": 400, "n@b.co": 200}


def test_search_rejects_unknown_categories(spark):
    with pytest.raises(ValueError):
        Q.search("album", "x", spark.createDataFrame([], "name string, subtitle string, uri string"))


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}
    assert {r["node"]: r["distance"] for r in G.path_lengths(e, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r["node"]: r["clustering"] for r in G.clustering(e).collect()}[3] == round(1 / 3, 9)
    assert {r["node"]: r["betweenness"] for r in centralities(e).collect()} == {1: 0, 2: 0, 3: 2, 4: 0, 6: 0, 7: 0}
    assert [r["generation"] for r in G.generations(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")).orderBy("node").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        G.generations(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"))
    words = spark.createDataFrame([("cat",), ("cot",), ("dog",), ("cats",)], "word string")
    assert [tuple(r) for r in G.word_graph(words).collect()] == [("cat", "cot")]


def test_graph_iterations(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)], "a long, b long")
    assert [(r["step"], r["node"]) for r in G.path_between(e, 1, 4).orderBy("step").collect()] == [(0, 1), (1, 3), (2, 4)]
    assert not G.path_between(e, 1, 7).count()
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0), (3, 4, 1.0), (6, 7, 5.0)], "a long, b long, weight double")
    assert {(r["a"], r["b"]) for r in G.spanning_forest(w).collect()} == {(1, 2), (2, 3), (3, 4), (6, 7)}
    assert {r["node"]: r["label"] for r in G.label_propagation(e, 1).collect()} == {1: 2, 2: 1, 3: 1, 4: 3, 6: 7, 7: 6}
    import numpy as np

    a = np.eye(4)
    for i, j in ((0, 1), (1, 2), (0, 2), (2, 3)):
        a[i, j] = a[j, i] = 1
    x = np.ones(4)
    for _ in range(10):
        x = a @ x
        x /= np.linalg.norm(x)
    got = {r["node"]: r["centrality"] for r in G.eigenvector(e.where("a < 5"), 10).collect()}
    assert all(abs(got[i + 1] - x[i]) < 1e-5 for i in range(4))


def test_exactly_one_users_and_playlists(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    assert I.exactly_one(one, ["name"]).count() == 2
    with pytest.raises(Exception, match="not exactly one row for a"):
        I.exactly_one(one.unionByName(one.where("v = 1")), ["name"]).collect()
    users = spark.createDataFrame([("a@b.co", "x")], "email string, name string")
    assert I.insert_users(users, spark.createDataFrame([("a@b.co", "y"), ("n@b.co", "z"), ("bad", "q")], "email string, name string")).count() == 2
    with pytest.raises(LookupError, match="no row"):
        I.exactly_one(one.where("false"), ["name"])
    wanted = spark.createDataFrame([("b",), ("b",)], "name string")
    assert [tuple(r) for r in I.exactly_one(one, ["name"], wanted).collect()] == [("b", 2)]
    with pytest.raises(Exception, match="no row for c"):
        I.exactly_one(one, ["name"], spark.createDataFrame([("c",)], "name string")).collect()
    links = spark.createDataFrame([("a", "b"), ("a", "z")], "source string, target string")
    assert [r["target"] for r in M.dangling_links(links, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == ["z"]


def test_lookup_rules(spark):
    names = spark.createDataFrame([("one",), ("two",), ("far",), ("one",)], "name string")
    local = spark.createDataFrame([("one", "l1"), ("two", "l2"), ("two", "l3")], "name string, uri string")
    remote = spark.createDataFrame([("one", "r1", 0), ("two", "r3", 2), ("two", "r2", 1), ("far", "r4", 5)], "name string, uri string, rank int")
    assert {tuple(r) for r in I.lookup(names, local, remote).collect()} == {("one", "l1", "local"), ("two", "r2", "remote"), ("far", "r4", "remote")}
    with pytest.raises(Exception, match="several rows for two"):
        I.lookup(names, local, remote, ambiguous="error").collect()
    lost = spark.createDataFrame([("lost",)], "name string")
    with pytest.raises(Exception, match="no search results for lost"):
        I.lookup(lost, local, remote).collect()
    assert [tuple(r) for r in I.lookup(lost, local, remote, strict=False).collect()] == [("lost", None, "none")]


def test_ingestion_of_several_playlists(spark):
    head = spark.createDataFrame([("p:1", "mix"), ("p:2", "new"), ("p:3", "empty")], "playlist_uri string, name string")
    items = spark.createDataFrame([("p:1", 0, "t", "u0"), ("p:1", 1, "s", "u1"), ("p:1", 2, "t", "u2"), ("p:2", 0, "s", "u1"), ("p:9", 0, "s", "u1"), ("p:2", 1, "x", "u9")], "playlist_uri string, pos int, name string, uri string")
    songs = spark.createDataFrame([("u0", "t", "a:0"), ("u1", "s", "a:1"), ("u2", "t", "a:1")], "uri string, name string, artist_uri string")
    once = I.ingest_playlists(head, items, songs)
    got = {t: {tuple(r)[:-1] for r in df.where("created").collect()} for t, df in once.items()}
    assert got["playlist_songs"] == {("p:1", "u1"), ("p:1", "u2"), ("p:2", "u1")} and got["artist_playlists"] == {("a:1", "p:1"), ("a:1", "p:2")}
    assert len(got["playlists"]) == 3 and {r[0] for r in got["songs"]} == {"u1", "u2"} and got["artists"] == {("a:1",)}
    again = I.ingest_playlists(head, items, songs, {t: df.drop("created") for t, df in once.items()})
    assert not any(df.where("created").count() for df in again.values())
    effects = I.search_effects(songs.withColumn("artist_uri", F.when(F.col("uri") != "u0", F.col("artist_uri"))), {"artists": spark.createDataFrame([("a:1",)], "artist_uri string")})
    assert {tuple(r) for r in effects["artist_songs"].collect()} == {("a:1", "u1", True), ("a:1", "u2", True)} and not effects["artists"].where("created").count()




def test_landed_search_and_edges(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"tracks": {"items": [{"name": "t", "uri": "u", "artists": [{"name": "A", "uri": "a"}]}, {"name": "x", "uri": "v", "artists": []}]}}')
    doc = L.read_json(spark, str(tmp_path / "s.json"), L.SEARCH)
    assert [tuple(r) for r in L.search_hits(doc, "track").collect()] == [(0, "t", "A", "u"), (1, "x", None, "v")]
    with pytest.raises(ValueError):
        L.search_hits(doc, "album")
    (tmp_path / "f.json").write_text('{"playlists": {"items": [{"name": "p", "uri": "u", "description": "d"}]}}')
    assert [tuple(r) for r in L.listed_playlists(L.read_json(spark, str(tmp_path / "f.json"), L.PLAYLISTS)).collect()] == [(0, "p", "u", "d")]
    edges = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    L.write_edges(edges, str(tmp_path / "edges"))
    assert {tuple(r) for r in L.read_edges(spark, str(tmp_path / "edges")).collect()} == {("a", "b"), ("c", "d")}
    assert [tuple(r) for r in L.literal_list(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]


def test_landed_documents(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"items": [{"track": {"name": "a", "uri": "u"}}, {"track": null}]}')
    assert [tuple(r) for r in L.playlist_tracks(L.read_json(spark, str(tmp_path / "items.json"), L.ITEMS)).collect()] == [(0, "a", "u")]
    (tmp_path / "head.json").write_text('{"name": "p", "owner": {"display_name": "Ann", "uri": "u:1"}, "followers": {"total": 3}, "description": "d", "images": []}')
    r = L.header(L.read_json(spark, str(tmp_path / "head.json"), L.HEADER)).first()
    assert (r["owner"], r["follow_count"], r["cover_image"]) == ('["Ann","u:1"]', 3, None)


def test_landed_details_features_and_listings(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"uri": "a:1", "name": "A", "genres": ["x", "it\'s"]}, {"uri": "a:2", "name": "B"}]')
    assert [tuple(r) for r in L.artist_details(L.read_json(spark, str(tmp_path / "a.json"), L.ARTIST)).collect()] == [("a:1", "A", "['x', \"it's\"]"), ("a:2", "B", "[]")]
    (tmp_path / "f.json").write_text('[{"uri": "u", "danceability": 0.5, "energy": 0.6, "mode": 1, "valence": 0.7, "tempo": 120.0, "key": 3}]')
    assert [tuple(r) for r in L.audio_features(L.read_json(spark, str(tmp_path / "f.json"), L.FEATURES)).collect()] == [("u", 0.5, 0.6, 1, 0.7, 1.2, 3)]
    (tmp_path / "t.json").write_text('{"tracks": [{"name": "a", "uri": "u"}, {"name": "b", "uri": "v"}, {"name": "c", "uri": "w"}]}')
    assert [tuple(r) for r in L.top_tracks(L.read_json(spark, str(tmp_path / "t.json"), L.TOP_TRACKS), 2).collect()] == [(0, "a", "u"), (1, "b", "v")]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "x"}, {"id": "y"}], "links": [{"source": "x", "target": "y", "value": 2}]}')
    doc = L.read_json(spark, str(tmp_path / "g.json"), L.GRAPH)
    assert [r["id"] for r in L.graph_nodes(doc).collect()] == ["x", "y"] and [tuple(r) for r in L.graph_links(doc).collect()] == [("x", "y", 2.0)]
    (tmp_path / "frames").mkdir()
    for n in ("b.png", "a.png"):
        (tmp_path / "frames" / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in L.listing(spark, str(tmp_path / "frames")).collect()] == ["a.png", "b.png"]
    L.write_csv(spark.createDataFrame([(1, 'a"b')], "n int, t string"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", 'a"b')]
    L.write_json(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["n"] == 1
    many = L.adjacency_lines(spark.createDataFrame([(1, b) for b in range(50)], "a long, b long"), most=10).collect()
    assert len(many) > 1 and sorted(int(x) for r in many for x in r["line"].split()[1:]) == list(range(50)) and all(r["line"].startswith("1 ") for r in many)
    lines = L.numbered_lines(spark.createDataFrame([("* c 1:2\n1one:2 3\\\n 4\n 5\n2two:2\n3:\nno colon\n",), (None,), ("",)], "text string"))
    assert sorted(tuple(r) for r in lines.collect()) == [("1", "2"), ("1", "3"), ("1", "4"), ("1", "5"), ("2", "2")] and L.self_loops(lines).count() == 1


def test_stream_upserts_once(spark, tmp_path):
    from cadenza.streaming.ingest import upsert_stream

    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "name string, v int").coalesce(1).write.json(str(tmp_path / "in"))
    for k in (1, 2):
        stream = spark.readStream.schema("name string, v int").json(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "table"), ["name"], str(tmp_path / f"state{k}")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "table")).count() == 2


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(registered.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(registered.ORACLE_SQL[name]).df())


def test_get_or_create_edges_takes_one_pass(spark, monkeypatch):
    """Links aren't kept as a table, and what exists comes from the rows that are combined anyway."""
    some = spark.createDataFrame([("a", "b", 0.5, "old"), ("a", "b", 0.5, "new"), ("a", "b", 0.5, None), ("a", "b", 0.6, "new"), ("a", "b", 0.6, "new"), ("b", "a", 0.5, None), (None, "a", 0.5, "new"), (None, "a", 0.5, "old")], "x string, y string, s double, kind string")
    got = I.created(some, ["x", "y", "s"], F.col("kind") == "old")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "b", 0.5, False), ("a", "b", 0.6, True), ("b", "a", 0.5, True), (None, "a", 0.5, False)]))
    monkeypatch.setattr(registered, "cut", lambda *_: pytest.fail("a table of all links"))
    data = "/root/testdata/sf0.001"
    links = registered.similarity_graph_links(spark, data).collect()
    rows = registered.get_or_create_edges(spark, data).collect()
    assert sorted((r["song_a"], r["song_b"], r["similarity_score"]) for r in rows) == sorted({(r["source"], r["target"], r["score"]) for r in links})
    assert {r["created"] for r in rows} == {True, False}
