"""Features, similarities, clusters, outliers and streams."""

import random

from pyspark.sql import functions as F

from quadrille import streaming
from quadrille.model import TYPE, XSD, triples
from quadrille.operators import learning

INT, STR = XSD + "integer", XSD + "string"


def movies(spark):
    rows = []
    for k in range(30):
        m = f"urn:m{k}"
        rows += [(m, TYPE, "urn:Movie"), (m, "urn:year", str(1990 + k % 3 if k else 9000), 2, INT), (m, "urn:title", f"title {k}", 2, STR), (m, "urn:genre", f"urn:g{k % 2}")]
        rows += [(m, "urn:actor", f"urn:a{(k + j) % 5}") for j in range(2)]
    rows += [(f"urn:a{k}", "urn:age", str(30 + k), 2, INT) for k in range(5)] + [("urn:m3", "urn:odd", "1", 2, INT)]
    return triples(spark, rows)


def test_modes(spark):
    t = triples(spark, [("urn:a", "urn:p", "urn:b"), ("urn:c", "urn:q", "urn:a")])
    want = {"an": {"urn:b", "urn:c"}, "in": {"urn:c"}, "on": {"urn:b"}, "ar": {"urn:p", "urn:q"}, "ir": {"urn:q"}, "or": {"urn:p"}, "at": {"urn:b", "urn:c", "urn:p", "urn:q"}, "it": {"urn:c", "urn:q"}, "ot": {"urn:b", "urn:p"}, "as": {"urn:p urn:b", "urn:q urn:c"}, "is": {"urn:q urn:c"}, "os": {"urn:p urn:b"}}
    assert set(want) == set(learning.MODES)
    for mode, features in want.items():
        assert {r.entity: set(r.features) for r in learning.features(t, mode).collect()}["urn:a"] == features


def test_similarities_equal_brute_force(spark):
    rng = random.Random(2)
    sets = {f"e{k}": sorted({f"f{rng.randint(0, 12)}" for _ in range(rng.randint(1, 8))} | ({"all"} if k % 2 else set())) for k in range(40)}
    df = spark.createDataFrame(list(sets.items()), "entity string, features array<string>").coalesce(1)
    of = {"jaccard": lambda c, n, m: c / (n + m - c), "dice": lambda c, n, m: 2 * c / (n + m), "simpson": lambda c, n, m: c / min(n, m), "ochiai": lambda c, n, m: c / (n * m) ** 0.5, "braun_blanquet": lambda c, n, m: c / max(n, m), "tversky": lambda c, n, m: c / (c + 0.5 * (n - c) + 0.5 * (m - c))}
    for measure, f in of.items():
        for threshold in (0.0, 0.6):
            want = {(a, b) for a in sets for b in sets if a < b and (c := len(set(sets[a]) & set(sets[b]))) and f(c, len(sets[a]), len(sets[b])) >= threshold}
            assert {(r.left, r.right) for r in learning.similar(df, measure=measure, threshold=threshold).collect()} == want, (measure, threshold)
    got = learning.nearest(df, sets["e7"], 3).collect()
    assert "e7" in {r.entity for r in got if r.value == 1.0} and len(got) == 3
    assert learning.similar(df, measure="batet", threshold=0.5).count() < learning.similar(df, measure="batet").count()
    lsh = learning.Lsh(df, tables=20)
    exact = {(r.left, r.right) for r in learning.similar(df, threshold=0.6).collect()}
    assert len(exact & {(r.left, r.right) for r in lsh.join(0.6).collect()}) >= 0.9 * len(exact) and lsh.nearest("e7", 2).count() == 2
    assert {r.cluster for r in lsh.clusters(0.95).collect()} <= set(sets)


def test_frames(spark):
    t = movies(spark)
    frame = learning.sparql_frame(t, "SELECT ?m ?y ?a WHERE { ?m <urn:year> ?y ; <urn:actor> ?a }")
    assert dict(frame.dtypes) == {"m": "string", "y": "double", "a": "string"}
    flat = learning.collapse(frame, "m")
    assert dict(flat.dtypes)["y"] == "double" and dict(flat.dtypes)["a"] == "array<string>" and flat.count() == 30
    wide = learning.pivot_features(t, kind="urn:Movie")
    assert dict(wide.dtypes)["year"] == "array<double>" and wide.count() == 30
    vectors = learning.assemble(flat, "m")
    assert vectors.count() == 30 and vectors.first().features.size >= 2
    text = learning.feature_query(t, "urn:Movie", depth=2)
    assert "?root__actor__age" in text and "?root__odd" not in text and learning.SparqlQuery(text).transform(t).count() >= 30
    assert learning.feature_kinds(flat, "m")["y"] == "single-numeric"


def test_anomalies_and_clusters(spark):
    t = movies(spark)
    assert [(r.s, r.v) for r in learning.numeric_anomalies(t.where("p = 'urn:year'")).collect()] == [("urn:m0", 9000.0)]
    assert {(r.s, r.p) for r in learning.predicate_anomalies(t).collect()} == {("urn:m3", "urn:odd")}
    wide = learning.pivot_features(t, ["urn:year"], "urn:Movie").select("s", F.get("year", F.lit(0)).alias("year"))
    assert learning.multi_anomalies(wide, "s").orderBy(F.desc("score")).first().s == "urn:m0"
    assert learning.cohort_anomalies(t.where("p in ('urn:year', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type')")).first().s == "urn:m0"
    assert learning.cluster(t, "or", k=2).select("cluster").distinct().count() == 2
    assert learning.detect(t, {"anomalyDetectionType": "multi", "anomalyListSize": 1}).first().s in ("urn:m0", "urn:m3")
    pairs = learning.seeds_similarity(t, "urn:Movie", threshold=0.5)
    assert pairs.count() > 0 and pairs.where("value > 1").isEmpty()
    assert learning.similarity_triples(pairs.limit(2), "urn:x", "dasim").count() == 10
    made = learning.prediction_triples(wide, "s", ["year"], "urn:p").first()
    assert made.p == "urn:p#year" and made.dt == XSD + "double"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:q> \"x\" .\nbad\n")
    streaming.write(streaming.read_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    q = streaming.usage(streaming.read_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("usage").collect()} == {("urn:p", 1), ("urn:q", 1)}
    timed = streaming.read_files(spark, str(tmp_path / "in")).withColumn("at", F.timestamp_seconds(F.lit(100)))
    q = streaming.windowed(timed, "at").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.property, r.n) for r in spark.table("windows").collect()} == {("urn:p", 1), ("urn:q", 1)}
