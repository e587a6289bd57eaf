"""From graphs to feature tables, similarities, clusters and outliers, and back to triples."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, HashingTF, MinHashLSH, StringIndexer, VectorAssembler, Word2Vec
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NUMERIC, TYPE, XSD
from ..plans.sparql import query
from .graph import outliers
from .pairs import pairs, shares

#: A text feature with fewer distinct values a row than this is a category.
CATEGORY_SHARE = 0.1
MODES = tuple(place + kind for kind in "nrts" for place in "aio")


def features(t: DataFrame, mode: str = "at") -> DataFrame:
    """entity, features.  The first letter says which statements count: i those into an entity, o those out of it, a both; the second what is taken of them: n the
    neighbour, r the relation, t both as two features, s both as one."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    place, kind = mode
    out = t.select(F.col("s").alias("entity"), F.col("p").alias("r"), F.col("o").alias("n"))
    back = t.where("t <> 2").select(F.col("o").alias("entity"), F.col("p").alias("r"), F.col("s").alias("n"))
    rows = out if place == "o" else back if place == "i" else out.unionByName(back)
    one = {"n": F.array("n"), "r": F.array("r"), "t": F.array("n", "r"), "s": F.array(F.concat_ws(" ", "r", "n"))}[kind]
    return rows.select("entity", F.explode(one).alias("f")).distinct().groupBy("entity").agg(F.sort_array(F.collect_list("f")).alias("features"))


def _value(measure: str, n: Column, m: Column, c: Column, alpha: float, beta: float) -> Column:
    n, m, c = n.cast("double"), m.cast("double"), c.cast("double")
    return {"jaccard": lambda: c / (n + m - c), "dice": lambda: 2 * c / (n + m), "simpson": lambda: c / F.least(n, m), "ochiai": lambda: c / F.sqrt(n * m), "braun_blanquet": lambda: c / F.greatest(n, m),
            "tversky": lambda: c / (c + alpha * (n - c) + beta * (m - c)), "batet": lambda: F.log2(1 + (n + m - 2 * c) / (n + m - c))}[measure]()


def similar(a: DataFrame, b: DataFrame | None = None, measure: str = "jaccard", threshold: float = 0.0, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """left, right, value: pairs of entities that share a feature and reach the threshold (for batet, a distance: lie within it, if it is above 0).  Without b, pairs inside a.

    Equal sets are one.  Where the measure and threshold bound how many features two sets must share, only the rarest features of each meet: of n features, a set that
    shares o needs just n - o + 1 of them to meet its partners, so features that many sets share join nothing."""
    within = measure == "batet"
    keep = lambda v: F.lit(True) if within and threshold <= 0 else v <= threshold if within else v >= threshold
    return pairs(a, b, lambda n, m, c: _value(measure, n, m, c, alpha, beta), keep, shares(measure, threshold, alpha, beta), ordered=b is None)


def nearest(a: DataFrame, key: list[str], k: int, measure: str = "jaccard", alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """entity, value: the k entities whose features are most like those given."""
    wanted = F.array(*(F.lit(x) for x in dict.fromkeys(key)))
    c = F.size(F.array_intersect("features", wanted))
    value = _value(measure, F.size("features"), F.size(wanted), c, alpha, beta)
    order = F.col("value") if measure == "batet" else F.col("value").desc()
    return a.where(c > 0).select("entity", value.alias("value")).orderBy(order, "entity").limit(k)


class Lsh:
    """MinHash with locality-sensitive hashing over feature sets."""

    def __init__(self, a: DataFrame, tables: int = 5, seed: int = 1, bits: int = 18):
        self.hashing = HashingTF(inputCol="features", outputCol="vector", numFeatures=1 << bits, binary=True)
        self.rows = self.hashing.transform(a)
        self.model = MinHashLSH(inputCol="vector", outputCol="hashes", numHashTables=tables, seed=seed).fit(self.rows)

    def join(self, threshold: float) -> DataFrame:
        """left, right, value: about all pairs of a Jaccard similarity of threshold or more."""
        pairs = self.model.approxSimilarityJoin(self.rows, self.rows, 1 - threshold + 1e-9, "distance")
        return pairs.select(F.col("datasetA.entity").alias("left"), F.col("datasetB.entity").alias("right"), (1 - F.col("distance")).alias("value")).where("left < right")

    def nearest(self, entity: str, k: int) -> DataFrame:
        key = self.rows.where(F.col("entity") == entity).first()["vector"]
        return self.model.approxNearestNeighbors(self.rows.where(F.col("entity") != entity), key, k, distCol="distance").select("entity", (1 - F.col("distance")).alias("value"))

    def clusters(self, threshold: float) -> DataFrame:
        """entity, cluster: entities that chains of similar pairs connect, by the least of them."""
        from ..plans.fixpoint import closure

        pairs = self.join(threshold).select(F.col("left").alias("a"), F.col("right").alias("b"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = closure(both).groupBy("a").agg(F.min("b").alias("low"))
        return self.rows.join(least, F.col("entity") == F.col("a"), "left").select("entity", F.least("entity", F.coalesce("low", "entity")).alias("cluster"))


def feature_kinds(frame: DataFrame, key: str) -> dict[str, str]:
    """single or list, and numeric, categorical or text, for each column but the key of a typed frame."""
    tests = []
    for c, kind in frame.dtypes:
        if c != key:
            v = F.col(f"`{c}`")
            tests += [F.max(F.size(v) if kind.startswith("array") else F.lit(1)).alias(f"{c} most"), F.approx_count_distinct(F.to_json(v) if kind.startswith("array") else v.cast("string")).alias(f"{c} distinct")]
    row, n, out = frame.agg(*tests, F.count("*").alias(" n")).first(), 0, {}
    n = row[" n"]
    for c, kind in frame.dtypes:
        if c != key:
            inner = kind.removeprefix("array<").removesuffix(">")
            numeric = inner in ("double", "int", "bigint", "float") or inner.startswith("decimal")
            what = "numeric" if numeric else "boolean" if inner == "boolean" else "timestamp" if inner in ("timestamp", "date") else "categorical" if n and row[f"{c} distinct"] / n < CATEGORY_SHARE else "text"
            out[c] = f"{'list' if kind.startswith('array') and (row[f'{c} most'] or 0) > 1 else 'single'}-{what}"
    return out


def sparql_frame(t: DataFrame, text: str) -> DataFrame:
    """A query's solutions as plain columns: numbers where all of a variable's values are, booleans and times likewise, else text."""
    rows = query(t, text).cache()
    tests = [F.count(F.when(F.col(v)["v"].isNotNull() & ~F.coalesce(F.col(v)["dt"].isin(*NUMERIC), F.lit(False)), 1)).alias(f"n{k}") for k, v in enumerate(rows.columns)]
    tests += [F.count(F.when(F.col(v)["v"].isNotNull() & ~F.coalesce(F.col(v)["dt"] == XSD + kind, F.lit(False)), 1)).alias(f"{kind}{k}") for k, v in enumerate(rows.columns) for kind in ("boolean", "dateTime")]
    odd = rows.agg(*tests, *(F.count(F.col(v)["v"]).alias(f"all{k}") for k, v in enumerate(rows.columns))).first()

    def column(k: int, v: str) -> Column:
        text = F.col(v)["v"]
        if not odd[f"all{k}"]:
            return text.alias(v)
        return (text.cast("double") if not odd[f"n{k}"] else text.cast("boolean") if not odd[f"boolean{k}"] else text.cast("timestamp") if not odd[f"dateTime{k}"] else text).alias(v)

    return rows.select(*(column(k, v) for k, v in enumerate(rows.columns)))


def collapse(frame: DataFrame, key: str) -> DataFrame:
    """One row a key: the sorted distinct values of each column; a column with one value at most a key becomes plain."""
    sets = frame.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in frame.columns if c != key)).cache()
    most = sets.agg(*(F.max(F.size(c)).alias(c) for c in sets.columns if c != key)).first()
    return sets.select(key, *(F.get(c, F.lit(0)).alias(c) if (most[c] or 0) <= 1 else F.col(c) for c in sets.columns if c != key))


def pivot_features(t: DataFrame, predicates: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """One row a subject (of a class, if given), a column a predicate with its sorted values; numbers where all values are."""
    rows = t.join(t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct(), "s", "left_semi") if kind else t
    names = predicates or [r.p for r in rows.select("p").distinct().orderBy("p").collect()]  # a vocabulary
    local = {p: p.rstrip("/#").rsplit("/", 1)[-1].rsplit("#", 1)[-1].rsplit(":", 1)[-1] for p in names}
    label = {p: local[p] if list(local.values()).count(local[p]) == 1 else p.replace(".", "_") for p in names}
    numeric = {r.p for r in rows.where(F.col("p").isin(*names)).groupBy("p").agg(F.min(F.coalesce(F.col("dt").isin(*NUMERIC), F.lit(False)).cast("int")).alias("all")).where("all = 1").collect()}
    wide = rows.where(F.col("p").isin(*names)).groupBy("s").pivot("p", names).agg(F.sort_array(F.collect_set("o")))
    return wide.select("s", *((F.transform(F.col(f"`{p}`"), lambda x: x.cast("double")) if p in numeric else F.col(f"`{p}`")).alias(label[p]) for p in names))


def assemble(frame: DataFrame, key: str, label: str | None = None, width: int = 64, seed: int = 1) -> DataFrame:
    """key, label and a vector: numbers as they are (means of lists), categories indexed, lists of categories counted, texts embedded."""
    kinds = feature_kinds(frame, key)
    stages, inputs, df = [], [], frame
    for c, kind in kinds.items():
        if c == label:
            continue
        many, _, what = kind.partition("-")
        is_list = dict(frame.dtypes)[c].startswith("array")
        if what == "numeric":
            col = F.col(f"`{c}`")
            df = df.withColumn(f"_{c}", F.coalesce(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.size(col), F.lit(1)) if is_list else col.cast("double"), F.lit(0.0)))
            inputs.append(f"_{c}")
        elif what in ("boolean", "timestamp"):
            col = F.get(F.col(f"`{c}`"), F.lit(0)) if is_list else F.col(f"`{c}`")
            df = df.withColumn(f"_{c}", F.coalesce(col.cast("long").cast("double") if what == "timestamp" else col.cast("double"), F.lit(0.0)))
            inputs.append(f"_{c}")
        elif what == "categorical" and many == "single":
            col = F.get(F.col(f"`{c}`"), F.lit(0)) if is_list else F.col(f"`{c}`")
            df = df.withColumn(f"_{c}", F.coalesce(col.cast("string"), F.lit("")))
            stages.append(StringIndexer(inputCol=f"_{c}", outputCol=f"{c}_index", handleInvalid="keep"))
            inputs.append(f"{c}_index")
        else:
            words = F.coalesce(F.col(f"`{c}`").cast("array<string>") if is_list else F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\s+"), F.array().cast("array<string>"))
            df = df.withColumn(f"_{c}", words)
            stages.append(CountVectorizer(inputCol=f"_{c}", outputCol=f"{c}_vector", vocabSize=width) if what == "categorical" else Word2Vec(inputCol=f"_{c}", outputCol=f"{c}_vector", vectorSize=8, minCount=1, seed=seed, numPartitions=1))
            inputs.append(f"{c}_vector")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df).transform(df).select(key, *([label] if label else []), "features")


def feature_query(t: DataFrame, kind: str, depth: int = 1, least: float = 0.5) -> str:
    """A SELECT that collects the literals of a class's things, and of things up to depth links away, by the properties that at least a share of them have."""
    things = t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("root"), F.col("s").alias("node")).distinct()
    n, selects, wheres = things.count(), ["?root"], []

    def walk(rows: DataFrame, var: str, left: int, path: str) -> None:
        facts = t.join(rows, F.col("s") == F.col("node")).where(F.col("p") != TYPE)
        share = facts.groupBy("p", (F.col("t") == 2).alias("literal")).agg(F.countDistinct("root").alias("n")).where(F.col("n") >= least * n).orderBy("p", "literal").collect()
        for r in share:
            name = path + "__" + r.p.rstrip("/#").rsplit("/", 1)[-1].rsplit("#", 1)[-1].rsplit(":", 1)[-1].replace("-", "_")
            if r.literal:
                selects.append(f"?{name}")
                wheres.append(f"OPTIONAL {{ {var} <{r.p}> ?{name} }}" if path == "root" else f"OPTIONAL {{ {var_path(path)} ?{path} <{r.p}> ?{name} }}")
            elif left > 1:
                links[name] = (path, r.p)
                walk(facts.where((F.col("p") == r.p) & (F.col("t") < 2)).select("root", F.col("o").alias("node")).distinct(), f"?{name}", left - 1, name)

    links: dict[str, tuple[str, str]] = {}

    def var_path(path: str) -> str:
        if path == "root":
            return ""
        before, p = links[path]
        return f"{var_path(before)} ?{before} <{p}> ?{path} ."

    walk(things, "?root", depth, "root")
    return f"SELECT {' '.join(selects)} WHERE {{ ?root a <{kind}> . {' '.join(wheres)} }}"


class SparqlQuery(Transformer):
    """A query as a step of an ML pipeline, from triples to its solutions as plain columns."""

    def __init__(self, text: str):
        super().__init__()
        self.text = text

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return sparql_frame(dataset, self.text)


def node_index(t: DataFrame) -> DataFrame:
    from .partition import vertices

    return vertices(t)


def cluster(t: DataFrame, mode: str = "or", k: int | None = None, most: int = 8, seed: int = 1, width: int = 256) -> DataFrame:
    """entity, cluster by bisecting k-means over feature counts; without k, the k of the best silhouette from 2 to most."""
    rows = CountVectorizer(inputCol="features", outputCol="vector", vocabSize=width)
    sets = features(t, mode)
    vectors = rows.fit(sets).transform(sets).select("entity", "vector").cache()
    fit = lambda n: BisectingKMeans(featuresCol="vector", predictionCol="cluster", k=n, seed=seed).fit(vectors).transform(vectors)
    if k is None:
        score = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")
        def silhouette(n):
            made = fit(n)
            return score.evaluate(made) if made.select("cluster").distinct().count() > 1 else -2.0
        k = max(range(2, most + 1), key=silhouette)
    return fit(k).select("entity", "cluster")


def numeric_anomalies(t: DataFrame, method: str = "iqr", factor: float = 1.5, clusters: DataFrame | None = None) -> DataFrame:
    """s, p, v: outliers of each predicate's numbers, inside each cluster of entities if clusters are given."""
    if clusters is None:
        return outliers(t, method, factor)
    rows = t.join(clusters, F.col("s") == F.col("entity")).withColumn("p", F.concat_ws(" ", F.col("cluster").cast("string"), "p"))
    return outliers(rows.select(*t.columns), method, factor).withColumn("p", F.regexp_replace("p", r"^\S+ ", ""))


def predicate_anomalies(t: DataFrame, least: float = 0.05) -> DataFrame:
    """s, p, share: statements with a predicate that few things of their subject's class have."""
    typed = t.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("class"))
    sizes = typed.groupBy("class").agg(F.countDistinct("x").alias("things"))
    rows = t.where(F.col("p") != TYPE).select("s", "p").distinct().join(typed, F.col("s") == F.col("x"))
    share = rows.groupBy("class", "p").agg(F.countDistinct("s").alias("having")).join(sizes, "class").select(F.col("class").alias("c"), F.col("p").alias("q"), (F.col("having") / F.col("things")).alias("share")).where(F.col("share") < least)
    return rows.join(share, (F.col("class") == F.col("c")) & (F.col("p") == F.col("q"))).select("s", "p", "share")


def multi_anomalies(frame: DataFrame, key: str, trees: int = 50, size: int = 256, seed: int = 1) -> DataFrame:
    """key, score by an isolation forest over the numeric columns, grown on a sample of trees * size rows at most; the score is a chain of built-in expressions."""
    import numpy as np

    columns = [c for c, kind in frame.dtypes if c != key and kind in ("double", "float", "int", "bigint")]
    sample = frame.select(key, *columns).na.fill(0.0).orderBy(F.xxhash64(key)).limit(trees * size).collect()
    rows, rng = np.array([[float(r[c]) for c in columns] for r in sample]).reshape(-1, len(columns)), np.random.default_rng(seed)
    expected = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    deepest = int(np.ceil(np.log2(max(2, min(size, len(rows))))))

    def grow(part, depth) -> str:
        able = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
        if depth == deepest or not len(able):
            return repr(float(depth + expected(len(part))))
        f = int(rng.choice(able))
        at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        return f"if(coalesce(`{columns[f]}`, 0) <= {at!r}D, {grow(part[part[:, f] <= at], depth + 1)}, {grow(part[part[:, f] > at], depth + 1)})"

    paths = [F.expr(grow(rows[rng.choice(len(rows), min(size, len(rows)), replace=False)], 0)).cast("double") for _ in range(trees)] if len(rows) else [F.lit(0.0)]
    mean = reduce(lambda a, b: a + b, paths) / len(paths)
    return frame.select(key, F.pow(F.lit(2.0), -mean / max(float(expected(min(size, len(rows)))), 1e-9)).alias("score"))


def cohort_anomalies(t: DataFrame, threshold: float = 0.45, factor: float = 1.5) -> DataFrame:
    """s, p, v: outliers among entities of the same cohort: those whose sets of types are alike, by the least of those that a type set is similar to."""
    types = t.where(F.col("p") == TYPE).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("features"))
    sets = types.select(F.array_join("features", " ").alias("entity"), "features").distinct()
    pairs = similar(sets, threshold=threshold)
    low = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "value")).groupBy("left").agg(F.min("right").alias("low"))
    cohort = sets.join(low, F.col("entity") == F.col("left"), "left").select(F.col("entity").alias("set"), F.xxhash64(F.least("entity", F.coalesce("low", "entity"))).alias("cluster"))
    entities = types.select(F.col("s").alias("entity"), F.array_join("features", " ").alias("set")).join(cohort, "set").select("entity", "cluster")
    return numeric_anomalies(t, "iqr", factor, entities)


def detect(t: DataFrame, config: dict) -> DataFrame:
    """A detection by its configuration: anomalyDetectionType (numeric, predicate, multi, cohort), algorithm, clusteringMethod (none, kmeans, lsh), numberOfClusters, pairWiseDistanceThreshold, anomalyListSize."""
    kind, method = config.get("anomalyDetectionType", "numeric").lower(), config.get("algorithm", "IQR").lower()
    how = config.get("clusteringMethod", "none").lower()
    groups = None
    if how.startswith("bisecting") or how == "kmeans":
        groups = cluster(t, k=config.get("numberOfClusters"))
    elif "lsh" in how:
        groups = Lsh(features(t, "or")).clusters(1 - config.get("pairWiseDistanceThreshold", 0.43))
    if kind == "predicate":
        return predicate_anomalies(t)
    if kind == "multi":
        wide = pivot_features(t)
        numeric = [c for c, d in wide.dtypes if d == "array<double>"]
        return multi_anomalies(wide.select("s", *(F.get(c, F.lit(0)).alias(c) for c in numeric)), "s").orderBy(F.desc("score"), "s").limit(config.get("anomalyListSize", 10))
    if kind == "cohort":
        return cohort_anomalies(t)
    return numeric_anomalies(t, method, config.get("factor", 1.5), groups)


def similarity_triples(pairs: DataFrame, experiment: str, measure: str) -> DataFrame:
    """A similarity experiment as triples: a node for each pair with its two entities and the value."""
    node = F.concat(F.lit(f"{experiment}/"), F.md5(F.concat_ws(" ", "left", "right")))
    rows = [("type", F.lit(experiment + "#Similarity"), 1, None), ("first", F.col("left"), 1, None), ("second", F.col("right"), 1, None), ("value", F.col("value").cast("string"), 2, XSD + "double"), ("measure", F.lit(measure), 2, XSD + "string")]
    made = F.array(*(F.struct(F.lit(TYPE if p == "type" else f"{experiment}#{p}").alias("p"), o.alias("o"), F.lit(t).alias("t"), F.lit(dt).cast("string").alias("dt")) for p, o, t, dt in rows))
    return pairs.select(node.alias("s"), F.explode(made).alias("x")).select("s", "x.p", "x.o", "x.t", "x.dt", F.lit(None).cast("string").alias("lang"))


def prediction_triples(frame: DataFrame, key: str, columns: list[str], base: str) -> DataFrame:
    """Predictions as triples: (entity, base#column, value)."""
    kinds = {"double": "double", "float": "float", "int": "integer", "bigint": "integer", "boolean": "boolean"}
    dtypes = dict(frame.dtypes)
    made = F.array(*(F.struct(F.lit(f"{base}#{c}").alias("p"), F.col(c).cast("string").alias("o"), F.lit(XSD + kinds.get(dtypes[c], "string")).alias("dt")) for c in columns))
    return frame.select(F.col(key).alias("s"), F.explode(made).alias("x")).where("x.o is not null").select("s", "x.p", "x.o", F.lit(2).alias("t"), "x.dt", F.lit(None).cast("string").alias("lang"))


def seeds_similarity(t: DataFrame, kind: str, weights: dict[str, float] | None = None, threshold: float = 0.0, candidate_mode: str = "os") -> DataFrame:
    """left, right, value: things of a class that share a statement, compared property by property (overlap of values; for numbers, closeness within the property's range),
    and the weighted mean over the properties that either has."""
    own = t.join(t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct(), "s", "left_semi").where(F.col("p") != TYPE)
    pairs = similar(features(own, candidate_mode)).select("left", "right").distinct()
    number = F.when(F.col("dt").isin(*NUMERIC), F.col("o").try_cast("double"))
    sets = own.withColumn("v", number).groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("set"), F.avg("v").alias("v"))
    spread = sets.groupBy("p").agg((F.max("v") - F.min("v")).alias("spread"))
    sets = sets.join(spread, "p")
    x = pairs.join(sets.select(F.col("s").alias("left"), "p", F.col("set").alias("x"), F.col("v").alias("u"), "spread"), "left")
    y = pairs.join(sets.select(F.col("s").alias("right"), "p", F.col("set").alias("y"), F.col("v").alias("w")), "right")
    both = x.join(y, ["left", "right", "p"], "full")
    overlap = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    value = F.when(F.col("x").isNull() | F.col("y").isNull(), 0.0).when(F.col("u").isNotNull() & F.col("w").isNotNull() & (F.col("spread") > 0), 1 - F.abs(F.col("u") - F.col("w")) / F.col("spread")).otherwise(overlap)
    weight = F.coalesce(F.create_map(*(z for k, v in weights.items() for z in (F.lit(k), F.lit(float(v)))))[F.col("p")], F.lit(1.0)) if weights else F.lit(1.0)
    return both.groupBy("left", "right").agg((F.sum(value * weight) / F.sum(weight)).alias("value")).where(F.col("value") >= threshold)
