"""Vector functions, neighbours, cluster quality, density clusters, topic merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.functions import vectors as V
from dataquarry.operators import cluster as K
from dataquarry.operators import columns as C
from dataquarry.operators import neighbors as N
from dataquarry.operators import topics as T
from queryset.common import TOPIC_SQL, Registry, docs_topic, rnd, table

REGISTRY = Registry()

EMB_SQL = """e as (select vec_id, cast(embedding as double[]) as v,
  case when vec_id % 20 = 0 then -1 else label end as label from embeddings),
 own as (select * from e where label <> -1)"""
_CENTRE = """parts as (select label, i, avg(v[i]) as x from own, (select unnest(range(1, 65)) as i) group by 1, 2),
 cen as (select label, list(x order by i) as c from parts group by 1)"""
_PAIRS = """d as (select a.vec_id as p, a.label as own, b.label as label, list_distance(a.v, b.v) as d
  from own a, own b where a.vec_id <> b.vec_id)"""


def emb_mask(spark, sf):
    return table(spark, sf, "embeddings").withColumn("label", F.expr("case when vec_id % 20 = 0 then -1 else label end"))


def labelled(spark, sf):
    return C.filter_noise(emb_mask(spark, sf), "label")


@REGISTRY.add("cosine_similarity", """
select vec_id, round(list_cosine_similarity(cast(embedding as double[]), list_resize(cast([1.0] as double[]), 64, 1.0)), 6) as sim from embeddings""")
def cosine_similarity(spark, sf):
    ones = F.array_repeat(F.lit(1.0), 64)
    return table(spark, sf, "embeddings").select("vec_id", rnd(V.cosine_similarity(F.col("embedding"), ones), 6).alias("sim"))


@REGISTRY.add("l2_normalize", """
with n as (select vec_id, cast(embedding as double[]) as v, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as size from embeddings)
select vec_id, unnest(range(1, 65)) as i, round(unnest(list_transform(v, lambda x: x / size)), 6) as x from n""")
def l2_normalize(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.posexplode_outer(V.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return df.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), rnd("x", 6).alias("x"))


@REGISTRY.add("attach_labels", """
select doc_id, n_chars, coalesce(cast(quality as integer), -1) as quality from documents left join labels using (doc_id)""")
def attach_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return C.attach_labels(docs, table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id", "quality")


@REGISTRY.add("distinct_labels", f"with {TOPIC_SQL} select distinct topic from docs where topic <> -1")
def distinct_labels(spark, sf):
    return C.distinct_labels(docs_topic(spark, sf), "topic")


@REGISTRY.add("filter_noise_topics", f"with {TOPIC_SQL} select doc_id, topic from docs where topic <> -1")
def filter_noise_topics(spark, sf):
    return C.filter_noise(docs_topic(spark, sf).select("doc_id", "topic"), "topic")


@REGISTRY.add("topic_stats", f"""with {TOPIC_SQL} select count(distinct topic) filter (where topic <> -1) as n_topics,
 round(100.0 * avg(cast(topic = -1 as integer)), 4) as noise_pct, count(*) as n_rows from docs""")
def topic_stats(spark, sf):
    return T.topic_stats(docs_topic(spark, sf), "topic").withColumn("noise_pct", rnd("noise_pct"))


@REGISTRY.add("cluster_centroids", f"""with {EMB_SQL}, {_CENTRE},
 n as (select label, count(*) as n from own group by 1)
select parts.label, n, cast(i as integer) as i, round(x, 6) as x from parts join n using (label)""")
def cluster_centroids(spark, sf):
    out = K.cluster_centroids(emb_mask(spark, sf), "embedding", "label")
    return out.select("label", "n", F.posexplode("centroid").alias("i", "x")).select(
        "label", "n", (F.col("i") + 1).alias("i"), rnd("x", 6).alias("x")
    )


@REGISTRY.add("centroid_similarity", f"""with {EMB_SQL}, {_CENTRE}
select a.label as i, b.label as j, round(list_cosine_similarity(a.c, b.c), 6) as sim from cen a, cen b where a.label < b.label""")
def centroid_similarity(spark, sf):
    return T.centroid_similarity(emb_mask(spark, sf), "embedding", "label").withColumn("sim", rnd("sim", 6))


def _knn_sql(distance, k=15):
    return f"""with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
 d as (select a.vec_id as src, b.vec_id as dst, {distance} as dist from e a, e b where a.vec_id <> b.vec_id),
 r as (select *, row_number() over (partition by src order by dist, dst) as rank from d)
select src, dst, cast(rank as integer) as rank, round(dist, 5) as dist from r where rank <= {k}"""


@REGISTRY.add("knn_cosine", _knn_sql("1 - list_cosine_similarity(a.v, b.v)"))
def knn_cosine(spark, sf):
    out = N.knn(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.withColumn("dist", rnd("dist", 5))


@REGISTRY.add("knn_euclidean", _knn_sql("list_distance(a.v, b.v)"))
def knn_euclidean(spark, sf):
    """The neighbour graph in Euclidean mode, searched through pivot cells."""
    out = N.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", metric="euclidean", block_rows=512)
    return out.withColumn("dist", rnd("dist", 5))


@REGISTRY.add("pairwise_distance", f"""with {EMB_SQL}, {_PAIRS}
select p as key, own, label, round(sum(d), 3) as total from d group by 1, 2, 3""")
def pairwise_distance(spark, sf):
    """All pairs, summed per row and label; a row's distance to itself is zero."""
    df = labelled(spark, sf).withColumn("labels", F.array("label"))
    out = N.distances_to_labels(df, "vec_id", "embedding", "labels")
    return out.select("key", "own", "label", rnd("total", 3).alias("total"))


_SIL = f"""{_PAIRS},
 g as (select p, own, label, avg(d) as m from d group by 1, 2, 3),
 ab as (select p, max(m) filter (where label = own) as a, min(m) filter (where label <> own) as b from g group by 1),
 s as (select case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end as s from ab),
 sil as (select avg(s) as silhouette from s)"""
_DB = f"""{_CENTRE}, sp as (select own.label, any_value(c) as c, avg(list_distance(v, c)) as s from own join cen using (label) group by 1),
 w as (select a.label, max(case when list_distance(a.c, b.c) > 0 then (a.s + b.s) / list_distance(a.c, b.c) else 0 end) as w
   from sp a, sp b where a.label <> b.label group by 1),
 db as (select avg(w) as davies_bouldin from w)"""


@REGISTRY.add("silhouette", f"with {EMB_SQL}, {_SIL} select round(silhouette, 6) as silhouette, 'euclidean' as distance from sil")
def silhouette(spark, sf):
    return K.silhouette(labelled(spark, sf), "vec_id", "embedding", "label").withColumn("silhouette", rnd("silhouette", 6))


@REGISTRY.add("silhouette_squared", f"with {EMB_SQL}, " + _SIL.replace("list_distance(a.v, b.v)", "list_distance(a.v, b.v) ** 2")
              + " select round(silhouette, 6) as silhouette, 'squared_euclidean' as distance from sil")
def silhouette_squared(spark, sf):
    """The linear-cost measure, checked against all pairs."""
    out = K.silhouette(labelled(spark, sf), "vec_id", "embedding", "label", "squared_euclidean")
    return out.withColumn("silhouette", rnd("silhouette", 6))


@REGISTRY.add("davies_bouldin", f"with {EMB_SQL}, {_DB} select round(davies_bouldin, 5) as davies_bouldin from db")
def davies_bouldin(spark, sf):
    return K.davies_bouldin(emb_mask(spark, sf), "embedding", "label").withColumn("davies_bouldin", rnd("davies_bouldin", 5))


@REGISTRY.add("cluster_score", f"""with {EMB_SQL}, {_SIL}, {_DB}
select round(silhouette, 5) as silhouette, round(davies_bouldin, 5) as davies_bouldin,
  round(0.6 * (silhouette + 1) / 2 + 0.4 / (1 + davies_bouldin), 5) as score from sil, db""")
def cluster_score(spark, sf):
    out = K.cluster_score(labelled(spark, sf), "vec_id", "embedding", "label")
    return out.select(*[rnd(c, 5).alias(c) for c in out.columns])


@REGISTRY.add("pca_reduce", """
with m as (select var_samp(p_size) as a, var_samp(p_retailprice / 100) as b, covar_samp(p_size, p_retailprice / 100) as c from part),
 e as (select a + b as tr, sqrt(((a + b) / 2) ** 2 - (a * b - c * c)) as gap from m)
select 1 as component, round((tr / 2 + gap) / tr, 5) as ratio from e union all select 2, round((tr / 2 - gap) / tr, 5) from e""")
def pca_reduce(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"))
    _, _, ratios = K.pca_reduce(df, "v")
    return K.variance_table(spark, ratios).withColumn("ratio", rnd("ratio", 5))


@REGISTRY.add("kmeans_sweep")
def kmeans_sweep(spark, sf):
    return K.kmeans_sweep(T.reduce_vectors(table(spark, sf, "embeddings"), "embedding"), "vec_id")[0]


def _which_sql(which: int, label: str) -> str:
    own = f"own as (select vec_id, v, {label} as label from e where label <> -1)"
    pairs = _PAIRS.replace("list_distance(a.v, b.v)", "list_distance(a.v, b.v) ** 2")
    rest = _SIL.replace(_PAIRS, pairs)
    first = EMB_SQL[: EMB_SQL.index("own as")]
    return f"select {which} as which, round(silhouette, 6) as silhouette from (with {first} {own}, {rest} select silhouette from sil)"


@REGISTRY.add("sweep_silhouettes", _which_sql(0, "label") + " union all " + _which_sql(1, "cast(vec_id % 3 as integer)"))
def sweep_silhouettes(spark, sf):
    """The measure of the k sweep for two given labellings in one pass, checked against all pairs."""
    df = labelled(spark, sf).withColumn("labels", F.array(F.col("label").cast("int"), F.expr("cast(vec_id % 3 as int)")))
    found = K.squared_silhouettes(df, "embedding", "labels")
    return spark.createDataFrame(sorted(found.items()), "which int, silhouette double").withColumn("silhouette", rnd("silhouette", 6))


@REGISTRY.add("reduce_vectors")
def reduce_vectors(spark, sf):
    out = T.reduce_vectors(table(spark, sf, "embeddings"), "embedding")
    return out.select("vec_id", *[rnd(F.col("reduced")[i], 5).alias(f"x{i}") for i in range(5)])


_EPSILON = 7.6


@REGISTRY.add("density_cluster", f"""with recursive g as ({_knn_sql("list_distance(a.v, b.v)").replace("round(dist, 5)", "dist")}),
 core as (select src as node, dist as core from g where rank = 15 and dist <= {_EPSILON}),
 w as (select g.src, g.dst from g join core a on a.node = g.src join core b on b.node = g.dst where g.dist <= {_EPSILON}),
 links as (select src, dst from w union select dst, src from w),
 reach(node, seen) as (select node, node from core union select reach.node, links.dst from reach join links on links.src = reach.seen),
 comp as (select node, min(seen) as comp from reach group by 1),
 big as (select comp, row_number() over (order by count(*) desc, comp) - 1 as label from comp group by 1 having count(*) >= 15)
select e.vec_id, cast(coalesce(big.label, -1) as integer) as label from embeddings e
left join comp on comp.node = e.vec_id left join big using (comp)""")
def density_cluster(spark, sf):
    """Components of the mutual-reachability graph cut at a fixed distance."""
    return T.density_cluster(table(spark, sf, "embeddings"), "vec_id", "embedding", epsilon=_EPSILON)


@REGISTRY.add("density_cluster_hierarchy")
def density_cluster_hierarchy(spark, sf):
    """The clusters of greatest excess of mass over the grid of distances."""
    reduced = T.reduce_vectors(table(spark, sf, "embeddings"), "embedding")
    return T.density_cluster(reduced, "vec_id", "reduced")


@REGISTRY.add("merge_topics", f"""with recursive {EMB_SQL}, {_CENTRE},
 nx as (select a.label as i, min(b.label) as j from cen a join cen b on a.label < b.label
   and list_cosine_similarity(a.c, b.c) > 0.15 group by 1),
 chain(label, pos) as (select label, label from cen union all select label, nx.j from chain join nx on nx.i = chain.pos),
 fin as (select label, max(pos) as merged from chain group by 1)
select vec_id, cast(coalesce(merged, -1) as integer) as label from e left join fin using (label)""")
def merge_topics(spark, sf):
    out = T.merge_topics(emb_mask(spark, sf).select("vec_id", "embedding", "label"), "embedding", "label", 0.15)
    return out.select("vec_id", "label")
