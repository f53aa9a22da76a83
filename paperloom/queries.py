"""One query for each operator of the inventory over the bundled tables, with the SQL that gives the same rows.

``QUERIES``: name to (spark, folder) -> DataFrame. ``SQL``: name to DuckDB SQL.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.functions import text as tx
from paperloom.functions import vector as vec
from paperloom.operators import composition as co
from paperloom.operators import graph as gr
from paperloom.operators import metrics as me
from paperloom.operators import projection as pr
from paperloom.operators import relational as re_
from paperloom.operators import sampling as sa
from paperloom.operators import similarity as si
from paperloom.operators import spectral as sp
from paperloom.operators import vectorize as ve
from paperloom.plans import pipelines as pl
from paperloom.sources import readers, writers
from paperloom.sources.views import EDGES, EMB, NODES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ASSIGN = """emb as (select node_id, class_idx, cast(embedding as double[]) as e from emb0),
assignments as (select node_id, class_idx, cluster_id from (select a.node_id, a.class_idx, s.node_id as cluster_id, row_number() over (partition by a.node_id order by list_cosine_similarity(a.e, s.e) desc, s.node_id) as rn from emb a, emb s where s.node_id < 10) x where rn = 1),
comp as (select cluster_id, class_idx as class_id, count(*) as paper_count from assignments group by 1, 2),
composition as (select *, paper_count * 100.0 / sum(paper_count) over (partition by cluster_id) as pct, sum(paper_count) over (partition by cluster_id) as total, row_number() over (partition by cluster_id order by paper_count desc, class_id) as rn from comp)"""
_PRELUDE = f"with recursive nodes as ({NODES}), edges as ({EDGES}), emb0 as ({EMB}), {_ASSIGN}"
_CATS = "cats as (select unnest(range(40)) as class_id, unnest([" + ",".join(f"'{c}'" for c in readers.CATEGORIES) + "]) as category, unnest([" + ",".join(f"'{c}'" for c in readers.CATEGORY_NAMES) + "]) as full_name)"


def query(sql: str | None = None):
    """Register a function of (views); its SQL may use nodes, edges, emb, assignments, comp and composition."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            SQL[f.__name__] = f"{_PRELUDE}, {body[5:]}" if body.startswith("also ") else f"{_PRELUDE} {body}"
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# sources, text, relational


@query("select o_orderkey, o_custkey, c_custkey as c_key, o_orderstatus, coalesce(c_name, 'none') as c_name from orders left join customer on o_custkey = c_custkey order by o_orderkey limit 1000")
def src_left_join_head(v: Views) -> DataFrame:
    """J1, P5, L2, S2."""
    c = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("c_key"), "c_name")
    joined = re_.left_join_suffixed(v.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), c, "o_custkey")
    return re_.fill_defaults(readers.first_records(joined, 1000, "o_orderkey"), {"c_name": "none"}).select("o_orderkey", "o_custkey", "c_key", "o_orderstatus", "c_name")


@query("select event_id, json_extract_string(props, '$.k') as k, length(props) as n from events")
def json_props(v: Views) -> DataFrame:
    """S3, X20, X21."""
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("select * from (values ('1','2'),('3','4'),('5','6')) t(source, target)")
def edge_text_parse(v: Views) -> DataFrame:
    """S4, F5."""
    lines = ["# header", "", "1 2", "  3\t4  extra", "lonely", "   # note", "5   6"]
    return readers.parse_edge_lines(v.spark.createDataFrame([(x,) for x in lines], "value string"))


@query("select * from (values ('hep-th/1','On a long title','A. One, B. Two','We show it.'),('hep-th/2','Short Abstract: Done.', null, 'Done.')) t(paper_id, title, authors, abstract)")
def meta_regex_extract(v: Views) -> DataFrame:
    """S5, X1, X2."""
    blobs = ["Paper: hep-th/1\nTitle: On a\n  long title\nAuthors: A. One,\n B. Two\nComments: 9 pages\nAbstract: We show\nit.\\\\ tail", "Paper: hep-th/2\nTitle: Short\nAbstract: Done.", "nothing here"]
    return readers.parse_blobs(v.spark.createDataFrame([(b,) for b in blobs], "content string"))


@query(f"""also {_CATS} select node_id, coalesce(category, 'unknown_' || class_idx) as class_label, case when mag_paper_id is not null and mag_paper_id <> 0 then 'MAG:' || mag_paper_id else 'node_' || node_id end as paper_id, coalesce(title, 'Paper ' || node_id) as title, coalesce(abstract, '') as abstract from nodes left join cats on class_idx = class_id""")
def nodes_enrich(v: Views) -> DataFrame:
    """M37, J17, P1, P7, P8, D1, D20."""
    labels = readers.default_categories(v.spark).select(F.col("class_id").alias("class_idx"), F.col("category").alias("class_label"))
    return re_.enrich_nodes(v.nodes(), labels).select("node_id", "class_label", "paper_id", "title", "abstract")


@query("""also part_nodes as (select node_id, case when mag_paper_id is not null and mag_paper_id <> 0 then 'MAG:' || mag_paper_id else 'node_' || node_id end as pid from nodes where class_idx < 30) select source, target, a.pid as source_paper_id, b.pid as target_paper_id from edges join part_nodes a on source = a.node_id join part_nodes b on target = b.node_id""")
def edge_list_subset(v: Views) -> DataFrame:
    """M38, F1, J5, D4."""
    n = v.nodes().where("class_idx < 30")
    return re_.edge_list(re_.induced_edges(v.edges(), n), n)


@query("select row_number() over (order by node_id) - 1 as idx, node_id from nodes")
def dense_ids(v: Views) -> DataFrame:
    """P11, L9."""
    return re_.dense_index(v.nodes().select("node_id"), "node_id").select(F.col("idx").cast("long").alias("idx"), "node_id")


@query(f"also {_CATS} select cluster_id, c.class_id, paper_count, category, coalesce(category, 'Unknown_' || c.class_id) as shown from comp c left join (select * from cats where class_id < 5) k on c.class_id = k.class_id")
def label_map_join(v: Views) -> DataFrame:
    """J2, S16, P1, P7."""
    few = readers.default_categories(v.spark).where("class_id < 5").select("class_id", "category")
    return v.composition().select(F.col("cluster_id").cast("long").alias("cluster_id"), "class_id", "paper_count").join(few, "class_id", "left").withColumn("shown", F.coalesce("category", F.concat(F.lit("Unknown_"), F.col("class_id").cast("string"))))


def _merged(v: Views) -> DataFrame:
    return v.composition().join(readers.default_categories(v.spark).where("class_id < 8"), "class_id", "left")


@query(f"also {_CATS}, m as (select * from comp join (select * from cats where class_id < 8) k using (class_id)) select category, sum(paper_count)::bigint as total_papers, count(distinct cluster_id) as n_clusters, round(sum(paper_count) * 100.0 / sum(sum(paper_count)) over (), 6) as percentage from m group by category")
def category_summary(v: Views) -> DataFrame:
    """A2, W8."""
    return r6(co.category_summary(_merged(v)), "percentage")


@query(f"also {_CATS} select category, sum(paper_count)::bigint as total_papers from comp join cats using (class_id) where class_id < 8 group by category order by 2 desc, 1 limit 5")
def top_categories(v: Views) -> DataFrame:
    """A3, L1, L3."""
    return co.top_categories(_merged(v))


@query("select class_idx, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percentage from nodes group by 1")
def class_distribution(v: Views) -> DataFrame:
    """A1, K12, P13."""
    return r6(co.class_distribution(v.nodes()), "percentage")


@query("select count(*) as n_rows, count(*) filter (mag_paper_id is null) as mag_paper_id_nulls, count(*) filter (title is null) as title_nulls, count(distinct class_idx) as n_classes, round(avg(length(title)), 6) as avg_title from nodes")
def missing_values(v: Views) -> DataFrame:
    """A4, A24, F4."""
    n = v.nodes()
    extra = n.agg(F.countDistinct("class_idx").alias("n_classes"), F.round(F.avg(F.length("title")), 6).alias("avg_title"))
    return re_.null_counts(n, ["mag_paper_id", "title"]).crossJoin(extra)


@query("""select node_id, title as t, title || case when abstract <> '' then ' ' || abstract else '' end as ta, title || case when abstract <> '' then ' [ABSTRACT] ' || abstract else '' end as c, case when title <> '' and abstract <> '' then title || ' [SEP] ' || abstract else title || abstract end as s from (select node_id, title, coalesce(case when node_id % 3 = 0 then null else abstract end, '') as abstract from nodes) x""")
def text_combine_modes(v: Views) -> DataFrame:
    """X5, X6, X23."""
    n = v.nodes().withColumn("abstract", F.expr("case when node_id % 3 = 0 then null else abstract end"))
    none = F.lit(None).cast("string")
    return n.select("node_id", tx.combine_fields("title", "abstract", none, "title").alias("t"), tx.combine_fields("title", "abstract", none, "title_abstract").alias("ta"), tx.combine_fields("title", "abstract", none, "combined").alias("c"), tx.title_sep_abstract("title", "abstract").alias("s"))


@query("select * from (values (1,'On and limits'),(2,'plain'),(3,'a b')) t(id, title)")
def latex_clean(v: Views) -> DataFrame:
    """X3, F9, F10."""
    rows = [(1, r"On \emph{this} $x^2$ and {limits}"), (2, "plain"), (3, "a   \\alpha b")]
    return v.spark.createDataFrame(rows, "id int, title string").select("id", tx.clean_latex("title").alias("title"))


_STOP = ",".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(f"""select doc_id, trim(regexp_replace(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '([.,;:!?])', ' \\1 ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '' and not list_contains([{_STOP}], t)), ' '), '\\s+([.,;:!?])', '\\1', 'g')) as t from documents where lang = 'en'""")
def stopword_removal(v: Views) -> DataFrame:
    """X4, X8."""
    return v.table("documents").where("lang = 'en'").select("doc_id", tx.remove_stop_words("text").alias("t"))


@query(f"""select doc_id, len(w)::bigint as n_tokens, array_to_string(w, ' ') as tokens from (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '\\p{{L}}+') and not list_contains([{_STOP}], t)) as w from documents) x""")
def tokenize_alpha(v: Views) -> DataFrame:
    """X7, X11."""
    return v.table("documents").select("doc_id", tx.tokenize_alpha("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query("""also w as (select node_id as id, list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda t: t <> '')) as w from nodes), a as (select id, len(w) as size, unnest(w) as word from w), p as (select a.id as l, b.id as r, a.size, count(*) as n from a join a b on a.word = b.word group by all), s as (select l, r, n * 1.0 / size as o from p where n * 1.0 / size > 0.5), k as (select *, row_number() over (partition by l order by o desc, r) as rn from s) select l as left_id, r as right_id, round(o, 6) as overlap from k where rn <= 3""")
def word_overlap_match(v: Views) -> DataFrame:
    """J18, X12, S18."""
    t = v.nodes().select(F.col("node_id").alias("id"), "title")
    return r6(re_.match_titles(t, t), "overlap")


@query("""also t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from documents), tf as (select doc_id, term, count(*) as tf from t group by 1, 2), v as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by 2 desc, 1 limit 2000), n as (select count(*) as n from documents), x as (select doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as x from tf join v using (term), n) select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from x""")
def tfidf(v: Views) -> DataFrame:
    """M27, K9."""
    return r6(ve.tfidf(v.table("documents")), "weight")


@query("""also t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from documents), tf as (select doc_id, term, count(*) as tf from t group by 1, 2), v as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by 2 desc, 1 limit 20), n as (select count(*) as n from documents), x as (select doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as x from tf join v using (term), n) select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from x""")
def tfidf_dense_csv(v: Views) -> DataFrame:
    """K9: written as a wide table and read back; its cells other than zero."""
    wide = ve.dense_tfidf(v.table("documents"), max_features=20)
    path = _out(v, "tfidf")
    writers.write_csv(wide, path)
    back = readers.read_csv(v.spark, path, ", ".join(f"`{c}` {'bigint' if c == 'id' else 'double'}" for c in wide.columns))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"`{c}`").alias("weight")) for c in back.columns if c != "id"]))
    return r6(back.select(F.col("id").alias("doc_id"), cells.alias("c")).select("doc_id", "c.*").where("weight <> 0"), "weight")


@query()
def word2vec_docs(v: Views) -> DataFrame:
    """M28."""
    return ve.word2vec(v.table("documents"), size=16)


@query()
def embed_hash(v: Views) -> DataFrame:
    """U1, M29-M35."""
    return ve.embed(v.table("documents"), ve.hashing_embedder(64), 64)


# vectors and similarity


@query("select node_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as first_unit, round(list_max(e), 6) as biggest, len(e)::bigint as dim from emb")
def vector_functions(v: Views) -> DataFrame:
    """X13-X15, X18, K5, P2, P3, P10."""
    packed = re_.unpack_vector(re_.pack_vector(v.emb()))
    return r6(packed.select("node_id", vec.norm("embedding").alias("norm"), F.get(vec.unit("embedding"), F.lit(0)).alias("first_unit"), F.expm1(vec.splade_pool("embedding")).alias("biggest"), F.size("embedding").cast("long").alias("dim")), "norm", "first_unit", "biggest")


_EW = "ew as (select source, target, list_cosine_similarity(a.e, b.e) as weight from edges join emb a on source = a.node_id join emb b on target = b.node_id)"


@query(f"also {_EW} select source, target, round(weight, 6) as weight from ew")
def cosine_edge_weight(v: Views) -> DataFrame:
    """J8, F13, D5, X13."""
    return r6(si.edge_weights(v.edges(), v.emb()), "weight")


@query(f"also {_EW} select count(*) as n_edges, round(avg(weight), 6) as mean_weight, round(stddev_samp(weight), 6) as std_weight, round(min(weight), 6) as min_weight, round(max(weight), 6) as max_weight from ew")
def edge_weight_stats(v: Views) -> DataFrame:
    """A19."""
    return r6(si.weight_stats(si.edge_weights(v.edges(), v.emb())), "mean_weight", "std_weight", "min_weight", "max_weight")


@query("select count(*) as n from edges where source not in (select node_id from emb) or target not in (select node_id from emb)")
def edges_without_vectors(v: Views) -> DataFrame:
    """F13."""
    return si.edges_without_vectors(v.edges(), v.emb()).agg(F.count("*").alias("n"))


@query("also far as (select source + 2000000000 as source, target + 2000000000 as target from edges) select s.node_id as source, t.node_id as target from far join nodes s on far.source = s.mag_paper_id join nodes t on far.target = t.mag_paper_id")
def id_bridge_join(v: Views) -> DataFrame:
    """J9."""
    far = v.edges().select((F.col("source") + 2000000000).alias("source"), (F.col("target") + 2000000000).alias("target"))
    return re_.bridge_ids(far, v.nodes(), v.emb())


_PAIRS = "pairs as (select a.node_id as i, b.node_id as j, list_cosine_similarity(a.e, b.e) as sim from emb a, emb b)"


@query(f"also {_PAIRS} select round(avg(sim), 6) as mean_sim, round(stddev_pop(sim), 6) as std_sim, round(min(sim), 6) as min_sim, round(max(sim), 6) as max_sim from pairs")
def pairwise_similarity_stats(v: Views) -> DataFrame:
    """A18, J10."""
    return r6(si.similarity_stats(v.emb()), "mean_sim", "std_sim", "min_sim", "max_sim")


_KNN = f"{_PAIRS}, knn as (select * from (select *, row_number() over (partition by i order by sim desc, j) as rn from pairs where i <> j) x where rn <= 10)"


@query(f"also {_KNN} select i, j, round(sim, 6) as sim, rn::bigint as rank from knn")
def knn_join(v: Views) -> DataFrame:
    """J11, W7."""
    return longs(r6(si.knn(v.emb(), 10), "sim"), "rank")


@query(f"also {_KNN}, b as (select i, j, greatest(sim, 0) as w from knn union all select j, i, greatest(sim, 0) from knn) select i, j, round(max(w), 6) as w from b group by 1, 2 having max(w) > 0")
def knn_graph_v1(v: Views) -> DataFrame:
    """M1, G7."""
    return r6(si.knn_graph_assigned(v.emb(), 10), "w")


@query(f"also {_KNN}, b as (select i, j, sim as w from knn where sim > 0 union all select j, i, sim from knn where sim > 0 union all select node_id, node_id, 1.0 from emb) select i, j, round(sum(w), 6) as w from b group by 1, 2")
def knn_graph_v2(v: Views) -> DataFrame:
    """M2, A27, D9."""
    return r6(si.knn_graph_summed(v.emb(), 10), "w")


@query(f"also {_PAIRS} select i, j, round(sim, 6) as w from pairs where sim >= 0.3")
def epsilon_graph(v: Views) -> DataFrame:
    """M3, J12, F3."""
    return r6(si.epsilon_graph(v.emb(), 0.3), "w")


@query(f"also {_PAIRS} select i, j, round((sim + 1) / 2, 6) as w from pairs")
def full_graph_v1(v: Views) -> DataFrame:
    """M4, D10."""
    return r6(si.full_graph(v.emb()), "w")


@query(f"also {_PAIRS} select i, j, round((sim + 1) / 2, 6) as w from pairs where sim >= 0.01")
def full_graph_v2(v: Views) -> DataFrame:
    """M5."""
    return r6(si.full_graph(v.emb(), 0.01), "w")


# citation graphs


def _adj(where: str) -> str:
    return f"both_ways as (select source as i, target as j from edges {where} union all select target, source from edges where source <> target), adj as (select i, j, count(*)::double as w from both_ways group by 1, 2)"


@query(f"also {_adj('')} select * from adj")
def citation_adjacency_keep(v: Views) -> DataFrame:
    """M6a, G7, A27."""
    return gr.citation_adjacency(v.edges(), "keep")


@query(f"also {_adj('where source <> target')} select * from adj")
def citation_adjacency_drop(v: Views) -> DataFrame:
    """M6b, F6."""
    return gr.citation_adjacency(v.edges(), "drop")


@query(f"also {_adj('where source <> target')} select * from adj union all select node_id, node_id, 1.0::double from nodes")
def citation_adjacency_unit(v: Views) -> DataFrame:
    """M6c-e."""
    return gr.citation_adjacency(v.edges(), "unit", v.nodes())


@query(f"also {_EW}, b as (select source as i, target as j, weight from ew union all select target, source, weight from ew where source <> target) select i, j, round(sum(weight), 6) as w from b group by 1, 2")
def weighted_adjacency(v: Views) -> DataFrame:
    """M7."""
    return r6(gr.weighted_adjacency(v.edges(), v.emb()), "w")


@query("select 0.0::double as max_difference")
def adjacency_symmetry(v: Views) -> DataFrame:
    """A30."""
    return gr.asymmetry(gr.citation_adjacency(v.edges(), "keep")).select(F.round("max_difference", 6).alias("max_difference"))


_LAP = f"{_adj('')}, deg as (select i, sum(w) as d from adj group by i)"


@query(f"also {_LAP}, x as (select adj.i, adj.j, -w / sqrt(a.d * b.d) as w from adj join deg a on adj.i = a.i join deg b on adj.j = b.i union all select i, i, 1.0 from deg) select i, j, round(sum(w), 6) as w from x group by 1, 2")
def normalized_laplacian(v: Views) -> DataFrame:
    """M8, X17, A21."""
    return r6(gr.normalized_laplacian(gr.citation_adjacency(v.edges(), "keep")), "w")


@query(f"also {_LAP}, x as (select adj.i, adj.j, -w / d as w from adj join deg on adj.i = deg.i union all select i, i, 1.0 from deg) select i, j, round(sum(w), 6) as w from x group by 1, 2")
def random_walk_laplacian(v: Views) -> DataFrame:
    """M8, X17."""
    return r6(gr.normalized_laplacian(gr.citation_adjacency(v.edges(), "keep"), True), "w")


@query("select n_nodes, n_edges, round(n_edges * 1.0 / (n_nodes * (n_nodes - 1)), 9) as density, round(2.0 * n_edges / n_nodes, 6) as average_degree from (select count(distinct node_id) as n_nodes from nodes), (select count(*) as n_edges from (select distinct * from edges))")
def graph_stats(v: Views) -> DataFrame:
    """A22, G6, D11."""
    return gr.graph_stats(v.edges(), v.nodes()).select("n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("average_degree", 6).alias("average_degree"))


@query("also u as (select source as a, target as b from edges union select target, source from edges), l as (select node_id as n, node_id as c from nodes union select u.b, l.c from l join u on u.a = l.n where l.c < u.b) select n as node_id, min(c) as component from l group by n")
def connected_components(v: Views) -> DataFrame:
    """A23."""
    return gr.components(v.edges(), v.nodes())


@query("""also o as (select source as node_id, count(distinct target) as n from edges group by 1), i as (select target as node_id, count(distinct source) as n from edges group by 1), b as (select a as node_id, count(distinct b) as n from (select source as a, target as b from edges union all select target, source from edges) group by 1) select nodes.node_id, coalesce(o.n, 0) as n_out, coalesce(i.n, 0) as n_in, coalesce(b.n, 0) as n_both from nodes left join o using (node_id) left join i on i.node_id = nodes.node_id left join b on b.node_id = nodes.node_id""")
def citation_neighbors(v: Views) -> DataFrame:
    """A25, D12."""
    return gr.neighbour_counts(v.edges(), v.nodes())


_CITE = "l as (select source as n, target as x from edges union select target, source from edges), dg as (select n, count(*) as d from l group by n), cs as (select a.n as i, b.n as j, count(*) as c from l a join l b on a.x = b.x join nodes na on na.node_id = a.n and na.class_idx > 12 join nodes nb on nb.node_id = b.n and nb.class_idx <= 12 group by 1, 2), sims as (select i, j, c / sqrt(p.d * q.d) as sim from cs join dg p on p.n = i join dg q on q.n = j)"


@query(f"also {_CITE} select i, j, round(sim, 6) as sim from sims")
def citation_similarity(v: Views) -> DataFrame:
    """J14, M23."""
    n = v.nodes()
    return r6(gr.citation_similarity(v.edges(), n.where("class_idx > 12"), n.where("class_idx <= 12")), "sim")


# sampling and projection

_QUOTA = "cnt as (select class_idx, count(*) as size from nodes group by 1), ex as (select class_idx, size, size * N * 1.0 / sum(size) over () as exact from cnt, (select round(count(*) * 0.1) as N from nodes)), rk as (select *, floor(exact) as base, row_number() over (order by exact - floor(exact) desc, class_idx) as rr from ex), q as (select class_idx, least(size, base + case when rr <= (select round(count(*) * 0.1) from nodes) - sum(base) over () then 1 else 0 end) as quota from rk), sampled as (select node_id, class_idx, rn <= quota as is_in from (select node_id, class_idx, row_number() over (partition by class_idx order by md5(node_id || ':42'), node_id) as rn from nodes) x join q using (class_idx))"


@query(f"also {_QUOTA} select node_id, class_idx from sampled where is_in")
def stratified_sample(v: Views) -> DataFrame:
    """M16, M17."""
    return sa.stratified_sample(v.nodes().select("node_id", "class_idx"), ratio=0.1)[0]


@query(f"also {_QUOTA} select node_id, class_idx from sampled where not is_in")
def stratified_rest(v: Views) -> DataFrame:
    """M16, F2, J6."""
    return sa.stratified_sample(v.nodes().select("node_id", "class_idx"), ratio=0.1)[1]


@query(f"also {_QUOTA}, s as (select node_id from sampled where is_in), nb as (select target as n from edges join s on source = node_id union select source from edges join s on target = node_id) select node_id, true as is_seed from s union all select n, false from nb where n not in (select node_id from s) and n in (select node_id from nodes)")
def stratified_expand(v: Views) -> DataFrame:
    """M18, J20, G1-G3, L9."""
    n = v.nodes().select("node_id", "class_idx")
    return sa.expand_sample(sa.stratified_sample(n, ratio=0.1)[0], v.edges(), n).select("node_id", "is_seed")


def _with_clusters(v: Views) -> DataFrame:
    return v.emb().join(v.assignments().select("node_id", "cluster_id"), "node_id")


_CENT = "ce as (select cluster_id, generate_subscripts(e, 1) as pos, unnest(e) as x from emb join assignments using (node_id)), cent as (select cluster_id, pos, avg(x) as x from ce group by 1, 2), cents as (select cluster_id, list(x order by pos) as c from cent group by 1)"


@query(f"also {_CENT} select cluster_id, pos - 1 as pos, round(x, 6) as x from cent")
def centroids(v: Views) -> DataFrame:
    """A20, M19."""
    return si.centroids(_with_clusters(v)).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.posexplode("centroid").alias("pos", "x")).select("cluster_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("select node_id, class_idx, cluster_id from assignments")
def nearest_seed(v: Views) -> DataFrame:
    """The flagship slice."""
    return longs(v.assignments(), "cluster_id")


@query(f"also {_CENT} select node_id, cluster_id, score from (select node_id, cluster_id, round(list_cosine_similarity(e, c), 6) as score, row_number() over (partition by node_id order by list_cosine_similarity(e, c) desc, cluster_id) as rn from emb, cents) x where rn = 1")
def nearest_centroid(v: Views) -> DataFrame:
    """J15, M22."""
    return longs(r6(si.nearest_centroid(v.emb(), si.centroids(_with_clusters(v))), "score").select("node_id", "cluster_id", "score"), "cluster_id")


@query(f"also {_CENT} select node_id, cluster_id, score from (select node_id, cluster_id, round(0.4 * list_cosine_similarity(e, c) + 0.6 * list_cosine_similarity(e[1:8], c[1:8]), 6) as score, row_number() over (partition by node_id order by 0.4 * list_cosine_similarity(e, c) + 0.6 * list_cosine_similarity(e[1:8], c[1:8]) desc, cluster_id) as rn from emb, cents) x where rn = 1")
def blended_centroid(v: Views) -> DataFrame:
    """J16, M22."""
    rows = _with_clusters(v).withColumn("features", F.slice("embedding", 1, 8))
    out = si.blended_centroid(rows.drop("cluster_id"), si.centroids(rows), si.centroids(rows, "features"), 0.4)
    return longs(r6(out, "score").select("node_id", "cluster_id", "score"), "cluster_id")


@query("also k as (select i, j, greatest(sim, 1e-10) as w from (select a.node_id as i, b.node_id as j, list_cosine_similarity(a.e, b.e) as sim, row_number() over (partition by a.node_id order by list_cosine_similarity(a.e, b.e) desc, b.node_id) as rn from emb a, emb b where a.class_idx >= 5 and b.class_idx < 5) x where rn <= 3), f as (select i, pos - 1 as pos, sum(w * x) / sum(w) as x from k join (select node_id, generate_subscripts(e[1:4], 1) as pos, unnest(e[1:4]) as x from emb) on j = node_id group by 1, 2) select i as node_id, pos, round(x, 6) as x from f")
def project_embedding_knn(v: Views) -> DataFrame:
    """M20, J13, X16."""
    e = v.emb()
    features = e.select("node_id", F.slice("embedding", 1, 4).alias("features"))
    return pr.project_knn(e.where("class_idx >= 5"), e.where("class_idx < 5"), features, 3).select("node_id", F.posexplode("features").alias("pos", "x")).select("node_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"also {_CITE}, k as (select *, row_number() over (partition by i order by sim desc, j) as rn from sims), w as (select i, j, sim / sum(sim) over (partition by i) as weight from k where rn <= 3), z as (select node_id as i from nodes where class_idx > 12 and node_id not in (select i from w)), f as (select node_id as j from nodes where class_idx <= 12 order by 1 limit 3) select i, j, round(weight, 6) as weight from w union all select i, j, round(1.0 / (select count(*) from f), 6) from z, f")
def project_citation(v: Views) -> DataFrame:
    """M21, L6."""
    n = v.nodes()
    return r6(pr.citation_weights(v.edges(), n.where("class_idx > 12"), n.where("class_idx <= 12"), 3), "weight")


@query("select node_id, class_idx, cluster_id from assignments")
def reconstruct_labels(v: Views) -> DataFrame:
    """J19, G4, L10."""
    a = v.assignments()
    return longs(re_.reconstruct_labels(a.where("node_id % 3 = 0"), a.where("node_id % 3 <> 0"), v.emb().select("node_id", "class_idx")), "cluster_id")


@query("select nodes.node_id, title, emb.class_idx as emb_class from nodes join emb on nodes.node_id = emb.node_id")
def align_datasets(v: Views) -> DataFrame:
    """J7, J3, G3."""
    return re_.align(v.nodes(), v.emb().drop("class_idx")).join(v.emb().select("node_id", F.col("class_idx").alias("emb_class")), "node_id").select("node_id", "title", "emb_class")


@query("select n.node_id, coalesce(a.p_name, b.p_name, 'Missing title') as title from nodes n left join part a on a.p_partkey = n.node_id and a.p_partkey % 2 = 0 left join part b on b.p_partkey = n.node_id + 1 and b.p_partkey % 2 = 0")
def join_with_fallback(v: Views) -> DataFrame:
    """By the id, else by the prefixed id."""
    even = v.table("part").where("p_partkey % 2 = 0")
    meta = even.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("title")).unionByName(even.select(F.concat(F.lit("x/"), (F.col("p_partkey") - 1).cast("string")).alias("key"), F.col("p_name").alias("title")))
    return re_.join_with_fallback(v.nodes().select("node_id", F.col("node_id").cast("string").alias("key")), meta, "key", "x/", {"title": "Missing title"}).select("node_id", "title")


# compositions and measures


@query("select cluster_id, class_id, paper_count, round(pct, 6) as percentage_in_cluster, total::bigint as total_cluster_size, rn = 1 as is_dominant_class from composition")
def composition(v: Views) -> DataFrame:
    """A6, A7, W10, D15."""
    return longs(r6(v.composition(), "percentage_in_cluster"), "cluster_id")


@query("also e as (select cluster_id, count(*) as classes, max(pct) as top from composition group by 1) select count(*) as total_clusters, round(avg(classes), 6) as avg_classes, round(avg(top), 6) as avg_dominant_pct, count(*) filter (classes = 1) as single_class, count(*) filter (classes > 1) as multi_class, (select count(distinct class_id) from composition) as total_classes from e")
def composition_summary(v: Views) -> DataFrame:
    """A10, A4."""
    return r6(co.composition_summary(v.composition()), "avg_classes", "avg_dominant_pct")


@query("also s as (select cluster_id, count(*) as size from assignments group by 1) select count(*) as n_clusters, max(size) as largest, min(size) as smallest, round(avg(size), 6) as mean_size, round(stddev_pop(size), 6) as std_size from s")
def cluster_sizes(v: Views) -> DataFrame:
    """A5."""
    return r6(co.cluster_size_stats(co.cluster_sizes(v.assignments())), "mean_size", "std_size")


_PUR = "pur as (select cluster_id, total::bigint as size, class_id as dominant_class, paper_count * 1.0 / total as purity from composition where rn = 1)"


@query(f"also {_PUR} select cluster_id, size, dominant_class, round(purity, 6) as purity from pur")
def purity(v: Views) -> DataFrame:
    """A7, A8, D17."""
    return longs(r6(co.purity(v.assignments()), "purity"), "cluster_id")


@query(f"also {_PUR} select round(avg(purity), 6) as mean_purity, round(stddev_pop(purity), 6) as std_purity, round(min(purity), 6) as min_purity, round(max(purity), 6) as max_purity, round(sum(purity * size) / sum(size), 6) as weighted_purity from pur")
def purity_summary(v: Views) -> DataFrame:
    """A9."""
    return r6(co.purity_summary(co.purity(v.assignments())), "mean_purity", "std_purity", "min_purity", "max_purity", "weighted_purity")


@query("select cluster_id, round(max(paper_count) * 100.0 / sum(paper_count), 6) as purity_pct from comp group by 1")
def purity_pct(v: Views) -> DataFrame:
    """A8b, M36."""
    return longs(r6(co.purity_percent(v.composition()), "purity_pct"), "cluster_id")


@query("select class_idx, cluster_id, count(*) as n, grouping_id(class_idx, cluster_id)::integer as margin from assignments group by cube(class_idx, cluster_id)")
def confusion_margins(v: Views) -> DataFrame:
    """A11, L11."""
    return longs(co.confusion_margins(v.assignments()), "cluster_id")


@query("also e as (select min(class_idx) as lo, max(class_idx) as hi from nodes) select least(floor((class_idx - lo) * 30.0 / (hi - lo)), 29)::integer as bin, count(*) as n from nodes, e group by 1")
def class_histogram(v: Views) -> DataFrame:
    """A29."""
    return co.histogram(v.nodes(), "class_idx")


_CT = "ct as (select class_idx as a, cluster_id as b, count(*)::double as n from assignments group by 1, 2), sa as (select a, sum(n) as n from ct group by 1), sb as (select b, sum(n) as n from ct group by 1), tot as (select sum(n) as t from ct)"


@query(f"also {_CT}, p as (select (select sum(n * (n - 1) / 2) from ct) as s, (select sum(n * (n - 1) / 2) from sa) as x, (select sum(n * (n - 1) / 2) from sb) as y, t * (t - 1) / 2 as m from tot) select round((s - x * y / m) / ((x + y) / 2 - x * y / m), 6) as ari from p")
def ari(v: Views) -> DataFrame:
    """A12, U3."""
    return r6(me.adjusted_rand(v.assignments()), "ari")


@query(f"also {_CT}, i as (select sum(ct.n / t * ln(ct.n * t / (sa.n * sb.n))) as mi from ct join sa using (a) join sb using (b), tot), h as (select (select -sum(n / t * ln(n / t)) from sa, tot) as ha, (select -sum(n / t * ln(n / t)) from sb, tot) as hb) select round(2 * mi / (ha + hb), 6) as nmi, round(mi / ha, 6) as homogeneity, round(mi / hb, 6) as completeness, round(2 * mi / (ha + hb), 6) as v_measure from i, h")
def information_scores(v: Views) -> DataFrame:
    """A13-A15, U3."""
    return r6(me.information_scores(v.assignments()), "nmi", "homogeneity", "completeness", "v_measure")


_SIL = "d as (select a.node_id as i, x.cluster_id as own, y.cluster_id as other, sum(list_distance(a.e, b.e)) as t, count(*) as n from emb a join assignments x on x.node_id = a.node_id, emb b join assignments y on y.node_id = b.node_id group by 1, 2, 3), ab as (select i, max(case when own = other then n end) as size, max(case when own = other and n > 1 then t / (n - 1) end) as a, min(case when own <> other then t / n end) as b from d group by 1), sil as (select i, case when size = 1 then 0 else (b - a) / greatest(a, b) end as s from ab)"


@query(f"also {_SIL} select round(avg(s), 6) as silhouette from sil")
def silhouette(v: Views) -> DataFrame:
    """A16."""
    return r6(me.silhouette(_with_clusters(v)), "silhouette")


@query("also n as (select count(*) as n from assignments), k as (select node_id, cluster_id, row_number() over (partition by cluster_id order by md5(node_id || ':42'), node_id) as rn, count(*) over (partition by cluster_id) as nc, n from assignments, n) select node_id, cluster_id from k where n <= 100 or rn <= greatest(1, floor(nc * 100.0 / n))")
def silhouette_sample(v: Views) -> DataFrame:
    """The sample that a silhouette of many rows uses."""
    return longs(me.proportional_sample(v.assignments().select("node_id", "cluster_id"), 100), "cluster_id")


_TOP3 = f"{_CATS}, t as (select cluster_id, class_id, paper_count, pct, total, rn, coalesce(category, 'Unknown_' || class_id) as cat, coalesce(full_name, 'Unknown_' || class_id) as name from composition left join cats using (class_id) where rn <= 3)"
_SLOTS = ", ".join(f"coalesce(max(cat) filter (rn = {k}), 'None') as top{k}_category, coalesce(max(name) filter (rn = {k}), 'None') as top{k}_full_name, coalesce(max(paper_count) filter (rn = {k}), 0)::bigint as top{k}_count, round(coalesce(max(pct) filter (rn = {k}), 0), 6) as top{k}_percentage" for k in (1, 2, 3))


@query(f"also {_TOP3} select cluster_id, max(total)::bigint as total_papers, {_SLOTS}, sum(paper_count)::bigint as top3_total_count, round(sum(pct), 6) as top3_total_percentage, (max(total) - sum(paper_count))::bigint as other_count, round((max(total) - sum(paper_count)) * 100.0 / max(total), 6) as other_percentage from t group by 1")
def top3_wide(v: Views) -> DataFrame:
    """W6, W9, D19."""
    wide = co.top3_wide(v.composition(), readers.default_categories(v.spark))
    return longs(r6(wide, *[f"top{k}_percentage" for k in (1, 2, 3)], "top3_total_percentage", "other_percentage"), "cluster_id")


@query(f"also {_TOP3} select cat as category, count(*) as appearances_in_top3 from t group by 1 order by 2 desc, 1 limit 15")
def category_frequency(v: Views) -> DataFrame:
    """A26, K15."""
    return co.category_frequency(co.top3_wide(v.composition(), readers.default_categories(v.spark)))


# eigenvalues and clustering

#: A rising series that both engines compute alike from a whole table: the shares of the classes, added up.
_GAPS = """shares as (select class_idx, sum(node_id)::bigint as s from nodes group by 1),
ev as (select 0::bigint as idx, 0::double as ev union all select row_number() over (order by class_idx), (sum(s) over (order by class_idx))::double / (select sum(s) from shares)::double from shares),
g0 as (select idx + 1 as k, ev, lead(ev) over (order by idx) - ev as gap, (lead(ev) over (order by idx) - ev) / (lead(ev) over (order by idx) + 1e-10) as rel from ev), g as (select * from g0 where gap is not null)"""


def _values(v: Views) -> DataFrame:
    """(idx, eigenvalue): what stands in for eigenvalues, one row a class."""
    shares = v.nodes().groupBy("class_idx").agg(F.sum("node_id").cast("long").alias("s"))
    rows, total = shares.orderBy("class_idx").select("s").toArrow().column("s").to_pylist(), 0
    values = [0.0]
    for s in rows:
        total += s
        values.append(float(total))
    return sp.eigenvalue_frame(v.spark, [x / values[-1] if x else 0.0 for x in values])


@query(f"also {_GAPS} select k::integer as k, round(ev, 6) as eigenvalue, round(gap, 6) as eigen_gap, round(rel, 6) as relative_gap, round(rel / nullif(lag(rel) over (order by k), 0), 6) as gap_ratio from g")
def eigen_gaps(v: Views) -> DataFrame:
    """W1-W3, D13."""
    return r6(sp.eigen_gaps(_values(v)), "eigenvalue", "eigen_gap", "relative_gap", "gap_ratio")


@query(f"also {_GAPS}, b as (select *, row_number() over (order by rel desc, k) as best from g) select k::integer as k, round(ev, 6) as eigenvalue, round(gap, 6) as eigen_gap, row_number() over (order by gap desc, k) as gap_rank, round(100 * cume_dist() over (order by gap), 6) as gap_percentile, best = 1 as is_optimal, best = 2 as is_second_choice, best = 3 as is_third_choice from b")
def eigen_gap_table(v: Views) -> DataFrame:
    """W4, W5, L4, L5, P12, D18."""
    return longs(r6(sp.eigen_gap_table(sp.eigen_gaps(_values(v))), "eigenvalue", "eigen_gap", "gap_percentile"), "gap_rank")


@query(f"""also {_GAPS}, best as (select k, gap, rel from g order by rel desc, k limit 1)
select best.k::integer as optimal_k, (select k from g order by gap desc, k limit 1)::integer as optimal_k_absolute, round(avg(g.gap), 6) as mean_gap, round(stddev_pop(g.gap), 6) as std_gap, (select count(*) from ev where ev < 1e-8) as n_zero,
round(best.gap / stddev_pop(g.gap), 6) as gap_significance, round(best.gap, 6) as largest_gap, round(max(g.rel), 6) as largest_relative_gap, round((select max(ev) filter (idx = 1) - max(ev) filter (idx = 0) from ev), 6) as spectral_gap,
round((select max(ev) filter (idx = 10) / max(ev) filter (idx = 1) from ev), 6) as eigenvalue_decay, round(max(g.rel) / stddev_pop(g.rel), 6) as relative_gap_significance, round(best.gap / avg(g.gap), 6) as largest_gap_ratio from g, best group by best.k, best.gap""")
def gap_statistics(v: Views) -> DataFrame:
    """A28, M24, M25."""
    values = _values(v)
    whole = longs(sp.gap_statistics(values, sp.eigen_gaps(values)), "n_zero")
    return r6(whole, *[c for c, t in whole.dtypes if t == "double"])


def _stars(v: Views, along: float = 0.0) -> DataFrame:
    """(i, j, w): each vector linked to a node of its class, and with ``along`` to the next of the class: a graph whose eigenvalues and clusters are known."""
    e = v.emb().where("class_idx is not null").select(F.col("node_id").alias("i"), (-1 - F.col("class_idx")).cast("long").alias("j"), F.lit(1.0).alias("w"))
    if along:
        following = F.lead("i").over(Window.partitionBy("j").orderBy("i"))
        e = e.unionByName(e.select("i", following.alias("j"), F.lit(along).alias("w")).where("j is not null"))
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def _named(labels: DataFrame) -> DataFrame:
    """(node_id, cluster): each cluster of vectors by its smallest one, as numbers of clusters are arbitrary."""
    rows = labels.where("node_id >= 0")
    return rows.join(rows.groupBy("cluster_id").agg(F.min("node_id").alias("cluster")), "cluster_id").select("node_id", "cluster")


_COMPONENTS = "select node_id, min(node_id) over (partition by class_idx) as cluster from emb where class_idx is not null"


@query("also c as (select count(distinct class_idx) as c, count(*) as n from emb where class_idx is not null) select way, i::integer as idx, case when i < c then 0.0 when i < n then 1.0 else 2.0 end::double as eigenvalue from c, range(20) r(i), (values ('dense'), ('iterated')) w(way) where i < n + c")
def eigen_known(v: Views) -> DataFrame:
    """A star has the eigenvalues 0, 1 for each leaf but one, and 2; both ways of computing them."""
    stars = scratch.staged(_stars(v), "stars")
    found = [sp.eigenvalue_frame(v.spark, sp.eigenpairs(stars, 20, dense=d)[0]).withColumn("way", F.lit(way)) for way, d in (("dense", sp.DENSE), ("iterated", 0))]
    return r6(found[0].unionByName(found[1]), "eigenvalue").select("way", "idx", "eigenvalue")


@query(f"also k as ({_COMPONENTS}) select 'rows by degree' as way, * from k union all select 'unit rows', * from k")
def spectral_known(v: Views) -> DataFrame:
    """The clusters of a graph of separate stars are its stars."""
    stars, k = scratch.staged(_stars(v), "stars"), v.emb().select("class_idx").dropna().distinct().count()
    by_degree, unit = (_named(sp.spectral_cluster(stars, k, row_normalise=r)) for r in (False, True))
    return by_degree.select(F.lit("rows by degree").alias("way"), "*").unionByName(unit.select(F.lit("unit rows").alias("way"), "*"))


@query(_COMPONENTS)
def multiview_known(v: Views) -> DataFrame:
    """Two views with the same separate parts are clustered into these."""
    k = v.emb().select("class_idx").dropna().distinct().count()
    return _named(sp.multiview_cluster(scratch.staged(_stars(v), "stars"), scratch.staged(_stars(v, 0.25), "stars"), k))


@query()
def eigen_gap_embeddings(v: Views) -> DataFrame:
    """Gaps of the vectors' kNN graph."""
    return pl.eigen_gap_analysis(pl.affinity(v.emb(), "knn", 20), 20)[0]


@query()
def spectral_features(v: Views) -> DataFrame:
    """M13."""
    return sp.spectral_features(pl.affinity(v.emb(), "knn", 20), 10)


@query()
def spectral_cluster(v: Views) -> DataFrame:
    """M8, M9, M11."""
    return pl.spectral_embeddings(v.emb(), 10, n_init=2)


@query()
def spectral_metrics(v: Views) -> DataFrame:
    """§3.1 to the end: clustering and its measures."""
    return pl.evaluate(pl.spectral_embeddings(v.emb(), 10, n_init=2), v.emb())


@query()
def minibatch_spectral(v: Views) -> DataFrame:
    """M12, M16, M20, M22."""
    return pl.minibatch_spectral(v.emb(), 10, graph_k=10, stratified_ratio=0.4, n_init=2)


@query()
def minibatch_citation(v: Views) -> DataFrame:
    """M12, M16, M18, M21, M22."""
    return pl.minibatch_citation(v.nodes(), v.edges(), 10, stratified_ratio=0.2, n_init=2)


@query()
def multiview(v: Views) -> DataFrame:
    """M14."""
    return pl.multiview(v.emb(), v.edges(), 10, k_neighbors=10, n_init=2)


@query()
def minibatch_multiview(v: Views) -> DataFrame:
    """M13-M22."""
    return pl.minibatch_multiview(v.emb(), v.edges(), 10, n_spectral_dims=10, graph_k=10, stratified_ratio=0.4, include_neighbors=False, n_init=2)


@query()
def citation_spectral(v: Views) -> DataFrame:
    """M6, M11."""
    return pl.citation_spectral(v.nodes(), v.edges(), 10, n_init=2)


@query()
def hybrid_cluster(v: Views) -> DataFrame:
    """§3.3: M7, M11."""
    return pl.hybrid(v.nodes(), v.edges(), v.emb(), 10, n_init=2)


@query()
def kmeans(v: Views) -> DataFrame:
    """M15."""
    return pl.kmeans_embeddings(v.emb(), 10, n_init=2)


@query()
def pca_plot(v: Views) -> DataFrame:
    """K13."""
    return ve.pca_2d(v.emb())


@query()
def tsne_plot(v: Views) -> DataFrame:
    """A picture of at most 2,000 vectors."""
    return ve.tsne_2d(v.emb())


@query("select node_id, class_idx, round(e[1], 5) as first_value, round(e[len(e)], 5) as last_value, len(e)::bigint as dim from emb")
def source_npy(v: Views) -> DataFrame:
    """Packed vectors written as one matrix and read back by blocks."""
    emb = v.emb()
    path = _local(_out(v, "npy") + ".npy")
    packed = emb.select("node_id", F.concat("embedding", F.array(F.col("node_id").cast("float"), F.col("class_idx").cast("float"))).alias("values"))
    writers.write_npy(packed, path, order="node_id")
    back = readers.read_packed(v.spark, path, dim=64, block_rows=128)
    return back.select(F.col("node_id").cast("long").alias("node_id"), F.col("class_idx").cast("int").alias("class_idx"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("last_value"), F.size("embedding").cast("long").alias("dim"))


@query("also d as (select count(*) as n from edges), k as (select source as node_id, count(*) as n_out from edges group by 1) select e.node_id, class_idx, round(e[1], 5) as first_value, coalesce(n_out, 0)::bigint as n_out, n::bigint as n_edges from emb e left join k on k.node_id = e.node_id, d")
def source_ogb(v: Views) -> DataFrame:
    """A raw node-property data set, written from the views and read back."""
    base, emb = _out(v, "ogb"), v.emb().orderBy("node_id")
    for name, lines in (("node-feat", emb.select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))), ("node-label", emb.select(F.col("class_idx").cast("string"))), ("edge", v.edges().select(F.concat_ws(",", "source", "target")))):
        lines.write.option("compression", "gzip").text(f"{base}/{name}.csv.gz")
    nodes, edges = readers.read_ogb(v.spark, base)
    out = edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("n_out"))
    total = edges.agg(F.count("*").alias("n_edges"))
    found = nodes.join(out, "node_id", "left").crossJoin(F.broadcast(total))
    return found.select("node_id", "class_idx", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), "n_edges")


# sinks, read back


@query("select node_id, class_idx from nodes")
def sink_csv(v: Views) -> DataFrame:
    """K2, S10."""
    path = _out(v, "csv")
    writers.write_csv(v.nodes().select("node_id", "class_idx"), path)
    return readers.read_csv(v.spark, path, "node_id bigint, class_idx int")


@query("select node_id, class_idx from nodes")
def sink_parquet_once(v: Views) -> DataFrame:
    """The second write does nothing."""
    path = _out(v, "once")
    writers.write_parquet_once(v.nodes().select("node_id", "class_idx"), path)
    writers.write_parquet_once(v.nodes().select("node_id", "class_idx").limit(1), path)
    return readers.read_parquet(v.spark, path)


@query("select node_id, class_idx, cluster_id from assignments")
def sink_json(v: Views) -> DataFrame:
    """K6, K7, X20, S3."""
    path = _out(v, "json")
    writers.write_json(v.assignments(), path)
    return readers.read_jsonl(v.spark, path, "node_id bigint, class_idx int, cluster_id bigint")


@query("select 0 as part, node_id as source, null::bigint as target, coalesce(title, '') as title from nodes union all select 1, source, target, null from (select distinct source, target from edges)")
def sink_graphml(v: Views) -> DataFrame:
    """K8: written as a file and read back."""
    path = _local(_out(v, "graphml") + ".graphml")
    writers.write_graphml(v.nodes(), v.edges(), path, ["title", "class_idx"])
    line = v.spark.read.text(f"file://{path}").where("value like '<node %' or value like '<edge %'")
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    node = F.col("value").startswith("<node ")
    found = line.select(F.when(node, 0).otherwise(1).alias("part"), F.when(node, part('<node id="([^"]*)"')).otherwise(part('source="([^"]*)"')).cast("long").alias("source"), F.when(~node, part('target="([^"]*)"')).cast("long").alias("target"), F.when(node, part('key="title">([^<]*)<')).alias("title"))
    return found.withColumn("title", F.replace(F.replace(F.replace("title", F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")))


_DIM = 64


@query("select node_id, " + ", ".join(f"round(e[{i + 1}], 6) as dim_{i}" for i in range(_DIM)) + " from emb")
def sink_wide_vectors(v: Views) -> DataFrame:
    """K4, K5, P10: all dimensions, written and read back."""
    path = _out(v, "wide")
    writers.write_csv(writers.wide_vectors(v.emb(), _DIM), path)
    back = readers.read_csv(v.spark, path, "node_id bigint, " + ", ".join(f"dim_{i} float" for i in range(_DIM)))
    return back.select("node_id", *[F.round(F.col(f"dim_{i}").cast("double"), 6).alias(f"dim_{i}") for i in range(_DIM)])


@query("select node_id, title from nodes")
def source_tsv(v: Views) -> DataFrame:
    """A table without a header, columns named by the schema."""
    path = _out(v, "tsv")
    v.nodes().select("node_id", "title").write.option("sep", "\t").csv(path)
    readers.exists(v.spark, path)
    return readers.read_csv(v.spark, path, "node_id bigint, title string", sep="\t", header=False)


@query("select node_id as source, class_idx as target, title from nodes")
def source_positional(v: Views) -> DataFrame:
    """Columns by position, whatever they are called."""
    path = _out(v, "positional")
    writers.write_csv(v.nodes().select(F.col("node_id").alias("a"), F.col("class_idx").alias("b"), "title"), path)
    return readers.read_positional(v.spark, path, ["source", "target"], schema="a bigint, b int, title string")


@query("select i::integer as class_id, 'category_' || i as category from range(40) t(i)")
def source_label_map(v: Views) -> DataFrame:
    """Made-up names where there is no file."""
    return readers.read_label_map(v.spark)


@query("select cluster_id, class_id, paper_count from comp")
def source_composition(v: Views) -> DataFrame:
    """S15, F8."""
    path = _out(v, "composition")
    writers.write_csv(v.composition(), path)
    return longs(readers.read_composition(v.spark, path), "cluster_id", "paper_count").select("cluster_id", F.col("class_id").cast("int").alias("class_id"), "paper_count")


@query("select * from (values (1, 'cs.LG'), (2, 'math.AG'), (3, 'hep-th'), (4, 'cs.AI')) t(id, category)")
def category_names(v: Views) -> DataFrame:
    """S17, X8."""
    rows = [(1, "arxiv cs lg"), (2, "Math AG"), (3, " hep-th "), (4, "cs.AI")]
    return v.spark.createDataFrame(rows, "id int, c string").select("id", readers.normal_category(F.col("c")).alias("category"))


@query("select try_cast(case when node_id % 5 = 0 then 'x' else cast(node_id as varchar) end as bigint) as number, coalesce(title, 'Missing title') as title, '' as authors, node_id from nodes")
def typed_nodes(v: Views) -> DataFrame:
    """Coerced numbers, defaults for nulls and missing columns, columns in order."""
    raw = v.nodes().select("node_id", F.when(F.col("node_id") % 5 == 0, "x").otherwise(F.col("node_id").cast("string")).alias("number"), "title")
    typed = re_.coerce(re_.require_columns(raw, ["node_id", "number"]), {"number": "bigint"})
    return re_.reorder(re_.fill_defaults(typed, {"title": "Missing title", "authors": ""}), ["number", "title", "authors"])


@query("select node_id, class_idx from nodes where node_id < 100")
def first_id_sample(v: Views) -> DataFrame:
    """The sample by number that is taken where no strata are wanted."""
    return sa.first_ids(v.nodes().select("node_id", "class_idx"), 100)


@query("also s as (select cluster_id, count(*) as size from assignments group by 1), m as (select count(*) as a, max(size) as b, min(size) as c from s) select 'n_clusters: ' || a as value from m union all select 'largest: ' || b from m union all select 'smallest: ' || c from m")
def summary_text(v: Views) -> DataFrame:
    """The numeric measures as text lines."""
    stats = co.cluster_size_stats(co.cluster_sizes(v.assignments())).select("n_clusters", "largest", "smallest", F.lit("text").alias("note"))
    return writers.summary_lines(stats)


@query("select node_id, round((e[1] + e[5]) / 2, 6) as first, round((e[2] + e[6]) / 2, 6) as second from emb")
def masked_pooling(v: Views) -> DataFrame:
    """The mean of the states whose mask is set."""
    states = F.array(*[F.transform(F.slice("embedding", 4 * k + 1, 2), lambda x: x.cast("double")) for k in range(3)])
    pooled = v.emb().select("node_id", vec.masked_mean(states, F.array(F.lit(1), F.lit(1), F.lit(0))).alias("m"))
    return pooled.select("node_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.get("m", F.lit(1)), 6).alias("second"))


def _out(v: Views, name: str) -> str:
    return f"{scratch.folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """The path of a file in the shared folder, for a writer that needs a mounted one; its folder is made."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path} is not a mounted path")
    rest = "/" + rest.lstrip("/")
    os.makedirs(os.path.dirname(rest), exist_ok=True)
    return rest
