"""One query for each operator of this package, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its URL names; bad is low quality or toxic."""
    from paperloom.llm.url_templates import document_number, url_filter

    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    found = url_filter(table(spark, sf_dir, "pages"), labels, label_key=document_number("url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.quality_gam import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=~held_out("_id"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.exact_dedup import exact_dedup, normalised

    return exact_dedup(table(spark, sf_dir, "documents"), text_sha256=F.sha2(normalised("text"), 256))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.html_consensus import extract_main

    return extract_main(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length and hash after the repeated lines went."""
    from paperloom.llm.line_dedup import dedup_lines

    left = dedup_lines(table(spark, sf_dir, "documents"), count="n_removed")
    return left.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.secret_forest import find_secrets, redact

    found = find_secrets(table(spark, sf_dir, "documents"), path="source")
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), F.array_join(F.transform(secrets, lambda f: F.concat_ws(":", f["at"].cast("string"), F.length(f["value"]).cast("string"))), ",").alias("places"), F.sha2(redact(F.col("text"), F.col("findings")), 256).alias("redacted_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_embedding_dedup, op3_bpe, op4_quality, op5_packing, op6_exact_dedup, op7_html, op8_line_dedup, op9_jaccard, op10_secrets)}

SQL = {
    "op2_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a, count(*) as n from l group by a),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) as c from r group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, vec_id)::bigint as component_id, vec_id = coalesce(c.c, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
""",
    "op6_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
""",
    "op8_line_dedup": r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from documents),
m as (select *, trim(regexp_replace(lower(line), '[ \t\x0B\f\r]+', ' ', 'g')) as n from l),
u as (select n, min((doc_id, k)) as place from m where n <> '' group by n),
w as (select * from u where length(n) >= 16),
v as (select n, place, hash(n) as h from w union all select n, place, unnest(list_transform(range(1, length(n) + 1), lambda i: hash(n[1:i - 1] || n[i + 1:]))) from w),
near as (select distinct a.n from v a join v b on a.h = b.h and b.place < a.place where levenshtein(a.n, b.n) <= 1),
x as (select m.*, coalesce(u.place <> (m.doc_id, m.k), false) or near.n is not null as gone from m left join u on m.n = u.n left join near on m.n = near.n),
t as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by k) filter (not gone), '') as t from x group by doc_id)
select doc_id, n_removed, length(t) as n_chars_left, sha256(t) as text_sha256 from t
""",
    "op9_jaccard": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
c as (select a, count(*) as k from l group by a),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
h as (select a, least(a, min(b)) as h from r group by a)
select doc_id, coalesce(h, doc_id)::bigint as component_id, coalesce(k, 0)::bigint as n_links, doc_id = coalesce(h, doc_id) as kept from documents left join c on c.a = doc_id left join h on h.a = doc_id
""",
}
