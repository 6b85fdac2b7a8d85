"""Registered queries of the training-data operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_code
from . import centroids, decontam, hard_negatives, harmonic, html_text, neighbours, packing, quality, sharding, simhash, token_count, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


WARC_SQL = """with p as (select page_id, coalesce(html,'') h from pages), d as (select page_id, octet_length(encode(h)) n, sha256(h) s from p),
 f as (select s, min(page_id) first, count(*) c from d where n>=100 group by s having count(*)>1)
 select d.page_id, cast(n as bigint) payload_bytes, d.s payload_digest, case when f.first is not null and d.page_id is distinct from f.first then 'revisit' else 'response' end record_type,
 case when d.page_id is distinct from f.first then f.first end refers_to from d left join f on d.s=f.s"""


@query("op2_warc_round_trip", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op3_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


# The checksum byte by byte, the jumps one by one.
SHARD_SQL = """with recursive tab as (select list(v order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) v from (select unnest(range(256)) i))),
 b as (select doc_id, encode(coalesce(text,'')) e from documents),
 h as (select doc_id, cast(octet_length(e) as bigint)+1 size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(e), '..'), lambda x: cast(concat('0x', x) as bigint))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) text_crc32 from b, tab),
 j as (select doc_id, cast(coalesce(doc_id,0) as uhugeint) k, cast(-1 as bigint) b, cast(0 as bigint) j, 0 n from (select distinct doc_id from documents)
  union all select doc_id, nk, j, cast(floor((j+1)*(2147483648.0e0/cast(cast(nk // 8589934592 as bigint)+1 as double))) as bigint), n+1 from (select *, (k*2862933555777941757+1) % 18446744073709551616::uhugeint nk from j where j < 9)),
 s as (select doc_id, cast(max(j) filter (j<8) as int) shard, cast(max(j) filter (j<9) as int) grown_shard from j group by doc_id)
select h.doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by h.doc_id, text_crc32, size)-1 slot, grown_shard from h join s on h.doc_id is not distinct from s.doc_id"""


@query("op6_jump_sharding", SHARD_SQL)
def jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op7_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


DECONTAM_SQL = r"""with w as (select doc_id, cast(row_number() over () as bigint) r, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
 b as (select item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where text is not null and item_id is not null),
 p as (select distinct item_id, least(len(ws),13) n, array_to_string(list_slice(ws, i, i+12), ' ') win from (select item_id, ws, unnest(range(1, greatest(2, len(ws)-11))) i from b where len(ws)>0)),
 lens as (select distinct n from p),
 d as (select r, n, i, array_to_string(list_slice(ws, i, i+n-1), ' ') win from (select r, ws, n, unnest(range(1, len(ws)-n+2)) i from w, lens where len(ws)>=n)),
 m as (select d.r, d.i, d.n, p.item_id from d join p on d.win=p.win and d.n=p.n),
 hit as (select r, count(distinct k) n_hit from (select r, unnest(range(i, i+n)) k from m) group by r),
 it as (select r, count(*) n_items, array_to_string(list_sort(list(cast(item_id as varchar))), ',') s from (select distinct r, item_id from m) group by r)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit,0) as bigint) n_hit, cast(coalesce(n_items,0) as bigint) n_items, sha256(coalesce(s,'')) items_sha256,
 coalesce(n_hit,0)>0 and 20*coalesce(n_hit,0)>=len(ws) contaminated from w left join hit using (r) left join it using (r)"""


@query("op8_benchmark_decontamination", DECONTAM_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_weak_label_quality")
def weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label+1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) v from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
 s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]*z[2])) as bigint) score from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
 p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as int) rank, s.vec_id negative_id, positive_score, s.score negative_score
 from p join s on s.anchor_id = p.anchor_id and not same and 80*positive_score <= 100*s.score and s.score <= positive_score
 window w as (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 5"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query("op12_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, sf_dir, "documents"))


def _rounds_sql() -> str:
    """Assignment and means written out round by round."""
    near = """a{n} as (select v.vec_id, v, arg_min(c, (d, c)) c, min(d) d from (select v.vec_id, v.v, c.c, cast(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))) as bigint) d from v, c{n} c) v group by all)"""
    mean = """m{n} as (select c, i, cast(sum(x) as hugeint) s, count(*) k from (select c, unnest(v) x, unnest(range(len(v))) i from a{p}) group by c, i),
 c{n} as (select o.c, coalesce(m.v, o.v) v from c{p} o left join (select c, list(cast((s - ((s % k) + k) % k) // k as bigint) order by i) v from m{n} group by c) m on m.c = o.c)"""
    steps = [near.format(n=0)]
    for n in range(1, 4):
        steps += [mean.format(n=n, p=n - 1), near.format(n=n)]
    return f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64*cast(x as double)) as bigint)) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
 c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 c, v from v where vec_id is not null order by c limit 16),
 {", ".join(steps)}
select a.vec_id, cast(a.c as int) "cluster", d distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c3.v, ',')) centroid_sha256
 from a3 a join c3 on c3.c = a.c"""


@query("op13_ptolemaic_centroids", _rounds_sql())
def ptolemaic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
