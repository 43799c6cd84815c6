"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm import hnsw, licenses, linededup, mixing, pieces, quality, secrets, simhash, tokencounts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratings = _table(spark, sf_dir, "labels").select("doc_id", quality.grade().alias("grade"))
    return quality.score(docs, quality.train(docs, ratings))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's lines."""
    return tokencounts.count(_table(spark, sf_dir, "documents"), rule="most")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.kept_digests(docs, linededup.keep_bitmaps(docs))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_tokens, op3_secrets, op4_topk, op5_mix, op6_simhash, op7_pieces, op8_licenses, op9_lines, op10_embeddings, pipeline)
    return {f.__name__: f for f in own}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_LINES = r"""
with line as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from line),
often as (
  select key, max(doc_id) as last from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
told as (select keyed.*, often.key is not null and doc_id <> last as gone from keyed left join often using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from told group by doc_id"""

_MIX = rf"""
with sized as (
  select doc_id, source, {_WORDS} as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as w from r),
l as (
  select *, (sum(source_size) over () * 1.5e0
             - coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) * 2.0e0)
            / sum(w) over (o rows between current row and unbounded following) as level
  from w window o as (order by source_size / w, rank)),
f as (select level from l where level * w <= 2.0e0 * source_size order by source_size / w, rank limit 1),
t as (select source, source_size, least(2.0e0 * source_size, (select level from f) * w) as target from l),
p as (
  select doc_id, size, source_size, target,
         case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs,
         coalesce(sum(size) over (partition by sized.source order by key, doc_id, size
                                  rows between unbounded preceding and 1 preceding), 0) as before
  from sized join t on sized.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * source_size - before)) as bigint) as taken
from p"""

_TOPK = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select q.n, q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.n <> c.n)
select query_id, cast(row_number() over (partition by n order by score desc, vec_id nulls last) as integer) as rank, vec_id, score
from pair qualify rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": _TOPK, "op5_mix": _MIX, "op9_lines": _LINES}
