"""Queries over records, judgements and the planning of extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.text import WHITE, human_bytes, human_duration, sort_key, strip
from routescope.functions.vectors import finite
from routescope.operators import records as R
from routescope.sources.tables import PASS_ALL, PASS_PAPER, current, latest, table

PASSES = (PASS_ALL, PASS_PAPER)
PASS_LAYERS = {PASS_ALL: "attention", PASS_PAPER: "selected"}  # the second: see layer_selection
BATCH = 8


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "records"), ["text_id"], ["loaded_at"])


def current_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, doc_id, rel: the latest graded judgement of each pair; of several at one time the last loaded."""
    q = table(spark, folder, "qrels").where("rel is not null")
    return latest(q, ["query_id", "doc_id"], ["judged_at", "loaded_at", "rel"]).select("query_id", "doc_id", "rel")


def records_build(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("text_id"), R.document_text(F.col("source"), F.col("text")).alias("text"))
    item = F.col("item_id").cast("string")
    queries = table(spark, folder, "eval_items").select(F.lit("query").alias("kind"), F.when(F.col("item_id") % 2 == 0, item).otherwise(F.concat(F.lit("q"), item)).alias("text_id"), "text")
    rows = docs.unionByName(queries).select("kind", "text_id", F.md5("text").alias("text_md5"))
    out = R.numbered(rows, sort_key(F.col("text_id")), "ordinal", within=["kind"])
    return out.select("kind", "ordinal", "text_id", "text_md5", R.filename(F.col("kind"), F.col("ordinal")).alias("filename"))


def records_limit(spark: SparkSession, folder: str) -> DataFrame:
    return R.limited(current_records(spark, folder), 100, 20).select("kind", "ordinal", "text_id")


def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    r = current_records(spark, folder).where("text is not null")
    return r.select("text_id", "kind", R.prompt(F.col("kind"), F.col("text")).alias("prompt"))


def token_stand_in(spark: SparkSession, folder: str) -> DataFrame:
    """White-space tokens of the prompt, at most 512 (the extraction's length limit): the end of a long prompt is lost."""
    r = current_records(spark, folder).where("text is not null")
    words = F.slice(F.filter(F.split(strip(R.prompt(F.col("kind"), F.col("text"))), f"{WHITE}+"), lambda w: w != ""), 1, 512)
    return r.select("text_id", F.size(words).cast("bigint").alias("seq_len"), F.md5(F.concat_ws(" ", words)).alias("tokens_md5"))


def qrels_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that occur in the judgements, with the number of their judged documents known to the records."""
    r = current_records(spark, folder)
    judged = current_judgements(spark, folder)
    known = judged.join(r.where("kind = 'doc'").select(F.col("text_id").alias("doc_id")), "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("known"))
    q = r.where("kind = 'query'").select(F.col("text_id").alias("query_id")).join(judged, "query_id", "left_semi")
    return q.join(known, "query_id", "left").select("query_id", F.coalesce("known", F.lit(0)).cast("bigint").alias("known_docs"))


def judgements(spark: SparkSession, folder: str) -> DataFrame:
    return current_judgements(spark, folder)


def format_duration(spark: SparkSession, folder: str) -> DataFrame:
    """Time between writing and loading of every payload row, as printed."""
    p = table(spark, folder, "payloads").where("written_at is not null and loaded_at is not null")
    s = (F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("written_at").cast("timestamp"))) / 1e6
    return p.select("pass_name", "text_id", s.alias("seconds")).withColumn("printed", human_duration(F.col("seconds")))


def format_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each document's text, scaled up to reach every unit, as printed."""
    d = table(spark, folder, "documents").where("text is not null and doc_id is not null")
    n = F.octet_length("text").cast("bigint") * F.expr("cast(power(1024, doc_id % 5) as bigint)")
    return d.select("doc_id", n.alias("bytes")).withColumn("printed", human_bytes(F.col("bytes")))


VECTOR_FIELDS = ("hs_last_token", "hs_mean", "routing_full_last")
FLOAT_FIELDS = (*VECTOR_FIELDS, "routing_weights")


def finite_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Payload rows and layers whose floats, in any of the float columns, hold a NaN or an infinity."""
    p = table(spark, folder, "payloads").select("pass_name", "text_id", "written_at", "loaded_at", *FLOAT_FIELDS)
    per = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.transform(f, lambda t: F.flatten(t)) if f == "routing_weights" else F.col(f)).alias("layers")) for f in FLOAT_FIELDS])).alias("v")
    layers = p.select("pass_name", "text_id", "written_at", "loaded_at", per).select("pass_name", "text_id", "written_at", "loaded_at", F.col("v.field").alias("field"), F.posexplode("v.layers").alias("layer", "x"))
    return layers.where(~finite(F.col("x"))).select("pass_name", "text_id", "written_at", "loaded_at", "field", "layer")


def _done(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "payloads").select("pass_name", "text_id", "written_at", "loaded_at", *[F.col(f).isNotNull().alias(f) for f in VECTOR_FIELDS])
    return current(p).where(" and ".join(VECTOR_FIELDS)).select("text_id", "pass_name")


def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    out = R.batch_status(current_records(spark, folder).select("text_id", "kind", "ordinal"), _done(spark, folder), len(PASSES))
    return out.select("text_id", "kind", "ordinal", F.col("position").cast("bigint").alias("position"), F.col("outputs").cast("int").alias("outputs"), "status")


def reset_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The outputs to delete: those of records that some pass has and another lacks."""
    done = _done(spark, folder)
    return R.partial_outputs(batch_status(spark, folder), done).select("text_id", "pass_name")


def query_batches(spark: SparkSession, folder: str) -> DataFrame:
    return R.query_batches(batch_status(spark, folder).where("status <> 'skip'"), BATCH).select("kind", "ordinal", "text_id", "batch")


def pass_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with every pass: how the pass reroutes attention, in which layers, and the path of the output."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pass_name"), F.lit("self").alias("mode"), F.lit(layers).alias("layer_set")) for p, layers in PASS_LAYERS.items()])).alias("p")
    r = current_records(spark, folder).select("text_id", "filename", each).select("text_id", "filename", "p.*")
    return r.select("text_id", "pass_name", "mode", "layer_set", F.concat_ws("/", F.lit("embeddings"), "pass_name", "filename").alias("path"))


def cache_key(spark: SparkSession, folder: str) -> DataFrame:
    """Key of a pass's materialised representations: settings and a fingerprint of the rows they are made from."""
    p = table(spark, folder, "payloads").select("pass_name", "text_id", "written_at")
    stamp = F.md5(F.concat_ws("|", "text_id", F.unix_micros(F.col("written_at").cast("timestamp")).cast("string")))
    seen = p.groupBy("pass_name").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(stamp, 1, 8), 16, 10).cast("bigint")).alias("s"))
    key = F.concat_ws(",", F.lit("dense"), "pass_name", F.lit("doc"), F.lit("hs_mean"), F.col("n").cast("string"), F.col("s").cast("string"))
    return seen.select("pass_name", F.substring(F.sha1(key), 1, 16).alias("key"))


QUERIES = {f.__name__: f for f in (records_build, records_limit, prompt_text, token_stand_in, qrels_semi, judgements, format_duration, format_bytes, finite_violations, batch_status, reset_outputs, query_batches, pass_plan, cache_key)}

_REC = """with rec as (select * exclude (rk) from (select *, row_number() over (partition by text_id order by loaded_at desc) as rk from records where text_id is not null) where rk = 1)"""
_JUDGED = """jud as (select query_id, doc_id, rel from (select *, row_number() over (partition by query_id, doc_id order by judged_at desc nulls last, loaded_at desc nulls last, rel desc) as rk
  from qrels where rel is not null and query_id is not null and doc_id is not null) where rk = 1)"""
_DONE = """done as (select text_id, pass_name from (select pass_name, text_id, hs_last_token is not null and hs_mean is not null and routing_full_last is not null as ok,
  row_number() over (partition by pass_name, text_id order by written_at desc, loaded_at desc) as rk from payloads where text_id is not null) where rk = 1 and ok)"""
_STATUS = f"""{_REC}, {_DONE}, st as (select rec.text_id, kind, ordinal, cast(count(distinct pass_name) as int) as outputs from rec left join done on done.text_id = rec.text_id group by all),
ps as (select *, row_number() over (order by case kind when 'doc' then 0 else 1 end, ordinal) as position from st),
status as (select *, case when outputs >= 2 then 'skip' when outputs > 0 then 'reset' else 'new' end as status from ps)"""


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


ORACLE = {
    "records_build": f"""
with docs as (select 'doc' as kind, cast(doc_id as varchar) as text_id, {_strip_sql(_strip_sql("coalesce(source, '')") + " || '. ' || " + _strip_sql("coalesce(text, '')"))} as text from documents),
qs as (select 'query' as kind, case when item_id % 2 = 0 then cast(item_id as varchar) else 'q' || item_id end as text_id, text from eval_items),
u as (select * from docs union all select * from qs),
o as (select *, cast(row_number() over (partition by kind order by case when regexp_full_match(text_id, '[0-9]+') then 0 else 1 end, try_cast(text_id as decimal(38,0)), text_id) as int) as ordinal from u)
select kind, ordinal, text_id, md5(text) as text_md5, case when kind = 'doc' then printf('doc_%07d.npz', ordinal) else printf('query_%06d.npz', ordinal) end as filename from o""",
    "records_limit": f"{_REC} select kind, ordinal, text_id from rec where (kind = 'doc' and ordinal <= 100) or (kind = 'query' and ordinal <= 20)",
    "prompt_text": f"""{_REC} select text_id, kind, case when kind = 'doc' then 'Context' else 'Query' end || ': ' || text || chr(10) || 'Compress the ' ||
  case when kind = 'doc' then 'Context' else 'Query' end || ' in one word:' as prompt from rec where text is not null""",
    "token_stand_in": f"""{_REC}, p as (select text_id, case when kind = 'doc' then 'Context' else 'Query' end || ': ' || text || chr(10) || 'Compress the ' || case when kind = 'doc' then 'Context' else 'Query' end || ' in one word:' as text from rec where text is not null),
w as (select text_id, list_filter(regexp_split_to_array({_strip_sql('text')}, '{WHITE}+'), lambda x: x <> '')[1:512] as w from p)
select text_id, cast(len(w) as bigint) as seq_len, md5(array_to_string(w, ' ')) as tokens_md5 from w""",
    "qrels_semi": f"""{_REC}, {_JUDGED} select r.text_id as query_id, cast((select count(*) from jud j join rec d on d.text_id = j.doc_id and d.kind = 'doc' where j.query_id = r.text_id) as bigint) as known_docs
from rec r where kind = 'query' and text_id in (select query_id from jud)""",
    "judgements": f"with {_JUDGED} select * from jud",
    "format_duration": """
with s as (select pass_name, text_id, (epoch_us(loaded_at) - epoch_us(written_at)) / 1e6 as seconds from payloads where written_at is not null and loaded_at is not null)
select *, case when seconds < 60 then printf('%.1fs', seconds) when floor(seconds / 60) < 60 then printf('%dm %.0fs', cast(floor(seconds / 60) as bigint), seconds - floor(seconds / 60) * 60)
  else printf('%dh %dm', cast(floor(floor(seconds / 60) / 60) as bigint), cast(floor(seconds / 60) as bigint) % 60) end as printed from s""",
    "format_bytes": """
with b as (select doc_id, cast(strlen(text) as bigint) * cast(power(1024, doc_id % 5) as bigint) as bytes from documents where text is not null and doc_id is not null)
select *, case when bytes < 1024 then printf('%.2f B', cast(bytes as double)) when bytes < 1048576 then printf('%.2f KB', bytes / 1024.0::double) when bytes < 1073741824 then printf('%.2f MB', bytes / 1048576.0::double)
  when bytes < 1099511627776 then printf('%.2f GB', bytes / 1073741824.0::double) else printf('%.2f TB', bytes / 1099511627776.0::double) end as printed from b""",
    "finite_violations": " union all ".join(f"select pass_name, text_id, written_at, loaded_at, '{f}' as field, cast(layer as int) as layer from (select *, unnest({'list_transform(routing_weights, lambda t: flatten(t))' if f == 'routing_weights' else f}) as x, generate_subscripts({f}, 1) - 1 as layer from payloads) where x is null or len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) > 0" for f in FLOAT_FIELDS),
    "batch_status": f"{_STATUS} select text_id, kind, ordinal, position, outputs, status from status",
    "reset_outputs": f"{_STATUS} select done.text_id, done.pass_name from done join status on done.text_id = status.text_id where status = 'reset'",
    "query_batches": f"""{_STATUS}, pend as (select *, row_number() over (partition by kind order by ordinal) as rn from status where status <> 'skip')
select kind, ordinal, text_id, cast(case when kind = 'query' then (rn - 1) // 8 else rn - 1 end as int) as batch from pend""",
    "pass_plan": f"{_REC} select text_id, p as pass_name, 'self' as mode, case p when 'rerouted' then 'attention' else 'selected' end as layer_set, 'embeddings/' || p || '/' || filename as path from rec, (select unnest(['rerouted', 'paper_rerouted']) as p)",
    "cache_key": """
with s as (select pass_name, count(*) as n, sum(cast('0x' || substr(md5(text_id || '|' || epoch_us(written_at)), 1, 8) as bigint)) as s from payloads group by 1)
select pass_name, substr(sha1('dense,' || pass_name || ',doc,hs_mean,' || n || ',' || s), 1, 16) as key from s""",
}
