"""Every operator applied to the driver's tables, with the same result in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import classify, consensus, evaluate, geometry, identity, reconcile, stats
from reconspark.plans import known
from reconspark.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Parts of supplier names and what they stand for; fixed values of this example, least priority first.
DIMENSION = [(1, "00001", "north"), (2, "0000", "east"), (3, "9", "south")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


VOTE = f"""
with r as (select user_id, cast(ts as date) d, event_type v, count(*) n, min(event_id) f from events group by all),
k as (select *, row_number() over w rn, lead(n) over w nx, count(*) over p c, sum(n) over p t from r
  window p as (partition by user_id, d), w as (partition by user_id, d order by n desc, f)),
a as (select user_id, d, string_agg(v, '|' order by n desc, f) candidates from r group by all)
select user_id, cast(d as varchar) as day, case when c = 1 or (n >= 2 and n >= 2 * nx) then v end as value,
  case when c = 1 then case when n >= 2 then '{consensus.CONFIRMED}' else '{consensus.SINGLE}' end
    when n >= 2 and n >= 2 * nx then '{consensus.MAJORITY}' else '{consensus.DISPUTED}' end as status,
  candidates, cast(n as bigint) as agreement, cast(t as bigint) as attempts
from k join a using (user_id, d) where rn = 1"""


@query(VOTE)
def consensus_vote(t):
    reads = t("events").withColumn("day", F.to_date("ts").cast("string"))
    return consensus.consensus(reads, ["user_id", "day"], "event_type", "event_id").withColumn("candidates", F.array_join("candidates", "|"))


@query("""select user_id, cast(cast(ts as date) as varchar) as day, count(event_type) >= 2 and count(distinct event_type) = 1 as stable
from events group by user_id, cast(ts as date)""")
def stable_reading(t):
    return consensus.stable(t("events").withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"], "event_type")


@query("""with s as (select user_id, event_type, round(max(value) / 100, 6) as s from events group by all),
r as (select *, row_number() over w rn, lead(s) over w nx from s window w as (partition by user_id order by s desc, event_type))
select user_id, event_type from r where rn = 1 and s >= 0.65 and s - coalesce(nx, 0) >= 0.12 and event_type <> 'error'""")
def best_sample(t):
    samples = t("events").withColumn("score", F.col("value") / 100).groupBy("user_id", "event_type").agg(F.round(F.max("score"), 6).alias("score"))
    return consensus.best_sample(samples, ["user_id"], "event_type", "score", never="error")


@query("""with p as (select p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') c from part)
select a.p_partkey as left_key, b.p_partkey as right_key from p a join p b on b.p_partkey = a.p_partkey + 1
where least(length(a.c), length(b.c)) >= 4 and levenshtein(a.c, b.c)::double / greatest(length(a.c), length(b.c)) > 0.28""")
def name_mismatch(t):
    a = t("part").select(F.col("p_partkey").alias("left_key"), (F.col("p_partkey") + 1).alias("right_key"), F.col("p_name").alias("a"))
    b = t("part").select(F.col("p_partkey").alias("right_key"), F.col("p_name").alias("b"))
    return a.join(b, "right_key").where(X.different("a", "b")).select("left_key", "right_key")


@query("select doc_id, nullif(regexp_extract(text, '([0-9]{3})-?([0-9]{2})', 0), '') as code from documents")
def code_extract(t):
    return t("documents").select("doc_id", F.nullif(F.regexp_extract("text", "([0-9]{3})-?([0-9]{2})", 0), F.lit("")).alias("code"))


@query("select sha256(text) as digest, min(doc_id) as survivor, count(*) as copies from documents where text is not null group by 1")
def digest_dedup(t):
    return t("documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("survivor"), F.count("*").alias("copies"))


@query("""with d as (select doc_id, bool_or(doc_id % 7 = 0) over (partition by text) as named, min(doc_id) over (partition by text) as low from documents where text is not null)
select doc_id, named from d where not named or doc_id = low""")
def copies_dropped(t):
    files_ = t("documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"), (F.col("doc_id") % 7 == 0).alias("named"))
    return files.drop_copies(files_, order="doc_id", explicit="named").select("doc_id", "named")


@query(r"""select doc_id, md5(trim(regexp_replace(translate(upper(replace(coalesce(text, ''), 'ß', 'ss')), 'Ё–—', 'Е--'), '\s+', ' ', 'g'))) as normal_md5
from documents""")
def normalize_text(t):
    return t("documents").select("doc_id", F.md5(X.fold(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))).cast("binary")).alias("normal_md5"))


@query(r"select p_partkey, translate(trim(regexp_replace(upper(p_name), '\s+', ' ', 'g')), 'OLI', '011') as folded from part")
def confusable_fold(t):
    return t("part").select("p_partkey", X.digits("p_name").alias("folded"))


@query(r"""with p as (select page_id, regexp_extract(url, 'page=(\d+)', 1) n from pages)
select page_id, case when regexp_full_match(n, '[0-9]{1,4}') and try_cast(n as integer) between 1 and 1000 then try_cast(n as integer) end as number from p""")
def page_number(t):
    return t("pages").select("page_id", X.page_number(F.regexp_extract("url", "page=(\\d+)", 1)).alias("number"))


@query(r"""select doc_id, case when text like '% | %' then 'table' when regexp_matches(text, '!!') then 'shout' when regexp_matches(text, '\$\$\$|%%%|&&&') then 'junk'
when lang = 'en' then 'text' else 'foreign' end as kind from documents""")
def classify_document(t):
    rules = [(F.col("text").contains(" | "), "table"), (F.col("text").contains("!!"), "shout"), (F.col("text").rlike("\\$\\$\\$|%%%|&&&"), "junk"), (F.col("lang") == "en", "text")]
    return t("documents").select("doc_id", classify.cascade(rules, "foreign").alias("kind"))


@query("""with d(priority, pattern, name) as (values (1, '00001', 'north'), (2, '0000', 'east'), (3, '9', 'south')),
m as (select s_suppkey, name, row_number() over (partition by s_suppkey order by priority) r from supplier join d on contains(s_name, pattern))
select s_suppkey, coalesce(m.name, 'Не определено') as name from supplier left join (select * from m where r = 1) m using (s_suppkey)""")
def org_dimension(t):
    suppliers = t("supplier")
    dimension = suppliers.sparkSession.createDataFrame(DIMENSION, "priority int, pattern string, name string")
    return classify.by_dimension(suppliers, F.col("s_name"), dimension, ["s_suppkey"], X.UNKNOWN)


@query("select doc_id, cast(len(regexp_extract_all(lower(text), 'the|and|der|que')) * 25 + len(regexp_extract_all(lower(text), '[a-z]{4,}')) as bigint) as score from documents")
def keyword_score(t):
    return t("documents").select("doc_id", classify.keyword_score(F.lower("text"), "the|and|der|que", "[a-z]{4,}").alias("score"))


@query("""select doc_id, cast(i - 1 as bigint) as line_no, md5(l[i]) as line_md5 from (select doc_id, string_split(text, chr(10)) l from documents), unnest(range(1, len(l) + 1)) u(i)""")
def lines_explode(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(r"""with c as (select distinct unnest([regexp_extract(url, '//([^/]+)', 1), regexp_extract(url, '//[^/]+(/[^?#]*)', 1)]) as code from pages),
m as (select page_id, code, rank() over (partition by page_id order by length(code) desc) r, count(*) over (partition by page_id, length(code)) n
  from pages join c on length(code) > 0 and contains(url, code))
select page_id, code from m where r = 1 and n = 1""")
def longest_unique_match(t):
    pages = t("pages")
    codes = pages.select(F.explode(F.array(F.regexp_extract("url", "//([^/]+)", 1), F.regexp_extract("url", "//[^/]+(/[^?#]*)", 1))).alias("code"))
    return identity.longest_unique(pages, codes, "url", "code", ["page_id"])


@query(r"""with k as (select upper(regexp_replace(p_name, '\s+', '', 'g')) as key, p_name from part where p_name is not null group by all)
select key, max(p_name) as name from k group by key having count(*) = 1""")
def unique_key(t):
    return identity.unique_keys(t("part").select(F.col("p_name").alias("name")), "name")


@query("select l_orderkey, case when min(l_returnflag) = max(l_returnflag) then max(l_returnflag) end as l_returnflag, count(distinct l_returnflag) as n_distinct from lineitem group by 1")
def unique_or_null(t):
    return reconcile.unique_or_null(t("lineitem"), ["l_orderkey"], "l_returnflag")


@query("""with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber > 1 then l_linestatus end as flag from lineitem),
u as (select l_orderkey, case when min(flag) = max(flag) then max(flag) end as lone from v group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(flag, lone) as flag from v join u using (l_orderkey)""")
def group_propagate(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("flag"))
    return reconcile.propagate_unique(rows, "l_orderkey", "flag").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag")


@query("select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r from orders) where r = 1")
def first_wins(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return reconcile.first_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("select conv_id, string_agg(text, ' ' order by turn, text) as text from conversations group by 1")
def continuation_concat(t):
    return reconcile.concat_in_order(t("conversations"), ["conv_id"], "text", "turn")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def missing_volumes(t):
    urgent = t("orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return reconcile.missing(t("customer").select("c_custkey"), urgent, ["c_custkey"])


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def present_volumes(t):
    urgent = t("orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return reconcile.having(t("customer").select("c_custkey"), urgent, ["c_custkey"])


@query("""select o_orderpriority, count(*) filter (o_orderstatus is not null and l_linestatus is not null) as compared, count(*) filter (o_orderstatus = l_linestatus) as matched
from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def reconcile_counts(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return reconcile.compare(t("orders"), lines, ["o_orderkey"], F.col("o_orderstatus"), F.col("l_linestatus"), [F.col("o_orderpriority")])


@query("""with e as (select o_custkey, o_orderpriority, min(o_orderkey) f from orders group by all)
select o_custkey, string_agg(o_orderpriority, ' / ' order by f, o_orderpriority) as values from e group by 1 having count(*) > 1""".replace(" as values", ' as "values"'))
def distinct_conflict(t):
    return reconcile.distinct_conflict(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""select o_orderkey, exists (select 1 from orders f where f.o_orderstatus = 'F' and f.o_custkey = o.o_custkey and f.o_orderpriority = o.o_orderpriority) as contained from orders o""")
def set_containment(t):
    facts = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sets = t("orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderpriority").alias("member"))
    return reconcile.contained(facts, sets, ["o_custkey"], "o_orderpriority", "member").select("o_orderkey", "contained")


@query("""with k as (select distinct l_orderkey, l_returnflag from lineitem),
r as (select distinct o_orderkey as l_orderkey, case o_orderstatus when 'F' then 'R' when 'O' then 'N' else 'A' end as l_returnflag from orders),
g as (select l_orderkey, count(*) n, max(k.l_returnflag) only_one, count(r.l_orderkey) seen, max(r.l_returnflag) hit from k left join r using (l_orderkey, l_returnflag) group by 1)
select l_orderkey, case when n = 1 then only_one when seen = 1 then hit end as l_returnflag, case when n = 1 then 'only' when seen = 1 then 'matched' else 'skipped' end as outcome from g""")
def version_select(t):
    status = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    return reconcile.select_version(t("lineitem"), t("orders").select(F.col("o_orderkey").alias("l_orderkey"), status.alias("l_returnflag")), ["l_orderkey"], "l_returnflag")


@query("""with p as (select p_partkey, p_brand, p_size, p_name, split_part(p_name, ' ', 1) w from part)
select p_partkey, (select case when min(q.p_name) = max(q.p_name) then max(q.p_name) end from p q where q.p_brand = p.p_brand and q.p_size = p.p_size
  and starts_with(q.p_name, p.w) and length(q.p_name) > length(p.w)) as completed from p""")
def code_completion(t):
    rows = t("part").select("p_partkey", "p_brand", "p_size", "p_name")
    return identity.complete(rows, ["p_brand", "p_size"], F.substring_index("p_name", " ", 1), "p_name").select("p_partkey", "completed")


@query(r"""with p as (select o_orderkey, l_linenumber, 'KEY' || o_custkey a, 'KEY' || l_suppkey b from orders join lineitem on l_orderkey = o_orderkey)
select o_orderkey, l_linenumber from p where levenshtein(a, b)::double / greatest(length(a), length(b)) > 0.28 and least(length(a), length(b)) >= 4""")
def pair_mismatch(t):
    a = t("orders").select("o_orderkey", F.concat(F.lit("KEY"), F.col("o_custkey").cast("string")).alias("a"))
    b = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat(F.lit("KEY"), F.col("l_suppkey").cast("string")).alias("b"))
    return a.join(b, "o_orderkey").where(X.different("a", "b")).select("o_orderkey", "l_linenumber")


@query("""select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where r_regionkey < 3
union all select n_nationkey, r_name from nation, region where r_regionkey >= 3""")
def codeless_broadcast(t):
    findings = t("region").select(F.when(F.col("r_regionkey") < 3, F.col("r_regionkey")).alias("code"), "r_name")
    return reconcile.with_keyless(t("nation").select("n_nationkey", F.col("n_regionkey").alias("code")), findings, "code").select("n_nationkey", "r_name")


@query("""with b as (select user_id, event_id as band_id, ts as start_ts, lead(ts) over (partition by user_id order by ts, event_id) e from events where event_type = 'signup')
select b.user_id, band_id, count(*) as n from events v join b on b.user_id = v.user_id and v.ts >= start_ts and (e is null or v.ts < e) group by all""")
def band_join(t):
    starts = t("events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("band_id"), F.col("ts").alias("start_ts"))
    return geometry.last_start(t("events").select("user_id", "ts"), starts, ["user_id"], "ts", "start_ts", ["band_id"], "band_id").groupBy("user_id", "band_id").agg(F.count("*").alias("n"))


@query("""with m as (select a.event_id as label_id, b.event_id as value_id, abs(date_diff('microsecond', a.ts, b.ts)) d, row_number() over (partition by a.event_id order by abs(date_diff('microsecond', a.ts, b.ts)), b.event_id) r
  from events a join events b on a.user_id = b.user_id where a.event_type = 'purchase' and b.event_type = 'view')
select label_id, value_id, cast(d as bigint) as distance from m where r = 1""")
def nearest_label(t):
    labels = t("events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("at"))
    values = t("events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("value_id"), "ts")
    return geometry.nearest_in_time(labels, values, ["user_id"], "at", "ts", "value_id").select("label_id", "value_id", "distance")


@query("""with recursive s as (select user_id, date_diff('second', timestamp '2024-01-01', ts) x, row_number() over (partition by user_id order by ts, event_id) r from events),
f as (select user_id, r, x as kept, 1 as n from s where r = 1
  union all select s.user_id, s.r, case when s.x - f.kept > 86400 then s.x else f.kept end, f.n + case when s.x - f.kept > 86400 then 1 else 0 end from f join s on s.user_id = f.user_id and s.r = f.r + 1)
select user_id, cast(max(n) as bigint) as kept from f group by 1""")
def spacing_filter(t):
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(seconds)).alias("xs")).select("user_id", F.size(geometry.spaced(F.col("xs"), F.lit(86400).cast("long"))).cast("long").alias("kept"))


@query("""select l_suppkey, l_orderkey, l_linenumber, l_partkey, cast(r as int) as rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate) r from lineitem) where r <= 3""")
def topk_per_group(t):
    order = [F.desc("l_extendedprice"), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"))]
    return reconcile.top_k(t("lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("select l_returnflag, quantile_disc(l_extendedprice, 0.9) as quantile from lineitem group by 1")
def quantile_paper(t):
    return stats.quantile(t("lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@query("""with r as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity) r, count(*) over (partition by l_suppkey) n from lineitem where l_quantity is not null)
select l_suppkey, l_quantity as upper_median from r where r = n // 2 + 1""")
def upper_median(t):
    return stats.upper_median(t("lineitem"), ["l_suppkey"], "l_quantity")


@query("select p_brand, round(regr_slope(p_retailprice, p_size), 6) as slope from part group by 1")
def line_fit(t):
    return stats.line_fit(t("part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", F.round("slope", 6).alias("slope"))


@query("""with m as (select vec_id, label, list_transform(embedding, lambda x: x > 0) m from embeddings), b as (select label, arg_min(m, vec_id) b from m group by 1),
z as (select vec_id, list_zip(m, b) z from m join b using (label))
select vec_id, round(case when len(list_filter(z, lambda x: x[1] or x[2])) = 0 then 0 else len(list_filter(z, lambda x: x[1] and x[2]))::double / len(list_filter(z, lambda x: x[1] or x[2])) end, 6) as likeness from z""")
def mask_jaccard(t):
    masks = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x > 0).alias("m"))
    base = masks.groupBy("label").agg(F.min_by("m", "vec_id").alias("b"))
    return masks.join(base, "label").select("vec_id", F.round(stats.mask_likeness(F.col("m"), F.col("b")), 6).alias("likeness"))


@query(r"""with e as (select doc_id, list_distinct(regexp_extract_all(text, '([a-z]+)@[a-z]+', 1)) k from documents) select doc_id, cast(len(k) as bigint) as n_keys from e""")
def section_map(t):
    keys, names = (F.regexp_extract_all("text", F.lit("([a-z]+)@([a-z]+)"), F.lit(i)) for i in (1, 2))
    rows = F.arrays_zip(keys.alias("k"), names.alias("v"))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows) + 1), lambda s: s["k"] == r["k"]))
    return t("documents").select("doc_id", F.size(F.map_from_entries(last)).cast("long").alias("n_keys"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as int) as serial from orders")
def serial_date(t):
    return t("orders").select("o_orderkey", X.serial_of(F.to_date("o_orderdate")).alias("serial"))


@query("select o_orderkey, case when year(o_orderdate) between 2000 and 2199 then cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as int) end as serial from orders")
def date_text(t):
    return t("orders").select("o_orderkey", X.date_serial(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("serial"))


@query("""with w as (select conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') a, list_filter(string_split(replace(lead(text) over (partition by conv_id order by turn), chr(10), ' '), ' '), lambda x: x <> '') b from conversations)
select conv_id, turn, cast(coalesce(len(list_distinct(list_filter(b, lambda x: not list_contains(a, x)))), 0) as bigint) as n_new from w""")
def append_distinct(t):
    lines = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    following = F.lead("lines").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", lines.alias("lines")).withColumn("next", following)
    more = F.size(F.array_except(F.filter(F.split(F.coalesce("next", F.lit("")), "\n"), lambda v: v != ""), F.split("lines", "\n")))
    return rows.select("conv_id", "turn", more.cast("long").alias("n_new"))


QUALITY = """with p as (select l.doc_id, cast(l.quality as varchar) e, case when d.lang = 'en' then case when text like '% | %' or text like '%!!%' or text like '%$$$%' then '0' else '1' end else '' end a
  from labels l join documents d using (doc_id))"""


def _graded(t):
    guess = F.when(F.col("lang") == "en", F.when(F.col("text").contains(" | ") | F.col("text").contains("!!") | F.col("text").contains("$$$"), "0").otherwise("1")).otherwise("")
    return t("labels").join(t("documents").select("doc_id", guess.alias("actual")), "doc_id")


@query(QUALITY + f"select case when e = a then '{evaluate.CORRECT}' when a = '' then '{evaluate.MISSING}' else '{evaluate.WRONG}' end as status, count(*) as n from p group by 1")
def quality_eval(t):
    return _graded(t).groupBy(evaluate.field_status(F.col("quality").cast("string"), F.col("actual")).alias("status")).agg(F.count("*").alias("n"))


@query("""with r as (select case when doc_id % 2 = 0 then 'after' else 'before' end run, quality, toxic from labels),
m as (select run, count(*)::double images, count(*) filter (quality = 1)::double good, count(*) filter (toxic = 1)::double toxic from r group by 1),
u as (unpivot m on images, good, toxic into name measure value v)
select measure, max(v) filter (run = 'before') as before, max(v) filter (run = 'after') as after, max(v) filter (run = 'after') - max(v) filter (run = 'before') as change from u group by 1""")
def before_after(t):
    runs = t("labels").groupBy(F.when(F.col("doc_id") % 2 == 0, "after").otherwise("before").alias("run")).agg(F.count("*").alias("images"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return evaluate.compare_runs(runs, "run", ["images", "good", "toxic"])


@query("select doc_id, n_chars + 1 as n_chars from documents where lang = 'de' union all select doc_id, n_chars from documents where lang <> 'de' or lang is null")
def recheck_merge(t):
    old = t("documents").select("doc_id", "n_chars")
    return reconcile.replace_subset(old, t("documents").where("lang = 'de'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), ["doc_id"])


@query("select event_id, date_diff('microsecond', ts, lead(ts) over (partition by user_id order by ts, event_id)) as micros from events")
def stage_timing(t):
    return stats.step_times(t("events"), ["user_id"], "ts", "event_id").select("event_id", "micros")


@query()
def row_cluster(t):
    """A fold with moving means; held against brute force in the tests."""
    w = t("events").select("user_id", F.col("event_type").alias("text"), F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double").alias("x"), F.col("value").alias("y"), F.lit(1.0).alias("width"), F.lit(8.0).alias("height"))
    return geometry.cluster_rows(w, ["user_id"])


@query("""select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 else 4 end as int) as severity
from orders order by severity, o_orderkey""")
def severity_sort(t):
    return t("orders").select("o_orderkey", reconcile.severity(F.col("o_orderpriority"), PRIORITIES).alias("severity")).orderBy("severity", "o_orderkey")


@query("select s_suppkey, regexp_full_match(regexp_extract(s_name, '^([A-Za-z]+)', 1), '[A-Za-z][A-Za-z -]*') as valid from supplier")
def surname_valid(t):
    return t("supplier").select("s_suppkey", X.valid_surname(F.regexp_extract("s_name", "^([A-Za-z]+)", 1)).alias("valid"))


@query(r"""select p_partkey, lpad(upper(to_hex(p_partkey * 7919 % 4294967296)), 8, '0') as sum from part""".replace(" as sum", ' as "sum"'))
def checksum_pad(t):
    return t("part").select("p_partkey", X.crc(F.concat(F.lit("CRC32: "), X.pad8(F.hex(F.col("p_partkey") * 7919 % 4294967296)))).alias("sum"))


FINDINGS = """with l as (select l_orderkey, count(distinct l_linestatus) n, string_agg(distinct l_linestatus, ' / ' order by l_linestatus) s, count(*) c, min(l_linenumber) m from lineitem group by 1),
f as (
select 'Проверить' as level, o_orderkey as code, 'status conflict' as topic, s as detail from orders join l on l_orderkey = o_orderkey where n > 1
union select 'Расхождение', o_orderkey, 'status mismatch', o_orderstatus || ' / ' || s from orders join l on l_orderkey = o_orderkey where n = 1 and o_orderstatus <> 'P' and o_orderstatus <> s
union select 'Проверить', o_orderkey, 'no lines', '' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
union select 'Наблюдение', o_orderkey, 'first line missing', cast(m as varchar) from orders join l on l_orderkey = o_orderkey where m > 1)
"""


def _findings(t):
    by = t("lineitem").groupBy(F.col("l_orderkey").alias("code")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("s"), F.min("l_linenumber").alias("m"))
    orders = t("orders").select(F.col("o_orderkey").alias("code"), "o_orderstatus")
    both = orders.join(by, "code")
    row = lambda df, level, topic, detail: df.select(F.lit(level).alias("level"), "code", F.lit(topic).alias("topic"), detail.alias("detail"))
    lone = both.where((F.size("s") == 1) & (F.col("o_orderstatus") != "P") & (F.col("o_orderstatus") != F.get("s", F.lit(0))))
    return reconcile.union_findings([
        row(both.where(F.size("s") > 1), "Проверить", "status conflict", F.array_join("s", " / ")),
        row(lone, "Расхождение", "status mismatch", F.concat_ws(" / ", "o_orderstatus", F.get("s", F.lit(0)))),
        row(reconcile.missing(orders, by, ["code"]), "Проверить", "no lines", F.lit("")),
        row(both.where("m > 1"), "Наблюдение", "first line missing", F.col("m").cast("string")),
    ])


@query(FINDINGS + "select level, code, topic, detail from f")
def findings_union(t):
    return _findings(t)


@query(FINDINGS + "select level, topic, count(*) as findings, count(distinct code) as documents from f group by 1, 2")
def summary_metrics(t):
    return _findings(t).groupBy("level", "topic").agg(F.count("*").alias("findings"), F.count_distinct("code").alias("documents"))


for _made, _sql in known.QUERIES.values():
    query(_sql)(_made)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rule_findings"](spark, sf_dir)
