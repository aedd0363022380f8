"""The queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconspark.llm.archive import archive_round_trip
from reconspark.llm.collocations import collocations
from reconspark.llm.common import fold, table
from reconspark.llm.compression import compression_rules
from reconspark.llm.decontaminate import contaminated
from reconspark.llm.divergence import source_divergence
from reconspark.llm.language import identify, learn
from reconspark.llm.packing import pack
from reconspark.llm.prefix import compare_with_edits
from reconspark.llm.quality import learn_quality, score_quality
from reconspark.llm.simhash import near_duplicates
from reconspark.llm.substring import remove_repeats
from reconspark.llm.tokencount import count_tokens
from reconspark.llm.toxicity import learn_toxicity, score_toxicity


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, lanes=1, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_quality(docs, table(spark, sf_dir, "labels").where(~fold("doc_id", 5, 0)), sample=6000)
    scored = score_quality(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), least=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~fold("doc_id", 3, 1)))
    found = identify(docs.select("doc_id", "text"), prototypes, keep=["doc_id"])
    return found.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_edits(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").where(~fold("doc_id", 3, 1)), sample=8000)
    scored = score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), words=3, least=10, top=2000)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_substring": op4_substring,
        "op5_simhash": op5_simhash,
        "op6_decontamination": op6_decontamination,
        "op7_token_counts": op7_token_counts,
        "op8_language": op8_language,
        "op9_fingerprint": op9_fingerprint,
        "op10_toxicity": op10_toxicity,
        "op11_collocations": op11_collocations,
        "op12_divergence": op12_divergence,
        "op13_compression": op13_compression,
    }


#: A record per page; of equal payloads of at least 1000 bytes the largest page id is the response.
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
m as (select h, max(page_id) as top from p where strlen(h) >= 1000 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to
from p left join m on p.h = m.h"""

#: Windows of 50 words by their text; those that a smaller doc_id has too cover their words.
REPEATS_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (select doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as k from w, unnest(range(1, len(ws) - 48)) t(p)),
least as (select k, min(doc_id) as low from win group by k),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(p, p + 50)) as i from win join least using (k) where low < doc_id)),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)"""


#: Phrases by unnesting each piece with its two neighbours; products as 128-bit integers.
COLLOCATIONS_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
piece as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from piece),
g3 as (select lang, unnest(list_zip(ws, ws[2:], ws[3:])) as g from w),
f1 as (select lang, g[1] as phrase, count(*) as a from g3 where g[1] is not null group by all),
f2 as (select lang, concat(g[1], ' ', g[2]) as phrase, count(*) as a, any_value(g[1]) as w1, any_value(g[2]) as w2 from g3 where g[2] is not null group by all having count(*) >= 10),
f3 as (select lang, concat(g[1], ' ', g[2], ' ', g[3]) as phrase, count(*) as a, any_value(g[1]) as w1, any_value(g[2]) as w2, any_value(g[3]) as w3 from g3 where g[3] is not null group by all having count(*) >= 10),
n as (select lang, sum(a) as n from f1 group by lang),
longer as (select lang, max(a) as most, p from (select lang, a, unnest([concat(w1, ' ', w2), concat(w2, ' ', w3)]) as p from f3) group by lang, p),
cut as (select lang, phrase, a, 1 as k, w1 as p1, w2 as p2 from f2 where not exists (select 1 from longer where longer.lang = f2.lang and p = phrase and 100 * most >= 50 * a)
  union all select lang, phrase, a, 1, w1, concat(w2, ' ', w3) from f3 union all select lang, phrase, a, 2, concat(w1, ' ', w2), w3 from f3),
f as (select lang, phrase, a from f1 union all select lang, phrase, a from f2),
scored as (select cut.lang, cut.phrase, cut.a, x.a as l, y.a as r, (1000000::hugeint * cut.a * cut.a) // (x.a::hugeint * y.a) as score, k from cut join f x on x.lang = cut.lang and x.phrase = p1 join f y on y.lang = cut.lang and y.phrase = p2),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join n using (lang) where rank <= 2000"""

#: Every kept term of a language for every source of it, and sums over pairs of sources term by term.
DIVERGENCE_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
e as (select lang, source, regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from d),
df as (select lang, term from (select lang, unnest(list_distinct(ts)) as term from e) group by all having count(*) >= 30),
occ as (select lang, source, term, count(*) as n from (select lang, source, unnest(ts) as term from e) join df using (lang, term) group by all),
g as (select distinct lang, source from e),
v as (select lang, count(term) as v from (select distinct lang from g) left join df using (lang) group by lang),
cell as (select g.lang, g.source, df.term, coalesce(n, 0) as n from g join df using (lang) left join occ using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from cell join v using (lang)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * any_value(v)) as q from cell join v using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
term as (select lang, source, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
parts as (select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pairs left join sums using (lang, source, item) union all select lang, source, 'term', item, value from term),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op4_substring": REPEATS_SQL, "op11_collocations": COLLOCATIONS_SQL, "op12_divergence": DIVERGENCE_SQL}
