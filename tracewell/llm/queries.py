"""Queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import conversations, hard_negatives, hnsw, jaccard, langid, lm, mih, mixing, packing, pii, secret_scan, suffix_dedup, toxicity
from tracewell.llm import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Whether a document lies in the held-out fold; one without id doesn't."""
    return F.coalesce(tx.fold("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select("doc_id", held_out(5, 0), "score", "predicted", "n_sentences", "offending")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns), turns)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    digest = F.sha2(secret_scan.joined(of(*secret_scan.BASE_KINDS)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.joined(F.col("spans")).alias("spans"), F.transform("spans", lambda x: x["bits"]).alias("bits"))


QUERIES = {"op1_pii": op1_pii, "op2_mih": op2_mih, "op3_packing": op3_packing, "op6_suffix_dedup": op6_suffix_dedup, "op7_mixing": op7_mixing, "op8_jaccard_join": op8_jaccard_join, "op9_embedding_dedup": op9_embedding_dedup, "op10_lm": op10_lm, "op4_toxicity": op4_toxicity, "op5_language": op5_language, "op11_repair": op11_repair, "op12_hard_negatives": op12_hard_negatives, "op13_secrets": op13_secrets}

HARD_NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
ranked as (
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
    other_id as negative_id, positive_score, score as negative_score
  from positives join pairs using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10
"""

EMBEDDING_DEDUP_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reached as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reached r join links l on l.a = r.b),
counts as (select a, count(*) as n from links group by a), least as (select a, min(b) as c from reached group by a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from embeddings left join counts on counts.a = vec_id join least on least.a = vec_id
"""


def _repair_sql() -> str:
    """The edits' dynamic program from the last row of each conversation to its first; costs, audits and lines by state."""

    def step(edit: str, cost: str, state: int, line: str = "") -> str:
        rest = f"list_prepend({line}, s{state}.r)" if line else f"s{state}.r"
        return f"{{'c': {cost} + s{state}.c, 'a': '{edit}' || s{state}.a, 'r': {rest}}}"

    def over_row(state: int) -> str:
        made, role = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[state]
        kept = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
        line = "role || ':' || txt"
        ways = [step("K", f"case when left(role, 1) = '{c}' then more else 1000000 end", to, line) for c, to in kept] + [step("R", "1 + more", made, f"'{role}:' || txt")]
        delete = step("D", "2", state)
        return f"case when fault in (1, 2) then {delete} else list_min([{delete}, {', '.join(ways)}]) end as s{state}"

    def inserted(state: int) -> str:
        first, then = ("user:", "assistant:") if state != 2 else ("assistant:", "user:")
        one, two = (2, 3) if state != 2 else (3, 2)
        a = f"{{'c': 5 + s{one}.c, 'a': 'I' || s{one}.a, 'r': list_prepend('{first}', s{one}.r)}}"
        b = f"{{'c': 10 + s{two}.c, 'a': 'II' || s{two}.a, 'r': list_prepend('{first}', list_prepend('{then}', s{two}.r))}}"
        return f"list_min([s{state}, {a}, {b}]) as s{state}"

    ends = ((0, "", "[]::varchar[]"), (10, "II", "['user:', 'assistant:']"), (5, "I", "['assistant:']"), (0, "", "[]::varchar[]"))
    states = ", ".join(f"{{'c': {c}::bigint, 'a': '{a}', 'r': {r}}} as s{q}" for q, (c, a, r) in enumerate(ends))
    return rf"""
with recursive crcs as (
  select list(crc order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as crc from range(256) as r(i))),
numbered as (
  select *, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as codes from conversations),
kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt,
    xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from numbered, crcs),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(txt, '.!?', '') else txt end as txt, unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from kinds where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(txt), copy) as i from damaged),
judged as (
  select *, case when not regexp_matches(txt, '[^ 	-
]') then 1
      when row_number() over (partition by conv_id, role, txt order by i) > 1 then 2
      when not regexp_matches(txt, '[.!?][ 	-
]*\z') then 3 else 0 end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed),
sized as (select *, case when fault = 3 then 5 else 0 end as more from judged),
states as (
  select conv_id, count(*) as i, {states} from sized group by conv_id
  union all
  select conv_id, i, {", ".join(inserted(q) for q in range(4))} from (
    select p.conv_id, p.i - 1 as i, {", ".join(over_row(q) for q in range(4))}
    from states as p join sized as d on d.i = p.i and d.conv_id is not distinct from p.conv_id)),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
    count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from sized group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(s0.c, 0) as cost, coalesce(s0.a, '') as audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) as o
left join counts as c on c.conv_id is not distinct from o.conv_id
left join states as s on s.conv_id is not distinct from o.conv_id and s.i = 0
"""


ORACLE_SQL: dict[str, str] = {"op9_embedding_dedup": EMBEDDING_DEDUP_SQL, "op11_repair": _repair_sql(), "op12_hard_negatives": HARD_NEGATIVES_SQL}
