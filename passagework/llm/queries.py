"""Registered queries of the corpus operators. ``QUERIES[name] = (function(spark, sf_dir), sql)``.

Each reads its whole table and returns the full result of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import byte_bpe, page_text, quality, secrets
from passagework.llm.anchored_runs import runs
from passagework.llm.chat_format import INSTRUCTIONS, format_turns, read_back
from passagework.llm.embedding_dedup import near_duplicates
from passagework.llm.exact_dedup import mark_copies
from passagework.llm.hard_negatives import mine
from passagework.llm.jaccard_join import similar
from passagework.llm.packing import pack
from passagework.llm.paragraph_dedup import repeats
from passagework.llm.passages import passages
from passagework.llm.sharding import assign
from passagework.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@register("op1_exact_dedup", r"""with digests as (select doc_id,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
        from documents)
    select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = min(doc_id) over same as kept, text_sha256
    from digests window same as (partition by text_sha256)""")
def exact_dedup(spark, sf):
    return mark_copies(table(spark, sf, "documents"))


@register("op2_sharding")
def sharding(spark, sf):
    placed = assign(table(spark, sf, "documents"), "doc_id", shards=[f"shard-{i:03}" for i in range(100)])
    return placed.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


@register("op3_quality")
def quality_scores(spark, sf):
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op4_jaccard_join", r"""with recursive words as (select doc_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        end as s from words),
    members as (select doc_id, len(s) as n, hash(unnest(s)) as gram from sets),
    links as (select a.doc_id as a, b.doc_id as b from members a join members b on a.gram = b.gram
        and a.doc_id <> b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
        group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach as (select doc_id as node, doc_id as root from documents
        union select l.b, r.root from reach r join links l on l.a = r.node)
    select doc_id, len(s) as n_shingles, least as component_id from sets
    join (select node, min(root) as least from reach group by node) on doc_id = node""")
def jaccard_join(spark, sf):
    return similar(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op5_secret_scans")
def secret_scans(spark, sf):
    def of(*kinds: str):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    base = secrets.KINDS[:3]
    return secrets.scan(table(spark, sf, "documents")).select(
        "doc_id", *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(secrets.listed(of(*base)), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"))


@register("op6_page_text")
def page_texts(spark, sf):
    return page_text.extract(table(spark, sf, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op7_packing")
def packing(spark, sf):
    pieces = pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")


@register("op8_paragraph_dedup")
def paragraph_dedup(spark, sf):
    """Lines that repeat nearly or exactly, and runs of words that repeat inside or across lines."""
    docs = table(spark, sf, "documents")
    lines = repeats(docs).withColumn("kind", F.lit("line"))
    return lines.unionByName(runs(docs).withColumn("kind", F.lit("run")), allowMissingColumns=True)


@register("op8_passage_dedup")
def passage_dedup(spark, sf):
    return passages(table(spark, sf, "documents"))


@register("op9_embedding_dedup", """with recursive valid as (select vec_id, label, embedding from embeddings
        where label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    units as (select vec_id, label, cast(embedding as double[]) as v from valid),
    links as (select a.vec_id as a, b.vec_id as b from units a join units b
        on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
        where list_cosine_similarity(a.v, b.v) >= 0.98),
    reach as (select vec_id as node, vec_id as root from embeddings
        union select l.b, r.root from reach r join links l on l.a = r.node),
    counts as (select a, count(*) as n from links group by a)
    select vec_id, coalesce(n, 0) as n_links, least as component_id, vec_id = least as kept
    from (select node, min(root) as least from reach group by node) join embeddings on vec_id = node
    left join counts on a = vec_id""")
def embedding_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"))


@register("op10_byte_bpe")
def byte_pairs(spark, sf):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, sf, "documents").select("doc_id", byte_bpe.encode(F.col("text"), *vocabulary).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode(F.col("ids"), *vocabulary), 256).alias("decoded_sha256"))


@register("op11_whitening")
def whitening(spark, sf):
    return whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@register("op12_hard_negatives", """with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as double)) as x from embeddings
        where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    scores as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_inner_product(a.x, b.x) as bigint) as score
        from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
    positives as (select anchor_id, other_id as positive_id, score as positive_score from scores where same
        qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
    negatives as (select p.*, other_id as negative_id, score as negative_score, row_number() over (
        partition by p.anchor_id, positive_id order by score desc, other_id) as rank
        from positives p join scores s on s.anchor_id = p.anchor_id and not same
        and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
    select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
    from negatives where rank <= 3""")
def hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def _escaped_length(x: str) -> str:
    """Each escape character and each mark costs one character more; no mark begins another or overlaps itself."""
    found = [f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in ["\\", *INSTRUCTIONS.marks]]
    return f"(length({x}) + {' + '.join(found)})"


def _formatted_length() -> str:
    known = " ".join(f"when '{role}' then {len(turn.before + turn.after)}" for role, turn in INSTRUCTIONS.turns.items())
    marks = len("".join(INSTRUCTIONS.other))
    return f"{_escaped_length('text')} + case role {known} else {marks} + {_escaped_length('role')} end"


#: A conversation whose texts hold control strings.
STRICT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op13_chat_format", f"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
        from (select conv_id, turn, role, text from conversations union all select * from (values {", ".join(map(str, STRICT))}))),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as place from turns)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
        cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
        sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by place)) as loss_sha256,
        cast(sum({_formatted_length()}) as bigint) as formatted_chars
    from placed group by conv_id""")
def chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    strict = spark.createDataFrame(STRICT, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(strict))).drop("valid", "first_broken")


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf.rstrip("/"))
