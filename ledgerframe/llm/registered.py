"""The operators' queries over the given tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import byte_bpe, fingerprints, html_extraction, language_id, near_dedup, packing, prefix_trie, quality_rules, sharding, suffix_dedup, token_counts, url_filter, whitening
from ledgerframe.session import fresh_path, materialize

URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]
#: Words of host names that put a host of the corpus on the block list.
BLOCKED_WORDS = ["adult", "casino", "malware", "phish", "porn", "spam"]
TOKEN_LIMIT = 2048
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page; hosts of the corpus with a blocked word in their name are listed."""
    pages = table(spark, sf_dir, "pages")
    words = "|".join(BLOCKED_WORDS)
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("domain")).distinct()
    blocked = hosts.filter(F.col("domain").rlike(rf"(^|[.-])({words})([.-]|$)"))
    return url_filter.url_filter(pages, URL_RULES, blocked)


OP1_SQL = rf"""
with parts as (
    select page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
    from pages
), judged as (
    select *, regexp_matches(host, '(^|[.-])({"|".join(BLOCKED_WORDS)})([.-]|$)') as listed,
        case
            when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
            when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
            when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
            when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
            when (host = 'org' or host like '%.org') and path like '/%' then 'org/'
        end as rule
    from parts
)
select page_id, host, path, rule,
    case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null or listed then 'block' else 'allow' end as verdict,
    listed
from judged
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that earlier documents have in runs of 50 or more."""
    cut = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("bytes", 256).alias("kept_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, whether it fails the base, and the verdict of the weighted votes."""
    counts = quality_rules.counted(table(spark, sf_dir, "documents"), "doc_id")
    judged = materialize(counts.withColumns(quality_rules.votes()), "votes")
    quality = quality_rules.posterior(quality_rules.fit(judged))
    failed = quality_rules.base_failed()
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = ~failed & (quality >= quality_rules.THRESHOLD)
    return judged.select(*named, failed.alias("base_failed"), kept.alias("kept"), quality.alias("quality"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside of the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = language_id.train(docs.filter(fold != 0))
    predicted = language_id.predicted(docs, model)
    return predicted.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by the slot map that is read back: dealt, then edited once for slots too full."""
    records = sharding.sized(table(spark, sf_dir, "documents"))
    path = fresh_path(spark, "slot-map")
    version = sharding.rebalance(records, path, sharding.deal(records, path, SHARDS), SHARDS)
    placed = sharding.sharded(records, sharding.stored(spark, path), version)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that they stand for, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decoded(byte_bpe.encoded(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates, named by its least doc_id."""
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    names = classes.filter(F.col("row") == F.col("class")).select("class", F.col("doc_id").alias("class_id"))
    return classes.join(names, "class").select("doc_id", "class_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations rebuilt on the heads they share."""
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.spliced(turns))


OP11_SQL = """
with crc_table as (
    select list(list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)
        order by n) as entries
    from (select range::bigint as n from range(256))
), own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as content, row_number() over (partition by conv_id
        order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, x: xor(entries[(xor(c, x) & 255) + 1], c >> 8))) % 6 as h
    from (select distinct conv_id from own), crc_table
), rebuilt as (
    select c.conv_id, 0 as half, o.pos, o.role, o.content from convs c join own o on o.conv_id = c.base and o.pos <= c.h
    union all
    select c.conv_id, 1, o.pos, o.role, o.content from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h
), whole as (
    select c.conv_id, coalesce(list({'role': r.role, 'content': r.content} order by r.half, r.pos) filter (where r.pos is not null), []) as turns
    from convs c left join rebuilt r on r.conv_id = c.conv_id group by c.conv_id
), paths as (
    select conv_id, d as depth, turns[1:d] as prefix, d = len(turns) as ends
    from (select *, unnest(range(len(turns) + 1)) as d from whole)
), named as (
    select *, min(conv_id) over (partition by depth, prefix) as node from paths
), nodes as (
    select n.node, n.depth, any_value(up.node) as parent, count(*) as n_convs,
        (count(*) - 1) * coalesce(any_value(length(n.prefix[n.depth].content)), 0) as own,
        sha256(coalesce(string_agg(n.conv_id::varchar, ',' order by n.conv_id) filter (where n.ends), '')) as ends_sha256
    from named n left join named up on up.conv_id = n.conv_id and up.depth = n.depth - 1
    group by n.node, n.depth
), children as (
    select n.*, (select count(*) from nodes c where c.parent = n.node and c.depth = n.depth + 1) as n_children from nodes n
), subtrees as (
    select m.node, m.depth, sum(c.own) as saved_tokens, count(*) filter (where c.n_children = 0) as n_leaves
    from children c join named m on m.conv_id = c.node and m.depth <= c.depth
    group by m.node, m.depth
)
select c.node as conv_id, c.depth, c.parent as parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
    s.saved_tokens::bigint as saved_tokens, c.ends_sha256
from children c join subtrees s on s.node = c.node and s.depth = c.depth
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the eight leading components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), count=8)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by the wrapper of its host."""
    return html_extraction.main_texts(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_html_extraction": op13_html_extraction,
    "pipeline": corpus_pipeline.run,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {"op1_url_filters": OP1_SQL, "op11_prefix_trie": OP11_SQL}
